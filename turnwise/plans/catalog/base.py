"""Registry of queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"query {name} is registered twice")
        RUNS[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class View:
    """Columns derived from one table by expressions that both dialects read."""

    def __init__(self, source: str, where: str | None = None, **columns: str) -> None:
        self.source, self.where, self.columns = source, where, columns

    def load(self, spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, self.source)
        if self.where:
            df = df.filter(self.where)
        return df.selectExpr(*(f"{e} AS {n}" for n, e in self.columns.items()))

    @property
    def sql(self) -> str:
        listed = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"SELECT {listed} FROM {self.source}" + (
            f" WHERE {self.where}" if self.where else ""
        )


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squash_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that the last bits of a sum do not matter."""
    return df.select(
        *(
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        )
    )


def rounded_sql(sql: str, columns: dict[str, bool], digits: int = 6) -> str:
    """``sql`` with the columns marked true rounded in the same way."""
    listed = ", ".join(
        f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" if double else c
        for c, double in columns.items()
    )
    cte, _, body = sql.rpartition("--main")
    return f"{cte} SELECT {listed} FROM ({body})"


def spread(df: DataFrame) -> DataFrame:
    """Give an input in fewer files than cores to all cores; inputs of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
