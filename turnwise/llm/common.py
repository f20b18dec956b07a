"""Stored steps and size-checked broadcasts shared by the operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word: a run of characters other than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its file system: without a scheme it is one of the default system, as for Spark's readers."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return folder if default.startswith("file:") else default.rstrip("/") + folder


def step_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{qualified(spark, shared_folder(spark))}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; survives lost executors."""
    spark = df.sparkSession
    path = step_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it has at most ``rows`` rows.

    The count is read from the files' footers. A larger table is joined by a shuffle; the
    result is the same.
    """
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A lambda that captures an expression would evaluate it for each element instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
