"""Running values along an order, for keys that may hold any share of the rows.

A window partitioned by a key puts the whole key into one task. Here each key is
cut into segments along its order: a first window works inside each (key, segment),
a one-row summary per segment carries counts, sums and last values forward, and the
two are joined. Only keys that span several segments take part in the second step: they
are found by a pre-aggregated pass over the key columns alone, and where there are none
the summary stays empty. So ordinary keys pay for one shuffle of the data and hot keys
are spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of one key handled by one task.
SEGMENT_ROWS = 65_536
#: Segments of equal depth at most.
MOST_SEGMENTS = 4_096

_SEG = "__segment"


def position_segment(position: str, rows: int = SEGMENT_ROWS) -> Column:
    """Segment number for keys ordered by a dense integer position."""
    return F.floor(F.col(position) / F.lit(rows))


def by_depth(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SEGMENT_ROWS, name: str = "__depth"
) -> DataFrame:
    """``df`` with a segment number ``name`` that grows along ``order`` within a key, about ``rows`` rows each.

    Segments follow the rows, not the values of ``order``: Spark's range partitioning samples the rows and cuts
    them into parts of equal depth, so a far-off value or a sparse stretch makes no difference. There are
    at most ``MOST_SEGMENTS`` of them, which bounds what is carried from one to the next; beyond that many rows
    the segments grow. Row counts per key come first, in a pre-aggregated pass; if no key has more than ``rows``
    rows, there is one segment and nothing moves. Otherwise the parts are stored, since the numbers must be
    the same wherever the result is read.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    most, total = per_key.agg(F.max("n"), F.sum("n")).first()
    if not most or most <= rows:
        return df.withColumn(name, F.lit(0))
    parts = min(MOST_SEGMENTS, -(-total // rows))
    columns = [F.col(f"`{c}`") for c in (*keys, *order)]
    placed = df.repartitionByRange(parts, *columns).withColumn(name, F.spark_partition_id())
    return cut_lineage(placed, "segments")


def scan_by_depth(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SEGMENT_ROWS, **running
) -> DataFrame:
    """``scan`` over segments of equal depth: for orders that are no dense position, and without keys."""
    return scan(by_depth(df, keys, order, rows), keys, order, F.col("__depth"), **running).drop("__depth")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    *,
    index: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    ``index`` numbers the rows of a key from 0; ``sums`` are running sums including
    the row; ``lasts`` the last non-null value up to and including the row;
    ``lags``/``leads`` the value of the previous/next row. ``order`` must be total
    within a key and ``segment`` must not decrease along it; keys must not be null.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    lags, leads = dict(lags or {}), dict(leads or {})
    keys = list(keys)
    base = df.withColumn(_SEG, segment)
    for name, c in {**sums, **lasts, **lags, **leads}.items():
        base = base.withColumn(f"__v_{name}", c)
    local = W.partitionBy(*keys, _SEG).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    row = base.select(
        "*",
        *([(F.row_number().over(local) - 1).cast("long").alias("__i")] if index else []),
        *(F.sum(f"__v_{n}").over(upto).alias(f"__s_{n}") for n in sums),
        *(F.last(f"__v_{n}", ignorenulls=True).over(upto).alias(f"__l_{n}") for n in lasts),
        *(F.lag(F.struct(F.col(f"__v_{n}").alias("v"))).over(local).alias(f"__g_{n}") for n in lags),
        *(F.lead(F.struct(F.col(f"__v_{n}").alias("v"))).over(local).alias(f"__d_{n}") for n in leads),
    )

    place = F.struct(*order)
    several = base
    if keys:
        wide = (
            base.groupBy(*keys)
            .agg(F.min(_SEG).alias("__lo"), F.max(_SEG).alias("__hi"))
            .filter("__lo < __hi")
            .select(*keys)
        )
        several = base.join(wide, keys, "left_semi")
    several = several.groupBy(*keys, _SEG).agg(
        F.count("*").alias("__n"),
        *(F.sum(f"__v_{n}").alias(f"__v_{n}") for n in sums),
        *(
            F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__v_{n}")
            for n in lasts
        ),
        *(F.max_by(F.struct(F.col(f"__v_{n}").alias("v")), place).alias(f"__v_{n}") for n in lags),
        *(F.min_by(F.struct(F.col(f"__v_{n}").alias("v")), place).alias(f"__v_{n}") for n in leads),
    )
    chain = W.partitionBy(*keys).orderBy(_SEG) if keys else W.orderBy(_SEG)
    prior = chain.rowsBetween(W.unboundedPreceding, -1)
    carry = several.select(
        *(F.col(k).alias(f"__k_{k}") for k in keys),
        F.col(_SEG).alias("__k_segment"),
        F.sum("__n").over(prior).alias("__cn"),
        *(F.sum(f"__v_{n}").over(prior).alias(f"__c_{n}") for n in sums),
        *(F.last(f"__v_{n}", ignorenulls=True).over(prior).alias(f"__c_{n}") for n in lasts),
        *(F.lag(f"__v_{n}").over(chain).alias(f"__c_{n}") for n in lags),
        *(F.lead(f"__v_{n}").over(chain).alias(f"__c_{n}") for n in leads),
    )
    # The rows are already partitioned by these columns, the carried values are few.
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    same = same & (F.col(_SEG) == F.col("__k_segment"))
    joined = row.join(carry, same, "left")

    zero = F.lit(0)
    out = {
        **({index: F.col("__i") + F.coalesce(F.col("__cn"), zero)} if index else {}),
        **{
            n: F.when(
                F.col(f"__s_{n}").isNotNull() | F.col(f"__c_{n}").isNotNull(),
                F.coalesce(F.col(f"__s_{n}"), zero) + F.coalesce(F.col(f"__c_{n}"), zero),
            )
            for n in sums
        },
        **{n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in lasts},
        **{n: F.coalesce(F.col(f"__g_{n}"), F.col(f"__c_{n}"))["v"] for n in lags},
        **{n: F.coalesce(F.col(f"__d_{n}"), F.col(f"__c_{n}"))["v"] for n in leads},
    }
    kept = [F.col(c) for c in df.columns if c not in out]
    return joined.select(*kept, *(c.alias(n) for n, c in out.items()))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each key; each task keeps ``k`` rows before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
