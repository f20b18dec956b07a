"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``BITS`` bits, the cells are numbered along a Hilbert curve, the rows
are sorted by that number, and equal runs of the sorted rows become the shards, so that a shard
covers a compact region of the dimensions and a filter on any of them can skip files. Cells hold any
share of the rows: ties go by size, text and identifier, so one cell spreads over as many range
partitions as it needs. A row's rank is its place in its range partition plus the rows of those
before it; only one number per partition is summed up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

BITS = 8


def quantise_text(c: Column) -> Column:
    """A cell number for a category: its hash; null has a cell like any value."""
    return F.pmod(F.xxhash64(F.coalesce(c, F.lit("\\0"))), F.lit(1 << BITS)).cast("int")


def quantise_size(c: Column) -> Column:
    """A cell number for a size: a sixteenth of a power of two each."""
    log = F.log2(F.coalesce(c, F.lit(0)).cast("double") + 1) * 10
    return F.least(F.lit((1 << BITS) - 1), F.floor(log)).cast("int")


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place of a cell on the Hilbert curve through a cube of ``2**bits`` cells a side.

    The coordinates are turned into the transposed index level by level: per level and dimension, an
    exchange or an inversion of the lower bits, then a Gray code over the dimensions. Each level is a
    fold over an array, so that the expression stays short.
    """
    n = len(cells)
    start = F.array(*(c.cast("int") for c in cells))

    def level(x: Column, q: Column) -> Column:
        def turn(x: Column, i: int) -> Column:
            low = q - 1
            first, own = F.get(x, F.lit(0)), F.get(x, F.lit(i))
            swap = (first.bitwiseXOR(own)).bitwiseAND(low)
            inverted = own.bitwiseAND(q) != 0
            new_first = F.when(inverted, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
            new_own = F.when(inverted, own).otherwise(own.bitwiseXOR(swap))
            out = [F.get(x, F.lit(j)) for j in range(n)]
            out[i] = new_own
            out[0] = new_first
            return F.array(*out)

        return reduce(lambda acc, i: F.element_at(F.transform(F.array(acc), lambda y: turn(y, i)), 1), range(n), x)

    levels = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)))
    turned = F.aggregate(levels, start, level)

    def gray(x: Column) -> Column:
        out = [F.get(x, F.lit(0))]
        for j in range(1, n):
            out.append(F.get(x, F.lit(j)).bitwiseXOR(out[j - 1]))
        return F.array(*out)

    def flip(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        t = F.aggregate(
            levels, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    def weave(x: Column) -> Column:
        places = F.array(*(F.lit(b) for b in range(bits - 1, -1, -1)))
        return F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda acc, b: reduce(
                lambda a, j: a * 2 + F.call_function("shiftright", F.get(x, F.lit(j)), b).bitwiseAND(F.lit(1)), range(n), acc
            ),
        )

    one = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    return one(one(one(turned, gray), flip), weave)


def rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank``, the place of each row in the order from 0, and ``total``, their number.

    The rows are range-partitioned, sorted and stored once; a row's number in its file comes from
    Spark's own row number. ``df`` is evaluated twice, as Spark samples it for the ranges first. Repeated rows get ranks of their own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row per partition
    before = counts.select(
        "__part",
        (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(W.partitionBy()).alias("total"),
    )
    inside = F.col("__at") - F.shiftleft(part, 33)
    out = placed.join(F.broadcast(before), part == F.col("__part"))  # one row per partition
    return out.withColumn("rank", F.col("__before") + inside).drop("__at", "__part", "__before", "__n")


def cut(df: DataFrame, shards: int) -> DataFrame:
    """``rank`` and ``total`` replaced by ``shard`` and ``slot``: runs whose lengths differ by one at most."""
    base, extra = F.floor(F.col("total") / shards), F.col("total") % shards
    long_rows = extra * (base + 1)
    r = F.col("rank")
    rest = r - long_rows
    short = F.greatest(base, F.lit(1))
    shard = F.when(r < long_rows, F.floor(r / (base + 1))).otherwise(extra + F.floor(rest / short))
    slot = F.when(r < long_rows, r % (base + 1)).otherwise(rest % short)
    return df.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("rank", "total")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """A row per document: identifier, size, text hash, cells, curve index, shard and slot.

    ``docs`` needs ``doc_id``, ``text``, ``lang`` and ``source``; other columns are left aside. The dimensions
    are language, source and size. A null text has the size and hash of an empty one; null languages
    and sources share a cell of their own. Rows that agree in everything are told apart by their place alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        quantise_text(F.col("lang")).alias("lang_cell"),
        quantise_text(F.col("source")).alias("source_cell"),
        quantise_size(F.octet_length(text)).alias("size_cell"),
    )
    cells = [F.col(c) for c in ("lang_cell", "source_cell", "size_cell")]
    keyed = rows.withColumn("curve", hilbert_index(cells))
    return cut(rank(keyed, ["curve", "size", "text_crc32", "doc_id"]), shards)


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: rows, bytes and the range of each dimension per shard."""
    ranges = [f(c).alias(f"{n}_{c}") for c in ("lang_cell", "source_cell", "size_cell") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)
