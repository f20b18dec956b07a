"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces; nothing is truncated. The pieces are
dealt into blocks of about ``BLOCK_ROWS`` rows by a hash of their row number, so that neither a
frequent identifier nor a group of copies gathers in one block, and each block is packed alone. In a
block the pieces go, longest first, into the open bin that they leave the least room in; if none
fits, a new bin opens in the size whose cost per filled token is least. That is tried with every
permitted length as the largest that may be opened, each bin is downsized to the smallest length
that holds its contents, and the cheapest of these plans is taken. A block's last bins are the only
loss against packing everything at once: at most a few bins in ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SIZES = (512, 1024, 2048, 4096, 8192)
BLOCK_ROWS = 20_000
#: Cost of a sequence: its tokens, attention that grows with their square, and a fixed part.
FIXED_COST, QUADRATIC_AT = 256.0, 16_384.0


def cost(size: int) -> float:
    return FIXED_COST + size + size * size / QUADRATIC_AT


def _fill(lengths: list[int], order: list[int], sizes: tuple[int, ...], top: int) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, its place there, and the contents of each bin."""
    left = sum(lengths)
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins, places, filled = [0] * len(lengths), [0] * len(lengths), []
    capacity: list[int] = []
    for i in order:
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            free = rooms[at]
            b = room[free].pop()
            if not room[free]:
                del room[free]
                del rooms[at]
        else:
            fit = [s for s in sizes if n <= s <= top] or [s for s in sizes if s >= n][:1]
            size = min(fit, key=lambda s: (cost(s) / min(s, left), s))
            b = len(filled)
            filled.append(0)
            capacity.append(size)
        bins[i], places[i] = b, filled[b]
        filled[b] += n
        left -= n
        free = capacity[b] - filled[b]
        if free:
            if free not in room:
                room[free] = []
                insort(rooms, free)
            room[free].append(b)
    return bins, places, filled


def best_fit(lengths: list[int], sizes: Iterable[int] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each piece, and the size of each bin, for the cheapest of the plans.

    Every length must lie between 1 and the largest size. Equal lengths keep their order.
    """
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best = None
    for top in sizes:
        plan = _fill(lengths, order, sizes, top)
        final = [sizes[bisect_left(sizes, n)] for n in plan[2]]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, plan, final)
    return best[1][0], best[1][1], best[2]


def pack(docs: DataFrame, length: Column, keep: list[str], sizes: Iterable[int] = SIZES) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, for each piece, where it goes.

    ``piece`` (from 0), ``piece_start`` and ``piece_length`` say which part of the document it is,
    ``bin_id``, ``bin_size`` and ``bin_start`` in which sequence and at which place it stands. A document
    of length 0 or null has one piece of length 0 and no bin. Repeated rows and null identifiers are
    packed like any others. ``keep`` must not name one of the new columns. An empty table gives an empty one.
    """
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    n = F.coalesce(length, F.lit(0)).cast("long")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), n.alias("__n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("__n") / most) - 1).cast("long")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("piece_start", F.col("piece") * most)
    rows = rows.withColumn("piece_length", F.least(F.lit(most).cast("long"), F.col("__n") - F.col("piece_start")))
    rows = stored(rows.drop("__n"), "pieces")
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    # the stored files fix the row numbers, so that a repeated task deals in the same way
    row = F.monotonically_increasing_id()
    dealt = rows.withColumn("__row", row).withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(blocks)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__row", ignore_index=True)
        filled = part["piece_length"] > 0
        bins, places, final = best_fit(part.loc[filled, "piece_length"].tolist(), sizes)
        for name in ("bin_id", "bin_size", "bin_start"):
            part[name] = pd.array([None] * len(part), dtype="Int64")
        part.loc[filled, "bin_id"] = pd.array([(key[0] << 32) + b for b in bins], dtype="Int64")
        part.loc[filled, "bin_size"] = pd.array([final[b] for b in bins], dtype="Int64")
        part.loc[filled, "bin_start"] = pd.array(places, dtype="Int64")
        return part.drop(columns=["__row", "__block"])

    schema = rows.schema
    for name in ("bin_id", "bin_size", "bin_start"):
        schema = schema.add(name, "long")
    return dealt.groupBy("__block").applyInPandas(run, schema)
