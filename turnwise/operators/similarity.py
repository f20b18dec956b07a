"""Grouping of near-duplicate rule texts within a role and scope.

Rows are taken in order; each joins the first group whose first member is similar enough,
or founds a group. The result is that of the sequential rule, but it is reached in rounds
over all groups at once, without listing the pairs of a group and without gathering one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import top_k
from ..session import cut_lineage

_SPACE = ["role", "scope"]
#: Sets in pairs whose list is sent to all tasks, 8 bytes each.
FEW_SETS = 500_000


def word_set(c: Column) -> Column:
    """Distinct lower-case words of a text."""
    words = F.split(F.lower(c), r"(?U)\W+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def _least_overlap(n: Column, m: Column, threshold: float) -> Column:
    """Common words that sets of ``n`` and ``m`` words need at least to be similar."""
    low = _low(threshold)
    return F.ceil((n + m) * (low / (1 + low)) - 1e-9)


def _low(threshold: float) -> float:
    """Similarities are rounded to nine digits, so bounds are taken a little lower."""
    return round(threshold, 9) - 1e-9


def _sets(worded: DataFrame, leads: DataFrame) -> DataFrame:
    """``(role, scope, ord, n, own, ids, marks)`` of each lead.

    ``ids`` are its words as numbers, the rarest first; the ``own`` words that no other row has are left
    out, since they can't be common to two sets, as are leads that have no other words. ``marks`` are 512 bits, each turned
    round once for every id that falls on it: two sets differ in as many words as in bits, or in more.
    """
    tokens = worded.select("ord", F.explode("tokens").alias("token"))
    freq = tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1").orderBy("f", "token")
    freq = cut_lineage(freq.select("token", F.monotonically_increasing_id().alias("id")), "numbers")
    known = tokens.join(freq, "token").groupBy("ord").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    marks = F.expr(
        "transform(sequence(0, 7), k -> aggregate(filter(ids, x -> shiftright(x, 6) % 8 = k), 0L, "
        "(acc, x) -> acc ^ shiftleft(1L, cast(x % 64 AS INT))))"
    )
    sets = leads.join(known, "ord").withColumn("own", F.col("n") - F.size("ids")).withColumn("marks", marks)
    return cut_lineage(sets.select(*_SPACE, "ord", "n", "own", "ids", "marks"), "sets")


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """Buckets of each set: its rarest tokens, as many as two similar sets must share one of.

    Two sets with Jaccard ``t`` or more always meet in one of these buckets. ``pos`` is the place of the
    token among all words of the set, from 1.
    """
    keep = F.greatest(F.col("n") - F.ceil(F.col("n") * _low(threshold) - 1e-9) + 1 - F.col("own"), F.lit(0))
    first = sets.select(*_SPACE, "ord", "n", "own", F.slice("ids", F.lit(1), keep.cast("int")).alias("first"))
    placed = first.select(*_SPACE, "ord", "n", "own", F.posexplode("first").alias("at", "token"))
    return placed.select(*_SPACE, "ord", "n", "token", (F.col("own") + F.col("at") + 1).alias("pos"))


def _met(left: DataFrame, right: DataFrame, threshold: float, sets: DataFrame) -> DataFrame:
    """(ord, other) pairs that can be similar, ``other`` being earlier: by buckets, places and marks.

    How many words two sets must share depends on the sizes of both, and so do the prefixes that must share one.
    Behind the last word they share there, no more can follow than the shorter rest has.
    """
    other = right.select(*_SPACE, "token", F.col("ord").alias("other"), F.col("n").alias("m"), F.col("pos").alias("mpos"))
    n, m, low = F.col("n"), F.col("m"), _low(threshold)
    # A similar set is neither much shorter nor much longer.
    sized = (m >= n * low - 1e-9) & (n >= m * low - 1e-9)
    least = _least_overlap(n, m, threshold)
    early = (F.col("pos") <= n - least + 1) & (F.col("mpos") <= m - least + 1)
    shared = (
        left.join(other, [*_SPACE, "token"])
        .filter((F.col("other") < F.col("ord")) & sized & early)
        .groupBy("ord", "other", "n", "m")
        .agg(F.count("*").alias("k"), F.max("pos").alias("pos"), F.max("mpos").alias("mpos"))
        .filter(F.col("k") + F.least(n - F.col("pos"), m - F.col("mpos")) >= least)
    )
    a = sets.select("ord", "own", "marks")
    b = sets.select(F.col("ord").alias("other"), F.col("own").alias("mown"), F.col("marks").alias("mmarks"))
    bits = F.zip_with("marks", "mmarks", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda x, y: x + y) + F.col("own") + F.col("mown")
    return shared.join(a, "ord").join(b, "other").filter(apart <= n + m - 2 * least).select("ord", "other")


def _close(left: DataFrame, right: DataFrame, threshold: float, sets: DataFrame) -> DataFrame:
    """(ord, other) pairs that share a bucket, ``other`` being earlier, and are similar.

    Only the words of sets that are in a pair move; the list of these is sent to all tasks unless it is long.
    """
    met = cut_lineage(_met(left, right, threshold, sets), "met")
    wanted = cut_lineage(met.select(F.explode(F.array("ord", "other")).alias("ord")).distinct(), "wanted")
    few = wanted.count() <= FEW_SETS
    words = sets.select("ord", "n", "ids").join(F.broadcast(wanted) if few else wanted, "ord", "left_semi")
    a = words.select("ord", "n", F.col("ids").alias("a"))
    b = words.select(F.col("ord").alias("other"), F.col("n").alias("m"), F.col("ids").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    alike = F.round(common / (F.col("n") + F.col("m") - common), 9) >= round(threshold, 9)
    return met.join(a, "ord").join(b, "other").filter(alike).select("ord", "other")


def near_duplicates(entries: DataFrame, threshold: float, width: int = 32) -> DataFrame:
    """Members of every group of two or more: ``(role, scope, primary, row_id)``.

    ``entries`` is ``(row_id, role, scope, ord, text)`` with ``ord`` unique. Equal word sets
    are one entry until the end. In each round a bucket's first ``width`` open rows are
    compared with its later rows; a row all of whose earlier bucket mates were compared and
    which is similar to none of them founds a group, a row similar to a founder is
    settled. ``width`` doubles, so the number of rounds grows with the logarithm of a bucket.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    worded = entries.withColumn("tokens", F.array_sort(word_set(F.col("text")))).drop("text")
    worded = cut_lineage(worded.withColumn("key", F.sha2(F.array_join("tokens", " "), 256)), "words")
    # A row without words is similar to nothing, not even to its copies.
    leads = (
        worded.filter(F.size("tokens") > 0)
        .groupBy(*_SPACE, "key")
        .agg(F.min("ord").alias("ord"), F.any_value(F.size("tokens")).alias("n"))
    )
    leads = cut_lineage(leads, "leads")
    sets = _sets(worded, leads)
    buckets = cut_lineage(_prefixes(sets, threshold), "buckets")
    open_ = buckets
    founders = None
    while True:
        pivots = top_k(open_, [*_SPACE, "token"], [F.col("ord")], width, "__r").drop("__r")
        edges = cut_lineage(_close(open_, pivots, threshold, sets), "edges")
        # Clear: the row is a pivot in each of its buckets, so every earlier mate was compared.
        seen = pivots.groupBy("ord").agg(F.count("*").alias("p"))
        clear = (
            open_.groupBy("ord").agg(F.count("*").alias("b")).join(seen, "ord").filter("p = b").select("ord")
        )
        new = cut_lineage(clear.join(edges, "ord", "left_anti"), "founders")
        if new.isEmpty():
            break
        covered = edges.join(new.select(F.col("ord").alias("other")), "other", "left_semi").select("ord").distinct()
        founders = new if founders is None else founders.unionByName(new)
        open_ = cut_lineage(
            open_.join(new, "ord", "left_anti").join(covered, "ord", "left_anti"), "open"
        )
        width *= 2
    keys = [*_SPACE, "primary_ord"]
    # Every other set belongs to its earliest similar founder; a set without buckets is like no other.
    placed = leads.select(*_SPACE, "key", F.col("ord").alias("primary_ord"))
    if founders is not None:
        leading = buckets.join(founders, "ord", "left_semi")
        others = buckets.join(founders, "ord", "left_anti")
        joined = _close(others, leading, threshold, sets).groupBy("ord").agg(F.min("other").alias("first"))
        placed = leads.join(joined, "ord", "left").select(*_SPACE, "key", F.coalesce("first", "ord").alias("primary_ord"))
    members = worded.join(placed, [*_SPACE, "key"]).select(*keys, "row_id", "ord")
    large = members.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("row_id", "ord").alias("primary")).filter("n > 1")
    return members.join(large, keys).select(*_SPACE, "primary", "row_id")
