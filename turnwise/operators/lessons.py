"""Versioned lesson tables: append, transition, merge, retrieve and audit.

``versions`` is append-only: ``(lesson_id, version, position, role, scope, trigger, do,
avoid, criterion, lifecycle, merged)``; ``position`` is the order in which a lesson first
arrived. What a lesson cites is a table of links, one row per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.hashing import canonical_hash, set_digest
from ..functions.segments import top_k
from .paired import reasons

MERGEABLE = ["validated", "promoted"]


def lesson_current(versions: DataFrame) -> DataFrame:
    """The newest version of every lesson."""
    return top_k(versions, ["lesson_id"], [F.col("version").desc()], 1, "__k").drop("__k")


def version_violations(versions: DataFrame) -> DataFrame:
    """Lessons whose versions do not run 1, 2, 3 … without gaps or repeats."""
    stats = versions.groupBy("lesson_id").agg(
        F.min("version").alias("lo"),
        F.max("version").alias("hi"),
        F.count("*").alias("n"),
        F.count_distinct("version").alias("d"),
    )
    found = reasons(
        (F.col("lo") != 1, "first_version_not_one"),
        (F.col("n") != F.col("d"), "repeated_version"),
        (F.col("hi") - F.col("lo") + 1 != F.col("d"), "version_gap"),
    )
    return stats.select("lesson_id", F.explode(found).alias("violation"))


def lesson_append(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that continue their lesson by exactly one version, ready to be appended."""
    newest = versions.groupBy("lesson_id").agg(F.max("version").alias("__v"))
    expected = F.coalesce("__v", F.lit(0)) + 1
    return (
        entries.join(newest, "lesson_id", "left").filter(F.col("version") == expected).drop("__v")
    )


def transition_violations(versions: DataFrame) -> DataFrame:
    """Consecutive versions whose lifecycle change is not allowed.

    A merge keeps the lifecycle, or retires the folded lesson.
    """
    before = versions.select(
        "lesson_id", (F.col("version") + 1).alias("version"), F.col("lifecycle").alias("before")
    )
    moves = versions.select("lesson_id", "version", "lifecycle", "merged").join(
        before, ["lesson_id", "version"]
    )
    allowed = F.lit(False)
    for a, b in K.LIFECYCLE_MOVES:
        allowed = allowed | ((F.col("before") == a) & (F.col("lifecycle") == b))
    by_merge = (
        F.col("merged")
        & F.col("before").isin(MERGEABLE)
        & ((F.col("lifecycle") == F.col("before")) | (F.col("lifecycle") == "retired"))
    )
    return moves.filter(~(allowed | by_merge))


def lesson_transition(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Next versions for ``wanted(lesson_id, lifecycle)``; refused ones have ``ok`` false."""
    asked = wanted.select("lesson_id", F.col("lifecycle").alias("__to"))
    needed = F.when(F.col("__to") == "promoted", "validated").when(
        F.col("__to").isin("quarantined", "retired"), "promoted"
    )
    ok = F.coalesce(F.col("lifecycle") == needed, F.lit(False))
    return (
        current.join(asked, "lesson_id")
        .withColumn("ok", ok)
        .withColumn("version", F.when(F.col("ok"), F.col("version") + 1).otherwise(F.col("version")))
        .withColumn("lifecycle", F.when(F.col("ok"), F.col("__to")).otherwise(F.col("lifecycle")))
        .drop("__to")
    )


def mergeable_groups(current: DataFrame, groups: DataFrame) -> DataFrame:
    """Primaries of groups that may be merged.

    ``groups`` is ``(primary_id, lesson_id, ord)``, the primary itself at ``ord`` 0. A group is
    refused when a member is missing, not validated or promoted, or of another role or
    scope.
    """
    return (
        groups.join(current.select("lesson_id", "lifecycle", "role", "scope"), "lesson_id", "left")
        .groupBy("primary_id")
        .agg(
            F.bool_and(F.coalesce(F.col("lifecycle").isin(MERGEABLE), F.lit(False))).alias("fine"),
            F.min("role").alias("r1"),
            F.max("role").alias("r2"),
            F.min("scope").alias("s1"),
            F.max("scope").alias("s2"),
            F.count("*").alias("n"),
        )
        .filter("fine AND r1 = r2 AND s1 = s2 AND n > 1")
        .select("primary_id")
    )


def merge_lessons(current: DataFrame, groups: DataFrame) -> DataFrame:
    """Next versions of a merge: primaries keep their lifecycle, duplicates retire."""
    members = groups.join(mergeable_groups(current, groups), "primary_id", "left_semi")
    lifecycle = F.when(F.col("ord") > 0, "retired").otherwise(F.col("lifecycle"))
    return (
        current.join(members, "lesson_id")
        .withColumn("lifecycle", lifecycle)
        .withColumn("version", F.col("version") + 1)
        .withColumn("merged_into", F.when(F.col("ord") > 0, F.col("primary_id")))
        .drop("primary_id", "ord")
    )


def merge_links(current: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """What merged primaries cite: the ordered union of their members' links.

    ``links`` is ``(lesson_id, kind, pos, value)`` with the sources, validation results and
    folded ids of a lesson; folded duplicates are added as ``merged_from``. One row per
    value, its first place as ``(ord, pos)``: a group of copies of any size stays rows.
    """
    members = groups.join(mergeable_groups(current, groups), "primary_id", "left_semi")
    cited = members.join(links, "lesson_id").filter((F.col("kind") != "merged_from") | (F.col("ord") == 0))
    folded = members.filter("ord > 0").select(
        "primary_id",
        F.lit("merged_from").alias("kind"),
        "ord",
        F.lit(0).cast("long").alias("pos"),
        F.col("lesson_id").alias("value"),
    )
    rows = cited.select("primary_id", "kind", "ord", F.col("pos").cast("long").alias("pos"), "value")
    return (
        rows.unionByName(folded)
        .groupBy(F.col("primary_id").alias("lesson_id"), "kind", "value")
        .agg(F.min(F.struct("ord", "pos")).alias("place"))
        .select("lesson_id", "kind", "value", "place.ord", "place.pos")
    )


def rule_text() -> Column:
    fields = ("trigger", "do", "avoid", "criterion")
    return T.squash(F.concat(*(x for before, c in zip(K.RULE_TEXT, fields) for x in (F.lit(before), F.col(c)))))


def retrieve_lessons(versions: DataFrame, limit: int) -> DataFrame:
    """Per (role, scope) the first ``limit`` lessons whose current version is promoted."""
    promoted = lesson_current(versions).filter("lifecycle = 'promoted'")
    return top_k(promoted, ["role", "scope"], [F.col("position"), F.col("lesson_id")], limit).select(
        "role", "scope", "rank", "lesson_id", rule_text().alias("rule")
    )


def lesson_blocks(retrieved: DataFrame, by_topic: bool) -> DataFrame:
    """Rules of a scope, or of a scope's topic, in one list (the retrieval limit bounds it)."""
    scope = F.split_part("scope", F.lit("|"), F.lit(1)) if by_topic else F.col("scope")
    ordered = F.array_sort(F.collect_list(F.struct("scope", "rank", "rule")))
    return retrieved.groupBy("role", scope.alias("key")).agg(
        F.transform(ordered, lambda s: s["rule"]).alias("rules")
    )


def audit_transfer(
    observations: DataFrame, minimum_support: int, win_rate: float
) -> DataFrame:
    """Monitoring verdict per promoted lesson from ``(lesson_id, benefit)``."""
    stats = observations.groupBy("lesson_id").agg(
        F.count("*").alias("n"),
        F.avg("benefit").alias("mean_benefit"),
        F.avg((F.col("benefit") > 0).cast("double")).alias("wins"),
    )
    mean, wins = F.round("mean_benefit", 9), F.round("wins", 9)
    few = F.col("n") < minimum_support
    return stats.select(
        "lesson_id",
        F.when(few, "insufficient-support")
        .when((mean <= 0) | (wins < win_rate), "retire")
        .otherwise("keep")
        .alias("verdict"),
        F.when(few, "insufficient_transfer_support")
        .when(mean <= 0, "non_positive_mean_paired_benefit")
        .when(wins < win_rate, "transfer_win_rate_below_requirement")
        .otherwise("positive_transfer_supported")
        .alias("reason"),
    )


def poison_check(lessons: DataFrame, sources: DataFrame) -> DataFrame:
    """Label-shaped text and single-source support per lesson.

    ``sources`` is ``(lesson_id, source_id)``.
    """

    def shaped(c: str) -> Column:
        key = T.strip(F.split_part(F.col(c), F.lit(":"), F.lit(1)))
        return F.contains(F.col(c), F.lit(":")) & key.isin(K.FORBIDDEN_LABEL_KEYS)

    label = F.lit(False)
    for c in ("trigger", "do", "avoid", "criterion", "scope"):
        label = label | shaped(c)
    stats = sources.groupBy("lesson_id").agg(
        F.min("source_id").alias("lo"), F.max("source_id").alias("hi")
    )
    return lessons.join(stats, "lesson_id", "left").select(
        "lesson_id",
        label.alias("label_shaped"),
        F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)).alias("single_source"),
    )


def conflicts(current: DataFrame) -> DataFrame:
    """Promoted lessons whose scope holds another promoted lesson with a different ``do``.

    A scope conflicts exactly when it has two distinct ``do`` texts, and then every lesson
    of the scope has an opponent: no pairs need to be listed.
    """
    promoted = current.filter("lifecycle = 'promoted'")
    split = promoted.groupBy("scope").agg(F.min("do").alias("a"), F.max("do").alias("b")).filter("a <> b")
    return promoted.join(split.select("scope"), "scope", "left_semi").select("lesson_id", "scope")


def distill_candidates(contrasts: DataFrame) -> DataFrame:
    """Candidate lessons from ``(lesson_key, scope, role, contrast_id, accepted)``.

    A key with a rejected contrast or with several roles gives no lesson. The generated id
    hashes role, scope and the digest of the source ids; the sources stay rows.
    """
    stats = contrasts.groupBy("lesson_key", "scope").agg(
        F.bool_and("accepted").alias("verified"),
        F.min("role").alias("role"),
        F.max("role").alias("role2"),
        *set_digest(F.col("contrast_id"), "src_"),
    )
    digest = F.concat_ws(":", *(F.col(f"src_{x}").cast("string") for x in ("n", "s0", "s1", "s2", "s3")))
    return stats.filter("verified AND role = role2").select(
        "lesson_key",
        "scope",
        "role",
        canonical_hash(role=F.col("role"), scope=F.col("scope"), sources=digest).alias("lesson_id"),
        F.lit(1).alias("version"),
        F.lit("candidate").alias("lifecycle"),
        F.col("src_n").alias("sources"),
    )
