"""Append-only evidence memory, contradictions, scheduling and the criterion map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.hashing import canonical_hash
from ..functions.segments import top_k
from .retrieval import tier_rank


def record_id(session: Column, topic: Column, turn_ids: Column, quote: Column) -> Column:
    """Content hash of a claim: the same claim found twice has the same id."""
    return canonical_hash(
        participant=session.cast("string"), topic=topic, turn_ids=turn_ids, quote=quote
    )


def new_evidence(memory: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` that memory does not hold yet, each id once (the first round).

    Writing the result in append mode is idempotent: a second run finds nothing new.
    """
    return top_k(
        found.join(memory.select("record_id"), "record_id", "left_anti"),
        ["record_id"],
        [F.col("round_index"), F.col("confidence").desc()],
        1,
        "__k",
    ).drop("__k")


def append_evidence(memory: DataFrame, found: DataFrame) -> DataFrame:
    return memory.unionByName(new_evidence(memory, found).select(*memory.columns))


def _side() -> Column:
    present = (F.col("polarity") == "supports") & (F.col("frequency_basis") != "none")
    return F.when(F.col("polarity") == "refutes", "refutes").when(present, "supports")


def contradiction_sides(evidence: DataFrame) -> DataFrame:
    """Records that contradict others of their (session, topic): how many, and the first of them.

    Within a group every denial stands against every report of presence, so the two
    sides name all contradictions in a table no longer than the evidence itself.
    """
    sided = evidence.withColumn("side", _side()).filter(F.col("side").isNotNull())
    place = F.struct("round_index", "record_id")

    def first(side: str) -> Column:
        return F.min(F.when(F.col("side") == side, place)).alias(f"first_{side}")

    groups = (
        sided.groupBy("session_id", "topic")
        .agg(
            F.count_if(F.col("side") == "refutes").alias("refuting"),
            F.count_if(F.col("side") == "supports").alias("supporting"),
            first("refutes"),
            first("supports"),
        )
        .filter((F.col("refuting") > 0) & (F.col("supporting") > 0))
    )
    refutes = F.col("side") == "refutes"
    return sided.join(groups, ["session_id", "topic"]).select(
        "session_id",
        "topic",
        "record_id",
        "round_index",
        "side",
        F.when(refutes, F.col("supporting")).otherwise(F.col("refuting")).alias("counterparts"),
        F.when(refutes, F.col("first_supports")).otherwise(F.col("first_refutes")).alias("first"),
    )


def contradiction_counts(evidence: DataFrame) -> DataFrame:
    """Number of contradicting record pairs per (session, topic), without listing them."""
    side = _side()
    return (
        evidence.groupBy("session_id", "topic")
        .agg(
            F.count_if(side == "refutes").alias("r"),
            F.count_if(side == "supports").alias("s"),
        )
        .filter((F.col("r") > 0) & (F.col("s") > 0))
        .select("session_id", "topic", (F.col("r") * F.col("s")).alias("contradictions"))
    )


def contradictions(sides: DataFrame) -> DataFrame:
    """Each contradicting record with the first record that it stands against.

    Together with ``counterparts`` this says all that a list of every pair would, in as many rows as
    there are records: the other counterparts are the records of the other side. ``earlier_record_id``
    is the one of an earlier round, if the rounds differ.
    """
    first = F.col("first")
    return sides.select(
        "session_id",
        "topic",
        "record_id",
        first["record_id"].alias("counterpart_id"),
        "counterparts",
        F.lit(K.CONTRADICTION_REASON).alias("reason"),
        F.when(F.col("round_index") < first["round_index"], F.col("record_id"))
        .when(first["round_index"] < F.col("round_index"), first["record_id"])
        .alias("earlier_record_id"),
    )


# --- scheduling -------------------------------------------------------------------


def _sufficient() -> Column:
    return F.coalesce("sufficient", F.lit(False))


def topic_need() -> Column:
    rank = tier_rank(F.col("tier"))
    return F.when(_sufficient(), 0.0).otherwise(1.0 - rank / F.lit(len(K.TIERS) - 1))


def redundancy() -> Column:
    return F.when(F.col("max_rounds") <= 0, 1.0).otherwise(
        F.least(F.lit(1.0), F.try_divide("rounds_spent", "max_rounds"))
    )


def experience(lesson_scopes: Sequence[str]) -> Column:
    """1 when a promoted rule covers the (topic, tier) state."""
    if not lesson_scopes:
        return F.lit(0.0)
    scope = F.concat_ws("|", "topic", "tier")
    return F.when(scope.isin(list(lesson_scopes)), 1.0).otherwise(0.0)


def with_utility(states: DataFrame, lesson_scopes: Sequence[str] = ()) -> DataFrame:
    """Utility of spending a round; ``states`` is per (session, topic)."""
    value = (
        topic_need()
        + K.EXPERIENCE_WEIGHT * experience(lesson_scopes)
        - K.REDUNDANCY_WEIGHT * redundancy()
    )
    resolved = _sufficient() | (F.col("rounds_spent") >= F.col("max_rounds"))
    return states.withColumns({"utility": F.round(value, 9), "resolved": resolved})


def next_action(states: DataFrame, lesson_scopes: Sequence[str] = ()) -> DataFrame:
    """Per session the unresolved topic of highest utility, the earliest among equals."""
    open_ = with_utility(states, lesson_scopes).filter(~F.col("resolved"))
    return top_k(open_, ["session_id"], [F.col("utility").desc(), F.col("topic_ord")], 1).drop("rank")


# --- explanation ------------------------------------------------------------------


def counterfactual(score: Column, sufficient: Column) -> Column:
    """What evidence would change the score, from the day bands next to it."""
    bands = F.lit(K.DAY_BANDS)

    def band(s: Column) -> Column:
        return F.try_element_at(bands, (s + 1).cast("int"))

    def sentence(parts: tuple[str, str], to: Column) -> Column:
        return F.concat(F.lit(parts[0]), band(to), F.lit(parts[1]), to.cast("string"))

    up = F.when(score < K.ITEM_MAX, sentence(K.COUNTERFACTUAL_UP, score + 1))
    down = F.when(score > 0, sentence(K.COUNTERFACTUAL_DOWN, score - 1))
    return F.when(~sufficient | score.isNull(), K.COUNTERFACTUAL_UNSCORED).otherwise(
        F.concat_ws("; ", up, down)
    )


def _mean3(c: str) -> Column:
    """Mean to three places, rounded as a decimal so that ties do not depend on bits."""
    return F.round(F.avg(c).cast("decimal(20,9)"), 3).cast("double")


def criterion_map(item_results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status, confidence and contradictions of every (session, topic).

    The records behind a row are the rows of ``evidence`` with the same session and
    topic, and the contradicting ones those of ``contradiction_sides``: they stay rows,
    so that no group has to be gathered into a list.
    """
    support = evidence.groupBy("session_id", "topic").agg(
        F.count("*").alias("records"), _mean3("confidence").alias("confidence")
    )
    status = (
        F.when(F.col("abstained"), "unresolved")
        .when(F.col("present") == "no", "refuted")
        .otherwise("supported")
    )
    keys = ["session_id", "topic"]
    return (
        item_results.join(support, keys, "left")
        .join(contradiction_counts(evidence), keys, "left")
        .select(
            "session_id",
            "topic",
            status.alias("status"),
            "score",
            F.coalesce("records", F.lit(0)).cast("long").alias("records"),
            "confidence",
            F.col("contradictions").isNotNull().alias("contradiction"),
            F.coalesce("contradictions", F.lit(0)).cast("long").alias("contradictions"),
            counterfactual(F.col("score"), ~F.col("abstained")).alias("counterfactual"),
        )
    )


def criterion_records(item_results: DataFrame, evidence: DataFrame) -> DataFrame:
    """The records behind the rows of ``criterion_map``: ``(session_id, topic, record_id, side, counterpart_id)``.

    ``side`` and ``counterpart_id`` (the first record it stands against) are null where a record
    contradicts nothing. One row per record, so a topic may have any number.
    """
    keys = ["session_id", "topic"]
    behind = evidence.select(*keys, "record_id").join(item_results.select(*keys), keys, "left_semi")
    sides = contradiction_sides(evidence).select(*keys, "record_id", "side", F.col("first.record_id").alias("counterpart_id"))
    return behind.join(sides, [*keys, "record_id"], "left")


def collect_maps(criterion_maps: DataFrame) -> DataFrame:
    """One review row per session; a session has one row per topic of the scale."""

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("topic"))))

    contradicted, unresolved = F.col("contradiction"), F.col("status") == "unresolved"
    return criterion_maps.groupBy("session_id").agg(
        names(contradicted).alias("contradicted_criteria"),
        names(unresolved).alias("unresolved_criteria"),
        F.count_if(contradicted).alias("contradicted"),
        F.count_if(unresolved).alias("unresolved"),
    )
