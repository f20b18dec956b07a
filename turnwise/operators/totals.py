"""Imputation, totals, severity and per-session diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def clamp(c: Column, low: float, high: float) -> Column:
    """Clamp to a range; null stays null (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def impute(items: DataFrame, fits: DataFrame) -> DataFrame:
    """Fill missing items of ``(session_id, item, score)`` from the session's mean.

    ``fits`` is ``(item, intercept, slope, base_rate)``. A session without any score
    gets base rates, an item without a fit a fixed value.
    """
    known = (
        items.groupBy("session_id")
        .agg(F.avg("score").alias("mean_score"))
    )
    missing = items.filter(F.col("score").isNull()).drop("score")
    low, high = 0.0, float(K.ITEM_MAX)
    value = (
        F.when(F.col("intercept").isNull(), F.lit(K.UNFITTED_ITEM))
        .when(F.col("mean_score").isNull(), clamp(F.col("base_rate"), low, high))
        .otherwise(clamp(F.col("intercept") + F.col("slope") * F.col("mean_score"), low, high))
    )
    return (
        missing.join(known, "session_id")
        .join(fits.select("item", "intercept", "slope", "base_rate"), "item", "left")
        .select("session_id", "item", value.alias("imputed"))
    )


def calibrate(total: Column, intercept, slope, low: float = 0.0, high: float = K.TOTAL_MAX) -> Column:
    return clamp(F.lit(intercept) + F.lit(slope) * total, low, high)


def severity_band(total: Column) -> Column:
    out = F.when(total <= K.SEVERITY[0][0], K.SEVERITY[0][1])
    for top, name in K.SEVERITY[1:-1]:
        out = out.when(total <= top, name)
    return out.otherwise(K.SEVERITY[-1][1])


def totals(
    items: DataFrame,
    imputed: DataFrame | None = None,
    calibrator: tuple[float, float] | None = None,
) -> DataFrame:
    """Raw, calibrated and rounded totals; an item without any value counts as 0."""
    scored = items.select("session_id", F.col("score").cast("double").alias("value"))
    if imputed is not None:
        scored = scored.unionByName(imputed.select("session_id", F.col("imputed").alias("value")))
    raw = scored.groupBy("session_id").agg(
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 9).alias("raw_total")
    )
    calibrated = F.col("raw_total")
    if calibrator is not None:
        calibrated = calibrate(F.col("raw_total"), *calibrator)
    return (
        raw.withColumn("calibrated_total", F.round(calibrated, 9))
        .withColumn("total", F.bround("calibrated_total", 0).cast("long"))
        .withColumn("severity", severity_band(F.col("total")))
    )


def session_diagnostics(
    item_results: DataFrame, contradictions: DataFrame | None = None
) -> DataFrame:
    """Counts per session: tiers, abstentions, mismatches, failures, extra rounds.

    ``contradictions`` are the counts per (session, topic) of ``memory.contradiction_counts``.
    """
    scored = F.col("score").isNotNull()
    out = item_results.groupBy("session_id").agg(
        *(F.count_if(F.col("evidence_tier") == t).alias(f"tier_{t}") for t in K.TIERS),
        F.count_if(~scored).alias("abstentions"),
        F.count_if("citation_mismatch").alias("citation_mismatches"),
        F.count_if(scored & ~F.col("quote_grounded")).alias("ungrounded_quotes"),
        F.count_if("parse_failed").alias("parse_failures"),
        F.sum(F.col("rounds") - 1).alias("expansion_rounds"),
    )
    if contradictions is None:
        return out.withColumn("contradictions", F.lit(0).cast("long"))
    found = contradictions.groupBy("session_id").agg(F.sum("contradictions").alias("contradictions"))
    return out.join(found, "session_id", "left").withColumn(
        "contradictions", F.coalesce("contradictions", F.lit(0)).cast("long")
    )


def diagnostic_rates(diagnostics: DataFrame) -> DataFrame:
    """Batch rates over ``(known, missing, citation_mismatches, low_faithfulness)``."""
    total = F.coalesce(F.sum(F.col("known") + F.col("missing")), F.lit(0))

    def rate(c: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.sum(c), total), F.lit(0.0)), 4)

    return diagnostics.agg(
        total.cast("double").alias("total_topic_assessments"),
        rate("known").alias("evidence_coverage_rate"),
        rate("citation_mismatches").alias("citation_mismatch_rate"),
        rate("low_faithfulness").alias("low_faithfulness_rate"),
    )


def report(topic_states: DataFrame) -> DataFrame:
    """Total of proposed scores per case and the number of cited slots."""
    return topic_states.groupBy("case_id").agg(
        F.sum(F.coalesce("proposed_score", F.lit(0))).cast("long").alias("total"),
        F.sum(F.size("score_basis_slot_ids")).cast("long").alias("cited_slots"),
        F.count("*").alias("topics"),
    )


def report_topics(topic_states: DataFrame) -> DataFrame:
    """Score and cited slots per topic of a case, a row per slot and one for a topic that cites none."""
    return topic_states.select(
        "case_id",
        "topic",
        F.coalesce("proposed_score", F.lit(0)).alias("score"),
        F.posexplode_outer("score_basis_slot_ids").alias("pos", "slot_id"),
    )
