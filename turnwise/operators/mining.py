"""Error and low-yield cells, holdouts, replay gains and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.hashing import canonical_hash, draw
from ..functions.segments import scan, top_k
from .paired import reasons
from .retrieval import tier_name, tier_rank
from .totals import clamp, impute

CELL = ["topic", "evidence_tier"]


def scoring_state_id() -> Column:
    return canonical_hash(
        participant=F.col("session_id").cast("string"), topic=F.col("topic"), tier=F.col("evidence_tier")
    )


def error_cells(
    states: DataFrame,
    min_support: int = 8,
    min_absolute_error: float = 0.5,
    min_systematic_share: float = 0.4,
) -> DataFrame:
    """(topic, tier) cells whose error is large and mostly of one sign.

    ``states`` is ``(session_id, topic, evidence_tier, predicted, reference, abstained)``;
    an abstention enters as predicted 0. The states of a cell stay rows (``cell_members``).
    """
    predicted = F.when(F.col("abstained"), 0).otherwise(F.col("predicted"))
    err = (predicted - F.col("reference")).cast("double")
    cells = states.groupBy(*CELL).agg(
        F.count("*").alias("support"),
        F.avg(err).alias("mean_signed_error"),
        F.avg(F.abs(err)).alias("mean_absolute_error"),
        F.avg(F.col("abstained").cast("double")).alias("abstention_rate"),
    )
    share = F.coalesce(
        F.try_divide(F.abs("mean_signed_error"), F.when(F.col("mean_absolute_error") > 1e-9, F.col("mean_absolute_error"))),
        F.lit(0.0),
    )
    return cells.withColumns(
        {
            "systematic_share": share,
            "direction": F.when(F.col("mean_signed_error") < 0, "under").otherwise("over"),
            "strength": F.abs("mean_signed_error") * F.col("support"),
        }
    ).filter(
        (F.col("support") >= min_support)
        & (F.round("mean_absolute_error", 9) >= min_absolute_error)
        & (F.round("systematic_share", 9) >= min_systematic_share)
    )


def cell_members(states: DataFrame, cells: DataFrame) -> DataFrame:
    """States of the kept cells with their ids; the cell table is a few dozen rows."""
    return states.join(cells.select(*CELL), CELL, "left_semi").withColumn("state_id", scoring_state_id())


def low_yield_cells(
    rounds: DataFrame, min_support: int = 8, max_yield: float = 0.35
) -> DataFrame:
    """(topic, tier before) cells whose rounds rarely helped, with sample queries.

    ``rounds`` is ``(session_id, topic, round_index, tier_before, tier_after,
    resolved_before, resolved_after, queries)``.
    """
    better = (F.col("resolved_after") & ~F.col("resolved_before")) | (
        tier_rank(F.col("tier_after")) > tier_rank(F.col("tier_before"))
    )
    cells = (
        rounds.groupBy("topic", "tier_before")
        .agg(F.count("*").alias("support"), F.avg(better.cast("double")).alias("yield_rate"))
        .filter((F.col("support") >= min_support) & (F.round("yield_rate", 9) <= max_yield))
    )
    early = top_k(
        rounds.select("topic", "tier_before", "session_id", "round_index", F.slice("queries", 1, 2).alias("q")),
        ["topic", "tier_before"],
        [F.col("session_id"), F.col("round_index")],
        6,
    )
    samples = early.groupBy("topic", "tier_before").agg(
        F.slice(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "q"))), lambda s: s["q"])), 1, 8
        ).alias("sample_queries")
    )
    return cells.join(samples, ["topic", "tier_before"]).withColumn(
        "wasted", (1.0 - F.col("yield_rate")) * F.col("support")
    )


def source_holdout(members: DataFrame, seed: int, max_holdout: int | None = None) -> DataFrame:
    """Split each cell's participants into ``source`` (a third, at least one) and ``holdout``.

    ``max_holdout`` bounds the holdout of a cell where each of its rows is to cost a call. The order is a seeded hash, which stands in for a shuffle; positions come from hash
    segments, so a cell of any size is ranked by many tasks.
    """
    people = members.select(*CELL, "session_id").distinct().withColumn(
        "h", draw(F.lit(seed), F.col("topic"), F.col("evidence_tier"), F.col("session_id"))
    )
    ranked = scan(people, CELL, ["h", "session_id"], F.shiftright("h", 48), index="at")
    sizes = people.groupBy(*CELL).agg(F.count("*").alias("n"))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    inside = F.lit(True) if max_holdout is None else F.col("at") < cut + max_holdout
    part = F.when(F.col("at") < cut, "source").when(inside, "holdout")
    return (
        ranked.join(sizes, CELL)
        .withColumn("part", part)
        .filter(F.col("part").isNotNull())
        .select(*CELL, "session_id", "part")
    )


def worst_examples(states: DataFrame, k: int) -> DataFrame:
    """The ``k`` states of each cell with the largest error."""
    err = F.abs(F.when(F.col("abstained"), 0).otherwise(F.col("predicted")) - F.col("reference"))
    return top_k(states.withColumn("error", err), CELL, [F.col("error").desc(), F.col("session_id")], k)


def score_gain(control: Column, treatment: Column, reference: Column) -> Column:
    delta = (F.abs(control - reference) - F.abs(treatment - reference)) / float(K.ITEM_MAX)
    return clamp(delta, -1.0, 1.0)


def acquisition_value(tier: Column, resolved: Column) -> Column:
    return (tier_rank(tier) + F.when(resolved, 1).otherwise(0)).cast("double")


def efficiency_gain(control: Column, treatment: Column) -> Column:
    return clamp((treatment - control) / float(len(K.TIERS)), -1.0, 1.0)


def resolve_arm(arm: DataFrame, assessed: DataFrame, fits: DataFrame) -> DataFrame:
    """Resolve the abstentions of ``(state_id, session_id, item, score)``.

    An abstained item is imputed from the session's *other* assessed items
    ``(session_id, item, score)``.
    """
    others = arm.filter(F.col("score").isNull()).select("state_id", "session_id", "item")
    own = assessed.select("session_id", F.col("item").alias("other"), "score")
    context = others.join(own, "session_id").filter(F.col("other") != F.col("item"))
    listed = others.select(F.col("state_id").alias("session_id"), "item", F.lit(None).cast("double").alias("score"))
    known = context.select(
        F.col("state_id").alias("session_id"), F.col("other").alias("item"), F.col("score").cast("double")
    )
    filled = impute(listed.unionByName(known), fits).select(F.col("session_id").alias("state_id"), "imputed")
    return arm.join(filled, "state_id", "left").withColumn(
        "value", F.coalesce(F.col("score").cast("double"), F.col("imputed"))
    ).drop("imputed")


def acquisition_treatment(tier_before: Column, found: Column) -> Column:
    """The stronger of the tier before and the tier of what was found."""
    return tier_name(F.greatest(tier_rank(tier_before), tier_rank(F.coalesce(found, tier_before))))


def transfer_gate(
    outcomes: DataFrame,
    excluded: DataFrame,
    min_support: int = 6,
    min_mean_gain: float = 0.02,
    min_improved: float = 0.55,
) -> DataFrame:
    """First promotion gate per lesson over states that are not its sources.

    ``outcomes`` is ``(lesson_id, state_id, gain)`` and, for the scoring channel,
    ``control_grounded`` and ``treatment_grounded``; ``excluded`` is ``(lesson_id, state_id)``.
    """
    scoring = "treatment_grounded" in outcomes.columns
    regression = (
        F.col("control_grounded") & ~F.col("treatment_grounded") if scoring else F.lit(False)
    )
    marked = outcomes.join(
        excluded.select("lesson_id", "state_id", F.lit(True).alias("own")).distinct(),
        ["lesson_id", "state_id"],
        "left",
    )
    ok = F.col("own").isNull()
    stats = marked.groupBy("lesson_id").agg(
        F.count_if(ok).alias("support"),
        F.coalesce(F.avg(F.when(ok, F.col("gain"))), F.lit(0.0)).alias("mean_gain"),
        F.coalesce(F.avg(F.when(ok, (F.col("gain") > 0).cast("double"))), F.lit(0.0)).alias("improved"),
        F.count_if(ok & regression).alias("regressions"),
    )
    none = F.col("support") == 0
    found = F.when(none, F.array(F.lit("no_source_excluded_states"))).otherwise(
        reasons(
            (F.col("support") < min_support, "insufficient_support"),
            (F.round("mean_gain", 9) < min_mean_gain, "utility_margin_below_threshold"),
            (F.round("improved", 9) < min_improved, "too_few_states_improved"),
            (F.col("regressions") > 0, "safety_regression"),
        )
    )
    return stats.withColumn("reasons", found).withColumn("promoted", F.size("reasons") == 0)


def validate_lessons(results: DataFrame, excluded: DataFrame, minimum_support: int) -> DataFrame:
    """Second gate: enough supporting results outside the lesson's sources.

    ``results`` is ``(lesson_id, source_id, supports)``.
    """
    own = excluded.select("lesson_id", "source_id", F.lit(True).alias("own")).distinct()
    marked = results.join(own, ["lesson_id", "source_id"], "left")
    return (
        marked.groupBy("lesson_id")
        .agg(
            F.count_if(F.col("own").isNull()).alias("eligible"),
            F.count_if(F.col("own").isNull() & F.col("supports")).alias("supporting"),
        )
        .withColumn(
            "lifecycle",
            F.when(F.col("supporting") >= minimum_support, "validated").otherwise("rejected"),
        )
    )


def promotions(gate: DataFrame, validated: DataFrame) -> DataFrame:
    """Lessons that pass both gates."""
    return (
        gate.filter("promoted")
        .join(validated.filter("lifecycle = 'validated'"), "lesson_id", "left_semi")
        .select("lesson_id")
    )
