"""Paired statistics, resampling, ablations and trace parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.segments import SEGMENT_ROWS, scan, scan_by_depth
from ..session import cut_lineage


#: Sign bits taken from one hash in the permutation test.
BITS = 60
#: Buckets of the bootstrap's range join that one row is listed in at once.
SHELF = 4_096


def pairing_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Why two arms ``(session_id, predicted, reference, question_budget, valid)`` do not pair."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("session_id").agg(
            F.count("*").alias(f"n_{name}"),
            F.min("question_budget").alias(f"lo_{name}"),
            F.max("question_budget").alias(f"hi_{name}"),
            F.bool_and("valid").alias(f"ok_{name}"),
        )

    both = side(a, "a").join(side(b, "b"), "session_id", "full_outer")
    found = both.agg(
        F.count_if((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("repeated_ids"),
        F.count_if(F.col("n_a").isNull() | F.col("n_b").isNull()).alias("unmatched_ids"),
        F.count_if(~F.coalesce("ok_a", F.lit(True)) | ~F.coalesce("ok_b", F.lit(True))).alias("invalid_rows"),
        F.least(F.min("lo_a"), F.min("lo_b")).alias("lo"),
        F.greatest(F.max("hi_a"), F.max("hi_b")).alias("hi"),
    )
    return found.select(
        "repeated_ids",
        "unmatched_ids",
        "invalid_rows",
        (F.col("lo") != F.col("hi")).alias("mixed_budgets"),
    )


def paired_diff(a: DataFrame, b: DataFrame, check: bool = True) -> DataFrame:
    """Per id the absolute error of ``a`` minus that of ``b``.

    With ``check`` an unpaired comparison fails before any difference is returned.
    """
    if check:
        row = pairing_violations(a, b).first()
        if row.repeated_ids or row.unmatched_ids or row.invalid_rows or row.mixed_budgets:
            raise ValueError(f"arms do not pair: {row.asDict()}")
    err = F.abs(F.col("predicted") - F.col("reference")).cast("double")
    left = a.select("session_id", err.alias("ea"))
    right = b.select("session_id", err.alias("eb"))
    return left.join(right, "session_id").select(
        "session_id", (F.col("ea") - F.col("eb")).alias("d")
    )


def paired_bootstrap(
    diffs: DataFrame, iterations: int, seed: int, level: float = 0.95
) -> DataFrame:
    """Mean difference and percentile interval of resampled means.

    Draw ``i`` of replicate ``r`` is position ``hash(seed, r, i) mod n`` among the sorted
    differences, so a retried task draws the same. Equal differences are one row with the
    positions it takes, and a draw finds its row by a bucketed range join.
    """
    if iterations <= 0 or not 0.0 < level < 1.0:
        raise ValueError("iterations must be positive and level between 0 and 1")
    merged = cut_lineage(diffs.groupBy("d").agg(F.count("*").alias("w")), "weights")
    n, mean, values = merged.agg(F.sum("w"), F.sum(F.col("d") * F.col("w")) / F.sum("w"), F.count("*")).first()
    if not n:
        raise ValueError("paired statistics require non-empty arms")
    sums = {"upto": F.col("w")}
    short = values <= SEGMENT_ROWS
    ends = scan(merged, [], ["d"], F.lit(0), sums=sums) if short else scan_by_depth(merged, [], ["d"], sums=sums)
    drawn = _drawn(_draws(diffs.sparkSession, iterations, n, seed), ends, n, values)
    means = drawn.groupBy("r").agg((F.sum("d") / F.lit(float(n))).alias("m"))
    tail = (1.0 - level) / 2.0
    return means.agg(
        F.lit(float(mean)).alias("mean_difference"),
        F.percentile("m", F.lit(tail)).alias("interval_lower"),
        F.percentile("m", F.lit(1.0 - tail)).alias("interval_upper"),
    )


def _draws(spark, iterations: int, n: int, seed: int) -> DataFrame:
    rows = iterations * n
    parts = max(spark.sparkContext.defaultParallelism, rows // 5_000_000 + 1)
    ids = spark.range(0, rows, 1, parts)
    r, i = F.floor(F.col("id") / n), F.col("id") % n
    # known not to be null, so that no filter computes the hash once more
    return ids.select(F.coalesce(r, F.lit(0)).alias("r"), F.coalesce(draw(F.lit(seed), r, i) % n, F.lit(0)).alias("j"))


def _drawn(draws: DataFrame, ends: DataFrame, n: int, values: int) -> DataFrame:
    """``(r, d)``: the value whose positions ``[upto - w, upto)`` hold position ``j`` of each draw.

    Positions are cut into about as many buckets as there are values. A value is listed in each bucket that
    it reaches into, which makes at most twice as many rows as values however often a value
    occurs; a draw meets the two or so values of its bucket.
    """
    width = max(1, n // values)
    spans = ends.select("d", (F.col("upto") - F.col("w")).alias("lo"), (F.col("upto") - 1).alias("hi"))
    first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    # in two steps, so that no array grows with the rows of one value
    shelves = spans.withColumn("shelf", F.explode(F.sequence(F.floor(first / SHELF), F.floor(last / SHELF))))
    low, high = F.col("shelf") * SHELF, F.col("shelf") * SHELF + (SHELF - 1)
    reached = F.sequence(F.greatest(first, low), F.least(last, high))
    # stored, so that its size is known and a short table is broadcast before any draw moves
    listed = cut_lineage(shelves.select("d", "lo", "hi", F.explode(reached).alias("bucket")), "buckets")
    placed = draws.withColumn("bucket", F.coalesce(F.floor(F.col("j") / width), F.lit(0)))
    return placed.join(listed, "bucket").filter("lo <= j AND j <= hi").select("r", "d")


def paired_permutation(diffs: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Share of random sign flips whose mean is at least as extreme as the observed.

    One hash per (row, block) gives the signs of sixty replicates, which are summed as
    sixty columns before the only shuffle, of one row per block and task.
    """
    if iterations <= 0:
        raise ValueError("iterations must be positive")
    blocks = (iterations + BITS - 1) // BITS
    rows = diffs.select(
        "d", "session_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    ).withColumn("h", draw(F.lit(seed), F.col("block"), F.col("session_id")))
    sums = rows.groupBy("block").agg(
        *(
            F.sum(
                F.when(F.shiftright("h", k).bitwiseAND(F.lit(1)) == 1, F.col("d")).otherwise(-F.col("d"))
            ).alias(f"s{k}")
            for k in range(BITS)
        ),
        F.count("*").alias("n"),
        F.sum("d").alias("total"),
    )
    flat = sums.select(
        "n", "total", "block", F.posexplode(F.array(*(F.col(f"s{k}") for k in range(BITS)))).alias("k", "s")
    ).filter(F.col("block") * BITS + F.col("k") < iterations)
    mean, observed = F.col("s") / F.col("n"), F.col("total") / F.col("n")
    return flat.agg(
        F.max(observed).alias("observed_mean_difference"),
        F.avg((F.abs(mean) >= F.abs(observed)).cast("double")).alias("proportion_at_least_as_extreme"),
    )


def onoff_gain(arms: DataFrame) -> DataFrame:
    """On and off gains of ``(arm, state_id, seed, quality)`` for the four arms.

    Arms are ``initial_on``, ``initial_off``, ``evolved_on``, ``evolved_off``; they must hold
    the same (state, seed) rows, which ``matched`` reports.
    """
    names = ["initial_on", "initial_off", "evolved_on", "evolved_off"]
    per = (
        arms.groupBy("state_id", "seed")
        .agg(
            *(F.count_if(F.col("arm") == a).alias(f"n_{a}") for a in names),
            *(F.sum(F.when(F.col("arm") == a, F.col("quality"))).alias(a) for a in names),
        )
    )
    same = F.lit(True)
    for a in names:
        same = same & (F.col(f"n_{a}") == 1)
    stats = per.agg(F.bool_and(same).alias("matched"), *(F.avg(a).alias(a) for a in names))
    return stats.select(
        "matched",
        F.when(F.col("matched"), F.col("evolved_on") - F.col("initial_on")).alias("combined_on_gain"),
        F.when(F.col("matched"), F.col("evolved_off") - F.col("initial_off")).alias("parametric_off_gain"),
    )


def action_rate(triggered: DataFrame, actions: DataFrame, positive: DataFrame) -> DataFrame:
    """Share of triggered states whose action is one of the state's validated actions."""
    hit = (
        triggered.select("state_id")
        .join(actions.select("state_id", "action"), "state_id", "left")
        .join(
            positive.select("state_id", "action", F.lit(1).alias("hit")).distinct(),
            ["state_id", "action"],
            "left",
        )
    )
    stats = hit.agg(F.count("*").alias("triggered"), F.count("hit").alias("validated"))
    rate = F.when(
        F.col("triggered") == 0, F.raise_error(F.lit("no triggered states")).cast("double")
    ).otherwise(F.try_divide(F.col("validated").cast("double"), F.col("triggered")))
    return stats.select("triggered", "validated", rate.alias("rate"))


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the reasons whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*(F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs))
    )


def internalization(df: DataFrame) -> DataFrame:
    """Verdict per row of initial/evolved off quality and action rate."""
    found = reasons(
        (F.col("evolved_off_quality") <= F.col("initial_off_quality"), "memory_off_quality_not_improved"),
        (F.col("evolved_rate") <= F.col("initial_rate"), "iar_not_improved"),
    )
    return df.withColumn("reasons", found).withColumn("internalized", F.size("reasons") == 0)


def ablation_violations(arms: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(arm_id, violation)`` rows of an ablation set.

    ``arms`` is ``(arm_id, ablated_component, question_budget, model_call_budget, seed)``,
    one row per declared seed; ``outcomes`` ``(arm_id, seed, value, questions_asked,
    model_calls)``. Every check is an aggregate or an equi-join.
    """
    one = arms.groupBy("arm_id").agg(
        F.min("question_budget").alias("q"),
        F.max("question_budget").alias("q2"),
        F.min("model_call_budget").alias("m"),
        F.max("model_call_budget").alias("m2"),
        F.count("*").alias("rows"),
        F.count_distinct("seed").alias("seeds"),
        F.max(F.col("ablated_component").isNull()).alias("is_reference"),
    )
    ref = one.filter("is_reference").agg(
        F.count("*").alias("refs"), F.max("q").alias("rq"), F.max("m").alias("rm")
    )
    shared = arms.join(
        arms.filter(F.col("ablated_component").isNull()).select("seed", F.lit(1).alias("in_ref")).distinct(),
        "seed",
        "left",
    )
    foreign = shared.groupBy("arm_id").agg(
        F.count_if(F.col("in_ref").isNull()).alias("foreign"), F.count("in_ref").alias("common")
    )
    ref_seeds = arms.filter(F.col("ablated_component").isNull()).agg(
        F.count_distinct("seed").alias("n")
    ).scalar()
    per_arm = one.join(foreign, "arm_id").select(
        "arm_id",
        F.explode(
            reasons(
                (F.col("rows") != F.col("seeds"), "repeated_arm"),
                ((F.col("q") != ref.select("rq").scalar()) | (F.col("q") != F.col("q2")), "question_budget_differs"),
                ((F.col("m") != ref.select("rm").scalar()) | (F.col("m") != F.col("m2")), "model_call_budget_differs"),
                ((F.col("foreign") > 0) | (F.col("common") != ref_seeds), "seeds_differ"),
            )
        ).alias("violation"),
    )
    refs = ref.filter("refs <> 1").select(
        F.lit(None).cast("string").alias("arm_id"), F.lit("not_one_reference_arm").alias("violation")
    )
    declared = arms.select("arm_id", "seed", "question_budget", "model_call_budget")
    joined = outcomes.join(declared.withColumn("declared", F.lit(True)), ["arm_id", "seed"], "left")
    spent = joined.select(
        "arm_id",
        F.explode(
            reasons(
                (F.col("declared").isNull(), "undeclared_seed"),
                (F.col("questions_asked") > F.col("question_budget"), "question_budget_exceeded"),
                (F.col("model_calls") > F.col("model_call_budget"), "model_call_budget_exceeded"),
            )
        ).alias("violation"),
    )
    repeated = (
        outcomes.groupBy("arm_id", "seed").agg(F.count("*").alias("n")).filter("n > 1")
        .select("arm_id", F.lit("repeated_seed_outcome").alias("violation"))
    )
    missing = declared.join(outcomes, ["arm_id", "seed"], "left_anti").select(
        "arm_id", F.lit("missing_seed_outcome").alias("violation")
    )
    return (
        per_arm.unionByName(refs).unionByName(spent).unionByName(repeated).unionByName(missing)
        .groupBy("arm_id", "violation").agg(F.count("*").alias("n"))
    )


def seed_robustness(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("arm_id").agg(
        F.count_distinct("seed").alias("seed_count"),
        F.avg("value").alias("mean"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        (F.max("value") - F.min("value")).alias("spread"),
    )


def ablation_effects(outcomes: DataFrame, reference_arm: str) -> DataFrame:
    """Per arm and seed the difference to the reference arm, with the arm's mean."""
    ref = outcomes.filter(F.col("arm_id") == reference_arm).select("seed", F.col("value").alias("ref"))
    diffs = (
        outcomes.filter(F.col("arm_id") != reference_arm)
        .join(ref, "seed")
        .select("arm_id", "seed", (F.col("value") - F.col("ref")).alias("difference"))
    )
    means = diffs.groupBy("arm_id").agg(F.avg("difference").alias("mean_difference"))
    return diffs.join(means, "arm_id")


def trace_parity(
    baseline: DataFrame,
    candidate: DataFrame,
    allowed_response_mismatches: int = 0,
    latency_budget_ms: float | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Compare two call traces position by position.

    Traces are ``(position, request_id, role, request_hash, response_hash, outcome,
    failure_type, provenance, latency_ms)``; ``position`` increases but may have gaps of any size.
    """
    fields = [
        "request_id", "role", "request_hash", "response_hash", "outcome", "failure_type",
        "provenance", "latency_ms",
    ]

    def side(df: DataFrame, name: str) -> DataFrame:
        placed = scan_by_depth(df, [], ["position"], segment_rows, index="__at")
        return placed.select("__at", F.struct(*fields).alias(name))

    joined = side(baseline, "a").join(side(candidate, "b"), "__at", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()

    def differs(*names: str) -> Column:
        equal = F.lit(True)
        for n in names:
            equal = equal & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        return F.count_if(both & ~equal)

    slower = F.when(both, F.greatest(F.col("b.latency_ms") - F.col("a.latency_ms"), F.lit(0.0)))
    stats = joined.agg(
        F.count("a").alias("baseline_count"),
        F.count("b").alias("candidate_count"),
        differs("request_id", "role").alias("control_flow_mismatches"),
        differs("request_hash").alias("request_mismatches"),
        differs("outcome", "failure_type").alias("outcome_mismatches"),
        differs("response_hash").alias("response_mismatches"),
        differs("provenance").alias("provenance_mismatches"),
        F.coalesce(F.sum(slower), F.lit(0.0)).alias("total_latency_regression_ms"),
        F.coalesce(F.max(slower), F.lit(0.0)).alias("max_latency_regression_ms"),
        F.coalesce(F.avg(slower), F.lit(0.0)).alias("mean_latency_regression_ms"),
    )
    passes = (
        (F.col("baseline_count") == F.col("candidate_count"))
        & (F.col("control_flow_mismatches") == 0)
        & (F.col("request_mismatches") == 0)
        & (F.col("outcome_mismatches") == 0)
        & (F.col("provenance_mismatches") == 0)
        & (F.col("response_mismatches") <= allowed_response_mismatches)
    )
    if latency_budget_ms is not None:
        passes = passes & (F.col("max_latency_regression_ms") <= latency_budget_ms)
    return stats.withColumn("passes", passes)
