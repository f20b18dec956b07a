"""Fits, metrics and paired statistics on small inputs with known answers."""

import random
import statistics

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnwise.operators import fits, metrics, paired, totals


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_exact_median(spark, n):
    rng = random.Random(n)
    rows = [(g, rng.choice([-1.5, 0.1, 0.2, 3.0, 3.1, 9.9]), rng.randint(1, 4)) for g in range(3) for _ in range(n)]
    got = {r.g: r.median for r in fits.exact_median(frame(spark, rows, "g int, v double, w int"), "g", "v", "w").collect()}
    for g in range(3):
        assert got[g] == pytest.approx(statistics.median([v for k, v, w in rows if k == g for _ in range(w)]))


def test_calibrator_equals_grid_search(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 24))) for _ in range(25)]
    best = None
    for step in range(401):
        slope = 4.0 * step / 400
        icpt = statistics.median([r - slope * p for p, r in rows])
        err = sum(abs(max(0.0, min(24.0, icpt + slope * p)) - r) for p, r in rows) / len(rows)
        if best is None or round(err, 9) < best[0]:
            best = (round(err, 9), icpt, slope)
    got = fits.fit_calibrator_mae(frame(spark, rows, "predicted double, reference double")).first()
    assert (got.intercept, got.slope, got.error) == pytest.approx((best[1], best[2], best[0]))


def test_line_without_spread_or_points(spark):
    rows = [(s, "a", v) for s, v in enumerate([1, 2, 3])] + [(s, "b", 2) for s in range(3)] + [(0, "c", 3)]
    got = {r["item"]: r for r in fits.fit_impute_refs(frame(spark, rows, "session_id int, item string, value int")).collect()}
    assert (got["c"].slope, got["c"].intercept, got["c"].support) == (0.0, 3.0, 1)
    assert got["a"].slope != 0.0 or got["a"].intercept == pytest.approx(2.0)


def test_impute_cases(spark):
    items = frame(
        spark,
        [("s", "a", 2), ("s", "b", None), ("s", "z", None), ("t", "a", None), ("t", "b", None)],
        "session_id string, item string, score int",
    )
    fitted = frame(
        spark, [("a", 0.5, 2.0, 1.2), ("b", -9.0, 1.0, 7.0)], "item string, intercept double, slope double, base_rate double"
    )
    got = {(r.session_id, r["item"]): r.imputed for r in totals.impute(items, fitted).collect()}
    assert got == {("s", "b"): 0.0, ("s", "z"): 0.9, ("t", "a"): 1.2, ("t", "b"): 3.0}


def test_totals_round_half_to_even(spark):
    items = frame(spark, [(1, 2.5), (2, 3.5), (3, None)], "session_id int, score double")
    got = {r.session_id: (r.total, r.severity[:4]) for r in totals.totals(items).collect()}
    assert got == {1: (2, "None"), 2: (4, "None"), 3: (0, "None")}


def test_correlation_without_spread_is_zero(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "predicted double, reference double")
    assert metrics.regression_metrics(df).first().pearson_r == 0.0
    assert metrics.regression_metrics(df.limit(1)).first().pearson_r == 0.0


def test_total_mae_refuses_mixed_budgets_and_empty_results(spark):
    schema = "predicted int, reference int, question_budget int, failed boolean, invalid_reason string"
    for rows in ([(1, 2, 3, False, None), (1, 2, 4, False, None)], [(1, 2, 3, True, None)]):
        with pytest.raises(PySparkException):
            metrics.total_mae(frame(spark, rows, schema)).collect()


def test_pairing_is_checked(spark):
    schema = "session_id int, predicted int, reference int, question_budget int, valid boolean"
    a = frame(spark, [(1, 1, 2, 6, True), (2, 3, 3, 6, True)], schema)
    for rows in ([(1, 1, 2, 6, True)], [(1, 1, 2, 7, True), (2, 1, 1, 7, True)], [(1, 1, 2, 6, True), (2, 1, 1, 6, False)]):
        with pytest.raises(ValueError):
            paired.paired_diff(a, frame(spark, rows, schema))


def test_bootstrap_draws_from_the_differences(spark):
    diffs = spark.range(60).select(F.col("id").alias("session_id"), ((F.col("id") * 7) % 13 - 6).cast("double").alias("d"))
    values = sorted(r.d for r in diffs.collect())
    drawn = paired._draws(spark, 40, 60, 5).groupBy("r").agg(F.collect_list("j").alias("j")).collect()
    means = sorted(sum(values[j] for j in r.j) / 60 for r in drawn)
    got = paired.paired_bootstrap(diffs, 40, 5).first()
    assert got.mean_difference == pytest.approx(sum(values) / 60)
    assert got.interval_lower == pytest.approx(np.percentile(means, 2.5))
    assert got.interval_upper == pytest.approx(np.percentile(means, 97.5))


def test_a_value_of_most_positions_is_drawn_like_the_others(spark):
    """Fifty million copies of one value: positions are a range of it, never a row or an array cell each."""
    ends = frame(spark, [(0.5, 50_000_000, 50_000_000), (1.5, 1, 50_000_001), (2.5, 9, 50_000_010)], "d double, w long, upto long")
    draws = frame(spark, [(0, 0), (0, 49_999_999), (1, 50_000_000), (1, 50_000_001), (2, 50_000_009)], "r long, j long")
    found = paired._drawn(draws, ends, 50_000_010, 3)
    assert sorted(map(tuple, found.collect())) == [(0, 0.5), (0, 0.5), (1, 1.5), (1, 2.5), (2, 2.5)]
    many = spark.range(20_001).select(F.col("id").cast("double").alias("d"), F.when(F.col("id") == 7, 1_000_000).otherwise(1).alias("w"))
    from pyspark.sql import Window

    ends = many.withColumn("upto", F.sum("w").over(Window.orderBy("d")))
    places = spark.range(0, 1_020_000, 997).select(F.lit(0).alias("r"), F.col("id").alias("j"))
    got = paired._drawn(places, ends, 1_020_000, 20_001).groupBy("d").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == places.count()
    assert {r.d: r.n for r in got}[7.0] == places.filter("j >= 7 AND j < 1000007").count()


def test_traces_with_huge_gaps_compare_by_order(spark):
    fields = "'q' AS request_id, 'r' AS role, 'h' AS request_hash, 's' AS response_hash, 'ok' AS outcome, 'x' AS failure_type, 'p' AS provenance, 1.0D AS latency_ms"
    a = spark.range(5_000).selectExpr("id * 7 AS position", *fields.split(", "))
    b = spark.range(5_000).selectExpr("id * id * 1000003 AS position", *fields.split(", "))
    row = paired.trace_parity(a, b, segment_rows=500).first()
    assert (row.baseline_count, row.candidate_count, row.control_flow_mismatches, row.passes) == (5_000, 5_000, 0, True)


def test_permutation_of_equal_arms_is_always_extreme(spark):
    diffs = spark.range(30).select(F.col("id").alias("session_id"), F.lit(0.0).alias("d"))
    assert paired.paired_permutation(diffs, 70, 1).first().proportion_at_least_as_extreme == 1.0


def test_onoff_needs_identical_states(spark):
    names = ["initial_on", "initial_off", "evolved_on", "evolved_off"]
    rows = [(a, s, 0, float(i)) for i, a in enumerate(names) for s in (1, 2)]
    good = paired.onoff_gain(frame(spark, rows, "arm string, state_id int, seed int, quality double")).first()
    assert (good.matched, good.combined_on_gain, good.parametric_off_gain) == (True, 2.0, 2.0)
    assert not paired.onoff_gain(frame(spark, rows[1:], "arm string, state_id int, seed int, quality double")).first().matched


@pytest.mark.parametrize("k", [1, 4, 9])
def test_stratified_shots(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.randint(0, 5)) for i in range(8)]
    got = {r.session_id for r in fits.stratified_shots(frame(spark, rows, "session_id long, total int"), k, 3).collect()}
    ranked = sorted(rows, key=lambda r: (r[1], r[0]))
    want = rows if len(rows) <= k else [ranked[i] for i in sorted({round(i * 7 / max(k - 1, 1)) for i in range(k)})]
    assert got == {i for i, _ in want}
