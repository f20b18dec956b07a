"""Imputation, fits, metrics and paired statistics over ``lineitem`` and ``orders``.

Item scores come from ``lineitem`` (session = order, item = line number, duplicates
merged by minimum), totals of two arms from ``orders``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...operators import fits, metrics, paired
from ...operators import totals as totals_ops
from .base import View, query, rounded, rounded_sql, table

ITEMS_SQL = """SELECT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS item,
  CAST(min(l_quantity) AS BIGINT) % 4 AS value, min(l_partkey) % 4 AS score,
  min(l_suppkey) % 5 <> 0 AS assessed FROM lineitem GROUP BY l_orderkey, l_linenumber"""

TOTALS = View(
    "orders",
    session_id="o_orderkey",
    reference="o_custkey % 25",
    predicted="o_orderkey % 25",
    predicted_b="(o_orderkey * 7) % 25",
    failed="o_orderstatus = 'P'",
)

CTE = f"items AS ({ITEMS_SQL}), totals AS ({TOTALS.sql})"


def items(spark, folder):
    """(session_id, item, value, score, assessed), one row per session and item."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("item"))
        .agg(
            (F.min("l_quantity").cast("long") % 4).alias("value"),
            (F.min("l_partkey") % 4).alias("score"),
            (F.min("l_suppkey") % 5 != 0).alias("assessed"),
        )
    )


def totals(spark, folder):
    return TOTALS.load(spark, folder)


REFS_FIT_CTE = """
x AS (SELECT session_id, item, value, CASE WHEN count(*) OVER s > 1 THEN
       (sum(value) OVER s - value) / (count(*) OVER s - 1.0) END AS x FROM items
       WINDOW s AS (PARTITION BY session_id)),
refs_fit AS (SELECT item, CASE WHEN regr_count(value, x) < 3 OR regr_sxx(value, x) <= 1e-9
       THEN avg(value) FILTER (WHERE x IS NOT NULL) ELSE regr_intercept(value, x) END AS intercept,
     CASE WHEN regr_count(value, x) < 3 OR regr_sxx(value, x) <= 1e-9 THEN 0
       ELSE regr_slope(value, x) END AS slope,
     avg(value) AS base_rate, count(*) AS support FROM x GROUP BY 1)"""

FIT_COLUMNS = {"item": False, "intercept": True, "slope": True, "base_rate": True, "support": False}


def labels_of(df):
    return df.select("session_id", "item", "value")


@query(
    "fit_impute_refs",
    rounded_sql(f"WITH {CTE}, {REFS_FIT_CTE} --main SELECT * FROM refs_fit", FIT_COLUMNS),
)
def fit_impute_refs(spark, folder):
    return rounded(fits.fit_impute_refs(labels_of(items(spark, folder))))


RUN_FIT_CTE = """
m AS (SELECT session_id, avg(score) AS x FROM items WHERE assessed GROUP BY 1),
y AS (SELECT i.item, value, x FROM items i LEFT JOIN m ON i.session_id = m.session_id
      WHERE NOT assessed),
run_fit AS (SELECT item, CASE WHEN regr_count(value, x) < 3 OR regr_sxx(value, x) <= 1e-9
       THEN avg(value) FILTER (WHERE x IS NOT NULL) ELSE regr_intercept(value, x) END AS intercept,
     CASE WHEN regr_count(value, x) < 3 OR regr_sxx(value, x) <= 1e-9 THEN 0
       ELSE regr_slope(value, x) END AS slope,
     avg(value) AS base_rate, count(*) AS support FROM y GROUP BY 1)"""


@query(
    "fit_impute_run",
    rounded_sql(f"WITH {CTE}, {RUN_FIT_CTE} --main SELECT * FROM run_fit", FIT_COLUMNS),
)
def fit_impute_run(spark, folder):
    df = items(spark, folder)
    assessed = df.filter("assessed").select("session_id", "item", "score")
    return rounded(fits.fit_impute_run(assessed, labels_of(df)))


IMPUTED_CTE = f"""{REFS_FIT_CTE},
known AS (SELECT session_id, avg(score) AS mean_score FROM items WHERE assessed GROUP BY 1),
imputed AS (SELECT i.session_id, i.item, CASE WHEN f.item IS NULL THEN 0.9
     WHEN k.session_id IS NULL THEN greatest(0, least(3, base_rate))
     ELSE greatest(0, least(3, intercept + slope * mean_score)) END AS imputed
   FROM items i LEFT JOIN known k ON k.session_id = i.session_id
   LEFT JOIN refs_fit f ON f.item = i.item WHERE NOT assessed),
raw AS (SELECT session_id, round(sum(v), 9) AS raw_total FROM
   (SELECT session_id, score AS v FROM items WHERE assessed UNION ALL
    SELECT session_id, imputed FROM imputed) GROUP BY 1)"""


def scored_items(df):
    return df.select("session_id", "item", F.when(F.col("assessed"), F.col("score")).alias("score"))


def imputed_items(df):
    return totals_ops.impute(scored_items(df), fits.fit_impute_refs(labels_of(df)))


@query(
    "impute",
    rounded_sql(
        f"WITH {CTE}, {IMPUTED_CTE} --main SELECT * FROM imputed",
        {"session_id": False, "item": False, "imputed": True},
    ),
)
def impute(spark, folder):
    return rounded(imputed_items(items(spark, folder)))


SEVERITY_SQL = " ".join(f"WHEN total <= {top} THEN '{name}'" for top, name in K.SEVERITY[:-1])


@query(
    "session_totals",
    f"""WITH {CTE}, {IMPUTED_CTE}, c AS (SELECT session_id, raw_total,
          round(greatest(0, least(24, 2.05 + 0.55 * raw_total)), 9) AS calibrated_total FROM raw),
        f AS (SELECT *, CAST(round_even(calibrated_total, 0) AS BIGINT) AS total FROM c)
        SELECT session_id, round(raw_total, 6) + 0.0 AS raw_total,
          round(calibrated_total, 6) + 0.0 AS calibrated_total, total,
          CASE {SEVERITY_SQL} ELSE '{K.SEVERITY[-1][1]}' END AS severity FROM f""",
)
def session_totals(spark, folder):
    df = items(spark, folder)
    return rounded(totals_ops.totals(scored_items(df), imputed_items(df), (2.05, 0.55)))


@query(
    "severity_band",
    f"""WITH {CTE}, r AS (SELECT session_id, reference AS total FROM totals)
        SELECT session_id, total, CASE {SEVERITY_SQL} ELSE '{K.SEVERITY[-1][1]}' END AS severity
        FROM r""",
)
def severity_band(spark, folder):
    return totals(spark, folder).select(
        "session_id",
        F.col("reference").alias("total"),
        totals_ops.severity_band(F.col("reference")).alias("severity"),
    )


@query(
    "fit_calibrator_mae",
    rounded_sql(
        f"""WITH {CTE}, g AS (SELECT i AS step, 4.0 * i / 400 AS slope FROM range(401) t(i)),
        r AS (SELECT step, slope, CAST(predicted AS DOUBLE) AS p, CAST(reference AS DOUBLE) AS r,
          count(*) AS w FROM totals, g GROUP BY 1, 2, 3, 4),
        res AS (SELECT step, slope, r - slope * p AS v, w, p, r FROM r),
        cum AS (SELECT *, sum(w) OVER (PARTITION BY step ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto,
          sum(w) OVER (PARTITION BY step) AS n FROM res),
        med AS (SELECT step, (min(v) FILTER (WHERE upto > (n - 1) // 2)
          + min(v) FILTER (WHERE upto > n // 2)) / 2.0 AS median FROM cum GROUP BY 1),
        err AS (SELECT r.step, r.slope, any_value(median) AS intercept,
          sum(w * abs(greatest(0, least(24, median + r.slope * p)) - r)) / sum(w) AS error
          FROM r JOIN med ON r.step = med.step GROUP BY 1, 2)
        --main SELECT intercept, slope, error FROM err ORDER BY round(error, 9), step LIMIT 1""",
        {"intercept": True, "slope": True, "error": True},
    ),
)
def fit_calibrator_mae(spark, folder):
    return rounded(fits.fit_calibrator_mae(totals(spark, folder)))


@query(
    "fit_calibrator_spread",
    rounded_sql(
        f"""WITH {CTE}, s AS (SELECT stddev_pop(reference) / stddev_pop(predicted) AS slope,
        avg(reference) AS mr, avg(predicted) AS mp FROM totals)
        --main SELECT mr - slope * mp AS intercept, slope FROM s""",
        {"intercept": True, "slope": True},
    ),
)
def fit_calibrator_spread(spark, folder):
    return rounded(fits.fit_calibrator_spread(totals(spark, folder)))


@query(
    "calibrate",
    rounded_sql(
        f"""WITH {CTE} --main SELECT session_id,
        greatest(0, least(24, 2.05 + 0.55 * predicted_b)) AS calibrated FROM totals""",
        {"session_id": False, "calibrated": True},
    ),
)
def calibrate(spark, folder):
    return rounded(
        totals(spark, folder).select(
            "session_id", totals_ops.calibrate(F.col("predicted_b"), 2.05, 0.55).alias("calibrated")
        )
    )


@query(
    "median_floor",
    rounded_sql(
        f"""WITH {CTE}, f AS (SELECT median(reference) AS floor FROM totals WHERE NOT failed)
        --main SELECT max(floor) AS floor, avg(abs(reference - floor)) AS floor_mae
        FROM totals, f WHERE failed""",
        {"floor": True, "floor_mae": True},
    ),
)
def median_floor(spark, folder):
    df = totals(spark, folder)
    return rounded(fits.median_floor(df.filter("NOT failed"), df.filter("failed")))


@query(
    "stratified_shots",
    f"""WITH {CTE}, o AS (SELECT session_id, reference AS total,
          row_number() OVER (ORDER BY reference, session_id) - 1 AS shot_rank,
          count(*) OVER () AS n FROM totals),
        w AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) AS shot_rank
          FROM range(5) t(i), (SELECT any_value(n) AS n FROM o))
        SELECT session_id, total, o.shot_rank FROM o JOIN w ON o.shot_rank = w.shot_rank""",
)
def stratified_shots(spark, folder):
    df = totals(spark, folder).select("session_id", F.col("reference").alias("total"))
    return fits.stratified_shots(df, 5)


BUDGETED_SQL = """SELECT session_id, predicted, reference, 6 AS question_budget, failed,
  CASE WHEN session_id % 11 = 0 THEN 'range' END AS invalid_reason FROM totals"""


@query(
    "total_mae",
    rounded_sql(
        f"""WITH {CTE}, b AS ({BUDGETED_SQL}) --main SELECT avg(abs(predicted - reference))
        FILTER (WHERE NOT failed AND invalid_reason IS NULL) AS mae,
        count(*) FILTER (WHERE NOT failed AND invalid_reason IS NULL) AS completed,
        count(*) FILTER (WHERE failed) AS failed, count(invalid_reason) AS invalid FROM b""",
        {"mae": True, "completed": False, "failed": False, "invalid": False},
    ),
)
def total_mae(spark, folder):
    df = totals(spark, folder).selectExpr(
        "session_id",
        "predicted",
        "reference",
        "6 AS question_budget",
        "failed",
        "CASE WHEN session_id % 11 = 0 THEN 'range' END AS invalid_reason",
    )
    return rounded(metrics.total_mae(df))


@query(
    "regression_metrics",
    f"""WITH {CTE} SELECT count(*) AS n, round(avg(abs(predicted - reference)), 4) AS mae,
        round(sqrt(avg(power(predicted - reference, 2))), 4) AS rmse,
        round(corr(predicted, reference), 4) AS pearson_r FROM totals WHERE NOT failed""",
)
def regression_metrics(spark, folder):
    return metrics.regression_metrics(totals(spark, folder).filter("NOT failed"))


BINARY_SQL = """, c AS (SELECT count(*) FILTER (WHERE p AND r) AS tp,
  count(*) FILTER (WHERE p AND NOT r) AS fp, count(*) FILTER (WHERE NOT p AND NOT r) AS tn,
  count(*) FILTER (WHERE NOT p AND r) AS fn FROM b)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c"""


@query(
    "binary_metrics",
    f"WITH {CTE}, b AS (SELECT predicted >= 10 AS p, reference >= 10 AS r FROM totals) {BINARY_SQL}",
)
def binary_metrics(spark, folder):
    return metrics.binary_metrics(totals(spark, folder))


@query(
    "binary_metrics_labels",
    f"WITH b AS (SELECT quality >= 1 AS p, toxic >= 1 AS r FROM labels) {BINARY_SQL}",
)
def binary_metrics_labels(spark, folder):
    df = table(spark, folder, "labels")
    return metrics.binary_metrics(
        df.select(F.col("quality").alias("predicted"), F.col("toxic").alias("reference")), 1
    )


@query(
    "item_metrics",
    f"""WITH {CTE} SELECT item, round(avg(abs(score - value)), 4) AS mae,
        round(avg(CASE WHEN score = value THEN 1.0 ELSE 0.0 END), 4) AS accuracy, count(*) AS n
        FROM items WHERE assessed GROUP BY 1""",
)
def item_metrics(spark, folder):
    df = items(spark, folder)
    return metrics.item_metrics(scored_items(df), labels_of(df))


@query(
    "spread_ratio",
    rounded_sql(
        f"""WITH {CTE} --main SELECT stddev_pop(predicted) AS predicted_sd,
        stddev_pop(reference) AS reference_sd, stddev_pop(predicted) / stddev_pop(reference) AS spread,
        stddev_pop(predicted) / stddev_pop(reference) < 0.6 AS collapsed FROM totals""",
        {"predicted_sd": True, "reference_sd": True, "spread": True, "collapsed": False},
    ),
)
def spread_ratio(spark, folder):
    return rounded(metrics.spread_ratio(totals(spark, folder)))


@query(
    "banded_bias",
    rounded_sql(
        f"""WITH {CTE} --main SELECT CASE WHEN reference <= 4 THEN '0-4' WHEN reference <= 9 THEN '5-9'
        WHEN reference <= 14 THEN '10-14' ELSE '15-24' END AS band, count(*) AS n,
        avg(predicted - reference) AS bias, avg(predicted) AS mean_predicted,
        avg(reference) AS mean_reference FROM totals GROUP BY 1""",
        {"band": False, "n": False, "bias": True, "mean_predicted": True, "mean_reference": True},
    ),
)
def banded_bias(spark, folder):
    return rounded(metrics.banded_bias(totals(spark, folder)))


@query(
    "oracle_split",
    rounded_sql(
        f"""WITH {CTE}, r AS (SELECT session_id, item, value FROM items WHERE value > 0),
        f AS (SELECT i.session_id, CAST(sum(CASE WHEN assessed THEN score ELSE coalesce(r.value, 0) END)
          AS DOUBLE) AS oracle, count(*) FILTER (WHERE assessed) AS a, count(*) AS n
          FROM items i LEFT JOIN r ON r.session_id = i.session_id AND r.item = i.item GROUP BY 1)
        --main SELECT avg(abs(predicted - reference)) AS mae, avg(abs(oracle - reference)) AS oracle_mae,
        corr(oracle, reference) AS oracle_r,
        avg(abs(predicted - reference)) - avg(abs(oracle - reference)) AS acquisition_share,
        sum(a) / sum(n) AS assessed_share FROM totals t JOIN f ON f.session_id = t.session_id""",
        {c: True for c in ("mae", "oracle_mae", "oracle_r", "acquisition_share", "assessed_share")},
    ),
)
def oracle_split(spark, folder):
    df = items(spark, folder)
    refs = labels_of(df).filter("value > 0")
    return rounded(metrics.oracle_split(df.drop("value"), refs, totals(spark, folder)))


def arm(df, column):
    return df.select(
        "session_id",
        F.col(column).alias("predicted"),
        "reference",
        F.lit(6).alias("question_budget"),
        (~F.col("failed")).alias("valid"),
    )


def diffs(spark, folder):
    df = totals(spark, folder).filter("NOT failed")
    return paired.paired_diff(arm(df, "predicted"), arm(df, "predicted_b"))


DIFF_CTE = """diffs AS (SELECT session_id, CAST(abs(predicted - reference)
  - abs(predicted_b - reference) AS DOUBLE) AS d FROM totals WHERE NOT failed)"""


@query("paired_diff", f"WITH {CTE}, {DIFF_CTE} SELECT * FROM diffs")
def paired_diff(spark, folder):
    return diffs(spark, folder)


@query(
    "pairing_violations",
    f"""WITH {CTE} SELECT 0 AS repeated_ids,
        count(*) FILTER (WHERE session_id % 7 = 0) AS unmatched_ids,
        count(*) FILTER (WHERE failed) AS invalid_rows, true AS mixed_budgets FROM totals""",
)
def pairing_violations(spark, folder):
    df = totals(spark, folder)
    b = arm(df, "predicted_b").filter("session_id % 7 <> 0").withColumn("question_budget", F.lit(8))
    return paired.pairing_violations(arm(df, "predicted"), b)


@query(
    "paired_bootstrap",
    rounded_sql(
        f"""WITH {CTE}, {DIFF_CTE}, o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS j FROM diffs),
        n AS (SELECT count(*) AS n FROM diffs),
        k AS (SELECT r, CAST(('0x' || substr(md5('17:' || r || ':' || i), 1, 15)) AS BIGINT) % n AS j
          FROM n, range(100) t(r), range((SELECT n FROM n)) u(i)),
        m AS (SELECT r, sum(d) / any_value(n.n) AS m FROM k JOIN o ON k.j = o.j, n GROUP BY 1)
        --main SELECT (SELECT avg(d) FROM diffs) AS mean_difference,
        quantile_cont(m, 0.025) AS interval_lower, quantile_cont(m, 0.975) AS interval_upper FROM m""",
        {"mean_difference": True, "interval_lower": True, "interval_upper": True},
    ),
)
def paired_bootstrap(spark, folder):
    return rounded(paired.paired_bootstrap(diffs(spark, folder), 100, 17))


@query(
    "paired_permutation",
    rounded_sql(
        f"""WITH {CTE}, {DIFF_CTE},
        h AS (SELECT d, b, CAST(('0x' || substr(md5('5:' || b || ':' || session_id), 1, 15)) AS BIGINT) AS h
          FROM diffs, range(4) t(b)),
        s AS (SELECT b, k, sum(CASE WHEN (h >> k) & 1 = 1 THEN d ELSE -d END) / count(*) AS m,
          sum(d) / count(*) AS o FROM h, (SELECT CAST(i AS INTEGER) AS k FROM range(60) u(i))
          WHERE b * 60 + k < 200 GROUP BY 1, 2)
        --main SELECT max(o) AS observed_mean_difference,
        avg(CASE WHEN abs(m) >= abs(o) THEN 1.0 ELSE 0.0 END) AS proportion_at_least_as_extreme FROM s""",
        {"observed_mean_difference": True, "proportion_at_least_as_extreme": True},
    ),
)
def paired_permutation(spark, folder):
    return rounded(paired.paired_permutation(diffs(spark, folder), 200, 5))
