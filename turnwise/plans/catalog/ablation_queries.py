"""On/off evaluation, ablations, trace parity and usage over ``events``.

An arm is derived from the user, a seed from the event id; every row of the table takes
part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import metrics, paired
from .base import View, query, rounded, rounded_sql, table

ARM_NAMES = ["initial_on", "initial_off", "evolved_on", "evolved_off"]

ONOFF_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS arm, event_id AS state_id, user_id % 3 AS seed, value / 100 + {i} * (event_id % 7) / 70.0 AS quality FROM events"
    for i, a in enumerate(ARM_NAMES)
)


@query(
    "onoff_gain",
    rounded_sql(
        f"""WITH a AS ({ONOFF_SQL}), m AS (SELECT {", ".join(f"avg(quality) FILTER (WHERE arm = '{a}') AS {a}" for a in ARM_NAMES)} FROM a)
        --main SELECT true AS matched, evolved_on - initial_on AS combined_on_gain,
        evolved_off - initial_off AS parametric_off_gain FROM m""",
        {"matched": False, "combined_on_gain": True, "parametric_off_gain": True},
    ),
)
def onoff_gain(spark, folder):
    e = table(spark, folder, "events")
    listed = F.array(
        *(
            F.struct(
                F.lit(a).alias("arm"), (F.col("value") / 100 + i * (F.col("event_id") % 7) / 70.0).alias("quality")
            )
            for i, a in enumerate(ARM_NAMES)
        )
    )
    arms = e.select(
        F.col("event_id").alias("state_id"), (F.col("user_id") % 3).alias("seed"), F.explode(listed).alias("x")
    ).select("state_id", "seed", "x.*")
    return rounded(paired.onoff_gain(arms))


@query(
    "action_rate",
    rounded_sql(
        """WITH t AS (SELECT event_id, event_type AS action, value > 30 AS trig, event_id % 4 <> 0 AS has,
          event_id % 2 = 0 AS pos FROM events)
        --main SELECT count(*) AS triggered, count(*) FILTER (WHERE has AND (pos AND action <> 'error' OR action = 'view')) AS validated,
        avg(CASE WHEN has AND (pos AND action <> 'error' OR action = 'view') THEN 1.0 ELSE 0.0 END) AS rate FROM t WHERE trig""",
        {"triggered": False, "validated": False, "rate": True},
    ),
)
def action_rate(spark, folder):
    e = table(spark, folder, "events").withColumn("state_id", F.col("event_id"))
    actions = e.filter("event_id % 4 <> 0").select("state_id", F.col("event_type").alias("action"))
    positive = (
        e.filter("event_id % 2 = 0 AND event_type <> 'error'").select("state_id", F.col("event_type").alias("action"))
    ).unionByName(e.select("state_id", F.lit("view").alias("action")))
    return rounded(paired.action_rate(e.filter("value > 30"), actions, positive))


@query(
    "internalization",
    """WITH v AS (SELECT user_id, avg(value) FILTER (WHERE event_id % 2 = 0) AS q0, avg(value) FILTER (WHERE event_id % 2 = 1) AS q1,
         avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) AS r0, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS r1
         FROM events GROUP BY 1)
       SELECT user_id, concat_ws(',', CASE WHEN q1 <= q0 THEN 'memory_off_quality_not_improved' END,
         CASE WHEN r1 <= r0 THEN 'iar_not_improved' END) AS reasons, NOT (coalesce(q1 <= q0, false) OR r1 <= r0) AS internalized FROM v""",
)
def internalization(spark, folder):
    even = F.col("event_id") % 2 == 0
    df = table(spark, folder, "events").groupBy("user_id").agg(
        F.avg(F.when(even, F.col("value"))).alias("initial_off_quality"),
        F.avg(F.when(~even, F.col("value"))).alias("evolved_off_quality"),
        F.avg((F.col("event_type") == "view").cast("double")).alias("initial_rate"),
        F.avg((F.col("event_type") == "click").cast("double")).alias("evolved_rate"),
    )
    return paired.internalization(df).select(
        "user_id", F.array_join("reasons", ",").alias("reasons"), "internalized"
    )


OUTCOMES = View(
    "events",
    arm_id="event_type",
    seed="event_id % 3",
    value="value",
    questions_asked="event_id % 8",
    model_calls="event_id % 50",
)

SEEDED_SQL = f"SELECT arm_id, seed, avg(value) AS value, max(questions_asked) AS questions_asked, max(model_calls) AS model_calls FROM ({OUTCOMES.sql}) GROUP BY 1, 2"


def seeded(spark, folder):
    return (
        OUTCOMES.load(spark, folder)
        .groupBy("arm_id", "seed")
        .agg(
            F.avg("value").alias("value"),
            F.max("questions_asked").alias("questions_asked"),
            F.max("model_calls").alias("model_calls"),
        )
    )


@query(
    "ablation_violations",
    f"""WITH o AS ({SEEDED_SQL}), arms AS (SELECT DISTINCT event_type AS arm_id, event_id % 3 AS seed,
          CASE WHEN event_type = 'view' THEN 6 ELSE 7 END AS q FROM events WHERE event_type <> 'click' OR event_id % 3 < 2),
        s AS (SELECT o.*, a.q, a.arm_id IS NOT NULL AS declared FROM o LEFT JOIN arms a ON a.arm_id = o.arm_id AND a.seed = o.seed)
        SELECT 'click' AS arm_id, 'seeds_differ' AS violation, 1 AS n UNION ALL
        SELECT 'view', 'question_budget_differs', 1 UNION ALL
        SELECT arm_id, 'undeclared_seed', count(*) FROM s WHERE NOT declared GROUP BY 1 UNION ALL
        SELECT arm_id, 'question_budget_exceeded', count(*) FROM s WHERE questions_asked > q GROUP BY 1""",
)
def ablation_violations(spark, folder):
    arms = (
        OUTCOMES.load(spark, folder)
        .filter("arm_id <> 'click' OR seed < 2")
        .select(
            "arm_id",
            F.when(F.col("arm_id") != "error", F.col("arm_id")).alias("ablated_component"),
            F.when(F.col("arm_id") == "view", 6).otherwise(7).alias("question_budget"),
            F.lit(50).alias("model_call_budget"),
            "seed",
        )
        .distinct()
    )
    return paired.ablation_violations(arms, seeded(spark, folder))


@query(
    "seed_robustness",
    rounded_sql(
        f"""WITH o AS ({SEEDED_SQL}) --main SELECT arm_id, count(*) AS seed_count, avg(value) AS mean, min(value) AS minimum,
        max(value) AS maximum, max(value) - min(value) AS spread FROM o GROUP BY 1""",
        {"arm_id": False, "seed_count": False, "mean": True, "minimum": True, "maximum": True, "spread": True},
    ),
)
def seed_robustness(spark, folder):
    return rounded(paired.seed_robustness(seeded(spark, folder)))


@query(
    "ablation_effects",
    rounded_sql(
        f"""WITH o AS ({SEEDED_SQL}), d AS (SELECT a.arm_id, a.seed, a.value - r.value AS difference FROM o a
          JOIN o r ON r.seed = a.seed AND r.arm_id = 'error' WHERE a.arm_id <> 'error')
        --main SELECT *, avg(difference) OVER (PARTITION BY arm_id) AS mean_difference FROM d""",
        {"arm_id": False, "seed": False, "difference": True, "mean_difference": True},
    ),
)
def ablation_effects(spark, folder):
    return rounded(paired.ablation_effects(seeded(spark, folder), "error"))


SUMMARIES_SQL = """SELECT 'dev' AS split, event_type AS method, count(*) AS scored, round(avg(value), 4) AS mae FROM events GROUP BY 2
 UNION ALL SELECT 'test', o_orderstatus, count(*), NULL FROM orders GROUP BY 2"""


@query("compare_runs", SUMMARIES_SQL)
def compare_runs(spark, folder):
    a = (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("method"))
        .agg(F.count("*").alias("scored"), F.round(F.avg("value"), 4).alias("mae"))
        .withColumn("split", F.lit("dev"))
    )
    b = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderstatus").alias("method"))
        .agg(F.count("*").alias("scored"))
        .withColumn("split", F.lit("test"))
    )
    return metrics.compare_runs(a, b)


TRACE = View(
    "events",
    position="event_id",
    request_id="CAST(event_id AS STRING)",
    role="event_type",
    request_hash="CAST(user_id AS STRING)",
    response_hash="CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END",
    outcome="CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END",
    failure_type="CASE WHEN event_type = 'error' THEN 'timeout' END",
    provenance="'m1'",
    latency_ms="value * 10",
)


CANDIDATE = View(
    "events",
    **{
        **TRACE.columns,
        "role": "CASE WHEN event_id % 97 = 0 THEN 'other' ELSE event_type END",
        "request_hash": "CASE WHEN event_id % 89 = 0 THEN 'x' ELSE CAST(user_id AS STRING) END",
        "response_hash": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 53 = 0 THEN 'x' ELSE props END",
        "latency_ms": "value * 9 + 20",
    },
)


@query(
    "trace_parity",
    f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY position) AS k FROM ({TRACE.sql})),
        b AS (SELECT *, row_number() OVER (ORDER BY position) AS k FROM ({CANDIDATE.sql})),
        p AS (SELECT (a.request_id, a.role) IS DISTINCT FROM (b.request_id, b.role) AS cf,
          a.request_hash IS DISTINCT FROM b.request_hash AS rq, a.outcome IS DISTINCT FROM b.outcome OR a.failure_type IS DISTINCT FROM b.failure_type AS oc,
          a.response_hash IS DISTINCT FROM b.response_hash AS rs, greatest(b.latency_ms - a.latency_ms, 0) AS slow FROM a JOIN b ON a.k = b.k),
        s AS (SELECT (SELECT count(*) FROM a) AS baseline_count, (SELECT count(*) FROM b) AS candidate_count,
          count(*) FILTER (WHERE cf) AS control_flow_mismatches, count(*) FILTER (WHERE rq) AS request_mismatches,
          count(*) FILTER (WHERE oc) AS outcome_mismatches, count(*) FILTER (WHERE rs) AS response_mismatches, 0 AS provenance_mismatches,
          round(sum(slow), 3) AS total_latency_regression_ms, round(max(slow), 6) AS max_latency_regression_ms,
          round(avg(slow), 6) AS mean_latency_regression_ms FROM p)
        SELECT *, baseline_count = candidate_count AND control_flow_mismatches + request_mismatches + outcome_mismatches = 0
          AND response_mismatches <= 3 AND max_latency_regression_ms <= 5000 AS passes FROM s""",
)
def trace_parity(spark, folder):
    out = paired.trace_parity(TRACE.load(spark, folder), CANDIDATE.load(spark, folder), 3, 5000.0)
    return rounded(out).withColumn("total_latency_regression_ms", F.round("total_latency_regression_ms", 3))


USAGE = View(
    "events",
    ts="ts",
    event_id="event_id",
    outcome="CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'retry' ELSE 'call' END",
    truncated="event_id % 13 = 0",
    input_tokens="event_id % 1000",
    output_tokens="event_id % 300",
)

USAGE_SQL = """count(*) FILTER (WHERE outcome = 'call') AS calls, count(*) FILTER (WHERE outcome = 'retry') AS retries,
 count(*) FILTER (WHERE outcome = 'failure') AS failed_calls, count(*) FILTER (WHERE outcome = 'call' AND truncated) AS truncated_generations,
 CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 round((sum(input_tokens) * 0.15 + sum(output_tokens) * 0.6) / 1000000, 4) AS estimated_cost_usd"""


@query("usage_totals", f"SELECT {USAGE_SQL} FROM ({USAGE.sql})")
def usage_totals(spark, folder):
    return metrics.usage_totals(USAGE.load(spark, folder), 0.15, 0.6)
