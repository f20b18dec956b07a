"""Evidence memory, scheduling and explanation over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...operators import memory as M
from ...operators import totals as T
from .base import View, query, rounded, rounded_sql, strings, table

EVIDENCE = View(
    "events",
    session_id="user_id",
    topic="event_type",
    ts="ts",
    turn="concat('turn-', CAST(event_id % 50 AS STRING))",
    quote="concat('quote ', CAST(event_id % 40 AS STRING))",
    polarity="CASE event_id % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'refutes' ELSE 'uncertain' END",
    frequency_basis=(
        "CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'stated_days' WHEN 2 THEN 'frequency_word' "
        "WHEN 3 THEN 'ongoing_state' ELSE 'single_episode' END"
    ),
    relation="CASE event_id % 2 WHEN 0 THEN 'probe' ELSE 'reverse' END",
    confidence="least(1.0, value / 100)",
    round_index="event_id % 4",
)

_RECORD_ID = (
    """sha256('{"participant":"' || session_id || '","quote":"' || quote || '","topic":"' """
    """|| topic || '","turn_ids":["' || turn || '"]}')"""
)

EVIDENCE_CTE = f"e AS (SELECT *, {_RECORD_ID} AS record_id FROM ({EVIDENCE.sql}))"


def evidence(spark, folder):
    df = EVIDENCE.load(spark, folder).withColumn("turn_ids", F.array("turn"))
    rid = M.record_id(F.col("session_id"), F.col("topic"), F.col("turn_ids"), F.col("quote"))
    return df.withColumn("record_id", rid).drop("turn")


@query(
    "record_id",
    """SELECT conv_id AS session_id, turn AS turn_idx, sha256(CAST(to_json({'participant': CAST(conv_id AS VARCHAR),
       'quote': text, 'topic': role, 'turn_ids': ['turn-' || turn]}) AS VARCHAR)) AS record_id FROM conversations""",
)
def record_id(spark, folder):
    turn = F.concat(F.lit("turn-"), F.col("turn").cast("string"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_idx"),
        M.record_id(F.col("conv_id"), F.col("role"), F.array(turn), F.col("text")).alias("record_id"),
    )


@query(
    "append_evidence",
    f"""WITH {EVIDENCE_CTE}, old AS (SELECT record_id, round_index, CAST(confidence AS DOUBLE) AS confidence
          FROM e WHERE ts < TIMESTAMP '2024-01-16'),
        fresh AS (SELECT record_id, round_index, CAST(confidence AS DOUBLE) AS confidence FROM e
          WHERE ts >= TIMESTAMP '2024-01-11' AND record_id NOT IN (SELECT record_id FROM old)
          QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY round_index, confidence DESC) = 1)
        SELECT * FROM old UNION ALL SELECT * FROM fresh""",
)
def append_evidence(spark, folder):
    df = evidence(spark, folder).select("record_id", "round_index", "confidence", "ts")
    old = df.filter("ts < TIMESTAMP '2024-01-16'").drop("ts")
    return M.append_evidence(old, df.filter("ts >= TIMESTAMP '2024-01-11'").drop("ts"))


MEMORY_CTE = f"""{EVIDENCE_CTE},
mem AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY round_index, confidence DESC,
  polarity, frequency_basis) = 1),
sided AS (SELECT *, CASE WHEN polarity = 'refutes' THEN 'refutes' WHEN polarity = 'supports'
  AND frequency_basis <> 'none' THEN 'supports' END AS side FROM mem)"""


def memory(spark, folder):
    """Each claim once; the catalog decides ties by the remaining columns."""
    order = [F.col("round_index"), F.col("confidence").desc(), F.col("polarity"), F.col("frequency_basis")]
    return M.top_k(evidence(spark, folder), ["record_id"], order, 1, "k").drop("k")


@query(
    "contradiction_sides",
    f"""WITH {MEMORY_CTE}, s AS (SELECT session_id, topic, record_id, round_index, side,
          count(*) FILTER (WHERE side = 'refutes') OVER w AS r, count(*) FILTER (WHERE side = 'supports') OVER w AS p
        FROM sided WINDOW w AS (PARTITION BY session_id, topic))
        SELECT session_id, topic, record_id, round_index, side, CASE WHEN side = 'refutes' THEN p ELSE r END
          AS counterparts FROM s WHERE side IS NOT NULL AND r > 0 AND p > 0""",
)
def contradiction_sides(spark, folder):
    return M.contradiction_sides(memory(spark, folder)).drop("first")


@query(
    "contradictions",
    f"""WITH {MEMORY_CTE}, s AS (SELECT *, count(*) FILTER (WHERE side = 'refutes') OVER w AS r,
          count(*) FILTER (WHERE side = 'supports') OVER w AS p,
          min((round_index, record_id)) FILTER (WHERE side = 'refutes') OVER w AS fr,
          min((round_index, record_id)) FILTER (WHERE side = 'supports') OVER w AS fp
        FROM sided WINDOW w AS (PARTITION BY session_id, topic)),
        o AS (SELECT *, CASE WHEN side = 'refutes' THEN fp[1] ELSE fr[1] END AS oround,
          CASE WHEN side = 'refutes' THEN fp[2] ELSE fr[2] END AS oid FROM s WHERE side IS NOT NULL AND r > 0 AND p > 0)
        SELECT session_id, topic, record_id, oid AS counterpart_id, CASE WHEN side = 'refutes' THEN p ELSE r END AS counterparts,
          '{K.CONTRADICTION_REASON}' AS reason, CASE WHEN round_index < oround THEN record_id
          WHEN oround < round_index THEN oid END AS earlier_record_id FROM o""",
)
def contradictions(spark, folder):
    return M.contradictions(M.contradiction_sides(memory(spark, folder)))


TOPIC_ORD = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"

STATES_SQL = f"""SELECT user_id AS session_id, event_type AS topic, {TOPIC_ORD} AS topic_ord,
  ({strings(K.TIERS)})[CAST(sum(event_id) % 5 + 1 AS BIGINT)] AS tier, count(*) % 4 AS rounds_spent, 3 AS max_rounds,
  CASE sum(event_id) % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS sufficient,
  CAST(sum(event_id) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2, 3"""

UTILITY_CTE = f"""st AS ({STATES_SQL}), ut AS (SELECT *, round(
   CASE WHEN coalesce(sufficient, false) THEN 0.0 ELSE 1.0 - (list_position({strings(K.TIERS)}, tier) - 1) / 4.0 END
   + 0.25 * CASE WHEN topic || '|' || tier IN ('view|absent', 'click|lexical') THEN 1 ELSE 0 END
   - 0.5 * least(1.0, rounds_spent / 3.0), 9) AS utility,
   coalesce(sufficient, false) OR rounds_spent >= max_rounds AS resolved FROM st)"""

SCOPES = ["view|absent", "click|lexical"]


def states(spark, folder):
    k = F.sum("event_id")
    return (
        table(spark, folder, "events")
        .groupBy(
            F.col("user_id").alias("session_id"),
            F.col("event_type").alias("topic"),
            F.expr(TOPIC_ORD).alias("topic_ord"),
        )
        .agg(k.alias("k"), F.count("*").alias("n"))
        .withColumns(
            {
                "tier": F.element_at(F.lit(K.TIERS), (F.col("k") % 5 + 1).cast("int")),
                "rounds_spent": F.col("n") % 4,
                "max_rounds": F.lit(3),
                "sufficient": F.when(F.col("k") % 7 == 0, True).when(F.col("k") % 7 != 1, False),
            }
        )
    )


@query(
    "utility",
    rounded_sql(
        f"WITH {UTILITY_CTE} --main SELECT session_id, topic, utility, resolved FROM ut",
        {"session_id": False, "topic": False, "utility": True, "resolved": False},
    ),
)
def utility(spark, folder):
    df = M.with_utility(states(spark, folder), SCOPES)
    return rounded(df.select("session_id", "topic", "utility", "resolved"))


@query(
    "next_action",
    f"""WITH {UTILITY_CTE} SELECT session_id, topic FROM ut WHERE NOT resolved
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY utility DESC, topic_ord) = 1""",
)
def next_action(spark, folder):
    return M.next_action(states(spark, folder), SCOPES).select("session_id", "topic")


RESULTS_CTE = f"""st AS ({STATES_SQL}), res AS (SELECT session_id, topic, CASE WHEN k % 6 > 3 THEN NULL ELSE k % 4 END
  AS score, k % 6 > 3 AS abstained, CASE WHEN k % 6 = 0 THEN 'no' ELSE 'yes' END AS present, tier AS evidence_tier,
  k % 5 = 0 AS citation_mismatch, k % 3 <> 0 AS quote_grounded, k % 11 = 0 AS parse_failed, 1 + n % 3 AS rounds FROM st)"""


def item_results(spark, folder):
    return states(spark, folder).selectExpr(
        "session_id",
        "topic",
        "CASE WHEN k % 6 > 3 THEN NULL ELSE k % 4 END AS score",
        "k % 6 > 3 AS abstained",
        "CASE WHEN k % 6 = 0 THEN 'no' ELSE 'yes' END AS present",
        "tier AS evidence_tier",
        "k % 5 = 0 AS citation_mismatch",
        "k % 3 <> 0 AS quote_grounded",
        "k % 11 = 0 AS parse_failed",
        "1 + n % 3 AS rounds",
    )


def _raise(i: int) -> str:
    return f"'evidence of {K.DAY_BANDS[i]} would raise the score to {i}'"


def _lower(i: int) -> str:
    return f"'evidence of only {K.DAY_BANDS[i]} would lower the score to {i}'"


COUNTERFACTUAL_SQL = (
    f"CASE WHEN abstained OR score IS NULL THEN '{K.COUNTERFACTUAL_UNSCORED}' "
    f"WHEN score = 0 THEN {_raise(1)} WHEN score = 1 THEN {_raise(2)} || '; ' || {_lower(0)} "
    f"WHEN score = 2 THEN {_raise(3)} || '; ' || {_lower(1)} ELSE {_lower(2)} END"
)


@query(
    "counterfactual",
    f"WITH {RESULTS_CTE} SELECT session_id, topic, {COUNTERFACTUAL_SQL} AS counterfactual FROM res",
)
def counterfactual(spark, folder):
    return item_results(spark, folder).select(
        "session_id",
        "topic",
        M.counterfactual(F.col("score"), ~F.col("abstained")).alias("counterfactual"),
    )


MAP_CTE = f"""{RESULTS_CTE}, {MEMORY_CTE},
sup AS (SELECT session_id, topic, count(*) AS records, CAST(round(CAST(avg(confidence) AS DECIMAL(20,9)), 3) AS DOUBLE) AS confidence,
  count(*) FILTER (WHERE side = 'refutes') * count(*) FILTER (WHERE side = 'supports') AS edges FROM sided GROUP BY 1, 2),
cmap AS (SELECT r.session_id, r.topic, CASE WHEN abstained THEN 'unresolved' WHEN present = 'no' THEN 'refuted'
  ELSE 'supported' END AS status, score, coalesce(records, 0) AS records, confidence, coalesce(edges, 0) > 0 AS contradiction,
  coalesce(edges, 0) AS contradictions, {COUNTERFACTUAL_SQL} AS counterfactual
  FROM res r LEFT JOIN sup s ON s.session_id = r.session_id AND s.topic = r.topic)"""


def cmap(spark, folder):
    return M.criterion_map(item_results(spark, folder), memory(spark, folder))


@query("criterion_map", f"WITH {MAP_CTE} SELECT * FROM cmap")
def criterion_map(spark, folder):
    return cmap(spark, folder)


@query(
    "criterion_records",
    f"""WITH {RESULTS_CTE}, {MEMORY_CTE}, s AS (SELECT *, min((round_index, record_id)) FILTER (WHERE side = 'refutes') OVER w AS fr,
          min((round_index, record_id)) FILTER (WHERE side = 'supports') OVER w AS fp
        FROM sided WINDOW w AS (PARTITION BY session_id, topic))
        SELECT s.session_id, s.topic, record_id, CASE WHEN fr IS NOT NULL AND fp IS NOT NULL THEN side END AS side,
          CASE WHEN fr IS NULL OR fp IS NULL THEN NULL WHEN side = 'refutes' THEN fp[2] WHEN side = 'supports' THEN fr[2] END AS counterpart_id
        FROM s SEMI JOIN res r ON r.session_id = s.session_id AND r.topic = s.topic""",
)
def criterion_records(spark, folder):
    return M.criterion_records(item_results(spark, folder), memory(spark, folder))


@query(
    "collect_maps",
    f"""WITH {MAP_CTE} SELECT session_id,
        coalesce(string_agg(topic, ',' ORDER BY topic) FILTER (WHERE contradiction), '') AS contradicted_criteria,
        coalesce(string_agg(topic, ',' ORDER BY topic) FILTER (WHERE status = 'unresolved'), '') AS unresolved_criteria,
        count(*) FILTER (WHERE contradiction) AS contradicted, count(*) FILTER (WHERE status = 'unresolved') AS unresolved
        FROM cmap GROUP BY 1""",
)
def collect_maps(spark, folder):
    df = M.collect_maps(cmap(spark, folder))
    return df.withColumns(
        {c: F.array_join(c, ",") for c in ("contradicted_criteria", "unresolved_criteria")}
    )


@query(
    "session_diagnostics",
    f"""WITH {MAP_CTE} SELECT r.session_id, {", ".join(f"count(*) FILTER (WHERE evidence_tier = '{t}') AS tier_{t}" for t in K.TIERS)},
        count(*) FILTER (WHERE r.score IS NULL) AS abstentions, count(*) FILTER (WHERE citation_mismatch) AS citation_mismatches,
        count(*) FILTER (WHERE r.score IS NOT NULL AND NOT quote_grounded) AS ungrounded_quotes,
        count(*) FILTER (WHERE parse_failed) AS parse_failures, CAST(sum(rounds - 1) AS BIGINT) AS expansion_rounds,
        CAST(sum(c.contradictions) AS BIGINT) AS contradictions
        FROM res r JOIN cmap c ON c.session_id = r.session_id AND c.topic = r.topic GROUP BY 1""",
)
def session_diagnostics(spark, folder):
    counts = M.contradiction_counts(memory(spark, folder))
    return T.session_diagnostics(item_results(spark, folder), counts)


@query(
    "diagnostic_rates",
    """WITH d AS (SELECT o_orderkey % 9 AS known, o_custkey % 4 AS missing, o_orderkey % 3 AS cm,
         o_custkey % 2 AS lf FROM orders)
       SELECT CAST(sum(known + missing) AS DOUBLE) AS total_topic_assessments,
         round(sum(known) / sum(known + missing), 4) AS evidence_coverage_rate,
         round(sum(cm) / sum(known + missing), 4) AS citation_mismatch_rate,
         round(sum(lf) / sum(known + missing), 4) AS low_faithfulness_rate FROM d""",
)
def diagnostic_rates(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey % 9 AS known",
        "o_custkey % 4 AS missing",
        "o_orderkey % 3 AS citation_mismatches",
        "o_custkey % 2 AS low_faithfulness",
    )
    return T.diagnostic_rates(df)


@query(
    "report",
    """SELECT l_orderkey AS case_id, CAST(sum(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_partkey % 4 END) AS BIGINT) AS total,
       CAST(sum(l_linenumber % 3) AS BIGINT) AS cited_slots, count(*) AS topics FROM lineitem GROUP BY 1""",
)
def report(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_partkey") % 4).alias("proposed_score"),
        F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("l_linenumber") % 3).alias(
            "score_basis_slot_ids"
        ),
    )
    return T.report(df)


@query(
    "report_topics",
    """WITH r AS (SELECT l_orderkey AS case_id, l_linenumber AS topic, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_partkey % 4 END AS score,
         ['a', 'b'][1:l_linenumber % 3] AS slots FROM lineitem)
       SELECT case_id, topic, score, s.pos AS pos, s.slot AS slot_id FROM r
         LEFT JOIN LATERAL (SELECT generate_subscripts(slots, 1) - 1 AS pos, unnest(slots) AS slot) s ON true""",
)
def report_topics(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("topic"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_partkey") % 4).alias("proposed_score"),
        F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("l_linenumber") % 3).alias("score_basis_slot_ids"),
    )
    return T.report_topics(df)
