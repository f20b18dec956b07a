"""Mining, gates, lesson tables and offline experience over ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions.hashing import canonical_hash
from ...functions.segments import scan_by_depth
from ...operators import experience as X
from ...operators import fits, lessons, mining
from .base import View, query, rounded, rounded_sql, strings, table
from .evaluation_queries import CTE as ITEMS_CTE
from .evaluation_queries import REFS_FIT_CTE, items, labels_of

TIERS_SQL = strings(K.TIERS)

STATES_CTE = f"""{ITEMS_CTE}, states AS (SELECT session_id, 'item_' || item AS topic,
  ({TIERS_SQL})[(session_id + item) % 5 + 1] AS evidence_tier, score AS predicted,
  CASE WHEN item % 3 = 0 THEN 3 ELSE value END AS reference, NOT assessed AS abstained FROM items)"""


def states(spark, folder):
    return items(spark, folder).select(
        "session_id",
        F.concat(F.lit("item_"), F.col("item").cast("string")).alias("topic"),
        F.element_at(F.lit(K.TIERS), ((F.col("session_id") + F.col("item")) % 5 + 1).cast("int")).alias("evidence_tier"),
        F.col("score").alias("predicted"),
        F.when(F.col("item") % 3 == 0, 3).otherwise(F.col("value")).alias("reference"),
        (~F.col("assessed")).alias("abstained"),
    )


CELLS_CTE = f"""{STATES_CTE}, cells AS (SELECT topic, evidence_tier, count(*) AS support,
  avg(CASE WHEN abstained THEN 0 ELSE predicted END - reference) AS mean_signed_error,
  avg(abs(CASE WHEN abstained THEN 0 ELSE predicted END - reference)) AS mean_absolute_error,
  avg(CASE WHEN abstained THEN 1.0 ELSE 0.0 END) AS abstention_rate FROM states GROUP BY 1, 2),
kept AS (SELECT *, abs(mean_signed_error) / mean_absolute_error AS systematic_share,
  CASE WHEN mean_signed_error < 0 THEN 'under' ELSE 'over' END AS direction,
  abs(mean_signed_error) * support AS strength FROM cells WHERE support >= 8
  AND round(mean_absolute_error, 9) >= 0.5 AND round(abs(mean_signed_error) / mean_absolute_error, 9) >= 0.4)"""


@query(
    "error_cells",
    rounded_sql(
        f"WITH {CELLS_CTE} --main SELECT * FROM kept",
        {
            "topic": False,
            "evidence_tier": False,
            "support": False,
            "mean_signed_error": True,
            "mean_absolute_error": True,
            "abstention_rate": True,
            "systematic_share": True,
            "direction": False,
            "strength": True,
        },
    ),
)
def error_cells(spark, folder):
    return rounded(mining.error_cells(states(spark, folder)))


@query(
    "cell_members",
    f"""WITH {CELLS_CTE} SELECT session_id, topic, evidence_tier, sha256('{{"participant":"' || session_id ||
        '","tier":"' || evidence_tier || '","topic":"' || topic || '"}}') AS state_id FROM states
        WHERE (topic, evidence_tier) IN (SELECT topic, evidence_tier FROM kept)""",
)
def cell_members(spark, folder):
    df = states(spark, folder)
    return mining.cell_members(df, mining.error_cells(df)).select(
        "session_id", "topic", "evidence_tier", "state_id"
    )


ROUNDS = View(
    "events",
    session_id="user_id",
    topic="event_type",
    round_index="event_id",
    before="event_id % 5",
    after="(event_id + CASE WHEN value < 12 THEN 1 ELSE 0 END) % 5",
    resolved_before="event_id % 11 = 0",
    resolved_after="event_id % 7 = 0",
)


def rounds(spark, folder):
    tier = F.lit(K.TIERS)
    return ROUNDS.load(spark, folder).select(
        "session_id",
        "topic",
        "round_index",
        F.element_at(tier, (F.col("before") + 1).cast("int")).alias("tier_before"),
        F.element_at(tier, (F.col("after") + 1).cast("int")).alias("tier_after"),
        "resolved_before",
        "resolved_after",
        F.array(
            *(F.concat(F.lit(f"q{i}-"), (F.col("round_index") % 9).cast("string")) for i in range(3))
        ).alias("queries"),
    )


@query(
    "low_yield_cells",
    f"""WITH r AS ({ROUNDS.sql}), c AS (SELECT topic, before, count(*) AS support,
          avg(CASE WHEN (resolved_after AND NOT resolved_before) OR after > before THEN 1.0 ELSE 0.0 END) AS yield_rate
        FROM r GROUP BY 1, 2),
        s AS (SELECT topic, before, 'q0-' || round_index % 9 || ',q1-' || round_index % 9 AS q,
          row_number() OVER (PARTITION BY topic, before ORDER BY session_id, round_index) AS k FROM r),
        e AS (SELECT topic, before, string_agg(q, ',' ORDER BY k) AS sample_queries FROM s WHERE k <= 4 GROUP BY 1, 2)
        SELECT c.topic, ({TIERS_SQL})[c.before + 1] AS tier_before, support, round(yield_rate, 6) + 0.0 AS yield_rate,
          sample_queries, round((1 - yield_rate) * support, 6) + 0.0 AS wasted
        FROM c JOIN e ON e.topic = c.topic AND e.before = c.before WHERE support >= 8 AND round(yield_rate, 9) <= 0.35""",
)
def low_yield_cells(spark, folder):
    df = mining.low_yield_cells(rounds(spark, folder))
    return rounded(df.withColumn("sample_queries", F.array_join("sample_queries", ",")))


@query(
    "source_holdout",
    f"""WITH {CELLS_CTE}, p AS (SELECT DISTINCT topic, evidence_tier, session_id FROM states
          WHERE (topic, evidence_tier) IN (SELECT topic, evidence_tier FROM kept)),
        h AS (SELECT *, CAST('0x' || substr(md5('9:' || topic || ':' || evidence_tier || ':' || session_id), 1, 15) AS BIGINT) AS h FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY topic, evidence_tier ORDER BY h, session_id) - 1 AS a,
          greatest(1, count(*) OVER (PARTITION BY topic, evidence_tier) // 3) AS cut FROM h)
        SELECT topic, evidence_tier, session_id, CASE WHEN a < cut THEN 'source' ELSE 'holdout' END AS part FROM r""",
)
def source_holdout(spark, folder):
    df = states(spark, folder)
    return mining.source_holdout(mining.cell_members(df, mining.error_cells(df)), 9)


@query(
    "worst_examples",
    f"""WITH {STATES_CTE}, e AS (SELECT topic, evidence_tier, session_id,
          abs(CASE WHEN abstained THEN 0 ELSE predicted END - reference) AS error FROM states)
        SELECT *, row_number() OVER w AS rank FROM e
        WINDOW w AS (PARTITION BY topic, evidence_tier ORDER BY error DESC, session_id) QUALIFY row_number() OVER w <= 4""",
)
def worst_examples(spark, folder):
    return mining.worst_examples(states(spark, folder), 4).select(
        "topic", "evidence_tier", "session_id", "error", F.col("rank").cast("long").alias("rank")
    )


GAIN_SQL = "greatest(-1.0, least(1.0, (abs({c} - {y}) - abs({t} - {y})) / 3.0))"

OUTCOMES_CTE = f"""{STATES_CTE}, outcomes AS (SELECT topic || '|' || evidence_tier AS lesson_id, session_id AS state_id,
  {GAIN_SQL.format(c='predicted', t='(predicted + reference * 2) / 3.0', y='reference')} AS gain,
  session_id % 2 = 0 AS control_grounded, NOT (session_id % 401 = 0) AS treatment_grounded FROM states),
excluded AS (SELECT lesson_id, state_id FROM outcomes WHERE state_id % 3 = 0)"""


def outcomes(spark, folder):
    p, y = F.col("predicted"), F.col("reference")
    df = states(spark, folder).select(
        F.concat_ws("|", "topic", "evidence_tier").alias("lesson_id"),
        F.col("session_id").alias("state_id"),
        mining.score_gain(p, (p + y * 2) / 3.0, y).alias("gain"),
        (F.col("session_id") % 2 == 0).alias("control_grounded"),
        (F.col("session_id") % 401 != 0).alias("treatment_grounded"),
    )
    return df, df.filter("state_id % 3 = 0").select("lesson_id", "state_id")


@query(
    "score_gain",
    rounded_sql(
        f"WITH {OUTCOMES_CTE} --main SELECT lesson_id, state_id, gain FROM outcomes",
        {"lesson_id": False, "state_id": False, "gain": True},
    ),
)
def score_gain(spark, folder):
    return rounded(outcomes(spark, folder)[0].select("lesson_id", "state_id", "gain"))


@query(
    "efficiency_gain",
    f"""SELECT session_id, round_index, round(greatest(-1.0, least(1.0, (after + CASE WHEN resolved_after THEN 1 ELSE 0 END
        - before - CASE WHEN resolved_before THEN 1 ELSE 0 END) / 5.0)), 6) + 0.0 AS gain FROM ({ROUNDS.sql})""",
)
def efficiency_gain(spark, folder):
    value = mining.acquisition_value
    return rounded(
        rounds(spark, folder).select(
            "session_id",
            "round_index",
            mining.efficiency_gain(
                value(F.col("tier_before"), F.col("resolved_before")),
                value(F.col("tier_after"), F.col("resolved_after")),
            ).alias("gain"),
        )
    )


@query(
    "acquisition_treatment",
    f"""SELECT session_id, round_index, ({TIERS_SQL})[greatest(before, CASE WHEN resolved_after THEN 2 ELSE before END) + 1]
        AS tier FROM ({ROUNDS.sql})""",
)
def acquisition_treatment(spark, folder):
    found = F.when(F.col("resolved_after"), "expanded")
    return rounds(spark, folder).select(
        "session_id", "round_index", mining.acquisition_treatment(F.col("tier_before"), found).alias("tier")
    )


@query(
    "resolve_arm",
    rounded_sql(
        f"""WITH {ITEMS_CTE}, {REFS_FIT_CTE},
        arm AS (SELECT session_id * 10 + item AS state_id, session_id, item,
          CASE WHEN (session_id + item) % 3 = 0 THEN NULL ELSE (score + 1) % 4 END AS score FROM items),
        o AS (SELECT a.state_id, avg(i.score) AS m FROM arm a JOIN items i ON i.session_id = a.session_id
          AND i.item <> a.item AND i.assessed WHERE a.score IS NULL GROUP BY 1)
        --main SELECT a.state_id, CASE WHEN a.score IS NOT NULL THEN a.score WHEN m IS NULL
          THEN greatest(0, least(3, base_rate)) ELSE greatest(0, least(3, intercept + slope * m)) END AS value
        FROM arm a LEFT JOIN o ON o.state_id = a.state_id LEFT JOIN refs_fit f ON f.item = a.item""",
        {"state_id": False, "value": True},
    ),
)
def resolve_arm(spark, folder):
    df = items(spark, folder)
    arm = df.select(
        (F.col("session_id") * 10 + F.col("item")).alias("state_id"),
        "session_id",
        "item",
        F.when((F.col("session_id") + F.col("item")) % 3 != 0, (F.col("score") + 1) % 4).alias("score"),
    )
    assessed = df.filter("assessed").select("session_id", "item", "score")
    out = mining.resolve_arm(arm, assessed, fits.fit_impute_refs(labels_of(df)))
    return rounded(out.select("state_id", "value"))


#: Supporting states that a lesson needs.
MIN_SUPPORT = 6

GATE_CTE = f"""{OUTCOMES_CTE}, marked AS (SELECT o.*, e.state_id IS NULL AS ok FROM outcomes o LEFT JOIN excluded e
  ON e.lesson_id = o.lesson_id AND e.state_id = o.state_id),
g AS (SELECT lesson_id, count(*) FILTER (WHERE ok) AS support, coalesce(avg(gain) FILTER (WHERE ok), 0) AS mean_gain,
  coalesce(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 0) AS improved,
  count(*) FILTER (WHERE ok AND control_grounded AND NOT treatment_grounded) AS regressions FROM marked GROUP BY 1),
gate AS (SELECT *, concat_ws(',', CASE WHEN support = 0 THEN 'no_source_excluded_states' END,
  CASE WHEN support > 0 AND support < 6 THEN 'insufficient_support' END,
  CASE WHEN support > 0 AND round(mean_gain, 9) < 0.02 THEN 'utility_margin_below_threshold' END,
  CASE WHEN support > 0 AND round(improved, 9) < 0.55 THEN 'too_few_states_improved' END,
  CASE WHEN support > 0 AND regressions > 0 THEN 'safety_regression' END) AS reasons FROM g),
valid AS (SELECT lesson_id, count(*) FILTER (WHERE ok) AS eligible, count(*) FILTER (WHERE ok AND gain > 0) AS supporting,
  CASE WHEN count(*) FILTER (WHERE ok AND gain > 0) >= {MIN_SUPPORT} THEN 'validated' ELSE 'rejected' END AS lifecycle
  FROM marked GROUP BY 1)"""


@query(
    "transfer_gate",
    f"""WITH {GATE_CTE} SELECT lesson_id, support, round(mean_gain, 6) + 0.0 AS mean_gain, round(improved, 6) + 0.0 AS improved,
        regressions, reasons, reasons = '' AS promoted FROM gate""",
)
def transfer_gate(spark, folder):
    gate = mining.transfer_gate(*outcomes(spark, folder))
    return rounded(gate.withColumn("reasons", F.array_join("reasons", ",")))


def validated(spark, folder):
    out, excluded = outcomes(spark, folder)
    results = out.select("lesson_id", F.col("state_id").alias("source_id"), (F.col("gain") > 0).alias("supports"))
    return mining.validate_lessons(results, excluded.withColumnRenamed("state_id", "source_id"), MIN_SUPPORT)


@query("validate_lessons", f"WITH {GATE_CTE} SELECT * FROM valid")
def validate_lessons(spark, folder):
    return validated(spark, folder)


@query(
    "promotions",
    f"""WITH {GATE_CTE} SELECT lesson_id FROM gate JOIN valid USING (lesson_id)
        WHERE reasons = '' AND lifecycle = 'validated'""",
)
def promotions(spark, folder):
    gate = mining.transfer_gate(*outcomes(spark, folder))
    return mining.promotions(gate, validated(spark, folder))


# --- lesson versions ----------------------------------------------------------------

VERSIONS_CTE = """n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS rn FROM events),
versions AS (SELECT user_id || '-' || event_type AS lesson_id, rn + 1 + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS version,
  CASE WHEN user_id % 2 = 0 THEN 'scorer' ELSE 'interviewer' END AS role, event_type || '|' || (user_id % 9) AS scope,
  'do ' || (user_id // 9 % 3) AS "do", user_id AS position, event_id,
  CASE WHEN rn = 0 THEN 'candidate' WHEN rn = 1 THEN 'validated' WHEN rn = 2 THEN 'promoted'
    WHEN event_id % 4 = 0 THEN 'retired' WHEN event_id % 4 = 1 THEN 'quarantined' ELSE 'promoted' END AS lifecycle,
  event_id % 5 = 0 AS merged FROM n)"""

CURRENT_CTE = f"""{VERSIONS_CTE}, cur AS (SELECT * FROM versions
  QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY version DESC, event_id) = 1)"""


def versions(spark, folder):
    events, keys = table(spark, folder, "events"), ["user_id", "event_type"]
    numbered = scan_by_depth(events, keys, ["ts", "event_id"], index="rn")
    user, e = F.col("user_id"), F.col("event_id")
    return numbered.select(
        F.concat_ws("-", user.cast("string"), "event_type").alias("lesson_id"),
        (F.col("rn") + 1 + F.when(e % 37 == 0, 1).otherwise(0)).alias("version"),
        F.when(user % 2 == 0, "scorer").otherwise("interviewer").alias("role"),
        F.concat(F.col("event_type"), F.lit("|"), (user % 9).cast("string")).alias("scope"),
        F.lit("t").alias("trigger"),
        F.concat(F.lit("do "), F.expr("user_id div 9 % 3").cast("string")).alias("do"),
        F.lit("a").alias("avoid"),
        F.lit("c").alias("criterion"),
        user.alias("position"),
        "event_id",
        F.when(F.col("rn") == 0, "candidate")
        .when(F.col("rn") == 1, "validated")
        .when(F.col("rn") == 2, "promoted")
        .when(e % 4 == 0, "retired")
        .when(e % 4 == 1, "quarantined")
        .otherwise("promoted")
        .alias("lifecycle"),
        (e % 5 == 0).alias("merged"),
    )


def current(spark, folder):
    """Newest version; two rows of the same version are settled by event id."""
    order = [F.col("version").desc(), F.col("event_id")]
    return lessons.top_k(versions(spark, folder), ["lesson_id"], order, 1, "k").drop("k")


@query("lesson_current", f"WITH {CURRENT_CTE} SELECT lesson_id, max(version) AS version FROM cur GROUP BY 1")
def lesson_current(spark, folder):
    return lessons.lesson_current(versions(spark, folder)).select("lesson_id", "version")


@query(
    "version_violations",
    f"""WITH {VERSIONS_CTE}, s AS (SELECT lesson_id, min(version) AS lo, max(version) AS hi, count(*) AS n,
          count(DISTINCT version) AS d FROM versions GROUP BY 1)
        SELECT lesson_id, 'first_version_not_one' AS violation FROM s WHERE lo <> 1
        UNION ALL SELECT lesson_id, 'repeated_version' FROM s WHERE n <> d
        UNION ALL SELECT lesson_id, 'version_gap' FROM s WHERE hi - lo + 1 <> d""",
)
def version_violations(spark, folder):
    return lessons.version_violations(versions(spark, folder))


@query(
    "lesson_append",
    f"""WITH {VERSIONS_CTE}, old AS (SELECT * FROM versions WHERE event_id % 2 = 0),
        m AS (SELECT lesson_id, max(version) AS v FROM old GROUP BY 1)
        SELECT e.lesson_id, e.version, e.event_id FROM versions e LEFT JOIN m ON m.lesson_id = e.lesson_id
        WHERE event_id % 2 = 1 AND e.version = coalesce(v, 0) + 1""",
)
def lesson_append(spark, folder):
    df = versions(spark, folder)
    out = lessons.lesson_append(df.filter("event_id % 2 = 0"), df.filter("event_id % 2 = 1"))
    return out.select("lesson_id", "version", "event_id")


MOVES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in K.LIFECYCLE_MOVES)


@query(
    "transition_violations",
    f"""WITH {VERSIONS_CTE} SELECT v.lesson_id, v.version, v.lifecycle, b.lifecycle AS before FROM versions v
        JOIN versions b ON b.lesson_id = v.lesson_id AND b.version + 1 = v.version
        WHERE (b.lifecycle, v.lifecycle) NOT IN (VALUES {MOVES_SQL}) AND NOT (v.merged AND b.lifecycle IN
          ('validated', 'promoted') AND (v.lifecycle = b.lifecycle OR v.lifecycle = 'retired'))""",
)
def transition_violations(spark, folder):
    return lessons.transition_violations(versions(spark, folder)).select(
        "lesson_id", "version", "lifecycle", "before"
    )


@query(
    "lesson_transition",
    f"""WITH {CURRENT_CTE}, w AS (SELECT *, CASE position % 3 WHEN 0 THEN 'promoted' WHEN 1 THEN 'retired' ELSE 'quarantined' END
          AS wanted FROM cur), o AS (SELECT *, lifecycle = CASE WHEN wanted = 'promoted' THEN 'validated' ELSE 'promoted' END AS ok FROM w)
        SELECT lesson_id, version + CASE WHEN ok THEN 1 ELSE 0 END AS version,
          CASE WHEN ok THEN wanted ELSE lifecycle END AS lifecycle, ok FROM o""",
)
def lesson_transition(spark, folder):
    cur = current(spark, folder)
    p = F.col("position") % 3
    wanted = cur.select(
        "lesson_id", F.when(p == 0, "promoted").when(p == 1, "retired").otherwise("quarantined").alias("lifecycle")
    )
    return lessons.lesson_transition(cur, wanted).select("lesson_id", "version", "lifecycle", "ok")


#: Lessons that are proposed for merging: among them candidates and members of another scope, which refuse their group.
PROPOSED = "lifecycle IN ('validated', 'promoted') OR (lifecycle = 'candidate' AND position % 4 = 0)"
MERGE_CTE = f"""{CURRENT_CTE}, m AS (SELECT *, role || '#' || split_part(scope, '|', 1) || '|' || CASE WHEN position % 50 = 7 THEN '0'
    ELSE split_part(scope, '|', 2) END AS gk FROM cur WHERE {PROPOSED}),
a AS (SELECT *, first_value(lesson_id) OVER w AS primary_id, row_number() OVER w - 1 AS ord, count(*) OVER p AS n,
  bool_and(lifecycle IN ('validated', 'promoted')) OVER p AND min(scope) OVER p = max(scope) OVER p AS fine
  FROM m WINDOW w AS (PARTITION BY gk ORDER BY position, lesson_id), p AS (PARTITION BY gk)),
g AS (SELECT * FROM a WHERE fine)"""


def merge_groups(cur):
    """Lessons of a (role, scope), and strays from other scopes, fold into the one that arrived first."""
    own = F.split_part("scope", F.lit("|"), F.lit(2))
    number = F.when(F.col("position") % 50 == 7, "0").otherwise(own)
    cur = cur.withColumn("gk", F.concat_ws("|", "role", F.split_part("scope", F.lit("|"), F.lit(1)), number))
    first = cur.groupBy("gk").agg(
        F.min_by("lesson_id", F.struct("position", "lesson_id")).alias("primary_id")
    )
    return cur.join(first, "gk").select(
        "primary_id",
        "lesson_id",
        F.when(F.col("lesson_id") == F.col("primary_id"), 0).otherwise(F.col("position") + 1).alias("ord"),
    )


@query(
    "merge_lessons",
    f"""WITH {MERGE_CTE} SELECT lesson_id, version + 1 AS version, CASE WHEN ord = 0 THEN lifecycle ELSE 'retired' END AS lifecycle,
        CASE WHEN ord > 0 THEN primary_id END AS merged_into FROM g WHERE n > 1""",
)
def merge_lessons(spark, folder):
    cur = current(spark, folder).filter(PROPOSED)
    return lessons.merge_lessons(cur, merge_groups(cur)).select("lesson_id", "version", "lifecycle", "merged_into")


@query(
    "merge_links",
    f"""WITH {MERGE_CTE}, l AS (SELECT primary_id AS lesson_id, 'source' AS kind, 's' || position % 5 AS value FROM g WHERE n > 1
          UNION SELECT primary_id, 'validation', lesson_id FROM g WHERE n > 1
          UNION SELECT primary_id, 'merged_from', lesson_id FROM g WHERE n > 1 AND ord > 0) SELECT * FROM l""",
)
def merge_links(spark, folder):
    cur = current(spark, folder).filter(PROPOSED)
    source = F.concat(F.lit("s"), (F.col("position") % 5).cast("string"))
    links = cur.select(
        "lesson_id", F.lit("source").alias("kind"), F.lit(0).alias("pos"), source.alias("value")
    ).unionByName(
        cur.select("lesson_id", F.lit("validation").alias("kind"), F.lit(0).alias("pos"), F.col("lesson_id").alias("value"))
    )
    return lessons.merge_links(cur, links, merge_groups(cur)).select("lesson_id", "kind", "value")


RETRIEVED_CTE = f"""{CURRENT_CTE}, ret AS (SELECT role, scope, row_number() OVER w AS rank, lesson_id,
  'When t, ' || "do" || ' Avoid: a You will know it applied when c' AS rule FROM cur WHERE lifecycle = 'promoted'
  WINDOW w AS (PARTITION BY role, scope ORDER BY position, lesson_id) QUALIFY row_number() OVER w <= 3)"""


@query("retrieve_lessons", f"WITH {RETRIEVED_CTE} SELECT * FROM ret")
def retrieve_lessons(spark, folder):
    out = lessons.retrieve_lessons(current(spark, folder), 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "lesson_blocks",
    f"""WITH {RETRIEVED_CTE} SELECT role, split_part(scope, '|', 1) AS key, string_agg(rule, '; ' ORDER BY scope, rank) AS rules
        FROM ret GROUP BY 1, 2""",
)
def lesson_blocks(spark, folder):
    out = lessons.lesson_blocks(lessons.retrieve_lessons(current(spark, folder), 3), True)
    return out.withColumn("rules", F.array_join("rules", "; "))


@query(
    "audit_transfer",
    """WITH s AS (SELECT l_linenumber || '-' || l_returnflag || '-' || l_suppkey % 20 AS lesson_id, count(*) AS n,
         round(avg(l_discount - l_tax - 0.01), 9) AS m, round(avg(CASE WHEN l_discount - l_tax - 0.01 > 0 THEN 1.0 ELSE 0.0 END), 9) AS w
         FROM lineitem GROUP BY 1)
       SELECT lesson_id, CASE WHEN n < 140 THEN 'insufficient-support' WHEN m <= 0 OR w < 0.5 THEN 'retire' ELSE 'keep' END AS verdict,
         CASE WHEN n < 140 THEN 'insufficient_transfer_support' WHEN m <= 0 THEN 'non_positive_mean_paired_benefit'
         WHEN w < 0.5 THEN 'transfer_win_rate_below_requirement' ELSE 'positive_transfer_supported' END AS reason FROM s""",
)
def audit_transfer(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.concat_ws(
            "-", F.col("l_linenumber").cast("string"), "l_returnflag", (F.col("l_suppkey") % 20).cast("string")
        ).alias("lesson_id"),
        (F.col("l_discount") - F.col("l_tax") - 0.01).alias("benefit"),
    )
    return lessons.audit_transfer(df, 140, 0.5)


@query(
    "poison_check",
    f"""WITH {CURRENT_CTE}, s AS (SELECT user_id || '-' || event_type AS lesson_id, count(DISTINCT event_id % 2) AS n
          FROM events GROUP BY 1)
        SELECT cur.lesson_id, position % 10 = 3 AS label_shaped, coalesce(n = 1, false) AS single_source
        FROM cur LEFT JOIN s ON s.lesson_id = cur.lesson_id""",
)
def poison_check(spark, folder):
    cur = current(spark, folder).withColumn(
        "avoid",
        F.when(F.col("position") % 10 == 3, " labels : never").when(F.col("position") % 10 == 4, "labels").otherwise("note: x"),
    )
    sources = table(spark, folder, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("lesson_id"),
        (F.col("event_id") % 2).cast("string").alias("source_id"),
    )
    return lessons.poison_check(cur, sources)


@query(
    "conflicts",
    f"""WITH {CURRENT_CTE}, p AS (SELECT * FROM cur WHERE lifecycle = 'promoted')
        SELECT DISTINCT a.lesson_id, a.scope FROM p a JOIN p b ON a.scope = b.scope AND a."do" <> b."do" """,
)
def conflicts(spark, folder):
    return lessons.conflicts(current(spark, folder))


DIGEST_SQL = "count(*) || ':' || " + " || ':' || ".join(
    f"CAST(sum(CAST('0x' || substr(sha256({{x}}), {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)
)


@query(
    "distill_candidates",
    f"""WITH c AS (SELECT 'k' || user_id AS lesson_key, 'view|' || user_id % 5 AS scope,
          CASE WHEN event_id % 400 = 7 THEN 'interviewer' ELSE 'scorer' END AS role, 'c' || event_id AS contrast_id,
          event_id % 300 <> 0 AS accepted FROM events),
        g AS (SELECT lesson_key, scope, min(role) AS role, count(*) AS sources, {DIGEST_SQL.format(x='contrast_id')} AS d FROM c
          GROUP BY 1, 2 HAVING bool_and(accepted) AND min(role) = max(role))
        SELECT lesson_key, scope, role, sha256('{{"role":"' || role || '","scope":"' || scope || '","sources":"' || d || '"}}') AS lesson_id,
          1 AS version, 'candidate' AS lifecycle, sources FROM g""",
)
def distill_candidates(spark, folder):
    e, user = F.col("event_id"), F.col("user_id")
    df = table(spark, folder, "events").select(
        F.concat(F.lit("k"), user.cast("string")).alias("lesson_key"),
        F.concat(F.lit("view|"), (user % 5).cast("string")).alias("scope"),
        F.when(e % 400 == 7, "interviewer").otherwise("scorer").alias("role"),
        F.concat(F.lit("c"), e.cast("string")).alias("contrast_id"),
        (e % 300 != 0).alias("accepted"),
    )
    return lessons.distill_candidates(df)


# --- offline experience ---------------------------------------------------------------

HARD_CTE = """h AS (SELECT event_id AS experience_id, event_type, user_id, least(1.0, value / 100) AS m,
  (event_id % 10) / 10.0 AS u, (user_id % 8) / 8.0 AS c FROM events),
hard AS (SELECT *, round((m + u + c) / 3.0, 9) AS normalized_score FROM h)"""


def hard(spark, folder):
    df = table(spark, folder, "events").select(
        F.col("event_id").alias("experience_id"), "event_type", "user_id", "value"
    )
    return X.hard_states(
        df,
        F.least(F.lit(1.0), F.col("value") / 100),
        (F.col("experience_id") % 10) / 10.0,
        (F.col("user_id") % 8) / 8.0,
        0.5,
    )


@query(
    "hard_states",
    f"""WITH {HARD_CTE} SELECT experience_id, round(normalized_score, 6) + 0.0 AS normalized_score, normalized_score >= 0.5 AS selected,
        CASE WHEN m = greatest(m, u, c) THEN 'missing' WHEN u = greatest(m, u, c) THEN 'uncertainty' ELSE 'coordination' END
          || '_signal_dominates' AS rationale FROM hard""",
)
def hard_states(spark, folder):
    return rounded(
        hard(spark, folder).select("experience_id", "normalized_score", "selected", "rationale")
    )


@query(
    "branch_set",
    f"""WITH {HARD_CTE}, s(i, strategy) AS (VALUES (0, 'probe'), (1, 'wait'), (2, 'rephrase'))
        SELECT experience_id, experience_id || '-branches' AS branch_set_id, experience_id || '-branches-' || i AS branch_id,
          strategy AS generation_strategy FROM hard, s WHERE normalized_score >= 0.5""",
)
def branch_set(spark, folder):
    out = X.branch_set(hard(spark, folder).filter("selected"), ["probe", "wait", "rephrase"])
    return out.select("experience_id", "branch_set_id", "branch_id", "generation_strategy")


BRANCHES = View(
    "events",
    branch_set_id="concat('b', CAST(user_id AS STRING), '-', event_type)",
    starting_state_hash="CASE WHEN event_id % 50 = 0 THEN 'x' ELSE 's' END",
    profile_hash="CASE WHEN event_id % 90 = 1 THEN 'x' ELSE 'p' END",
    policy_id="'policy'",
    simulator_version="CASE WHEN event_id % 200 = 3 THEN 'v2' ELSE 'v1' END",
    seed="CASE WHEN event_id % 70 = 2 THEN 1 ELSE 0 END",
)


@query(
    "branch_violations",
    "WITH b AS (" + BRANCHES.sql + ") "
    + " UNION ALL ".join(
        f"SELECT branch_set_id, 'differs_in_{c}' AS violation FROM b GROUP BY 1 HAVING min({c}) <> max({c})"
        for c in X.SHARED
    ),
)
def branch_violations(spark, folder):
    return X.branch_violations(BRANCHES.load(spark, folder))


@query(
    "branch_validity",
    """WITH b AS (SELECT event_id, event_id % 13 <> 0 AS safe, event_id % 17 <> 0 AS okt, event_id % 19 = 0 AS badp,
         event_id % 23 = 0 AS badv, CASE WHEN event_id % 6 = 0 THEN 'unsupported_fact:f' || event_id % 3 END AS f1,
         CASE WHEN event_id % 10 = 0 THEN 'unsupported_fact:z' END AS f2 FROM events),
       r AS (SELECT event_id, concat_ws(',', CASE WHEN NOT safe THEN 'unsafe_output' END, CASE WHEN NOT okt THEN 'invalid_state_transition' END,
         CASE WHEN badp THEN 'inconsistent_profile' END, CASE WHEN badv THEN 'simulator_version_mismatch' END, f1, f2) AS invalid_reasons FROM b)
       SELECT event_id, invalid_reasons, invalid_reasons = '' AS valid FROM r""",
)
def branch_validity(spark, folder):
    e = F.col("event_id")
    facts = F.concat(
        F.when(e % 10 == 0, F.array(F.lit("z"))).otherwise(F.lit([]).cast("array<string>")),
        F.array(F.lit("known")),
        F.when(e % 6 == 0, F.array(F.concat(F.lit("f"), (e % 3).cast("string")))).otherwise(
            F.lit([]).cast("array<string>")
        ),
    )
    df = table(spark, folder, "events").select(
        "event_id",
        (e % 13 != 0).alias("safe"),
        (e % 17 != 0).alias("state_transition_valid"),
        F.when(e % 19 == 0, "x").otherwise("p").alias("profile_hash"),
        F.lit("p").alias("frozen_profile_hash"),
        F.when(e % 23 == 0, "v2").otherwise("v1").alias("simulator_version"),
        F.lit("v1").alias("frozen_simulator_version"),
        facts.alias("asserted_fact_keys"),
        F.array(F.lit("known")).alias("fact_keys"),
    )
    return X.branch_validity(df).select(
        "event_id", F.array_join("invalid_reasons", ",").alias("invalid_reasons"), "valid"
    )


CONTRAST_CTE = """res AS (SELECT user_id || '-' || event_id % 20 AS branch_set_id, event_type AS role, event_id AS branch_index,
  'r' || (event_id // 20) % 4 AS response, round(0.5 * (event_id % 7) / 7.0 + 0.3 * (value / 100) - 0.2 * ((event_id % 5) / 5.0), 9) AS u,
  event_id % 9 <> 0 AND event_id % 8 <> 0 AS ok FROM events),
rk AS (SELECT *, row_number() OVER (PARTITION BY branch_set_id, role ORDER BY u DESC, branch_index) AS a,
  row_number() OVER (PARTITION BY branch_set_id, role ORDER BY u, branch_index DESC) AS z FROM res WHERE ok),
ct AS (SELECT s.branch_set_id, s.role, s.n, b.branch_index AS bi, w.branch_index AS wi, b.response AS br, w.response AS wr, round(b.u - w.u, 9) AS delta
  FROM (SELECT branch_set_id, role, count(*) FILTER (WHERE ok) AS n FROM res GROUP BY 1, 2) s
  LEFT JOIN rk b ON b.branch_set_id = s.branch_set_id AND b.role = s.role AND b.a = 1
  LEFT JOIN rk w ON w.branch_set_id = s.branch_set_id AND w.role = s.role AND w.z = 1),
contrast AS (SELECT *, CASE WHEN n >= 2 AND delta >= 0.1 THEN 'accepted' ELSE 'rejected' END AS status FROM ct)"""


def contrast_rows(spark, folder):
    e = F.col("event_id")
    df = table(spark, folder, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), (e % 20).cast("string")).alias("branch_set_id"),
        F.col("event_type").alias("role"),
        e.alias("branch_index"),
        e.cast("string").alias("branch_id"),
        F.concat(F.lit("r"), F.expr("event_id div 20 % 4").cast("string")).alias("response"),
        ((e % 7) / 7.0).alias("task_gain"),
        (F.col("value") / 100).alias("evidence_gain"),
        ((e % 5) / 5.0).alias("costs"),
        (e % 9 != 0).alias("valid"),
        (e % 8 != 0).alias("safety_admissible"),
    )
    return X.contrasts(df, 0.5, 0.3, 0.2, 0.1)


@query(
    "contrasts",
    f"""WITH {CONTRAST_CTE} SELECT branch_set_id, role, status, CASE WHEN n < 2 THEN 'insufficient_valid_branches' WHEN delta < 0.1
        THEN 'tie_below_pair_margin' ELSE '' END AS reason, CASE WHEN status = 'accepted' THEN CAST(bi AS VARCHAR) END AS chosen_branch_id,
        CASE WHEN status = 'accepted' THEN CAST(wi AS VARCHAR) END AS rejected_branch_id,
        CASE WHEN status = 'accepted' THEN br END AS chosen, CASE WHEN status = 'accepted' THEN wr END AS rejected,
        CASE WHEN status = 'accepted' THEN round(delta, 6) + 0.0 END AS delta_utility FROM contrast""",
)
def contrasts(spark, folder):
    return rounded(contrast_rows(spark, folder))


@query(
    "preference_pairs",
    f"""WITH {CONTRAST_CTE} SELECT 'pair-' || branch_set_id || '-' || role AS pair_id, role, br AS chosen, wr AS rejected,
        branch_set_id || '/' || role AS contrast_id FROM contrast WHERE status = 'accepted' AND br <> wr""",
)
def preference_pairs(spark, folder):
    return X.preference_pairs(contrast_rows(spark, folder))


PAIRS = View(
    "events",
    pair_id="CAST(event_id AS STRING)",
    role="concat('role-', CAST(user_id % 40 AS STRING))",
    split_id="CASE WHEN event_id % 501 = 0 THEN 'dev' ELSE 'evolve' END",
    contrast_id="CASE WHEN event_id % 333 = 1 THEN 'same' ELSE CAST(event_id AS STRING) END",
    chosen="'c'",
    rejected="CASE WHEN event_id % 777 = 5 THEN 'c' ELSE 'r' END",
)

REFUSAL_CTE = f"""p AS ({PAIRS.sql}), refusal AS (
  SELECT role, 'mixed_split_ids' AS reason FROM p GROUP BY 1 HAVING count(DISTINCT split_id) > 1
  UNION ALL SELECT role, 'below_minimum_role_pairs' FROM p GROUP BY 1 HAVING count(*) < 240
  UNION ALL SELECT role, 'duplicate_contrast_id:' || contrast_id FROM p GROUP BY role, contrast_id HAVING count(*) > 1
  UNION ALL SELECT role, 'chosen_equals_rejected:' || pair_id FROM p WHERE chosen = rejected)"""


@query("partition_refusals", f"WITH {REFUSAL_CTE} SELECT * FROM refusal")
def partition_refusals(spark, folder):
    return X.partition_refusals(PAIRS.load(spark, folder), 240)


@query(
    "role_partitions",
    f"""WITH {REFUSAL_CTE} SELECT role, min(split_id) AS split_id, count(*) AS pairs FROM p
        WHERE role NOT IN (SELECT role FROM refusal) GROUP BY 1""",
)
def role_partitions(spark, folder):
    return X.role_partitions(PAIRS.load(spark, folder), 240)


REPLAYS = View(
    "events",
    decoding_hash="'d'",
    policy_id="concat('p', CAST(user_id % 30 AS STRING))",
    profile_hash="event_type",
    seed="event_id % 3",
    simulator_version="'v1'",
    state_hash="CAST(user_id AS STRING)",
    result_hash="CASE WHEN event_id % 400 = 0 THEN 'other' ELSE 'same' END",
)

REPLAY_CTE = f"""o AS ({REPLAYS.sql}), man AS (SELECT sha256('{{"decoding_hash":"' || decoding_hash || '","policy_id":"' || policy_id ||
  '","profile_hash":"' || profile_hash || '","seed":' || seed || ',"simulator_version":"' || simulator_version || '","state_hash":"' ||
  state_hash || '"}}') AS replay_key, count(*) AS replays, min(result_hash) AS result_hash,
  count(DISTINCT result_hash) > 1 AS mismatched FROM o GROUP BY 1)"""


@query("replay_manifest", f"WITH {REPLAY_CTE} SELECT * FROM man")
def replay_manifest(spark, folder):
    return X.replay_manifest(REPLAYS.load(spark, folder))


@query(
    "determinism",
    f"""WITH {REPLAY_CTE} SELECT CAST(sum(replays) AS BIGINT) AS replay_count, count(*) AS key_count,
        count(*) FILTER (WHERE mismatched) AS mismatched_keys FROM man""",
)
def determinism(spark, folder):
    return X.determinism(REPLAYS.load(spark, folder))


BUFFER = View(
    "events",
    event_id="event_id",
    split_id="CASE WHEN event_id % 5 = 0 THEN 'dev' ELSE 'evolve' END",
    role="event_type",
    event_role="CASE WHEN event_id % 7 = 0 THEN 'other' ELSE event_type END",
    offline_state_hash="CAST(user_id AS STRING)",
    pre_state_hash="CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(user_id AS STRING) END",
)


@query(
    "guarded_append",
    f"""SELECT event_id, CASE WHEN offline_state_hash <> pre_state_hash THEN 'state_not_its_own' WHEN role <> event_role
        THEN 'role_disagrees' WHEN split_id <> 'evolve' THEN 'other_split' ELSE '' END AS reason FROM ({BUFFER.sql})""",
)
def guarded_append(spark, folder):
    return X.guarded_append(BUFFER.load(spark, folder), "evolve").select("event_id", "reason")
