"""Governance over ``conversations``, ``events``, ``orders`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions.hashing import canonical_hash as hash_expr
from ...functions.segments import scan_by_depth
from ...operators import governance as G
from .base import View, query, table
from .mining_queries import DIGEST_SQL

TURN_JSON = "CAST(to_json({{'role': role, 'text': text, 'turn': {turn}}}) AS VARCHAR)"


@query(
    "canonical_hash",
    f"SELECT conv_id, turn, sha256({TURN_JSON.format(turn='turn')}) AS hash FROM conversations",
)
def canonical_hash(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        hash_expr(turn=F.col("turn"), text=F.col("text"), role=F.col("role")).alias("hash"),
    )


@query(
    "redact",
    """SELECT conv_id, turn, sha256(CAST(to_json(text) AS VARCHAR)) AS completion, sha256(CAST(to_json(role) AS VARCHAR)) AS memory,
       false AS raw_text_opt_in FROM conversations""",
)
def redact(spark, folder):
    df = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("completion"), F.col("role").alias("memory")
    )
    return G.redact(df)


@query(
    "pseudonymize",
    """SELECT turn, role, 'participant-' || sha256('{"participant_id":"' || conv_id || '"}') AS participant_ref
       FROM conversations""",
)
def pseudonymize(spark, folder):
    df = table(spark, folder, "conversations").select("turn", "role", F.col("conv_id").alias("participant_id"))
    return G.pseudonymize(df)


@query(
    "audit_release",
    """WITH r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS who, CASE WHEN event_id % 3 = 0 THEN sha256(props) ELSE props END AS completion,
         event_type FROM events), known AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS v FROM events WHERE user_id % 2 = 0)
       SELECT 'label_key' AS kind, 'payload.facts.labels' AS path, sha256('labels') AS detail_hash, count(*) AS rows FROM r
       UNION ALL SELECT 'label_key', 'payload.extra', sha256('phq8_score'), count(*) FROM r WHERE event_id % 5 = 0
       UNION ALL SELECT 'sensitive_text', 'payload.facts.completion', sha256(completion), count(*) FROM r WHERE event_id % 3 <> 0 GROUP BY completion
       UNION ALL SELECT 'participant_id', 'payload.who', sha256(who), count(*) FROM r WHERE who IN (SELECT v FROM known) GROUP BY who
       UNION ALL SELECT 'participant_id', 'payload.list', sha256(who), count(*) FROM r WHERE who IN (SELECT v FROM known) AND event_id % 7 = 0 GROUP BY who""",
)
def audit_release(spark, folder):
    e = table(spark, folder, "events")
    who = F.col("user_id").cast("string")
    df = e.select(
        who.alias("who"),
        F.when(F.col("event_id") % 7 == 0, F.array(F.lit("no one"), who)).alias("list"),
        F.struct(
            F.lit(1).alias("labels"),
            F.when(F.col("event_id") % 3 == 0, F.sha2("props", 256)).otherwise(F.col("props")).alias("completion"),
        ).alias("facts"),
        F.when(
            F.col("event_id") % 5 == 0, F.create_map(F.lit("phq8_score"), F.lit("x"))
        ).alias("extra"),
    )
    known = e.filter("user_id % 2 = 0").select(who.alias("participant_id"))
    return G.audit_release(df, known, K.RUNTIME_SENSITIVE_FIELDS)


@query(
    "label_leaks",
    """SELECT 'labels' AS key, count(*) AS rows FROM events WHERE event_id % 6 = 0
       UNION ALL SELECT 'symptom_level', count(*) FROM events WHERE event_id % 4 = 0""",
)
def label_leaks(spark, folder):
    e = F.col("event_id")
    keys = F.array(
        F.when(e % 6 == 0, "labels").otherwise("a"), F.when(e % 4 == 0, "symptom_level").otherwise("b")
    )
    df = table(spark, folder, "events").select(
        F.map_from_arrays(keys, F.array(F.lit("1"), F.lit("2"))).alias("payload")
    )
    return G.map_label_leaks(df, "payload")


MEMBERS_SQL = """SELECT CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split_id, conv_id AS session_id FROM conversations GROUP BY conv_id
 UNION ALL SELECT 'dev', conv_id FROM conversations GROUP BY conv_id HAVING max(turn) > 6
 UNION ALL SELECT 'train', conv_id FROM conversations GROUP BY conv_id HAVING max(turn) > 5 AND conv_id % 3 = 0"""


def members(spark, folder):
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    i = F.col("conv_id")
    own = F.when(i % 3 == 0, "train").when(i % 3 == 1, "dev").otherwise("test")

    def part(rows, split):
        return rows.select(split.alias("split_id"), i.alias("session_id"))

    return (
        part(c, own)
        .unionByName(part(c.filter("turn > 6"), F.lit("dev")))
        .unionByName(part(c.filter("turn > 5 AND conv_id % 3 = 0"), F.lit("train")))
    )


@query(
    "split_overlaps",
    f"""WITH m AS ({MEMBERS_SQL}) SELECT 'shared_participant' AS violation, CAST(NULL AS VARCHAR) AS split_id, session_id FROM m
          GROUP BY session_id HAVING count(DISTINCT split_id) > 1
        UNION ALL SELECT 'repeated_participant', split_id, session_id FROM m GROUP BY 2, 3 HAVING count(*) > 1
        UNION ALL SELECT 'empty_split', 'external', NULL""",
)
def split_overlaps(spark, folder):
    splits = spark.createDataFrame([("train",), ("dev",), ("test",), ("external",)], "split_id string")
    return G.split_overlaps(members(spark, folder), splits)


USES = [u for uses in K.PERMITTED_USES.values() for u in uses][:10]

REQUESTS = View(
    "events",
    event_id="event_id",
    split_id="concat('s', CAST(user_id % 7 AS STRING))",
    use=(
        "CASE event_id % 6 WHEN 0 THEN 'collection' WHEN 1 THEN 'pairs' WHEN 2 THEN 'regression' "
        "WHEN 3 THEN 'final_claim' WHEN 4 THEN 'retrieval_index' ELSE 'other' END"
    ),
    actor="event_type",
)

KINDS = ["evolve", "development", "final-test", "external"]


@query(
    "authorize_uses",
    f"""WITH r AS ({REQUESTS.sql}), s(split_id, kind, authorized) AS (VALUES {", ".join(
        f"('s{i}', '{KINDS[i % 4]}', {str(i != 4).lower()})" for i in range(6))}),
        p(kind, use) AS (VALUES {", ".join(f"('{k}', '{u}')" for k, us in K.PERMITTED_USES.items() for u in us)}),
        d AS (SELECT event_id, s.kind, CASE WHEN s.kind IS NULL THEN 'unknown_split' WHEN NOT authorized THEN 'unauthorized_split'
          WHEN p.use IS NULL THEN 'forbidden_use' ELSE '' END AS denial FROM r LEFT JOIN s ON s.split_id = r.split_id
          LEFT JOIN p ON p.kind = s.kind AND p.use = r.use)
        SELECT event_id, denial, denial = '' AND coalesce(kind, '') = 'final-test' AS logged FROM d""",
)
def authorize_uses(spark, folder):
    splits = spark.createDataFrame(
        [(f"s{i}", KINDS[i % 4], i != 4) for i in range(6)], "split_id string, kind string, authorized boolean"
    )
    out = G.authorize_uses(REQUESTS.load(spark, folder), splits)
    return out.select("event_id", "denial", F.coalesce("logged", F.lit(False)).alias("logged"))


def manifest_sql(source: str) -> str:
    digest = DIGEST_SQL.format(x="CAST(session_id AS VARCHAR)")
    return (
        "SELECT split_id, kind, count(*) AS participants, sha256('{\"kind\":\"' || kind || '\",\"participants\":\"' || "
        + digest
        + " || '\",\"split_id\":\"' || split_id || '\"}') AS manifest_hash FROM "
        + source
        + " GROUP BY 1, 2"
    )


@query(
    "manifest_hash",
    f"""WITH m AS (SELECT *, 'evolve' AS kind FROM ({MEMBERS_SQL})) {manifest_sql('m')}""",
)
def manifest_hash(spark, folder):
    return G.manifest_hash(members(spark, folder).withColumn("kind", F.lit("evolve")))


@query(
    "reusable",
    f"""WITH m AS (SELECT *, 'evolve' AS kind FROM ({MEMBERS_SQL})),
        n AS (SELECT * FROM m WHERE NOT (split_id = 'test' AND session_id = 2)),
        a AS ({manifest_sql('m')}), b AS ({manifest_sql('n')})
        SELECT a.split_id, a.manifest_hash = b.manifest_hash AS reusable FROM a JOIN b ON a.split_id = b.split_id""",
)
def reusable(spark, folder):
    m = members(spark, folder).withColumn("kind", F.lit("evolve"))
    other = m.repartition(3, "session_id").filter("NOT (split_id = 'test' AND session_id = 2)")
    return G.reusable(G.manifest_hash(m), G.manifest_hash(other))


@query(
    "case_projection",
    """WITH t AS (SELECT DISTINCT user_id, event_type FROM events)
       SELECT 'case-' || user_id AS case_id, string_agg(event_type || '=slot-' || event_type, ',' ORDER BY event_type) AS evidence_index,
         count(*) AS topics FROM t GROUP BY 1""",
)
def case_projection(spark, folder):
    states = (
        table(spark, folder, "events")
        .select("user_id", "event_type")
        .distinct()
        .select(
            F.concat(F.lit("case-"), F.col("user_id").cast("string")).alias("case_id"),
            F.col("event_type").alias("topic_id"),
            F.array(F.concat(F.lit("slot-"), F.col("event_type"))).alias("slot_ids"),
        )
    )
    entry = F.transform(
        F.map_entries("evidence_index"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))
    )
    return G.case_projection(states).select("case_id", F.array_join(entry, ",").alias("evidence_index"), "topics")


@query(
    "governed_read",
    """SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'unknown_memory' WHEN event_id % 4 = 0 THEN 'case_mismatch'
         WHEN event_type NOT IN ('view', 'click') THEN 'role_not_permitted'
         WHEN user_id % 3 > 0 AND ts >= TIMESTAMP '2024-01-15' THEN 'expired' ELSE '' END AS denial FROM events""",
)
def governed_read(spark, folder):
    e = table(spark, folder, "events")
    user = F.col("user_id")
    case = F.concat(F.lit("case-"), user.cast("string"))
    requests = e.select(
        "event_id",
        user.alias("memory_id"),
        F.when(F.col("event_id") % 4 == 0, "other").otherwise(case).alias("case_id"),
        F.col("event_type").alias("role"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    memories = e.filter("user_id % 10 <> 9").select(
        user.alias("memory_id"),
        case.alias("memory_case_id"),
        F.array(F.lit("view"), F.lit("click")).alias("allowed_roles"),
        F.when(user % 3 > 0, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("expires_at"),
    ).distinct()
    return G.governed_read(requests, memories).select("event_id", "denial")


LOG_CTE = """n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
lg AS (SELECT user_id AS case_id, k AS decision_index, CASE event_type WHEN 'view' THEN 'interviewer' WHEN 'click' THEN 'scorer'
  WHEN 'purchase' THEN 'evaluator' WHEN 'signup' THEN 'updater' ELSE 'reporter' END AS role, 'a' || event_id AS action_id,
  CASE WHEN event_id % 19 = 0 THEN 'a0' ELSE 'a' || event_id END AS output_action_id,
  k * 2 - CASE WHEN event_id % 23 = 0 THEN 3 ELSE 0 END AS revision, CASE WHEN k < 2 THEN NULL ELSE (k // 5) % 4 END AS score,
  CASE WHEN event_id % 29 = 0 THEN 'broken' ELSE 'h' || k END AS pre_state_hash, 'h' || (k + 1) AS post_state_hash FROM n)"""


def decision_log(spark, folder):
    k, e = F.col("k"), F.col("event_id")
    events, keys = table(spark, folder, "events"), ["user_id"]
    numbered = scan_by_depth(events, keys, ["ts", "event_id"], index="k")
    roles = {"view": "interviewer", "click": "scorer", "purchase": "evaluator", "signup": "updater"}
    role = F.lit("reporter")
    for kind, name in roles.items():
        role = F.when(F.col("event_type") == kind, name).otherwise(role)
    action = F.concat(F.lit("a"), e.cast("string"))
    return numbered.select(
        F.col("user_id").alias("case_id"),
        k.alias("decision_index"),
        role.alias("role"),
        action.alias("action_id"),
        F.when(e % 19 == 0, "a0").otherwise(action).alias("output_action_id"),
        (k * 2 - F.when(e % 23 == 0, 3).otherwise(0)).alias("revision"),
        F.when(k >= 2, F.floor(k / 5) % 4).alias("score"),
        F.when(e % 29 == 0, "broken").otherwise(F.concat(F.lit("h"), k.cast("string"))).alias("pre_state_hash"),
        F.concat(F.lit("h"), (k + 1).cast("string")).alias("post_state_hash"),
    )


@query(
    "event_violations",
    f"""WITH {LOG_CTE}, p AS (SELECT *, lag(revision) OVER w AS pr, lag(score) OVER w AS ps, lag(post_state_hash) OVER w AS ph FROM lg
          WINDOW w AS (PARTITION BY case_id ORDER BY decision_index))
        SELECT case_id, decision_index, 'role_may_not_emit' AS violation FROM p WHERE role = 'reporter'
        UNION ALL SELECT case_id, decision_index, 'output_of_other_action' FROM p WHERE action_id <> output_action_id
        UNION ALL SELECT case_id, decision_index, 'revision_not_rising' FROM p WHERE revision <= pr
        UNION ALL SELECT case_id, decision_index, 'unauthorized_score_revision' FROM p WHERE ps IS NOT NULL AND ps IS DISTINCT FROM score AND role <> 'updater'
        UNION ALL SELECT case_id, decision_index, 'broken_state_chain' FROM p WHERE pre_state_hash <> ph""",
)
def event_violations(spark, folder):
    return G.event_violations(decision_log(spark, folder), K.DECISION_ROLES, K.SCORE_REVISING_ROLES)


@query(
    "state_diff",
    f"""WITH {LOG_CTE}, s AS (SELECT case_id, decision_index AS position, decision_index * 2 AS revision, 't' || (decision_index // 3) AS topic,
          decision_index % 4 AS a, decision_index // 2 AS b FROM lg),
        p AS (SELECT *, lag(revision) OVER w AS pr, lag(topic) OVER w AS pt, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM s
          WINDOW w AS (PARTITION BY case_id ORDER BY position))
        SELECT case_id, position, pr AS revision_from, revision AS revision_to, CASE WHEN topic <> pt THEN topic END AS current_topic_id,
          concat_ws(',', CASE WHEN a <> pa THEN 'a=' || a END, CASE WHEN b <> pb THEN 'b=' || b END) AS topics FROM p WHERE pr IS NOT NULL""",
)
def state_diff(spark, folder):
    k = F.col("decision_index")

    def topic(score):
        return F.struct(F.lit("open").alias("status"), score.alias("proposed_score"), F.lit(0).alias("revision"))

    states = decision_log(spark, folder).select(
        "case_id",
        k.alias("position"),
        (k * 2).alias("revision"),
        F.concat(F.lit("t"), F.floor(k / 3).cast("string")).alias("current_topic_id"),
        F.array(F.lit("turn-0")).alias("turn_ids"),
        F.create_map(
            F.lit("a"), topic((k % 4).cast("long")), F.lit("b"), topic(F.floor(k / 2).cast("long"))
        ).alias("topics"),
    )
    shown = F.transform(
        F.map_entries("topics"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["proposed_score"].cast("string"))
    )
    return G.state_diff(states).select(
        "case_id",
        "position",
        "revision_from",
        "revision_to",
        "current_topic_id",
        F.array_join(F.array_sort(shown), ",").alias("topics"),
    )


@query(
    "evidence_violations",
    """SELECT event_id AS topic_id, 'known_slot_without_source' AS violation FROM events WHERE event_id % 5 = 0
       UNION ALL SELECT event_id, 'basis_cites_unknown_slot' FROM events WHERE event_id % 7 = 0 AND event_id % 11 <> 0
       UNION ALL SELECT event_id, 'score_without_basis' FROM events WHERE event_id % 11 = 0 AND event_id % 3 <> 0""",
)
def evidence_violations(spark, folder):
    e = F.col("event_id")
    turns = F.when(e % 5 == 0, F.lit([]).cast("array<string>")).otherwise(F.array(F.lit("turn-1")))
    slots = F.array(
        F.struct(F.lit("s1").alias("slot_id"), F.lit("known").alias("status"), turns.alias("source_turn_ids")),
        F.struct(
            F.lit("s2").alias("slot_id"), F.lit("missing").alias("status"), F.lit([]).cast("array<string>").alias("source_turn_ids")
        ),
    )
    basis = F.when(e % 11 == 0, F.lit([]).cast("array<string>")).otherwise(
        F.array(F.lit("s1"), F.when(e % 7 == 0, "s9").otherwise("s2"))
    )
    df = table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"),
        e.alias("topic_id"),
        slots.alias("slots"),
        F.when(e % 3 != 0, e % 4).alias("proposed_score"),
        basis.alias("score_basis_slot_ids"),
    )
    return G.evidence_violations(df).select("topic_id", "violation")


METRICS_SQL = """m AS (SELECT user_id AS candidate_id, event_type AS role, min(event_id) % 2 = 0 AS updated, avg(value) - 20 AS d,
  max(event_id) % 9 = 0 AS unsafe, max(event_id) % 4 > 0 AS ni FROM events GROUP BY 1, 2),
c AS (SELECT DISTINCT user_id AS candidate_id FROM events)"""


@query(
    "policy_regression",
    f"""WITH {METRICS_SQL} SELECT candidate_id, 'manifest_check_failed' AS reason FROM c WHERE candidate_id % 5 = 0
        UNION ALL SELECT candidate_id, 'leakage_check_failed' FROM c WHERE candidate_id % 7 = 0
        UNION ALL SELECT candidate_id, 'parameter_diff_failed' FROM c WHERE candidate_id % 11 = 0
        UNION ALL SELECT candidate_id, 'safety_regression:' || role FROM m WHERE unsafe
        UNION ALL SELECT candidate_id, 'non_inferiority_failed:' || role FROM m WHERE NOT updated AND NOT ni
        UNION ALL SELECT candidate_id, 'no_quality_gain:' || role FROM m WHERE updated AND d <= 0""",
)
def policy_regression(spark, folder):
    e = table(spark, folder, "events")
    metrics = e.groupBy(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("role")).agg(
        (F.min("event_id") % 2 == 0).alias("updated"),
        (F.avg("value") - 20).alias("quality_delta"),
        (F.max("event_id") % 9 == 0).alias("safety_regression"),
        (F.max("event_id") % 4 > 0).alias("non_inferiority_met"),
    )
    u = F.col("user_id")
    candidates = e.select(
        u.alias("candidate_id"),
        (u % 5 != 0).alias("manifest_checks_passed"),
        (u % 7 != 0).alias("leakage_checks_passed"),
        (u % 11 != 0).alias("parameter_diff_ok"),
    ).distinct()
    return G.policy_regression(candidates, metrics)


@query(
    "unpaired_runs",
    """SELECT event_id AS participant_id, user_id % 3 AS seed, 'candidate' AS side FROM events WHERE event_id % 41 = 0
       UNION ALL SELECT event_id, user_id % 3, 'baseline' FROM events WHERE event_id % 43 = 0 AND event_id % 41 <> 0""",
)
def unpaired_runs(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("event_id").alias("participant_id"), (F.col("user_id") % 3).alias("seed")
    )
    candidate = e.filter("participant_id % 43 <> 0 OR participant_id % 41 = 0")
    return G.unpaired_runs(candidate, e.filter("participant_id % 41 <> 0"))


@query(
    "manifest_diff",
    """WITH s AS (SELECT user_id AS p, event_type AS role, min(event_id) AS k FROM events GROUP BY 1, 2),
         a AS (SELECT p, role, 'base' AS base, 'w' AS w FROM s),
         b AS (SELECT p, CASE WHEN k % 31 = 0 THEN 'new' ELSE role END AS role, CASE WHEN p % 13 = 0 THEN 'base2' ELSE 'base' END AS base,
           CASE WHEN role = 'view' AND p % 4 > 0 OR k % 17 = 0 THEN 'w2' ELSE 'w' END AS w FROM s),
         j AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.role, b.role) AS role, a.base AS ba, b.base AS bb, a.w AS wa, b.w AS wb
           FROM a FULL OUTER JOIN b ON a.p = b.p AND a.role = b.role),
         g AS (SELECT p, coalesce(bool_or(ba <> bb), false) AS base, bool_or(wa IS NULL OR wb IS NULL) AS roles,
           coalesce(bool_or(role = 'view' AND wa IS NOT NULL AND wb IS NOT NULL), false) AS declared,
           coalesce(bool_or(role = 'view' AND wa = wb), false) AS same FROM j GROUP BY 1)
       SELECT p AS policy_id, 'base_model_hash_changed' AS reason FROM g WHERE base
       UNION ALL SELECT p, 'adapter_roles_changed' FROM g WHERE roles
       UNION ALL SELECT p, 'updated_role_missing:view' FROM g WHERE NOT declared
       UNION ALL SELECT p, 'updated_adapter_unchanged:view' FROM g WHERE same
       UNION ALL SELECT p, 'unexpected_adapter_change:' || role FROM j WHERE role <> 'view' AND wa <> wb""",
)
def manifest_diff(spark, folder):
    s = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("policy_id"), F.col("event_type").alias("role"))
        .agg(F.min("event_id").alias("k"))
    )
    p, k, role = F.col("policy_id"), F.col("k"), F.col("role")
    parents = s.select("policy_id", "role", F.lit("base").alias("base_model_hash"), F.lit("w").alias("adapter_hash"))
    candidates = s.select(
        "policy_id",
        F.when(k % 31 == 0, "new").otherwise(role).alias("role"),
        F.when(p % 13 == 0, "base2").otherwise("base").alias("base_model_hash"),
        F.when(((role == "view") & (p % 4 > 0)) | (k % 17 == 0), "w2").otherwise("w").alias("adapter_hash"),
    )
    updates = s.select("policy_id", F.lit("view").alias("updated_role")).distinct()
    return G.manifest_diff(parents, candidates, updates)
