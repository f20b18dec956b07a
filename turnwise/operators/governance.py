"""Redaction, leak audits, splits, governed reads and event audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.hashing import canonical_hash, hash_value, set_digest
from ..functions.segments import SEGMENT_ROWS, position_segment, scan
from .paired import reasons


def redact(
    df: DataFrame, fields: Sequence[str] = tuple(K.RUNTIME_SENSITIVE_FIELDS), allow_raw_text: bool = False
) -> DataFrame:
    """Replace sensitive columns by hashes and record whether raw text was allowed."""
    if not allow_raw_text:
        df = df.withColumns({f: hash_value(F.col(f)) for f in fields if f in df.columns})
    return df.withColumn("raw_text_opt_in", F.lit(allow_raw_text))


def pseudonym(participant: Column) -> Column:
    """A stable one-way name that still joins."""
    return F.concat(
        F.lit("participant-"), canonical_hash(participant_id=participant.cast("string"))
    )


def pseudonymize(df: DataFrame, column: str = "participant_id") -> DataFrame:
    return df.withColumn("participant_ref", pseudonym(F.col(column))).drop(column)


def _leaves(field_type: T.DataType, path: str, column: Column, key: str):
    """(key, path, column) of every field; string values of arrays come as arrays."""
    yield key, path, column, field_type
    inner = field_type
    depth = ""
    while isinstance(inner, T.ArrayType):
        inner, depth = inner.elementType, depth + "[]"
    if isinstance(inner, T.StructType):
        for f in inner.fields:
            yield from _leaves(
                T.ArrayType(f.dataType) if depth else f.dataType,
                f"{path}{depth}.{f.name}",
                column[f.name],
                f.name,
            )


def _fields(df: DataFrame):
    for f in df.schema.fields:
        yield from _leaves(f.dataType, f"payload.{f.name}", F.col(f"`{f.name}`"), f.name)


def label_leaks(df: DataFrame) -> list[str]:
    """Paths of the schema whose name is a label key (map keys: see ``audit_release``)."""
    return [path for key, path, _, _ in _fields(df) if key in K.FORBIDDEN_LABEL_KEYS]


def map_label_leaks(df: DataFrame, column: str) -> DataFrame:
    """Label keys inside a map column, with the number of rows that carry them."""
    leaked = F.array_intersect(F.map_keys(column), F.lit(K.FORBIDDEN_LABEL_KEYS))
    return (
        df.select(F.explode(leaked).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    )


def audit_release(
    df: DataFrame, participant_ids: DataFrame, sensitive_fields: Sequence[str]
) -> DataFrame:
    """Label keys, known participant ids and raw sensitive text in a release table.

    The schema decides which expressions to build; the values are then checked in one
    pass and one join with ``participant_ids(participant_id)``. Findings give the path, the
    hash of the value and the number of rows, never the value itself.
    """
    keys, values = [], []
    for key, path, column, kind in _fields(df):
        name = F.lit(path)
        if key in K.FORBIDDEN_LABEL_KEYS:
            keys.append(F.struct(F.lit("label_key").alias("kind"), name.alias("path"), F.lit(key).alias("v")))
        if isinstance(kind, T.MapType):
            leaked = F.array_intersect(F.map_keys(column), F.lit(K.FORBIDDEN_LABEL_KEYS))
            values.append(_found("label_key", name, leaked))
            values.append(_found("value", name, F.transform(F.map_values(column), lambda v: v.cast("string"))))
        texts = None
        if isinstance(kind, T.StringType):
            texts = F.array(column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            texts = column
        if texts is not None:
            values.append(_found("value", name, texts))
        if key in sensitive_fields:
            raw = texts if texts is not None else F.array(column.cast("string"))
            raw = F.filter(raw, lambda v: ~F.coalesce(v.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)))
            values.append(_found("sensitive_text", name, raw))
    empty = df.select(F.lit("").alias("kind"), F.lit("").alias("path"), F.lit("").alias("v")).limit(0)
    rows = df.select(F.explode(F.concat(*values)).alias("f")).select("f.*") if values else empty
    known = participant_ids.select(F.col("participant_id").cast("string").alias("v")).distinct()
    ids = rows.filter("kind = 'value'").join(known, "v", "left_semi").select(
        F.lit("participant_id").alias("kind"), "path", "v"
    )
    found = rows.filter("kind <> 'value'").unionByName(ids)
    counted = found.groupBy("kind", "path", F.sha2("v", 256).alias("detail_hash")).agg(
        F.count("*").alias("rows")
    )
    if keys:
        n = df.agg(F.count("*").alias("rows"))
        schema_rows = n.select("rows", F.explode(F.array(*keys)).alias("f")).select(
            "f.kind", "f.path", F.sha2("f.v", 256).alias("detail_hash"), "rows"
        )
        counted = counted.unionByName(schema_rows)
    return counted


def _found(kind: str, path: Column, texts: Column) -> Column:
    made = F.transform(
        texts, lambda v: F.struct(F.lit(kind).alias("kind"), path.alias("path"), v.alias("v"))
    )
    return F.coalesce(made, F.lit([]).cast("array<struct<kind:string,path:string,v:string>>"))


# --- splits -----------------------------------------------------------------------


def split_overlaps(members: DataFrame, splits: DataFrame) -> DataFrame:
    """``(violation, split_id, session_id)`` of shared, repeated and empty splits."""
    shared = (
        members.groupBy("session_id")
        .agg(F.min("split_id").alias("lo"), F.max("split_id").alias("hi"))
        .filter("lo <> hi")
        .select(F.lit("shared_participant").alias("violation"), F.lit(None).cast("string").alias("split_id"), "session_id")
    )
    repeated = (
        members.groupBy("split_id", "session_id").agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.lit("repeated_participant").alias("violation"), "split_id", "session_id")
    )
    kind = dict(members.dtypes)["session_id"]
    empty = splits.join(members, "split_id", "left_anti").select(
        F.lit("empty_split").alias("violation"), "split_id", F.lit(None).cast(kind).alias("session_id")
    )
    return shared.unionByName(repeated).unionByName(empty)


def authorize_uses(requests: DataFrame, splits: DataFrame) -> DataFrame:
    """Verdict per ``(split_id, use, actor)`` request; ``logged`` marks final-test access."""
    matrix = F.create_map(
        *(x for kind, uses in K.PERMITTED_USES.items() for x in (F.lit(kind), F.lit(uses)))
    )
    permitted = F.coalesce(F.array_contains(F.element_at(matrix, F.col("kind")), F.col("use")), F.lit(False))
    cause = (
        F.when(F.col("kind").isNull(), "unknown_split")
        .when(~F.col("authorized"), "unauthorized_split")
        .when(~permitted, "forbidden_use")
        .otherwise("")
    )
    return (
        requests.join(splits.select("split_id", "kind", "authorized"), "split_id", "left")
        .withColumn("denial", cause)
        .withColumn("logged", (F.col("denial") == "") & (F.col("kind") == "final-test"))
    )


def manifest_hash(members: DataFrame) -> DataFrame:
    """Per (split_id, kind) a hash of the id set, whatever the order of the rows.

    Ids are digested by sums of their hashes, so a split of any size is hashed by partial
    aggregates and never listed in one row.
    """
    stats = members.groupBy("split_id", "kind").agg(*set_digest(F.col("session_id").cast("string")))
    digest = F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")))
    return stats.select(
        "split_id",
        "kind",
        F.col("n").alias("participants"),
        canonical_hash(kind=F.col("kind"), participants=digest, split_id=F.col("split_id")).alias("manifest_hash"),
    )


def reusable(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which cached manifests equal the wanted ones, by ``split_id``."""
    return cached.select("split_id", F.col("manifest_hash").alias("cached")).join(
        wanted.select("split_id", F.col("manifest_hash").alias("wanted")), "split_id", "full_outer"
    ).select("split_id", F.coalesce(F.col("cached") == F.col("wanted"), F.lit(False)).alias("reusable"))


# --- governed reads ------------------------------------------------------------------


def case_projection(topic_states: DataFrame) -> DataFrame:
    """Label-free memory of a case: slot ids per topic (a case has a handful of topics)."""
    leaks = label_leaks(topic_states)
    if leaks:
        raise ValueError(f"topic states carry labels: {leaks}")
    return topic_states.groupBy("case_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("topic_id", "slot_ids")))
        ).alias("evidence_index"),
        F.count("*").alias("topics"),
    )


def governed_read(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """First cause of denial per request, or an empty text for a permitted read.

    ``requests`` is ``(request_id, memory_id, case_id, role, at)``; ``memories`` ``(memory_id,
    memory_case_id, allowed_roles, expires_at)``.
    """
    cause = (
        F.when(F.col("memory_case_id").isNull(), "unknown_memory")
        .when(F.col("case_id") != F.col("memory_case_id"), "case_mismatch")
        .when(~F.array_contains("allowed_roles", F.col("role")), "role_not_permitted")
        .when(F.col("expires_at").isNotNull() & (F.col("at") >= F.col("expires_at")), "expired")
        .otherwise("")
    )
    return requests.join(memories, "memory_id", "left").withColumn("denial", cause)


# --- decision events -------------------------------------------------------------------


def event_violations(
    events: DataFrame,
    decision_roles: Sequence[str],
    revising_roles: Sequence[str] = ("updater",),
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Rule breaks of a decision log, one row per (case, decision, violation).

    ``events`` is ``(case_id, decision_index, role, action_id, output_action_id, revision,
    score, pre_state_hash, post_state_hash)``, ``score`` the proposed score after the event.
    """
    before = scan(
        events,
        ["case_id"],
        ["decision_index"],
        position_segment("decision_index", segment_rows),
        lags={"__prev": F.struct("revision", "score", "post_state_hash")},
    )
    prev = F.col("__prev")
    found = reasons(
        (~F.col("role").isin(list(decision_roles)), "role_may_not_emit"),
        (F.col("action_id") != F.col("output_action_id"), "output_of_other_action"),
        (F.col("revision") <= prev["revision"], "revision_not_rising"),
        (
            prev["score"].isNotNull()
            & ~prev["score"].eqNullSafe(F.col("score"))
            & ~F.col("role").isin(list(revising_roles)),
            "unauthorized_score_revision",
        ),
        (F.col("pre_state_hash") != prev["post_state_hash"], "broken_state_chain"),
    )
    return before.select("case_id", "decision_index", F.explode(found).alias("violation"))


def state_diff(states: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Minimal patch from each state to the next of its case.

    ``states`` is ``(case_id, revision, position, current_topic_id, turn_ids, topics)`` with
    ``topics map<topic, struct<status, proposed_score, revision>>``.
    """
    columns = ["revision", "current_topic_id", "turn_ids"]
    # Maps do not compare; entries do. The lagged row keeps them as an array.
    df = scan(
        states,
        ["case_id"],
        ["position"],
        position_segment("position", segment_rows),
        lags={"__prev": F.struct(*columns, F.map_entries("topics").alias("entries"))},
    ).filter(F.col("__prev").isNotNull())
    old = F.col("__prev")
    changed = F.filter(
        F.map_entries("topics"), lambda e: ~F.array_contains(old["entries"], e)
    )

    def patch(name: str) -> Column:
        return F.when(~F.col(name).eqNullSafe(old[name]), F.col(name))

    return df.select(
        "case_id",
        "position",
        old["revision"].alias("revision_from"),
        F.col("revision").alias("revision_to"),
        F.map_from_entries(changed).alias("topics"),
        patch("current_topic_id").alias("current_topic_id"),
        patch("turn_ids").alias("turn_ids"),
    )


def evidence_violations(topics: DataFrame) -> DataFrame:
    """Topic states that break evidence rules.

    ``topics`` is ``(case_id, topic_id, slots array<struct<slot_id, status,
    source_turn_ids>>, proposed_score, score_basis_slot_ids)``.
    """
    unsourced = F.exists(
        "slots", lambda s: (s["status"] == "known") & (F.coalesce(F.size(s["source_turn_ids"]), F.lit(0)) == 0)
    )
    unknown = F.size(F.array_except("score_basis_slot_ids", F.col("slots.slot_id"))) > 0
    unfounded = F.col("proposed_score").isNotNull() & (F.size("score_basis_slot_ids") == 0)
    found = reasons(
        (unsourced, "known_slot_without_source"),
        (unknown, "basis_cites_unknown_slot"),
        (unfounded, "score_without_basis"),
    )
    return topics.select("case_id", "topic_id", F.explode(found).alias("violation"))


# --- policies ------------------------------------------------------------------------------


def policy_regression(candidates: DataFrame, role_metrics: DataFrame) -> DataFrame:
    """``(candidate_id, reason)`` rows against promotion.

    ``candidates`` has the three check flags; ``role_metrics`` is ``(candidate_id, role,
    updated, quality_delta, safety_regression, non_inferiority_met)``.
    """
    checks = candidates.select(
        "candidate_id",
        F.explode(
            reasons(
                (~F.col("manifest_checks_passed"), "manifest_check_failed"),
                (~F.col("leakage_checks_passed"), "leakage_check_failed"),
                (~F.col("parameter_diff_ok"), "parameter_diff_failed"),
            )
        ).alias("reason"),
    )

    def named(text: str) -> Column:
        return F.concat(F.lit(text + ":"), F.col("role"))

    metrics = role_metrics.select(
        "candidate_id",
        F.explode(
            reasons(
                (F.col("safety_regression"), named("safety_regression")),
                (~F.col("updated") & ~F.col("non_inferiority_met"), named("non_inferiority_failed")),
                (F.col("updated") & (F.col("quality_delta") <= 0), named("no_quality_gain")),
            )
        ).alias("reason"),
    )
    bare = candidates.join(role_metrics, "candidate_id", "left_anti").select(
        "candidate_id", F.lit("no_role_metric").alias("reason")
    )
    return checks.unionByName(metrics).unionByName(bare)


def unpaired_runs(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(seed, participant) rows that only one side of a paired regression has."""
    keys = ["seed", "participant_id"]
    only_a = candidate.join(baseline, keys, "left_anti").select(*keys, F.lit("candidate").alias("side"))
    only_b = baseline.join(candidate, keys, "left_anti").select(*keys, F.lit("baseline").alias("side"))
    return only_a.unionByName(only_b)


def manifest_diff(parents: DataFrame, candidates: DataFrame, updates: DataFrame) -> DataFrame:
    """Whether exactly the declared role's adapter changed, per policy.

    ``parents`` and ``candidates`` are ``(policy_id, base_model_hash, role, adapter_hash)``, one
    row per role; ``updates`` is ``(policy_id, updated_role)``.
    """

    def side(df: DataFrame, n: str) -> DataFrame:
        return df.select(
            "policy_id", "role", F.col("base_model_hash").alias(f"base_{n}"), F.col("adapter_hash").alias(f"adapter_{n}")
        )

    joined = side(parents, "a").join(side(candidates, "b"), ["policy_id", "role"], "full_outer").join(
        updates, "policy_id"
    )
    both = F.col("adapter_a").isNotNull() & F.col("adapter_b").isNotNull()
    mine = F.col("role") == F.col("updated_role")
    equal = F.col("adapter_a") == F.col("adapter_b")
    whole = joined.groupBy("policy_id", "updated_role").agg(
        F.bool_or(F.col("base_a") != F.col("base_b")).alias("base"),
        F.bool_or(~both).alias("roles"),
        F.coalesce(F.bool_or(mine & both), F.lit(False)).alias("declared"),
        F.coalesce(F.bool_or(mine & both & equal), F.lit(False)).alias("unchanged"),
    )

    def about(text: str) -> Column:
        return F.concat(F.lit(text + ":"), F.col("updated_role"))

    summary = whole.select(
        "policy_id",
        F.explode(
            reasons(
                (F.coalesce("base", F.lit(False)), "base_model_hash_changed"),
                (F.col("roles"), "adapter_roles_changed"),
                (~F.col("declared"), about("updated_role_missing")),
                (F.col("unchanged"), about("updated_adapter_unchanged")),
            )
        ).alias("reason"),
    )
    others = joined.filter(both & ~mine & ~equal).select(
        "policy_id", F.concat(F.lit("unexpected_adapter_change:"), F.col("role")).alias("reason")
    )
    return summary.unionByName(others)
