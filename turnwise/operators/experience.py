"""Offline experience: hard states, branches, contrasts, pairs and replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_hash
from .paired import reasons

SHARED = ["starting_state_hash", "profile_hash", "policy_id", "simulator_version", "seed"]


def hard_states(
    df: DataFrame, missing: Column, uncertainty: Column, coordination: Column, threshold: float
) -> DataFrame:
    """Mean of three signals against a threshold; unselected rows stay."""
    top = F.greatest(missing, uncertainty, coordination)
    score = F.round((missing + uncertainty + coordination) / 3.0, 9)
    return df.withColumns(
        {
            "normalized_score": score,
            "selected": score >= threshold,
            "rationale": F.concat(
                F.when(missing == top, "missing").when(uncertainty == top, "uncertainty").otherwise("coordination"),
                F.lit("_signal_dominates"),
            ),
        }
    )


def branch_set(states: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """One branch per state and strategy of the given list."""
    set_id = F.concat(F.col("experience_id").cast("string"), F.lit("-branches"))
    return (
        states.select("*", F.posexplode(F.lit(list(strategies))).alias("branch_index", "generation_strategy"))
        .withColumn("branch_set_id", set_id)
        .withColumn("branch_id", F.concat_ws("-", set_id, F.col("branch_index").cast("string")))
    )


def branch_violations(branches: DataFrame) -> DataFrame:
    """Branch sets whose members do not share state, profile, policy, simulator or seed."""
    stats = branches.groupBy("branch_set_id").agg(
        *(x for c in SHARED for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")))
    )
    found = reasons(*((F.col(f"lo_{c}") != F.col(f"hi_{c}"), f"differs_in_{c}") for c in SHARED))
    return stats.select("branch_set_id", F.explode(found).alias("violation"))


def branch_validity(results: DataFrame) -> DataFrame:
    """Reasons against a replayed branch.

    ``results`` has ``safe``, ``state_transition_valid``, both profile hashes and simulator
    versions, ``asserted_fact_keys`` and the profile's ``fact_keys``.
    """
    unsupported = F.transform(
        F.array_sort(F.filter("asserted_fact_keys", lambda k: ~F.array_contains("fact_keys", k))),
        lambda k: F.concat(F.lit("unsupported_fact:"), k),
    )
    fixed = reasons(
        (~F.col("safe"), "unsafe_output"),
        (~F.col("state_transition_valid"), "invalid_state_transition"),
        (F.col("profile_hash") != F.col("frozen_profile_hash"), "inconsistent_profile"),
        (F.col("simulator_version") != F.col("frozen_simulator_version"), "simulator_version_mismatch"),
    )
    return results.withColumn("invalid_reasons", F.concat(fixed, unsupported)).withColumn(
        "valid", F.size("invalid_reasons") == 0
    )


def contrasts(
    results: DataFrame, task: float, evidence: float, cost: float, pair_margin: float
) -> DataFrame:
    """Best against worst admissible branch of each set, or the reason for none.

    ``results`` is ``(branch_set_id, role, branch_index, branch_id, response, task_gain,
    evidence_gain, costs, valid, safety_admissible)``. Equal utilities: the first branch is
    chosen, the last rejected.
    """
    utility = F.round(
        task * F.col("task_gain") + evidence * F.col("evidence_gain") - cost * F.col("costs"), 9
    )
    ok = F.col("valid") & F.col("safety_admissible")
    place = F.when(ok, F.struct(F.col("u"), (-F.col("branch_index")).alias("i")))
    item = F.struct("branch_id", "response", "u")
    stats = (
        results.withColumn("u", utility)
        .groupBy("branch_set_id", "role")
        .agg(
            F.count_if(ok).alias("admissible"),
            F.max_by(item, place).alias("best"),
            F.min_by(item, place).alias("worst"),
        )
    )
    delta = F.round(F.col("best.u") - F.col("worst.u"), 9)
    status = F.when((F.col("admissible") >= 2) & (delta >= pair_margin), "accepted").otherwise("rejected")
    return stats.select(
        "branch_set_id",
        "role",
        status.alias("status"),
        F.when(F.col("admissible") < 2, "insufficient_valid_branches")
        .when(delta < pair_margin, "tie_below_pair_margin")
        .otherwise("")
        .alias("reason"),
        F.when(status == "accepted", F.col("best.branch_id")).alias("chosen_branch_id"),
        F.when(status == "accepted", F.col("worst.branch_id")).alias("rejected_branch_id"),
        F.when(status == "accepted", F.col("best.response")).alias("chosen"),
        F.when(status == "accepted", F.col("worst.response")).alias("rejected"),
        F.when(status == "accepted", delta).alias("delta_utility"),
    )


def preference_pairs(found: DataFrame) -> DataFrame:
    """Accepted contrasts whose two responses differ."""
    return found.filter("status = 'accepted' AND chosen <> rejected").select(
        F.concat(F.lit("pair-"), F.col("branch_set_id"), F.lit("-"), F.col("role")).alias("pair_id"),
        "role",
        "chosen",
        "rejected",
        F.concat_ws("/", "branch_set_id", "role").alias("contrast_id"),
    )


def partition_refusals(pairs: DataFrame, minimum_pairs: int) -> DataFrame:
    """``(role, reason)`` rows against using a role's pairs; a role without rows is usable.

    ``pairs`` is ``(pair_id, role, split_id, contrast_id, chosen, rejected)``.
    """
    stats = pairs.groupBy("role").agg(
        F.min("split_id").alias("lo"), F.max("split_id").alias("hi"), F.count("*").alias("n")
    )
    whole = stats.select(
        "role",
        F.explode(
            reasons(
                (F.col("lo") != F.col("hi"), "mixed_split_ids"),
                (F.col("n") < minimum_pairs, "below_minimum_role_pairs"),
            )
        ).alias("reason"),
    )
    twice = (
        pairs.groupBy("role", "contrast_id").agg(F.count("*").alias("n")).filter("n > 1")
        .select("role", F.concat(F.lit("duplicate_contrast_id:"), F.col("contrast_id")).alias("reason"))
    )
    same = pairs.filter("chosen = rejected").select(
        "role", F.concat(F.lit("chosen_equals_rejected:"), F.col("pair_id")).alias("reason")
    )
    return whole.unionByName(twice).unionByName(same)


def role_partitions(pairs: DataFrame, minimum_pairs: int) -> DataFrame:
    """Usable roles with their split and number of pairs."""
    refused = partition_refusals(pairs, minimum_pairs).select("role").distinct()
    return (
        pairs.groupBy("role")
        .agg(F.min("split_id").alias("split_id"), F.count("*").alias("pairs"))
        .join(refused, "role", "left_anti")
    )


def replay_key() -> Column:
    names = ["decoding_hash", "policy_id", "profile_hash", "seed", "simulator_version", "state_hash"]
    return canonical_hash(**{n: F.col(n) for n in names})


def replay_manifest(observations: DataFrame) -> DataFrame:
    """Per replay key its result hash and whether replays disagree."""
    return (
        observations.withColumn("replay_key", replay_key())
        .groupBy("replay_key")
        .agg(
            F.count("*").alias("replays"),
            F.min("result_hash").alias("result_hash"),
            (F.min("result_hash") != F.max("result_hash")).alias("mismatched"),
        )
    )


def determinism(observations: DataFrame) -> DataFrame:
    """Number of replays, keys and disagreeing keys."""
    return replay_manifest(observations).agg(
        F.sum("replays").cast("long").alias("replay_count"),
        F.count("*").alias("key_count"),
        F.count_if("mismatched").alias("mismatched_keys"),
    )


def guarded_append(records: DataFrame, split_id: str) -> DataFrame:
    """Mark which experience rows may enter the buffer of ``split_id``; ``reason`` is empty then.

    ``records`` has ``split_id``, ``role``, ``event_role``, ``offline_state_hash`` and
    ``pre_state_hash``.
    """
    reason = (
        F.when(F.col("offline_state_hash") != F.col("pre_state_hash"), "state_not_its_own")
        .when(F.col("role") != F.col("event_role"), "role_disagrees")
        .when(F.col("split_id") != split_id, "other_split")
        .otherwise("")
    )
    return records.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")
