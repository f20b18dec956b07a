"""The adaptive pass: seed retrieval, scheduled expansion rounds, scoring and totals.

Model answers are recorded tables. All sessions take part in every scheduling step; the
driver only loops over the round budget, which is a small number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import memory, retrieval
from ..operators.retrieval import tier_name, tier_rank
from ..session import cut_lineage

_TURN = ["turn_id", "turn_idx", "score", "tier", "relation"]


def _as_list(retrieved: DataFrame) -> DataFrame:
    """Ranked rows to one short array per (session, topic); the retrieval limit bounds it."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*_TURN).alias("t"))))
    return retrieved.groupBy("session_id", "topic").agg(
        F.transform(rows, lambda r: r["t"]).alias("turns")
    )


def _best_tier(turns):
    return F.coalesce(F.array_max(F.transform(turns, lambda t: tier_rank(t["tier"]))), F.lit(0))


def _with_missing(recorded: DataFrame) -> DataFrame:
    return recorded if "missing" in recorded.columns else recorded.withColumn("missing", F.lit(""))


def seed_states(
    pairs: DataFrame,
    edges: retrieval.Edges,
    queries: Mapping[str, Sequence[str]],
    recorded: DataFrame,
    limit: int = 8,
    max_rounds: int = 3,
) -> DataFrame:
    """State of every (session, topic) after the seed round.

    ``recorded`` is ``(session_id, topic, round_index, queries, verdict)`` and, if the replies say what is
    ``missing``, that text; round 0 holds the seed's verdict. ``tried`` holds the queries asked so far, the seed's first.
    """
    recorded = _with_missing(recorded)
    found = _as_list(retrieval.retrieve_topics(pairs, edges, queries, limit))
    first = recorded.filter("round_index = 0").select("session_id", "topic", F.col("verdict").alias("sufficient"), "missing")
    seeded = F.create_map(*(x for t, qs in queries.items() for x in (F.lit(t), F.lit(list(qs)).cast("array<string>"))))
    keys = ["session_id", "topic"]
    everyone = retrieval.topics_of_sessions(pairs, list(queries))
    none = F.lit([]).cast(dict(found.dtypes)["turns"])
    return (
        everyone.join(found, keys, "left")
        .join(first, keys, "left")
        .withColumn("turns", F.coalesce("turns", none))
        .withColumns(
            {
                "tier": tier_name(_best_tier(F.col("turns"))),
                "rounds_spent": F.lit(1),
                "max_rounds": F.lit(max_rounds),
                "missing": F.coalesce("missing", F.lit("")),
                "tried": F.element_at(seeded, F.col("topic")),
            }
        )
    )


def acquisition_round(
    pairs: DataFrame,
    states: DataFrame,
    recorded: DataFrame,
    lesson_scopes: Sequence[str] = (),
    limit: int = 8,
) -> DataFrame:
    """One scheduling step: the chosen topic of each session with its new state.

    A round without queries is spent all the same; sufficiency is judged again only when
    the tier changed, and so is what is missing. What was missing and tried before the round stays with it.
    """
    keys = ["session_id", "topic"]
    target = memory.next_action(states, lesson_scopes).drop("utility", "resolved")
    now = _with_missing(recorded).select(
        *keys, F.col("round_index").alias("rounds_spent"), "queries", "verdict", F.col("missing").alias("missing_now")
    )
    asked = target.join(now, [*keys, "rounds_spent"], "left").withColumn(
        "queries", F.coalesce("queries", F.lit([]).cast("array<string>"))
    )
    asked = cut_lineage(asked, "asked")  # one row per session, read three times below
    requests = asked.filter(F.size("queries") > 0).select(
        *keys, "queries", F.col("turns.turn_id").alias("exclude")
    )
    found = _as_list(retrieval.search_requests(pairs, requests, limit)).withColumnRenamed("turns", "found")
    grown = asked.join(found, keys, "left").withColumn(
        "new_turns",
        F.slice(
            F.concat("turns", F.coalesce("found", F.slice("turns", 1, 0))), 1, limit
        ),
    )
    after = tier_name(_best_tier(F.col("new_turns")))
    judged = (F.size("queries") > 0) & (F.col("tier_after") != F.col("tier"))
    return grown.withColumn("tier_after", after).select(
        *keys,
        F.col("rounds_spent").alias("round_index"),
        F.col("tier").alias("tier_before"),
        "tier_after",
        F.coalesce("sufficient", F.lit(False)).alias("resolved_before"),
        F.when(judged, F.col("verdict")).otherwise(F.col("sufficient")).alias("sufficient"),
        F.col("missing").alias("missing_before"),
        F.when(judged, F.coalesce("missing_now", F.lit(""))).otherwise(F.col("missing")).alias("missing_after"),
        F.col("tried").alias("already_tried_before"),
        "queries",
        F.transform("turns", lambda t: t["turn_id"]).alias("excluded"),
        F.coalesce("found", F.slice("turns", 1, 0)).alias("found"),
        "new_turns",
    )


def round_finds(trace: DataFrame) -> DataFrame:
    """Every turn that a round found, also those that the merge had no room for, one row each.

    Claims are extracted from all of them, see ``round_evidence``.
    """
    return trace.select(
        "session_id", "topic", "round_index", F.posexplode("found").alias("pos", "turn")
    ).select("session_id", "topic", "round_index", "pos", "turn.*")


def round_evidence(trace: DataFrame, claims: DataFrame, held: DataFrame) -> DataFrame:
    """The evidence memory after the rounds of ``trace``: ``held`` and the claims of every turn that a round found.

    ``claims`` are the records extracted from turns, with session_id, topic, turn_id, record_id, confidence and what
    else ``held`` has but the round, which is that of the find. A record that several finds give stays with the first
    round, and one that memory holds stays as it is; so this equals appending after each round.
    """
    finds = round_finds(trace).select("session_id", "topic", "round_index", "turn_id").distinct()
    told = claims.drop("round_index").join(finds, ["session_id", "topic", "turn_id"])
    return memory.append_evidence(held, told)


def acquire(
    pairs: DataFrame,
    states: DataFrame,
    recorded: DataFrame,
    lesson_scopes: Sequence[str] = (),
    budget: int = 6,
    limit: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Spend up to ``budget`` rounds per session; returns final states and the trace.

    Each step is written to the shared folder, so plans stay short and a lost executor
    costs at most one step.
    """
    keys = ["session_id", "topic"]
    states = cut_lineage(states, "states")
    columns = states.columns
    traces = []
    for _ in range(budget):
        step = cut_lineage(acquisition_round(pairs, states, recorded, lesson_scopes, limit), "round")
        if step.isEmpty():
            break
        traces.append(step)
        done = step.select(
            *keys, "new_turns", "tier_after", F.col("sufficient").alias("judged"), "missing_after", F.col("queries").alias("asked")
        )
        joined = states.join(done, keys, "left")
        hit = F.col("new_turns").isNotNull()
        states = cut_lineage(
            joined.withColumns(
                {
                    "turns": F.coalesce("new_turns", "turns"),
                    "tier": F.coalesce("tier_after", "tier"),
                    "sufficient": F.when(hit, F.col("judged")).otherwise(F.col("sufficient")),
                    "rounds_spent": F.col("rounds_spent") + F.when(hit, 1).otherwise(0),
                    "missing": F.coalesce("missing_after", "missing"),
                    "tried": F.when(hit, F.concat("tried", "asked")).otherwise(F.col("tried")),
                }
            ).select(*columns),
            "states",
        )
    trace = None
    for t in traces:
        trace = t if trace is None else trace.unionByName(t)
    if trace is None:
        trace = acquisition_round(pairs, states, recorded, lesson_scopes, limit).limit(0)
    return states, trace.withColumn("resolved_after", F.coalesce("sufficient", F.lit(False))).drop(
        "sufficient", "new_turns", "missing_after"
    )
