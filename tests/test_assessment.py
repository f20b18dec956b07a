"""The scheduled loop against a direct restatement on a few sessions."""

import pytest
from test_retrieval import EDGES, PAIRS, QUERIES, search

from turnwise.functions.constants import TIERS
from turnwise.operators import retrieval as R
from turnwise.plans import assessment

SCOPES = ["mood|lexical"]


def rule(s, topic, r):
    k = (len(s) + ord(s) + len(topic) * 3 + r) % 5
    queries = [["low energy"], ["bad sleep", "tired"], [], ["low mood"], ["hello there"]][k]
    return queries, [True, False, None, False, False][(k + r) % 5]


@pytest.mark.parametrize("limit", [2, 8])
def test_acquire(spark, limit):
    schema = "session_id string, turn_id string, turn_idx long, question string, answer string, tag string"
    pairs = spark.createDataFrame(PAIRS, schema)
    topics = list(QUERIES)
    recorded = [(s, t, r, *rule(s, t, r), None if r == 1 else f"{t} {r}?") for s in "stu" for t in topics for r in range(3)]
    rec = spark.createDataFrame(
        recorded, "session_id string, topic string, round_index int, queries array<string>, verdict boolean, missing string"
    )
    seeds = assessment.seed_states(pairs, EDGES, QUERIES, rec, limit)
    states, trace = assessment.acquire(pairs, seeds, rec, SCOPES, budget=6, limit=limit)

    first = R.retrieve_topics(pairs, EDGES, QUERIES, limit).orderBy("rank").collect()
    want, steps, finds = {}, [], []
    for s in "stu":
        own = [p for p in PAIRS if p[0] == s]
        st = {}
        for t in topics:
            rows = [(r.turn_id, r.tier) for r in first if (r.session_id, r.topic) == (s, t)]
            st[t] = {"turns": rows, "spent": 1, "ok": rule(s, t, 0)[1], "missing": f"{t} 0?", "tried": list(QUERIES[t])}
        tier = lambda x: max([TIERS.index(b) for _, b in x["turns"]], default=0)
        for _ in range(6):
            best = None
            for t in topics:
                x = st[t]
                if x["ok"] is True or x["spent"] >= 3:
                    continue
                u = 1 - tier(x) / 4 + 0.25 * (f"{t}|{TIERS[tier(x)]}" in SCOPES) - 0.5 * min(1, x["spent"] / 3)
                if best is None or round(u, 9) > best[0]:
                    best = (round(u, 9), t)
            if best is None:
                break
            t = best[1]
            x, r = st[t], st[t]["spent"]
            before, (queries, verdict) = tier(x), rule(s, t, r)
            x["spent"] += 1
            lacked, tried = x["missing"], list(x["tried"])
            x["tried"] += queries
            if queries:
                known = {a for a, _ in x["turns"]}
                found = [(a, "expanded") for a, _, _ in search(own, queries, limit, known)]
                finds += [(s, t, r, i, a) for i, (a, _) in enumerate(found)]
                x["turns"] = (x["turns"] + found)[:limit]
                if tier(x) != before:
                    x["ok"], x["missing"] = verdict, "" if r == 1 else f"{t} {r}?"
            steps.append((s, t, r, TIERS[before], TIERS[tier(x)], lacked, tuple(tried)))
        for t in topics:
            want[(s, t)] = ([a for a, _ in st[t]["turns"]], TIERS[tier(st[t])], st[t]["spent"], st[t]["ok"])
    got = {
        (r.session_id, r.topic): ([x.turn_id for x in r.turns], r.tier, r.rounds_spent, r.sufficient)
        for r in states.collect()
    }
    assert got == want
    shown = sorted((r.session_id, r.topic, r.round_index, r.tier_before, r.tier_after, r.missing_before, tuple(r.already_tried_before)) for r in trace.collect())
    assert shown == sorted(steps) and steps
    rows = assessment.round_finds(trace).collect()
    assert sorted((r.session_id, r.topic, r.round_index, r.pos, r.turn_id) for r in rows) == sorted(finds) and finds

    # memory after the rounds equals claims appended round by round, of all finds
    held = {("old", 0)}
    told = [(s, t, a, f"{s}{a}", 0.5) for s in "stu" for t in topics for _, a, *_ in [p for p in PAIRS if p[0] == s]]
    for s, t, r, _, a in sorted(finds, key=lambda f: f[2]):
        if f"{s}{a}" not in {i for i, _ in held}:
            held.add((f"{s}{a}", r))
    claims = spark.createDataFrame(told, "session_id string, topic string, turn_id string, record_id string, confidence double")
    old = spark.createDataFrame([("s", topics[0], "x", "old", 0.5, 0)], claims.schema.simpleString()[7:-1].replace(":", " ") + ", round_index int")
    kept = assessment.round_evidence(trace, claims, old).collect()
    assert {(r.record_id, r.round_index) for r in kept} == held and len(kept) == len(held) > 1
