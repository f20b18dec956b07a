"""Search and tiered retrieval against a direct restatement on a few pairs."""

import math
import re

import pytest

from turnwise.functions.constants import STOPWORDS
from turnwise.operators import retrieval as R

PAIRS = [
    ("s", f"turn-{i}", i, q, a, tag)
    for i, (q, a, tag) in enumerate(
        [
            ("how is sleep", "i sleep badly most nights", "sleep_q"),
            ("", "cannot fall asleep", None),
            ("energy", "tired tired tired", "both"),
            ("x", "i feel low energy", None),
            ("mood", "low mood", "mood_q"),
            ("mood", "low mood", None),
            ("y", "nothing here", "ctx"),
            ("z", "low energy and bad sleep", "ctx"),
            ("", "um", None),
            ("mood", "low mood", None),
            ("mood", "low mood", None),
            ("", "the and of", "ctx"),
        ]
    )
] + [("t", "turn-1", 1, "hello", "there", "ctx"), ("u", "turn-1", 1, "hello", "there", None)]

QUERIES = {"sleep": ["bad sleep", "fall asleep"], "mood": ["low mood"], "energy": ["the of", "low energy"]}
EDGES = {
    "sleep_q": [{"topic": "sleep", "relation": "reverse", "strength": "indirect"}],
    "both": [
        {"topic": "energy", "relation": "reverse", "strength": "direct"},
        {"topic": "energy", "relation": "probe", "strength": "direct"},
        {"topic": "sleep", "relation": "probe", "strength": "direct"},
    ],
    "mood_q": [{"topic": "mood", "relation": "probe", "strength": "indirect"}],
    "ctx": [{"topic": R.K.CROSS_CUTTING, "relation": "context", "strength": "direct"}],
}


def terms(text):
    return {w for w in re.findall(r"[a-z']+", text.lower()) if w not in STOPWORDS and len(w) > 2}


def search(pairs, queries, k, exclude=(), least=0.5):
    docs = [terms(f"{q} {a}") for _, _, _, q, a, _ in pairs]
    df = {}
    for d in docs:
        for t in d:
            df[t] = df.get(t, 0) + 1
    out = []
    for (_, tid, idx, q, a, _), words in zip(pairs, docs):
        if tid in exclude:
            continue
        best, matched = 0.0, set()
        for query in queries:
            want = terms(query)
            common = words & want
            if not common:
                continue
            score = sum(math.log(1 + len(pairs) / (1 + df[t])) for t in common) * (0.5 + 0.5 * len(common) / len(want))
            if " ".join(query.lower().split()) in f"{q} {a}".lower():
                score *= 1.75
            best, matched = max(best, score), matched | common
        if round(best, 9) >= least:
            out.append((tid, round(best, 6), tuple(sorted(matched))))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(
        PAIRS, "session_id string, turn_id string, turn_idx long, question string, answer string, tag string"
    )


@pytest.mark.parametrize("segment_rows", [2, 1000])
def test_search(pairs, segment_rows):
    got = R.search_pairs(pairs, QUERIES, 3, segment_rows=segment_rows).orderBy("rank").collect()
    for s in "stu":
        own = [p for p in PAIRS if p[0] == s]
        for topic, queries in QUERIES.items():
            found = [(r.turn_id, round(r.score, 6), tuple(r.matched)) for r in got if (r.session_id, r.topic) == (s, topic)]
            assert found == search(own, queries, 3), (s, topic)


def test_ties_go_to_the_smaller_id_text(pairs):
    got = R.search_pairs(pairs, {"mood": ["low mood"]}, 4).orderBy("rank").collect()
    assert [r.turn_id for r in got] == ["turn-10", "turn-4", "turn-5", "turn-9"]


def test_excluded_pairs_still_count_in_frequencies(spark, pairs):
    exclude = spark.createDataFrame([("s", "turn-4")], "session_id string, turn_id string")
    got = R.search_pairs(pairs, {"mood": ["low mood"]}, 9, exclude=exclude).orderBy("rank").collect()
    own = [p for p in PAIRS if p[0] == "s"]
    assert [(r.turn_id, round(r.score, 6)) for r in got] == [x[:2] for x in search(own, ["low mood"], 9, {"turn-4"})]


def test_retrieve_topics(pairs):
    got = R.retrieve_topics(pairs, EDGES, QUERIES, limit=3).orderBy("rank").collect()
    own = [p for p in PAIRS if p[0] == "s"]
    for topic, queries in QUERIES.items():
        anchored = {}
        for _, tid, _, _, _, tag in own:
            for e in EDGES.get(tag, []):
                if e["topic"] == topic:
                    score = 3.0 if e["strength"] == "direct" else 2.0
                    if tid not in anchored or score > anchored[tid][0]:
                        anchored[tid] = (score, e["relation"])
        want = [(t, r) for t, (s, r) in sorted(anchored.items(), key=lambda x: (-x[1][0], x[0]))]
        want += [(t, "probe") for t, _, _ in search(own, queries, 3, anchored)]
        found = [(r.turn_id, r.relation) for r in got if (r.session_id, r.topic) == ("s", topic)]
        assert found == want[:3], topic
    context = {(r.topic, r.turn_id, r.tier) for r in got if r.session_id == "t"}
    assert context == {(t, "turn-1", "contextual") for t in QUERIES}
    assert not [r for r in got if r.session_id == "u"]
    tiers = {(r.session_id, r.topic): r.tier for r in R.overall_tier(R.retrieve_topics(pairs, EDGES, QUERIES), pairs, list(QUERIES)).collect()}
    assert tiers[("s", "energy")] == "direct" and tiers[("t", "mood")] == "contextual" and tiers[("u", "mood")] == "absent"


def test_requests_for_several_topics_use_the_session_frequencies(spark, pairs):
    asked = [("s", t, q, ["turn-0"]) for t, q in QUERIES.items()]
    requests = spark.createDataFrame(asked, "session_id string, topic string, queries array<string>, exclude array<string>")
    got = R.search_requests(pairs, requests, 8).orderBy("rank").collect()
    own = [p for p in PAIRS if p[0] == "s"]
    for topic, queries in QUERIES.items():
        found = [(r.turn_id, round(r.score, 6), tuple(r.matched)) for r in got if r.topic == topic]
        assert found == search(own, queries, 8, {"turn-0"})


def test_a_long_session_is_searched_in_its_segments(spark):
    """Half of all pairs in one session: they meet the requests in as many places as it has segments."""
    rows = [("long", f"turn-{i}", i, "", f"low mood {i % 7} word{i % 13}", None) for i in range(400)]
    rows += [(f"s{k}", "turn-0", 0, "", "low mood here", None) for k in range(400)]
    pairs = spark.createDataFrame(rows, "session_id string, turn_id string, turn_idx long, question string, answer string, tag string")
    asked = [("long", "mood", ["word3 mood"], ["turn-3"]), ("long", "sleep", ["word5"], []), ("s7", "mood", ["low mood"], [])]
    requests = spark.createDataFrame(asked, "session_id string, topic string, queries array<string>, exclude array<string>")
    few = R.search_requests(pairs, requests, 4, segment_rows=20)
    keys = ["session_id", "topic", "turn_id", "score", "rank"]
    want = R.search_requests(pairs, requests, 4, segment_rows=1_000)
    assert sorted(map(tuple, few.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect())) != []
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "__part" in line for line in plan.splitlines())
