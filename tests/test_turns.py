"""Literal turns: runs, blanks, tags, hypothetical prompts, segments."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as X
from turnwise.functions.segments import by_depth, position_segment, scan, scan_by_depth
from turnwise.operators import turns as T

ROWS = [
    ("a", 0, "P", "early"),
    ("a", 1, "E", "sleep_q (how do\nyou sleep)"),
    ("a", 2, "P", "badly"),
    ("a", 3, "P", "   "),
    ("a", 4, "P", " um "),
    ("a", 5, "P", "so so"),
    ("a", 6, "E", "first prompt"),
    ("a", 7, "E", ""),
    ("a", 8, "P", "after a blank prompt"),
    ("a", 9, "E", "What would you do (then)"),
    ("a", 10, "P", "i would rest"),
    ("a", 11, "P", "i'm 9 and 42 years old"),
    ("a", 12, "P", "i am 42"),
    ("b", 0, "E", "only a prompt"),
    ("c", 0, "P", "only an answer"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ROWS, "session_id string, turn_idx long, role string, text string")


def reference_pairs(rows):
    out, question, tag, run = [], {}, {}, {}

    def flush(s):
        if run.get(s):
            ids = [i for i, _ in run[s]]
            out.append((s, f"turn-{ids[0]}", question.get(s, ""), " ".join(t for _, t in run[s]), tag.get(s), tuple(f"turn-{i}" for i in ids)))
        run[s] = []

    import re

    for s, i, role, text in rows:
        text = text.strip()
        if role != "P":
            flush(s)
            m = re.match(r"^([A-Za-z0-9_]+)\s*\((.*)\)$", text, re.DOTALL)
            question[s], tag[s] = (m.group(2).strip(), m.group(1)) if m else (text, None)
        elif text:
            run.setdefault(s, []).append((i, text))
    for s in list(run):
        flush(s)
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_rows", [1, 2, 3, 1000])
def test_pairs_whatever_the_segments(turns, segment_rows):
    got = T.pair_turns(turns, "P", segment_rows=segment_rows).collect()
    shaped = sorted(
        ((r.session_id, r.turn_id, r.question, r.answer, r.tag, tuple(r.span_ids)) for r in got), key=repr
    )
    assert shaped == reference_pairs(ROWS)


def test_merging_keeps_the_text(turns):
    words = lambda df: sorted(w for r in df.collect() for w in r.answer.split())
    assert words(T.pair_turns(turns, "P")) == words(T.pair_turns(turns, "P", merge=False))


@pytest.mark.parametrize("segment_rows", [1, 2, 1000])
def test_only_the_first_reply_follows_a_hypothetical_question(turns, segment_rows):
    df = T.after_hypothetical(turns, "E", segment_rows)
    assert [r.turn_idx for r in df.filter("after_hypothetical").collect()] == [10]


@pytest.mark.parametrize("rows", [1, 3, 7, 100])
def test_scan_equals_plain_running_values(spark, rows):
    df = spark.range(40).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("p"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("v")
    )
    out = scan(
        df, ["k"], ["p"], position_segment("p", rows),
        index="i", sums={"s": F.lit(1)}, lasts={"l": F.col("v")}, lags={"g": F.col("p")}, leads={"d": F.col("p")},
    ).orderBy("k", "p").collect()
    state = {}
    for r in out:
        st = state.setdefault(r.k, {"i": 0, "l": None, "g": None})
        st["l"] = r.v if r.v is not None else st["l"]
        assert (r.i, r.s, r.l, r.g) == (st["i"], st["i"] + 1, st["l"], st["g"])
        assert r.d == (r.p + 3 if r.p + 3 < 40 else None)
        st["i"], st["g"] = st["i"] + 1, r.p


def test_scan_without_keys_numbers_all_rows(spark):
    df = spark.range(25).select(F.col("id").alias("p"))
    out = scan(df, [], ["p"], position_segment("p", 4), index="i").orderBy("p").collect()
    assert [r.i for r in out] == list(range(25))


def test_first_age_skips_a_turn_whose_first_number_is_no_age(turns):
    ages = {r.session_id: r.age for r in T.first_age(turns, "P").collect()}
    assert ages == {"a": "42", "b": "undisclosed", "c": "undisclosed"}


@pytest.mark.parametrize("segment_rows", [1, 1000])
def test_participant_text_is_cut(turns, segment_rows):
    got = {r.session_id: r.text for r in T.participant_text(turns, 12, "P", segment_rows).collect()}
    whole = " ".join(t for s, _, role, t in ROWS if s == "a" and role == "P")
    assert got["a"] == whole[:12]


def test_negation(spark):
    cases = [
        ("i was not sad at all", False),
        ("not sad but later sad today again", False),
        ("not sad. but later on i felt quite sad", True),
        ("another sad day", False),
        ("never in all my life was sad", True),
        ("sad", True),
        ("glad", False),
    ]
    df = spark.createDataFrame(cases, "t string, want boolean")
    got = df.select("t", "want", X.plain_occurrence(F.col("t"), F.lit("sad")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_segments_of_equal_depth_split_a_busy_key(spark):
    df = spark.range(100).select(
        F.when(F.col("id") < 90, 1).otherwise(2).alias("k"), F.timestamp_seconds(F.col("id") * 50).alias("ts"), "id"
    )
    placed = by_depth(df, ["k"], ["ts"], rows=10)
    assert placed.filter("k = 1").select("__depth").distinct().count() >= 8
    out = scan(placed, ["k"], ["ts"], F.col("__depth"), index="i").collect()
    assert all(r.i == (r.id if r.k == 1 else r.id - 90) for r in out)
    assert by_depth(df, ["k"], ["ts"]).select("__depth").distinct().count() == 1
    assert scan_by_depth(df.limit(0), ["k"], ["ts"], 10, index="i").count() == 0


@pytest.mark.parametrize("place", ["id", "id * id * id", "CASE WHEN id = 199999 THEN 1000000000000 ELSE id END", "id div 100000 * 4000000000000 + id"])
def test_segments_hold_rows_whatever_the_gaps(spark, place):
    """A far-off value, sparse places and a wide gap: no segment above twice the target, and the scan is right."""
    df = spark.range(200_000).select(F.expr(place).alias("p"), "id").repartition(8)
    placed = by_depth(df, [], ["p"], rows=1_000)
    depth = placed.groupBy("__depth").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    rows = sorted(map(tuple, depth.collect()))
    assert max(r[1] for r in rows) <= 2_000 and 100 <= len(rows) <= 4_096
    assert all(a[3] < b[2] for a, b in zip(rows, rows[1:]))
    out = scan(placed, [], ["p"], F.col("__depth"), index="i", sums={"s": F.lit(1)}, lags={"g": F.col("id")})
    assert out.filter("i <> id OR s <> id + 1 OR (id > 0 AND g <> id - 1)").count() == 0
