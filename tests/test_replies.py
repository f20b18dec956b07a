"""Reply parsing and grounding edge cases."""

import pytest
from pyspark.sql import functions as F

from turnwise.operators import grounding, memory, replies, totals


def test_balanced_spans():
    find = replies.balanced_spans
    assert find('a {"x": "}"} b {"y": {"z": 1}} {open') == ['{"x": "}"}', '{"y": {"z": 1}}']
    assert find('say "not { here" then {1}') == ["{1}"]
    assert find('{"a": "q\\"}"}') == ['{"a": "q\\"}"}']
    assert find('"never closed { }') == [] and find(None) == [] and find("} {}") == ["{}"]


SCORES = [
    ("", None, "empty response"),
    ("<think>{\"score\": 3}</think>", None, "reasoning-only response (likely truncated before the answer)"),
    ('<think>a</think>x {"score": 1} {"score": 2, "summary": "s"}', 2, ""),
    ('{"score": 2} {"score": true}', 2, ""),
    ('{"score": "2"}', 2, ""),
    ('{"score": 2.0}', 2, ""),
    ('{"score": -1}', 0, ""),
    ('{"score": 7}', 3, ""),
    ('"score": 1 and "Score": 9', 3, ""),
    ("the rating is 2.", 2, ""),
    ("2 or 3", None, "no score field found in response"),
    ("**Thinking Process**: x\n---\n{\"score\": 1}", 1, ""),
    ("Reasoning: x\n```json\n{\"score\": 2}\n```", 2, ""),
    ("Thinking: {\"score\": 3}\nFinal answer: {\"score\": 0}", 0, ""),
]


def test_typed_scores(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(SCORES)], "i int, raw string")
    got = replies.typed_scores(df).orderBy("i").collect()
    assert [(r.score, r.reason) for r in got] == [x[1:] for x in SCORES]


def test_item_scores_keep_abstention_apart(spark):
    cases = [
        ('{"score": 2, "present": "unclear", "sufficient": true}', None, False, "unclear"),
        ('{"score": null, "present": "no", "sufficient": true}', None, False, "no"),
        ('{"score": 1, "present": "no"}', 0, True, "no"),
        ('{"score": 1, "sufficient": "false"}', None, False, "yes"),
        ('{"score": "about 3 days"}', 3, True, "yes"),
        ("none", None, False, "unclear"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = replies.typed_item_scores(df).orderBy("i").collect()
    assert [(r.score, r.sufficient, r.present) for r in got] == [c[1:] for c in cases]


def test_quotes(spark):
    evidence = "I  have not slept well for two whole weeks, honestly"
    cases = [("", False), ("slept WELL", True), ("one two three four", False),
             ("he said not slept well for two and then", True), ("not slept well for three weeks now", False)]
    df = spark.createDataFrame([(q, evidence, w) for q, w in cases], "q string, e string, w boolean")
    got = df.select("w", grounding.quote_grounded(F.col("q"), F.col("e")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_corpus_grounding_equals_row_grounding(spark):
    docs = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "xalpha beta gamma delta epsilonic"), (3, "a b"), (4, "beta, gamma delta")]
    quotes = [(1, "alpha beta gamma delta epsilon"), (2, "a b"), (3, "lpha be"), (4, "gamma delta"), (5, "  "), (6, "q alpha beta gamma delta epsilon r")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = spark.createDataFrame(quotes, "quote_id int, text string")
    got = {(r.quote_id, r.doc_id) for r in grounding.ground_quotes(q, d).collect()}
    both = q.select("quote_id", F.col("text").alias("qt")).crossJoin(d)
    want = {(r.quote_id, r.doc_id) for r in both.filter(grounding.quote_grounded(F.col("qt"), F.col("text"))).collect()}
    assert got == want and (3, 1) in want


def test_objects_with_repeated_keys_and_odd_numbers(spark):
    cases = [
        ('{"score": 1, "score": 2}', 2, ""),
        ('{"score": 3, "x": NaN}', 3, ""),
        ('{"score": 2, "x": [Infinity, -Infinity]}', 2, ""),
        ('{"score": NaN}', None, ""),
        ('{"score": 1, "quote": "a\nb"}', None, "no JSON object in reply"),
        ('{"score": 2, "n": 123456789012345678901234567890}', 2, ""),
        ('{"score": 1} {"score": 2,, }', 1, ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = {r.i: (r.score, r.reason) for r in replies.typed_item_scores(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    same = spark.createDataFrame([('{"sufficient": true, "sufficient": false, "missing": "a", "missing": "b", "y": NaN}',)], "raw string")
    r = replies.typed_sufficiency(same).first()
    assert (r.sufficient, r.missing) == (False, "b")
    doubled = spark.createDataFrame([(1, "m", '{"trigger": "t", "trigger": "u", "do": "d", "avoid": "a", "criterion": "c", "confidence": NaN}')], "role int, scope string, raw string")
    r = replies.lesson_candidates(doubled).first()
    assert (r.trigger, r.candidate_confidence) == ("u", 0.0)


def test_contradictions(spark):
    rows = [("s", "t", "a", 0, "refutes", "none"), ("s", "t", "b", 1, "supports", "stated_days"), ("s", "t", "c", 0, "supports", "ongoing_state"),
            ("s", "t", "d", 2, "supports", "none"), ("s", "t", "e", 2, "uncertain", "stated_days"), ("s", "u", "f", 0, "supports", "stated_days")]
    df = spark.createDataFrame(rows, "session_id string, topic string, record_id string, round_index int, polarity string, frequency_basis string")
    found = memory.contradictions(memory.contradiction_sides(df)).collect()
    assert {(r.record_id, r.counterpart_id, r.counterparts, r.earlier_record_id) for r in found} == {
        ("a", "c", 2, None), ("b", "a", 1, "a"), ("c", "a", 1, None)}
    assert [r.contradictions for r in memory.contradiction_counts(df).collect()] == [2]


def test_large_groups_keep_their_contradictions(spark):
    rows = spark.range(260).selectExpr(
        "'s' AS session_id", "'t' AS topic", "string(id) AS record_id", "int(id % 5) AS round_index",
        "if(id < 130, 'refutes', 'supports') AS polarity", "'stated_days' AS frequency_basis")
    assert memory.contradiction_counts(rows).first().contradictions == 16_900
    sides = memory.contradiction_sides(rows)
    assert sides.count() == 260 and memory.contradictions(sides).agg(F.min("counterparts")).first()[0] == 130
    results = spark.createDataFrame([("s", "none", None, False, False, False, 1)],
        "session_id string, evidence_tier string, score int, citation_mismatch boolean, quote_grounded boolean, parse_failed boolean, rounds int")
    assert totals.session_diagnostics(results, memory.contradiction_counts(rows)).first().contradictions == 16_900


def test_append_is_idempotent(spark):
    schema = "record_id string, round_index int, confidence double"
    old = spark.createDataFrame([("a", 0, 0.5)], schema)
    new = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.1), ("b", 1, 0.2)], schema)
    once = memory.append_evidence(old, new)
    assert sorted(tuple(r) for r in once.collect()) == [("a", 0, 0.5), ("b", 1, 0.2)]
    assert memory.new_evidence(once, new).count() == 0


@pytest.mark.parametrize("n,asked,go", [(2, 2, True), (2, 3, False), (1, 1, True), (1, 2, False), (0, 0, False)])
def test_continue_asking(spark, n, asked, go):
    assert spark.range(1).select(grounding.continue_asking(F.lit(n), F.lit(asked))).first()[0] is go


def test_half_a_surrogate_pair_does_not_end_the_job(spark):
    cut = '{"score": 2, "summary": "cut \\ud83d"}'
    deep = '{"a": ' * 3000 + "1" + "}" * 3000
    rows = [cut, '{"x": {"y": "\\udc00"}, "score": 1}', '{"score": 3, "summary": "whole \\ud83d\\ude00"}', deep, '{"score": 1, "score": 2}', '{"score": NaN} {"score": 1}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, raw string")
    got = replies.typed_scores(df).orderBy("i").collect()
    assert [(r.score, r.summary) for r in got] == [(2, "cut �"), (1, ""), (3, "whole \U0001f600"), (1, ""), (2, ""), (1, "")]
    items = replies.typed_item_scores(df.withColumn("raw", F.replace("raw", F.lit("summary"), F.lit("quote")))).orderBy("i").collect()
    assert [r.quote for r in items][:1] == ["cut �"]
    replies.typed_sufficiency(df).collect(), replies.typed_queries(df).collect()


FLAT = ['{"a": 1}', 'x {"a": "q"} y {"b": [1, 2]} z', '{"a": "}"}', '{"a": "{"} {"b": "}"}', 'say "{" {"a": 1}', "{a}", '{"a": 1.50}',
        '{"a": 1e400}', '{"a": 1, "a": 2}', '{"a": "\\u00e9"}', "", "none", '{"a": "x\ny"}', "{}", '{"a": 12345678901234567890}', '{"a": Infinity}']


def test_flat_objects_read_the_same_with_and_without_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*FLAT, None])], "i int, t string")
    got = replies.with_objects(df, F.col("t")).select("i", F.transform("objects", lambda v: F.to_json(v)).alias("o"))
    slow = df.select("i", F.filter(F.transform(replies.readable_objects("t"), F.try_parse_json), lambda v: v.isNotNull()).alias("v"))
    want = slow.select("i", F.transform("v", lambda v: F.to_json(v)).alias("o"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
