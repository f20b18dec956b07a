"""File sources, settings, run records and streams."""

import glob
import json
import os
import re

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnwise.plans.catalog import RUNS
from turnwise.session import shared_folder
from turnwise.sources import reference, runs, transcripts
from turnwise.operators import turns as T
from turnwise.streaming import streams


def test_transcripts(spark, tmp_path):
    (tmp_path / "301_TRANSCRIPT.csv").write_bytes(
        "﻿start_time\tstop_time\tspeaker\tvalue\r\n0.5\t1\tEllie\thi (there)\r\n2\t3\tParticipant\t  yes, ok \r\n4\t5\tOther\tx\r\n6\t7\tParticipant\t\r\n8\t9\tParticipant\tNone\r\n".encode()
    )
    (tmp_path / "302_TRANSCRIPT.csv").write_text('speaker;value\nParticipant;"a; b"\nEllie;q\n')
    got = transcripts.scan_transcripts(spark, str(tmp_path)).orderBy("session_id", "block", "line").collect()
    assert [(r.session_id, r.role, r.text, r.start_time) for r in got] == [
        ("301", "Ellie", "hi (there)", 0.5), ("301", "Participant", "yes, ok", 2.0),
        ("302", "Participant", "a; b", None), ("302", "Ellie", "q", None),
    ]


def test_transcript_without_required_column(spark, tmp_path):
    (tmp_path / "9_TRANSCRIPT.csv").write_text("speaker,words\nEllie,x\n")
    with pytest.raises(PySparkException):
        transcripts.scan_transcripts(spark, str(tmp_path)).collect()


def test_labels(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes(b"participant_ID,PHQ_Binary,PHQ_Score,Gender,PHQ8_Sleep,PHQ8_Tired\r\n\r\n302.0,1,12,0,3,\r\n\r\n303,0,4,1,,\r\n\r\n")
    got = {r.session_id: (r.total, r.binary, r["items"]) for r in transcripts.scan_labels(spark, str(path)).collect()}
    assert got == {"302": (12, 1, {"PHQ8_Sleep": 3}), "303": (4, 0, None)}


def test_wide_and_multi_line_transcripts(spark, tmp_path):
    names = ",".join(f"c{i}" for i in range(12))
    (tmp_path / "1_TRANSCRIPT.csv").write_text(
        f'{names},speaker,value\n,{"x," * 11}Participant,"fine\nthanks, ""ok"""\n{"," * 12}Ellie,plain\n' + "".join(
            f'{"," * 12}Participant,"n{i}\n\nm"\n' for i in range(40)))
    (tmp_path / "2_TRANSCRIPT.csv").write_text("speaker,value\nEllie,it is 5\n")
    got = transcripts.scan_transcripts(spark, str(tmp_path)).orderBy("session_id", "block", "line").collect()
    assert [r.text for r in got][:3] == ['fine\nthanks, "ok"', "plain", "n0\n\nm"]
    assert [r.text for r in got][-2:] == ["n39\n\nm", "it is 5"] and len(got) == 43


def test_lone_quotes_do_not_swallow_lines(spark, tmp_path):
    (tmp_path / "1_TRANSCRIPT.csv").write_text('speaker,value\nEllie,5\' 6" tall\n' + "".join(f"Participant,n{i}\n" for i in range(300)))
    (tmp_path / "2_TRANSCRIPT.csv").write_text(
        'speaker\tvalue\nEllie\t"a, ""b""\nc 7"" d"\nEllie\t3" or 4\nParticipant\t"never closed\n' + "".join(f"Participant\tm{i}\n" for i in range(50)))
    rows = transcripts.scan_transcripts(spark, str(tmp_path)).orderBy("session_id", "block", "line").collect()
    got = {s: [r.text for r in rows if r.session_id == s] for s in "12"}
    assert got["1"] == ["5' 6\" tall", *(f"n{i}" for i in range(300))]
    assert got["2"] == ['a, "b"\nc 7" d', '3" or 4', '"never closed', *(f"m{i}" for i in range(50))]


def test_labels_without_a_number_are_listed(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("Participant_ID,PHQ8_Sleep\n1,2\nx,3\n,1\n")
    got = {(r.raw_id, r.reason) for r in transcripts.rejected_labels(spark, str(path)).collect()}
    assert got == {("x", "id is no number"), (None, "no id")}


def test_long_sessions_are_written_in_parts(spark):
    turns = spark.createDataFrame([(s, i, "P", "x") for s, n in ((1, 2), (2, 5)) for i in range(n)], "session_id int, turn_idx int, role string, text string")
    labels = spark.createDataFrame([(1, 3, 0), (2, 9, 1), (3, 1, 0)], "session_id int, total int, binary int").withColumn(
        "items", F.create_map(F.lit("a"), F.lit(1)))
    samples, missing = transcripts.build_samples(labels, turns, part_turns=3)
    got = sorted((r.Participant_ID, r.part, r.first_turn, len(r.real_interview)) for r in samples.collect())
    assert got == [("1", 0, 0, 2), ("2", 0, 0, 3), ("2", 1, 3, 2)]
    told = sorted((r.session_id, r.turn_idx) for r in transcripts.sample_turns(samples).collect())
    assert told == sorted((str(s), i) for s, n in ((1, 2), (2, 5)) for i in range(n))
    assert transcripts.sample_labels(samples).count() == 2
    assert [r.session_id for r in missing.collect()] == [3]
    with pytest.raises(ValueError):
        transcripts.build_samples(labels, turns, strict=True)


def settings_files(tmp_path, **changed):
    data = {
        "scale": {"A": ["q"], "B": ["q"]},
        "edges": {"_meta": {}, "tags": {"t": [{"topic": "A", "relation": "probe", "strength": "direct"}]}},
        "queries": {"_meta": {}, "A": ["x"], "B": ["y"]},
        "lexicon": {"A": ["Sad"]},
        "rubric": {"SCALE": {"A": {"0": "none"}}},
        **changed,
    }
    files = {}
    for name, value in data.items():
        files[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    return files


def test_settings(spark, tmp_path):
    s = reference.load_settings(spark, settings_files(tmp_path))
    assert s.topics == ("A", "B") and s.lexicon == {"A": ["sad"]} and s.rubric == {"A": {"0": "none"}}
    assert {n: t.count() for n, t in s.tables(spark).items()}["seed_query"] == 2


@pytest.mark.parametrize(
    "changed",
    [
        {"edges": {"tags": {}}},
        {"edges": {"tags": {"t": [{"topic": "C", "relation": "probe", "strength": "direct"}]}}},
        {"edges": {"tags": {"t": [{"topic": "A", "relation": "ask", "strength": "direct"}]}}},
        {"edges": {"tags": {"t": [{"topic": "A", "relation": "probe", "strength": "weak"}]}}},
        {"queries": {"A": ["x"]}},
        {"queries": {"A": ["x"], "B": ["y"], "C": ["z"]}},
        {"lexicon": {"C": ["x"]}},
    ],
)
def test_settings_fail_closed(spark, tmp_path, changed):
    with pytest.raises(ValueError):
        reference.load_settings(spark, settings_files(tmp_path, **changed))


def test_records_of_both_generations_in_one_folder(spark, tmp_path):
    older = {"participant_id": "1", "topics": {
        "A": {"score": 2, "item_key": "a", "evidence_status": "known"}, "B": {"score": 0, "item_key": "b", "evidence_status": "missing"},
        "C": {"score": 1, "item_key": "c"}}}
    newer = {"participant_id": "2", "topics": {
        "A": {"score": 3, "abstained": False, "item_key": "a", "acquisition_trace": [{"round_index": 1, "tier_before": "absent", "tier_after": "expanded",
              "resolved_before": False, "resolved_after": True, "queries_tried": ["q"]}]}, "B": {"score": None, "abstained": True, "item_key": "b"}}}
    for r in (older, newer):
        (tmp_path / f"{r['participant_id']}_evaluation.json").write_text(json.dumps(r, indent=1))
    (tmp_path / "other.json").write_text("{}")
    results = runs.item_results(runs.read_run(spark, str(tmp_path)))
    got = sorted((r.session_id, r["item"], r.score) for r in runs.assessed_items(results).collect())
    assert got == [("1", "a", 2), ("1", "c", 1), ("2", "a", 3)]
    assert [r.tier_after for r in runs.trace_rounds(results).collect()] == ["expanded"]


def test_summary_files(spark, tmp_path):
    runs.write_summary(spark.range(1), spark.range(3), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "metrics")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "sessions")).count() == 3


#: Two stages may meet a refused entry at once, which Spark reports as an error of its own kind.
REFUSED = (PySparkException, Py4JError)
EDGE = {"topic": "mood", "relation": "probe", "strength": "direct"}


@pytest.mark.parametrize("tags", [{}, {"t": "mood"}, {"t": {"topic": "mood"}}, {"t": None}, {"t": [EDGE | {"topic": "luck"}]}, {"t": [EDGE | {"relation": "near"}]}, {"t": [EDGE, EDGE | {"strength": "weak"}]}, {"t": [{"topic": "mood"}]}])
def test_refused_edges_end_the_job(spark, tmp_path, tags):
    path = tmp_path / "edges.json"
    path.write_text(json.dumps({"_meta": 1, "tags": tags}))
    topics = spark.createDataFrame([("mood",), ("sleep",)], "topic string")
    with pytest.raises(REFUSED):
        reference.read_edges(spark, str(path), topics).count()


@pytest.mark.parametrize("queries", [{"mood": ["a"]}, {"mood": ["a"], "sleep": [], "luck": []}, {"mood": "a", "sleep": ["b"]}])
def test_refused_queries_end_the_job(spark, tmp_path, queries):
    path = tmp_path / "queries.json"
    path.write_text(json.dumps({"_meta": {"v": 1}} | queries))
    with pytest.raises(REFUSED):
        reference.read_queries(spark, str(path), spark.createDataFrame([("mood",), ("sleep",)], "topic string")).count()


def test_settings_as_tables(spark, tmp_path):
    (tmp_path / "edges.json").write_text(json.dumps({"tags": {"t": [EDGE, EDGE | {"topic": "CROSS_CUTTING"}], "none": []}}))
    (tmp_path / "queries.json").write_text(json.dumps({"mood": ["a", "b"], "sleep": []}))
    topics = spark.createDataFrame([("mood",), ("sleep",), ("mood",)], "topic string")
    got = reference.read_edges(spark, str(tmp_path / "edges.json"), topics).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [("t", 0, "mood", "probe", "direct"), ("t", 1, "CROSS_CUTTING", "probe", "direct")]
    got = reference.read_queries(spark, str(tmp_path / "queries.json"), topics).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [("mood", 0, "a"), ("mood", 1, "b")]


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, turn_idx long, role string, text string, s long")
    return df.select("session_id", "turn_idx", "role", "text", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))


def test_pair_stream_closes_a_silent_session(spark, tmp_path):
    rows = [("a", 0, "P", "hello", 0), ("a", 1, "E", "q1", 60), ("a", 2, "P", "one", 120), ("a", 3, "P", "two", 180), ("b", 0, "E", "later", 90_000)]
    df = turns_of(spark, rows + [(None, 0, "P", "nobody", 0), ("a", None, "P", "nowhere", 0)])
    for part in (df.filter("turn_idx < 3 AND session_id = 'a'"), df.filter("turn_idx = 3 OR session_id IS NULL OR turn_idx IS NULL"), df.filter("session_id = 'b'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    run = stream.writeStream.foreachBatch(streams.pair_writer(path, "P", 60_000, 600_000)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.turn_id, r.question, r.answer) for r in streams.read_pairs(spark, path).collect())
    assert got == [("turn-0", "", "hello"), ("turn-2", "q1", "one two")]


@pytest.mark.parametrize("cuts", [[7], [1, 2, 3, 4, 5], [40, 41, 300]])
def test_pair_stream_equals_the_batch_however_it_is_cut(spark, tmp_path, cuts):
    """Also when each trigger is repeated, and whatever other sessions do meanwhile."""
    rows = []
    for s, n in (("long", 400), ("short", 9), ("late", 60)):
        for i in range(n):
            role = "P" if (i * 7 + len(s)) % 5 < 3 else "E"
            rows.append((s, i, role, "  " if i % 11 == 0 else f"{s} {i}", i * 60))
        rows.append((s, n, "E", "bye", n * 60))
    df = turns_of(spark, rows)
    path, bounds = str(tmp_path / "out"), [0, *cuts, 10_000]
    write = streams.pair_writer(path, "P", timeout_ms=0, segment_rows=16)
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        batch = df.filter((F.col("turn_idx") >= lo) & (F.col("turn_idx") < hi))
        write(batch, k)
        write(batch, k)
    want = T.pair_turns(df, "P").collect()
    assert sorted(map(tuple, streams.read_pairs(spark, path).collect())) == sorted(map(tuple, want))
    assert spark.read.parquet(f"{path}/open/{len(cuts)}").count() == 3  # the closing prompts


def test_a_trigger_that_is_repeated_adds_nothing_and_reads_its_prefixes(spark, tmp_path):
    path = str(tmp_path / "memory")
    write = streams.append_to_memory(path)
    first = spark.range(500).select(F.concat(F.lit("r"), "id").alias("record_id"), F.col("id").alias("n"))
    for batch_id, ids in enumerate([(0, 300), (200, 500)]):
        batch = first.filter(F.col("n").between(ids[0], ids[1] - 1)).union(first.limit(3)).union(spark.sql("SELECT CAST(NULL AS STRING), 0L"))
        write(batch, batch_id)
        write(batch, batch_id)
    got = streams.read_memory(spark, path)
    assert got.count() == 500 and got.select("record_id").distinct().count() == 500
    write(first, 7)  # other numbers, records all held
    assert streams.read_memory(spark, path).count() == 500
    few = streams.with_prefix(spark.sql("SELECT 'r1' AS record_id, 1L AS n UNION ALL SELECT 'x', 2L"))
    new = streams.unheld(few, spark.read.parquet(f"{path}/records"))
    assert [r.record_id for r in new.collect()] == ["x"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "prefix" in filters and len(re.findall(r"\d+", filters.split("IN", 1)[-1])) <= 4


@pytest.mark.parametrize("kind", [{"window": "10 minutes", "slide": "5 minutes"}, {"session_gap": "5 minutes"}])
def test_usage_windows_in_batch(spark, kind):
    df = spark.createDataFrame([(0,), (60,), (1200,)], "s long").select(
        F.timestamp_seconds("s").alias("ts"), F.lit("call").alias("outcome"), F.lit(False).alias("truncated"),
        F.lit(10).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    got = streams.stream_usage(df, **kind)
    total = sum(r.calls for r in got.collect())
    assert total == (6 if "slide" in kind else 3)


def test_transcript_files_are_opened_once(spark, tmp_path):
    """All steps after the first read stored lines, also where values run over several lines."""
    (tmp_path / "1_TRANSCRIPT.csv").write_text('speaker,value\nEllie,"a\nb"\n')
    (tmp_path / "2_TRANSCRIPT.csv").write_text("speaker,value\nEllie,c\n")
    for files, texts in (("*", ["a\nb", "c"]), ("2*", ["c"])):
        got = transcripts.scan_transcripts(spark, f"{tmp_path}/{files}")
        assert "text" not in re.findall(r"FileScan (\w+)", got._jdf.queryExecution().executedPlan().toString())
        assert [r.text for r in got.orderBy("session_id").collect()] == texts


def test_triggers_do_not_grow_with_files(spark):
    """Five arrivals in four triggers each at most, and one that closes windows; not one per file."""
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/turnwise-windows-*-progress"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        RUNS["stream_usage"](spark, "/root/testdata/sf0.001")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    (progress,) = set(glob.glob(f"{folder}/turnwise-windows-*-progress")) - before
    commits = [x for x in os.listdir(f"{progress}/commits") if x.isdigit()]
    assert 5 <= len(commits) <= 25
