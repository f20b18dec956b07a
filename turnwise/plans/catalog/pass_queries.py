"""The adaptive pass, near-duplicate groups and the streams, run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import similarity
from ...operators.turns import pair_turns
from ...session import shared_folder
from ...streaming import streams
from .. import assessment
from .ablation_queries import USAGE, USAGE_SQL
from .base import query, spread, table
from .memory_queries import EVIDENCE_CTE, evidence
from .retrieval_queries import EDGES, QUERIES
from .turn_queries import MIXED, PAIRS_CTE, stored_pairs


def recorded_rounds(pairs):
    """Recorded queries and verdicts by rule, for every session, topic and round."""
    i, r = F.col("session_id"), F.col("round_index")
    bank = F.lit(["thand on", "les an der", "eine chie", "shan re", "the enst", "que oument"])
    first = F.element_at(bank, ((i + r * 2 + F.col("ord")) % 6 + 1).cast("int"))
    second = F.element_at(bank, ((i * 3 + r) % 6 + 1).cast("int"))
    none = F.lit([]).cast("array<string>")
    topics = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(t).alias("topic")) for k, t in enumerate(QUERIES)))
    return (
        pairs.select("session_id")
        .distinct()
        .select("session_id", F.explode(topics).alias("t"))
        .select("session_id", "t.*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("round_index"))
        .select(
            "session_id",
            "topic",
            "round_index",
            F.when((i + r) % 7 == 0, none).otherwise(F.array(first, second)).alias("queries"),
            F.when((i + F.col("ord")) % 5 > 0, (i + F.col("ord") + r) % 4 == 0).alias("verdict"),
            F.when((i + r) % 3 > 0, F.concat("topic", F.lit(" after round "), r.cast("string"))).alias("missing"),
        )
    )


@query("acquisition_trace")
def acquisition_trace(spark, folder):
    pairs = stored_pairs(spark, folder)
    recorded = recorded_rounds(pairs)
    seeds = assessment.seed_states(pairs, EDGES, QUERIES, recorded)
    _, trace = assessment.acquire(pairs, seeds, recorded, ["sleep|absent", "mood|lexical"])
    listed = ("queries", "excluded", "already_tried_before")
    return trace.drop("found").withColumns({c: F.array_join(c, ",") for c in listed})


@query("round_finds")
def round_finds(spark, folder):
    """Turns found per round; without SQL like the trace, and compared with it in the tests."""
    pairs = stored_pairs(spark, folder)
    recorded = recorded_rounds(pairs)
    seeds = assessment.seed_states(pairs, EDGES, QUERIES, recorded)
    _, trace = assessment.acquire(pairs, seeds, recorded, ["sleep|absent", "mood|lexical"])
    return assessment.round_finds(trace)


WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: w <> ''))"


@query(
    "word_similarity",
    f"""WITH d AS (SELECT lang, source, doc_id, {WORDS_SQL.format(t='text')} AS a FROM documents),
        p AS (SELECT *, lag(a) OVER (PARTITION BY lang, source ORDER BY doc_id) AS b FROM d),
        j AS (SELECT doc_id, len(list_intersect(a, b)) AS k, len(a) + len(b) AS n FROM p WHERE b IS NOT NULL)
        SELECT doc_id, round(CASE WHEN n > k THEN k / (n - k) ELSE 0 END, 6) + 0.0 AS similarity FROM j""",
)
def word_similarity(spark, folder):
    """Similarity of each document to the one before it in its language and source."""
    from ...functions.segments import position_segment, scan

    d = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    words = d.withColumn("a", similarity.word_set(F.col("text"))).drop("text")
    paired = scan(words, ["lang", "source"], ["doc_id"], position_segment("doc_id"), lags={"b": F.col("a")})
    return paired.filter(F.col("b").isNotNull()).select(
        "doc_id", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("similarity")
    )


@query(
    "near_duplicates",
    f"""WITH RECURSIVE d AS (SELECT doc_id, lang AS role, source AS scope, {WORDS_SQL.format(t='text')} AS ws FROM documents),
        w AS (SELECT doc_id, role, scope, unnest(ws) AS t, len(ws) AS n FROM d),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n + b.n) AS n FROM w a
          JOIN w b ON a.t = b.t AND a.role = b.role AND a.scope = b.scope AND b.doc_id < a.doc_id GROUP BY 1, 2),
        e AS (SELECT a, list(b) AS bs FROM c WHERE round(k / (n - k), 9) >= 0.8 GROUP BY a),
        o AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, coalesce(bs, []::BIGINT[]) AS bs
          FROM d LEFT JOIN e ON a = doc_id),
        r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS f, NULL::BIGINT AS doc_id, NULL::BIGINT AS p UNION ALL
          SELECT o.i, CASE WHEN list_has_any(f, bs) THEN f ELSE list_append(f, o.doc_id) END, o.doc_id,
            CASE WHEN list_has_any(f, bs) THEN list_min(list_intersect(f, bs)) ELSE o.doc_id END FROM r JOIN o ON o.i = r.i + 1)
        SELECT role, scope, p AS "primary", r.doc_id AS row_id FROM r JOIN d ON d.doc_id = r.doc_id
        WHERE p IN (SELECT p FROM r GROUP BY p HAVING count(*) > 1)""",
)
def near_duplicates(spark, folder):
    d = table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("role"), F.col("source").alias("scope"),
        F.col("doc_id").alias("ord"), "text",
    )
    return similarity.near_duplicates(spread(d), 0.8)


# --- streams ---------------------------------------------------------------------------


def _drain(arrivals, spark, name, key, run, mode="append", each=None, triggers=4):
    """Run the stream ``run`` makes of ``arrivals``, written and drained one after the other; where it wrote.

    The stream takes a share of an arrival's files per trigger, so the number of triggers doesn't grow with the input.
    """
    path = f"{shared_folder(spark)}/turnwise-{name}-{uuid.uuid4().hex}"
    arrived = f"{path}-arrived"
    files = 0
    for df in arrivals:
        df.repartition(key).write.mode("append").parquet(arrived)
        files, before = len(spark.read.parquet(arrived).inputFiles()), files
        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-(files - before) // triggers)))
        writer = run(reader.parquet(arrived)).writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress")
        writer = writer.foreachBatch(each(path)) if each else writer.format("parquet").option("path", path)
        writer.trigger(availableNow=True).start().awaitTermination()
    return path


@query(
    "stream_pairs",
    f"""WITH {PAIRS_CTE} SELECT CAST(session_id AS VARCHAR) AS session_id, turn_id, turn_idx, question, answer, tag, span_ids FROM pairs""",
)
def stream_pairs(spark, folder):
    """All turns of ``MIXED`` and one closing prompt per session, as an arriving stream without a timeout."""
    turns = MIXED.load(spark, folder)
    closing = turns.groupBy("session_id").agg((F.max("turn_idx") + 1).alias("turn_idx")).select(
        "session_id", "turn_idx", F.lit("prompt").alias("role"), F.lit("bye").alias("text")
    )
    timed = turns.unionByName(closing).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn_idx") * 60)
    )
    arrivals = [timed.filter("turn_idx < 4"), timed.filter("turn_idx >= 4")]
    path = _drain(
        arrivals, spark, "pairs", "session_id", lambda t: t, each=lambda path: streams.pair_writer(path, "answer", timeout_ms=0)
    )
    return streams.read_pairs(spark, path).withColumn("span_ids", F.array_join("span_ids", ","))


@query(
    "stream_evidence",
    f"WITH {EVIDENCE_CTE} SELECT DISTINCT record_id, session_id, topic FROM e",
)
def stream_evidence(spark, folder):
    df = evidence(spark, folder).select("record_id", "session_id", "topic", F.col("ts").cast("timestamp").alias("ts"))
    half = "TIMESTAMP '2024-01-16'"
    arrivals = [df.filter(f"ts < {half}"), df.filter(f"ts >= {half}")]
    path = _drain(
        arrivals, spark, "memory", "record_id", lambda e: streams.stream_evidence(e, "40 days"), each=streams.append_to_memory
    )
    return streams.read_memory(spark, path).drop("ts")


def _usage_stream(spark, folder, **kind):
    """Usage rows as a stream: most on time, a tenth late, and some again when their windows are closed.

    Two rows three months on move the watermark past all windows, one trigger for the windows to close and one for
    what comes after them to be too late.
    """
    df = USAGE.load(spark, folder).withColumns({"ts": F.col("ts").cast("timestamp"), "caller": F.col("event_id") % 7})
    last = df.agg(F.max("ts").alias("t")).select((F.col("t") + F.expr("INTERVAL 90 DAYS")).alias("ts"))
    closing = last.select(
        "ts", F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("outcome"), F.lit(False).alias("truncated"),
        F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(-1).cast("long").alias("caller"),
    )
    late = F.col("event_id") % 10 == 3
    arrivals = [df.filter(~late), df.filter(late), closing.coalesce(1), closing.coalesce(1), df.filter("event_id % 50 = 7")]
    out = spark.read.parquet(
        _drain(arrivals, spark, "windows", "event_id", lambda u: streams.stream_usage(u, watermark="40 days", **kind))
    )
    busy = F.col("calls") + F.col("retries") + F.col("failed_calls") > 0
    return out.filter(busy).drop("end").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_usage",
    f"""SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, {USAGE_SQL}
        FROM ({USAGE.sql}) GROUP BY 1""",
)
def stream_usage(spark, folder):
    return _usage_stream(spark, folder, window="6 hours")


@query(
    "stream_usage_sliding",
    f"""SELECT strftime(time_bucket(INTERVAL '3 hours', ts) - (INTERVAL '3 hours' * k), '%Y-%m-%d %H:%M:%S') AS start, {USAGE_SQL}
        FROM ({USAGE.sql}), (SELECT unnest([0, 1]) AS k) GROUP BY 1""",
)
def stream_usage_sliding(spark, folder):
    return _usage_stream(spark, folder, window="6 hours", slide="3 hours")


@query(
    "stream_usage_sessions",
    f"""WITH u AS (SELECT *, event_id % 7 AS caller FROM ({USAGE.sql})),
        g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL '20 minutes', true) AS fresh FROM u WINDOW w AS (PARTITION BY caller ORDER BY ts, event_id)),
        s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY caller ORDER BY ts, event_id) AS nth FROM g)
        SELECT * EXCLUDE (estimated_cost_usd) FROM (
          SELECT caller, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, {USAGE_SQL} FROM s GROUP BY caller, nth)""",
)
def stream_usage_sessions(spark, folder):
    """Sessions of each caller, which end after twenty minutes without a call; their costs lie halfway between
    four digits too often to be compared."""
    return _usage_stream(spark, folder, session_gap="20 minutes", keys=["caller"]).drop("estimated_cost_usd")
