"""File sources: tables are written in the file's format, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...functions.segments import scan
from ...session import cut_lineage, shared_folder
from ...operators.totals import diagnostic_rates
from ...sources import reference, runs, transcripts
from .base import View, query, table


def _fresh(spark, name):
    return f"{shared_folder(spark)}/turnwise-{name}-{uuid.uuid4().hex}"




@query(
    "scan_transcripts",
    """WITH f AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Participant' ELSE 'Ellie' END AS role,
         CASE WHEN turn = 5 THEN '' ELSE trim(regexp_replace(replace(text, '"', ''''), '\\s+', ' ', 'g')) END AS text FROM conversations WHERE role <> 'system')
       SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx,
         CAST(turn AS DOUBLE) AS start_time, role, text FROM f WHERE text <> ''""",
)
def scan_transcripts(spark, folder):
    """One delimited file per conversation, with three delimiters and a header each."""
    c = table(spark, folder, "conversations")
    flat = F.trim(F.regexp_replace(F.replace("text", F.lit('"'), F.lit("'")), r"(?U)\s+", " "))
    sep = F.element_at(F.lit([",", "\t", ";"]), (F.col("conv_id") % 3 + 1).cast("int"))
    speaker = (
        F.when(F.col("role") == "assistant", "Participant").when(F.col("role") == "user", "Ellie").otherwise("Other")
    )
    said = F.concat(F.lit('"'), F.when(F.col("turn") == 5, "").otherwise(flat), F.lit('"'))

    def line(*cells):
        return F.call_function("concat_ws", sep, *cells)

    body = c.select("conv_id", "turn", line(F.col("turn").cast("string"), F.lit("9.5"), speaker, said).alias("value"))
    head = c.select("conv_id").distinct().select(
        "conv_id",
        F.lit(-1).cast("long").alias("turn"),
        line(F.lit("start_time"), F.lit("stop_time"), F.lit("speaker"), F.lit("value")).alias("value"),
    )
    path = _fresh(spark, "transcripts")
    (
        body.unionByName(head)
        .repartition(4 * spark.sparkContext.defaultParallelism, "conv_id")  # files cost time, so all cores write alike
        .sortWithinPartitions("conv_id", "turn")
        .drop("turn")
        .write.partitionBy("conv_id")
        .text(path)
    )
    # numbering reads the turns more than once
    lines = cut_lineage(transcripts.scan_transcripts(spark, path, r"conv_id=(\d+)/", recursive=True), "turns")
    numbered = scan(lines, ["session_id"], ["block", "line"], F.col("block"), index="turn_idx")
    return numbered.select("session_id", "turn_idx", "start_time", "role", "text")


LABELS = View(
    "labels",
    Participant_ID="concat(CAST(doc_id AS STRING), '.0')",
    PHQ_Score="quality * 7 + toxic",
    PHQ_Binary="toxic",
    PHQ8_Sleep="CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 4 END",
    PHQ8_Tired="quality",
)


@query(
    "scan_labels",
    """SELECT CAST(doc_id AS VARCHAR) AS session_id, quality * 7 + toxic AS total, toxic AS binary,
       concat_ws(',', CASE WHEN doc_id % 3 > 0 THEN 'PHQ8_Sleep=' || doc_id % 4 END, 'PHQ8_Tired=' || quality) AS items FROM labels""",
)
def scan_labels(spark, folder):
    path = _fresh(spark, "labels")
    LABELS.load(spark, folder).write.option("header", True).csv(path)
    shown = F.transform(F.map_entries("items"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return transcripts.scan_labels(spark, path).select(
        "session_id", "total", "binary", F.array_join(F.array_sort(shown), ",").alias("items")
    )


def _samples(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("session_id"),
        F.col("quality").alias("total"),
        F.col("toxic").alias("binary"),
        F.create_map(F.lit("PHQ8_Sleep"), F.col("quality")).alias("items"),
    )
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_idx"), "role", "text"
    )
    return transcripts.build_samples(labels, turns)


@query(
    "build_samples",
    """SELECT CAST(doc_id AS VARCHAR) AS "Participant_ID", count(*) AS turns, quality AS total,
       string_agg(role || ':' || text, '|' ORDER BY turn) AS interview FROM labels JOIN conversations ON doc_id = conv_id
       GROUP BY doc_id, quality""",
)
def build_samples(spark, folder):
    samples, _ = _samples(spark, folder)
    told = F.transform("real_interview", lambda t: F.concat_ws(":", t["roleName"], t["content"]))
    return samples.select(
        "Participant_ID",
        F.size("real_interview").cast("long").alias("turns"),
        F.col("phq8_scores.PHQ8_Score").alias("total"),
        F.array_join(told, "|").alias("interview"),
    )


@query(
    "missing_transcripts",
    "SELECT doc_id AS session_id FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)",
)
def missing_transcripts(spark, folder):
    return _samples(spark, folder)[1]


@query(
    "rejected_labels",
    """SELECT 'x' || doc_id AS raw_id, 'id is no number' AS reason FROM labels WHERE doc_id % 7 = 3""",
)
def rejected_labels(spark, folder):
    """Labels whose ids are numbers, but for every seventh."""
    path = _fresh(spark, "labels")
    raw = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    labels = table(spark, folder, "labels").select(raw.alias("Participant_ID"), F.col("quality").alias("PHQ8_Sleep"))
    labels.write.option("header", True).csv(path)
    return transcripts.rejected_labels(spark, path)


@query(
    "sample_documents",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, role, text
       FROM conversations JOIN labels ON doc_id = conv_id""",
)
def sample_documents(spark, folder):
    path = _fresh(spark, "samples")
    transcripts.write_samples(_samples(spark, folder)[0], path, "train")
    return transcripts.sample_turns(transcripts.read_samples(spark, path)).drop("turn_id")


RUN_SQL = """SELECT user_id, event_type, CAST(sum(event_id) AS BIGINT) AS k FROM events GROUP BY 1, 2"""


def _run_records(spark, folder):
    """Records of both generations: even users newer, odd users older."""
    k = (
        table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.sum("event_id").alias("k"))
    )
    score = F.when(F.col("k") % 7 > 0, F.col("k") % 4).cast("int")
    newer = F.col("user_id") % 2 == 0
    topic = F.struct(
        score.alias("score"),
        F.when(newer, F.col("k") % 5 == 0).alias("abstained"),
        F.when(~newer, F.when(F.col("k") % 3 == 0, "missing").when(F.col("k") % 3 == 1, "known")).alias("evidence_status"),
        F.when(F.col("k") % 13 > 0, F.concat(F.lit("i_"), F.col("event_type"))).alias("item_key"),
    )
    return k.groupBy(F.col("user_id").cast("string").alias("participant_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", topic.alias("t")))).alias("topics"),
        F.sum("k").cast("double").alias("total_predicted_score"),
    )


ASSESSED_SQL = f"""WITH s AS ({RUN_SQL}) SELECT CAST(user_id AS VARCHAR) AS session_id, 'i_' || event_type AS item, k % 4 AS score FROM s
 WHERE k % 7 > 0 AND k % 13 > 0 AND CASE WHEN user_id % 2 = 0 THEN k % 5 > 0 ELSE k % 3 > 0 END"""


def _results(spark, folder):
    path = _fresh(spark, "run")
    _run_records(spark, folder).write.json(path)
    return runs.item_results(runs.read_run(spark, path, multi_line=False))


@query(
    "read_run",
    f"""WITH s AS ({RUN_SQL}) SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS topic,
        CASE WHEN k % 7 > 0 THEN k % 4 END AS score, CASE WHEN user_id % 2 = 0 THEN k % 5 = 0 END AS abstained FROM s""",
)
def read_run(spark, folder):
    return _results(spark, folder).select("session_id", "topic", "score", "abstained")


@query("assessed_items", ASSESSED_SQL)
def assessed_items(spark, folder):
    return runs.assessed_items(_results(spark, folder))


@query(
    "pending",
    "SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)",
)
def pending(spark, folder):
    inputs = table(spark, folder, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return runs.pending(inputs, table(spark, folder, "labels").select(F.col("doc_id").alias("session_id")))


@query(
    "sample_head",
    """WITH i AS (SELECT DISTINCT CASE WHEN conv_id % 9 = 0 THEN 'x' || conv_id ELSE CAST(conv_id AS VARCHAR) END AS session_id FROM conversations)
       SELECT session_id FROM i ORDER BY TRY_CAST(session_id AS BIGINT) NULLS LAST, session_id LIMIT 25""",
)
def sample_head(spark, folder):
    i = F.col("conv_id")
    named = F.when(i % 9 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string"))
    inputs = table(spark, folder, "conversations").select(named.alias("session_id")).distinct()
    return runs.sample_head(inputs, 25)


SUMMARY = View(
    "orders",
    session_id="o_orderkey",
    initial="CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 19 END",
    predicted="CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 25 END",
    reference="CASE WHEN o_custkey % 13 > 0 THEN o_orderkey % 25 END",
)
SUMMARY_CTE = f"""s AS (SELECT *, predicted IS NOT NULL AND reference IS NOT NULL AS scored, abs(predicted - reference) AS absolute_difference,
  predicted >= 10 AS predicted_binary, reference >= 10 AS reference_binary FROM ({SUMMARY.sql}))"""


def _summary(spark, folder):
    """The two files of a batch's summary, written and read back."""
    sessions = runs.session_summary(SUMMARY.load(spark, folder))
    path = _fresh(spark, "summary")
    runs.write_summary(runs.batch_summary(sessions), sessions, path)
    return path


@query("session_summary", f"WITH {SUMMARY_CTE} SELECT * FROM s")
def session_summary(spark, folder):
    schema = (
        "session_id long, initial long, predicted long, reference long, scored boolean, absolute_difference long, "
        "predicted_binary boolean, reference_binary boolean"
    )
    return spark.read.schema(schema).option("header", True).csv(f"{_summary(spark, folder)}/sessions")


@query(
    "batch_summary",
    f"""WITH {SUMMARY_CTE} SELECT count(*) FILTER (WHERE scored) AS scored, round(avg(absolute_difference) FILTER (WHERE scored), 6) AS mae,
        round(avg(CASE WHEN predicted_binary = reference_binary THEN 1.0 ELSE 0.0 END) FILTER (WHERE scored), 6) AS binary_agreement,
        count(*) FILTER (WHERE NOT scored) AS unscored FROM s""",
)
def batch_summary(spark, folder):
    schema = "scored long, mae double, binary_agreement double, unscored long"
    return spark.read.schema(schema).json(f"{_summary(spark, folder)}/metrics")


def _full_summary(spark, folder):
    sessions = runs.session_summary(SUMMARY.load(spark, folder))
    topics = DIAGNOSED.load(spark, folder)
    path = _fresh(spark, "full-summary")
    runs.write_summary(runs.full_summary(sessions, diagnostic_rates(topics)), sessions, path)
    return path


DIAGNOSED = View(
    "orders", known="o_orderkey % 9", missing="8 - o_orderkey % 9", citation_mismatches="o_custkey % 3", low_faithfulness="o_custkey % 2"
)


@query(
    "write_summary",
    f"""WITH {SUMMARY_CTE}, c AS (SELECT count(*) AS total_samples, count(*) FILTER (WHERE scored) AS scored_samples,
          count(*) FILTER (WHERE NOT scored) AS unscored_samples FROM s),
        m AS (SELECT round(avg(abs(predicted - reference)), 4) AS mae, round(sqrt(avg((predicted - reference) ** 2)), 4) AS rmse,
          round(corr(predicted, reference), 4) AS pearson_r, count(*) FILTER (WHERE predicted >= 10 AND reference >= 10) AS tp,
          count(*) FILTER (WHERE predicted >= 10 AND reference < 10) AS fp, count(*) FILTER (WHERE predicted < 10 AND reference < 10) AS tn,
          count(*) FILTER (WHERE predicted < 10 AND reference >= 10) AS fn FROM s WHERE scored),
        d AS (SELECT CAST(sum(known + missing) AS DOUBLE) AS total_topic_assessments, round(sum(known) / sum(known + missing), 4) AS evidence_coverage_rate,
          round(sum(citation_mismatches) / sum(known + missing), 4) AS citation_mismatch_rate,
          round(sum(low_faithfulness) / sum(known + missing), 4) AS low_faithfulness_rate FROM ({DIAGNOSED.sql}))
        SELECT c.*, m.*, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision,
          round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, d.* FROM c, m, d""",
)
def write_summary(spark, folder):
    counts = "total_samples long, scored_samples long, unscored_samples long, mae double, rmse double, pearson_r double"
    binary = "tp long, fp long, tn long, fn long, accuracy double, precision double, recall double, f1 double"
    rates = "total_topic_assessments double, evidence_coverage_rate double, citation_mismatch_rate double, low_faithfulness_rate double"
    return spark.read.schema(f"{counts}, {binary}, {rates}").json(f"{_full_summary(spark, folder)}/metrics")


@query("unscored_sessions", f"WITH {SUMMARY_CTE} SELECT session_id FROM s WHERE NOT scored")
def unscored_sessions(spark, folder):
    return spark.read.schema("session_id long").json(f"{_full_summary(spark, folder)}/unscored")


EDGE_ROWS = View(
    "part",
    tag="concat('tag', CAST(p_partkey AS STRING))",
    key="p_partkey",
    topic="CASE p_partkey % 4 WHEN 0 THEN 'sleep' WHEN 1 THEN 'mood' WHEN 2 THEN 'energy' ELSE 'CROSS_CUTTING' END",
    relation="CASE p_size % 3 WHEN 0 THEN 'probe' WHEN 1 THEN 'reverse' ELSE 'context' END",
    strength="CASE WHEN p_size % 2 = 0 THEN 'direct' ELSE 'indirect' END",
)
SETTING_TOPICS = ["sleep", "mood", "energy"]


@query(
    "settings_edges",
    f"""WITH e AS ({EDGE_ROWS.sql}) SELECT tag, ord, CASE WHEN ord = 0 THEN topic ELSE 'mood' END AS topic, relation,
        CASE WHEN ord = 0 THEN strength ELSE 'direct' END AS strength FROM e, (SELECT unnest([0, 1]) AS ord) WHERE ord = 0 OR key % 3 = 0""",
)
def settings_edges(spark, folder):
    """A tag map with a line for each tag of ``part``, written, read back and checked in the plan."""
    first = F.struct("topic", "relation", "strength")
    second = F.struct(F.lit("mood").alias("topic"), "relation", F.lit("direct").alias("strength"))
    listed = F.when(F.col("key") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    lines = EDGE_ROWS.load(spark, folder).select(F.to_json(F.struct(F.create_map("tag", listed).alias("tags"))).alias("value"))
    path = _fresh(spark, "edges")
    lines.write.text(path)
    topics = spark.createDataFrame([(t,) for t in SETTING_TOPICS], "topic string")
    return reference.read_edges(spark, path, topics).withColumn("ord", F.col("ord").cast("int"))


@query("settings_queries", "SELECT p_name AS topic, o AS ord, p_brand || ' ' || o AS query FROM part, (SELECT unnest([0, 1, 2]) AS o) QUALIFY row_number() OVER (PARTITION BY p_name, o ORDER BY p_partkey) = 1")
def settings_queries(spark, folder):
    """Seed queries with a topic for each name of ``part``, which are the topics they are checked against."""
    part = table(spark, folder, "part")
    first = part.groupBy(F.col("p_name").alias("topic")).agg(F.min_by("p_brand", "p_partkey").alias("brand"))
    texts = F.array(*(F.concat("brand", F.lit(f" {i}")) for i in range(3)))
    path = _fresh(spark, "queries")
    first.select(F.to_json(F.create_map("topic", texts)).alias("value")).write.text(path)
    return reference.read_queries(spark, path, first.select("topic"))
