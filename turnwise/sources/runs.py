"""Run records of both generations, pending inputs and batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import binary_metrics, regression_metrics

_TOPIC = (
    "struct<score:int,abstained:boolean,present:string,frequency_basis:string,summary:string,"
    "quote:string,quote_grounded:boolean,parse_failed:boolean,rounds:int,item_key:string,"
    "evidence_tier:string,evidence_status:string,evidence_turn_ids:array<string>,"
    "retrieved_turn_ids:array<string>,citation_mismatch:boolean,low_faithfulness:boolean,"
    "grounding_overridden:boolean,faithfulness_capped:boolean,queries_issued:array<string>,"
    "evidence_text:string,imputed_score:double,acquisition_trace:array<struct<round_index:int,"
    "tier_before:string,resolved_before:boolean,tier_after:string,resolved_after:boolean,"
    "queries_tried:array<string>>>>"
)

#: Fields of both record generations; a field a file lacks is null.
RUN_SCHEMA = (
    "participant_id string, total_predicted_score double, raw_total_score double, "
    "calibrated_total_score double, ground_truth_total double, ground_truth_items map<string,int>, "
    f"assessment_valid boolean, parse_failure_count int, topics map<string,{_TOPIC}>, "
    "parse_failures array<struct<stage:string,reason:string>>, "
    "criterion_map array<struct<criterion:string,status:string,score:int,contradiction:boolean>>"
)


def read_run(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run records from ``*_evaluation.json`` files, or line-wise JSON with ``multi_line=False``."""
    reader = spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line)
    if multi_line:
        reader = reader.option("pathGlobFilter", "*_evaluation.json")
    return reader.json(path)


def item_results(records: DataFrame) -> DataFrame:
    """One row per (session, topic) of run records."""
    return records.select(
        F.col("participant_id").alias("session_id"), F.explode("topics").alias("topic", "t")
    ).select("session_id", "topic", "t.*")


def is_assessed() -> Column:
    """Scored from evidence: records with ``abstained`` say so, older ones by their status."""
    older = F.col("abstained").isNull()
    known = F.coalesce(F.col("evidence_status") == "known", F.lit(True))
    return F.col("score").isNotNull() & F.when(older, known).otherwise(~F.col("abstained"))


def assessed_items(results: DataFrame) -> DataFrame:
    """Assessed items ``(session_id, item, score)`` of both record generations."""
    return results.filter(
        is_assessed() & F.col("item_key").isNotNull() & (F.col("item_key") != "")
    ).select("session_id", F.col("item_key").alias("item"), "score")


def trace_rounds(results: DataFrame) -> DataFrame:
    """Acquisition rounds of item results, one row each."""
    return results.select("session_id", "topic", F.explode("acquisition_trace").alias("r")).select(
        "session_id",
        "topic",
        "r.round_index",
        "r.tier_before",
        "r.tier_after",
        "r.resolved_before",
        "r.resolved_after",
        F.col("r.queries_tried").alias("queries"),
    )


def pending(inputs: DataFrame, done: DataFrame, key: str = "session_id") -> DataFrame:
    """Inputs without a result yet."""
    return inputs.join(done.select(key), key, "left_anti")


def sample_head(inputs: DataFrame, n: int, key: str = "session_id") -> DataFrame:
    """The first ``n`` inputs, numeric ids in number order before other ids."""
    number = F.col(key).try_cast("bigint")
    return inputs.orderBy(number.asc_nulls_last(), F.col(key)).limit(n)


def session_summary(records: DataFrame, threshold: int = 10) -> DataFrame:
    """Per session of a run: predicted and true total, their difference, both sides of ``threshold``.

    ``records`` is ``(session_id, predicted, reference)``, with ``initial`` where totals were revised; a session
    without both totals is not ``scored``.
    """
    both = F.col("predicted").isNotNull() & F.col("reference").isNotNull()
    return records.select(
        "session_id",
        *(["initial"] if "initial" in records.columns else []),
        "predicted",
        "reference",
        both.alias("scored"),
        F.abs(F.col("predicted") - F.col("reference")).alias("absolute_difference"),
        (F.col("predicted") >= threshold).alias("predicted_binary"),
        (F.col("reference") >= threshold).alias("reference_binary"),
    )


def batch_summary(sessions: DataFrame) -> DataFrame:
    """One row over ``session_summary``: how many sessions are scored, their error, their binary agreement.

    The unscored ids are the rows of ``sessions`` that are not ``scored``.
    """
    scored = sessions.filter("scored")
    agree = F.col("predicted_binary") == F.col("reference_binary")
    return scored.agg(
        F.count("*").alias("scored"),
        F.round(F.avg("absolute_difference"), 6).alias("mae"),
        F.round(F.avg(agree.cast("double")), 6).alias("binary_agreement"),
    ).join(sessions.agg(F.count_if(~F.col("scored")).alias("unscored")))


def full_summary(sessions: DataFrame, diagnostics: DataFrame, threshold: int = 10) -> DataFrame:
    """One row: sample counts, regression and binary metrics of the scored sessions, and the evidence ``diagnostics``.

    ``sessions`` is ``session_summary``, ``diagnostics`` one row, such as ``totals.diagnostic_rates``.
    """
    scored = sessions.filter("scored").select("predicted", "reference")
    counts = sessions.agg(
        F.count("*").alias("total_samples"), F.count_if("scored").alias("scored_samples"), F.count_if(~F.col("scored")).alias("unscored_samples")
    )
    return counts.join(regression_metrics(scored).drop("n")).join(binary_metrics(scored, threshold)).join(diagnostics)


def write_summary(summary: DataFrame, sessions: DataFrame, path: str) -> None:
    """Batch summary: the one-row ``summary`` as JSON, the sessions as CSV, and the ids of the unscored ones as JSON lines.

    Unscored ids stay rows of a file of their own, as they may be as many as the sessions.
    """
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    sessions.write.mode("overwrite").option("header", True).csv(f"{path}/sessions")
    if "scored" in sessions.columns:
        sessions.filter(~F.col("scored")).select("session_id").write.mode("overwrite").json(f"{path}/unscored")
