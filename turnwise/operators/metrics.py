"""Evaluation metrics of predicted against reference totals and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Correlation; 0 for fewer than two rows or no spread (``corr`` fails there)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))
    return F.coalesce(F.when(F.count(x) >= 2, r), F.lit(0.0))


def total_mae(results: DataFrame) -> DataFrame:
    """Mean error over completed valid rows; fails on no such row or mixed budgets.

    ``results`` is ``(predicted, reference, question_budget, failed, invalid_reason)``.
    """
    valid = ~F.col("failed") & F.col("invalid_reason").isNull()
    valid = valid & F.col("predicted").isNotNull() & F.col("reference").isNotNull()
    stats = results.agg(
        F.avg(F.when(valid, F.abs(F.col("predicted") - F.col("reference")))).alias("mae"),
        F.count_if(valid).alias("completed"),
        F.count_if("failed").alias("failed"),
        F.count_if(F.col("invalid_reason").isNotNull()).alias("invalid"),
        F.min("question_budget").alias("__lo"),
        F.max("question_budget").alias("__hi"),
    )
    checked = (
        F.when(F.col("__lo") != F.col("__hi"), F.raise_error(F.lit("unmatched question budgets")))
        .when(F.col("completed") == 0, F.raise_error(F.lit("no completed valid result")))
        .otherwise(F.col("mae"))
    )
    return stats.select(checked.cast("double").alias("mae"), "completed", "failed", "invalid")


def regression_metrics(pairs: DataFrame) -> DataFrame:
    err = F.col("predicted") - F.col("reference")
    return pairs.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.abs(err)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"),
        F.round(pearson("predicted", "reference"), 4).alias("pearson_r"),
    )


def binary_metrics(pairs: DataFrame, cutoff: float = 10) -> DataFrame:
    p, r = F.col("predicted") >= cutoff, F.col("reference") >= cutoff
    counts = pairs.agg(
        F.count_if(p & r).alias("tp"),
        F.count_if(p & ~r).alias("fp"),
        F.count_if(~p & ~r).alias("tn"),
        F.count_if(~p & r).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "tp",
        "fp",
        "tn",
        "fn",
        F.round(_ratio(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        F.round(_ratio(tp, tp + fp), 4).alias("precision"),
        F.round(_ratio(tp, tp + fn), 4).alias("recall"),
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
    )


def item_metrics(predicted: DataFrame, references: DataFrame) -> DataFrame:
    """Per item the mean error and exact agreement, where both values exist."""
    both = (
        predicted.filter(F.col("score").isNotNull())
        .join(references.filter(F.col("value").isNotNull()), ["session_id", "item"])
    )
    return both.groupBy("item").agg(
        F.round(F.avg(F.abs(F.col("score") - F.col("value"))), 4).alias("mae"),
        F.round(F.avg((F.col("score") == F.col("value")).cast("double")), 4).alias("accuracy"),
        F.count("*").alias("n"),
    )


def spread_ratio(pairs: DataFrame, collapse_below: float = 0.6) -> DataFrame:
    stats = pairs.agg(
        F.stddev_pop("predicted").alias("predicted_sd"), F.stddev_pop("reference").alias("reference_sd")
    )
    ratio = _ratio(F.col("predicted_sd"), F.col("reference_sd"))
    return stats.select(
        "predicted_sd", "reference_sd", ratio.alias("spread"), (ratio < collapse_below).alias("collapsed")
    )


def banded_bias(pairs: DataFrame) -> DataFrame:
    band = F.lit(None).cast("string")
    for low, high, name in reversed(K.BIAS_BANDS):
        band = F.when(F.col("reference").between(low, high), name).otherwise(band)
    return (
        pairs.withColumn("band", band)
        .filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count("*").alias("n"),
            F.avg(F.col("predicted") - F.col("reference")).alias("bias"),
            F.avg("predicted").alias("mean_predicted"),
            F.avg("reference").alias("mean_reference"),
        )
    )


def oracle_split(items: DataFrame, references: DataFrame, totals: DataFrame) -> DataFrame:
    """Error left when unassessed items take their reference value.

    ``items`` is ``(session_id, item, score, assessed)``, ``references``
    ``(session_id, item, value)``, ``totals`` ``(session_id, predicted, reference)``.
    """
    value = F.when(F.col("assessed"), F.col("score")).otherwise(F.coalesce("value", F.lit(0)))
    filled = (
        items.join(references, ["session_id", "item"], "left")
        .groupBy("session_id")
        .agg(
            F.sum(value).cast("double").alias("oracle"),
            F.count_if("assessed").alias("assessed"),
            F.count("*").alias("items"),
        )
    )
    joined = totals.join(filled, "session_id")
    mae = F.avg(F.abs(F.col("predicted") - F.col("reference")))
    oracle_mae = F.avg(F.abs(F.col("oracle") - F.col("reference")))
    return joined.agg(
        mae.alias("mae"),
        oracle_mae.alias("oracle_mae"),
        pearson("oracle", "reference").alias("oracle_r"),
        (mae - oracle_mae).alias("acquisition_share"),
        _ratio(F.sum("assessed"), F.sum("items")).alias("assessed_share"),
    )


def compare_runs(*summaries: DataFrame) -> DataFrame:
    """Union of run summaries ordered by split and method."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.orderBy("split", "method")


def usage_totals(usage: DataFrame, input_cost_per_1m: float, output_cost_per_1m: float) -> DataFrame:
    """Calls, retries, failures, truncations, tokens and cost of recorded calls."""
    cost = F.sum("input_tokens") * input_cost_per_1m + F.sum("output_tokens") * output_cost_per_1m
    return usage.agg(*usage_columns(cost))


def usage_columns(cost: Column) -> list[Column]:
    call = F.col("outcome") == "call"
    return [
        F.count_if(call).alias("calls"),
        F.count_if(F.col("outcome") == "retry").alias("retries"),
        F.count_if(F.col("outcome") == "failure").alias("failed_calls"),
        F.count_if(call & F.col("truncated")).alias("truncated_generations"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(cost / 1_000_000, 4).alias("estimated_cost_usd"),
    ]
