"""Imputation and calibration fits as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.segments import SEGMENT_ROWS, scan, scan_by_depth
from .totals import clamp


def _line(pairs: DataFrame) -> DataFrame:
    """Least squares per item over ``(item, x, y)``; rows with null x only add to the base.

    Fewer than three points or no spread in x give slope 0 at the mean of y.
    """
    x = F.col("x")
    has = x.isNotNull()
    y = F.when(has, F.col("y"))
    fit = pairs.groupBy("item").agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.avg(y).alias("my"),
        F.avg(x).alias("mx"),
        F.avg("y").alias("base_rate"),
        F.count("y").alias("support"),
    )
    flat = (F.col("n") < 3) | F.coalesce(F.col("sxx") <= 1e-9, F.lit(True))
    slope = F.when(flat, 0.0).otherwise(F.try_divide(F.col("sxy"), F.col("sxx")))
    return fit.select(
        "item",
        F.coalesce(F.col("my") - slope * F.coalesce("mx", F.lit(0.0)), F.lit(0.0)).alias("intercept"),
        slope.alias("slope"),
        "base_rate",
        "support",
    )


def fit_impute_refs(labels: DataFrame) -> DataFrame:
    """Each item against the mean of the session's other items.

    ``labels`` is ``(session_id, item, value)``, unique, without nulls; a session has
    as many rows as there are items, so the window group is small by definition.
    """
    session = W.partitionBy("session_id")
    others = F.count("*").over(session) - 1
    x = F.when(others > 0, (F.sum("value").over(session) - F.col("value")) / others)
    return _line(labels.select("item", x.cast("double").alias("x"), F.col("value").cast("double").alias("y")))


def fit_impute_run(assessed: DataFrame, labels: DataFrame) -> DataFrame:
    """Each item's reference against the assessed mean, where the item was not assessed.

    ``assessed`` is ``(session_id, item, score)``. With fewer than three such sessions
    the fit is the base rate over all references.
    """
    per_session = assessed.groupBy("session_id").agg(
        F.collect_set("item").alias("own"), F.avg("score").alias("mean_score")
    )
    joined = labels.join(per_session, "session_id", "left")
    missing = ~F.coalesce(F.array_contains("own", F.col("item")), F.lit(False))
    y = F.col("value").cast("double")
    line = _line(joined.filter(missing).select("item", F.col("mean_score").alias("x"), y.alias("y")))
    base = labels.groupBy("item").agg(F.avg(y).alias("all_mean"), F.count("*").alias("all_n"))
    few = F.coalesce(F.col("support"), F.lit(0)) < 3
    return base.join(line, "item", "left").select(
        "item",
        F.when(few, F.col("all_mean")).otherwise(F.col("intercept")).alias("intercept"),
        F.when(few, 0.0).otherwise(F.col("slope")).alias("slope"),
        F.when(few, F.col("all_mean")).otherwise(F.col("base_rate")).alias("base_rate"),
        F.when(few, F.col("all_n")).otherwise(F.col("support")).alias("support"),
    )


def exact_median(values: DataFrame, group: str, value: str, weight: str, width: float = 0.25) -> DataFrame:
    """Exact weighted median per group, without sorting a group in one task.

    Equal values are merged first; the merged values are ranked in buckets of ``width``,
    so only bucket totals are ordered across a whole group.
    """
    merged = values.groupBy(group, value).agg(F.sum(weight).alias("w"))
    ranked = scan(
        merged, [group], [value], F.floor(F.col(value) / width), sums={"upto": F.col("w")}
    )
    total = merged.groupBy(group).agg(F.sum("w").alias("total"))
    low = F.floor((F.col("total") - 1) / 2)
    high = F.floor(F.col("total") / 2)
    first = F.col("upto") - F.col("w")

    def at(k: Column) -> Column:
        return F.max(F.when((first <= k) & (k < F.col("upto")), F.col(value)))

    return (
        ranked.join(total, group)
        .groupBy(group)
        .agg(((at(low) + at(high)) / 2.0).alias("median"))
    )


def fit_calibrator_mae(totals: DataFrame, slope_grid: int = 401, max_slope: float = 4.0) -> DataFrame:
    """Best slope of a grid with the median residual as intercept, by mean error.

    ``totals`` is ``(predicted, reference)``. Equal pairs are counted once with a
    weight before the grid is laid over them: totals take few distinct values.
    """
    pairs = totals.groupBy(
        F.col("predicted").cast("double").alias("p"), F.col("reference").cast("double").alias("r")
    ).agg(F.count("*").alias("w"))
    grid = pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(slope_grid - 1))))
    slope = F.lit(max_slope) * F.col("step") / F.lit(slope_grid - 1)
    grid = grid.withColumn("slope", slope).withColumn("res", F.col("r") - F.col("slope") * F.col("p"))
    medians = exact_median(grid, "step", "res", "w")
    fitted = clamp(F.col("median") + F.col("slope") * F.col("p"), 0.0, K.TOTAL_MAX)
    errors = (
        grid.join(medians, "step")
        .groupBy("step")
        .agg(
            (F.sum(F.abs(fitted - F.col("r")) * F.col("w")) / F.sum("w")).alias("error"),
            F.any_value("slope").alias("slope"),
            F.any_value("median").alias("intercept"),
        )
    )
    best = F.struct(F.round("error", 9), "step")
    return errors.agg(
        F.min_by("intercept", best).alias("intercept"),
        F.min_by("slope", best).alias("slope"),
        F.min_by("error", best).alias("error"),
    )


def fit_calibrator_spread(totals: DataFrame) -> DataFrame:
    """Match mean and population spread of the references."""
    stats = totals.agg(
        F.stddev_pop("predicted").alias("sp"),
        F.stddev_pop("reference").alias("sr"),
        F.avg("predicted").alias("mp"),
        F.avg("reference").alias("mr"),
    )
    slope = F.when(F.col("sp") <= 1e-9, 0.0).otherwise(F.try_divide(F.col("sr"), F.col("sp")))
    return stats.select((F.col("mr") - slope * F.col("mp")).alias("intercept"), slope.alias("slope"))


def fit_calibrator_identity(totals: DataFrame) -> DataFrame:
    return totals.agg(F.lit(0.0).alias("intercept"), F.lit(1.0).alias("slope"))


def median_floor(train: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The train median as a constant predictor and its mean error.

    Both sides are counted by distinct total first.
    """
    counted = train.groupBy(F.col("reference").cast("double").alias("v")).agg(F.count("*").alias("w"))
    median = exact_median(counted.withColumn("g", F.lit(0)), "g", "v", "w").select("median").scalar()
    return evaluated.agg(
        F.first(median).alias("floor"), F.avg(F.abs(F.col("reference") - median)).alias("floor_mae")
    )


def stratified_shots(labels: DataFrame, k: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``k`` sessions at evenly spaced ranks of ``(total, session_id)``.

    ``labels`` is ``(session_id, total)``. Rows are numbered in segments of about ``segment_rows`` rows.
    """
    ordered = scan_by_depth(labels, [], ["total", "session_id"], segment_rows, index="shot_rank")
    n = labels.agg(F.count("*").alias("n")).scalar()
    wanted = [
        F.bround((n - 1) * F.lit(float(i)) / F.lit(max(k - 1, 1)), 0).cast("long") for i in range(k)
    ]
    return ordered.filter((n <= k) | F.col("shot_rank").isin(*wanted))
