"""Growing inputs: pairs, evidence and usage as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segments import SEGMENT_ROWS
from ..operators.metrics import usage_columns
from ..operators.turns import pair_turns
from ..session import cut_lineage

#: Parts of the memory table, by a hash of the record id.
PREFIXES = 256


def pair_writer(
    path: str,
    participant_role: str,
    watermark_ms: int = 3_600_000,
    timeout_ms: int = 3_600_000,
    segment_rows: int = SEGMENT_ROWS,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the question-answer pairs of an arriving turn stream.

    ``turns`` is ``(session_id, turn_idx, role, text, ts)``; the turns of a session arrive in order from one
    trigger to the next, and those without a session or an index are left out. A pair leaves when the next prompt
    arrives, or when the session has been silent for ``timeout_ms`` of event time (0: never), measured at
    ``watermark_ms`` before the latest turn seen. Pairs are those of ``pair_turns``, which does the work on a
    trigger's turns and the turns carried over: the last prompt of each open session and the answers since.

    Each trigger writes its pairs, the clock and the turns it carries on into folders of its own number and
    reads those of the one before; so a trigger that is repeated writes the same again. ``read_pairs`` reads the
    pairs. Folders of old carried turns are not deleted; give them a retention rule.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        turns = batch.select("session_id", "turn_idx", "role", "text", "ts")
        turns = turns.filter("session_id IS NOT NULL AND turn_idx IS NOT NULL")
        clock = turns.agg(F.unix_millis(F.max("ts")).alias("high"))
        if batch_id:
            turns = turns.unionByName(spark.read.parquet(f"{path}/open/{batch_id - 1}"))
            clock = clock.union(spark.read.parquet(f"{path}/clock/{batch_id - 1}")).agg(F.max("high").alias("high"))
        clock = cut_lineage(clock, "clock")  # one row
        high = clock.first().high
        prompt = F.when(F.col("role") != participant_role, F.col("turn_idx"))
        sessions = turns.groupBy("session_id").agg(
            F.max(prompt).alias("last_prompt"), F.unix_millis(F.max("ts")).alias("last_ms")
        )
        silent = F.lit(bool(timeout_ms)) & (F.col("last_ms") + (timeout_ms + watermark_ms) < F.lit(high))
        ended = F.coalesce(silent, F.lit(False))
        over = ended | F.coalesce(F.col("turn_idx") < F.col("last_prompt"), F.lit(False))
        judged = cut_lineage(turns.join(sessions, "session_id").withColumn("over", over), "turns")
        closed = judged.filter("over").drop("over", "last_prompt", "last_ms")
        pairs = pair_turns(closed, participant_role, segment_rows=segment_rows)
        pairs.withColumn("session_id", F.col("session_id").cast("string")).write.mode("overwrite").parquet(
            f"{path}/pairs/batch={batch_id}"
        )
        clock.write.mode("overwrite").parquet(f"{path}/clock/{batch_id}")
        carried = judged.filter("NOT over").select("session_id", "turn_idx", "role", "text", "ts")
        carried.write.mode("overwrite").parquet(f"{path}/open/{batch_id}")

    return write


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The pairs that ``pair_writer`` has written."""
    return spark.read.parquet(f"{path}/pairs").drop("batch")


def stream_evidence(evidence: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Evidence whose record id did not arrive before within the watermark.

    Append the result with ``append_to_memory`` to stay idempotent beyond it.
    """
    return evidence.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["record_id"])


def with_prefix(records: DataFrame) -> DataFrame:
    return records.withColumn("prefix", F.pmod(F.xxhash64("record_id"), F.lit(PREFIXES)).cast("int"))


def unheld(arrived: DataFrame, memory: DataFrame) -> DataFrame:
    """Arrived records, with their prefix, that ``memory`` lacks; only the prefixes that arrived are read."""
    asked = [r.prefix for r in arrived.select("prefix").distinct().collect()]  # PREFIXES at most
    held = memory.filter(F.col("prefix").isin(asked)).select("prefix", "record_id")
    return arrived.join(held, ["prefix", "record_id"], "left_anti")


def append_to_memory(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: appends the records that the memory table does not hold, each id once.

    The table is partitioned by a hash of the id, so that a trigger reads the parts its ids can be in. Finished
    triggers are listed beside it and skipped when they come again; one that ended between the
    two finds its own records held. Records without an id are left out. ``read_memory`` reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _table(spark, f"{path}/batches")
        if done is not None and done.filter(F.col("batch") == batch_id).count():
            return
        arrived = with_prefix(batch.filter("record_id IS NOT NULL").dropDuplicates(["record_id"]))
        arrived = cut_lineage(arrived, "arrived")
        memory = _table(spark, f"{path}/records")
        new = arrived if memory is None else unheld(arrived, memory)
        new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{path}/records")
        mark = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch"))
        mark.write.mode("append").parquet(f"{path}/batches")

    return write


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``append_to_memory`` has written."""
    return spark.read.parquet(f"{path}/records").drop("prefix")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stream_usage(
    usage: DataFrame,
    window: str = "1 hour",
    slide: str | None = None,
    session_gap: str | None = None,
    watermark: str = "1 hour",
    input_cost_per_1m: float = 0.15,
    output_cost_per_1m: float = 0.60,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Usage per tumbling, sliding (``slide``) or session (``session_gap``) window, for each value of ``keys``.

    Rows that come at most ``watermark`` late are counted and may join two sessions to one. As a stream, a
    session window needs a key: without one every row could join all sessions.
    """
    if session_gap:
        over = F.session_window("ts", session_gap)
    elif slide:
        over = F.window("ts", window, slide)
    else:
        over = F.window("ts", window)
    cost = F.sum("input_tokens") * input_cost_per_1m + F.sum("output_tokens") * output_cost_per_1m
    return (
        usage.withWatermark("ts", watermark)
        .groupBy(*keys, over.alias("w"))
        .agg(*usage_columns(cost))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("*"))
        .drop("w")
    )
