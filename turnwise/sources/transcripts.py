"""Transcript and label files, and the nested sample documents made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.segments import position_segment, scan
from ..functions.text import let, strip
from ..operators.turns import turn_id
from ..session import cut_lineage

#: Turns of one nested document; longer sessions are written in numbered parts.
PART_TURNS = 100_000

SAMPLE_SCHEMA = (
    "Participant_ID string, part long, first_turn long, real_interview array<struct<roleName string, content string>>, "
    "phq8_scores struct<PHQ8_Score int, PHQ8_Binary int, items map<string,int>>"
)


def _delimiter(header: Column) -> Column:
    """The most frequent of comma, tab and semicolon in the header line."""

    def n(d: str) -> Column:
        return F.length(header) - F.length(F.replace(header, F.lit(d), F.lit("")))

    return (
        F.when((n("\t") >= n(",")) & (n("\t") >= n(";")), "\t")
        .when(n(";") > n(","), ";")
        .otherwise(",")
    )


def _cells(line: Column, delimiter: Column) -> Column:
    """Fields of a delimited line, as many as there are; doubled quotes in a quoted field are one."""

    def cell(c: Column) -> Column:
        body = F.substring(c, F.lit(2), F.length(c))
        inner = F.regexp_extract(body, r'(?s)^\x20*"(.*)"\s*$', 1)
        quoted = body.rlike(r'(?s)^\x20*".*"\s*$')
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(body)

    def parsed(sep: str) -> Column:
        quoted = rf'{sep}\x20*"[^"]*+(?:""[^"]*+)*+"[^{sep}]*'
        # a delimiter in front makes every field, also an empty one, a match of its own
        pieces = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf"{quoted}|{sep}[^{sep}]*"), F.lit(0))
        return F.transform(pieces, cell)

    return F.when(delimiter == "\t", parsed("\t")).when(delimiter == ";", parsed(";")).otherwise(parsed(","))


def _opens(line: Column, delimiter: Column) -> Column:
    """1 if the last field of the line opens with a quote that isn't closed in it, else 0."""

    def parsed(sep: str) -> Column:
        quoted = rf'{sep}\x20*"[^"]*+(?:""[^"]*+)*+"[^{sep}]*'
        unclosed = rf'{sep}\x20*"[^"]*+(?:""[^"]*+)*+\z'
        pieces = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf"{quoted}|{unclosed}|{sep}[^{sep}]*"), F.lit(0))
        return F.element_at(pieces, -1).rlike(unclosed).cast("int")

    return F.when(delimiter == "\t", parsed("\t")).when(delimiter == ";", parsed(";")).otherwise(parsed(","))


def _heads(lines: DataFrame) -> DataFrame:
    """``(session_id, header, sep)``: the first line of each file and its delimiter."""
    first = lines.groupBy("session_id").agg(F.min_by("value", F.struct("block", "line")).alias("header"))
    return cut_lineage(first.withColumn("sep", _delimiter(F.col("header"))), "heads")


def _records(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines joined where a quoted field runs on into the next line; ``heads`` has the delimiters.

    Only files that have a line with an open field take part. A line keeps the state (in a quoted
    field or not), turns it round or sets it; the state after a line is the last one set, turned round
    as often as since then, which is carried from block to block of a file. Lines of a record that
    is never closed stay lines of their own. Where no file has such a line, all are left as they are.
    """
    quote = F.col("value").contains('"')
    told = lines.join(heads.select("session_id", F.col("sep").alias("__d")), "session_id")
    told = told.withColumn("__o", F.when(quote, _opens(F.col("value"), F.col("__d"))).otherwise(0))
    torn = cut_lineage(told.filter("__o = 1").select("session_id").distinct(), "torn")
    if torn.isEmpty():
        return lines
    whole = lines.join(torn, "session_id", "left_anti")
    # the same for a line that begins inside a quoted field
    inside = F.when(quote, _opens(F.concat(F.lit('"'), F.col("value")), F.col("__d"))).otherwise(1)
    told = cut_lineage(told.join(torn, "session_id", "left_semi").withColumn("__i", inside), "told")
    keys, order = ["session_id"], ["block", "line"]
    turns = ((F.col("__o") == 1) & (F.col("__i") == 0)).cast("long")
    turned = cut_lineage(scan(told, keys, order, F.col("block"), sums={"__n": turns}), "turned")
    put = F.when(F.col("__o") == F.col("__i"), (F.col("__o") + F.col("__n")) % 2)
    kept = cut_lineage(scan(turned, keys, order, F.col("block"), lasts={"__s": put}), "kept")
    closed = ((F.coalesce("__s", F.lit(0)) + F.col("__n")) % 2 == 0).cast("long")
    numbered = scan(kept.withColumn("__c", closed), keys, order, F.col("block"), sums={"__r": F.col("__c")})
    # records closed before the line
    numbered = cut_lineage(numbered.withColumn("__r", F.col("__r") - F.col("__c")), "numbered")
    ends = numbered.groupBy("session_id").agg(F.sum("__c").alias("__e"))
    numbered = numbered.join(ends, "session_id")
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = numbered.filter("__r < __e").groupBy("session_id", "__r").agg(parts.alias("x")).select(
        "session_id", F.col("x")[0]["block"].alias("block"), F.col("x")[0]["line"].alias("line"),
        F.array_join(F.transform("x", lambda p: p["value"]), "\n").alias("value"),
    )
    return whole.unionByName(joined).unionByName(numbered.filter("__r = __e").select(*lines.columns))


def scan_transcripts(
    spark: SparkSession,
    paths: str | Sequence[str],
    id_pattern: str = r"([^/]+)_TRANSCRIPT\.csv$",
    speakers: Sequence[str] = tuple(K.SPEAKERS),
    recursive: bool = False,
) -> DataFrame:
    """Lines of the wanted speakers as ``(session_id, block, line, start_time, stop_time, role, text)``.

    Files are read line by line, so a long file is split like any other; ``(block, line)`` is
    its order. The header of each file gives its delimiter and columns. A value may be
    quoted, hold doubled quotes and run over several lines. A quote inside an unquoted value is a
    character like others, and the lines after a quoted value that never ends are read one by one.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    lines = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("session_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.regexp_replace("value", "^﻿", "").alias("value"),
    )
    # Opening many files costs more than their lines, so they are read once and stored.
    lines = cut_lineage(lines, "lines")
    heads = _heads(lines)
    records = _records(lines, heads)
    if records is not lines:  # a header may run over several lines
        lines = cut_lineage(records, "records")
        heads = _heads(lines)
    names = F.transform(_cells(F.col("header"), F.col("sep")), strip)

    def at(name: str, required: bool = False) -> Column:
        pos = F.array_position(names, F.lit(name)).cast("int")
        if required:
            missing = F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("session_id")))
            return F.when(pos > 0, pos).otherwise(missing.cast("int"))
        return F.nullif(pos, F.lit(0))

    heads = heads.select(
        "session_id",
        "sep",
        at("speaker", True).alias("i_speaker"),
        at("value", True).alias("i_value"),
        at("start_time").alias("i_start"),
        at("stop_time").alias("i_stop"),
    )
    # The header line itself names no speaker, so the filter below removes it.
    cells = lines.join(heads, "session_id").withColumn("cells", _cells(F.col("value"), F.col("sep")))

    def cell(index: str) -> Column:
        return F.element_at("cells", F.col(index))

    return cells.select(
        "session_id",
        "block",
        "line",
        cell("i_start").try_cast("double").alias("start_time"),
        cell("i_stop").try_cast("double").alias("stop_time"),
        strip(cell("i_speaker")).alias("role"),
        F.when(~cell("i_value").isin(K.MISSING_TEXTS), strip(cell("i_value"))).alias("text"),
    ).filter(F.col("role").isin(list(speakers)) & (F.col("text") != ""))


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, total, binary, items map<string,int>)`` from a label file.

    Column aliases and both spellings of the id are accepted; null items are left out. Rows
    whose id is no number are those of ``rejected_labels``.
    """
    return _labels(spark, path).filter(F.col("session_id").isNotNull()).drop("raw_id")


def rejected_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(raw_id, reason)`` of the label rows that name no session."""
    bad = _labels(spark, path).filter(F.col("session_id").isNull())
    reason = F.when(F.col("raw_id").isNull(), "no id").otherwise("id is no number")
    return bad.select("raw_id", reason.alias("reason"))


def _labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnsRenamed(
        {a: b for a, b in K.LABEL_ALIASES.items() if a in raw.columns and b not in raw.columns}
    )
    ids = [c for c in K.ID_COLUMNS if c in raw.columns]
    if not ids:
        raise ValueError(f"no id column in {path}")

    def whole(c: str) -> Column:
        if c not in raw.columns:
            return F.lit(None).cast("int")
        return F.col(c).try_cast("double").cast("int")

    entries = [x for c in K.ITEM_COLUMNS for x in (F.lit(c), whole(c))]
    items = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())
    return raw.select(
        F.col(ids[0]).alias("raw_id"),
        F.col(ids[0]).try_cast("double").cast("long").cast("string").alias("session_id"),
        whole("PHQ8_Score").alias("total"),
        whole("PHQ8_Binary").alias("binary"),
        F.when(F.size(items) > 0, items).alias("items"),
    )


def build_samples(
    labels: DataFrame, turns: DataFrame, part_turns: int = PART_TURNS, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nested sample documents, and the labelled ids without a transcript.

    A document holds ``part_turns`` turns at most; a longer session is written in parts numbered
    from 0, each with the index of its first turn. ``strict`` refuses labels without a transcript.
    """
    told = turns.select("session_id").distinct()
    missing = labels.select("session_id").join(told, "session_id", "left_anti")
    if strict:
        some = [r.session_id for r in missing.orderBy("session_id").limit(10).collect()]
        if some:
            raise ValueError(f"labels without a transcript, among them: {some}")
    wanted = turns.join(labels.select("session_id"), "session_id", "left_semi")
    placed = scan(wanted, ["session_id"], ["turn_idx"], position_segment("turn_idx"), index="__at")
    parts = placed.groupBy("session_id", F.floor(F.col("__at") / part_turns).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn_idx", "role", "text"))).alias("t")
    )
    samples = labels.join(parts, "session_id").select(
        F.col("session_id").cast("string").alias("Participant_ID"),
        "part",
        F.col("t")[0]["turn_idx"].cast("long").alias("first_turn"),
        F.transform(
            "t", lambda x: F.struct(x["role"].alias("roleName"), x["text"].alias("content"))
        ).alias("real_interview"),
        F.struct(
            F.col("total").cast("int").alias("PHQ8_Score"), F.col("binary").cast("int").alias("PHQ8_Binary"), "items"
        ).alias("phq8_scores"),
    )
    return samples, missing


def write_samples(samples: DataFrame, path: str, split: str) -> None:
    """JSON documents under ``split=<name>``; other splits are left alone."""
    samples.write.mode("overwrite").json(f"{path}/split={split}")


def read_samples(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Sample documents; ``multi_line`` for one indented document per file."""
    return spark.read.schema(SAMPLE_SCHEMA).option("multiLine", multi_line).json(path)


def sample_turns(samples: DataFrame) -> DataFrame:
    """Turns of sample documents, one row each."""
    base = F.coalesce("first_turn", F.lit(0))
    return samples.select(
        F.col("Participant_ID").alias("session_id"), base.alias("base"), F.posexplode("real_interview").alias("at", "t")
    ).withColumn("turn_idx", F.col("base") + F.col("at")).select(
        "session_id",
        "turn_idx",
        turn_id("turn_idx").alias("turn_id"),
        F.col("t.roleName").alias("role"),
        F.col("t.content").alias("text"),
    )


def sample_labels(samples: DataFrame) -> DataFrame:
    """Item labels of sample documents, one row each; later parts repeat those of the first."""
    return samples.filter(F.coalesce("part", F.lit(0)) == 0).select(
        F.col("Participant_ID").alias("session_id"), F.explode("phq8_scores.items").alias("item", "value")
    )
