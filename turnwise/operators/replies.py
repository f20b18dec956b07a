"""Recorded model replies: cleaning, JSON extraction and typed tables.

Input is ``replies(session_id, topic, stage, round_index, raw)``. Nothing is guessed: a
reply without a usable value gets a reason instead. Finding balanced JSON spans is the
one step regular expressions cannot do; it is a small Arrow UDF, and everything after
it works on variants inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import constants as K
from ..functions import text as T
from ..functions.hashing import canonical_hash
from .totals import clamp

_TAGS = "|".join(K.REASONING_TAGS)
_REST = r"([\s\S]*)\z"


def drop_reasoning_tags(c: Column) -> Column:
    """Remove closed reasoning blocks, and everything from an unclosed one on."""
    closed = F.regexp_replace(c, rf"(?is)<\s*({_TAGS})\s*>.*?<\s*/\s*\1\s*>", "")
    return T.strip(F.regexp_replace(closed, rf"(?is)<\s*(?:{_TAGS})\s*>.*\z", ""))


def strip_reasoning(c: Column) -> Column:
    """The answer part of a reply; empty when there is nothing but reasoning."""
    t = drop_reasoning_tags(c)

    def after(pattern: str) -> Column:
        return T.strip(F.regexp_extract(t, f"(?imd){pattern}{_REST}", 1))

    fence = T.strip(F.regexp_extract(t, rf"(?md)({K.FENCE}[\s\S]*)\z", 1))
    return (
        F.when(~t.rlike("(?id)" + K.REASONING_HEADING), t)
        .when(t.rlike("(?imd)" + K.ANSWER_MARKER), after(K.ANSWER_MARKER))
        .when(t.rlike("(?md)" + K.HORIZONTAL_RULE), after(K.HORIZONTAL_RULE))
        .when(t.rlike("(?md)" + K.FENCE), fence)
        .otherwise("")
    )


def clean_replies(replies: DataFrame) -> DataFrame:
    return replies.withColumns(
        {"tag_free": drop_reasoning_tags(F.col("raw")), "cleaned": strip_reasoning(F.col("raw"))}
    )


def _span_finder():
    """The span function; made inside a function so that tasks get it by value."""
    pieces = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.DOTALL)

    def spans(text: str | None) -> list[str]:
        found, depth, start = [], 0, 0
        for piece in pieces.finditer(text or ""):
            mark = piece.group()
            if mark == "{":
                if depth == 0:
                    start = piece.start()
                depth += 1
            elif mark == "}" and depth:
                depth -= 1
                if depth == 0:
                    found.append(text[start : piece.end()])
        return found

    return spans


def _spans_of_batch():
    spans = _span_finder()

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(spans)

    return batch


#: Top-level ``{...}`` spans of a text; braces inside strings do not count.
balanced_spans = _span_finder()

json_objects = F.pandas_udf(_spans_of_batch(), ArrayType(StringType()))


def _object_reader():
    """A reader of one reply's objects, sent to tasks whole: spans that parse, written anew.

    Of a repeated key the last value counts, and NaN and infinities become null; a raw line break
    inside a string refuses the object. Half a surrogate pair, as a cut-off emoji leaves it, is U+FFFD.
    """
    import json

    spans = _span_finder()
    halves = re.compile("[\ud800-\udfff]")

    def parsed(span: str) -> str | None:
        try:
            value = json.loads(span, parse_constant=lambda _: None)
            return halves.sub("\ufffd", json.dumps(value, ensure_ascii=False, allow_nan=False))
        except (ValueError, RecursionError):  # no JSON, or a number beyond a double's range
            return None

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x for x in map(parsed, spans(t)) if x is not None])

    return batch


#: The objects of a text that parse, as JSON that every parser reads alike.
readable_objects = F.pandas_udf(_object_reader(), ArrayType(StringType()))

_FLAT = r"\{[^{}]*\}"
#: What parsers read in different ways: halves of surrogate pairs, exponents, long numbers, closing zeros.
_DELICATE = r"\\u[dD][89a-fA-F]|\d[eE]|\d{18}|\.\d*0"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once per row.

    A generator of one row: no filter or projection above it repeats the expression.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def with_objects(replies: DataFrame, source: Column) -> DataFrame:
    """``replies`` with ``objects``, the JSON objects of the text ``source`` that parse, as variants.

    A text whose braces only enclose flat objects, with no quote outside them, is read in the JVM if all of them
    parse there: the spans are then what the scanner would find. Only other texts go to Python.
    """
    text = "__source"
    spans = F.transform(F.regexp_extract_all(text, F.lit(_FLAT), F.lit(0)), F.try_parse_json)
    plain = ~F.regexp_replace(text, _FLAT, "").rlike('[{}"]') & ~F.col(text).rlike(_DELICATE)
    df = _once(_once(replies, text, source), "__flat", F.when(plain, spans))
    df = df.withColumn("__rest", F.when(F.forall("__flat", lambda v: v.isNotNull()), None).otherwise(F.col(text)))
    read = F.filter(F.transform("__read", F.try_parse_json), lambda v: v.isNotNull())
    df = df.withColumn("__read", readable_objects("__rest"))
    found = F.when(F.col("__rest").isNull(), F.coalesce("__flat", F.array())).otherwise(read)
    return _once(df, "objects", found).drop("__source", "__flat", "__rest", "__read")


def _with_answer_objects(replies: DataFrame) -> DataFrame:
    """Clean replies with the ``objects`` of the answer part, or of the whole reply when no answer part is left."""
    cleaned = clean_replies(replies)
    return with_objects(cleaned, F.when(F.col("cleaned") != "", F.col("cleaned")).otherwise(F.col("raw")))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(_get(v, path, "variant"))


def _has(v: Column, path: str) -> Column:
    return _get(v, path, "variant").isNotNull()


def _last(objects: Column) -> Column:
    return F.when(F.size(objects) > 0, F.element_at(objects, -1))


def _whole(v: Column, path: str, low: int, high: int, loose: bool = False) -> Column:
    """An integral number at ``path``, clamped; booleans and fractions are refused.

    A text must be a number, or with ``loose`` contain one.
    """
    kind, text = _kind(v, path), _get(v, path)
    number = text.try_cast("double")
    pattern = r"(-?\d+)" if loose else r"^\s*(-?\d+)\s*$"
    in_text = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    value = F.when(kind == "STRING", in_text).when(
        (kind != "BOOLEAN") & (kind != "VOID") & (number == F.floor(number)), number
    )
    return clamp(value, low, high).cast("int")


def _int_text(c: Column, low: int, high: int) -> Column:
    return clamp(F.nullif(c, F.lit("")).try_cast("double"), low, high).cast("int")


def _text(v: Column, path: str) -> Column:
    """Text at ``path``; a missing or null value is empty."""
    return T.strip(F.coalesce(_get(v, path), F.lit("")))


def _ids(v: Column, path: str) -> Column:
    """Strings and numbers of the list at ``path``; empty when it is no list."""
    listed = F.filter(
        _get(v, path, "array<variant>"),
        lambda e: F.schema_of_variant(e).isin("STRING", "BIGINT"),
    )
    return F.coalesce(
        F.transform(listed, lambda e: _get(e, "$")), F.lit([]).cast("array<string>")
    )


_LAST_NUMBER = r"^[^\d-]*(-?\d+)[^\d]*$"


def typed_scores(replies: DataFrame) -> DataFrame:
    """Scores 0-3 of scorer replies: JSON first, then ``score: n``, then a bare number."""
    # The answer part is searched if it has text, otherwise the tag-free text.
    cleaned = clean_replies(replies)
    df = with_objects(cleaned, F.when(F.col("cleaned") != "", F.col("cleaned")).otherwise(F.col("tag_free")))
    usable = F.filter("objects", lambda v: _whole(v, "$.score", 0, K.ITEM_MAX).isNotNull())
    df = _once(df, "__o", _last(usable))
    keyed = F.element_at(
        F.regexp_extract_all("cleaned", F.lit(r'(?i)"?score"?\s*:\s*(-?\d+)'), F.lit(1)), -1
    )
    has_key = F.col("cleaned").rlike(r'(?i)"?score"?\s*:\s*(-?\d+)')
    from_json = _whole(F.col("__o"), "$.score", 0, K.ITEM_MAX)
    from_key = F.when(has_key, _int_text(keyed, 0, K.ITEM_MAX))
    from_bare = _int_text(F.regexp_extract("cleaned", _LAST_NUMBER, 1), 0, K.ITEM_MAX)
    summary = F.when(from_json.isNotNull(), _text(F.col("__o"), "$.summary")).when(
        from_key.isNotNull(),
        T.strip(F.regexp_extract("cleaned", r'(?i)"?summary"?\s*:\s*"([^"]*)"', 1)),
    )
    score = F.coalesce(from_json, from_key, from_bare)
    return df.withColumns(
        {
            "score": score,
            "summary": F.coalesce(summary, F.lit("")),
            "evidence_turn_ids": F.when(
                from_json.isNotNull(), _ids(F.col("__o"), "$.evidence_turn_ids")
            ).otherwise(F.lit([]).cast("array<string>")),
            "reason": _reason(score, K.REASON_NO_SCORE),
        }
    ).drop("objects", "__o")


def _reason(value: Column, otherwise: str) -> Column:
    return F.when(value.isNotNull(), "").otherwise(
        F.when(T.strip(F.col("raw")) == "", K.REASON_EMPTY)
        .when(F.col("cleaned") == "", K.REASON_REASONING_ONLY)
        .otherwise(otherwise)
    )


def typed_necessity(replies: DataFrame) -> DataFrame:
    """Follow-up necessity 0-2 of necessity replies."""
    df = with_objects(clean_replies(replies), F.col("cleaned"))

    def rating(v: Column) -> Column:
        return F.coalesce(*(_whole(v, f"$.{k}", 0, 2) for k in ("necessity", "score", "rating")))

    rated = F.filter(F.transform("objects", rating), lambda r: r.isNotNull())
    pattern = r"(?i)\b(?:necessity|score|rating)\b\D{0,10}([0-2])"
    keyed = F.when(
        F.col("cleaned").rlike(pattern),
        F.element_at(F.regexp_extract_all("cleaned", F.lit(pattern), F.lit(1)), -1),
    )
    value = F.coalesce(
        F.when(F.size(rated) > 0, F.element_at(rated, -1)),
        _int_text(F.regexp_extract("cleaned", _LAST_NUMBER, 1), 0, 2),
        _int_text(keyed, 0, 2),
    )
    return df.withColumns(
        {"necessity": value, "reason": _reason(value, K.REASON_NO_NECESSITY)}
    ).drop("objects")


def typed_updates(replies: DataFrame, topics: Sequence[str]) -> DataFrame:
    """One row per (reply, revised topic) with score, reason and cited ids."""
    df = with_objects(clean_replies(replies), F.col("cleaned"))
    payloads = F.filter(
        "objects", lambda v: _has(v, "$.summary") | _has(v, "$.updated_scores")
    )
    df = _once(df, "__o", _last(payloads)).drop("objects")

    def from_json(t: str) -> Column:
        at = f'$.updated_scores["{t}"]'
        return F.struct(
            F.lit(t).alias("topic"),
            _whole(F.col("__o"), f"{at}.score", 0, K.ITEM_MAX).alias("score"),
            F.coalesce(_get(F.col("__o"), f"{at}.reason"), F.lit("")).alias("why"),
            _ids(F.col("__o"), f"{at}.evidence_turn_ids").alias("evidence_turn_ids"),
        )

    def recovered(t: str) -> Column:
        found = F.regexp_extract(
            "cleaned", rf'(?i)"\Q{t}\E"\s*:\s*\{{[^}}]*"score"\s*:\s*([0-3])', 1
        )
        return F.struct(
            F.lit(t).alias("topic"),
            _int_text(found, 0, K.ITEM_MAX).alias("score"),
            F.lit("Extracted via regex fallback").alias("why"),
            F.lit([]).cast("array<string>").alias("evidence_turn_ids"),
        )

    listed = F.when(F.col("__o").isNotNull(), F.array(*(from_json(t) for t in topics))).otherwise(
        F.array(*(recovered(t) for t in topics))
    )
    return df.select(
        *(c for c in replies.columns if c != "topic"),
        F.explode(F.filter(listed, lambda u: u["score"].isNotNull())).alias("u"),
    ).select(*(c for c in replies.columns if c != "topic"), "u.*")


def _flag(v: Column, path: str, default: Column) -> Column:
    kind, text = _kind(v, path), F.lower(T.strip(_get(v, path)))
    return (
        F.when(kind == "BOOLEAN", _get(v, path, "boolean"))
        .when((kind == "STRING") & text.isin("true", "yes", "y", "1"), True)
        .when((kind == "STRING") & text.isin("false", "no", "n", "0"), False)
        .otherwise(default)
    )


def typed_item_scores(replies: DataFrame) -> DataFrame:
    """Scores with abstention kept apart from zero."""
    df = _once(_with_answer_objects(replies), "__o", _last(F.col("objects")))
    o = F.col("__o")
    stated = F.lower(_text(o, "$.present"))
    kind = _kind(o, "$.score")
    df = df.withColumn("__s", _whole(o, "$.score", 0, K.ITEM_MAX, loose=True))
    scored = F.col("__s").isNotNull()
    df = df.withColumn(
        "present",
        F.when(o.isNull(), "unclear")
        .when(stated.isin("yes", "no", "unclear"), stated)
        .otherwise(F.when(scored, "yes").otherwise("unclear")),
    )
    sufficient = (
        F.coalesce(_flag(o, "$.sufficient", scored), F.lit(False))
        & scored
        & (F.col("present") != "unclear")
    )
    basis = F.lower(_text(o, "$.frequency_basis"))
    return (
        df.withColumn("sufficient", sufficient)
        .withColumns(
            {
                "score": F.when(
                    F.col("sufficient"),
                    F.when(F.col("present") == "no", 0).otherwise(F.col("__s")),
                ),
                "quote": _text(o, "$.quote"),
                "turn_ids": _ids(o, "$.turn_ids"),
                "frequency_basis": F.when(basis != "", basis).otherwise("none"),
                "reasoning": _text(o, "$.reasoning"),
                "ok": o.isNotNull(),
                "reason": F.when(o.isNull(), K.REASON_NO_OBJECT).otherwise(""),
            }
        )
        .drop("__o", "__s", "objects")
    )


def typed_sufficiency(replies: DataFrame) -> DataFrame:
    """Nullable verdict and the description of what is missing."""
    df = _once(_with_answer_objects(replies), "__o", _last(F.col("objects")))
    o = F.col("__o")
    return df.withColumns(
        {
            "sufficient": F.when(_has(o, "$.sufficient"), _flag(o, "$.sufficient", F.lit(False))),
            "missing": _text(o, "$.missing"),
        }
    ).drop("__o", "objects")


def typed_queries(replies: DataFrame, limit: int = 8, max_chars: int = 80) -> DataFrame:
    """The first distinct queries of a query reply, case ignored."""
    df = _once(_with_answer_objects(replies), "__o", _last(F.col("objects")))
    texts = F.transform(
        F.filter(
            _get(F.col("__o"), "$.queries", "array<variant>"),
            lambda e: F.schema_of_variant(e) == "STRING",
        ),
        lambda e: F.regexp_replace(T.squash(_get(e, "$")), '^"+|"+$', ""),
    )
    df = df.withColumn(
        "__q", F.filter(texts, lambda q: (q != "") & (F.length(q) <= max_chars))
    )
    keys = F.transform("__q", F.lower)
    first = F.filter(
        "__q", lambda q, i: F.array_position(keys, F.lower(q)) == i + 1
    )
    return df.withColumn(
        "queries", F.coalesce(F.slice(first, 1, limit), F.lit([]).cast("array<string>"))
    ).drop("__o", "__q", "objects")


def claims(replies: DataFrame) -> DataFrame:
    """Evidence records of extraction replies.

    ``replies`` carries ``offered map<turn_id, relation>``, the turns that were shown; a
    claim keeps only those it was offered and is dropped when none is left.
    """
    df = _once(_with_answer_objects(replies), "__o", _last(F.col("objects")))
    each = df.select(
        "session_id",
        "topic",
        "round_index",
        "offered",
        F.explode(_get(F.col("__o"), "$.claims", "array<variant>")).alias("c"),
    )
    c = F.col("c")
    polarity = F.lower(_text(c, "$.polarity"))
    basis = F.lower(_text(c, "$.frequency_basis"))
    number = F.when(
        ~_kind(c, "$.confidence").isin("STRING", "BOOLEAN", "VOID"), _get(c, "$.confidence", "double")
    )
    rank = F.array_max(
        F.transform("turn_ids", lambda t: -F.array_position(F.lit(K.RELATIONS), F.element_at("offered", t)))
    )
    return (
        each.withColumns(
            {
                "turn_ids": F.filter(
                    _ids(c, "$.turn_ids"), lambda t: F.map_contains_key("offered", t)
                ),
                "quote": _text(c, "$.quote"),
                "polarity": polarity,
                "frequency_basis": F.when(basis.isin(K.FREQUENCY_BASES), basis).otherwise("none"),
                "confidence": F.coalesce(clamp(number, 0.0, 1.0), F.lit(0.5)),
            }
        )
        .filter(F.col("polarity").isin(K.POLARITIES) & (F.col("quote") != "") & (F.size("turn_ids") > 0))
        .withColumn("relation", F.element_at(F.lit(K.RELATIONS), (-rank).cast("int")))
        .withColumn(
            "record_id",
            canonical_hash(
                participant=F.col("session_id").cast("string"),
                topic=F.col("topic"),
                turn_ids=F.col("turn_ids"),
                quote=F.col("quote"),
            ),
        )
        .drop("c", "offered")
    )


_LESSON_FIELDS = ["trigger", "do", "avoid", "criterion"]


def lesson_candidates(replies: DataFrame) -> DataFrame:
    """Lesson rules of distillation replies ``(role, scope, raw)``.

    A rule with an empty field, or one that speaks of the labels, is dropped.
    """
    df = _once(_with_answer_objects(replies), "__o", _last(F.col("objects")))
    fields = {f: T.squash(F.coalesce(_get(F.col("__o"), f"$.{f}"), F.lit(""))) for f in _LESSON_FIELDS}
    confidence = F.when(
        ~_kind(F.col("__o"), "$.confidence").isin("STRING", "VOID"),
        _get(F.col("__o"), "$.confidence", "double"),
    )
    df = df.withColumns(fields).withColumn(
        "candidate_confidence", F.coalesce(confidence, F.lit(0.0))
    )
    fine = F.col("__o").isNotNull()
    for f in _LESSON_FIELDS:
        fine = fine & (F.col(f) != "") & ~F.col(f).rlike("(?iU)" + K.LABEL_LEAK)
    return (
        df.filter(fine)
        .withColumn(
            "lesson_id",
            canonical_hash(role=F.col("role"), scope=F.col("scope"), **{f: F.col(f) for f in _LESSON_FIELDS}),
        )
        .drop("__o", "objects", "raw", "cleaned", "tag_free")
    )


def reply_failures(typed: DataFrame) -> DataFrame:
    """Number of unusable replies per stage and reason."""
    return typed.filter(F.col("reason") != "").groupBy("stage", "reason").agg(F.count("*").alias("n"))


def valid_records(records: DataFrame) -> DataFrame:
    """Run records that count: not marked invalid, with both totals."""
    return records.filter(
        F.coalesce("assessment_valid", F.lit(True))
        & F.col("total_predicted_score").isNotNull()
        & F.col("ground_truth_total").isNotNull()
    )
