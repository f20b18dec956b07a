"""Turn shaping: numbering, tags, question-answer pairs and per-turn flags.

``turns`` is ``(session_id, turn_idx, role, text)`` with ``turn_idx`` unique and
increasing within a session. Every running value goes through ``segments.scan``, so
one session may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.segments import SEGMENT_ROWS, position_segment, scan, top_k


def turn_id(position: Column | str) -> Column:
    return F.concat(F.lit("turn-"), F.col(position).cast("string") if isinstance(position, str) else position.cast("string"))


def number_turns(
    turns: DataFrame, position: str = "position", segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Number the turns of a session from 0 over all roles."""
    numbered = scan(
        turns,
        ["session_id"],
        [position],
        position_segment(position, segment_rows),
        index="turn_idx",
    )
    return numbered.withColumn("turn_id", turn_id("turn_idx"))


def split_tag(turns: DataFrame, text: str = "text") -> DataFrame:
    """Split ``tag (utterance)`` into two columns; untagged text passes through."""
    return turns.withColumns(
        {"tag": T.tag_of(F.col(text)), "utterance": T.utterance_of(F.col(text))}
    )


def _with_prompt(
    turns: DataFrame, participant_role: str, segment_rows: int, **extra
) -> DataFrame:
    """Add the run number and the last prompt to every turn."""
    speaks = F.col("role") == participant_role
    prompt = F.struct(
        T.utterance_of(F.col("text")).alias("question"), T.tag_of(F.col("text")).alias("tag")
    )
    return scan(
        turns,
        ["session_id"],
        ["turn_idx"],
        position_segment("turn_idx", segment_rows),
        sums={"run": F.when(speaks, 0).otherwise(1)},
        lasts={"prompt": F.when(~speaks, prompt)},
        **extra,
    )


def pair_turns(
    turns: DataFrame,
    participant_role: str = "Participant",
    merge: bool = True,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Join every run of answers to the last prompt before it.

    A blank answer is skipped without ending the run; any other turn ends it, blank
    or not. With ``merge=False`` every answer is a row of its own.
    """
    answers = (
        _with_prompt(turns, participant_role, segment_rows)
        .filter(F.col("role") == participant_role)
        .withColumn("text", T.strip(F.col("text")))
        .filter(F.col("text") != "")
    )
    question = F.coalesce(F.col("prompt.question"), F.lit(""))
    if not merge:
        return answers.select(
            "session_id",
            turn_id("turn_idx").alias("turn_id"),
            "turn_idx",
            question.alias("question"),
            F.col("text").alias("answer"),
            F.col("prompt.tag").alias("tag"),
            F.array(turn_id("turn_idx")).alias("span_ids"),
        )
    runs = answers.groupBy("session_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("parts"),
        F.any_value("prompt").alias("prompt"),
    )
    return runs.select(
        "session_id",
        turn_id(F.col("parts")[0]["turn_idx"]).alias("turn_id"),
        F.col("parts")[0]["turn_idx"].alias("turn_idx"),
        question.alias("question"),
        F.array_join(F.col("parts.text"), " ").alias("answer"),
        F.col("prompt.tag").alias("tag"),
        F.transform(F.col("parts.turn_idx"), turn_id).alias("span_ids"),
    )


def tag_reply_span(
    turns: DataFrame,
    tag_topic: DataFrame,
    participant_role: str = "Participant",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """All answers that follow a prompt whose tag maps to a topic, one row per turn."""
    replies = (
        _with_prompt(turns, participant_role, segment_rows)
        .filter(F.col("role") == participant_role)
        .withColumn("tag", F.col("prompt.tag"))
        .filter(F.col("tag").isNotNull())
    )
    return replies.join(tag_topic.select("tag", "topic"), "tag").select(
        "session_id", "topic", "turn_idx", turn_id("turn_idx").alias("turn_id"), "text"
    )


def after_hypothetical(
    turns: DataFrame, prompt_role: str | None = None, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Flag turns that directly follow a hypothetical question of the prompting role."""
    asks = T.asks_hypothetical(F.col("text"))
    if prompt_role is not None:
        asks = asks & (F.col("role") == prompt_role)
    flagged = scan(
        turns,
        ["session_id"],
        ["turn_idx"],
        position_segment("turn_idx", segment_rows),
        lags={"after_hypothetical": asks},
    )
    return flagged.withColumn(
        "after_hypothetical", F.coalesce("after_hypothetical", F.lit(False))
    )


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, T.tokens(F.col(text)))


def participant_text(
    turns: DataFrame,
    max_chars: int,
    participant_role: str = "Participant",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The participant's turns as one text, cut at ``max_chars``.

    Turns that begin beyond the cut are dropped before anything is gathered, so a
    group never holds more than ``max_chars`` turns.
    """
    own = turns.filter(F.col("role") == participant_role)
    measured = scan(
        own,
        ["session_id"],
        ["turn_idx"],
        position_segment("turn_idx", segment_rows),
        sums={"reach": (F.length("text") + 1).cast("long")},
    )
    begins = F.col("reach") - F.length("text") - 1
    return (
        measured.filter(begins <= max_chars)
        .groupBy("session_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("parts"))
        .select(
            "session_id",
            F.substring(F.array_join(F.col("parts.text"), " "), 1, max_chars).alias("text"),
        )
    )


def mentions_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("mentions_frequency", T.mentions_frequency(F.col(text)))


def first_age(turns: DataFrame, participant_role: str = "Participant") -> DataFrame:
    """Per session the first stated age, or ``undisclosed``."""
    age = F.when(F.col("role") == participant_role, T.age_in(F.col("text")))
    return turns.groupBy("session_id").agg(
        F.coalesce(
            F.min_by(age, F.when(age.isNotNull(), F.col("turn_idx"))).cast("string"),
            F.lit("undisclosed"),
        ).alias("age")
    )


def tag_inventory(turns: DataFrame, participant_role: str = "Participant") -> DataFrame:
    """Per tag the number of prompts and the utterance seen first."""
    return (
        split_tag(turns.filter(F.col("role") != participant_role))
        .filter(F.col("tag").isNotNull())
        .groupBy("tag")
        .agg(
            F.count("*").alias("n"),
            F.min_by("utterance", F.struct("session_id", "turn_idx")).alias("utterance"),
        )
    )


def lexicon_hits(
    turns: DataFrame, lexicon: Mapping[str, Sequence[str]], participant_role: str = "Participant"
) -> DataFrame:
    """One row per (turn, topic, keyword) where the keyword occurs in the turn."""
    entries = F.array(
        *(
            F.struct(F.lit(topic).alias("topic"), F.lit(k.lower()).alias("keyword"))
            for topic, words in lexicon.items()
            for k in words
        )
    )
    found = T.let(
        F.lower("text"), lambda low: F.filter(entries, lambda e: F.contains(low, e["keyword"]))
    )
    return (
        turns.filter(F.col("role") == participant_role)
        .select("session_id", "turn_idx", "text", F.explode(found).alias("e"))
        .select("session_id", "turn_idx", "text", "e.topic", "e.keyword")
    )


def lexicon_audit(hits: DataFrame) -> DataFrame:
    """Number of lines each keyword matches."""
    return hits.groupBy("topic", "keyword").agg(F.count("*").alias("hits"))


def lexicon_examples(hits: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` matching lines of each keyword."""
    return top_k(hits, ["topic", "keyword"], [F.col("session_id"), F.col("turn_idx")], n)
