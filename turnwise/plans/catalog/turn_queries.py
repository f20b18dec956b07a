"""Turn shaping over ``conversations``.

``TURNS`` is the table as it is. ``MIXED`` gives turns other roles, blanks and tags by
rule, so that runs of several answers, blank answers and tagged prompts occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...functions.text import mentions_frequency as mentions_frequency_expr
from ...operators import turns as T
from ...session import cut_lineage
from .base import View, query, strings, strip_sql

TURNS = View(
    "conversations", session_id="conv_id", turn_idx="turn", role="role", text="text"
)

MIXED = View(
    "conversations",
    session_id="conv_id",
    turn_idx="turn",
    role="CASE WHEN (conv_id + turn * turn) % 3 = 0 THEN 'prompt' ELSE 'answer' END",
    text=(
        "CASE WHEN (conv_id * 3 + turn) % 7 = 0 THEN '  ' "
        "WHEN (conv_id + turn * turn) % 3 = 0 AND (conv_id + turn) % 5 < 4 "
        "THEN concat(' tag_', CAST((conv_id + turn) % 5 AS STRING), ' (', text, ')') "
        "ELSE text END"
    ),
)

TAG_TOPIC = {"tag_0": "sleep", "tag_1": "mood", "tag_2": K.CROSS_CUTTING}

LEXICON = {
    "sleep": ["thing", "inst", "er the"],
    "mood": ["tion", "ou an", "enhei"],
    "energy": ["que la", "not", "und"],
}

TAG_SQL = r"nullif(regexp_extract({s}, '(?s)^([A-Za-z0-9_]+)\s*\((.*)\)$', 1), '')"
UTTERANCE_SQL = (
    r"CASE WHEN regexp_matches({s}, '(?s)^([A-Za-z0-9_]+)\s*\((.*)\)$') THEN "
    + strip_sql(r"regexp_extract({s}, '(?s)^([A-Za-z0-9_]+)\s*\((.*)\)$', 2)")
    + " ELSE {s} END"
)


def tag_sql(x: str) -> str:
    return TAG_SQL.replace("{s}", strip_sql(x))


def utterance_sql(x: str) -> str:
    return UTTERANCE_SQL.replace("{s}", strip_sql(x))


RUNS_CTE = f"""
t AS ({MIXED.sql}),
r AS (SELECT *, sum(CASE WHEN role <> 'answer' THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY turn_idx) AS run,
      lag(role) OVER (PARTITION BY session_id ORDER BY turn_idx) AS prev_role,
      lag(text) OVER (PARTITION BY session_id ORDER BY turn_idx) AS prev_text FROM t),
q AS (SELECT session_id, run, {tag_sql('text')} AS tag, {utterance_sql('text')} AS question
      FROM r WHERE role <> 'answer')"""

PAIRS_CTE = f"""{RUNS_CTE},
a AS (SELECT session_id, run, min(turn_idx) AS turn_idx,
        string_agg({strip_sql('text')}, ' ' ORDER BY turn_idx) AS answer,
        string_agg('turn-' || turn_idx, ',' ORDER BY turn_idx) AS span_ids
      FROM r WHERE role = 'answer' AND {strip_sql('text')} <> '' GROUP BY 1, 2),
pairs AS (SELECT a.session_id, 'turn-' || turn_idx AS turn_id, turn_idx,
        coalesce(question, '') AS question, answer, tag, span_ids
      FROM a LEFT JOIN q ON a.session_id = q.session_id AND a.run = q.run)"""


def mixed_pairs(spark, folder):
    return T.pair_turns(MIXED.load(spark, folder), "answer")


def stored_pairs(spark, folder):
    """The pairs as a table, for plans that read them several times."""
    return cut_lineage(mixed_pairs(spark, folder), "pairs")


@query(
    "number_turns",
    """SELECT conv_id AS session_id, role,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx,
       concat('turn-', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS turn_id
       FROM conversations""",
)
def number_turns(spark, folder):
    turns = TURNS.load(spark, folder).withColumnRenamed("turn_idx", "position")
    return T.number_turns(turns.drop("text")).select("session_id", "role", "turn_idx", "turn_id")


@query(
    "split_tag",
    f"""SELECT session_id, turn_idx, {tag_sql('text')} AS tag,
        {utterance_sql('text')} AS utterance FROM ({MIXED.sql})""",
)
def split_tag(spark, folder):
    return T.split_tag(MIXED.load(spark, folder)).select(
        "session_id", "turn_idx", "tag", "utterance"
    )


@query("pair_turns", f"WITH {PAIRS_CTE} SELECT * FROM pairs")
def pair_turns(spark, folder):
    return mixed_pairs(spark, folder).withColumn("span_ids", F.array_join("span_ids", ","))


@query(
    "pair_turns_unmerged",
    f"""WITH {RUNS_CTE} SELECT r.session_id, 'turn-' || turn_idx AS turn_id,
        coalesce(question, '') AS question, {strip_sql('text')} AS answer, tag
        FROM r LEFT JOIN q ON r.session_id = q.session_id AND r.run = q.run
        WHERE role = 'answer' AND {strip_sql('text')} <> ''""",
)
def pair_turns_unmerged(spark, folder):
    return T.pair_turns(MIXED.load(spark, folder), "answer", merge=False).select(
        "session_id", "turn_id", "question", "answer", "tag"
    )


@query(
    "tag_reply_span",
    f"""WITH {RUNS_CTE}, m(tag, topic) AS (VALUES ('tag_0', 'sleep'), ('tag_1', 'mood'),
        ('tag_2', 'CROSS_CUTTING'))
        SELECT r.session_id, topic, turn_idx, 'turn-' || turn_idx AS turn_id, text
        FROM r JOIN q ON r.session_id = q.session_id AND r.run = q.run JOIN m ON q.tag = m.tag
        WHERE role = 'answer'""",
)
def tag_reply_span(spark, folder):
    mapping = spark.createDataFrame(list(TAG_TOPIC.items()), "tag string, topic string")
    return T.tag_reply_span(MIXED.load(spark, folder), mapping, "answer")


HYPO_TURNS = View(
    "conversations",
    session_id="conv_id",
    turn_idx="turn",
    role="role",
    text=(
        "CASE WHEN (conv_id + turn) % 4 = 0 THEN concat('And WHAT would you say? ', text) "
        "WHEN (conv_id + turn) % 4 = 1 THEN concat('if you weren''t ', text) ELSE text END"
    ),
)


@query(
    "after_hypothetical",
    f"""SELECT session_id, turn_idx, coalesce(lag(role = 'user' AND
        regexp_matches(text, '(?i){K.HYPOTHETICAL.replace("'", "''")}'))
        OVER (PARTITION BY session_id ORDER BY turn_idx), false) AS after_hypothetical
        FROM ({HYPO_TURNS.sql})""",
)
def after_hypothetical(spark, folder):
    return T.after_hypothetical(HYPO_TURNS.load(spark, folder), "user").select(
        "session_id", "turn_idx", "after_hypothetical"
    )


@query(
    "tokenize",
    f"""SELECT conv_id AS session_id, turn AS turn_idx, array_to_string(list_filter(
        regexp_extract_all(lower(text), '[a-z'']+'),
        lambda w: length(w) > 2 AND NOT list_contains({strings(K.STOPWORDS)}, w)), ' ') AS tokens
        FROM conversations""",
)
def tokenize(spark, folder):
    return T.tokenize(TURNS.load(spark, folder)).select(
        "session_id", "turn_idx", F.array_join("tokens", " ").alias("tokens")
    )


@query(
    "participant_text",
    """SELECT conv_id AS session_id, substr(string_agg(text, ' ' ORDER BY turn), 1, 400) AS text
       FROM conversations WHERE role = 'assistant' GROUP BY 1""",
)
def participant_text(spark, folder):
    return T.participant_text(TURNS.load(spark, folder), 400, "assistant")


FREQUENCY_TURNS = View(
    "conversations",
    session_id="conv_id",
    turn_idx="turn",
    text=(
        "CASE turn % 4 WHEN 0 THEN concat(text, ' Most Days') "
        "WHEN 1 THEN concat('for ', CAST(conv_id AS STRING), ' weeks ', text) ELSE text END"
    ),
)


@query(
    "mentions_frequency",
    f"""SELECT session_id, turn_idx, regexp_matches(text, '(?i){K.FREQUENCY}')
        AS mentions_frequency FROM ({FREQUENCY_TURNS.sql})""",
)
def mentions_frequency(spark, folder):
    return FREQUENCY_TURNS.load(spark, folder).select(
        "session_id",
        "turn_idx",
        mentions_frequency_expr(F.col("text")).alias("mentions_frequency"),
    )


AGE_TURNS = View(
    "conversations",
    session_id="conv_id",
    turn_idx="turn",
    role="role",
    text=(
        "CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('I''m ', CAST((conv_id + 5 * turn) % 70 "
        "AS STRING), ' now ', text) WHEN (conv_id + turn) % 5 = 1 THEN concat(text, ' ', "
        "CAST((conv_id + turn) % 90 AS STRING), ' years old') ELSE text END"
    ),
)

_AGE_PATTERN = K.AGE.replace("'", "''")


@query(
    "first_age",
    f"""WITH c AS (SELECT session_id, turn_idx, role,
        TRY_CAST(coalesce(nullif(regexp_extract(text, '(?i){_AGE_PATTERN}', 1), ''),
                 nullif(regexp_extract(text, '(?i){_AGE_PATTERN}', 2), '')) AS INTEGER) AS age
        FROM ({AGE_TURNS.sql}))
        SELECT session_id, coalesce(CAST(arg_min(age, turn_idx) FILTER
          (WHERE role = 'assistant' AND age BETWEEN 10 AND 100) AS VARCHAR), 'undisclosed') AS age
        FROM c GROUP BY 1""",
)
def first_age(spark, folder):
    return T.first_age(AGE_TURNS.load(spark, folder), "assistant")


@query(
    "tag_inventory",
    f"""WITH s AS (SELECT session_id, turn_idx, {tag_sql('text')} AS tag,
        {utterance_sql('text')} AS utterance FROM ({MIXED.sql}) WHERE role <> 'answer'),
        o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY session_id, turn_idx) AS k
              FROM s WHERE tag IS NOT NULL)
        SELECT tag, count(*) AS n, max(CASE WHEN k = 1 THEN utterance END) AS utterance
        FROM o GROUP BY tag""",
)
def tag_inventory(spark, folder):
    return T.tag_inventory(MIXED.load(spark, folder), "answer")


LEXICON_VALUES = ", ".join(
    f"('{t}', '{w}')" for t, words in LEXICON.items() for w in words
)


@query(
    "lexicon_audit",
    f"""WITH l(topic, keyword) AS (VALUES {LEXICON_VALUES})
        SELECT topic, keyword, count(*) AS hits FROM conversations, l
        WHERE role = 'assistant' AND contains(lower(text), keyword) GROUP BY 1, 2""",
)
def lexicon_audit(spark, folder):
    return T.lexicon_audit(T.lexicon_hits(TURNS.load(spark, folder), LEXICON, "assistant"))


@query(
    "lexicon_examples",
    f"""WITH l(topic, keyword) AS (VALUES {LEXICON_VALUES}),
        h AS (SELECT topic, keyword, conv_id AS session_id, turn AS turn_idx, text,
          row_number() OVER (PARTITION BY topic, keyword ORDER BY conv_id, turn) AS rank
        FROM conversations, l WHERE role = 'assistant' AND contains(lower(text), keyword))
        SELECT * FROM h WHERE rank <= 3""",
)
def lexicon_examples(spark, folder):
    hits = T.lexicon_hits(TURNS.load(spark, folder), LEXICON, "assistant")
    return T.lexicon_examples(hits, 3)
