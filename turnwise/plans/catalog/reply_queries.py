"""Reply tables: raw replies are composed from ``events`` rows by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...operators import grounding as G
from ...operators import replies as D
from .base import View, query, spread, squash_sql, strip_sql, table

N = "CAST(event_id % 5 AS STRING)"
ID = "CAST(event_id % 97 AS STRING)"

#: Half of an escaped surrogate pair, as a cut-off emoji leaves it: U+FFFD when its object is read.
HALF = "concat(chr(92), 'ud83d')"


def mended_sql(x: str) -> str:
    return f"replace({x}, {HALF}, chr(65533))"


SCORER = View(
    "events",
    session_id="user_id",
    topic="event_type",
    event_id="event_id",
    stage="CASE WHEN event_id % 2 = 0 THEN 'scorer' ELSE 'rescorer' END",
    raw=(
        f"""CASE WHEN event_id % 36 = 20 THEN concat('{{"score": ', {N}, ', "summary": "cut ', {HALF}, '"}}') """
        f"""WHEN event_id % 36 = 32 THEN concat('{{"note": {{"a": "', {HALF}, '"}}, "score": ', {N}, '}}') """
        "ELSE CASE event_id % 12 "
        f"""WHEN 0 THEN concat('{{"score": ', {N}, ', "summary": "basis ', {ID}, '", "evidence_turn_ids": ["turn-', {ID}, '", 7, 1.5]}}') """
        f"""WHEN 1 THEN concat('<think>maybe {{"score": 3}} or so</THINK> {{"score": ', {N}, '}}') """
        """WHEN 2 THEN concat('Thinking: hm', chr(10), 'Answer: {"score": true}', chr(10)) """
        "WHEN 3 THEN '   ' "
        f"WHEN 4 THEN concat('<reasoning> not finished ', {N}) "
        f"WHEN 5 THEN concat('score: 1 then Score : ', {N}) "
        f"WHEN 6 THEN concat('I would say ', {ID}, '.') "
        f"""WHEN 7 THEN concat('{{"score": 2.5}} and {{"score": "', {N}, '"}}') """
        "WHEN 8 THEN 'no idea at all' "
        """WHEN 9 THEN '{"example": 1} {"score": -4, "summary": " low "}' """
        "WHEN 10 THEN 'Reasoning: because of things' "
        """ELSE concat('Thought process: x', chr(10), '---', chr(10), '{"score": 7}') END END"""
    ),
)


def _closed(tag: str, x: str) -> str:
    return rf"regexp_replace({x}, '(?is)<\s*{tag}\s*>.*?<\s*/\s*{tag}\s*>', '', 'g')"


def tag_free_sql(x: str) -> str:
    for tag in K.REASONING_TAGS:
        x = _closed(tag, x)
    opened = "|".join(K.REASONING_TAGS)
    return strip_sql(rf"regexp_replace({x}, '(?is)<\s*(?:{opened})\s*>.*$', '')")


def cleaned_sql(t: str) -> str:
    def after(pattern: str) -> str:
        return strip_sql(rf"regexp_extract({t}, '(?im){pattern}((?s:.*))\z', 1)")

    fence = strip_sql(rf"regexp_extract({t}, '(?m)({K.FENCE}(?s:.*))\z', 1)")
    return (
        f"CASE WHEN NOT regexp_matches({t}, '(?i){K.REASONING_HEADING}') THEN {t} "
        f"WHEN regexp_matches({t}, '(?im){K.ANSWER_MARKER}') THEN {after(K.ANSWER_MARKER)} "
        f"WHEN regexp_matches({t}, '(?m){K.HORIZONTAL_RULE}') THEN {after(K.HORIZONTAL_RULE)} "
        f"WHEN regexp_matches({t}, '(?m){K.FENCE}') THEN {fence} ELSE '' END"
    )


def cleaned_cte(view: View) -> str:
    return f"""r AS ({view.sql}), f AS (SELECT *, {tag_free_sql('raw')} AS tag_free FROM r),
c AS (SELECT *, {cleaned_sql('tag_free')} AS cleaned FROM f)"""


def whole_sql(obj: str, path: str, low: int, high: int) -> str:
    v = f"json_extract({obj}, '{path}')"
    s = f"json_extract_string({obj}, '{path}')"
    return (
        f"CASE json_type({v}) WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match({s}, '\\s*-?\\d+\\s*') "
        f"THEN greatest({low}, least({high}, CAST({s} AS BIGINT))) END WHEN 'BOOLEAN' THEN NULL "
        f"WHEN 'NULL' THEN NULL ELSE CASE WHEN TRY_CAST({s} AS DOUBLE) = floor(TRY_CAST({s} AS DOUBLE)) "
        f"THEN greatest({low}, least({high}, CAST(TRY_CAST({s} AS DOUBLE) AS BIGINT))) END END"
    )


def int_sql(x: str, low: int, high: int) -> str:
    return f"greatest({low}, least({high}, TRY_CAST(nullif({x}, '') AS BIGINT))) + CAST(nullif({x}, '') AS BIGINT) * 0"


@query(
    "clean_replies",
    f"WITH {cleaned_cte(SCORER)} SELECT event_id, tag_free, cleaned FROM c",
)
def clean_replies(spark, folder):
    return D.clean_replies(SCORER.load(spark, folder)).select("event_id", "tag_free", "cleaned")


@query(
    "json_objects",
    f"""WITH s AS (SELECT event_id, regexp_extract_all(raw, '\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}}') AS spans FROM ({SCORER.sql}))
        SELECT event_id, generate_subscripts(spans, 1) - 1 AS pos, unnest(spans) AS span FROM s""",
)
def json_objects(spark, folder):
    df = SCORER.load(spark, folder)
    spans = df.select("event_id", F.posexplode(D.json_objects("raw")).alias("pos", "span"))
    return spans.select("event_id", F.col("pos").cast("long").alias("pos"), "span")


SCORED_CTE = f"""{cleaned_cte(SCORER)},
o AS (SELECT *, list_filter(regexp_extract_all({mended_sql("CASE WHEN cleaned <> '' THEN cleaned ELSE tag_free END")},
      '\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}}'), lambda x: {whole_sql('x', '$.score', 0, 3)} IS NOT NULL)[-1] AS obj,
      regexp_extract_all(cleaned, '(?i)"?score"?\\s*:\\s*(-?\\d+)', 1)[-1] AS keyed,
      regexp_extract(cleaned, '^[^\\d-]*(-?\\d+)[^\\d]*$', 1) AS bare FROM c),
s AS (SELECT *, {whole_sql('obj', '$.score', 0, 3)} AS js, {int_sql('keyed', 0, 3)} AS ks,
      {int_sql('bare', 0, 3)} AS bs FROM o),
scored AS (SELECT session_id, topic, event_id, stage, coalesce(js, ks, bs) AS score,
      CASE WHEN js IS NOT NULL THEN coalesce({strip_sql("json_extract_string(obj, '$.summary')")}, '')
        ELSE '' END AS summary,
      CASE WHEN js IS NOT NULL THEN coalesce(array_to_string(list_transform(list_filter(
          CAST(json_extract(obj, '$.evidence_turn_ids') AS JSON[]),
          lambda e: json_type(e) IN ('VARCHAR', 'BIGINT', 'UBIGINT')),
          lambda e: json_extract_string(e, '$')), ','), '') ELSE '' END AS evidence_turn_ids,
      CASE WHEN coalesce(js, ks, bs) IS NOT NULL THEN '' WHEN {strip_sql('raw')} = '' THEN '{K.REASON_EMPTY}'
        WHEN cleaned = '' THEN '{K.REASON_REASONING_ONLY}' ELSE '{K.REASON_NO_SCORE}' END AS reason FROM s)"""


def scored(spark, folder):
    df = D.typed_scores(spread(SCORER.load(spark, folder)))
    return df.select(
        "session_id",
        "topic",
        "event_id",
        "stage",
        F.col("score").cast("long").alias("score"),
        "summary",
        F.array_join("evidence_turn_ids", ",").alias("evidence_turn_ids"),
        "reason",
    )


@query("typed_scores", f"WITH {SCORED_CTE} SELECT * FROM scored")
def typed_scores(spark, folder):
    return scored(spark, folder)


@query(
    "reply_failures",
    f"WITH {SCORED_CTE} SELECT stage, reason, count(*) AS n FROM scored WHERE reason <> '' GROUP BY 1, 2",
)
def reply_failures(spark, folder):
    return D.reply_failures(scored(spark, folder))


NECESSITY = View(
    "events",
    event_id="event_id",
    raw=(
        "CASE event_id % 7 "
        f"""WHEN 0 THEN concat('{{"rating": ', {N}, '}}') """
        f"""WHEN 1 THEN concat('{{"necessity": "x", "score": ', {N}, '}}') """
        f"WHEN 2 THEN concat('level ', {N}) "
        f"WHEN 3 THEN concat('10 of 12: necessity is ', {N}) "
        "WHEN 4 THEN '' WHEN 5 THEN '<thought>2' ELSE 'none given' END"
    ),
)


@query(
    "typed_necessity",
    f"""WITH {cleaned_cte(NECESSITY)},
        o AS (SELECT *, list_filter(list_transform(regexp_extract_all(cleaned, '\\{{[^{{}}]*\\}}'),
          lambda x: coalesce({", ".join(whole_sql('x', '$.' + k, 0, 2) for k in ("necessity", "score", "rating"))})),
          lambda v: v IS NOT NULL)[-1] AS js,
          regexp_extract_all(cleaned, '(?i)\\b(?:necessity|score|rating)\\b\\D{{0,10}}([0-2])', 1)[-1] AS keyed,
          regexp_extract(cleaned, '^[^\\d-]*(-?\\d+)[^\\d]*$', 1) AS bare FROM c),
        s AS (SELECT *, coalesce(js, {int_sql('bare', 0, 2)}, {int_sql('keyed', 0, 2)}) AS v FROM o)
        SELECT event_id, v AS necessity, CASE WHEN v IS NOT NULL THEN '' WHEN {strip_sql('raw')} = ''
          THEN '{K.REASON_EMPTY}' WHEN cleaned = '' THEN '{K.REASON_REASONING_ONLY}'
          ELSE '{K.REASON_NO_NECESSITY}' END AS reason FROM s""",
)
def typed_necessity(spark, folder):
    df = D.typed_necessity(NECESSITY.load(spark, folder))
    return df.select("event_id", F.col("necessity").cast("long").alias("necessity"), "reason")


UPDATES = View(
    "events",
    session_id="user_id",
    event_id="event_id",
    raw=(
        "CASE event_id % 4 "
        f"""WHEN 0 THEN concat('Reply: {{"summary": "s", "updated_scores": {{"view": {{"score": ', {N}, ', "reason": "r', {ID}, '", "evidence_turn_ids": ["turn-1"]}}, "other": {{"score": 1}}, "click": {{"score": "x"}}}}}}') """
        f"""WHEN 1 THEN concat('{{"updated_scores": {{"click": {{"score": "', {N}, '"}}, "view": {{"score": 1}}}}}}') """
        f"""WHEN 2 THEN concat('broken {{"view" : {{ "why": 1, "score": ', {N}, ' , }} "signup": {{"score": 2') """
        "ELSE 'nothing' END"
    ),
)

UPDATE_TOPICS = ["view", "click", "signup"]


@query(
    "typed_updates",
    f"""WITH r AS ({UPDATES.sql}), t(topic) AS (VALUES ('view'), ('click'), ('signup')),
        j AS (SELECT session_id, event_id, topic, raw, CASE WHEN event_id % 4 < 2
          THEN json_extract(regexp_extract(raw, '\\{{.*\\}}'), '$.updated_scores.' || topic) END AS u FROM r, t),
        s AS (SELECT session_id, event_id, topic, CASE WHEN event_id % 4 < 2 THEN {whole_sql('u', '$.score', 0, 3)}
          ELSE TRY_CAST(nullif(regexp_extract(raw, '(?i)"' || topic || '"\\s*:\\s*\\{{[^}}]*"score"\\s*:\\s*([0-3])', 1), '') AS BIGINT)
          END AS score, CASE WHEN event_id % 4 < 2 THEN coalesce(json_extract_string(u, '$.reason'), '')
          ELSE 'Extracted via regex fallback' END AS why,
          coalesce(json_extract_string(u, '$.evidence_turn_ids[0]'), '') AS cited FROM j)
        SELECT * FROM s WHERE score IS NOT NULL""",
)
def typed_updates(spark, folder):
    df = D.typed_updates(UPDATES.load(spark, folder), UPDATE_TOPICS)
    return df.select(
        "session_id",
        "event_id",
        "topic",
        F.col("score").cast("long").alias("score"),
        "why",
        F.array_join("evidence_turn_ids", ",").alias("cited"),
    )


ITEM_SCORES = View(
    "events",
    session_id="user_id",
    topic="event_type",
    event_id="event_id",
    raw=(
        "CASE event_id % 10 "
        f"""WHEN 0 THEN concat('{{"score": ', {N}, ', "present": "Yes", "sufficient": true, "quote": " q', {ID}, ' ", "turn_ids": ["turn-', {N}, '", 3], "frequency_basis": "Stated_Days"}}') """
        """WHEN 1 THEN '{"sufficient": true, "score": null, "present": "yes"}' """
        """WHEN 2 THEN '{"sufficient": "YES", "score": 2, "present": "unclear"}' """
        """WHEN 3 THEN '{"sufficient": true, "score": 2, "present": "no"}' """
        f"""WHEN 4 THEN concat('{{"score": "about ', {N}, ' days"}}') """
        """WHEN 5 THEN '{"score": 3, "sufficient": "no"}' """
        """WHEN 6 THEN '{"score": 2.5, "present": "yes"}' """
        f"""WHEN 7 THEN CASE WHEN event_id % 40 = 7 THEN concat('{{"score": 1, "quote": "half ', {HALF}, '"}}') ELSE 'not json' END """
        """WHEN 8 THEN '{"score": 1, "sufficient": 0}' """
        """ELSE '{"score": false, "present": "no", "sufficient": true}' END"""
    ),
)

_LOOSE = (
    "CASE json_type(json_extract(raw, '$.score')) WHEN 'VARCHAR' THEN CASE WHEN "
    "regexp_matches(json_extract_string(raw, '$.score'), '-?\\d+') THEN greatest(0, least(3, "
    "TRY_CAST(regexp_extract(json_extract_string(raw, '$.score'), '-?\\d+') AS BIGINT))) END "
    "ELSE " + whole_sql("raw", "$.score", 0, 3) + " END"
)


@query(
    "typed_item_scores",
    f"""WITH r AS (SELECT * REPLACE ({mended_sql('raw')} AS raw) FROM ({ITEM_SCORES.sql})), v AS (SELECT *, raw LIKE '{{%' AS ok FROM r),
        p AS (SELECT session_id, topic, event_id, ok, CASE WHEN ok THEN {_LOOSE} END AS s,
          CASE WHEN ok THEN lower(json_extract_string(raw, '$.present')) END AS st,
          CASE WHEN ok THEN json_extract(raw, '$.sufficient') END AS suff,
          CASE WHEN ok THEN coalesce(trim(json_extract_string(raw, '$.quote')), '') ELSE '' END AS quote,
          CASE WHEN ok THEN coalesce(lower(json_extract_string(raw, '$.frequency_basis')), 'none')
            ELSE 'none' END AS frequency_basis,
          CASE WHEN ok THEN coalesce(concat_ws(',', json_extract_string(raw, '$.turn_ids[0]'),
            json_extract_string(raw, '$.turn_ids[1]')), '') ELSE '' END AS turn_ids FROM v),
        q AS (SELECT *, CASE WHEN st IN ('yes', 'no', 'unclear') THEN st WHEN s IS NOT NULL THEN 'yes'
            ELSE 'unclear' END AS present,
          CASE WHEN lower(CAST(suff AS VARCHAR)) IN ('true', '"true"', '"yes"', '"y"', '"1"') THEN true
            WHEN lower(CAST(suff AS VARCHAR)) IN ('false', '"false"', '"no"', '"n"', '"0"') THEN false
            ELSE s IS NOT NULL END AS claimed FROM p),
        z AS (SELECT *, claimed AND s IS NOT NULL AND present <> 'unclear' AS sufficient FROM q)
        SELECT session_id, topic, event_id, sufficient, CASE WHEN sufficient THEN CASE WHEN present = 'no'
          THEN 0 ELSE s END END AS score, quote, turn_ids, present, frequency_basis, ok FROM z""",
)
def typed_item_scores(spark, folder):
    df = D.typed_item_scores(ITEM_SCORES.load(spark, folder))
    return df.select(
        "session_id",
        "topic",
        "event_id",
        "sufficient",
        F.col("score").cast("long").alias("score"),
        "quote",
        F.array_join("turn_ids", ",").alias("turn_ids"),
        "present",
        "frequency_basis",
        "ok",
    )


SUFFICIENCY = View(
    "events",
    event_id="event_id",
    raw=(
        "CASE event_id % 5 "
        f"""WHEN 0 THEN concat('{{"sufficient": true, "missing": " m', {ID}, ' "}}') """
        """WHEN 1 THEN '{"sufficient": "No"}' WHEN 2 THEN """
        f"""CASE WHEN event_id % 3 = 0 THEN concat('{{"missing": "', {HALF}, ' frequency"}}') ELSE '{{"missing": "frequency"}}' END """
        """WHEN 3 THEN '{"sufficient": 3}' ELSE 'unsure' END"""
    ),
)


@query(
    "typed_sufficiency",
    f"""WITH r AS (SELECT * REPLACE ({mended_sql('raw')} AS raw) FROM ({SUFFICIENCY.sql})) SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false
        WHEN 3 THEN false END AS sufficient, CASE WHEN raw LIKE '{{%'
        THEN coalesce(trim(json_extract_string(raw, '$.missing')), '') ELSE '' END AS missing FROM r""",
)
def typed_sufficiency(spark, folder):
    return D.typed_sufficiency(SUFFICIENCY.load(spark, folder)).select(
        "event_id", "sufficient", "missing"
    )


QUERY_REPLIES = View(
    "events",
    event_id="event_id",
    raw=(
        f"""concat('{{"queries": ["  Poor   sleep ', {N}, '", "poor SLEEP ', {N}, '", 5, "', """
        f"""CASE WHEN event_id % 3 = 0 THEN repeat('long ', 20) ELSE 'tired' END, '", "q', {ID}, '", "a b", "c", """
        f""""d", "e", "Q', {ID}, '", "f", "g", "h"]}}')"""
    ),
)


@query(
    "typed_queries",
    f"""WITH r AS ({QUERY_REPLIES.sql}), u AS (SELECT event_id, unnest(CAST(json_extract(raw, '$.queries') AS JSON[])) AS e,
          generate_subscripts(CAST(json_extract(raw, '$.queries') AS JSON[]), 1) AS pos FROM r),
        s AS (SELECT event_id, pos, {squash_sql("json_extract_string(e, '$')")} AS q FROM u
          WHERE json_type(e) = 'VARCHAR'),
        d AS (SELECT event_id, min(pos) AS pos, arg_min(q, pos) AS q FROM s
          WHERE q <> '' AND length(q) <= 80 GROUP BY event_id, lower(q)),
        k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS n FROM d)
        SELECT event_id, string_agg(q, '|' ORDER BY pos) AS queries FROM k WHERE n <= 8 GROUP BY 1""",
)
def typed_queries(spark, folder):
    df = D.typed_queries(QUERY_REPLIES.load(spark, folder))
    return df.select("event_id", F.array_join("queries", "|").alias("queries"))


CLAIMS = View(
    "events",
    session_id="user_id",
    topic="event_type",
    event_id="event_id",
    round_index="event_id % 4",
    raw=(
        f"""concat('Here: {{"claims": [{{"polarity": "Supports", "quote": "slept ', {ID}, CASE WHEN event_id % 9 = 2 THEN {HALF} ELSE '' END, '", "turn_ids": ["turn-', {N}, '", "turn-9"], "confidence": ', {N}, ', "frequency_basis": "stated_days"}}, """
        f"""{{"polarity": "refutes", "quote": "', CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'fine' END, '", "turn_ids": ["turn-1", "turn-0"], "confidence": "high", "frequency_basis": "weekly"}}, """
        """{"polarity": "maybe", "quote": "x", "turn_ids": ["turn-1"]}, {"polarity": "uncertain", "quote": "y", "turn_ids": ["turn-8"]}]}')"""
    ),
)

OFFERED = {"turn-0": "context", "turn-1": "reverse", "turn-2": "probe", "turn-3": "context"}


@query(
    "claims",
    f"""WITH r AS (SELECT * REPLACE ({mended_sql('raw')} AS raw) FROM ({CLAIMS.sql})), u AS (SELECT session_id, topic, event_id, round_index,
          unnest(json_extract(regexp_extract(raw, '\\{{.*\\}}'), '$.claims[*]')) AS c FROM r),
        o(turn, rel, k) AS (VALUES ('turn-0', 'context', 3), ('turn-1', 'reverse', 2), ('turn-2', 'probe', 1),
          ('turn-3', 'context', 3)),
        s AS (SELECT session_id, topic, event_id, round_index, lower(json_extract_string(c, '$.polarity')) AS polarity,
          trim(json_extract_string(c, '$.quote')) AS quote,
          list_filter(CAST(json_extract(c, '$.turn_ids') AS VARCHAR[]),
            lambda t: t IN ('turn-0', 'turn-1', 'turn-2', 'turn-3')) AS ids,
          CASE WHEN TRY_CAST(json_extract_string(c, '$.confidence') AS DOUBLE) IS NULL THEN 0.5
            ELSE greatest(0.0, least(1.0, TRY_CAST(json_extract_string(c, '$.confidence') AS DOUBLE))) END AS confidence,
          CASE WHEN json_extract_string(c, '$.frequency_basis') = 'stated_days' THEN 'stated_days' ELSE 'none' END
            AS frequency_basis FROM u)
        SELECT session_id, topic, round_index, polarity, quote, array_to_string(ids, ',') AS turn_ids,
          CAST(confidence AS DOUBLE) AS confidence, frequency_basis,
          CASE WHEN list_contains(ids, 'turn-2') THEN 'probe' WHEN list_contains(ids, 'turn-1') THEN 'reverse'
            ELSE 'context' END AS relation,
          sha256('{{"participant":"' || session_id || '","quote":"' || quote || '","topic":"' || topic
            || '","turn_ids":["' || array_to_string(ids, '","') || '"]}}') AS record_id
        FROM s WHERE polarity IN ('supports', 'refutes', 'uncertain') AND quote <> '' AND len(ids) > 0""",
)
def claims(spark, folder):
    pairs = [x for kv in OFFERED.items() for x in kv]
    df = CLAIMS.load(spark, folder).withColumn("offered", F.create_map(*map(F.lit, pairs)))
    return D.claims(df).select(
        "session_id",
        "topic",
        "round_index",
        "polarity",
        "quote",
        F.array_join("turn_ids", ",").alias("turn_ids"),
        "confidence",
        "frequency_basis",
        "relation",
        "record_id",
    )


LESSONS = View(
    "events",
    event_id="event_id",
    role="CASE WHEN event_id % 2 = 0 THEN 'scorer' ELSE 'interviewer' END",
    scope="concat(event_type, '|lexical')",
    raw=(
        f"""concat('{{"trigger": " t  ', {ID}, CASE WHEN event_id % 9 = 4 THEN {HALF} ELSE '' END, '", "do": "', CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'match the Ground Truth' """
        """ELSE 'ask again' END, '", "avoid": "guessing", "criterion": "ok", "confidence": 0.5}')"""
    ),
)


@query(
    "lesson_candidates",
    f"""WITH r AS (SELECT * REPLACE ({mended_sql('raw')} AS raw) FROM ({LESSONS.sql})), f AS (SELECT event_id, role, scope,
          {squash_sql("json_extract_string(raw, '$.trigger')")} AS "trigger", json_extract_string(raw, '$.do') AS "do",
          json_extract_string(raw, '$.avoid') AS "avoid", json_extract_string(raw, '$.criterion') AS criterion FROM r)
        SELECT event_id, "trigger", "do", sha256('{{"avoid":"' || "avoid" || '","criterion":"' || criterion || '","do":"'
          || "do" || '","role":"' || role || '","scope":"' || scope || '","trigger":"' || "trigger" || '"}}') AS lesson_id
        FROM f WHERE "do" <> '' AND NOT regexp_matches("do", '(?i){K.LABEL_LEAK}')""",
)
def lesson_candidates(spark, folder):
    return D.lesson_candidates(LESSONS.load(spark, folder)).select(
        "event_id", "trigger", "do", "lesson_id"
    )


RECORDS = View(
    "orders",
    session_id="o_orderkey",
    assessment_valid="CASE o_orderstatus WHEN 'P' THEN false WHEN 'F' THEN true END",
    total_predicted_score="CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 25 END",
    ground_truth_total="CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 25 END",
)


@query(
    "valid_records",
    f"""SELECT * FROM ({RECORDS.sql}) WHERE coalesce(assessment_valid, true)
        AND total_predicted_score IS NOT NULL AND ground_truth_total IS NOT NULL""",
)
def valid_records(spark, folder):
    return D.valid_records(RECORDS.load(spark, folder))


# --- grounding --------------------------------------------------------------------


@query(
    "citation_check",
    """WITH c AS (SELECT event_id, ['turn-' || event_id % 7, 'turn-' || event_id % 11] AS cited,
         ['turn-0', 'turn-1', 'turn-2', 'turn-' || event_id % 13] AS allowed FROM events)
       SELECT event_id, array_to_string(list_filter(cited, lambda x: NOT list_contains(allowed, x)), ',')
         AS bad_citations, len(list_filter(cited, lambda x: NOT list_contains(allowed, x))) > 0
         AS citation_mismatch FROM c""",
)
def citation_check(spark, folder):
    def turn(n):
        return F.concat(F.lit("turn-"), (F.col("event_id") % n).cast("string"))

    df = table(spark, folder, "events").select(
        "event_id",
        F.array(turn(7), turn(11)).alias("cited"),
        F.array(F.lit("turn-0"), F.lit("turn-1"), F.lit("turn-2"), turn(13)).alias("allowed"),
    )
    return G.citation_check(df).select(
        "event_id", F.array_join("bad_citations", ",").alias("bad_citations"), "citation_mismatch"
    )


_RUN_SQL = (
    "len(list_filter(range(1, len(words) - 3), lambda i: contains(e, "
    "array_to_string(words[i:i + 4], ' ')))) > 0"
)


@query(
    "ground_quotes",
    f"""WITH q AS (SELECT item_id AS quote_id, {squash_sql('lower(text)')} AS q FROM benchmark),
        w AS (SELECT *, regexp_extract_all(q, '[a-z0-9'']+') AS words FROM q),
        d AS (SELECT doc_id, {squash_sql('lower(text)')} AS e FROM documents)
        SELECT quote_id, doc_id FROM w, d WHERE q <> '' AND (contains(e, q) OR {_RUN_SQL})""",
)
def ground_quotes(spark, folder):
    quotes = table(spark, folder, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return G.ground_quotes(quotes, documents)


@query(
    "quote_grounded",
    f"""WITH t AS (SELECT conv_id AS session_id, turn AS turn_idx, {squash_sql('lower(text)')} AS e,
          {squash_sql("lower(substr(text, 1 + turn * 3, 40))")} AS q FROM conversations),
        w AS (SELECT *, regexp_extract_all(q, '[a-z0-9'']+') AS words FROM t)
        SELECT session_id, turn_idx, q <> '' AND (contains(e, q) OR {_RUN_SQL}) AS grounded FROM w""",
)
def quote_grounded(spark, folder):
    df = table(spark, folder, "conversations")
    quote = F.substring("text", 1 + F.col("turn") * 3, F.lit(40))
    return df.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_idx"),
        G.quote_grounded(quote, F.col("text")).alias("grounded"),
    )


@query(
    "faithfulness",
    """WITH t AS (SELECT conv_id AS session_id, turn AS turn_idx, lag(text) OVER (PARTITION BY conv_id ORDER BY turn)
         AS evidence, text AS reply FROM conversations),
       w AS (SELECT session_id, turn_idx, list_distinct(regexp_extract_all(lower(reply), '[a-z]{4,}')) AS a,
         list_distinct(regexp_extract_all(lower(evidence), '[a-z]{4,}')) AS b FROM t WHERE evidence IS NOT NULL),
       o AS (SELECT session_id, turn_idx, CASE WHEN turn_idx % 4 <> 3 AND len(a) > 0 AND len(b) > 0
         THEN len(list_intersect(a, b)) / len(a) END AS overlap FROM w)
       SELECT session_id, turn_idx, round(overlap, 6) + 0.0 AS overlap,
         coalesce(overlap < 0.15, false) AS low_faithfulness FROM o""",
)
def faithfulness(spark, folder):
    t = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    df = t.join(before, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_idx"),
        F.when(F.col("turn") % 4 != 3, "known").otherwise("missing").alias("status"),
        F.col("text").alias("reply"),
        "evidence",
    )
    return G.faithfulness(df).select(
        "session_id", "turn_idx", F.round("overlap", 6).alias("overlap"), "low_faithfulness"
    )


SCORES = View(
    "events",
    event_id="event_id",
    score="event_id % 4",
    status="CASE WHEN event_id % 3 = 0 THEN 'missing' ELSE 'known' END",
    low_faithfulness="value < 30",
)


@query(
    "ground_scores",
    f"""WITH s AS (SELECT *, score > 0 AND status <> 'known' AS grounding_overridden FROM ({SCORES.sql})),
        g AS (SELECT *, CASE WHEN grounding_overridden THEN 0 ELSE score END AS g FROM s)
        SELECT event_id, grounding_overridden, low_faithfulness AND g > 1 AS faithfulness_capped,
          CASE WHEN low_faithfulness AND g > 1 THEN 1 ELSE g END AS final_score FROM g""",
)
def ground_scores(spark, folder):
    return G.ground_scores(SCORES.load(spark, folder)).select(
        "event_id", "grounding_overridden", "faithfulness_capped", F.col("final_score").cast("long")
    )


@query(
    "accept_revisions",
    """WITH s AS (SELECT user_id AS session_id, event_type AS topic, CAST(sum(event_id) AS BIGINT) AS k
         FROM events GROUP BY 1, 2),
       r AS (SELECT session_id, topic, k % 4 AS score, k % 3 > 0 AS known, k % 5 AS new_score,
         k % 5 < 4 AS has, k % 7 AS cited, k % 6 AS cited2, k % 11 = 0 AS none FROM s),
       a AS (SELECT *, has AND NOT none AND cited < 5 AND cited2 < 5 AND NOT (new_score > 0 AND NOT known)
         AS revised FROM r)
       SELECT session_id, topic, CASE WHEN revised THEN new_score ELSE score END AS score, revised FROM a""",
)
def accept_revisions(spark, folder):
    k = F.col("k")
    s = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("topic"))
        .agg(F.sum("event_id").alias("k"))
    )
    allowed = F.array(*(F.lit(f"turn-{i}") for i in range(5)))
    scores = s.select(
        "session_id",
        "topic",
        (k % 4).alias("score"),
        F.when(k % 3 > 0, "known").otherwise("missing").alias("status"),
        allowed.alias("allowed"),
    )
    cited = F.array(
        F.concat(F.lit("turn-"), (k % 7).cast("string")), F.concat(F.lit("turn-"), (k % 6).cast("string"))
    )
    revisions = s.filter(k % 5 < 4).select(
        "session_id",
        "topic",
        (k % 5).alias("new_score"),
        F.when(k % 11 == 0, F.slice(cited, 1, 0)).otherwise(cited).alias("cited"),
    )
    return G.accept_revisions(scores, revisions).select("session_id", "topic", "score", "revised")


@query(
    "necessity_rules",
    """WITH n AS (SELECT event_id, CASE WHEN event_id % 3 = 0 OR value < 40 THEN 0 ELSE 1 END AS necessity,
         event_id % 4 AS asked FROM events)
       SELECT event_id, CAST(necessity AS BIGINT) AS necessity,
         asked < 3 AND (necessity = 2 OR (necessity = 1 AND asked < 2)) AS continue_asking FROM n""",
)
def necessity_rules(spark, folder):
    status = F.when(F.col("event_id") % 3 == 0, "missing").otherwise("known")
    necessity = G.necessity_default(status, F.col("value") < 40)
    return table(spark, folder, "events").select(
        "event_id",
        necessity.cast("long").alias("necessity"),
        G.continue_asking(necessity, F.col("event_id") % 4).alias("continue_asking"),
    )
