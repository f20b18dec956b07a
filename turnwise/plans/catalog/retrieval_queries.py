"""Tiered retrieval over the pairs of ``MIXED`` turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import constants as K
from ...operators import retrieval as R
from .base import query, squash_sql, strings, strip_sql
from .turn_queries import (
    LEXICON,
    MIXED,
    PAIRS_CTE,
    RUNS_CTE,
    TAG_TOPIC,
    TURNS,
    mixed_pairs,
    stored_pairs,
)

TOPICS = ["sleep", "mood", "energy", "focus"]

QUERIES = {
    "sleep": ["the thing inst", "erly onre", "of the"],
    "mood": ["ont le la", "thanst the thin", "tion  The", "anon"],
    "energy": ["und ieer", "lich und sch", "eron"],
    "focus": ["zzzz nowhere", "it is"],
}

EDGES = {
    "tag_0": [
        {"topic": "sleep", "relation": "probe", "strength": "direct"},
        {"topic": "energy", "relation": "reverse", "strength": "indirect"},
    ],
    "tag_1": [
        {"topic": "mood", "relation": "reverse", "strength": "indirect"},
        {"topic": "mood", "relation": "probe", "strength": "direct"},
        {"topic": K.CROSS_CUTTING, "relation": "context", "strength": "indirect"},
    ],
    "tag_2": [{"topic": K.CROSS_CUTTING, "relation": "context", "strength": "direct"}],
}

NEW_QUERIES = {"sleep": ["thand on", "les an"], "mood": ["eine chie"], "focus": ["shan re", "enen"]}

MATCHED = "array_to_string(matched, ' ')"


def terms_sql(x: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z'']+'), "
        f"lambda w: length(w) > 2 AND NOT list_contains({strings(K.STOPWORDS)}, w)))"
    )


def queries_values(queries) -> str:
    rows = [
        "('{}', {}, '{}')".format(t, i, q.replace("'", "''"))
        for t, listed in queries.items()
        for i, q in enumerate(listed)
    ]
    return ", ".join(rows)


def search_cte(queries, name: str = "hits") -> str:
    """Every scored (pair, topic) at 0.5 or more, before ranking."""
    return f"""
{name}_q AS (SELECT topic, qi, {terms_sql('query')} AS terms, {squash_sql('lower(query)')} AS phrase
       FROM (VALUES {queries_values(queries)}) v(topic, qi, query)),
{name}_w AS (SELECT session_id, turn_id, lower(question || ' ' || answer) AS text,
       unnest({terms_sql("question || ' ' || answer")}) AS token FROM pairs),
{name}_df AS (SELECT session_id, token, count(*) AS df FROM {name}_w GROUP BY 1, 2),
{name}_n AS (SELECT session_id, count(*) AS n FROM pairs GROUP BY 1),
{name}_o AS (SELECT w.session_id, w.turn_id, topic, qi, list(w.token) AS overlap,
       sum(ln(1.0 + n / (1.0 + df))) * (0.5 + 0.5 * count(*) / any_value(len(terms)))
         * CASE WHEN contains(any_value(w.text), any_value(phrase)) THEN 1.75 ELSE 1.0 END AS s
     FROM {name}_w w JOIN {name}_q q ON list_contains(q.terms, w.token)
     JOIN {name}_df d ON d.session_id = w.session_id AND d.token = w.token
     JOIN {name}_n c ON c.session_id = w.session_id
     GROUP BY 1, 2, 3, 4),
{name} AS (SELECT session_id, turn_id, topic, round(max(s), 9) AS score,
       list_sort(list_distinct(flatten(list(overlap)))) AS matched
     FROM {name}_o GROUP BY 1, 2, 3 HAVING round(max(s), 9) >= 0.5)"""


EDGE_VALUES = ", ".join(
    f"('{tag}', {i}, '{e['topic']}', '{e['relation']}', '{e['strength']}')"
    for tag, listed in EDGES.items()
    for i, e in enumerate(listed)
)

ANCHOR_CTE = f"""
edges(tag, edge_pos, topic, relation, strength) AS (VALUES {EDGE_VALUES}),
anchors AS (SELECT session_id, turn_id, turn_idx, edge_pos, topic,
     CASE WHEN topic = 'CROSS_CUTTING' THEN 0.5 WHEN strength = 'direct' THEN 3.0 ELSE 2.0 END AS score,
     CASE WHEN topic = 'CROSS_CUTTING' THEN 'contextual' WHEN strength = 'direct' THEN 'direct'
          ELSE 'lexical' END AS tier,
     CASE WHEN topic = 'CROSS_CUTTING' THEN 'context' ELSE relation END AS relation
   FROM pairs JOIN edges ON pairs.tag = edges.tag)"""

RETRIEVED_CTE = f"""{PAIRS_CTE}, {ANCHOR_CTE}, {search_cte(QUERIES)},
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, topic, turn_id
          ORDER BY score DESC, edge_pos) AS k FROM anchors WHERE topic <> 'CROSS_CUTTING') WHERE k = 1),
cand AS (SELECT session_id, topic, 0 AS grp, score, turn_id, tier, relation, '' AS matched FROM own
   UNION ALL SELECT session_id, topic, 1, score, turn_id, 'lexical', 'probe', {MATCHED} FROM hits
     WHERE (session_id, topic, turn_id) NOT IN (SELECT session_id, topic, turn_id FROM own)),
spec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, topic
          ORDER BY grp, score DESC, turn_id) AS rank FROM cand) WHERE rank <= 8),
ctx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_idx) AS rank
        FROM (SELECT DISTINCT session_id, turn_id, turn_idx FROM anchors WHERE topic = 'CROSS_CUTTING'))
        WHERE rank <= 3),
topics(topic) AS (VALUES {", ".join(f"('{t}')" for t in QUERIES)}),
retrieved AS (SELECT session_id, topic, rank, turn_id, score, tier, relation, matched FROM spec
   UNION ALL SELECT session_id, topic, rank, turn_id, 0.5, 'contextual', 'context', ''
     FROM ctx, topics WHERE (session_id, topic) NOT IN (SELECT session_id, topic FROM spec)),
everyone AS (SELECT DISTINCT session_id, topic FROM pairs, topics)"""


def retrieved(spark, folder):
    return R.retrieve_topics(stored_pairs(spark, folder), EDGES, QUERIES)


def shown(df):
    return df.select(
        "session_id",
        "topic",
        F.col("rank").cast("long").alias("rank"),
        "turn_id",
        "score",
        "tier",
        "relation",
        F.array_join("matched", " ").alias("matched"),
    )


NEGATED_PART = (
    "regexp_matches(replace(array_to_string(parts[1:i], chr(1)), chr(1), keyword), "
    + "'(?:{cues})\\S*(?:\\s+\\S+){{0,{gap}}}\\s*$')".format(
        cues="|".join(c.replace("'", "''") for c in K.NEGATION_CUES), gap=K.NEGATION_WINDOW - 1
    )
)

HITS_LEXICON = {
    "sleep": ["the", "in", "er the"],
    "mood": ["tion", "ou an", "enhei"],
    "energy": ["que la", "not", "und", "re"],
}


def keyword_cte(lexicon, source: str) -> str:
    values = ", ".join(f"('{t}', '{w}')" for t, words in lexicon.items() for w in words)
    return f"""
lex(topic, keyword) AS (VALUES {values}),
occ AS (SELECT session_id, turn_idx, topic, keyword, string_split(lower(text), keyword) AS parts
        FROM {source}, lex WHERE contains(lower(text), keyword)),
plain AS (SELECT session_id, turn_idx, topic FROM occ WHERE len(list_filter(range(1, len(parts)),
        lambda i: NOT {NEGATED_PART})) > 0),
kw AS (SELECT session_id, turn_idx, topic, count(*) AS hits FROM plain GROUP BY 1, 2, 3)"""


@query(
    "keyword_hits",
    f"WITH t AS ({TURNS.sql}), {keyword_cte(HITS_LEXICON, 't')} SELECT * FROM kw",
)
def keyword_hits(spark, folder):
    return R.keyword_hits(TURNS.load(spark, folder), HITS_LEXICON).withColumn(
        "hits", F.col("hits").cast("long")
    )


TAG_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in TAG_TOPIC.items())

BUNDLE_CTE = f"""{RUNS_CTE}, m(tag, topic) AS (VALUES {TAG_VALUES}),
ans AS (SELECT r.session_id, r.turn_idx, r.text, m.topic AS anchor,
     coalesce(r.prev_role <> 'answer' AND regexp_matches(r.prev_text,
       '(?i){K.HYPOTHETICAL.replace("'", "''")}'), false) AS hypo
   FROM r LEFT JOIN q ON r.session_id = q.session_id AND r.run = q.run
   LEFT JOIN m ON q.tag = m.tag WHERE r.role = 'answer'),
{keyword_cte(LEXICON, "(SELECT session_id, turn_idx, text FROM ans WHERE NOT hypo)")},
hit AS (SELECT session_id, anchor AS topic, 0 AS grp, turn_idx, text, 0 AS hits FROM ans
     WHERE anchor IS NOT NULL
   UNION ALL SELECT kw.session_id, kw.topic, 1, kw.turn_idx, ans.text, kw.hits FROM kw
     JOIN ans ON ans.session_id = kw.session_id AND ans.turn_idx = kw.turn_idx
     WHERE ans.anchor IS DISTINCT FROM kw.topic),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, topic ORDER BY grp, hits DESC,
     CASE WHEN grp = 1 THEN -length(text) ELSE 0 END, turn_idx) AS rank FROM hit),
bundle AS (SELECT session_id, topic, rank, 'turn-' || turn_idx AS turn_id,
     CASE WHEN topic = 'CROSS_CUTTING' THEN 'cross_cutting' WHEN grp = 0 THEN 'tag_anchor'
       ELSE 'keyword' END AS source, hits, text
   FROM ranked WHERE rank <= CASE WHEN topic = 'CROSS_CUTTING' THEN 3 ELSE 6 END),
btopics(topic) AS (VALUES {", ".join(f"('{t}')" for t in TOPICS)}),
bstatus AS (SELECT s.session_id, s.topic, CASE WHEN count(b.turn_id) > 0 THEN 'known'
     ELSE 'missing' END AS status, count(b.turn_id) AS snippets
   FROM (SELECT DISTINCT session_id, topic FROM t, btopics) s
   LEFT JOIN bundle b ON b.session_id = s.session_id AND b.topic = s.topic GROUP BY 1, 2)"""


def bundles(spark, folder):
    turns = MIXED.load(spark, folder)
    return turns, R.bundle_rows(turns, TOPICS, TAG_TOPIC, LEXICON, "answer")


@query("evidence_bundle", f"WITH {BUNDLE_CTE} SELECT * FROM bundle")
def evidence_bundle(spark, folder):
    _, rows = bundles(spark, folder)
    return rows.withColumns(
        {"rank": F.col("rank").cast("long"), "hits": F.col("hits").cast("long")}
    )


@query("evidence_bundle_status", f"WITH {BUNDLE_CTE} SELECT * FROM bstatus")
def evidence_bundle_status(spark, folder):
    turns, rows = bundles(spark, folder)
    return R.bundle_status(rows, turns, TOPICS)


@query(
    "render_bundles",
    f"""WITH {BUNDLE_CTE}, b AS (SELECT session_id, topic,
          string_agg('[' || turn_id || '] Participant: ' || text, chr(10) ORDER BY rank) AS block
        FROM bundle GROUP BY 1, 2)
        SELECT s.session_id, s.topic, coalesce(o.block,
          '{K.BUNDLE_CONTEXT_TEXT.strip()}' || chr(10) || c.block, '{K.BUNDLE_EMPTY_TEXT}') AS evidence
        FROM bstatus s LEFT JOIN b o ON o.session_id = s.session_id AND o.topic = s.topic
        LEFT JOIN b c ON c.session_id = s.session_id AND c.topic = 'CROSS_CUTTING'""",
)
def render_bundles(spark, folder):
    turns, rows = bundles(spark, folder)
    return R.render_bundles(rows, turns, TOPICS)


@query(
    "doc_freq",
    f"""WITH {PAIRS_CTE}, w AS (SELECT session_id,
          unnest({terms_sql("question || ' ' || answer")}) AS token FROM pairs)
        SELECT session_id, token, count(*) AS df FROM w GROUP BY 1, 2""",
)
def doc_freq(spark, folder):
    return R.doc_freq(mixed_pairs(spark, folder))


@query(
    "search_pairs",
    f"""WITH {PAIRS_CTE}, {search_cte(QUERIES)}
        SELECT session_id, topic, row_number() OVER (PARTITION BY session_id, topic
          ORDER BY score DESC, turn_id) AS rank, turn_id, score, 'expanded' AS tier,
          'probe' AS relation, {MATCHED} AS matched FROM hits
        QUALIFY row_number() OVER (PARTITION BY session_id, topic ORDER BY score DESC, turn_id) <= 3""",
)
def search_pairs(spark, folder):
    return shown(R.search_pairs(stored_pairs(spark, folder), QUERIES, 3))


@query(
    "tag_anchored",
    f"""WITH {PAIRS_CTE}, {ANCHOR_CTE} SELECT session_id, turn_id, edge_pos, topic,
        CAST(score AS DOUBLE) AS score, tier, relation FROM anchors""",
)
def tag_anchored(spark, folder):
    return R.tag_anchored(mixed_pairs(spark, folder), EDGES).select(
        "session_id",
        "turn_id",
        F.col("edge_pos").cast("long").alias("edge_pos"),
        "topic",
        F.col("score").cast("double").alias("score"),
        "tier",
        "relation",
    )


@query(
    "merge_retrieved",
    f"""WITH {PAIRS_CTE}, {search_cte(QUERIES, 'ha')}, {search_cte(NEW_QUERIES, 'hb')},
        g AS (SELECT *, row_number() OVER (PARTITION BY session_id, topic ORDER BY score DESC,
                turn_id) AS pos, 0 AS grp FROM ha UNION ALL
              SELECT *, row_number() OVER (PARTITION BY session_id, topic ORDER BY score DESC,
                turn_id) AS pos, 1 AS grp FROM hb),
        k AS (SELECT * FROM g WHERE pos <= 3 QUALIFY row_number() OVER (PARTITION BY session_id,
              topic, turn_id ORDER BY grp, pos) = 1),
        o AS (SELECT session_id, topic, turn_id, score, row_number() OVER
              (PARTITION BY session_id, topic ORDER BY grp, pos) AS rank FROM k)
        SELECT * FROM o WHERE rank <= 4""",
)
def merge_retrieved(spark, folder):
    pairs = stored_pairs(spark, folder)
    parts = [
        R.search_pairs(pairs, q, 3).withColumnRenamed("rank", "pos").withColumn("grp", F.lit(i))
        for i, q in enumerate((QUERIES, NEW_QUERIES))
    ]
    merged = R.merge_retrieved(parts[0].unionByName(parts[1]), 4)
    return merged.select(
        "session_id", "topic", "turn_id", "score", F.col("rank").cast("long").alias("rank")
    )


@query(
    "retrieve_topics",
    f"""WITH {RETRIEVED_CTE} SELECT session_id, topic, rank, turn_id,
        CAST(score AS DOUBLE) AS score, tier, relation, matched FROM retrieved""",
)
def retrieve_topics(spark, folder):
    return shown(retrieved(spark, folder))


TIERS_SQL = f"""{RETRIEVED_CTE}, tiers AS (SELECT e.session_id, e.topic,
   ({strings(K.TIERS)})[coalesce(max(list_position({strings(K.TIERS)}, r.tier)), 1)] AS tier
   FROM everyone e LEFT JOIN retrieved r ON r.session_id = e.session_id AND r.topic = e.topic
   GROUP BY 1, 2)"""


@query("overall_tier", f"WITH {TIERS_SQL} SELECT * FROM tiers")
def overall_tier(spark, folder):
    pairs = stored_pairs(spark, folder)
    return R.overall_tier(R.retrieve_topics(pairs, EDGES, QUERIES), pairs, list(QUERIES))


EXPAND_CTE = f"""{RETRIEVED_CTE}, {search_cte(NEW_QUERIES, 'more')},
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, topic
     ORDER BY score DESC, turn_id) AS pos FROM more WHERE (session_id, topic, turn_id) NOT IN
     (SELECT session_id, topic, turn_id FROM retrieved)) WHERE pos <= 8),
grown AS (SELECT *, row_number() OVER (PARTITION BY session_id, topic ORDER BY grp, pos) AS rank FROM
   (SELECT session_id, topic, turn_id, score, tier, relation, matched, 0 AS grp, rank AS pos FROM retrieved
    UNION ALL SELECT session_id, topic, turn_id, score, 'expanded', 'probe', {MATCHED}, 1, pos
    FROM found))"""


@query(
    "expand",
    f"""WITH {EXPAND_CTE} SELECT session_id, topic, rank, turn_id, CAST(score AS DOUBLE) AS score,
        tier, relation, matched FROM grown WHERE rank <= 8""",
)
def expand(spark, folder):
    pairs = stored_pairs(spark, folder)
    state = R.retrieve_topics(pairs, EDGES, QUERIES)
    asked = F.array(
        *(F.struct(F.lit(t).alias("topic"), F.lit(q).alias("queries")) for t, q in NEW_QUERIES.items())
    )
    requests = (
        pairs.select("session_id").distinct().select("session_id", F.explode(asked).alias("a"))
    ).select("session_id", "a.*")
    return shown(R.expand(state, pairs, requests))


@query(
    "flatten_polarity",
    f"WITH {RETRIEVED_CTE} SELECT session_id, topic, rank, turn_id, tier, 'probe' AS relation FROM retrieved",
)
def flatten_polarity(spark, folder):
    return R.flatten_polarity(shown(retrieved(spark, folder))).drop("score", "matched")


def _block_sql(relation: str) -> str:
    header = K.RELATION_HEADERS[relation].replace("'", "''")
    return (
        f"'{header}' || chr(10) || string_agg(CASE WHEN question <> '' THEN '  [' || r.turn_id || "
        f"'] Interviewer: ' || question || chr(10) ELSE '' END || '  [' || r.turn_id || "
        f"'] Participant: ' || answer, chr(10) ORDER BY rank) FILTER (WHERE r.relation = '{relation}')"
    )


@query(
    "render_evidence",
    f"""WITH {RETRIEVED_CTE}, b AS (SELECT r.session_id, r.topic, concat_ws(chr(10) || chr(10),
          {", ".join(_block_sql(r) for r in K.RELATIONS)}) AS block
        FROM retrieved r JOIN pairs p ON p.session_id = r.session_id AND p.turn_id = r.turn_id
        GROUP BY 1, 2)
        SELECT e.session_id, e.topic, coalesce(block, '{K.NO_EVIDENCE_TEXT}') AS evidence
        FROM everyone e LEFT JOIN b ON b.session_id = e.session_id AND b.topic = e.topic""",
)
def render_evidence(spark, folder):
    pairs = stored_pairs(spark, folder)
    found = R.retrieve_topics(pairs, EDGES, QUERIES)
    return R.render_evidence(found, pairs, pairs, list(QUERIES))


@query(
    "coverage_report",
    f"""WITH {TIERS_SQL}, c AS (SELECT topic, tier, count(*) AS n FROM tiers GROUP BY 1, 2
        UNION ALL SELECT '(all)', tier, count(*) FROM tiers GROUP BY 2)
        SELECT topic, tier, n, round(n / sum(n) OVER (PARTITION BY topic), 9) AS share FROM c""",
)
def coverage_report(spark, folder):
    return R.coverage_report(overall_tier(spark, folder)).withColumn("share", F.round("share", 9))
