"""Tiered retrieval: keyword bundles, idf search, tag anchors, merging, rendering.

Settings (lexicon, seed queries, tag edges) are small mappings that become literals
of the plan, so scoring a pair is a row-wise expression: no join multiplies the
transcript by the queries. Only the per-session document frequencies need a shuffle,
and they are limited to tokens that occur in a query.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.segments import SEGMENT_ROWS, position_segment, top_k
from .turns import _with_prompt, turn_id

Queries = Mapping[str, Sequence[str]]
Edges = Mapping[str, Sequence[Mapping[str, str]]]

_SEG = "__seg"
_PART = "__part"


# --- first generation: flat tags and keyword lexicon --------------------------


def keyword_counts(text: Column, lexicon: Queries) -> Column:
    """``array<struct<topic, hits>>`` of keywords occurring unnegated, by topic."""

    def counts(lowered: Column) -> Column:
        return F.array(
            *(
                F.struct(
                    F.lit(topic).alias("topic"),
                    F.size(
                        F.filter(
                            F.lit([w.lower() for w in words]),
                            lambda w: T.plain_occurrence(lowered, w),
                        )
                    ).alias("hits"),
                )
                for topic, words in lexicon.items()
            )
        )

    return T.let(F.lower(text), counts)


def keyword_hits(turns: DataFrame, lexicon: Queries) -> DataFrame:
    """Per (turn, topic) the number of lexicon entries that occur unnegated."""
    counted = F.filter(keyword_counts(F.col("text"), lexicon), lambda e: e["hits"] > 0)
    return turns.select("session_id", "turn_idx", F.explode(counted).alias("e")).select(
        "session_id", "turn_idx", "e.topic", "e.hits"
    )


def bundle_rows(
    turns: DataFrame,
    topics: Sequence[str],
    tag_map: Mapping[str, str],
    lexicon: Queries,
    participant_role: str = "Participant",
    max_specific: int = 6,
    max_cross_cutting: int = 3,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Snippets per (session, topic): tag hits first, then keyword hits.

    ``source`` is ``tag_anchor``, ``keyword`` or ``cross_cutting``; the latter carry
    the topic ``CROSS_CUTTING`` and serve every topic of the session.
    """
    speaks = F.col("role") == participant_role
    lookup = F.create_map(*(F.lit(x) for x in chain.from_iterable(tag_map.items())))
    rows = (
        _with_prompt(
            turns,
            participant_role,
            segment_rows,
            lags={"hypothetical": ~speaks & T.asks_hypothetical(F.col("text"))},
        )
        .filter(speaks)
        .withColumn("anchor", F.element_at(lookup, F.col("prompt.tag")))
    )
    counts = F.filter(
        keyword_counts(F.col("text"), lexicon),
        lambda e: (e["hits"] > 0) & ~e["topic"].eqNullSafe(F.col("anchor")),
    )
    keyword = F.transform(
        F.when(F.coalesce("hypothetical", F.lit(False)), F.slice(counts, 1, 0)).otherwise(counts),
        lambda e: F.struct(
            F.lit(1).alias("grp"), e["topic"].alias("topic"), e["hits"].alias("hits")
        ),
    )
    anchored = F.array(
        F.struct(F.lit(0).alias("grp"), F.col("anchor").alias("topic"), F.lit(0).alias("hits"))
    )
    known = [*topics, K.CROSS_CUTTING]
    hits = (
        rows.select(
            "session_id",
            "turn_idx",
            "text",
            F.explode(
                F.concat(
                    F.when(F.col("anchor").isNotNull(), anchored).otherwise(F.slice(anchored, 1, 0)),
                    keyword,
                )
            ).alias("e"),
        )
        .select("session_id", "turn_idx", "text", "e.*")
        .filter(F.col("topic").isin(known))
    )
    length = F.when(F.col("grp") == 1, -F.length("text")).otherwise(0)
    ranked = top_k(
        hits,
        ["session_id", "topic"],
        [F.col("grp"), -F.col("hits"), length, F.col("turn_idx")],
        max(max_specific, max_cross_cutting),
    )
    cross = F.col("topic") == K.CROSS_CUTTING
    return ranked.filter(
        F.col("rank") <= F.when(cross, max_cross_cutting).otherwise(max_specific)
    ).select(
        "session_id",
        "topic",
        "rank",
        turn_id("turn_idx").alias("turn_id"),
        F.when(cross, "cross_cutting")
        .when(F.col("grp") == 0, "tag_anchor")
        .otherwise("keyword")
        .alias("source"),
        "hits",
        "text",
    )


def topics_of_sessions(sessions: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Every session with every topic (the topic list is a literal)."""
    listed = F.array(
        *(F.struct(F.lit(i).alias("ord"), F.lit(t).alias("topic")) for i, t in enumerate(topics))
    )
    return (
        sessions.select("session_id")
        .distinct()
        .select("session_id", F.explode(listed).alias("t"))
        .select("session_id", F.col("t.topic").alias("topic"), F.col("t.ord").alias("topic_ord"))
    )


def bundle_status(bundles: DataFrame, sessions: DataFrame, topics: Sequence[str]) -> DataFrame:
    """``known``/``missing`` and the snippet count for every (session, topic)."""
    counted = bundles.groupBy("session_id", "topic").agg(F.count("*").alias("n"))
    return (
        topics_of_sessions(sessions, topics)
        .join(counted, ["session_id", "topic"], "left")
        .select(
            "session_id",
            "topic",
            F.when(F.col("n") > 0, "known").otherwise("missing").alias("status"),
            F.coalesce("n", F.lit(0)).cast("long").alias("snippets"),
        )
    )


def render_bundles(bundles: DataFrame, sessions: DataFrame, topics: Sequence[str]) -> DataFrame:
    """One text per (session, topic), from at most nine snippets each."""
    line = F.concat(F.lit("["), F.col("turn_id"), F.lit("] Participant: "), F.col("text"))
    blocks = bundles.groupBy("session_id", "topic").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))),
                lambda s: s["line"],
            ),
            "\n",
        ).alias("block")
    )
    own = blocks.filter(F.col("topic") != K.CROSS_CUTTING)
    mood = blocks.filter(F.col("topic") == K.CROSS_CUTTING).select(
        "session_id", F.col("block").alias("mood")
    )
    return (
        topics_of_sessions(sessions, topics)
        .join(own, ["session_id", "topic"], "left")
        .join(mood, "session_id", "left")
        .select(
            "session_id",
            "topic",
            F.coalesce(
                "block",
                F.concat(F.lit(K.BUNDLE_CONTEXT_TEXT), F.col("mood")),
                F.lit(K.BUNDLE_EMPTY_TEXT),
            ).alias("evidence"),
        )
    )


# --- idf search -----------------------------------------------------------------


def pair_text() -> Column:
    return F.concat_ws(" ", F.col("question"), F.col("answer"))


def doc_freq(pairs: DataFrame) -> DataFrame:
    """Per (session, token) the number of pairs that contain the token."""
    return (
        pairs.select("session_id", F.explode(T.terms(pair_text())).alias("token"))
        .groupBy("session_id", "token")
        .agg(F.count("*").alias("df"))
    )


def _prepared(queries: Column) -> Column:
    """``array<string>`` to ``array<struct<terms, phrase>>`` without empty queries."""
    made = F.transform(
        queries,
        lambda q: F.struct(T.terms(q).alias("terms"), T.squash(F.lower(q)).alias("phrase")),
    )
    return F.filter(made, lambda p: F.size(p["terms"]) > 0)


def _query_terms(query: str) -> list[str]:
    """Distinct tokens of a settings query; the same rule as ``text.terms``."""
    words = re.findall(r"[a-z']{3,}", query.lower())
    return list(dict.fromkeys(w for w in words if w not in K.STOPWORDS))


def _prepared_literal(queries: Sequence[str]) -> Column:
    """``_prepared`` of settings queries as a literal, so that no row tokenizes them again."""
    made = [
        F.struct(F.lit(_query_terms(q)).alias("terms"), F.lit(" ".join(q.lower().split())).alias("phrase"))
        for q in queries
        if _query_terms(q)
    ]
    empty = F.struct(
        F.lit([]).cast("array<string>").alias("terms"), F.lit("").alias("phrase")
    )
    return F.array(*made) if made else F.slice(F.array(empty), 1, 0)


def _score(text: Column, words: Column, prepared: Column, n: Column, df: Column) -> Column:
    """Best query score and the union of matched terms for one pair."""

    def one(p: Column) -> Column:
        def with_overlap(overlap: Column) -> Column:
            weight = F.aggregate(
                overlap,
                F.lit(0.0),
                lambda acc, t: acc + F.log(1.0 + n / (1.0 + F.element_at(df, t))),
            )
            coverage = F.size(overlap) / F.size(p["terms"])
            bonus = F.when(F.contains(text, p["phrase"]), 1.75).otherwise(1.0)
            return F.struct(
                F.when(F.size(overlap) > 0, weight * (0.5 + 0.5 * coverage) * bonus)
                .otherwise(0.0)
                .alias("score"),
                overlap.alias("overlap"),
            )

        return T.let(F.array_intersect(words, p["terms"]), with_overlap)

    def summary(scored: Column) -> Column:
        best = F.array_max(F.transform(scored, lambda s: s["score"]))
        matched = F.array_sort(
            F.array_distinct(F.flatten(F.transform(scored, lambda s: s["overlap"])))
        )
        return F.struct(F.round(best, 9).alias("score"), matched.alias("matched"))

    return T.let(F.transform(prepared, one), summary)


def _with_stats(
    pairs: DataFrame, wanted: Column, segment_rows: int, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Add text, terms, the pair count ``__n`` and the df map of wanted terms.

    One aggregate counts the wanted terms and, under the empty term, all pairs. Its one
    row per key is repeated for every segment of the session, so that a long session is
    met by several tasks instead of one.
    """
    base = pairs.withColumns(
        {
            "__text": F.lower(pair_text()),
            _SEG: position_segment("turn_idx", segment_rows),
        }
    ).withColumn("__words", F.array_intersect(T.terms(F.col("__text")), wanted))
    counted = F.concat(F.array(F.lit("")), F.col("__words"))
    stats = (
        base.select(*keys, _SEG, F.explode(counted).alias("t"))
        .groupBy(*keys, "t")
        .agg(F.count("*").alias("c"), F.max(_SEG).alias("hi"))
        .groupBy(*keys)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("__df"),
            F.max("hi").alias("hi"),
        )
        .select(*keys, "__df", F.explode(F.sequence(F.lit(0), F.col("hi"))).alias(_SEG))
        .withColumn("__n", F.element_at("__df", F.lit("")))
    )
    # Pairs without any query term cannot score; they only count in __n.
    return base.filter(F.size("__words") > 0).join(stats, [*keys, _SEG])


def search_pairs(
    pairs: DataFrame,
    queries: Queries,
    top_k_per_topic: int = 4,
    exclude: DataFrame | None = None,
    min_score: float = 0.5,
    tier: str = "expanded",
    relation: str = "probe",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Rank pairs against each topic's queries; ties go to the smaller turn id text.

    ``exclude`` is ``(session_id, turn_id)`` with an optional ``topic``; excluded pairs
    still count in the document frequencies.
    """
    hits = _scored_topics(_with_stats(pairs, _all_terms(queries), segment_rows), queries, min_score)
    if exclude is not None:
        on = ["session_id", "turn_id"] + (["topic"] if "topic" in exclude.columns else [])
        hits = hits.join(exclude.select(*on), on, "left_anti")
    ranked = top_k(
        hits, ["session_id", "topic"], [-F.col("score"), F.col("turn_id")], top_k_per_topic
    )
    return ranked.select(
        "session_id",
        "topic",
        "rank",
        "turn_id",
        "turn_idx",
        "score",
        F.lit(tier).alias("tier"),
        F.lit(relation).alias("relation"),
        "matched",
    )


def _all_terms(queries: Queries) -> Column:
    every = [t for words in queries.values() for q in words for t in _query_terms(q)]
    return F.lit(list(dict.fromkeys(every))).cast("array<string>")


def _topic_scores(queries: Queries) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(topic).alias("topic"),
                _score(
                    F.col("__text"),
                    F.col("__words"),
                    _prepared_literal(words),
                    F.col("__n"),
                    F.col("__df"),
                ).alias("s"),
            )
            for topic, words in queries.items()
            if words
        )
    )


def _scored_topics(stated: DataFrame, queries: Queries, min_score: float) -> DataFrame:
    hits = F.filter(_topic_scores(queries), lambda e: e["s"]["score"] >= min_score)
    keep = [c for c in stated.columns if c not in ("__text", "__words", "__n", "__df", _SEG)]
    return stated.select(*keep, F.explode(hits).alias("e")).select(
        *keep, "e.topic", "e.s.score", "e.s.matched"
    )


def search_requests(
    pairs: DataFrame,
    requests: DataFrame,
    top_k_per_topic: int = 8,
    min_score: float = 0.5,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Search with queries of a table ``(session_id, topic, queries, exclude)``.

    ``exclude`` lists turn ids. Frequencies are those of all pairs of the session. A request is repeated for each
    segment of its session and meets the pairs there, so a long session spreads over its segments.
    """
    placed = pairs.withColumn(_PART, position_segment("turn_idx", segment_rows))
    parts = placed.select("session_id", _PART).distinct()
    joined = placed.join(requests.join(parts, "session_id"), ["session_id", _PART]).drop(_PART)
    wanted = F.array_distinct(F.flatten(F.transform(F.col("queries"), T.terms)))
    stated = _with_stats(joined, wanted, segment_rows, ("session_id", "topic"))
    scored = stated.withColumn(
        "s",
        _score(F.col("__text"), F.col("__words"), _prepared(F.col("queries")), F.col("__n"), F.col("__df")),
    ).filter(
        (F.col("s.score") >= min_score) & ~F.array_contains(F.col("exclude"), F.col("turn_id"))
    )
    hits = scored.select(
        "session_id", "topic", "turn_id", "turn_idx", "s.score", "s.matched"
    )
    return top_k(
        hits, ["session_id", "topic"], [-F.col("score"), F.col("turn_id")], top_k_per_topic
    ).withColumns({"tier": F.lit("expanded"), "relation": F.lit("probe")})


# --- tag anchors and the tiered first pass --------------------------------------


def _edge_map(edges: Edges) -> Column:
    """Literal map from tag to its edges in order."""
    if not edges:
        raise ValueError("the tag map is empty")
    entries = []
    for tag, listed in edges.items():
        entries.append(F.lit(tag))
        entries.append(
            F.array(
                *(
                    F.struct(
                        F.lit(e["topic"]).alias("topic"),
                        F.lit(e["relation"]).alias("relation"),
                        F.lit(e["strength"]).alias("strength"),
                    )
                    for e in listed
                )
            )
        )
    return F.create_map(*entries)


def anchored_edges(edges: Edges) -> Column:
    """Edges of the row's tag as ``array<struct<topic, score, tier, relation>>``; null without."""

    def place(e: Column) -> Column:
        context = e["topic"] == K.CROSS_CUTTING
        direct = e["strength"] == "direct"
        return F.struct(
            e["topic"].alias("topic"),
            F.when(context, 0.5).when(direct, 3.0).otherwise(2.0).alias("score"),
            F.when(context, "contextual").when(direct, "direct").otherwise("lexical").alias("tier"),
            F.when(context, "context").otherwise(e["relation"]).alias("relation"),
        )

    return F.transform(F.element_at(_edge_map(edges), F.col("tag")), place)


def tag_anchored(pairs: DataFrame, edges: Edges) -> DataFrame:
    """Every (pair, edge) with score and tier; order is (-score, turn_id) per topic."""
    return pairs.select(
        "session_id", "turn_id", "turn_idx", F.posexplode(anchored_edges(edges)).alias("edge_pos", "e")
    ).select("session_id", "turn_id", "turn_idx", "edge_pos", "e.*")


def merge_retrieved(groups: DataFrame, limit: int) -> DataFrame:
    """Merge ranked groups ``(session_id, topic, grp, pos, turn_id, ...)``.

    The first occurrence of a turn wins and at most ``limit`` turns stay.
    """
    once = top_k(groups, ["session_id", "topic", "turn_id"], [F.col("grp"), F.col("pos")], 1, "__one")
    return top_k(
        once.drop("__one"), ["session_id", "topic"], [F.col("grp"), F.col("pos")], limit
    )


def tier_rank(tier: Column) -> Column:
    return (F.array_position(F.lit(K.TIERS), tier) - 1).cast("int")


def tier_name(rank: Column) -> Column:
    return F.element_at(F.lit(K.TIERS), (rank + 1).cast("int"))


def overall_tier(retrieved: DataFrame, sessions: DataFrame, topics: Sequence[str]) -> DataFrame:
    """The strongest tier of every (session, topic); ``absent`` when nothing was found."""
    best = retrieved.groupBy("session_id", "topic").agg(
        F.max(tier_rank(F.col("tier"))).alias("r")
    )
    return (
        topics_of_sessions(sessions, topics)
        .join(best, ["session_id", "topic"], "left")
        .select("session_id", "topic", tier_name(F.coalesce("r", F.lit(0))).alias("tier"))
    )


def retrieve_topics(
    pairs: DataFrame,
    edges: Edges,
    queries: Queries,
    limit: int = 8,
    context_limit: int = 3,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """First pass for every topic at once: tag anchors, then search, then context.

    Anchors and search hits of a pair are exclusive per topic, so both are worked out
    row by row and one top-k ranks them. Topics left empty get the session's first
    context turns.
    """
    topics = list(queries)
    columns = ["session_id", "turn_id", "turn_idx"]
    tagged = pairs.withColumn("__edges", anchored_edges(edges))
    own = F.filter("__edges", lambda e: e["topic"].isin(topics))
    # Of several edges to one topic the strongest counts, the earliest among equals.
    anchored = (
        tagged.select(*columns, F.posexplode(own).alias("edge_pos", "e"))
        .groupBy(*columns, "e.topic")
        .agg(F.max_by("e", F.struct("e.score", -F.col("edge_pos"))).alias("e"))
        .select(*columns, "e.*")
        .withColumns({"grp": F.lit(0), "matched": F.lit([]).cast("array<string>")})
    )
    stated = _with_stats(tagged, _all_terms(queries), segment_rows)
    taken = F.coalesce(
        F.exists("__edges", lambda e: e["topic"] == F.col("topic")), F.lit(False)
    )
    lexical = (
        _scored_topics(stated, queries, 0.5)
        .filter(~taken)
        .withColumns({"grp": F.lit(1), "tier": F.lit("lexical"), "relation": F.lit("probe")})
    )
    shape = [*columns, "topic", "grp", "score", "tier", "relation", "matched"]
    is_context = F.exists("__edges", lambda e: e["topic"] == K.CROSS_CUTTING)
    context = (
        top_k(
            tagged.filter(is_context).select(*columns),
            ["session_id"],
            [F.col("turn_idx")],
            context_limit,
        )
        .withColumn("topic", F.explode(F.lit(topics)))
        .withColumns(
            {
                "grp": F.lit(2),
                "score": F.lit(0.5),
                "tier": F.lit("contextual"),
                "relation": F.lit("context"),
                "matched": F.lit([]).cast("array<string>"),
            }
        )
    )
    ranked = top_k(
        anchored.select(*shape).unionByName(lexical.select(*shape)).unionByName(context.select(*shape)),
        ["session_id", "topic"],
        [
            F.col("grp"),
            -F.col("score"),
            F.when(F.col("grp") == 2, F.col("turn_idx")).otherwise(0),
            F.col("turn_id"),
        ],
        max(limit, context_limit),
    )
    # Context stays only where the topic has nothing of its own.
    strongest = F.min("grp").over(W.partitionBy("session_id", "topic"))
    return (
        ranked.withColumn("__best", strongest)
        .filter((F.col("grp") == F.col("__best")) | (F.col("grp") < 2))
        .filter(F.col("rank") <= F.when(F.col("grp") == 2, context_limit).otherwise(limit))
        .drop("__best", "grp")
    )


def expand(
    state: DataFrame, pairs: DataFrame, requests: DataFrame, limit: int = 8, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Search with new queries and append the finds; a full list drops them.

    ``state`` holds ranked rows; ``requests`` is ``(session_id, topic, queries)``.
    """
    known = state.groupBy("session_id", "topic").agg(F.collect_set("turn_id").alias("exclude"))
    asked = requests.join(known, ["session_id", "topic"], "left").withColumn(
        "exclude", F.coalesce("exclude", F.lit([]).cast("array<string>"))
    )
    found = search_requests(pairs, asked, limit, segment_rows=segment_rows)
    shape = ["session_id", "topic", "turn_id", "turn_idx", "score", "tier", "relation", "matched"]
    groups = state.select(*shape, F.lit(0).alias("grp"), F.col("rank").alias("pos")).unionByName(
        found.select(*shape, F.lit(1).alias("grp"), F.col("rank").alias("pos"))
    )
    return merge_retrieved(groups, limit).drop("grp", "pos")


def flatten_polarity(retrieved: DataFrame) -> DataFrame:
    """Ablation: every relation counts as a probe."""
    return retrieved.withColumn("relation", F.lit("probe"))


def render_evidence(
    retrieved: DataFrame, pairs: DataFrame, sessions: DataFrame, topics: Sequence[str]
) -> DataFrame:
    """One text block per (session, topic), grouped probe, reverse, context.

    A (session, topic) holds at most the retrieval limit of turns, so the ordered list
    that is gathered per group is short.
    """
    body = pairs.select("session_id", "turn_id", "question", "answer")
    mark = F.concat(F.lit("  ["), F.col("turn_id"), F.lit("] "))
    line = F.concat_ws(
        "\n",
        F.when(F.col("question") != "", F.concat(mark, F.lit("Interviewer: "), F.col("question"))),
        F.concat(mark, F.lit("Participant: "), F.col("answer")),
    )
    listed = (
        retrieved.join(body, ["session_id", "turn_id"])
        .groupBy("session_id", "topic")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "relation", line.alias("line")))
            ).alias("rows")
        )
    )

    def block(relation: str) -> Column:
        lines = F.transform(
            F.filter("rows", lambda r: r["relation"] == relation), lambda r: r["line"]
        )
        return F.when(
            F.size(lines) > 0,
            F.concat(F.lit(K.RELATION_HEADERS[relation] + "\n"), F.array_join(lines, "\n")),
        )

    return (
        topics_of_sessions(sessions, topics)
        .join(listed, ["session_id", "topic"], "left")
        .select(
            "session_id",
            "topic",
            F.when(F.col("rows").isNull(), F.lit(K.NO_EVIDENCE_TEXT))
            .otherwise(F.concat_ws("\n\n", *(block(r) for r in K.RELATIONS)))
            .alias("evidence"),
        )
    )


def coverage_report(tiers: DataFrame, by: str = "tier") -> DataFrame:
    """Count and share of (session, topic) by tier, per topic and overall."""
    counts = tiers.cube("topic", by).agg(
        F.count("*").alias("n"), F.grouping_id().alias("level")
    )
    # Four grouping levels of a few dozen cells; the level without a tier is the total.
    share = F.col("n") / F.max("n").over(W.partitionBy("topic"))
    return (
        counts.withColumn("share", share)
        .filter(F.col("level").isin(0, 2))
        .select(F.coalesce("topic", F.lit("(all)")).alias("topic"), by, "n", "share")
    )
