"""Citation and quote checks, faithfulness rules and score revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def bad_citations(cited: Column, allowed: Column) -> Column:
    """Cited ids that were never shown."""
    return F.filter(cited, lambda c: ~F.array_contains(allowed, c))


def citation_check(df: DataFrame) -> DataFrame:
    bad = bad_citations(F.col("cited"), F.col("allowed"))
    return df.withColumn("bad_citations", bad).withColumn(
        "citation_mismatch", F.size("bad_citations") > 0
    )


def _words(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit("([a-z0-9']+)"), F.lit(1))


def _run_found(words: Column, evidence: Column, run: int) -> Column:
    return F.exists(T.ngrams(words, run), lambda g: F.contains(evidence, g))


def quote_grounded(quote: Column, evidence: Column, run: int = 5) -> Column:
    """The quote, or a run of its words, occurs in the evidence; white space aside."""

    def decide(qe: Column) -> Column:
        q, e = qe["q"], qe["e"]
        return (
            F.when(q == "", False)
            .when(F.contains(e, q), True)
            .otherwise(F.coalesce(_run_found(_words(q), e, run), F.lit(False)))
        )

    normal = F.struct(T.squash(F.lower(quote)).alias("q"), T.squash(F.lower(evidence)).alias("e"))
    return T.let(normal, decide)


def ground_quotes(quotes: DataFrame, documents: DataFrame, run: int = 5, head: int = 8) -> DataFrame:
    """All (quote, document) pairs where the quote is grounded in the document.

    ``quotes`` is ``(quote_id, text)``, ``documents`` ``(doc_id, text)``. A run of words
    found in a text has its inner words as whole tokens there, so the inner words are an
    equi-join key; a quote too short for that is keyed by its first characters. The keys
    only propose pairs, the full rule then decides on whole texts.
    """
    q = quotes.select("quote_id", T.squash(F.lower("text")).alias("q")).filter(F.col("q") != "")
    d = documents.select("doc_id", T.squash(F.lower("text")).alias("e"))
    inner = run - 2

    def inner_keys(words: Column) -> Column:
        """Words 2 to ``run - 1`` of every run of ``run`` words."""
        return T.let(T.ngrams(words, inner), lambda g: F.slice(g, F.lit(2), F.greatest(F.size(g) - 2, F.lit(0))))

    spaced = F.split("q", " ")
    long = q.filter(F.size(spaced) >= run)
    q_keys = long.select(
        "quote_id",
        F.explode(
            F.array_distinct(
                F.concat(inner_keys(_words(F.col("q"))), F.slice(inner_keys(spaced), 1, 1))
            )
        ).alias("key"),
    ).select("quote_id", F.xxhash64("key").alias("key"))

    # Short quotes are keyed by their first characters; documents offer runs of the lengths asked for.
    short = q.filter(F.size(spaced) < run).withColumn("n", F.least(F.length("q"), F.lit(head)))
    asked = short.agg(F.collect_set("n").alias("lengths"))  # one row of ``head`` numbers at most
    s_keys = short.select("quote_id", F.xxhash64("n", F.expr("substring(q, 1, n)")).alias("key"))
    chars = F.split("e", "")

    def keys_of(lengths: Column) -> Column:
        words = F.transform(T.ngrams(F.split("e", " "), inner), lambda g: F.xxhash64(g))

        def runs(n: int) -> Column:
            grams = F.transform(T.ngrams(chars, n, ""), lambda g: F.xxhash64(F.lit(n), g))
            return F.when(F.array_contains(lengths, n), F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))

        return F.concat(F.array_distinct(words), *(runs(n) for n in range(1, head + 1)))

    d_keys = d.join(F.broadcast(asked)).select("doc_id", F.explode(keys_of(F.col("lengths"))).alias("key"))
    proposed = d_keys.join(q_keys.unionByName(s_keys), "key").select("quote_id", "doc_id")
    found = proposed.distinct().join(q, "quote_id").join(d, "doc_id")
    holds = F.contains("e", F.col("q")) | F.coalesce(
        _run_found(_words(F.col("q")), F.col("e"), run), F.lit(False)
    )
    return found.filter(holds).select("quote_id", "doc_id")


def faithfulness(df: DataFrame, min_overlap: float = 0.15) -> DataFrame:
    """Share of a reply's words that its evidence has; flagged below the minimum.

    ``df`` has ``status``, ``reply`` and ``evidence``.
    """
    reply, evidence = T.content_words(F.col("reply")), T.content_words(F.col("evidence"))
    applies = (F.col("status") == "known") & (F.size(reply) > 0) & (F.size(evidence) > 0)
    overlap = F.when(applies, F.size(F.array_intersect(reply, evidence)) / F.size(reply))
    return df.withColumn("overlap", overlap).withColumn(
        "low_faithfulness", F.coalesce(F.col("overlap") < min_overlap, F.lit(False))
    )


def ground_scores(df: DataFrame, cap: int = 1) -> DataFrame:
    """Zero a score without own evidence, cap one whose dialogue drifted from it."""
    overridden = (F.col("score") > 0) & (F.col("status") != "known")
    grounded = F.when(overridden, 0).otherwise(F.col("score"))
    capped = F.col("low_faithfulness") & (F.col("grounded_score") > cap)
    return (
        df.withColumn("grounding_overridden", overridden)
        .withColumn("grounded_score", grounded)
        .withColumn("faithfulness_capped", capped)
        .withColumn(
            "final_score", F.when(capped, cap).otherwise(F.col("grounded_score"))
        )
    )


def accept_revisions(scores: DataFrame, revisions: DataFrame) -> DataFrame:
    """Apply revisions that cite shown evidence of their own topic.

    ``scores`` is ``(session_id, topic, score, status, allowed)``; ``revisions``
    ``(session_id, topic, new_score, cited)``, one per (session, topic).
    """
    joined = scores.join(
        revisions.select("session_id", "topic", "new_score", "cited"), ["session_id", "topic"], "left"
    )
    accepted = (
        F.col("new_score").isNotNull()
        & (F.size("cited") > 0)
        & (F.size(bad_citations(F.col("cited"), F.col("allowed"))) == 0)
        & ~((F.col("new_score") > 0) & (F.col("status") != "known"))
    )
    return (
        joined.withColumn("revised", F.coalesce(accepted, F.lit(False)))
        .withColumn("score", F.when(F.col("revised"), F.col("new_score")).otherwise(F.col("score")))
        .drop("new_score", "cited")
    )


def necessity_default(status: Column, frequency_known: Column) -> Column:
    return F.when((status == "missing") | frequency_known, 0).otherwise(1)


def continue_asking(necessity: Column, asked: Column, most: int = 3) -> Column:
    """Ask again for necessity 2, or 1 before the second question; at most three."""
    return (asked < most) & ((necessity == 2) | ((necessity == 1) & (asked < 2)))
