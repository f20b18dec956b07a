"""Quality rules by weak supervision: rules vote or abstain, EM finds how far each is right.

Every rule votes +1 (fit for training), -1 (unfit) or 0 (abstains). A rule has two accuracies: how
often its vote is right on good documents and on bad ones; few rules see every kind of bad document,
so a good vote says little and a bad vote much. The documents are counted
per pattern of votes, of which there are at most 3**rules, so the estimation works on a table
of bounded size whatever the corpus: one row holds all patterns and counts, and a fold over the
iterations applies expectation and maximisation to it. The posterior of each pattern is then
hash-joined to the documents. All of it is DataFrame functions; no row leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, let, stored, words

# Frequent function words of the languages that the rules know.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "are", "with", "as",
    "be", "this", "was", "by", "an", "der", "die", "und", "das", "den", "von", "zu", "mit",
    "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "für", "sie", "es",
    "le", "la", "les", "et", "des", "du", "un", "une", "est", "que", "qui", "dans", "pour",
    "par", "au", "sur", "avec", "el", "los", "las", "y", "del", "se", "por", "con", "una",
    "su", "para", "no", "al", "lo", "como", "más",
]
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ITERATIONS = 25
#: Prior of a good document and pseudo-counts of the estimates; they decide on empty tables.
PRIOR = 0.8
START_GOOD, START_BAD = 0.97, 0.4
PSEUDO = 20.0

#: rule -> (bad if, good if) over the statistics; otherwise the rule abstains. SQL of both dialects.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("100 * n_symbols > 40 * n_words", "100 * n_symbols <= 5 * n_words"),
    "marked_words": ("100 * n_marked > 20 * n_words", "100 * n_marked <= 5 * n_words"),
    "shouting": ("100 * n_upper > 50 * n_letters", "100 * n_upper <= 20 * n_letters"),
    "exclaim": ("100 * n_exclaim > 30 * n_words", "100 * n_exclaim <= 5 * n_words"),
    "repeats": (
        "100 * n_repeat_words > 20 * n_words",
        "n_words >= 20 AND 100 * n_repeat_words <= 5 * n_words",
    ),
    "lines": ("100 * n_dup_lines > 30 * n_lines", "n_lines >= 3 AND 100 * n_dup_lines <= 10 * n_lines"),
    "function_words": (
        "n_words >= 30 AND 100 * n_function < 2 * n_words",
        "100 * n_function >= 8 * n_words",
    ),
    "word_length": (
        "word_chars < 2 * n_words OR word_chars > 15 * n_words",
        "word_chars >= 3 * n_words AND word_chars <= 9 * n_words",
    ),
}


def _repeat_words(w: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the array ``w``."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                before = (i > 0) & (F.get(p, i - 1)["h"] == x["h"])
                return before | (F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)))

            return F.sort_array(F.transform(F.filter(p, again), lambda x: x["i"]))

        def total(s: Column) -> Column:
            step = F.transform(
                s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))
            )
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda p: let(starts(p), total))

    hashes = F.transform(
        F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
    )
    # Most texts repeat no window: only the others pay for the sort with positions.
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def statistics(text: Column) -> Column:
    """A struct of the counts that the rules read; null counts as an empty text."""
    text = F.coalesce(text, F.lit(""))
    length = lambda c: F.length(c).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            length(F.array_join(w, "")).alias("word_chars"),
            (length(text) - length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(w, _repeat_words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (length(text) - length(F.regexp_replace(text, r"\p{Lu}+", ""))).alias("n_upper"),
            length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("n_letters"),
            (length(text) - length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_exclaim"),
            F.size(F.filter(w, lambda x: x.rlike(SYMBOLS))).cast("long").alias("n_marked"),
            F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        )

    return let(words(text), of)


def vote(rule: str, stats: str) -> Column:
    """The vote of a rule on the struct column ``stats``."""
    bad, good = (
        re.sub(r"\b(n_\w+|word_chars)", rf"`{stats}`.\1", condition) for condition in RULES[rule]
    )
    return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")


def _posterior(votes: Column, m: Column) -> Column:
    """Probability of a good document under the model ``m``, by the votes that were cast."""

    def odds(total: Column, x: Column) -> Column:
        good, bad = x["m"]["good"], x["m"]["bad"]
        up, down = F.log(good / (1 - bad)), F.log((1 - good) / bad)
        return total + F.when(x["v"] == 1, up).when(x["v"] == -1, down).otherwise(0.0)

    both = F.zip_with(votes, m["rules"], lambda v, r: F.struct(v.alias("v"), r.alias("m")))
    logit = F.aggregate(both, F.log(m["prior"] / (1 - m["prior"])), odds)
    return 1 / (1 + F.exp(-logit))


def _between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _estimates(q: Column, rules: int) -> Column:
    """The model from patterns with counts ``n`` and posteriors ``q`` (maximisation)."""

    def weight(pick) -> Column:
        return F.aggregate(q, F.lit(0.0), lambda a, x: a + x["n"] * pick(x))

    def of(j: Column) -> Column:
        cast = lambda x, v: (F.get(x["votes"], j) == v).cast("double")
        good_up = weight(lambda x: x["q"] * cast(x, 1))
        good_down = weight(lambda x: x["q"] * cast(x, -1))
        bad_up = weight(lambda x: (1 - x["q"]) * cast(x, 1))
        bad_down = weight(lambda x: (1 - x["q"]) * cast(x, -1))
        good = (good_up + PSEUDO * START_GOOD) / (good_up + good_down + PSEUDO)
        bad = (bad_down + PSEUDO * START_BAD) / (bad_up + bad_down + PSEUDO)
        good = _between(good, 0.7, 0.995)
        # a bad vote stays likelier on a bad document than on a good one
        return F.struct(
            good.alias("good"), _between(F.greatest(bad, 2 * (1 - good)), 0.05, 0.99).alias("bad")
        )

    prior = (weight(lambda x: x["q"]) + PSEUDO * PRIOR) / (weight(lambda x: F.lit(1.0)) + PSEUDO)
    return F.struct(
        _between(prior, 0.5, 0.95).alias("prior"),
        F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), of).alias("rules"),
    )


def posteriors(patterns: DataFrame, rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """Posterior probability of a good document for each pattern of votes.

    ``patterns`` has ``votes`` (array of -1, 0, 1) and ``n``; it has at most 3**rules rows, which
    are gathered into one. Accuracies are bounded so that good and bad can't change places, and
    pseudo-counts carry them where a rule never votes.
    """
    pattern = F.struct("votes", F.col("n").cast("double").alias("n"))
    row = patterns.agg(F.sort_array(F.collect_list(pattern)).alias("p"))

    def step(m: Column) -> Column:
        judged = F.transform(
            F.col("p"), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), _posterior(x["votes"], m).alias("q"))
        )
        return let(judged, lambda q: _estimates(q, rules))

    rule = F.struct(F.lit(START_GOOD).alias("good"), F.lit(START_BAD).alias("bad"))
    start = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(rule, rules).alias("rules"))
    rounds = F.sequence(F.lit(1), F.lit(iterations))
    fitted = row.select("p", F.aggregate(rounds, start, lambda m, _: step(m)).alias("m"))
    return fitted.select(F.explode("p").alias("x"), "m").select(
        F.col("x.votes").alias("votes"), _posterior(F.col("x.votes"), F.col("m")).alias("quality"), F.col("m").alias("model")
    )


def rate(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and a struct ``quality`` for each row.

    The struct holds the statistics, ``votes``, ``posterior``, ``base_failed`` (fewer than ten words,
    or more than a fifth of them in repeated 5-word windows) and ``kept`` (not base_failed, and the
    posterior is at least ``threshold``). A column already called ``quality`` keeps its name and the
    new one gets an underscore in front. Null and empty texts have no words: base_failed. Equal texts
    get equal results; an empty table gives an empty one; very long texts are judged whole. The votes are
    counted before they are judged, so the rows are written once to the shared folder, with the text if it is
    among ``keep``: no filter on the result can then work out the statistics again.
    """
    keep = docs.columns if keep is None else keep
    stats = free_name(docs, "stats")
    base = docs.select(*(F.col(f"`{c}`") for c in keep), statistics(F.col(f"`{text}`")).alias(stats))
    base = base.withColumn(free_name(base, "votes"), F.array(*(vote(r, stats) for r in RULES)))
    votes = base.columns[-1]
    base = stored(base, "quality")
    patterns = base.groupBy(F.col(votes).alias("votes")).agg(F.count("*").alias("n"))
    found = stored(posteriors(patterns, len(RULES)), "posteriors")
    joined = base.join(F.broadcast(found), base[votes] == found["votes"], "left")  # 3**rules rows at most
    s = F.col(stats)
    failed = (s["n_words"] < MIN_WORDS) | (
        100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"]
    )
    out = F.struct(
        s.alias("stats"),
        base[votes].alias("votes"),
        found["quality"].alias("posterior"),
        failed.alias("base_failed"),
        (~failed & (found["quality"] >= threshold)).alias("kept"),
    )
    return joined.select(*(base[f"`{c}`"] for c in keep), out.alias(free_name(docs.select(*keep), "quality")))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    rated = rate(docs, text)
    return rated.filter(F.col(f"{rated.columns[-1]}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
