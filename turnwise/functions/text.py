"""String and token expressions; every one of them stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_TAGGED = r"(?s)^([A-Za-z0-9_]+)\s*\((.*)\)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression captured by a lambda is otherwise evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Collapse white space runs to one space and strip."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tag_of(c: Column) -> Column:
    """The tag of ``tag (utterance)``, or null."""
    return F.nullif(F.regexp_extract(strip(c), _TAGGED, 1), F.lit(""))


def utterance_of(c: Column) -> Column:
    """The utterance of ``tag (utterance)``, or the stripped text itself."""
    s = strip(c)
    return F.when(s.rlike(_TAGGED), strip(F.regexp_extract(s, _TAGGED, 2))).otherwise(s)


def tokens(c: Column) -> Column:
    """Lower-case alphabetic tokens of three letters or more, without stopwords."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z']{3,})"), F.lit(1))
    stop = F.lit(K.STOPWORDS)
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def terms(c: Column) -> Column:
    """The distinct tokens of a text."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z']{3,})"), F.lit(1))
    return F.array_except(words, F.lit(K.STOPWORDS))


def content_words(c: Column) -> Column:
    """The distinct runs of four or more letters."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1))
    )


def negated_before(prefix: Column) -> Column:
    """A negation cue lies inside one of the last four words of ``prefix``."""
    cues = "|".join(K.NEGATION_CUES)
    gap = K.NEGATION_WINDOW - 1
    return prefix.rlike(rf"(?:{cues})\S*(?:\s+\S+){{0,{gap}}}\s*$")


def plain_occurrence(text: Column, keyword: Column) -> Column:
    """``keyword`` occurs in ``text`` at least once without a negation before it."""

    def some_plain(parts: Column) -> Column:
        def before(i: Column) -> Column:
            return F.call_function("array_join", F.slice(parts, F.lit(1), i), keyword)

        occurrences = F.sequence(F.lit(1), F.size(parts) - 1)
        return F.exists(occurrences, lambda i: ~negated_before(before(i)))

    pattern = F.concat(F.lit(r"\Q"), keyword, F.lit(r"\E"))
    return F.when(F.contains(text, keyword), let(F.split(text, pattern, -1), some_plain)).otherwise(False)


def ngrams(words: Column, n: int, sep: str = " ") -> Column:
    """Runs of ``n`` consecutive words, joined; shifted copies are zipped, so work is linear."""

    def runs(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        shifted = F.arrays_zip(
            *(F.slice(w, F.lit(k + 1), F.greatest(count, F.lit(0))).alias(f"w{k}") for k in range(n))
        )
        return F.transform(shifted, lambda z: F.concat_ws(sep, *(z[f"w{k}"] for k in range(n))))

    return let(words, runs)


def mentions_frequency(c: Column) -> Column:
    return c.rlike("(?iU)" + K.FREQUENCY)


def asks_hypothetical(c: Column) -> Column:
    return c.rlike("(?iU)" + K.HYPOTHETICAL)


def age_in(c: Column) -> Column:
    """The first age a text states, when it lies between 10 and 100."""
    pattern = "(?iU)" + K.AGE
    first = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    second = F.nullif(F.regexp_extract(c, pattern, 2), F.lit(""))
    age = F.coalesce(first, second).try_cast("int")
    return F.when(age.between(10, 100), age)
