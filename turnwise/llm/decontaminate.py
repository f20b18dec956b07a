"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

A text turns into words without punctuation, in lower case, in which a number, a capitalised word
inside a sentence and a unit after a number stand as placeholders that keep their values beside
them. A run of names, or of numbers with their units, is one placeholder, so that a value may be
replaced by one of another word count. Windows of eight such words are hash-joined with those of the
benchmark; hits of one document and item are chained over diagonals that lie near each other, since
every inserted or deleted word shifts the diagonal. What a chain (and each diagonal alone) covers of
the item is counted, and the values in the slots are compared: the same value of the item must
always stand for the same value of the document. A copied question passes with equal values, a
re-parameterised one with values that were replaced throughout. All this is done for two templates,
one in which capitalised words at the start of a sentence are literals and one in which they are names.
An item without a window in one of them is also searched for as it stands, values included.

All of it is DataFrame functions. Windows of documents are never shuffled while the windows of the
benchmark are few enough to be broadcast; a larger benchmark is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from .common import SPACES, WORD, free_name, let, small, stored

# Units that may follow a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "tonnes", "oz", "ounces", "lb", "lbs", "pound", "pounds",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "cup", "cups",
    "s", "ms", "sec", "seconds", "second", "min", "minutes", "minute", "h", "hours", "hour",
    "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent",
    "mph", "kmh", "w", "kw", "v", "volts", "j", "n", "pa", "hz", "degrees",
]
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
CAPITAL = "\ue003"
WINDOW = 8
MIN_LITERALS = 5
MIN_COVERAGE = 0.5
MIN_CONSISTENCY = 0.8
#: Words of an item in one chain that tell it by themselves, however long the item is.
LONG_MATCH = 20
#: Diagonals at most this far apart belong to one chain: so many words may be inserted or left out at once.
BAND = 16
#: Rows of benchmark windows, and of flagged texts, up to which they are broadcast.
BROADCAST_ROWS = 500_000


def _marked(text: Column) -> Column:
    """The text in lower case without punctuation, with a mark before each value of a slot.

    ``NAME`` stands before capitalised words inside a sentence, ``CAPITAL`` before all others.
    """
    t = F.coalesce(text, F.lit(""))
    ours = [t.contains(mark) for mark in (NUMBER, NAME, UNIT, CAPITAL)]  # few texts hold marks of their own
    own = ours[0] | ours[1] | ours[2] | ours[3]
    t = F.when(own, F.regexp_replace(t, f"[{NUMBER}{NAME}{UNIT}{CAPITAL}]+", "")).otherwise(t)
    number = r"[$€£]?[0-9]+(?:[.,:/][0-9]+)*%?"
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_.,]){number}", f"{NUMBER}$0")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    t = F.regexp_replace(t, rf"({NUMBER}{number}\x20?)((?i:{units}))(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    t = F.regexp_replace(
        t, r"\p{Lu}(?<=[\p{Ll}\p{N},;)][\x20\x09-\x0D]\p{Lu})[\p{L}\p{N}'’-]*", f"{NAME}$0"
    )
    # patterns begin with what is rare, so that no look-behind is tried at every character
    other = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}]\p{{Lu}})(?<![\p{{L}}\p{{N}}]['’-]\p{{Lu}})"
    t = F.regexp_replace(t, other, f"{CAPITAL}$0")
    return F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}{CAPITAL}\x20\x09-\x0D]+", "")


def template_words(text: Column) -> Column:
    """Words of the template; a placeholder word is its mark followed by the value it stands for."""
    return F.regexp_extract_all(F.replace(_marked(text), F.lit(CAPITAL), F.lit("")), F.lit(WORD), F.lit(0))


def _merged(marked: Column) -> Column:
    """Template words in which a run of names, or of numbers and units, is one placeholder."""
    first = r"(?<![^\x20\x09-\x0D]."
    t = F.regexp_replace(marked, rf"({NAME}{first}){WORD}+){SPACES}(?={NAME})", "$1")
    t = F.regexp_replace(t, rf"({NUMBER}{first}){WORD}+){SPACES}(?=[{NUMBER}{UNIT}])", "$1")
    t = F.regexp_replace(t, rf"[{NUMBER}{NAME}{UNIT}](?<=[^\x20\x09-\x0D].)", "")
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def _templates(df: DataFrame, text: str) -> DataFrame:
    """The column ``text`` replaced by ``template`` (a number) and ``words``, a row per template of the text.

    In template 0 only a capitalised word inside a sentence is a name, in template 1 every capitalised
    word, whatever stands before it.
    """

    def forms(m: Column) -> Column:
        each = [F.replace(m, F.lit(CAPITAL), F.lit(by)) for by in ("", NAME)]
        return F.array(*(F.struct(F.lit(i).alias("template"), _merged(t).alias("words")) for i, t in enumerate(each)))

    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*others, F.explode(let(_marked(F.col(text)), forms)).alias("each")).select(*others, "each.*")


def _is_slot(word: Column) -> Column:
    return word.between(F.lit(NUMBER), F.lit(UNIT + "\uffff"))


def _type_of(word: Column) -> Column:
    """The word in a template: without the value if it is a placeholder."""
    return F.when(_is_slot(word), F.substring(word, 1, 1)).otherwise(word)


def _windows(df: DataFrame, words: str) -> DataFrame:
    """A row per window of the array column ``words``: ``at`` and ``window`` (a hash)."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW))
    rows = df.withColumn("at", F.explode_outer(starts)).filter("at IS NOT NULL")
    return rows.withColumn(
        "window", F.xxhash64(*(_type_of(F.get(words, F.col("at") + k)) for k in range(WINDOW)))
    )


def benchmark_windows(benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """Windows of the benchmark that hold enough literal words to tell a question by.

    Per item and template, ``n_windows`` is their number, ``n_words`` how many words they cover and
    ``item_words`` the number of all words. Items shorter than a window, or of little but values, have none.
    """
    items = benchmark.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{text}`").alias("item_text"))
    rows = _windows(_templates(items.distinct(), "item_text"), "words")
    rows = rows.withColumn("slots", F.slice("words", F.col("at") + 1, WINDOW))
    literals = F.size(F.filter("slots", lambda w: ~_is_slot(w)))
    rows = rows.filter(literals >= MIN_LITERALS).select(
        "item_id", "template", "window", F.size("words").alias("item_words"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots")
    ).distinct()
    covered = rows.withColumn("pos", F.explode(F.sequence("item_at", F.col("item_at") + WINDOW - 1)))
    n = covered.groupBy(F.col("item_id").alias("id"), F.col("template").alias("t")).agg(
        F.count_distinct("item_at", "window").alias("n_windows"), F.count_distinct("pos").alias("n_words")
    )
    return rows.join(n, rows.item_id.eqNullSafe(n.id) & (rows.template == n.t)).drop("id", "t")


def exact_words(text: Column) -> Column:
    """Words in lower case without the punctuation around them; a word of nothing else stays."""
    edge = r"(?<![^\x20\x09-\x0D])\p{P}++(?=[^\x20\x09-\x0D])|(?<=[^\x20\x09-\x0D\p{P}])\p{P}++(?![^\x20\x09-\x0D])"
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), edge, "")
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def _hash(words: Column) -> Column:
    """128 bits of an array of words."""
    return F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit(7), words).alias("b"))


def _exact(docs: DataFrame, benchmark: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame | None:
    """Whole copies of the items that lack windows in a template: ``names``, ``item_id``, ``best``.

    An item is cut into pieces of eight words, the last of which ends with it, or is one piece if it is
    shorter; a copy holds all of them on one diagonal. None where no item lacks windows.
    """
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
    told = windows.groupBy(F.col("item_id").alias("id")).agg(F.count_distinct("template").alias("n"))
    told = told.filter("n = 2")
    rest = items.join(told, items.item_id.eqNullSafe(told.id), "left_anti")
    # texts that share an identifier are items of their own here
    rest = rest.select("item_id", F.xxhash64("item_text").alias("part"), exact_words(F.col("item_text")).alias("words"))
    rest = rest.withColumn("n", F.size("words")).filter("n > 0")
    starts = F.when(F.col("n") <= WINDOW, F.array(F.lit(0))).otherwise(
        F.array_union(F.sequence(F.lit(0), F.col("n") - WINDOW, F.lit(WINDOW)), F.array(F.col("n") - WINDOW))
    )
    pieces = rest.withColumn("starts", starts).withColumn("item_at", F.explode("starts")).select(
        "item_id", "part", F.size("starts").alias("n_pieces"), "item_at", F.least("n", F.lit(WINDOW)).alias("length"),
        _hash(F.slice("words", F.col("item_at") + 1, WINDOW)).alias("piece"),
    )
    pieces = stored(pieces, "benchmark-pieces")
    lengths = [r.length for r in pieces.select("length").distinct().collect()]  # eight at most
    if not lengths:
        return None
    words = docs.select(*names, exact_words(F.col("doc_text")).alias("words"))
    rows = words.withColumn("length", F.explode(F.array(*(F.lit(n) for n in sorted(lengths))))).filter(
        F.size("words") >= F.col("length")
    )
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length")))).select(
        *names, "length", "at", _hash(F.slice("words", F.col("at") + 1, F.col("length"))).alias("piece")
    )
    hits = rows.join(small(pieces, BROADCAST_ROWS), ["length", "piece"])
    group = [*names, "item_id", "part", (F.col("at") - F.col("item_at")).alias("diagonal")]
    n = F.count_distinct("item_at").cast("long").alias("n")
    whole = hits.groupBy(*group).agg(n, F.max("n_pieces").alias("n_pieces")).filter("n = n_pieces")
    best = F.struct(F.col("n").alias("n_matched"), F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistency"))
    return whole.select(*names, "item_id", best.alias("best"))


def matches(docs: DataFrame, benchmark: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Per key columns of ``docs`` and item: the best chain, or diagonal, of matching windows.

    Columns: the key, ``item_id``, ``n_matched`` (windows of the item found), ``coverage`` (their
    share, or that of the words they cover if that is more) and ``consistency`` (the share of slot
    values that always stand for one value; 1 without slots). Only pairs that reach ``MIN_COVERAGE``
    or ``LONG_MATCH`` words, and ``MIN_CONSISTENCY``, are returned. Null and
    empty texts and an empty benchmark match nothing. Items without windows in one of the templates
    are found where they stand whole; ``n_matched`` then counts their pieces. Rows with equal keys count as one document,
    so the key should hold a hash of the text where identifiers may repeat.
    """
    told = stored(benchmark_windows(benchmark), "benchmark-windows")
    windows = small(told, BROADCAST_ROWS)
    names = [f"key{i}" for i in range(len(key))]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(key, names)), F.col(f"`{text}`").alias("doc_text")
    )
    hits = (
        _windows(_templates(rows, "doc_text"), "words")
        .join(windows, ["template", "window"])
        .select(
            *names,
            "item_id",
            "template",
            (F.col("at") - F.col("item_at")).alias("diagonal"),
            "item_at",
            "item_words",
            "n_windows",
            "n_words",
            F.arrays_zip(F.col("item_slots").alias("a"), F.slice("words", F.col("at") + 1, WINDOW).alias("b")).alias("zipped"),
        )
    )
    hits = stored(hits, "benchmark-hits")
    pair = [*names, "item_id", "template"]
    along = SqlWindow.partitionBy(*pair).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    chained = hits.withColumn("apart", F.coalesce(gap > BAND, F.lit(False)).cast("int"))
    chained = chained.withColumn("chain", F.sum("apart").over(along))
    whole = SqlWindow.partitionBy(*pair, "chain")
    several = F.min("diagonal").over(whole) < F.max("diagonal").over(whole)
    # a diagonal alone is judged as well: a chain may hold two copies with different values
    alone = F.struct(F.lit(False).alias("chained"), F.col("diagonal").cast("long").alias("place"))
    joint = F.struct(F.lit(True).alias("chained"), F.col("chain").cast("long").alias("place"))
    spans = chained.withColumn("several", several).withColumn(
        "span", F.explode(F.when(F.col("several"), F.array(alone, joint)).otherwise(F.array(alone)))
    )
    group = [*pair, "chained", "place"]
    slot = spans.select(
        *pair, "span.*", "item_at", "item_words", "n_windows", "n_words", F.posexplode("zipped").alias("k", "z")
    ).withColumn("pos", F.col("item_at") + F.col("k"))
    counted = slot.groupBy(*group).agg(
        F.count_distinct("item_at").alias("n_matched"),
        F.count_distinct("pos").alias("n_covered"),
        F.max("n_windows").alias("n_windows"),
        F.max("n_words").alias("n_words"),
    )
    share = F.greatest(F.col("n_matched") / F.col("n_windows"), F.col("n_covered") / F.col("n_words"))
    counted = counted.withColumn("coverage", F.least(share, F.lit(1.0)))
    counted = counted.filter((F.col("coverage") >= MIN_COVERAGE) | (F.col("n_covered") >= LONG_MATCH))
    # a run at either end of the item may go on in the document, so its value isn't compared
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("item_words") - 1)
    values = slot.filter(inner & _is_slot(F.col("z.a"))).groupBy(*group, F.col("z.a").alias("a")).agg(
        (F.min("z.b") == F.max("z.b")).cast("int").alias("one")
    )
    steady = values.groupBy(*group).agg(F.avg("one").alias("consistency"))
    same = [counted[c].eqNullSafe(steady[c]) for c in group]
    both = counted.join(steady, same, "left").select(
        *(counted[c] for c in group), "n_matched", "coverage", F.coalesce("consistency", F.lit(1.0)).alias("consistency")
    )
    judged = both.filter(F.col("consistency") >= MIN_CONSISTENCY).select(
        *names, "item_id", F.struct("n_matched", "coverage", "consistency").alias("best")
    )
    exact = _exact(rows, benchmark, told, names)
    if exact is not None:
        judged = judged.union(exact)
    best = judged.groupBy(*names, "item_id").agg(F.max("best").alias("best"))
    return best.select(*(F.col(n).alias(c) for c, n in zip(key, names)), "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text matches no item, with all their columns.

    Texts are told apart by two 64-bit hashes, so rows with equal or null identifiers are judged each
    by its own text; repeated rows go or stay together.
    """
    a, b = free_name(docs, "hash_a"), free_name(docs, "hash_b")
    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumn(a, F.xxhash64(c)).withColumn(b, F.xxhash64(F.lit(7), c))
    found = matches(keyed, benchmark, [a, b], text).select(a, b).distinct()
    flagged = small(stored(found, "flagged"), BROADCAST_ROWS)
    return keyed.join(flagged, [a, b], "left_anti").select(*(F.col(f"`{x}`") for x in docs.columns))
