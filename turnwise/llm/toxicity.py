"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word, lower-cased, is the bag of its byte n-grams of three to five within ``<`` and ``>``. Each
hashed n-gram has a vector; a word is the mean of its n-grams' vectors, a window the mean of its
``WINDOW`` words, and a softmax over two classes reads the window. Vectors and softmax are trained together, in numpy,
so a misspelt or inflected word that was never seen is near the words that share its n-grams.

A toxic document may hold one insult in a thousand words, which a mean over the document would
drown. Its score is that of its worst window, over windows at every word; a shorter text is
one window. Training does the same: at first every window has its document's label, then only those windows
of toxic documents that the model takes for toxic, one at least, and what is left of them is
clean; at last only the worst window of each document counts, as it does for the score.

The model is fitted on a bounded sample: the ``SAMPLE_DOCS`` distinct texts of each label with the smallest
hash, of longer ones a stretch of ``SAMPLE_CHARS`` characters that the hash chooses. Every document is
scored over its whole text, from the text alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import stored

#: Distinct texts of each label that the model is fitted on, and the characters taken of each.
SAMPLE_DOCS = 1_500
SAMPLE_CHARS = 8_000
WINDOW = 6
GRAMS = (3, 4, 5)
HASH_BITS = 18
SIZE = 10
STEPS = 110
#: Steps in which all windows have their document's label, between choices of toxic windows afterwards, and
#: before those that only look at each document's worst window.
FIRST_STEPS, CHOOSE_EVERY, LAST_STEPS = 20, 5, 40
RATE = 0.5
L2 = 1e-6
THRESHOLD = 0.7
_U = np.uint64


def subwords(words: W.Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words at ``first``, and where each word's begin; there is one at least."""
    start, end = words.start[first], words.end[first]
    length = end - start + 2
    begin = np.cumsum(length) - length
    framed = np.empty(int(length.sum()), np.uint8)
    framed[begin], framed[begin + length - 1] = 60, 62  # < and >
    at = np.arange(len(framed)) - np.repeat(begin, length)
    inner = (at > 0) & (at < np.repeat(length, length) - 1)
    framed[inner] = words.data[(np.repeat(start, length) + at - 1)[inner]]
    count = sum(np.maximum(length - k + 1, 0) for k in GRAMS)
    offsets = np.r_[0, np.cumsum(count)]
    out = np.empty(int(offsets[-1]), np.int64)
    free = offsets[:-1].copy()
    for k in GRAMS:
        many = np.maximum(length - k + 1, 0)
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        place = np.repeat(begin, many) + inside
        value = np.full(len(place), k, _U)
        for i in range(k):
            value = value * _U(257) + framed[place + i]
        out[np.repeat(free, many) + inside] = (W.mix(value) >> _U(64 - HASH_BITS)).astype(np.int64)
        free += many
    return out, offsets


def fit(texts: list[str], labels: list[int], seed: int = 11) -> dict[str, np.ndarray] | None:
    """Vectors of the n-grams, softmax weights and bias; None unless both labels occur among words.

    A softmax of two classes reads a mean of vectors through the difference of its weights. So a step needs one
    number per n-gram forward (its vector times that difference) and one backward (how much more of it the
    windows ask for); the gradients of vectors and weights are products with these.
    """
    words = W.split_words(pa.array([t.lower() for t in texts], pa.large_string()))
    toxic_text = np.asarray(labels) == 1
    if not len(words.row) or len(set(toxic_text[words.row])) < 2:
        return None
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    grams, offsets = subwords(words, first)
    count = np.diff(offsets)
    # windows: each text is cut into stretches of WINDOW words, the last one shorter
    cut = np.flatnonzero(words.position() % WINDOW == 0)
    size = np.diff(np.r_[cut, len(words.row)])
    window = np.repeat(np.arange(len(cut)), size)
    text = words.row[cut]
    toxic = toxic_text[text]
    begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    number = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(text)]))
    draw = np.random.default_rng(seed)
    vector = draw.standard_normal((1 << HASH_BITS, SIZE)) * 0.1
    softmax = draw.standard_normal((SIZE, 2)) * 0.1
    bias = np.zeros(2)
    squares = [np.full(x.shape, 1e-12) for x in (vector, softmax, bias)]
    truth = toxic
    for step in range(STEPS):
        reading = softmax[:, 1] - softmax[:, 0]
        per_word = np.add.reduceat((vector @ reading)[grams], offsets[:-1]) / count
        logit = np.add.reduceat(per_word[which], cut) / size + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        if step >= FIRST_STEPS and step % CHOOSE_EVERY == 0:
            truth = toxic & ((p >= 0.5) | (p == np.maximum.reduceat(p, begins)[number]))
        use = np.ones(len(p), bool)
        if step >= LAST_STEPS:  # what is judged in the end: the worst window of each document
            truth = toxic
            use = p == np.maximum.reduceat(p, begins)[number]
        gap = np.where(use, truth - p, 0.0)  # of class 1; class 0 has its opposite
        if not FIRST_STEPS <= step < LAST_STEPS:  # both labels weigh the same
            gap *= np.where(truth, use.sum() / max((use & truth).sum(), 1), use.sum() / max((use & ~truth).sum(), 1)) / 2
        to_word = np.bincount(which, (gap / size)[window], len(first)) / count
        to_gram = np.bincount(grams, np.repeat(to_word, count), len(vector))
        to_class = vector.T @ to_gram
        grads = (np.outer(to_gram, reading), np.stack([-to_class, to_class], 1), gap.sum() * np.array([-1.0, 1.0]))
        for x, grad, square in zip((vector, softmax, bias), grads, squares):
            grad = grad / use.sum() - L2 * x
            square += grad * grad
            x += RATE * grad / np.sqrt(square)
    return {"gram": (vector @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), "bias": np.float32(bias[1] - bias[0])}


def scores(column: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of each lower-cased text's worst window; a text without words reads the bias alone."""
    words = W.split_words(column)
    length = np.diff(words.first)
    out = np.full(len(column), float(model["bias"]))
    if len(words.row):
        _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        grams, offsets = subwords(words, first)
        value = np.add.reduceat(model["gram"][grams].astype(np.float64), offsets[:-1]) / np.diff(offsets)
        total = np.r_[0.0, np.cumsum(value[which])]
        left = words.left()
        begins = np.flatnonzero((left >= WINDOW) | (words.position() == 0))
        stop = np.minimum(begins + WINDOW, words.first[words.row[begins] + 1])
        mean = (total[stop] - total[begins]) / (stop - begins)
        row = words.row[begins]
        has = np.flatnonzero(length > 0)
        out[has] += np.maximum.reduceat(mean, np.searchsorted(row, has))
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _score(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                # rounding makes equal texts equal in whatever batch they stand
                p = np.round(scores(part.column(1), model), 9)
                yield pa.record_batch([part.column(0), pa.array(p)], names=["id", "score"])

    return run


def sample(docs: DataFrame, labels: DataFrame, training: Column, id: str, text: str, label: str) -> list:
    """(text, toxic) of the bounded sample; a text that any training row calls toxic is toxic."""
    c = F.col(f"`{text}`")
    rows = docs.filter(training & c.rlike(r"\S")).select(F.col(f"`{id}`").alias("id"), F.xxhash64(c).alias("hash"))
    marked = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic"))
    marked = marked.filter("toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = stored(rows.join(marked, "id").groupBy("hash").agg(F.max("toxic").alias("toxic")), "labelled")
    many = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # below a hash bound that about twice the sample falls under, so that no task sorts more
    slot = F.pmod("hash", F.lit(1 << 30))
    bound = F.lit(0)
    for toxic, n in many.items():
        bound = F.when(F.col("toxic") == toxic, math.ceil(min(1.0, 2 * SAMPLE_DOCS / n) * (1 << 30))).otherwise(bound)
    drawn = known.filter(slot < bound)
    one_of = [drawn.filter(F.col("toxic") == toxic).orderBy(slot, "hash").limit(SAMPLE_DOCS) for toxic in (0, 1)]
    chosen = stored(one_of[0].union(one_of[1]), "chosen")  # 2 * SAMPLE_DOCS rows at most
    texts = docs.filter(training).select(c.alias("text"), F.xxhash64(c).alias("hash"))
    found = texts.join(F.broadcast(chosen), "hash").groupBy("hash", "toxic").agg(F.min(_stretch("text")).alias("text"))
    return sorted(found.collect(), key=lambda r: r.hash)


def _stretch(text: str) -> Column:
    """A text of at most SAMPLE_CHARS characters as it is, else a stretch that its hash chooses."""
    room = F.greatest(F.length(text) - F.lit(SAMPLE_CHARS), F.lit(0))
    at = F.pmod(F.xxhash64(F.col(text), F.lit(1)), (room + 1).cast("long")).cast("int") + 1
    return F.substring(F.col(text), at, F.lit(SAMPLE_CHARS))


def score(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """(id, score) for every row of ``docs``: the probability that its text is toxic.

    ``labels`` holds ``id`` and ``label`` (0 or 1; other values and null are no label, several of one id
    count as the largest); ``training`` says which rows of ``docs`` may be learned from. Equal texts get equal
    scores. A null text counts as empty; a text without words gets what the softmax says of nothing. Without labels
    of both kinds nothing can be learned: every score is 0. Rows with a null or repeated id are scored like others;
    an empty table gives an empty one. Texts are worked on whole, a long one in memory proportional to its words.
    """
    rows = sample(docs, labels, training, id, text, label)
    model = fit([r.text for r in rows], [r.toxic for r in rows])
    pairs = docs.select(F.col(f"`{id}`").alias("id"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"))
    if model is None:
        return pairs.select(F.col("id").alias(id), F.lit(0.0).alias("score"))
    kind = docs.schema[id].dataType.simpleString()
    return pairs.mapInArrow(_score(model), f"id {kind}, score double").withColumnRenamed("id", id)
