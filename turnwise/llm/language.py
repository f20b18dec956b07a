"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled with a language. Features of a word are its identity (the lexicon),
its first and last two and three bytes, and its byte n-grams of two to four; transitions between the
labels of neighbouring words are learned with them, so that a switch of language inside a text is
found where it happens. The probabilities of the labels come from forward-backward messages; a
document's language is the one with the largest sum over its words, its score that sum's share.

Emissions depend on the word alone, so they are computed once per distinct word of a batch. Chains
are cut into blocks that all advance together; what enters each block is carried over afterwards,
which gives the same messages as going through each text from end to end.

The field is fitted by gradient steps on the conditional likelihood of a bounded sample: up to
``SAMPLE_DOCS`` distinct documents of each language, fewer where many languages share ``SAMPLE_TOTAL``, and of a longer
document a stretch of ``SAMPLE_CHARS`` characters that its hash chooses, shorter where there are many languages.
Every language that a training row names is learned. Every document is labelled from its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from . import words as W
from .common import small, stored

SAMPLE_DOCS = 200
SAMPLE_CHARS = 6_000
#: Documents of all languages together, but for LEAST_DOCS of each.
SAMPLE_TOTAL, LEAST_DOCS = 2_000, 5
#: Languages up to which texts are sampled in full stretches and worked on in blocks.
FEW_LABELS = 16
HASH_BITS = 17
BLOCK = 64
STEPS = 30
RATE = 0.15
L2 = 1e-5
UNKNOWN = "und"
_U = np.uint64
_SALT = {name: _U(0x9E37_79B9_7F4A_7C15 * (i + 1) & 0xFFFF_FFFF_FFFF_FFFF) for i, name in enumerate(("word", "p2", "p3", "s2", "s3", "n2", "n3", "n4"))}


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes that are part of a word's letters: ASCII letters and every byte of other characters."""
    return ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words (byte ranges of ``data``) and, per word, where its features begin."""
    n = len(start)
    size = 1 << HASH_BITS
    owner, value = [], []
    length = end - start

    def add(rows: np.ndarray, hashes: np.ndarray, name: str) -> None:
        owner.append(rows)
        value.append((W.mix(hashes ^ _SALT[name]) >> _U(64 - HASH_BITS)).astype(np.int64))

    def grams(at: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(at), k, _U)
        for i in range(k):
            out = out * _U(257) + data[at + i]
        return out

    for k in (2, 3):
        long = np.flatnonzero(length >= k)
        add(long, grams(start[long], k), f"p{k}")
        add(long, grams(end[long] - k, k), f"s{k}")
    for k in (2, 3, 4):
        count = np.maximum(length - k + 1, 0)
        rows = np.repeat(np.arange(n), count)
        at = start[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        add(rows, grams(at, k), f"n{k}")
    # identity: polynomial over all bytes
    count = length
    rows = np.repeat(np.arange(n), count)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    power = W._powers(0x9E3779B97F4A7C15 | 1, int(length.max(initial=0)) + 1)
    parts = (data[start[rows] + inside].astype(_U) + _U(1)) * power[inside]
    whole = np.zeros(n, _U)
    some = np.flatnonzero(count > 0)
    if len(rows):
        whole[some] = np.add.reduceat(parts, (np.cumsum(count) - count)[some])
    add(some, whole[some], "word")
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order] & (size - 1)
    return value, np.searchsorted(owner, np.arange(n + 1))


def _trim(words: W.Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges of the letters of the words: punctuation and digits at both ends are left out."""
    start, end = words.start[first], words.end[first]
    letter = np.r_[0, np.cumsum(_letters(words.data))]
    has = letter[end] > letter[start]
    at = np.flatnonzero(_letters(words.data)) if len(words.data) else np.empty(0, np.int64)
    lo = np.where(has, at[np.minimum(letter[start], max(len(at) - 1, 0))] if len(at) else start, start)
    hi = np.where(has, (at[np.maximum(letter[end] - 1, 0)] if len(at) else start) + 1, start)
    return lo, hi


def emissions(words: W.Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores per distinct word and label, and the distinct word of each word; no letters, no score."""
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, end = _trim(words, first)
    value, begin = _features(words.data, start, end)
    out = np.zeros((len(first), weights.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(begin) > 0)
    if len(some):
        out[some] = np.add.reduceat(weights[value], begin[some], axis=0)
        out[some] /= np.sqrt(np.diff(begin)[some])[:, None]
    return out, which


class Chains:
    """Words of several texts laid out in blocks of ``BLOCK``, for messages in all blocks at once."""

    def __init__(self, words: W.Words):
        self.words = words
        length = np.diff(words.first)
        per_text = -(-length // BLOCK)
        self.blocks = int(per_text.sum())
        self.first_block = np.cumsum(per_text) - per_text
        self.text = np.repeat(np.arange(len(length)), per_text)
        position = words.position()
        self.slot = (self.first_block[words.row] + position // BLOCK) * BLOCK + position % BLOCK
        self.used = np.zeros(self.blocks * BLOCK, bool)
        self.used[self.slot] = True
        self.used = self.used.reshape(self.blocks, BLOCK)
        self.number = np.arange(self.blocks) - self.first_block[self.text]  # of a block in its text
        self.per_text = per_text

    def marginals(self, score: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word, and the expected transitions between labels."""
        k = score.shape[1]
        if k > FEW_LABELS:  # what a block turns each label into takes the third power of the labels
            return _step_by_step(self.words, score, transition)
        e = np.ones((self.blocks * BLOCK, k), np.float32)
        e[self.slot] = np.exp(score - score.max(1, keepdims=True))
        e = e.reshape(self.blocks, BLOCK, k)
        step = np.exp(transition).astype(np.float32)
        start = np.broadcast_to(np.float32(1 / k), (self.blocks, k)).copy()
        begin = self.number == 0
        # forward: what each block turns every entering label into
        through = np.broadcast_to(np.eye(k, dtype=np.float32), (self.blocks, k, k)).copy()
        for t in range(BLOCK):
            use = self.used[:, t]
            moved = (through.reshape(-1, k) @ step).reshape(-1, k, k)
            if t == 0:
                moved[begin] = through[begin]  # no transition into the first word
            moved = moved * e[:, t, None, :]
            moved /= moved.sum((1, 2), keepdims=True)
            through = np.where(use[:, None, None], moved, through)
        enter, leave = start.copy(), np.ones((self.blocks, k), np.float32)
        last = int(self.per_text.max(initial=0))
        for b in range(1, last):
            now = self._at(b)
            into = (enter[now - 1][:, :, None] * through[now - 1]).sum(1)
            enter[now] = into / into.sum(1, keepdims=True)
        for b in range(last - 2, -1, -1):
            now = self._at(b)
            now = now[self.per_text[self.text[now]] > b + 1]
            back = (through[now + 1] * leave[now + 1][:, None, :]).sum(2)
            leave[now] = back / back.sum(1, keepdims=True)
        alpha = np.empty_like(e)
        state = enter
        for t in range(BLOCK):
            moved = state @ step
            if t == 0:
                moved[begin] = state[begin]
            moved = moved * e[:, t]
            moved /= moved.sum(1, keepdims=True)
            state = np.where(self.used[:, t, None], moved, state)
            alpha[:, t] = state
        out = np.empty_like(e)
        after = leave
        pairs = np.zeros((k, k))
        for t in range(BLOCK - 1, -1, -1):
            use = self.used[:, t]
            p = alpha[:, t] * after
            out[:, t] = p / p.sum(1, keepdims=True)
            weighted = e[:, t] * after
            before = alpha[:, t - 1] if t else enter
            real = use & ~(begin & (t == 0))
            joint = before[real][:, :, None] * step * weighted[real][:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back = weighted @ step.T
            back /= back.sum(1, keepdims=True)
            after = np.where(use[:, None], back, after)
        return out.reshape(-1, k)[self.slot], pairs

    def _at(self, b: int) -> np.ndarray:
        texts = np.flatnonzero(self.per_text > b)
        return self.first_block[texts] + b


def _step_by_step(words: W.Words, score: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same messages, word by word in all texts at once, the longest texts first."""
    k = score.shape[1]
    length = np.diff(words.first)
    order = np.argsort(-length, kind="stable")
    begin, length = words.first[:-1][order], length[order]
    e = np.exp(score - score.max(1, keepdims=True)).astype(np.float32)
    step = np.exp(transition).astype(np.float32)
    alpha, out = np.empty_like(e), np.empty_like(e)
    state = np.full((len(length), k), 1 / k, np.float32)
    most = int(length[0]) if len(length) else 0
    longer = np.searchsorted(-length, -np.arange(most), side="left")  # texts that go on beyond each place
    for t in range(most):
        a = longer[t]
        at = begin[:a] + t
        p = (state[:a] @ step if t else state[:a]) * e[at]
        state[:a] = alpha[at] = p / p.sum(1, keepdims=True)
    after = np.ones((len(length), k), np.float32)
    pairs = np.zeros((k, k))
    for t in range(most - 1, -1, -1):
        a = longer[t]
        at = begin[:a] + t
        p = alpha[at] * after[:a]
        out[at] = p / p.sum(1, keepdims=True)
        if t:
            weighted, before = e[at] * after[:a], alpha[at - 1]
            back = weighted @ step.T
            pairs += step * (before.T @ (weighted / (before * back).sum(1, keepdims=True)))
            after[:a] = back / back.sum(1, keepdims=True)
    return out, pairs


def fit(texts: list[str], labels: list[int], k: int) -> dict[str, np.ndarray]:
    """Weights and transitions by gradient ascent; each word of a lower-cased text has the text's label."""
    weights = np.zeros((1 << HASH_BITS, k), np.float32)
    transition = np.zeros((k, k))
    words = W.split_words(pa.array(texts, pa.large_string()))
    if not len(words.row) or k < 2:
        return {"weights": weights, "transition": transition}
    chains = Chains(words)
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, end = _trim(words, first)
    value, begin = _features(words.data, start, end)
    count = np.diff(begin)
    some = np.flatnonzero(count > 0)
    norm = np.zeros(len(first), np.float32)
    norm[some] = 1 / np.sqrt(count[some])
    truth = np.asarray(labels)[words.row]
    real = np.zeros((k, k))
    inner = words.position() > 0
    np.add.at(real, (truth[inner], truth[inner]), 1)
    # balance: every language weighs the same, however many words its sample has
    share = np.bincount(truth, minlength=k).astype(float)
    balance = (len(truth) / np.maximum(share, 1) / k)[truth].astype(np.float32)
    g2w, g2t = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    owner = np.repeat(np.arange(len(first)), count)
    for _ in range(STEPS):
        score = np.zeros((len(first), k), np.float32)
        score[some] = np.add.reduceat(weights[value], begin[some], axis=0) * norm[some, None]
        p, pairs = chains.marginals(score[which], transition)
        gap = -p
        gap[np.arange(len(truth)), truth] += 1
        gap *= balance[:, None]
        per_word = np.stack([np.bincount(which, gap[:, c], len(first)) for c in range(k)], 1) * norm[:, None]
        grad = np.stack([np.bincount(value, per_word[owner, c], len(weights)) for c in range(k)], 1) / len(texts)
        grad = (grad - L2 * weights).astype(np.float32)
        g2w += grad * grad
        weights += RATE * grad / np.sqrt(g2w)
        grad = (real - pairs) / len(truth) - 1e-3 * transition
        g2t += grad * grad
        transition += RATE * grad / np.sqrt(g2t)
    return {"weights": weights, "transition": transition}


def label_words(column: pa.Array, model: dict[str, np.ndarray]) -> tuple[W.Words, np.ndarray]:
    """The words of lower-cased texts and the label probabilities of each."""
    words = W.split_words(column)
    score, which = emissions(words, model["weights"])
    if not len(words.row):
        return words, np.zeros((0, model["weights"].shape[1]), np.float32)
    p, _ = Chains(words).marginals(score[which], model["transition"])
    return words, p


def _predict(model: dict[str, np.ndarray], names: list[str]):
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", W.CHUNK_BYTES * FEW_LABELS // max(k, FEW_LABELS)):
                column = part.column(1)
                words, p = label_words(column, model)
                start, end = _trim(words, np.arange(len(words.row)))
                said = (end > start)[:, None] * p  # only words with letters count
                total = np.zeros((len(column), k))
                for c in range(k):
                    total[:, c] = np.bincount(words.row, said[:, c], len(column))
                sums = total.sum(1)
                best = total.argmax(1)
                score = np.where(sums > 0, total.max(1) / np.maximum(sums, 1e-12), 0.0)
                text = [names[b] if s > 0 else UNKNOWN for b, s in zip(best, sums)]
                switches = np.zeros(len(column), np.int64)
                if len(words.row) > 1:
                    spoken = np.flatnonzero(end > start)
                    label, row = p[spoken].argmax(1), words.row[spoken]
                    turn = (label[1:] != label[:-1]) & (row[1:] == row[:-1])
                    switches = np.bincount(row[1:][turn], minlength=len(column))
                yield pa.record_batch(
                    [part.column(0), pa.array(text, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(switches)],
                    names=["id", "lang_pred", "score", "switches"],
                )

    return run


def sample(docs: DataFrame, id: str, text: str, lang: str, training: Column) -> list:
    """(lang, hash, text) of the bounded sample, texts in lower case, the same on every run."""
    c = F.col(f"`{text}`")
    rows = docs.filter(training & F.col(f"`{lang}`").isNotNull() & c.isNotNull())
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(c).alias("hash"), c.alias("text"))
    hashed = stored(rows.select("lang", "hash").distinct(), "labelled")
    counts = stored(hashed.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    labels = counts.count()
    each = min(SAMPLE_DOCS, max(LEAST_DOCS, SAMPLE_TOTAL // max(labels, 1)))
    chars = max(1_000, SAMPLE_CHARS * FEW_LABELS // max(labels, FEW_LABELS))
    # below a hash bound that about twice the sample falls under, so that no task sorts a whole language
    slot = F.pmod("hash", F.lit(1 << 30))
    drawn = hashed.join(small(counts, SAMPLE_TOTAL), "lang").filter(slot < F.ceil(F.lit(2.0 * each * (1 << 30)) / F.col("n")))
    place = F.row_number().over(SqlWindow.partitionBy("lang").orderBy(slot, "hash"))
    chosen = drawn.withColumn("place", place).filter(F.col("place") <= each).select("lang", "hash")
    chosen = small(stored(chosen, "sample"), SAMPLE_TOTAL)
    room = F.greatest(F.length("text") - F.lit(chars), F.lit(0))
    at = F.pmod(F.xxhash64("text", F.lit(1)), (room + 1).cast("long")).cast("int") + 1
    found = rows.join(chosen, ["lang", "hash"]).groupBy("lang", "hash").agg(F.min(F.lower(F.substring("text", at, F.lit(chars)))).alias("text"))
    return found.orderBy("lang", "hash").collect()


def identify(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang_pred, score, switches) for every row of ``docs``.

    ``training`` says which rows may be learned from; a null text or language never is. A text without
    a letter, or null, is ``und`` with score 0, as is every text where nothing was learned. ``switches`` counts
    the neighbouring words whose likeliest languages differ. Equal texts get equal results, rows with a null or
    repeated id one each, an empty table an empty one; texts are worked on whole, however long.
    """
    rows = sample(docs, id, text, lang, training)
    names = sorted({r.lang for r in rows})
    c = F.lower(F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`")))
    pairs = docs.select(F.col(f"`{id}`").alias("id"), c.alias("text"))
    if not names:
        nothing = pairs.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("switches"))
        return nothing.withColumnRenamed("id", id)
    model = fit([r.text for r in rows], [names.index(r.lang) for r in rows], len(names))
    kind = docs.schema[id].dataType.simpleString()
    found = pairs.mapInArrow(_predict(model, names), f"id {kind}, lang_pred string, score double, switches long")
    return found.withColumnRenamed("id", id)
