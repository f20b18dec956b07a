"""Runs of repeated words in every text: maximal stretches that repeat with a period.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) that is at least
``max(MIN_WORDS, 2 * q)`` words long and that no neighbouring word continues. All runs of a text are
found, of every period, without comparing all pairs of places:

* **Direct lag scans** compare the text with itself ``q`` words later, for each ``q`` below ``LAGS``.
* **Minimizers at several scales** find the longer periods. At scale ``l`` (32, 64, ...) every window of
  ``l`` words marks its least ``l/2``-gram, by hash. Inside a run of period ``q`` in ``[l, 2l)`` a window and
  the one ``q`` words later hold the same words, so equal minimizers lie ``q`` apart; every such pair is
  a seed.
* **Extension** follows a seed to both sides while words ``q`` apart agree, by binary search over hashes
  of prefixes, and keeps stretches of two periods or more.

Grams that repeat inside themselves (a period of at most half their length; they lie in a run that a
smaller scale found) are no minimizers: their equal neighbours would be as many as the square of the
stretch. A run made of such grams alone lies on two touching runs of one smaller period, and
its periods follow from the phases of the two; these pairs are seeds as well. So seeds stay
proportional to the text and nothing is missed.

Texts of an Arrow batch are worked on together as one sequence with a separator of its own after each,
longest first, so that a scale only touches texts that can hold a run of it. Words and stretches
are compared by hashes of 62 to 64 bits. A text is worked on in one task; memory is a few arrays of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

MIN_WORDS = 12
#: Periods below it are found by direct scans; also the words of the smallest scale's windows.
LAGS = 32
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
_PRIMES = (2147483647, 2147483629)
_BASES = (1_181_783_497, 1_370_589_217)


class Runs(NamedTuple):
    """Parallel arrays, sorted by row, start and period; places are word numbers of the row's text."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    size, step = 1, base % prime
    while size < n:
        k = min(size, n - size)
        out[size : size + k] = out[:k] * step % prime
        size += k
        step = step * step % prime
    return out


class _Sequence:
    """Hashes of stretches of one sequence of words, and how far words at two places agree."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        self.word, self.n = word, n
        self.sums, self.powers = [], []
        for base, prime in zip(_BASES, _PRIMES):
            power = _powers(base, n + 1, prime)
            total = np.zeros(n + 1, np.int64)
            np.cumsum((word % _U(prime)).astype(np.int64) * power[:n] % prime, out=total[1:])
            self.sums.append(total % prime)
            self.powers.append(power)
        power = W._powers(W._BASE, n + 1)
        self.total = np.zeros(n + 1, _U)
        np.cumsum(word * power[:n], out=self.total[1:])
        self.inverse = W._powers(W._INVERSE, n + 1)

    def grams(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Hash of the ``k`` words at each place from ``lo`` to before ``hi``."""
        return W.mix((self.total[lo + k : hi + k] - self.total[lo:hi]) * self.inverse[lo:hi])

    def _same(self, at: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words of [at, at + length) and those ``lag`` later are equal."""
        ok = np.ones(len(at), bool)
        for total, power, prime in zip(self.sums, self.powers, _PRIMES):
            left = (total[at + length] - total[at]) % prime * power[lag] % prime
            ok &= left == (total[at + lag + length] - total[at + lag]) % prime
        return ok

    def extend(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around [at, at + lag) that keeps the period ``lag``."""
        right = self._longest(self.n - at - lag, lambda x: self._same(at, lag, x))
        left = self._longest(at, lambda x: self._same(at - x, lag, x))
        return at - left, at + lag + right

    @staticmethod
    def _longest(most: np.ndarray, holds) -> np.ndarray:
        """The largest length up to ``most`` for which ``holds``, which is so for all shorter ones."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            middle = (lo + hi + 1) // 2
            ok = holds(middle)
            lo, hi = np.where(ok, middle, lo), np.where(ok, hi, middle - 1)
        return lo


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) of every window of ``width`` values, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = least(x[:-step], x[step:])
        size += step
    return x


def _covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Places that lie in one of the stretches."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _lag_scan(word: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of period ``lag`` that is long enough."""
    equal = np.zeros(len(word) - lag + 2, np.int8)
    equal[1:-1] = word[lag:] == word[:-lag]
    edge = np.flatnonzero(np.diff(equal))
    start, end = edge[::2], edge[1::2]
    long = end - start >= max(MIN_WORDS - lag, lag)
    return start[long], end[long] + lag


def _minimizer_pairs(key: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of equal window minima that are at least ``scale`` and below twice it apart."""
    width = scale - scale // 2 + 1
    low = _sliding(key, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, _U), low, np.zeros(width - 1, _U)])
    at = np.flatnonzero((_sliding(padded, width, np.maximum) == key) & (key != _TOP))
    order = np.argsort(key[at], kind="stable")
    value, place = key[at][order], at[order]
    places, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, len(at)):  # grams without a period of half their length: eight steps at most
        distance = place[step:] - place[:-step]
        near = (value[step:] == value[:-step]) & (distance < 2 * scale)
        if not near.any():
            break
        near &= distance >= scale
        places.append(place[:-step][near])
        lags.append(distance[near])
    return np.concatenate(places), np.concatenate(lags)


def _touching_pairs(text: _Sequence, start, end, period, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds from neighbouring runs of one small period that touch, where their phases agree."""
    use = np.flatnonzero((period <= scale // 4) & (end - start >= scale))
    use = use[np.lexsort((start[use], period[use]))]
    places, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    one, two = use[:-1], use[1:]
    meet = (period[one] == period[two]) & (start[two] <= end[one])
    for i, j in zip(one[meet], two[meet]):
        p, s1, e1, s2, e2 = int(period[i]), int(start[i]), int(end[i]), int(start[j]), int(end[j])
        phase = np.flatnonzero(text.grams(p, s2, s2 + p) == text.grams(p, e1 - p, e1 - p + 1)[0])
        if len(phase):
            first = (s2 + int(phase[0]) - e1 + p - scale) % p + scale
            lag = np.arange(first, 2 * scale, p, dtype=np.int64)
            place = np.maximum(s1, s2 - lag)
            fits = place <= np.minimum(e1 - lag, e2 - 2 * lag)
            places.append(place[fits])
            lags.append(lag[fits])
    return np.concatenate(places), np.concatenate(lags)


def find_runs(words: W.Words) -> Runs:
    """All runs of the texts of a chunk."""
    length = np.diff(words.first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] >= MIN_WORDS]
    none = np.empty(0, np.int64)
    if not len(order):
        return Runs(none, none, none, none)
    size = length[order]
    base = np.cumsum(size + 1) - size - 1  # a separator follows each text
    word = W.mix(np.arange(int(base[-1] + size[-1]) + 1).astype(_U) + _U(0x5851F42D4C957F2D))
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    word[np.repeat(base, size) + inside] = words.hash[np.repeat(words.first[order], size) + inside]

    def upto(least: int) -> int:
        """Where the texts of at least ``least`` words end; 0 if there are none."""
        many = int(np.searchsorted(-size, -least, side="right"))
        return int(base[many - 1] + size[many - 1]) if many else 0

    starts, ends, periods = [none], [none], [none]
    for lag in range(1, LAGS):
        limit = upto(max(MIN_WORDS, 2 * lag))
        if not limit:
            break
        a, b = _lag_scan(word[:limit], lag)
        starts.append(a), ends.append(b), periods.append(np.full(len(a), lag))
    scale = LAGS
    text = _Sequence(word) if upto(2 * scale) else None
    while limit := upto(2 * scale):
        k = scale // 2
        a, b, q = _least(np.concatenate(starts), np.concatenate(ends), np.concatenate(periods))
        key = text.grams(k, 0, limit - k + 1)
        inner = (q <= k // 2) & (b - a >= k) & (b <= limit)
        key[_covered(a[inner], b[inner] - k + 1, len(key))] = _TOP
        seeds, lags = _minimizer_pairs(key, scale)
        more, more_lags = _touching_pairs(text, a, b, q, scale)
        seeds, lags = np.concatenate([seeds, more]), np.concatenate([lags, more_lags])
        a, b = text.extend(seeds, lags)
        long = b - a >= 2 * lags
        starts, ends, periods = [*starts, a[long]], [*ends, b[long]], [*periods, lags[long]]
        scale *= 2
    a, b, q = _least(np.concatenate(starts), np.concatenate(ends), np.concatenate(periods))
    at = np.searchsorted(base, a, side="right") - 1
    row, start = order[at], a - base[at]
    rank = np.lexsort((q, start, row))
    return Runs(row[rank], start[rank], (b - a)[rank], q[rank])


def _least(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period: a multiple of it gives the same stretch."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.chunks(batch, "text"):
            found = find_runs(W.split_words(part.column(1)))
            ids = part.column(0).take(pa.array(found.row))
            yield pa.record_batch(
                [ids, pa.array(found.start), pa.array(found.length), pa.array(found.period)],
                names=["id", "start", "length", "period"],
            )


def _collapse(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                column = part.column(1)
                words = W.split_words(column)
                found = find_runs(words)
                n, rows = len(words.row), len(column)
                begin = words.first[found.row] + found.start
                gone = _covered(begin + found.period, begin + found.length, n)
                dropped = np.bincount(words.row[gone], minlength=rows)
                bound = np.searchsorted(found.row, np.arange(rows + 1))
                _, offsets = W.text_buffer(column)
                best = np.lexsort((found.period, found.start, -found.length, found.row))[np.minimum(bound[:-1], max(len(found.row) - 1, 0))] if len(found.row) else np.zeros(rows, np.int64)
                some = bound[1:] > bound[:-1]
                said, kept, texts = [], [], []
                for r in range(rows):
                    lines = "".join(
                        f"{s},{m},{p}\n"
                        for s, m, p in zip(*(x[bound[r] : bound[r + 1]].tolist() for x in found[1:]))
                    )
                    said.append(hashlib.sha256(lines.encode()).hexdigest())
                    pieces = words.data[offsets[r] : offsets[r + 1]].tobytes().split()
                    if dropped[r]:
                        pieces = compress(pieces, ~gone[words.first[r] : words.first[r + 1]])
                    joined = b" ".join(pieces)
                    kept.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode() if with_text else None)

                def of(values: np.ndarray) -> pa.Array:
                    return pa.array(values[best] if len(values) else np.zeros(rows, np.int64), pa.int64(), mask=~some)

                columns = [
                    part.column(0),
                    pa.array(np.diff(words.first)),
                    pa.array(dropped.astype(np.int64)),
                    pa.array(np.diff(bound)),
                    of(found.start),
                    of(found.length),
                    of(found.period),
                    of(found.length * 1000 // np.maximum(found.period, 1)),
                    pa.array(said, pa.string()),
                    pa.array(kept, pa.string()),
                    pa.array(texts, pa.string()),
                ]
                yield pa.record_batch(columns, names=_COLUMNS)

    return run


_COLUMNS = [
    "id", "n_words", "n_dropped", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
    "collapsed_sha256", "collapsed",
]


def _pairs(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, str]:
    pairs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return pairs, pairs.schema["id"].dataType.simpleString()


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, period) of every run of every text of ``docs``; places count words from 0.

    Rows are judged one by one: repeated rows and identifiers, null ones too, give their runs again. A null or
    empty text has none, an empty table gives an empty one, other columns are not looked at.
    """
    pairs, kind = _pairs(docs, id, text)
    found = pairs.mapInArrow(_each, f"id {kind}, start long, length long, period long")
    return found.withColumnRenamed("id", id)


def collapse(docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: its runs counted, the longest one, and the text without repetitions.

    A word is dropped if a run holds it after that run's first period. ``start``, ``length``, ``period`` and
    ``exponent_milli`` (thousandths of a period, rounded down) are those of the longest run, of several the one
    that starts first and then that of the least period; null without a run. ``runs_sha256`` is the hash of all
    runs, a line ``start,length,period`` each; ``collapsed`` is what stays, joined by single blanks, with its
    hash, and null unless ``with_text``. A null text has no words and collapses to an empty one; repeated rows
    are judged alike; an empty table gives an empty one; other columns are not looked at. Very long texts
    are worked on alone, in memory proportional to their words.
    """
    pairs, kind = _pairs(docs, id, text)
    schema = (
        f"id {kind}, n_words long, n_dropped long, n_runs long, start long, length long, period long, "
        "exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    )
    return pairs.mapInArrow(_collapse(with_text), schema).withColumnRenamed("id", id)
