"""Repeated passages: words in a window of 20 words that the corpus has already seen are removed.

Seed and extend, on classes of occurrences instead of pairs of documents:

1. Seeds. Of the ``SEED``-word hashes in each window the least one is the window's anchor (winnowing), so
   equal windows have equal anchors, and an anchor stands for the run of windows that chose it.
   Anchors that occur once need no more work; they are dropped after a grouped count.
2. Extension. The span of an anchor reaches to the left and right as far as its windows do. Occurrences of one anchor with
   equal spans form a class: all its windows repeat those of its earliest document, and
   neighbouring spans join to maximal repeats in the document.
3. Ends of repeats. Where an anchor has several classes, only the earliest document of each class can
   hold a window first. The windows of these spans alone are compared one by one.

Every step is a grouped minimum, which combines before the shuffle, followed by an equi-join whose hot
keys Spark splits; no step pairs occurrences. Texts are read where they lie; only those of documents
with something to compare or to remove are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import small, stored

WINDOW = 20
SEED = 6
BROADCAST_ROWS = 2_000_000
BROADCAST_DOCS = 1_000_000
_U = np.uint64
_NO_ID = (1 << 63) - 1
#: A place in a document as one number: 27 bits of the text's hash, 32 of the first window, 4 of their count.
_TAG_BITS, _START_BITS, _COUNT_BITS = 27, 32, 4


def _tag(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << _TAG_BITS) - 1))


def _pack(tag: np.ndarray, start: np.ndarray, count) -> np.ndarray:
    return (tag << (_START_BITS + _COUNT_BITS)) | (start.astype(np.int64) << _COUNT_BITS) | count


def _tag_of(place: Column) -> Column:
    return F.shiftright(place, _START_BITS + _COUNT_BITS)


def anchors(words: W.Words) -> tuple[np.ndarray, ...]:
    """Per anchor: its hash, the hash of its span, its row, the index of its first window, their number."""
    width = WINDOW - SEED + 1
    none = np.empty(0, np.int64)
    starts = np.flatnonzero(words.left() >= WINDOW)
    if not len(starts):
        return none.astype(_U), none.astype(_U), none, none, none
    grams = W.gram_hashes(words, SEED)
    seen = np.lib.stride_tricks.sliding_window_view(grams, width)[starts]
    at = width - 1 - np.argmin(seen[:, ::-1], axis=1) + starts  # the rightmost of equal ones
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1) | (words.row[starts[1:]] != words.row[starts[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(starts)])
    begin, anchor = starts[first], at[first]
    # the span is the windows in their order, seen from the anchor
    windows = W.gram_hashes(words, WINDOW)[starts]
    order = (starts - np.repeat(begin, count)).astype(_U)
    sums = np.add.reduceat(W.mix(windows + order * _U(0x9E3779B97F4A7C15)), first)
    shape = (anchor - begin).astype(_U) * _U(64) + count.astype(_U)
    return grams[anchor], W.mix(sums ^ W.mix(shape)), words.row[begin], begin, count


def _seeds(with_span: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                words = W.split_words(part.column(part.schema.get_field_index("text")))
                anchor, span, row, begin, count = anchors(words)
                if not with_span:
                    yield pa.record_batch([pa.array(anchor.view(np.int64))], names=["anchor"])
                    continue
                doc, tag = (np.asarray(part.column(i))[row] for i in (0, 1))
                place = _pack(tag, begin - words.first[row], count)
                columns = [anchor.view(np.int64), span.view(np.int64), doc, place]
                yield pa.record_batch([pa.array(c) for c in columns], names=["anchor", "span", "doc", "place"])

    return run


def _spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and count of every packed place in a column of lists."""
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = (flat >> _COUNT_BITS) & ((1 << _START_BITS) - 1)
    return row, start, flat & ((1 << _COUNT_BITS) - 1)


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the spans, and the span each is of."""
    owner = np.repeat(np.arange(len(start)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return start[owner] + inside, owner


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the listed spans of each document, one row each."""
    for batch in batches:
        for part in W.chunks(batch, "text"):
            words = W.split_words(part.column(2))
            row, start, count = _spans(part.column(3))
            window, owner = _expand(start, count)
            row = row[owner]
            hashes = W.gram_hashes(words, WINDOW)[words.first[row] + window]
            seeds = W.gram_hashes(words, WINDOW - 1)[words.first[row] + window]
            doc, tag = (np.asarray(part.column(i))[row] for i in (0, 1))
            columns = [hashes.view(np.int64), seeds.view(np.int64), doc, _pack(tag, window, 1)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["window", "other", "doc", "place"])


def _repeats_inside(words: W.Words) -> np.ndarray:
    """Windows whose words also start earlier in the same text, as indexes of their first words."""
    starts = np.flatnonzero(words.left() >= WINDOW)
    keys = W.mix(W.gram_hashes(words, WINDOW)[starts] ^ W.mix(words.row[starts].astype(_U) + _U(1)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(starts), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return starts[again]


def _clean(with_text: bool, with_lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                words = W.split_words(part.column(2))
                starts = [_repeats_inside(words)]
                if with_lists:
                    row, start, count = _spans(part.column(3))
                    window, owner = _expand(start, count)
                    starts.append(words.first[row[owner]] + window)
                starts = np.concatenate(starts)
                n = len(words.row)
                edge = np.bincount(starts, minlength=n + WINDOW) - np.bincount(starts + WINDOW, minlength=n + WINDOW)[: n + WINDOW]
                gone = np.cumsum(edge)[:n] > 0
                total = np.diff(words.first)
                removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.first[:-1]) * (total > 0) if len(total) else total
                digests, kept = [], []
                _, offsets = W.text_buffer(part.column(2))
                for r in range(len(total)):
                    pieces = words.data[offsets[r] : offsets[r + 1]].tobytes().split()
                    if removed[r]:
                        pieces = compress(pieces, ~gone[words.first[r] : words.first[r + 1]])
                    text = b" ".join(pieces)
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if with_text else None)
                columns = [part.column(0), part.column(1), pa.array(total), pa.array(removed), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
                yield pa.record_batch(columns, names=["doc", "tag", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _later(occurrences: DataFrame, key: list[str]) -> DataFrame:
    """The earliest document of each key."""
    return occurrences.groupBy(*key).agg(F.min("doc").alias("first"))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc, tag, place) of every run of windows that an earlier document holds too.

    ``rows`` has doc, tag and text. Repeats inside one document are left to ``remove``.
    """
    seeds = rows.select("text").mapInArrow(_seeds(False), "anchor long")
    often = seeds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    often = small(stored(often, "anchors"), BROADCAST_ROWS)
    found = rows.mapInArrow(_seeds(True), "anchor long, span long, doc long, place long").join(often, "anchor")
    found = stored(found, "occurrences")
    classes = _later(found, ["anchor", "span"])
    several = classes.groupBy("anchor").agg((F.count("*") > 1).alias("several"))
    classes = classes.join(several, "anchor")
    judged = found.join(classes, ["anchor", "span"]).filter("doc > first OR several")
    judged = stored(judged.select("doc", "place", (F.col("doc") > F.col("first")).alias("later")), "spans")
    spans = judged.filter("later").select("doc", "place")
    ends = _listed(judged.filter("NOT later"))
    windows = _with_lists(rows, ends).mapInArrow(_ends, "window long, other long, doc long, place long")
    windows = stored(windows, "windows")
    first = _later(windows, ["window", "other"])
    repeats = windows.join(first, ["window", "other"]).filter("doc > first").select("doc", "place")
    return spans.union(repeats)


def _listed(places: DataFrame) -> DataFrame:
    """Places gathered per document; a list is bounded by the document's words."""
    lists = places.groupBy("doc", _tag_of(F.col("place")).alias("tag")).agg(F.collect_set("place").alias("places"))
    return stored(lists, "lists")


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The documents that have a list, with it; others are left out before the texts move."""
    keys = small(lists.select("doc", "tag"), BROADCAST_DOCS)
    return rows.join(keys, ["doc", "tag"], "left_semi").join(lists, ["doc", "tag"]).select("doc", "tag", "text", "places")


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) for every row of ``docs``.

    A word is removed if it lies in a window of ``WINDOW`` words of its document whose words also start in a
    document with a smaller identifier, or earlier in the same document; windows are judged on the
    input. ``kept`` is what stays, joined by single blanks, with its hash. A null text has no words. A
    null identifier comes after all others, and rows with equal identifiers do not count as earlier than each
    other, so repeated rows are judged alike. Texts shorter than a window keep all their words.
    """
    c = F.col(f"`{text}`")
    rows = docs.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NO_ID)).alias("doc"), _tag(c).alias("tag"), F.coalesce(c, F.lit("")).alias("text"))
    lists = _listed(repeated_windows(rows))
    schema = "doc long, tag long, n_words long, n_removed long, kept_sha256 string, kept string"
    listed = _with_lists(rows, lists).mapInArrow(_clean(with_text, True), schema)
    keys = small(lists.select("doc", "tag"), BROADCAST_DOCS)
    others = rows.join(keys, ["doc", "tag"], "left_anti").mapInArrow(_clean(with_text, False), schema)
    return listed.union(others).select(F.nullif("doc", F.lit(_NO_ID)).alias(id), "n_words", "n_removed", "kept_sha256", "kept")
