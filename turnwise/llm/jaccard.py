"""N-gram Jaccard join by vertical partitioning.

1. ``describe``: every document becomes the hash of its set of word shingles; equal sets are one
   class from here on, so copies are never paired. The same pass counts, task by task, shingles that
   several classes share.
2. The global order of shingles: the longest first, as they are the rarest as a rule, then by hash; the
   most frequent ones (``HEAD`` of them, by the counts) last. A shingle's number begins with its length, so
   the order of the numbers is the global order.
3. Candidates: two sets that are similar enough share a shingle among the first few of each in that
   order (the prefix). Equal shingles are brought together and cut into stars, which is linear in the
   prefixes. Pairs are screened by bitmaps: a bit is the parity of the shingles that hash to it, so each bit in
   which two sets differ is a shingle that one of them lacks. Sets that only share a passage are told apart here,
   before anything is connected: in a large corpus such passages would link most documents into one group.
   First each set meets the centre of its stars, and what passes is connected. Where a star then holds
   sets of several groups, those outside its largest group meet all others of the star. The connected
   groups of all that passed go on.
4. Vertical partitioning: the global order is cut into ``FRAGMENTS`` fragments. Each fragment counts, for the candidates
   of a group, the partial overlaps of their shingles in that fragment alone; the partial overlaps are summed
   per pair and compared with the threshold. Pairs travel as matrices of counts, never as rows. Groups above
   ``BLOCK`` classes are cut into blocks, and each pair of blocks is a task of its own.
5. Links give the number of links per document and, again as connected components, the classes.

No group of copies, prefix shingle, star or candidate group is limited; only the work is split. Sets and
shingles are identified by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import free_name, small, stored
from .components import components

HEAD = 200_000
#: Classes of one task that must share a shingle before it is counted for the order.
SHARED = 4
#: Shingles that a task counts at once.
FLUSH = 2_000_000
#: The global order is cut where shingles get shorter than so many bytes; the head is the last fragment.
CUTS = (40, 30, 20)
FRAGMENTS = len(CUTS) + 2
#: Bits of the smallest bitmap.
BITMAP_BITS = 1024
BLOCK = 1000
BROADCAST_ROWS = 1_000_000
_U = np.uint64
_NO_ID = (1 << 63) - 1
#: A set's size and the largest size of a partner are packed into one number.
_SIZE_BITS = 31


def _number(length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A shingle's place in the global order: 8 bits that fall with its length, 56 of its hash."""
    return ((255 - np.minimum(length, 255)).astype(_U) << _U(56)) | (hashes >> _U(8))


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) sorted and without repeats, and the size of each row's set.

    A text of fewer than ``n`` words, but at least one, has its whole sequence as its only shingle.
    """
    w = W.split_words(column, lower_ascii=True)
    rows = len(w.first) - 1
    count = np.diff(w.first)
    bytes_before = np.r_[0, np.cumsum(w.end - w.start)]

    def numbers(at: np.ndarray, k: int, hashes: np.ndarray) -> np.ndarray:
        return _number(bytes_before[at + k] - bytes_before[at], hashes)

    full = np.flatnonzero(w.left() >= n)
    row, token = [w.row[full]], [numbers(full, n, W.gram_hashes(w, n)[full])]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            at = w.first[short]
            row.append(short)
            token.append(numbers(at, k, W.mix(W.gram_hashes(w, k)[at] + _U(k))))
    row, token = np.concatenate(row), np.concatenate(token)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[new], token[new]
    return row, token, np.bincount(row, minlength=rows)


def set_hashes(row: np.ndarray, token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    out = np.zeros(len(size), _U)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sums = np.add.reduceat(W.mix(token ^ _U(0x5851F42D4C957F2D)), first)
        out[row[first]] = W.mix(sums ^ W.mix(size[row[first]].astype(_U)))
    return out


def bitmaps(row: np.ndarray, token: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set, the parity of its shingles in the cells of their hash.

    A set has at least twice as many cells as shingles, in powers of two from ``BITMAP_BITS``. Halves
    of a bitmap combine by exclusive or to the one with half as many cells.
    """
    out = [b""] * len(size)
    cells = np.maximum(BITMAP_BITS, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    first = np.searchsorted(row, np.arange(len(size) + 1))
    for bits in np.unique(cells).tolist():
        mine = np.flatnonzero(cells == bits)
        step = max(1, (1 << 21) // bits)
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            count = first[rows + 1] - first[rows]
            place = np.repeat(first[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
            cell = (token[place] & _U(bits - 1)).astype(np.int64) + np.repeat(np.arange(len(rows)) * bits, count)
            odd = np.bincount(cell, minlength=len(rows) * bits).astype(np.uint8) & 1
            packed = np.packbits(odd.reshape(len(rows), bits), axis=1)
            for r, x in zip(rows.tolist(), packed):
                out[r] = x.tobytes()
    return out


def _differences(
    maps: list[bytes], meet: Callable[[int, np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each bitmap, others and in how many bits they differ from it; each pair comes once.

    Bitmaps of different length are compared at the shorter's. ``meet`` says which of some rows
    a row is to be compared with.
    """
    length = np.array([len(x) for x in maps])
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length >= size)
        folded = np.empty((len(rows), size // 8), _U)
        for k, r in enumerate(rows.tolist()):
            x = np.frombuffer(maps[r], _U)
            while x.nbytes > size:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            folded[k] = x
        for k, r in enumerate(rows.tolist()):
            if length[r] == size:
                other = (length[rows] > size) | (rows > r)
                if meet:
                    other &= meet(r, rows)
                other = np.flatnonzero(other)
                yield r, rows[other], np.bitwise_count(folded[other] ^ folded[k]).sum(1, dtype=np.int64)


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def shared() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count >= SHARED], count[count >= SHARED]
            none = pa.nulls(len(token), pa.int64())
            return pa.record_batch(
                [none, none, none, none, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(count)],
                names=names,
            )

        names = ["id", "text_hash", "class", "n", "bitmap", "token", "count"]
        for batch in batches:
            for part in W.chunks(batch, "text"):
                row, token, size = shingle_sets(part.column(2), n)
                klass = set_hashes(row, token, size)
                none = pa.nulls(len(size), pa.int64())
                bits = pa.array(bitmaps(row, token, size), pa.binary())
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(klass.view(np.int64)), pa.array(size), bits, none, none],
                    names=names,
                )
                fresh = np.zeros(len(size), bool)
                for i, c in enumerate(klass.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                held.append(token[fresh[row]])
                total += len(held[-1])
                if total >= FLUSH:
                    yield shared()
                    seen.clear()
                    held.clear()
                    total = 0
        if held:
            yield shared()

    return run


def _order(token: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys of shingles in the global order: whether in the head, then place or number.

    ``head`` is a pair of sorted shingles and their places, as rows.
    """
    if not head.shape[1]:
        return np.zeros(len(token), bool), token
    at = np.minimum(np.searchsorted(head[0], token), head.shape[1] - 1)
    inside = head[0][at] == token
    return inside, np.where(inside, head[1][at], token)


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of which a similar one must share one: size - ceil(percent% of size) + 1."""
    return size - -(-percent * size // 100) + 1


def largest_partner(size: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The size above which no set can be similar to one of ``size`` if the first shingle that both
    hold is at place ``at`` in its order: the rest is too short for the overlap that is needed."""
    return np.maximum((size - at) * (100 + percent) // percent - size, 0)


def _prefixes(n: int, percent: int, head: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in W.chunks(batch, "text"):
                row, token, size = shingle_sets(part.column(0), n)
                klass = set_hashes(row, token, size)
                if len(seen) > FLUSH // 10:
                    seen.clear()
                fresh = np.zeros(len(size), bool)
                for i, c in enumerate(klass.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                keep = fresh[row]
                row, token = row[keep], token[keep]
                last, place = _order(token, head)
                order = np.lexsort((place, last, row))
                row, token = row[order], token[order]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
                at = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
                keep = at < prefix_length(size, percent)[row]
                row, token, at = row[keep], token[keep], at[keep]
                reach = largest_partner(size[row], at, percent)
                columns = [token.view(np.int64), (size[row] << _SIZE_BITS) | reach, klass[row].view(np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["token", "sizes", "class"])

    return run


def _stars():
    """The stars of two classes and more within runs of equal shingles, sorted by size; a gap in the sizes ends a star.

    A gap is where the next size is above what every set before it in the run can be similar to, given
    the shingle's place in it. Two sets that are similar have no gap between them at the first
    shingle that they share, so they are in one star there. The centre, a star's first class, is also one of its rows.
    """
    mask = (1 << _SIZE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle, size, centre, reach of the sets so far
        last_class, begun = None, False  # and whether rows of the star were given
        for batch in batches:
            token, sizes, klass = (np.asarray(batch.column(i)) for i in range(3))
            if last is not None and len(token):
                again = int(token[0] == last[0] and klass[0] == last_class)
                token, sizes, klass = token[again:], sizes[again:], klass[again:]
            if not len(token):
                continue
            fresh = np.r_[True, (token[1:] != token[:-1]) | (klass[1:] != klass[:-1])]
            token, sizes, klass = token[fresh], sizes[fresh], klass[fresh]
            last_class = klass[-1]
            n, reach = sizes >> _SIZE_BITS, sizes & mask
            if last is not None:
                token, n, klass, reach = (np.r_[x, y] for x, y in zip(last, (token, n, klass, reach)))
            run_of = np.cumsum(np.r_[False, token[1:] != token[:-1]])
            # the largest reach so far in each run: runs are lifted apart, then cut to size again
            lift = run_of << (_SIZE_BITS + 1)
            reach = np.maximum.accumulate(reach + lift) - lift
            begin = np.ones(len(token), bool)
            begin[1:] = (run_of[1:] != run_of[:-1]) | (n[1:] > reach[:-1])
            first = np.flatnonzero(begin)
            count = np.diff(np.r_[first, len(token)])
            centre = np.repeat(klass[first], count)
            keep = np.repeat(count > 1, count)
            keep[0] &= not begun
            begun = bool(count[-1] > 1) or begun and len(first) == 1
            last = (token[-1], n[-1], centre[-1], reach[-1])
            star = W.mix(token.view(_U) ^ W.mix(centre.view(_U))).view(np.int64)
            yield pa.record_batch([pa.array(x[keep]) for x in (star, klass, centre)], names=["star", "class", "centre"])

    return run


def _fragments(n: int, head: np.ndarray):
    """The shingles of each document by fragment of the global order."""
    cuts = _number(np.array(CUTS) - 1, np.zeros(len(CUTS), _U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                row, token, size = shingle_sets(part.column(0), n)
                klass = set_hashes(row, token, size).view(np.int64)
                last, _ = _order(token, head)
                place = np.searchsorted(cuts, token, side="right")
                place[last] = FRAGMENTS - 1
                order = np.lexsort((token, place, row))
                row, token, place = row[order], token[order], place[order]
                out = []
                for f in range(FRAGMENTS):
                    mine = place == f
                    cut = np.searchsorted(row[mine], np.arange(len(size) + 1))
                    blob = token[mine].tobytes()
                    out += [(klass[r], int(size[r]), f, blob[8 * cut[r] : 8 * cut[r + 1]]) for r in range(len(size)) if size[r]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                    names=["class", "n", "fragment", "tokens"],
                )

    return run


def partial_overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right`` in one fragment."""
    out = np.zeros((len(left), len(right)), np.int32)
    if len(left) * len(right) <= 9:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if not (left is right and i >= j):
                    out[i, j] = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
        return out + out.T if left is right else out
    a, b = ([np.frombuffer(x, _U) for x in side] for side in (left, right))
    ta, tb = np.concatenate([*a, np.empty(0, _U)]), np.concatenate([*b, np.empty(0, _U)])
    common = np.intersect1d(ta, tb)
    if left is right:
        common, times = np.unique(ta, return_counts=True)
        common = common[times > 1]
    if not len(common):
        return out
    ra, rb = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b))

    def places(token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, token), len(common) - 1)
        ok = common[at] == token
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], row[ok][order]

    ca, ra = places(ta, ra)
    cb, rb = places(tb, rb)
    width = 2048
    for start in range(0, len(common), width):
        sides = []
        for c, r, k in ((ca, ra, len(left)), (cb, rb, len(right))):
            lo, hi = np.searchsorted(c, [start, start + width])
            m = np.zeros((k, min(width, len(common) - start)), np.float32)
            m[r[lo:hi], c[lo:hi] - start] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int32)
    return out


_PAIR = ["task", "component", "bi", "bj"]


def _runs(part: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """``part`` sorted, and the slices of it that belong to one pair of blocks."""
    part = part.sort_values([*_PAIR, *order], ignore_index=True)
    keys = part[_PAIR].to_numpy(np.int64)
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
    return part, list(zip(first, [*first[1:], len(part)]))


def _count(part: pd.DataFrame) -> pd.DataFrame:
    """Partial overlaps of each pair of blocks in one fragment, as a matrix of counts."""
    part, runs = _runs(part.drop_duplicates([*_PAIR, "class"]), ["block", "class"])
    tokens, block = part.tokens.tolist(), part.block.to_numpy()
    columns = [part[c].to_numpy(np.int64) for c in ("class", "n", "size")]
    keys = [part[c].tolist() for c in _PAIR]
    out = []
    for lo, hi in runs:
        bi, bj = keys[2][lo], keys[3][lo]
        if bi == bj:
            a = b = slice(lo, hi)
            left = right = tokens[a]
        else:
            middle = lo + int(np.searchsorted(block[lo:hi], bj))
            a, b = slice(lo, middle), slice(middle, hi)
            left, right = tokens[a], tokens[b]
        blobs = [c[side].tobytes() for c in columns for side in (a, b)]
        out.append((*(k[lo] for k in keys), *blobs, partial_overlaps(left, right).tobytes()))
    return pd.DataFrame(out, columns=[*_PAIR, "class_a", "class_b", "n_a", "n_b", "size_a", "size_b", "counts"])


def _components(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that links reach from it."""
    label = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if label[i] < 0:
            label[i] = i
            front = [i]
            while front:
                near = np.flatnonzero(adjacent[front].any(0) & (label < 0))
                label[near] = i
                front = near.tolist()
    return label


def _possible(differ: np.ndarray, n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``other`` shingles can be similar if bitmaps differ in ``differ`` bits."""
    both, least = n + other, np.minimum(n, other)
    return (differ * (100 + percent) <= both * (100 - percent)) & (percent * (both - least) <= 100 * least)


def _near(percent: int):
    """The pairs that bitmaps and sizes leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, other = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            maps = [batch.column(c).to_pylist() for c in ("map_a", "map_b")]
            length = np.array([[len(x) for x in side] for side in maps]).reshape(2, -1)
            differ = np.zeros(len(n), np.int64)
            for la, lb in np.unique(length, axis=1).T.tolist():
                rows = np.flatnonzero((length[0] == la) & (length[1] == lb))
                folded = []
                for side, size in zip(maps, (la, lb)):
                    x = np.frombuffer(b"".join(side[r] for r in rows.tolist()), _U).reshape(len(rows), size // 8)
                    while x.shape[1] * 8 > min(la, lb):
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    folded.append(x)
                differ[rows] = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64)
            ok = pa.array(_possible(differ, n, other, percent))
            yield pa.record_batch([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


def _screen(percent: int):
    """Stars of the sets of different groups that bitmaps and sizes leave possible, in each pair of blocks."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, runs = _runs(part.drop_duplicates([*_PAIR, "class"]), ["class"])
        klass, n, label = (part[c].to_numpy(np.int64) for c in ("class", "n", "label"))
        own, odd = (part[c].to_numpy(bool) for c in ("own", "odd"))
        maps = part.bitmap.tolist()
        out = []
        for lo, hi in runs:
            near = np.zeros((hi - lo, hi - lo), bool)
            a, b, group, sizes = own[lo:hi], odd[lo:hi], label[lo:hi], n[lo:hi]

            def meet(i: int, rows: np.ndarray) -> np.ndarray:
                return (a[i] & b[rows] | b[i] & a[rows]) & (group[rows] != group[i])

            for i, other, differ in _differences(maps[lo:hi], meet):
                near[i, other] = _possible(differ, sizes[i], sizes[other], percent)
            label_of = _components(near | near.T)
            real = np.flatnonzero(label_of != np.arange(hi - lo))
            out.append(np.stack([klass[lo:hi][real], klass[lo:hi][label_of[real]]], 1))
        found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _sum(percent: int):
    """Sum the partial overlaps per pair, keep the links, and reduce them to stars and numbers."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part, runs = _runs(part, [])
        sides = [part[c].tolist() for c in ("class_a", "class_b", "n_a", "n_b", "size_a", "size_b")]
        counts, bi_, bj_ = part.counts.tolist(), part.bi.tolist(), part.bj.tolist()
        for lo, hi in runs:
            bi, bj = bi_[lo], bj_[lo]
            ca, cb, na, nb, sa, sb = (np.frombuffer(x[lo], np.int64) for x in sides)
            total = sum(np.frombuffer(c, np.int32) for c in counts[lo:hi]).reshape(len(ca), len(cb)).astype(np.int64)
            linked = 100 * total >= percent * (na[:, None] + nb[None, :] - total)
            if bi == bj:
                np.fill_diagonal(linked, False)
                links = {c: int(k) for c, k in zip(ca, linked @ sa)}
                both, adjacent = ca, linked
            else:
                links = {c: int(k) for c, k in zip(ca, linked @ sb)}
                links |= {c: int(k) for c, k in zip(cb, linked.T @ sa)}
                both = np.r_[ca, cb]
                adjacent = np.zeros((len(both), len(both)), bool)
                adjacent[: len(ca), len(ca) :] = linked
                adjacent[len(ca) :, : len(ca)] = linked.T
            label = _components(adjacent)
            out += [(c, both[k], links[c]) for c, k in zip(both, label) if links[c]]
        return pd.DataFrame(out, columns=["class", "centre", "links"])

    return run


def _known(id: str) -> Column:
    """Identifiers for comparisons: null comes after all others."""
    return F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_NO_ID))


def describe(docs: DataFrame, id: str, text: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """Stored (id, text_hash, class, n) per row of ``docs``, and the head of the global order."""
    c = F.col(f"`{text}`")
    rows = docs.select(_known(id).alias("id"), F.xxhash64(c).alias("text_hash"), c.alias("text"))
    schema = "id long, text_hash long, class long, n long, bitmap binary, token long, count long"
    found = stored(rows.mapInArrow(_describe(n), schema), "shingle-sets")
    counted = found.filter("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
    # stored first: so the tasks' own heads meet in a task and not on the driver
    top = stored(counted.orderBy(F.desc("count"), "token").limit(HEAD), "head")
    top = top.orderBy(F.desc("count"), "token").toPandas()["token"]
    token = top.to_numpy(np.int64).view(_U)
    place = np.arange(len(token), 0, -1).astype(_U)  # the most frequent last
    order = np.argsort(token)
    described = found.filter("token IS NULL").select("id", "text_hash", "class", "n", "bitmap")
    return described, np.stack([token[order], place[order]])


def _tasks(groups: DataFrame) -> DataFrame:
    """The tasks of each class of ``groups`` (class, component and more): one per bin of small groups,
    one per pair of blocks of a large one."""
    counts = groups.groupBy("component").agg(F.count("*").alias("m"))
    few = counts.agg(F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))), F.sum(F.col("m") * F.ceil(F.col("m") / BLOCK))).first()
    bins = max(1, math.ceil((few[0] or 0) / BLOCK))
    placed = groups.join(counts, "component").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("class"), "blocks")).otherwise(0).cast("int")
    placed = placed.withColumn("block", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    alone = F.pmod(F.xxhash64("component"), F.lit(bins))
    placed = placed.withColumn("task", F.when(F.col("blocks") > 1, F.xxhash64("component", "bi", "bj")).otherwise(alone))
    placed = placed.drop("m", "blocks", "other")
    return F.broadcast(placed) if (few[1] or 0) <= BROADCAST_ROWS else placed


def _apart(members: DataFrame) -> DataFrame:
    """The tasks of stars of three classes and more whose classes (star, class, label) are of several groups.

    In a task, ``odd`` classes, which are outside the star's largest group, meet those that are its ``own``. A star of
    many classes is cut into blocks, and each block meets each block of the odd ones in a task of its own.
    """
    counts = members.groupBy("star", "label").agg(F.count("*").alias("m")).groupBy("star").agg(
        F.sum("m").alias("r"), F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("labels")
    )
    counts = counts.filter("r > 2 AND labels > 1").select(
        "star",
        "r",
        F.col("most.label").alias("major"),
        F.ceil(F.col("r") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("r") - F.col("most.m")) / BLOCK).cast("int").alias("odd_blocks"),
    )
    counts = stored(counts, "apart")
    rows = counts.filter("blocks = 1 AND odd_blocks = 1").agg(F.sum("r")).first()[0] or 0
    placed = members.join(small(counts, BROADCAST_ROWS), "star")
    placed = placed.withColumn("minor", F.col("label") != F.col("major"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    placed = placed.withColumn("odd_block", F.pmod(F.xxhash64("class", F.lit(1)), "odd_blocks").cast("int"))
    own = placed.withColumn("bi", F.col("block")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)))
    own = own.withColumn("own", F.lit(True)).withColumn("odd", F.col("minor") & (F.col("bj") == F.col("odd_block")))
    more = placed.filter("minor AND blocks > 1").withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    more = more.filter("bi != block").withColumn("bj", F.col("odd_block"))
    more = more.withColumn("own", F.lit(False)).withColumn("odd", F.lit(True))
    alone = F.pmod(F.xxhash64("star"), F.lit(max(1, math.ceil(rows / BLOCK))))
    split = (F.col("blocks") > 1) | (F.col("odd_blocks") > 1)
    task = F.when(split, F.xxhash64("star", "bi", "bj")).otherwise(alone)
    return own.unionByName(more).select(
        task.alias("task"), F.col("star").alias("component"), "bi", "bj", "class", "label", "own", "odd"
    )


def candidates(texts: DataFrame, full: DataFrame, head: np.ndarray, n: int, percent: int) -> DataFrame:
    """Stored (class, component): groups of classes such that any two similar ones are in one group."""
    prefixes = texts.mapInArrow(_prefixes(n, percent, head), "token long, sizes long, class long")
    together = prefixes.repartition("token").sortWithinPartitions("token", "sizes", "class")
    stars = stored(together.mapInArrow(_stars(), "star long, class long, centre long"), "runs")
    met = small(stored(stars.select("class").distinct(), "met"), BROADCAST_ROWS)
    bits = full.join(met, "class", "left_semi").select("class", "n", "bitmap").dropDuplicates(["class"])
    bits = stored(bits, "bitmaps")
    pairs = stars.filter("class != centre").select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(bits.toDF(side, f"n_{side}", f"map_{side}"), side)
    links = components(pairs.mapInArrow(_near(percent), "a long, b long")).toDF("class", "label")
    links = stored(links, "candidates")
    label = F.coalesce("label", "class").alias("label")
    members = stored(stars.join(links, "class", "left").select("star", "class", label), "labelled")
    screened = bits.join(_apart(members), "class").groupBy("task").applyInPandas(_screen(percent), "a long, b long")
    return stored(components(links.toDF("a", "b").union(screened)).toDF("class", "component"), "screened")


def join(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85
) -> DataFrame:
    """(id, text_hash, component, n_shingles, component_id, n_links) for every row of ``docs``.

    Words are runs of characters other than white space, with A-Z in lower case; a document's set
    holds its distinct ``n``-word shingles (its whole sequence if it is shorter), and two rows link if
    their sets' intersection is at least ``percent`` % of their union. ``component_id`` is the smallest
    identifier that links reach; rows without words link with nothing and keep their own. Repeated
    rows are linked rows. A null identifier is never the smallest; a component of such rows alone has
    a null one. ``n_links`` counts the other rows that a row links with.
    """
    described, head = describe(docs, id, text, n)
    full = described.filter("n > 0")
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    groups = candidates(texts, full, head, n, percent)
    sizes = full.groupBy("class").agg(
        F.count("*").alias("size"), F.min("id").alias("min_id"), F.min(F.struct("id", "text_hash")).alias("one")
    )
    sizes = stored(sizes, "classes")
    members = stored(groups.join(sizes.select("class", "size", "one"), "class"), "members")
    # the texts of one document per class that has candidates
    wanted = members.select(F.col("one.id").alias("id"), F.col("one.text_hash").alias("text_hash")).distinct()
    wanted = small(stored(wanted, "wanted"), BROADCAST_ROWS)
    c = F.col(f"`{text}`")
    keyed = docs.select(_known(id).alias("i"), F.xxhash64(c).alias("h"), c.alias("text"))
    chosen = keyed.join(wanted, (F.col("i") == wanted["id"]) & (F.col("h") == wanted["text_hash"]), "left_semi")
    cut = chosen.select("text").mapInArrow(
        _fragments(n, head), "class long, n long, fragment int, tokens binary"
    )
    placed = _tasks(members.select("class", "component", "size"))
    blob = ", ".join(f"{x}_{s} binary" for x in ("class", "n", "size") for s in "ab")
    partial = cut.join(placed, "class").groupBy("task", "fragment").applyInPandas(
        _count, f"task long, component long, bi int, bj int, {blob}, counts binary"
    )
    linked = partial.groupBy("task").applyInPandas(_sum(percent), "class long, centre long, links long")
    linked = stored(linked, "links")
    whole = components(linked.select("class", "centre")).toDF("class", "component")
    number = linked.groupBy("class").agg(F.sum("links").alias("links"))
    classes = sizes.join(number, "class", "left").join(whole, "class", "left").select(
        "class",
        "min_id",
        F.coalesce("component", "class").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    classes = stored(classes, "linked-classes")
    least = classes.groupBy("component").agg(F.min("min_id").alias("component_id"))
    by_class = classes.join(least, "component").select("class", "component", "component_id", "n_links")
    joined = full.drop("bitmap").join(by_class, "class")
    empty = described.filter("n = 0").drop("bitmap").select(
        "*", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    name = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    return joined.unionByName(empty).select(
        name("id"), "text_hash", "component", F.col("n").alias("n_shingles"), name("component_id"), "n_links"
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with its smallest identifier.

    Rows without words all stay. Of repeated rows one stays; between rows that share the smallest
    identifier the one with the smallest text hash is taken, and a component without identifiers keeps one row too.
    """
    joined = stored(join(docs, id, text, n, percent).withColumn("id", _known("id")), "joined")
    full = joined.filter("n_shingles > 0")
    best = full.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("best"))
    times = full.groupBy("id", "text_hash").agg(F.count("*").alias("times"))
    chosen = best.select("best.*").join(times, ["id", "text_hash"])
    i, h, t = (free_name(docs, x) for x in ("kept_id", "kept_hash", "kept_times"))
    kept = small(stored(chosen.toDF(i, h, t), "kept"), BROADCAST_ROWS)
    c = F.col(f"`{text}`")
    names = [F.col(f"`{x}`") for x in docs.columns]
    found = docs.withColumn(i, _known(id)).withColumn(h, F.xxhash64(c)).join(kept, [i, h])
    once, often = found.filter(F.col(t) == 1), found.filter(F.col(t) > 1).dropDuplicates([i, h])
    wordless = docs.filter(~F.coalesce(c.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.select(*names).union(often.select(*names)).union(wordless)
