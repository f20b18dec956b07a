"""Runs of repeated words against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from turnwise.llm import periodic, words
from turnwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, length, period) of all runs, by comparing the text with itself at every distance."""
    ids = {}
    x = np.array([ids.setdefault(v, len(ids)) for v in w])
    found = {}
    for q in range(1, len(x) // 2 + 1):
        equal = np.zeros(len(x) - q + 2, np.int8)
        equal[1:-1] = x[q:] == x[:-q]
        edge = np.flatnonzero(np.diff(equal))
        for a, b in zip(edge[::2].tolist(), (edge[1::2] + q).tolist()):
            if b - a >= max(12, 2 * q):
                found.setdefault((a, b), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def text_of(rng):
    """Random words of few kinds, planted periods, nested periods, Fibonacci and Thue-Morse words."""
    n = rng.choice([5, 12, 30, 100, 200, 500, 900])
    kind = rng.randrange(6)
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 5, 1000]))}" for _ in range(n)]
    if kind == 1:
        p, a = rng.randint(1, max(1, n // 2)), rng.randrange(n)
        w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else x for i, x in enumerate(w)]
    elif kind == 2:
        w = ["a", "b"]
        while len(w) < n:
            w = w * rng.randint(1, 5) + w[: rng.randint(0, len(w))]
            w += w[::-1] * (rng.random() < 0.3)
    elif kind == 3:
        short, w = ["a"], ["a", "b"]
        while len(w) < n:
            short, w = w, w + short
    elif kind == 4:  # runs of period two that touch: squares of every odd length around their seam
        m = rng.randint(1, 60)
        w = (["a", "b"] * m + ["a"] + ["a", "b"] * rng.randint(max(m - 2, 0), m + 3) + ["a"]) * rng.randint(1, 4)
        w = [rng.choice("ab"), *w, "c", *w] if rng.random() < 0.5 else w
    elif kind == 5:
        w = ["0"]
        while len(w) < n:
            w = w + ["1" if x == "0" else "0" for x in w]
    return w


def found_runs(texts):
    found = periodic.find_runs(words.split_words(pa.array([" ".join(t) for t in texts], pa.string())))
    out = [[] for _ in texts]
    for row, *run in zip(*(x.tolist() for x in found)):
        out[row].append(tuple(run))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_many_kinds_of_texts(seed):
    rng = random.Random(seed)
    texts = [text_of(rng) for _ in range(150)]
    assert found_runs(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("scale", [32, 64, 128, 256])
def test_periods_at_the_edges_of_scales(scale):
    rng = random.Random(scale)
    texts = []
    for q in (scale - 1, scale, scale + 1, 2 * scale - 1):
        for extra in (0, 1, q // 2):
            block = [f"v{rng.randrange(3)}" for _ in range(q)]
            texts.append([f"x{rng.random()}", *(block * 3)[: 2 * q + extra], f"y{rng.random()}"])
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_a_very_long_text_of_one_word_and_one_of_touching_runs():
    one = ["a"] * 300_000
    seam = ["a", "b"] * 3_000 + ["a"] + ["a", "b"] * 3_000
    got = found_runs([one, seam])
    assert got[0] == [(0, 300_000, 1)]
    assert got[1] == brute_runs(seam)


def test_odd_rows_keep_their_place(spark):
    w = ["x", *["a", "b", "c"] * 5, "z"]
    rows = [(1, " ".join(w)), (1, " ".join(w)), (None, "a " * 11), (None, "\t a\n" * 12), (2, None), (3, ""), (4, " \n ")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, start string")
    got = sorted(periodic.collapse(docs).collect(), key=repr)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == len(rows)
    r = by[1, 17]
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) == (1, 1, 15, 3, 5000, "x a b c z")
    assert r.runs_sha256 == sha("1,15,3\n") and r.collapsed_sha256 == sha(r.collapsed)
    assert (by[None, 11].n_runs, by[None, 11].length) == (0, None)
    assert (by[None, 12].n_runs, by[None, 12].collapsed, by[None, 12].n_dropped) == (1, "a", 11)
    for i in (2, 3, 4):
        assert (by[i, 0].n_runs, by[i, 0].collapsed_sha256, by[i, 0].runs_sha256) == (0, sha(""), sha(""))
    assert periodic.collapse(docs.limit(0)).count() == 0
    assert sorted(map(tuple, periodic.runs(docs).collect()), key=repr) == [(1, 1, 15, 3), (1, 1, 15, 3), (None, 0, 12, 1)]


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    planted = 0
    for d in docs:
        w = WORD.findall(d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            n = len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            planted += 1
        runs, r = brute_runs(w), rows[d.doc_id]
        assert (r.n_words, r.n_runs) == (len(w), len(runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
    assert planted > 5
