"""Greedy near-duplicate groups against the sequential rule."""

import random
import re

import pytest

from turnwise.operators import similarity
from turnwise.operators.similarity import near_duplicates


def sequential(rows, threshold):
    groups = []
    for rid, role, scope, _, text in sorted(rows, key=lambda r: r[3]):
        words = {w for w in re.split(r"\W+", text.lower()) if w}
        for g in groups:
            if g[0] != (role, scope):
                continue
            union = g[1] | words
            if union and len(g[1] & words) / len(union) >= threshold:
                g[2].append(rid)
                break
        else:
            groups.append(((role, scope), words, [rid]))
    return {(g[2][0], m) for g in groups if len(g[2]) > 1 for m in g[2]}


@pytest.mark.parametrize("threshold,width", [(0.5, 1), (0.6, 32), (0.8, 2), (1.0, 4)])
def test_groups_equal_the_sequential_rule(spark, threshold, width):
    rng = random.Random(int(threshold * 100) + width)
    rows = []
    for i in range(90):
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[4].split()
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = f"w{rng.randrange(12)}"
            text = " ".join(base)
        else:
            text = " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 9)))
        rows.append((i, "r", f"s{i % 2}", i * 3, text))
    rows += [(100 + i, "r", "s0", 1000 + i, rows[4][4].upper() + "!") for i in range(20)]
    rows += [(200, "r", "s0", 2000, "?!"), (201, "r", "s0", 2001, "...")]
    df = spark.createDataFrame(rows, "row_id long, role string, scope string, ord long, text string")
    got = {(r.primary, r.row_id) for r in near_duplicates(df, threshold, width).collect()}
    assert got == sequential(rows, threshold)


def test_long_sets_with_rare_common_words(spark):
    """Sets of up to 1,600 words whose similarity lies about the threshold, and unlike sets that share words all the same."""
    rng = random.Random(5)
    rows = []
    for i in range(24):
        n = rng.choice([40, 90, 400, 1600])
        base = [f"w{x}" for x in rng.sample(range(4000), n)]
        rows.append((len(rows), "r", "s", len(rows), " ".join(base)))
        for share in (0.08, 0.1, 0.11, 0.112, 0.12, 0.2):
            near = base[:]
            for at in rng.sample(range(n), round(n * share)):
                near[at] = f"w{rng.randrange(4000)}"
            rows.append((len(rows), "r", "s", len(rows), " ".join(near)))
    df = spark.createDataFrame(rows, "row_id long, role string, scope string, ord long, text string")
    got = {(r.primary, r.row_id) for r in near_duplicates(df, 0.8).collect()}
    assert got == sequential(rows, 0.8) and len(got) > 60


def test_words_of_unlike_sets_are_not_compared(spark, monkeypatch):
    """All sets of one bucket share its word; the words of none are moved to compare them."""
    rng = random.Random(6)
    rows = [(i, "r", "s", i, " ".join(f"w{x}" for x in rng.sample(range(120), 60))) for i in range(200)]
    rows.append((200, "r", "s", 200, rows[7][4] + " x"))
    seen, cut = [], similarity.cut_lineage

    def counted(df, name="step"):
        out = cut(df, name)
        if name == "met":
            seen.append(out.count())
        return out

    monkeypatch.setattr(similarity, "cut_lineage", counted)
    df = spark.createDataFrame(rows, "row_id long, role string, scope string, ord long, text string")
    got = {(r.primary, r.row_id) for r in near_duplicates(df, 0.8).collect()}
    assert got == {(7, 7), (7, 200)}
    assert seen and max(seen) <= 20
