"""Operators on single texts against brute force: quality, PII, decontamination, languages."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.llm import decontaminate, language, pii, quality
from turnwise.llm import words as W
from turnwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c d e " * 30, "Überall: 3 % | x & y!\n\nÜberall: 3 % | x & y!\n", "x y z \U0001f600"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with odd texts, repeated rows and columns that clash with the operators' own."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150).collect()]
    rows += [(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, ODD[4], "en", "s", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("quality", "votes", "stats", "pii", "found", "hash_a", "words"):
        df = df.withColumn(c, F.lit(c))
    return df


def split(text):
    return WORD.findall(text or "")


# words


def test_words_match_a_regular_expression():
    texts = [*ODD, "\x0bé\x0cé ", "A" * 5000, "tail\r"]
    w = W.split_words(pa.array(texts, pa.string()), lower_ascii=True)
    got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    assert got == [[lower(x) for x in split(t)] for t in texts]
    known = {}
    for word, h in zip((x for t in got for x in t), w.hash.tolist()):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_chunks_cover_all_rows_once():
    batch = pa.record_batch([pa.array(range(7)), pa.array(["x" * k for k in (0, 9, 1, 30, 0, 2, 2)])], names=["i", "text"])
    parts = list(W.chunks(batch, "text", 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7)) and len(parts) > 2


# quality


def base_statistics(text):
    t, w = text or "", split(text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_base_failures(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rated = quality.rate(docs, keep=["text", "quality"])
    assert rated.columns == ["text", "quality", "_quality"]
    rows = rated.collect()
    assert len(rows) == docs.count()
    for r in rows:
        s = r._quality.stats
        assert tuple(s[n] for n in names) == base_statistics(r.text)
        assert r._quality.base_failed == (s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words)
        assert not (r._quality.base_failed and r._quality.kept)


def test_posteriors_match_the_same_iteration_in_python(spark):
    patterns = {(1, 1, 0): 50, (1, -1, 1): 4, (-1, -1, -1): 9, (0, 0, 0): 3, (1, 1, 1): 70, (-1, 1, 0): 6}
    df = spark.createDataFrame([(list(k), v) for k, v in patterns.items()], "votes array<int>, n long")
    got = {tuple(r.votes): r.quality for r in quality.posteriors(df, 3).collect()}
    prior, good, bad = quality.PRIOR, [quality.START_GOOD] * 3, [quality.START_BAD] * 3

    def posterior(v):
        x = np.log(prior / (1 - prior))
        for j, k in enumerate(v):
            x += {1: np.log(good[j] / (1 - bad[j])), -1: np.log((1 - good[j]) / bad[j]), 0: 0}[k]
        return 1 / (1 + np.exp(-x))

    for _ in range(quality.ITERATIONS):
        q = {v: posterior(v) for v in patterns}
        k = quality.PSEUDO
        total = sum(patterns.values())
        p = (sum(n * q[v] for v, n in patterns.items()) + k * quality.PRIOR) / (total + k)
        for j in range(3):
            up = sum(n * q[v] for v, n in patterns.items() if v[j] == 1)
            down = sum(n * q[v] for v, n in patterns.items() if v[j] == -1)
            bad_up = sum(n * (1 - q[v]) for v, n in patterns.items() if v[j] == 1)
            bad_down = sum(n * (1 - q[v]) for v, n in patterns.items() if v[j] == -1)
            good[j] = min(0.995, max(0.7, (up + k * quality.START_GOOD) / (up + down + k)))
            b = (bad_down + k * quality.START_BAD) / (bad_up + bad_down + k)
            bad[j] = min(0.99, max(0.05, b, 2 * (1 - good[j])))
        prior = min(0.95, max(0.5, p))
    assert got == pytest.approx({v: posterior(v) for v in patterns}, abs=1e-9)


def test_verdicts_agree_with_labels(spark):
    verdict = {r.doc_id: r for r in QUERIES["op8_weak_supervision"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    bad = [r.doc_id for r in labels if r.quality == 0 and verdict[r.doc_id].kept]
    good = [r.doc_id for r in labels if r.quality == 1 and not verdict[r.doc_id].kept and not verdict[r.doc_id].base_failed]
    assert len(bad) <= 1 and len(good) <= 3


def test_quality_stage_keeps_columns_and_takes_empty_tables(docs):
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.limit(0)).count() == 0


# PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def contract_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1]))
        out += [("card", *m.span())] * (13 <= len(d) <= 19 and s % 10 == 0)
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(3)
    letters = list("aZ09.%+-@ @..  ()é\n12345")
    for _ in range(20_000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii.base_spans(t) == contract_spans(t)
    card = "card 4111 1111-1111 1111, 4111111111111112, +1 (555) 010-0199; 0.0.0.256 1.2.3.4.5.6.7.8"
    assert pii.base_spans(card) == contract_spans(card)


def test_long_runs_take_linear_time():
    text = "a" * 200_000 + "!@b " + "1" * 200_000 + " " + "1." * 100_000
    pii.label_texts([text], pii.fit([]))


def test_distant_repeats_share_labels():
    text = "mail a@b.co, phone +1 (555) 555-0123 today. " + "word " * 50 + "Ask 4111111111111111 or 555-0123."
    known = [f"mail u{i}@b.co and phone +1 (555) {100 + i}-{1000 + 7 * i} on day {i} of it" for i in range(80)]
    model = pii.fit(known)
    spans = pii.label_texts([text], model)[0][1]
    assert ("phone", text.index("555-0123."), text.index("555-0123.") + 8) in spans
    assert set(contract_spans(text)) <= set(spans)
    assert "555" not in pii.redact(text, spans)


def test_beliefs_are_exact_on_a_chain():
    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    model = {"unary": rng.normal(size=(pii.FEATURES, k)), "pair": rng.normal(size=(3, k, k))}
    features = rng.integers(0, pii.FEATURES, (3, 7))
    edges = np.array([[0, 1, 0], [1, 2, 0]])
    u = model["unary"][features].sum(1)
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2] + model["pair"][0][:, :, None] + model["pair"][0][None])
    joint /= joint.sum()
    got = pii.beliefs(model, features, np.full(3, -1), edges)
    assert np.allclose(got[0], joint.sum((1, 2)), atol=2e-2) and np.allclose(got[2], joint.sum((0, 1)), atol=2e-2)


def test_one_clear_mention_settles_all_others():
    text = "call 555-0123 now. " + "then ask for 555-0123 again. " * 50
    g = pii.graph(text, [("phone", 5, 13)])
    model = {"unary": np.zeros((pii.FEATURES + 1, len(pii.LABELS))), "pair": np.stack([w * np.eye(len(pii.LABELS)) for w in (0, 4, 0.3)])}
    p = pii.beliefs(model, *pii._stack([g]))[: len(g.spans), pii.LABELS.index("phone")]
    assert len(p) == 51 and p[1:].min() > 0.85 and np.ptp(p[1:]) < 1e-2
    spans = pii.label_texts(["no digits", text + " +1 (555) 555-0123", "x 9 y 9"], model)[1][1]
    assert len(spans) >= 1
    chain = np.array([[i, i + 1, 1] for i in range(60)])
    one = np.array([2] + [-1] * 60)
    got = pii.beliefs(model, np.full((61, 7), pii.FEATURES), one, chain)[:, 2]
    e = np.exp(4)
    assert np.allclose(got, 0.2 + 0.8 * ((e - 1) / (e + 4)) ** np.arange(61), atol=1e-2)


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 40)
    texts = ["call 555-0123"] * 500 + [f"call 555-{i}" for i in range(30)]
    got = pii.sample_texts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(got) == sorted(set(texts))


def test_pii_stage(docs):
    found = pii.find(docs)
    assert found.columns == [*docs.columns, "_pii"]
    for r in found.collect():
        assert [r._pii[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in contract_spans(r.text or "")) for k in pii.KINDS]
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert out.filter("text rlike '@[a-z0-9]+[.]example'").count() == 0
    assert pii.redacted(docs.limit(0)).count() == 0


# decontamination


def test_template_words(spark):
    text = "The shop sold 12kg of apples to Maria Lopez, for $3.50, then Bob drove 5 miles."
    got = spark.createDataFrame([(text,)], "t string").select(decontaminate.template_words(F.col("t")).alias("w")).first().w
    n, a, u = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    assert got == ["the", "shop", "sold", f"{n}12{u}kg", "of", "apples", "to", f"{a}maria", f"{a}lopez", "for", f"{n}350", "then", f"{a}bob", "drove", f"{n}5", f"{u}miles"]


def test_replaced_values_must_be_consistent(spark):
    item = "If Maria has 12 apples and gives 5 kg of them to John while Maria keeps 12 of the rest, how many does John get?"
    same = "So. If Petra has 77 apples and gives 9 kg of them to Paul while Petra keeps 77 of the rest, how many does Paul get?"
    other = "So. If Petra has 77 apples and gives 9 kg of them to Paul while Bert keeps 78 of the rest, how many does Kim get?"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    rows = [(1, same), (2, other), (3, item), (4, None), (5, ""), (6, item), (None, item)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.matches(texts, items, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 1), ("3", 1), ("6", 1), ("None", 1)]
    assert {r.doc_id for r in decontaminate.clean(texts, items).collect()} == {2, 4, 5}
    assert decontaminate.clean(texts, items.limit(0)).count() == 7
    assert decontaminate.clean(texts.limit(0), items).count() == 0


def test_planted_items_are_found(spark, docs):
    folder = "/root/testdata/sf0.01"
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = spark.read.parquet(f"{folder}/documents.parquet").collect()
    planted = {r.doc_id for r in texts if r.text and any(i in r.text for i in items)}
    got = {r.doc_id for r in QUERIES["op3_template_decontamination"](spark, folder).collect()}
    assert planted and got == planted
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.clean(docs, benchmark).columns == docs.columns


LONG_ITEM = (
    "in the morning the baker near the old bridge fills three baskets with fresh rolls for Mary and then carries 1000 grams of "
    "flour back to the mill where his brother waits until noon before both of them walk home to count what is left"
)


def found(spark, items, texts):
    """(text number, item number) of the matches."""
    a = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.matches(b, a, ["doc_id"]).collect()}


def test_inserted_words_long_names_and_half_items_are_found(spark):
    split_at = LONG_ITEM.split()
    inserted = " ".join([*split_at[:14], "quickly", *split_at[14:28], "again", *split_at[28:]])
    renamed = LONG_ITEM.replace("Mary", "Mary Ann Smith").replace("1000 grams", "1 000 kg")
    half = "we saw that " + " ".join(split_at[: len(split_at) // 2]) + " and nothing else happened here today"
    copies = LONG_ITEM + " so " + LONG_ITEM.replace("Mary", "Paul")
    few = "they say that " + " ".join(split_at[:9]) + " and nothing else happened here today at all"
    texts = [inserted, renamed, half, copies, few, "the mill and the old bridge and the baker near the noon"]
    assert found(spark, [LONG_ITEM], texts) == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_names_that_begin_sentences_are_slots(spark):
    item = (
        "Natalia sold 48 clips to her friends in the town. Maria bought 24 clips at the market near the river. "
        "Tom paid for all of them with coins from the jar. Natalia gave half of the coins to the school."
    )
    other = item.replace("Natalia", "Petra").replace("Maria", "Ann Lee").replace("Tom", "Bo").replace("48", "70")
    spaced = other.replace(". ", ".\r\n").replace(" Bo", '  "Bo')
    texts = [item, other, "They say: " + spaced, other.replace("Petra gave", "Kim gave").replace("Tom", "Kim")]
    assert {(0, 0), (1, 0), (2, 0)} <= found(spark, [item], texts)


def test_items_without_windows_are_found_as_they_stand(spark):
    sums = "12 + 7 = 19 and 3 * 4 = 12 and 5 kg + 2 kg = 7 kg and 1 - 1 = 0"
    items = ["Who wrote Faust?", sums, "Der Hund, die Katze und das Pferd, Esel, Huhn, Hahn im Stall", "Why?", " ", None]
    texts = [f"So: {i} Then it ends." for i in items[:3]]
    texts += ["who wrote", sums.replace("19", "20"), "He asked (why?), and left.", sums.replace("12 + 7", "12 - 7"), None, " "]
    assert found(spark, items, texts) == {(0, 0), (1, 1), (2, 2), (5, 3)}


# languages


@pytest.mark.parametrize("few", [16, 0])
def test_messages_in_blocks_equal_those_from_end_to_end(monkeypatch, few):
    """In blocks, and step by step as with many languages."""
    monkeypatch.setattr(language, "FEW_LABELS", few)
    rng = np.random.default_rng(0)
    w = W.split_words(pa.array(["a b c d e", "x", "", "p q " * 90], pa.string()))
    score, step = rng.normal(size=(len(w.row), 3)).astype(np.float32), rng.normal(size=(3, 3))
    got, pairs = language.Chains(w).marginals(score, step)
    for a, b in zip(w.first, w.first[1:]):
        e, t = np.exp(score[a:b].astype(float)), np.exp(step)
        forward, back = [e[0]] if b > a else [], [np.ones(3)]
        for i in range(1, b - a):
            forward.append((forward[-1] @ t) * e[i])
            forward[-1] /= forward[-1].sum()
        for i in range(b - a - 2, -1, -1):
            back.insert(0, t @ (e[i + 1] * back[0]))
            back[0] /= back[0].sum()
        if b > a:
            p = np.array(forward) * np.array(back)
            assert np.allclose(got[a:b], p / p.sum(1, keepdims=True), atol=1e-4)
    assert pairs.sum() == pytest.approx(4 + 179, abs=1e-3)


def test_held_out_accuracy_and_odd_texts(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op5_language_crf"](spark, folder).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_languages_of_odd_and_mixed_texts(spark, docs):
    got = language.identify(docs, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (10_000, 10_001, 10_002)} == {"und"}
    nothing = language.identify(docs, F.lit(False)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]
    assert language.identify(docs.limit(0), F.lit(True)).count() == 0
    english, german = ("the and of with that this from are was for " * 3, "der die und nicht ist mit auf ein sich von " * 3)
    model = language.fit([english, german], [0, 1], 2)
    w, p = language.label_words(pa.array([english + german]), model)
    best = p.argmax(1)
    assert (best[:25] == 0).all() and (best[-25:] == 1).all()


def invented(rng, letters, n):
    """Words of syllables of a few letters: a language of its own."""
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n))


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(8)
    rows = [(i, invented(rng, "abcde", 60), "short") for i in range(30)] + [(100 + i, invented(rng, "vwxyz", 9_000), "long") for i in range(6)]
    assert all(len(t) > 45_000 for _, t, k in rows if k == "long")
    asked = [(200, invented(rng, "vwxyz", 40), None), (201, invented(rng, "abcde", 9_000), None)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, F.lit(True)).collect()}
    assert (got[200], got[201]) == ("long", "short")


def test_a_hundred_languages_are_learned(spark):
    rng = random.Random(9)
    alphabets = [rng.sample("abcdefghijklmnopqrstuvwxyz", 4) for _ in range(100)]
    rows = [(k * 100 + i, invented(rng, letters, 40), f"l{k}") for k, letters in enumerate(alphabets) for i in range(4)]
    asked = [(10**6 + k, invented(rng, letters, 80), None) for k, letters in enumerate(alphabets)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, F.lit(True)).filter("doc_id >= 1000000").collect()}
    assert sum(got[10**6 + k] == f"l{k}" for k in range(100)) >= 90
