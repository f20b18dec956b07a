"""Personal data by patterns and a skip-chain conditional random field.

Patterns find addresses, numbers and cards exactly (the base). The field then labels every other
word that holds a digit or ``@``; a word without either can carry no label but "none", which cuts
the chain there and keeps the graph small. Neighbouring words share a chain potential. All mentions
of one word are linked to a hub of that word by a "same" potential, and the words of one shape (or
their hubs) to a hub of the shape by a "similar" potential, however far apart, so that the graph stays
linear in the document and two mentions of a word are two links apart. Loopy
message passing runs over all graphs
of a batch at once. Base spans are observed labels, which is how one clear mention settles an
unclear one elsewhere in the document. Weights are fitted by pseudo-likelihood, with the base
spans as labels, on a bounded sample of documents (``SAMPLE_DOCS`` of at most ``SAMPLE_CHARS``
characters, those with the smallest text hash); all documents are labelled.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 20_000
FEATURES = 1 << 12
#: Rounds of messages in a graph: so many, and one per node, unless it converges before.
ROUNDS = 50
DAMPING = 0.5
MIN_BELIEF = 0.5
CHAIN, SAME, SIMILAR = range(3)
#: Where the weights of equal labels start and what they are drawn to: a sample may hold no repeats.
PRIOR_LINKS = (0.0, 1.5, 0.3)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match of the contract's pattern can only begin where a run of digits begins.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    """Leftmost matches of local@domain, in one pass: each ``@`` looks back over its own run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by the patterns, by kind as in ``KINDS`` and then by start."""
    out = [("email", *s) for s in _emails(text)]
    if not re.search("[0-9]", text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _features(word: str, before: str, after: str) -> list[int]:
    shape = re.sub("[^\x00-\x7f]", "u", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", word))))
    digits = shape.count("9")
    names = (
        "bias",
        "s" + shape,
        "c" + re.sub(r"(.)\1+", r"\1", shape),
        f"n{min(digits, 20)}",
        f"d{word.count('.')}{'@' in word}{'+' in word}{'-' in word}",
        "b" + before.lower().strip(".,:;()"),
        "a" + after.lower().strip(".,:;()"),
    )
    return [zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in names]


@dataclass
class Graph:
    """The words of one text that may carry a label, then the hubs, and the links."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    edges: list[tuple[int, int, int]]
    observed: list[int]
    members: list[list[int]]


def graph(text: str, base: list[tuple[str, int, int]]) -> Graph:
    g = Graph([], [], [], [], [])
    if not _HINT.search(text):
        return g
    owner = sorted((s, e, LABELS.index(k)) for k, s, e in base)
    same: dict[str, list[int]] = {}
    shape_of: dict[str, str] = {}
    found = list(_WORD.finditer(text))
    last, at = -2, 0
    for i, m in enumerate(found):
        if not _HINT.search(m[0]):
            continue
        start, end = m.span()
        while start < end - 1 and text[start] in "\"'([{<*#$%&":
            start += 1
        while end > start + 1 and text[end - 1] in "\"')]}>.,;:!?*#$%&":
            end -= 1
        while at < len(owner) and owner[at][1] <= start:
            at += 1
        hit = at < len(owner) and owner[at][0] < end
        node = len(g.spans)
        word = text[start:end]
        g.spans.append((start, end))
        g.observed.append(owner[at][2] if hit else -1)
        before = found[i - 1][0] if i else ""
        after = found[i + 1][0] if i + 1 < len(found) else ""
        g.features.append(_features(word, before[:40], after[:40]))
        if last == i - 1:
            g.edges.append((node - 1, node, CHAIN))
        key, shape = re.sub(r"[^0-9a-z@]", "", word.lower()), re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", word))
        same.setdefault(key, []).append(node)
        shape_of.setdefault(key, shape)
        last = i

    def hub(ends: list[int], kind: int, members: list[int]) -> int:
        node = len(g.spans) + len(g.members)
        g.edges += [(node, e, kind) for e in ends]
        g.members.append(members)
        return node

    similar: dict[str, list[tuple[int, str]]] = {}
    for key, nodes in same.items():
        end = hub(nodes, SAME, nodes) if len(nodes) > 1 else nodes[0]
        similar.setdefault(shape_of[key], []).append((end, key))
    for ends in similar.values():
        if len(ends) > 1:
            hub([e for e, _ in ends], SIMILAR, [n for _, key in ends for n in same[key]])
    return g


def _stack(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (those of a hub are ``FEATURES``, which has no weight), observed labels, links, and the graph of each node."""
    size = [len(g.spans) + len(g.members) for g in graphs]
    at = np.cumsum([0, *size])
    features = np.array([f for g in graphs for f in [*g.features, *([[FEATURES] * 7] * len(g.members))]], np.int64).reshape(-1, 7)
    observed = np.array([o for g in graphs for o in [*g.observed, *([-1] * len(g.members))]], np.int64)
    edges = [(i + a, j + a, t) for g, a in zip(graphs, at) for i, j, t in g.edges]
    return features, observed, np.array(edges, np.int64).reshape(-1, 3), np.repeat(np.arange(len(graphs)), size)


def _hub_labels(g: Graph) -> list[int]:
    """The most frequent label of each hub's members, the smallest of several."""
    counts = (np.bincount(np.maximum([g.observed[n] for n in m], 0), minlength=len(LABELS)) for m in g.members)
    return [int(c.argmax()) for c in counts]


def fit(texts: list[str], steps: int = 150, rate: float = 0.5, l2: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights by pseudo-likelihood: each label given its features and its neighbours' labels."""
    k = len(LABELS)
    prior = {"unary": np.zeros((FEATURES + 1, k)), "pair": np.stack([w * np.eye(k) for w in PRIOR_LINKS])}
    model = {name: w.copy() for name, w in prior.items()}
    graphs = [graph(t, base_spans(t)) for t in texts]
    features, _, edges, _ = _stack(graphs)
    if not len(features):
        return model
    label = np.array([x for g in graphs for x in [*np.maximum(g.observed, 0), *_hub_labels(g)]], np.int64)
    truth = np.eye(k)[label]
    src, dst, kind = edges.T
    speed = {x: np.zeros_like(v) for x, v in model.items()}
    scale = np.sqrt(np.bincount(features.ravel(), minlength=FEATURES + 1) / len(features) + 1e-3)[:, None]
    for _ in range(steps):
        logit = model["unary"][features].sum(1)
        np.add.at(logit, dst, model["pair"][kind, label[src]])
        np.add.at(logit, src, model["pair"][kind, :, label[dst]])
        p = np.exp(logit - logit.max(1, keepdims=True))
        gap = (truth - p / p.sum(1, keepdims=True)) / len(features)
        unary = np.stack([np.bincount(features.ravel(), np.repeat(gap[:, c], 7), FEATURES + 1) for c in range(k)], 1)
        unary[FEATURES] = 0
        pair = np.zeros((3, k, k))
        np.add.at(pair, (kind, label[src]), gap[dst])
        back = np.zeros((3, k, k))
        np.add.at(back, (kind, label[dst]), gap[src])
        pair += back.transpose(0, 2, 1)
        pair[1:] = (pair[1:] + pair[1:].transpose(0, 2, 1)) / 2  # skip links have no direction
        for name, grad in (("unary", unary / scale), ("pair", pair)):
            speed[name] = 0.9 * speed[name] + grad - l2 * (model[name] - prior[name])
            model[name] = model[name] + rate * speed[name]
    return model


def beliefs(
    model: dict[str, np.ndarray], features: np.ndarray, observed: np.ndarray, edges: np.ndarray, owner: np.ndarray | None = None
) -> np.ndarray:
    """Label probabilities of every node by damped loopy message passing.

    ``owner`` is the graph of each node (one graph for all by default). Each graph has its messages
    until they converge, for at most ``ROUNDS`` rounds and one per node.
    """
    unary = model["unary"][features].sum(1)
    seen = observed >= 0
    unary[seen] = -30.0
    unary[seen, observed[seen]] = 0.0
    owner = np.zeros(len(features), np.int64) if owner is None else owner
    if len(edges):
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([model["pair"][edges[:, 2]], model["pair"][edges[:, 2]].transpose(0, 2, 1)])
        back = np.roll(np.arange(len(src)), len(edges))
        message = np.zeros((len(src), unary.shape[1]))
        bound = ROUNDS + np.bincount(owner)
        live, done = np.arange(len(src)), 0
        while len(live):
            done += 1
            nodes, at = np.unique(dst[live], return_inverse=True)
            total = unary[nodes]
            np.add.at(total, at, message[live])
            total = total[np.searchsorted(nodes, src[live])]
            out = (total - message[back[live]])[:, :, None] + pair[live]
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            old = message[live]
            message[live] = DAMPING * old + (1 - DAMPING) * new
            moved = np.zeros(len(bound), bool)
            moved[owner[dst[live]][np.abs(message[live] - old).max(1) >= 1e-4]] = True
            live = live[(moved & (done < bound))[owner[dst[live]]]]
        np.add.at(unary, dst, message)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _added(text: str, g: Graph, p: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of words labelled by the field, neighbours of one kind joined, none over a base span."""
    out: list[tuple[str, int, int]] = []
    best = p.argmax(1)
    for i, (start, end) in enumerate(g.spans):
        if g.observed[i] >= 0 or best[i] == 0 or p[i, best[i]] < MIN_BELIEF:
            continue
        kind = LABELS[best[i]]
        if out and out[-1][0] == kind and text[out[-1][2] : start].strip() == "" and i and g.observed[i - 1] < 0:
            out[-1] = (kind, out[-1][1], end)
        else:
            out.append((kind, start, end))
    return out


def label_texts(texts: list[str], model: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    graphs = [graph(t, b) for t, b in zip(texts, base)]
    features, observed, edges, owner = _stack(graphs)
    p = beliefs(model, features, observed, edges, owner) if len(features) else None
    out, at = [], 0
    for t, b, g in zip(texts, base, graphs):
        n = len(g.spans)
        extra = _added(t, g, p[at : at + n], b) if n else []
        at += n + len(g.members)
        out.append((b, sorted(b + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by ``[KIND]``; overlapping spans become one, of the first kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


_RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans", "redacted")]
)


def sample_texts(docs: DataFrame, text: str = "text") -> list[str]:
    """The bounded sample of distinct texts that the field is fitted on, the same on every run.

    Hashes below a bound that about twice the sample falls under are taken first, so that no task
    sends the driver a whole sample of its own.
    """
    c = F.col(f"`{text}`")
    eligible = docs.filter(c.rlike("[0-9@]") & (F.length(c) <= SAMPLE_CHARS)).select(c.alias("text"))
    hashed = eligible.withColumn("hash", F.xxhash64("text"))
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, hashed.select("hash").distinct().count()))
    drawn = hashed.filter(F.pmod("hash", F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    each = drawn.groupBy("hash").agg(F.min("text").alias("text"))
    return [r.text for r in each.orderBy("hash").limit(SAMPLE_DOCS).collect()]


def find(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` and a struct ``pii``: counts of base spans, their hash, all spans, the redacted text.

    A null or empty text has no spans; its redacted text is null or empty as before. Equal texts get
    equal results. If ``docs`` has a column ``pii``, the struct is called ``_pii``. Texts without a
    digit or ``@`` can't hold a span and don't go to Python. An empty table gives an empty one.
    """
    model = fit(sample_texts(docs, text))
    model = {k: v.astype(np.float32) for k, v in model.items()}

    @F.pandas_udf(_RESULT)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(column), 500):  # messages of few documents at a time
            texts = [t or "" for t in column.iloc[at : at + 500]]
            for t, (base, spans) in zip(texts, label_texts(texts, model)):
                n = [sum(k == b[0] for b in base) for k in KINDS]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*n, digest, joined(spans), redact(t, spans) if with_text else None))
        return pd.DataFrame(rows, columns=_RESULT.names)

    c = F.col(f"`{text}`")
    nothing = F.struct(
        *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("base_sha256"),
        F.lit("").alias("spans"),
        F.lit(None).cast("string").alias("redacted"),
    )
    hinted = F.coalesce(c.rlike("[0-9@]"), F.lit(False))
    name, raw = free_name(docs, "pii"), free_name(docs, "found")
    ran = docs.withColumn(raw, run(F.when(hinted, c)))
    return ran.withColumn(name, F.when(hinted, F.col(raw)).otherwise(nothing)).drop(raw)


def redacted(docs: DataFrame, text: str = "text", count: str | None = "n_chars") -> DataFrame:
    """``docs`` with the spans of every text replaced, and the column ``count`` brought up to date."""
    found = find(docs, text)
    result = F.col(f"`{found.columns[-1]}`.redacted")
    new = F.coalesce(result, F.col(f"`{text}`"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(new.alias(c))
        elif c == count and text != count:
            out.append(F.length(new).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return found.select(*out)
