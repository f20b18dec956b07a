"""Operators on whole tables against brute force: joins, substrings, packing, shards, archives, calls."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.llm import jaccard, packing, sharding, substrings, toolcalls, warc
from turnwise.llm.components import components
from turnwise.llm.queries import QUERIES, TOOLS, tool_traffic

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NO_ID = (1 << 63) - 1


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, near copies of one, shared passages, odd and repeated rows, and clashing columns."""
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120).collect()]
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    for i in range(90):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randint(0, 119)] = f"x{rng.randint(0, 9)}"
        rows.append((10**6 + i, " ".join(near)))
    for i in range(50):
        a, n = rng.randint(0, 90), rng.randint(15, 60)
        own = [f"r{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        rows.append((2 * 10**6 + i, " ".join(own + base[a : a + n] + own[::-1] + base[a : a + n] * (i % 5 == 0))))
    odd = [None, "", " \n ", "One two", "one  TWO", "one", "one two three four", "a " * 100, "a " * 100, "b " * 19]
    rows += [(3 * 10**6 + i, t) for i, t in enumerate(odd)]
    rows += [(None, "zz yy")] * 2 + [(None, "one two three four"), (None, " ".join(base)), (10**6 + 3, " ".join(base[:100]))]
    rows += [(10**6 + 3, " ".join(base[:100]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("component", "token", "doc", "tag", "kept_id"):
        df = df.withColumn(c, F.lit(c))
    return df


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_components(rows, n, percent):
    """(id, set size, smallest id, links) per row, and the rows of each component."""
    sets, holders = [shingles(t, n) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in holders[g] if j != i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                links[i] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[(rows[i][0], len(sets[i]), min(ids, default=None), links[i])] += 1
    return out, groups, sets


@pytest.mark.parametrize("block, head", [(1000, 200_000), (25, 40), (1000, 0)])
def test_join_matches_all_pairs(docs, monkeypatch, block, head):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HEAD", head)
    want, _, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    got = Counter((r.id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(docs, n=4, percent=85).collect())
    assert got == want


def test_shared_passages_make_no_large_group(spark, monkeypatch):
    """A chain of passages runs through 100 texts, and one passage stands in families of near copies: the rows
    of all tasks stay in proportion to the texts, and the links are those of all pairs."""
    rng = random.Random(9)
    short = lambda k: [f"w{rng.randint(0, 10**6)}" for _ in range(k)]
    long = lambda name: [f"{name}-{'long' * 5}-{i}" for i in range(6)]
    texts = [" ".join(long(f"c{i}") + short(60) + long(f"c{i + 1}")) for i in range(100)]
    for _ in range(4):
        base = long("all") + short(120)
        for _ in range(6):
            copy = base[:]
            copy[rng.randint(6, 125)] = "changed"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    placed = []

    def counted(tasks):
        def run(groups):
            placed.append(tasks(groups))
            return placed[-1]

        return run

    for name in ("_tasks", "_apart"):
        if hasattr(jaccard, name):
            monkeypatch.setattr(jaccard, name, counted(getattr(jaccard, name)))
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    want, _, _ = brute_components(rows, 4, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(docs, n=4, percent=85).collect())
    assert got == want and len({r[2] for r in want}) < 110
    assert placed and placed[0].filter("component IS NOT NULL").count() <= 600


def test_one_document_of_each_group_stays(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, groups, sets = brute_components(rows, 5, 80)
    kept = jaccard.keep_one(docs, n=5, percent=80)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    worded = [m for m in groups.values() if sets[m[0]]]
    assert sum(got.values()) == len(worded) + sum(not s for s in sets)
    for members in worded:
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        there = [rows[i] for i in members if rows[i] in got]
        assert len(set(there)) == 1 and there[0][0] == min(ids, default=None)
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_bitmaps_never_exceed_the_difference():
    import numpy as np

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(2500)]
    texts = [" ".join(base[: rng.randint(1, 2500)]) for _ in range(40)] + ["", "a b c d"]
    row, token, size = jaccard.shingle_sets(pa.array(texts, pa.string()), 4)
    sets = [set(token[row == r].tolist()) for r in range(len(texts))]
    maps = jaccard.bitmaps(row, token, size)
    assert len({len(m) for m in maps}) > 2
    seen = set()
    for i, others, differ in jaccard._differences(maps):
        for j, d in zip(others.tolist(), differ.tolist()):
            true = len(sets[i] ^ sets[j])
            assert d <= true and d % 2 == true % 2 and frozenset((i, j)) not in seen
            alike = 100 * min(size[i], size[j]) >= 85 * max(size[i], size[j])
            assert not alike or d >= 0.4 * true
            seen.add(frozenset((i, j)))
    assert len(seen) == len(texts) * (len(texts) - 1) // 2 and np.all(size[-2:] == [0, 1])


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201)] * 2
    edges += [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in root}


def test_repeated_windows_are_removed(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    split = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            first[g] = min(first.get(g, NO_ID), NO_ID if i is None else i)
    want = Counter()
    for (i, _), w in zip(rows, split):
        gone, seen = set(), set()
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if first[g] < (NO_ID if i is None else i) or g in seen:
                gone.update(range(p, p + 20))
            seen.add(g)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    got = substrings.remove(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == want
    assert substrings.remove(docs.limit(0)).count() == 0


def test_substrings_without_broadcasts(docs, monkeypatch):
    want = sorted(map(str, substrings.remove(docs).collect()))
    for name in ("BROADCAST_ROWS", "BROADCAST_DOCS"):
        monkeypatch.setattr(substrings, name, -1)
    assert sorted(map(str, substrings.remove(docs).collect())) == want


# packing


def test_bins_hold_every_piece_once(docs):
    sizes = (16, 64, 128)
    rows = packing.pack(docs, F.length("text"), ["doc_id", "text"], sizes).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.text)].append(r)
        assert (r.bin_id is None) == (r.piece_length == 0)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    copies = Counter((r.doc_id, r.text) for r in docs.collect())
    for (key, parts), n in zip(pieces.items(), (copies[k] for k in pieces)):
        assert sum(r.piece_length for r in parts) == n * len(key[1] or "")
        assert {r.piece_start for r in parts} == set(range(0, max(len(key[1] or ""), 1), 128))
    assert set(pieces) == set(copies)
    for held in bins.values():
        end = 0
        for r in sorted(held, key=lambda r: r.bin_start):
            assert r.bin_start == end
            end += r.piece_length
        assert {r.bin_size for r in held} == {min(s for s in sizes if s >= end)}
    assert packing.pack(docs.limit(0), F.length("text"), ["doc_id"]).count() == 0


def test_best_fit_is_best_fit_decreasing_and_the_cheapest_plan():
    rng = random.Random(2)
    sizes = (50, 100, 200)
    for _ in range(40):
        lengths = [rng.randint(1, 200) for _ in range(rng.randint(0, 40))]
        bins, places, final = packing.best_fit(lengths, sizes)
        costs = []
        for top in sizes:  # the same rule, looking through all bins
            left, open_ = sum(lengths), []
            for n in sorted(lengths, reverse=True):
                fits = [b for b in open_ if b[0] >= n]
                if fits:
                    b = min(fits, key=lambda b: b[0])
                else:
                    size = min([s for s in sizes if n <= s <= top] or [min(s for s in sizes if s >= n)], key=lambda s: (packing.cost(s) / min(s, left), s))
                    b = [size, 0]
                    open_.append(b)
                b[0] -= n
                b[1] += n
                left -= n
            costs.append(sum(packing.cost(min(s for s in sizes if s >= b[1])) for b in open_))
        assert sum(map(packing.cost, final)) == pytest.approx(min(costs))


# shards


def test_hilbert_index_visits_neighbours(spark):
    n = F.col("id")
    cube = spark.range(512).select(*((F.floor(n / 8**i) % 8).cast("int").alias(c) for i, c in enumerate("abc")))
    rows = cube.withColumn("h", sharding.hilbert_index([F.col(c) for c in "abc"], 3)).collect()
    path = [p for _, p in sorted((r.h, (r.a, r.b, r.c)) for r in rows)]
    assert sorted(r.h for r in rows) == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards_are_gapless_runs(spark, docs):
    import zlib

    wide = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    rows = sharding.shard(wide, 7).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    encoded = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert sizes == Counter((i, len(b) + 8, zlib.crc32(b)) for i, b in encoded)
    assert sharding.shard(wide.limit(3), 7).agg(F.max("shard")).first()[0] == 2
    assert sharding.shard(wide.limit(0), 7).count() == 0
    assert sharding.shard_ranges(sharding.shard(wide, 7)).agg(F.sum("rows")).first()[0] == docs.count()


# archives


@pytest.mark.parametrize("split", [1, 3, 64, 1000, 1 << 20])
def test_archives_come_back_whole(spark, split):
    pages = [(1, "http://a b/é\n", "x" * 5000), (2, None, "x" * 5000), (None, "u", None), (None, "u", "x" * 5000)]
    pages += [(3, "u", ""), (2, None, "x" * 5000), (7, "u", "é\x1f" * 900), (8, "u", "x" * 999), (9, "u", "x" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).coalesce(2)
    rows = warc.read(warc.write(df), split).collect()
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = len(b) == 5000 and i != 2
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert Counter(bytes(r.payload) for r in rows if r.record_type == "response") == Counter((h or "").encode() for i, _, h in pages if len(h or "") != 5000 or i == 2)


def test_false_magic_is_no_record(tmp_path):
    data = b"\x1f\x8b\x08junk" + warc.encode_record(1, "u", b"p", hashlib.sha1(b"p").hexdigest()) + b"\x1f\x8b\x08"
    data += warc.encode_record(2, "u", b"q", hashlib.sha1(b"q").hexdigest())[:-3]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with open(path, "rb") as f:
        found = [r["page_id"] for at in range(len(data)) for _, d in warc.read_range(f, len(data), at, at + 1) for r in warc.decode_records(d)]
    assert found == [1]


def member(*records):
    import gzip

    return gzip.compress(b"".join(records))


def record(head, block, length=None):
    return b"WARC/1.0\r\n" + head + b"\r\nContent-Length: %d\r\n\r\n" % (len(block) if length is None else length) + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    http = b"Content-Type: application/http; msgtype=response"
    parts = [
        member(record(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields", b"software: x\r\n")),
        member(record(b"warc-type:request\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http;msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n")),
        member(record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Target-URI: http://\xc3\xa9/\r\nX-Folded: a\r\n b\r\nno colon here\r\n" + http,
                      b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX: \xff\r\n\r\n3;q=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")),
        member(record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:4>\r\nX-Odd: \xff\xfe\r\n" + http, b"HTTP/1.0 200 OK\r\n\r\nhello")),
        member(record(b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Refers-To: <urn:uuid:4>\r\nWARC-Payload-Digest: md5:xyz", b"")),
        member(record(b"WARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:6>", b"two"), record(b"WARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:7>", b"in one")),
        member(record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:8>\r\n" + http, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz", 500)),
        member(b"WARC/1.0\r\nWARC-Record-ID: <urn:uuid:9>\r\n\r\nloose"),
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(parts))
    files = spark.createDataFrame([(str(path), path.stat().st_size), (str(path), 0)], "path string, bytes long")
    for split in (64, 1 << 20):
        rows = {r.record_id[-2]: r for r in warc.read(files, split).collect()}
        assert [rows[k].record_type for k in "123456789"] == ["warcinfo", "request", "response", "response", "revisit", "resource", "metadata", "response", None]
        assert (bytes(rows["3"].payload), rows["3"].url) == (b"abcde", "http://é/")
        assert bytes(rows["4"].payload) == b"hello" and rows["4"].payload_digest == hashlib.sha1(b"hello").hexdigest()
        assert (rows["5"].refers_to_id, rows["5"].refers_to, rows["5"].payload_bytes, rows["5"].payload_digest) == ("<urn:uuid:4>", None, None, None)
        assert [bytes(rows[k].payload) for k in "679"] == [b"two", b"in one", b"loose"]
        assert {k: r.problem for k, r in rows.items() if r.problem} == {"8": "cut off", "9": "no content length"}


def test_ranges_are_read_in_many_tasks(spark):
    pages = spark.range(2_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    files = warc.write(pages.coalesce(1))
    size = files.collect()[0].bytes
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    read = warc.read(files, -(-size // 100)).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(read) >= 50 and sum(r.n for r in read) == 2_000
    assert max(r.n for r in read) <= 100


def test_paths_without_a_scheme_are_those_of_the_default_file_system(spark):
    from turnwise.llm.common import qualified

    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        assert qualified(spark, "/user/x") == "/user/x"
        hadoop.set("fs.defaultFS", "hdfs://names:8020/")
        assert qualified(spark, "/user/x") == "hdfs://names:8020/user/x"
        assert qualified(spark, "file:/tmp/x") == "file:/tmp/x" and qualified(spark, "s3a://b/x") == "s3a://b/x"
    finally:
        hadoop.set("fs.defaultFS", "file:///")


def test_pages_of_the_table(spark):
    rows = QUERIES["op7_warc"](spark, FOLDER).collect()
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert {(r.page_id, r.payload_digest) for r in rows} == {(p.page_id, hashlib.sha1((p.html or "").encode()).hexdigest()) for p in pages}
    assert warc.read(warc.write(spark.read.parquet(f"{FOLDER}/pages.parquet").limit(0))).count() == 0


# tool calls


def test_calls_are_linked_ordered_and_checked(spark):
    call = lambda i, turn, name, args, conv=1: (conv, i, turn, name, args if isinstance(args, str) or args is None else json.dumps(args))
    ok = {"query": "é", "limit": 3}
    calls = [
        call("a", 1, "lookup", ok), call("a", 1, "lookup", ok), call("b", 2, "store", {"path": "p", "overwrite": True, "tags": [{"x": {"$ref": "a"}}]}),
        call("c", 3, "measure", {"value": {"$ref": "b"}, "unit": "m"}), call("d", 4, "lookup", {"limit": True, "more": 1}),
        call("e", 5, "lookup", {"query": {"$ref": "f"}}), call("f", 6, "lookup", {"query": {"$ref": "e"}}), call("g", 7, "none", ok),
        call("h", 8, "lookup", "{"), call("i", 9, "lookup", "[1]"), call("j", 9, "lookup", '{"query": NaN}'), call("k", 9, "lookup", None),
        call("l", 10, "lookup", {"query": {"$ref": "missing"}}), call(None, 11, "lookup", ok), call("m", 12, "lookup", ok), call("a", 1, "lookup", ok, 2),
    ]
    results = [(1, x, 20, f"r{x}") for x in "abcdefghijl"] + [(1, "zz", 3, "lost"), (1, "m", 5, "early"), (None, "a", 1, "x"), (1, "a", 30, "late")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string").withColumn("level", F.lit(9))
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").withColumn("c", F.lit(9))
    rows = toolcalls.link(c, r, TOOLS).collect()
    got = {(x.conv_id, x.call_id): x for x in rows if x.status != "no identifier"}
    status = {k[1]: v.status for k, v in got.items() if k[0] == 1}
    assert status == dict(a="linked", b="linked", c="linked", d="invalid", e="circular", f="circular", g="invalid", h="invalid", i="invalid", j="invalid", k="invalid", l="linked", m="early result", zz="no call")
    assert got[(2, "a")].status == "no result"
    assert [got[(1, x)].level for x in "abce"] == [0, 1, 2, None]
    assert got[(1, "d")].faults == "limit is no integer; missing query; unexpected more"
    assert got[(1, "a")].repeats == 2
    assert got[(1, "a")].record == '{"arguments":{"limit":3,"query":"é"},"id":"a","name":"lookup","result":"ra"}'
    assert sum(x.status == "no identifier" for x in rows) == 2
    assert toolcalls.link(c.limit(0), r.limit(0), TOOLS).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rows = [(1, str(i), str(i - 1)) for i in range(1, 200)] + [(2, str(i), str(j)) for i in range(2, 30) for j in (i - 1, i - 2)] + [(3, "0", "1"), (3, "1", "2"), (3, "2", "0"), (3, "5", "2")]
    edges = spark.createDataFrame(rows, "conv_id long, call_id string, ref string")
    calls = spark.createDataFrame([(c, str(i)) for c in (1, 2, 3) for i in range(200)], "conv_id long, call_id string")
    got = {(r.conv_id, int(r.call_id)): r.level for r in toolcalls.levels(calls, edges.filter("conv_id <> 2")).collect()}
    assert all(got[1, i] == i for i in range(200)) and not {(3, 0), (3, 1), (3, 2), (3, 5)} & set(got) and got[3, 7] == 0
    stored, steps = toolcalls.stored, []
    monkeypatch.setattr(toolcalls, "stored", lambda df, name: steps.append(name) or stored(df, name))
    toolcalls.levels(calls, edges.filter("conv_id = 1")).count()
    assert len(steps) < 25
    short = toolcalls.levels(calls, edges.filter("conv_id = 2 AND int(call_id) < 8")).collect()
    assert all(r.level == max(0, int(r.call_id) - 1) for r in short if r.conv_id == 2 and int(r.call_id) < 8)


def test_derived_calls_hold_whole_texts_and_long_chains(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", "word " * 40 + "end" + "x" * (t % 5)) for c in (1, 2) for t in range(40)]
    calls, _ = tool_traffic(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    arguments = {(r.conv_id, r.turn): r.arguments for r in calls.collect()}
    assert sum("$ref" in a for a in arguments.values()) == 38
    assert any("word end" in a for a in arguments.values())


def test_calls_of_the_table(spark):
    rows = QUERIES["op6_tool_calls"](spark, FOLDER).collect()
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    there = {(t.conv_id, t.turn): t for t in turns}
    calls = {k: t for k, t in there.items() if t.role == "assistant"}
    mine = {(r.conv_id, r.turn): r for r in rows if r.status != "no call"}
    assert set(mine) == set(calls)
    for k, r in mine.items():
        after = there.get((k[0], k[1] + 1))
        assert (after is not None and after.role == "user") == (json.loads(r.record)["result"] is not None)
        assert r.record == toolcalls.canonical(json.loads(r.record))
        for ref in re.findall(r'"\$ref":"c\d+-(\d+)"', r.record):
            assert r.level is None or mine[(k[0], int(ref))].level < r.level


def test_calls_with_halves_of_surrogates_and_deep_arguments(spark):
    deep = '{"query": "x", "more": ' + "[" * 9_900 + "]" * 9_900 + "}"
    rows = [(1, "a", 0, "lookup", '{"query":"cut \\ud83d"}'), (1, "b", 1, "lookup", '{"query":{"$ref":"\\ud83d"}}'), (1, "c", 2, "lookup", deep), (1, "d", 3, "lookup", '{"query":"\\ud83d\\ude00"}')]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string")
    results = calls.select("conv_id", "call_id", (F.col("turn") + 10).alias("turn"), F.lit("r").alias("content"))
    got = {r.call_id: r for r in toolcalls.link(calls, results, TOOLS).collect()}
    assert got["a"].status == "linked"
    assert got["a"].record == '{"arguments":{"query":"cut \\ud83d"},"id":"a","name":"lookup","result":"r"}'
    assert got["d"].record == '{"arguments":{"query":"\U0001f600"},"id":"d","name":"lookup","result":"r"}'
    assert set(got) == set("abcd") and got["b"].record is not None
    assert got["c"].status in ("linked", "invalid")  # as deep as the parser of the Python at hand goes
