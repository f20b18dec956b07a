"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    jaccard,
    language,
    packing,
    periodic,
    pii,
    quality,
    sharding,
    substrings,
    toolcalls,
    toxicity,
    warc,
    whitening,
)
from .common import let, table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in sequences of 512 to 8192 words."""
    return packing.pack(table(spark, folder, "documents"), F.size(words(F.col("text"))), ["doc_id"])


@query
def op2_skip_chain_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, by patterns and by the skip-chain field."""
    found = pii.find(table(spark, folder, "documents"), with_text=False)
    columns = (*(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans")
    return found.select("doc_id", *(F.col(f"pii.{c}").alias(c) for c in columns))


@query
def op3_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))  # identifiers may repeat
    return decontaminate.matches(keyed, items, ["doc_id", "text_hash"]).drop("text_hash")


@query
def op8_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics of every document and the verdict of the weighted rules."""
    rated = quality.rate(table(spark, folder, "documents"), keep=["doc_id"])
    q, s = F.col("quality"), F.col("quality.stats")
    return rated.select(
        "doc_id",
        *(s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        q["base_failed"].alias("base_failed"),
        q["kept"].alias("kept"),
        F.round(q["posterior"], 9).alias("posterior"),
    )


@query
def op9_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 24 shards along the Hilbert curve, row counts at most one apart."""
    placed = sharding.shard(table(spark, folder, "documents"), 24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


@query
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component under four-word shingles and similarity 0.85."""
    joined = jaccard.join(table(spark, folder, "documents"), n=4, percent=85)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


#: What the tools of the derived calls accept: name -> argument -> (type, required).
TOOLS: toolcalls.Schema = {
    "lookup": {"query": ("string", True), "limit": ("integer", False)},
    "measure": {"value": ("number", True), "unit": ("string", True)},
    "store": {"path": ("string", True), "overwrite": ("boolean", True), "tags": ("array", False)},
}


def tool_traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results by rule from every turn of ``conversations``.

    An assistant's turn is a call whose tool and arguments follow from its place and text, with
    missing, mistyped and broken arguments among them; a call may refer to the assistant's turn
    two before it, and in two of three conversations every call does. A user's turn that follows is that call's result.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    refers = (F.col("turn") > 2) & ((F.pmod(F.col("conv_id"), F.lit(3)) > 0) | (n % 3 == 0))
    back = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 2).alias("$ref")))
    plain = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("q")))
    quoted = F.substring(plain, F.lit(6), F.length(plain) - 6)
    lookup = F.concat(F.lit('{"query": '), F.when(refers, back).otherwise(quoted), F.when(n % 7 == 0, F.lit(', "limit": "ten"}')).otherwise(F.concat(F.lit(', "limit": '), n, F.lit("}"))))
    measure = F.concat(F.lit('{ "value":'), F.when(refers, back).otherwise((n / 4).cast("string")), F.when(n % 5 == 0, F.lit("")).otherwise(F.lit(',"unit":"words"')), F.lit("}"))
    store = F.concat(F.lit('{"path":'), quoted, F.lit(',"tags":['), F.when(refers, back).otherwise(F.lit("1")), F.lit('],"overwrite":'), F.when(n % 11 == 0, F.lit("maybe")).otherwise(F.lit("true")), F.lit("}"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    calls = conversations.filter("role = 'assistant'").select(
        "conv_id",
        ident(F.col("turn")).alias("call_id"),
        "turn",
        F.when(kind == 0, "lookup").when(kind == 1, "measure").when(kind == 2, "store").otherwise(F.when(n % 2 == 0, "lookup").otherwise("guess")).alias("name"),
        F.when(kind == 1, measure).when(kind == 2, store).otherwise(lookup).alias("arguments"),
    )
    results = conversations.filter("role = 'user' AND turn > 0").select(
        "conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


@query
def op6_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and results of every conversation, linked, ordered, checked and as canonical JSON."""
    return toolcalls.link(*tool_traffic(table(spark, folder, "conversations")), TOOLS)


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back in byte ranges."""
    records = warc.read(warc.write(table(spark, folder, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 20-word windows that the corpus holds earlier."""
    return substrings.remove(table(spark, folder, "documents"), with_text=False).drop("kept")


@query
def op5_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of those with a label."""

    def held_out(id: str) -> Column:
        return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 4 == 2

    docs = table(spark, folder, "documents")
    found = language.identify(docs, training=~held_out("doc_id"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "switches")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where every tenth identifier's hash makes the text repeat itself from some word on.

    Other texts stay as they are, as do those without words and those of a null identifier.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        start = F.pmod(g, n).cast("int")
        period = 1 + F.floor((n - start) / (3 + g % 8)).cast("int")
        rule = F.struct(w.alias("w"), start.alias("a"), period.alias("p"))
        moved = lambda r: F.transform(
            r["w"], lambda x, i: F.when(i < r["a"], x).otherwise(F.get(r["w"], r["a"] + (i - r["a"]) % r["p"]))
        )
        return F.when(n > 0, F.array_join(let(rule, moved), " "))

    repeated = let(words(F.col("text")), repeat)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(repeated, "text")).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of every document, some of which are made to repeat themselves, and what is left without them."""
    docs = with_planted_periods(table(spark, folder, "documents"))
    return periodic.collapse(docs, with_text=False).drop("collapsed")


@query
def op12_qdwh_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector along the first sixteen principal components of all distinct ones, whitened."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_subword_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from two thirds of those with a label."""

    def held_out(id: str) -> Column:
        return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 3 == 1

    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, table(spark, folder, "labels"), training=~held_out("doc_id"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)


# --- SQL ------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

SQL["op4_seed_extend"] = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
x AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS i, ws FROM d WHERE len(ws) >= 20),
y AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h FROM x),
r AS (SELECT doc_id, i FROM y QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(generate_series(0, 19)) AS k)),
k AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM
  (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) w ANTI JOIN c ON c.doc_id = w.doc_id AND c.p = w.p GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

_LOWER = _WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

SQL["op10_ngram_jaccard"] = f"""WITH RECURSIVE d AS (SELECT doc_id, {_LOWER} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM d WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM w),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT n.doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM n JOIN c ON c.a = n.doc_id LEFT JOIN l ON l.a = n.doc_id"""

SQL["op7_warc"] = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)"""
