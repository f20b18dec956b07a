"""Scale, rubric, tag, lexicon and query settings from JSON files.

``load_settings`` reads configuration of a few hundred rows and gives it back as small mappings that operators
turn into plan literals. ``read_edges`` and ``read_queries`` read settings of any size as tables; their checks are
part of the plan, so a refused entry ends the job that meets it, and nothing passes through the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import bounded_rows


@dataclass(frozen=True)
class Settings:
    """Validated settings of a scale."""

    topics: tuple[str, ...]
    edges: dict[str, list[dict[str, str]]]
    tag_map: dict[str, str]
    lexicon: dict[str, list[str]]
    queries: dict[str, list[str]]
    rubric: dict[str, dict[str, str]]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The settings as tables, for joins and inspection."""
        listed = lambda m: [(t, i, x) for t, xs in m.items() for i, x in enumerate(xs)]
        return {
            "topics": spark.createDataFrame(
                list(enumerate(self.topics)), "ord int, topic string"
            ),
            "tag_edge": spark.createDataFrame(
                [(t, i, e["topic"], e["relation"], e["strength"]) for t, es in self.edges.items() for i, e in enumerate(es)],
                "tag string, ord int, topic string, relation string, strength string",
            ),
            "tag_topic": spark.createDataFrame(list(self.tag_map.items()), "tag string, topic string"),
            "lexicon": spark.createDataFrame(listed(self.lexicon), "topic string, ord int, keyword string"),
            "seed_query": spark.createDataFrame(listed(self.queries), "topic string, ord int, query string"),
            "rubric": spark.createDataFrame(
                [(t, lv, x) for t, levels in self.rubric.items() for lv, x in levels.items()],
                "topic string, level string, text string",
            ),
        }


def _load(spark: SparkSession, path: str) -> dict:
    rows = bounded_rows(spark.read.text(path, wholetext=True), 1, path)
    if not rows:
        raise ValueError(f"{path} is not a settings file")
    return json.loads(rows[0].value)


def check_topics(found, allowed, what: str) -> None:
    unknown = sorted(set(found) - set(allowed))
    if unknown:
        raise ValueError(f"{what} has unknown topics: {unknown}")


def check_edges(tags: dict, topics) -> dict[str, list[dict[str, str]]]:
    """Tag edges with known topic, relation and strength; refuses an empty map."""
    if not tags:
        raise ValueError("the tag map is empty")
    for tag, listed in tags.items():
        if not isinstance(listed, list):
            raise ValueError(f"tag {tag} must map to a list")
        for e in listed:
            check_topics([e.get("topic", "")], [*topics, K.CROSS_CUTTING], f"tag {tag}")
            if e.get("relation") not in K.RELATIONS:
                raise ValueError(f"tag {tag} has unknown relation {e.get('relation')}")
            if e.get("strength") not in K.STRENGTHS:
                raise ValueError(f"tag {tag} has unknown strength {e.get('strength')}")
    return tags


def load_settings(spark: SparkSession, files: dict[str, str]) -> Settings:
    """Settings from files named ``scale``, ``edges``, ``tag_map``, ``lexicon``, ``queries``, ``rubric``.

    ``scale`` and ``edges`` are required. Unknown topics, relations and strengths are errors,
    and so is a query file that leaves out a topic.
    """
    topics = tuple(_load(spark, files["scale"]))

    def plain(name: str) -> dict:
        raw = _load(spark, files[name]) if name in files else {}
        return {k: v for k, v in raw.items() if k != "_meta"}

    edges = check_edges(_load(spark, files["edges"]).get("tags", {}), topics)
    tag_map, lexicon, queries = plain("tag_map"), plain("lexicon"), plain("queries")
    check_topics(tag_map.values(), [*topics, K.CROSS_CUTTING], "the flat tag map")
    check_topics(lexicon, topics, "the lexicon")
    check_topics(queries, topics, "the seed queries")
    if "queries" in files and set(topics) - set(queries):
        raise ValueError(f"topics without queries: {sorted(set(topics) - set(queries))}")
    rubric = plain("rubric")
    inner = next(iter(rubric.values()), {})
    if rubric and all(isinstance(v, dict) for v in inner.values()):
        rubric = inner  # the file names the scale first
    return Settings(
        topics,
        edges,
        tag_map,
        {t: [str(w).lower() for w in ws] for t, ws in lexicon.items()},
        {t: [str(q) for q in qs] for t, qs in queries.items()},
        rubric,
    )


# --- settings of any size, as tables --------------------------------------------------------

_EDGE = "struct<topic:string,relation:string,strength:string>"


def _refused(df: DataFrame, problem: Column) -> DataFrame:
    """``df``, whose rows with a ``problem`` (a text) end the job; a filter, so no pruning can drop the check."""
    return df.filter(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True)))


def _or_empty(rows: DataFrame, source: DataFrame, what: str) -> DataFrame:
    """``rows``; an empty ``source`` ends the job."""
    n = source.agg(F.count("*").alias("n"))
    guard = n.filter(F.when(F.col("n") == 0, F.raise_error(F.lit(f"{what} is empty")).cast("boolean")).otherwise(F.lit(False)))
    return rows.unionByName(guard.select(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes)))


def _entries(spark: SparkSession, path: str, under: str | None) -> DataFrame:
    """``(name, value)`` of the objects in the lines of a JSON file, or of their field ``under``; values as JSON text."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    whole = F.from_json("value", "map<string,string>")
    inner = F.from_json(F.element_at(whole, F.lit(under)), "map<string,string>") if under else whole
    return raw.select(F.explode(inner).alias("name", "value")).filter("name <> '_meta'")


def _known(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """``rows`` with ``known``, whether the topic is one of ``topics``."""
    listed = topics.select(F.col("topic").alias("__topic"), F.lit(True).alias("known")).distinct()
    return rows.join(listed, F.col("topic") == F.col("__topic"), "left").drop("__topic")


def read_edges(spark: SparkSession, path: str, topics: DataFrame) -> DataFrame:
    """Tag edges ``(tag, ord, topic, relation, strength)`` from lines ``{"tags": {tag: [edge, ...]}}``.

    A tag that maps to no list, an edge with an unknown topic, relation or strength, and a file without tags
    are refused when the result is computed. A tag with an empty list has no edges.
    """
    tags = _entries(spark, path, "tags").select(
        F.col("name").alias("tag"), "value", F.from_json("value", f"array<{_EDGE}>").alias("edges")
    )
    no_list = ~F.coalesce(F.ltrim("value").startswith("["), F.lit(False)) | F.col("edges").isNull()
    tags = _refused(tags, F.when(no_list, F.concat(F.lit("tag "), "tag", F.lit(" must map to a list"))))
    # outer, since the filter that Spark derives from an inner one would drop the entries before they are checked
    rows = tags.select("tag", F.posexplode_outer("edges").alias("ord", "e")).filter("ord IS NOT NULL").select("tag", "ord", "e.*")
    rows = _known(rows, topics)

    def fault(what: str, value: str) -> Column:
        return F.concat(F.lit("tag "), "tag", F.lit(f" has an unknown {what}: "), F.coalesce(value, F.lit("none")))

    context = F.coalesce(F.col("topic") == K.CROSS_CUTTING, F.lit(False))
    problem = (
        F.when(F.col("known").isNull() & ~context, fault("topic", "topic"))
        .when(~F.coalesce(F.col("relation").isin(K.RELATIONS), F.lit(False)), fault("relation", "relation"))
        .when(~F.coalesce(F.col("strength").isin(K.STRENGTHS), F.lit(False)), fault("strength", "strength"))
    )
    return _or_empty(_refused(rows, problem).drop("known"), tags, "the tag map")


def read_queries(spark: SparkSession, path: str, topics: DataFrame) -> DataFrame:
    """Seed queries ``(topic, ord, query)`` from lines ``{topic: [query, ...]}``.

    An unknown topic, one that maps to no list, and a topic of ``topics`` that the file lacks are refused when the
    result is computed.
    """
    listed = _entries(spark, path, None).select(
        F.col("name").alias("topic"), F.from_json("value", "array<string>").alias("queries")
    )
    marked = _known(listed, topics)
    problem = F.when(F.col("known").isNull(), F.concat(F.lit("unknown topic: "), "topic")).when(
        F.col("queries").isNull(), F.concat(F.lit("topic "), "topic", F.lit(" must map to a list"))
    )
    rows = _refused(marked, problem).select("topic", F.posexplode_outer("queries").alias("ord", "query")).filter("ord IS NOT NULL")
    told = listed.select(F.col("topic").alias("__topic"), F.lit(True).alias("told"))
    every = topics.select("topic").distinct().join(told, F.col("topic") == F.col("__topic"), "left")
    # the flag comes from the other side of the join, so the check stays above it
    every = _refused(every, F.when(F.col("told").isNull(), F.concat(F.lit("topic without queries: "), "topic")))
    none = every.filter(F.col("told").isNull()).select("topic", F.lit(0).alias("ord"), F.lit("").alias("query"))
    return rows.unionByName(none)
