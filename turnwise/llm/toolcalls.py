"""Tool calls linked with their results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on conversation and call identifier, which is unique per
call, so a conversation of any length spreads over all tasks. Arguments may refer to the result of
another call as ``{"$ref": id}``; a call's level is one more than the highest level it refers to, found
in rounds of joins over the calls that are still open. In each round a reference to an open call with
one reference goes on to what that refers to, so a chain takes as many rounds as the logarithm of its
length (calls that refer to several open calls, which do so in turn, take one round per link). Level, turn and identifier order the calls of a conversation topologically; what never
gets a level refers to itself in a circle.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TYPES = {
    "string": (str,),
    "integer": (int,),
    "number": (int, float),
    "boolean": (bool,),
    "array": (list,),
    "object": (dict,),
}
Schema = dict[str, dict[str, tuple[str, bool]]]


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and every character that needs no escape as itself.

    Halves of surrogate pairs are no characters of a text: they stay escaped.
    """
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def escaped(text: str) -> str:
    return re.sub("[\ud800-\udfff]", lambda half: f"\\u{ord(half[0]):04x}", text)


def _refuse(text: str):
    raise ValueError(text)


def _reference(value) -> str | None:
    ok = isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str)
    return value["$ref"] if ok else None


def references(value) -> set[str]:
    """Identifiers that a value refers to, at any depth (walked with a stack of its own)."""
    found, open_ = set(), [value]
    while open_:
        x = open_.pop()
        ref = _reference(x)
        if ref is not None:
            found.add(escaped(ref))
        elif isinstance(x, dict):
            open_ += x.values()
        elif isinstance(x, list):
            open_ += x
    return found


def check(name: str | None, arguments: str | None, schemas: Schema) -> tuple[str | None, str, list[str]]:
    """Canonical arguments (null if they are no JSON object), the faults found, and the references."""
    try:
        value = json.loads(arguments or "", parse_constant=_refuse)
        text = canonical(value)
    except (ValueError, RecursionError):
        return None, "no JSON", []
    if not isinstance(value, dict):
        return None, "no object", []
    faults = []
    if name not in schemas:
        faults.append("unknown tool")
    else:
        for key, (kind, required) in sorted(schemas[name].items()):
            if key not in value:
                faults += [f"missing {key}"] * required
            elif _reference(value[key]) is None:
                x = value[key]
                right = isinstance(x, TYPES[kind]) and (kind == "boolean" or not isinstance(x, bool))
                faults += [] if right else [f"{key} is no {kind}"]
        faults += [f"unexpected {key}" for key in sorted(set(value) - set(schemas[name]))]
    return text, "; ".join(faults), sorted(references(value))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for the calls that are in no circle and refer to none.

    ``edges`` has conv_id, call_id and ref; references to calls that don't exist are left out.
    """
    key = ["conv_id", "call_id"]
    targets = calls.select("conv_id", F.col("call_id").alias("ref"))
    edges = edges.distinct().join(targets, ["conv_id", "ref"]).withColumn("steps", F.lit(1).cast("long"))
    open_ = stored(edges, "references")
    waiting = open_.select(*key).distinct()
    done = stored(calls.select(*key).join(waiting, key, "left_anti").withColumn("level", F.lit(0)), "level")
    found = done
    while open_.count() and done.count():
        met = found.select("conv_id", F.col("call_id").alias("ref"), "level")
        nodes = open_.join(met, ["conv_id", "ref"], "left").groupBy(*key).agg(
            F.max(F.col("level") + F.col("steps")).cast("int").alias("level"), F.count("*").alias("n"),
            F.count("level").alias("known"), F.max("ref").alias("ref"), F.max("steps").alias("steps"),
        )
        nodes = stored(nodes, "level")
        done = nodes.filter("n = known").select(*key, "level")
        rest = open_.join(done.select(*key), key, "left_anti")
        # a reference to an open call that has one reference itself goes on to that
        single = nodes.filter("n = 1 AND known = 0 AND ref <> call_id").select(
            "conv_id", F.col("call_id").alias("ref"), F.col("ref").alias("next"), F.col("steps").alias("more")
        )
        jumped = rest.join(single, ["conv_id", "ref"], "left").select(
            *key, F.coalesce("next", "ref").alias("ref"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        )
        found, open_ = found.union(done), stored(jumped.groupBy(*key, "ref").agg(F.max("steps").alias("steps")), "open")
    return found


def link(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """A row per call, and per result without a call.

    ``calls`` has conv_id, call_id, turn, name, arguments; ``results`` has conv_id, call_id, turn, content; other columns
    are ignored. Of calls (or results) that share an identifier the earliest turn counts, then the
    smallest text; ``repeats`` says how many others there were. Rows with a null conv_id or call_id can't be
    linked and come back unlinked, with that status. ``status``: ``linked``, ``invalid`` (see ``faults``), ``circular``,
    ``no result``, ``early result`` (before its call), ``no call``, ``no identifier``. ``level`` is null where there is no order. ``record`` is the canonical JSON of
    call and result.
    """

    @F.pandas_udf("text string, faults string, refs array<string>")
    def checked(name: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        rows = [check(n, a, schemas) for n, a in zip(name, arguments)]
        return pd.DataFrame(rows, columns=["text", "faults", "refs"])

    @F.pandas_udf("string")
    def record(call: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series) -> pd.Series:
        def one(i, n, a, c):
            # the arguments are canonical as they are, at any depth
            fields = {"arguments": "null" if a is None else a} | {k: canonical(v) for k, v in (("id", i), ("name", n), ("result", c))}
            return "{" + ",".join(f'"{k}":{fields[k]}' for k in sorted(fields)) + "}"

        return pd.Series([one(*x) for x in zip(call, name, arguments, content)], dtype=object)

    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def first(df: DataFrame, columns: list[str]) -> DataFrame:
        least = F.min(F.struct("turn", *columns)).alias("x")
        return df.filter(named).groupBy(*key).agg(least, (F.count("*") - 1).alias("repeats")).select(*key, "x.*", "repeats")

    c = first(calls, ["name", "arguments"]).withColumn("c", checked("name", "arguments"))
    c = stored(c, "calls")
    r = first(results, ["content"]).select(*key, F.col("turn").alias("result_turn"), "content", F.col("repeats").alias("result_repeats"))
    placed = levels(c, c.select(*key, F.explode("c.refs").alias("ref")))
    both = c.join(placed, key, "left").join(r, key, "full_outer")
    status = (
        F.when(F.col("c").isNull(), "no call")
        .when(F.col("c.text").isNull() | (F.col("c.faults") != ""), "invalid")
        .when(F.col("level").isNull(), "circular")
        .when(F.col("result_turn").isNull() & F.col("content").isNull() & F.col("result_repeats").isNull(), "no result")
        .when(F.col("result_turn") < F.col("turn"), "early result")
        .otherwise("linked")
    )
    out = both.select(
        *key,
        "turn",
        "level",
        "name",
        status.alias("status"),
        F.coalesce("c.faults", F.lit("")).alias("faults"),
        (F.coalesce("repeats", F.lit(0)) + F.coalesce("result_repeats", F.lit(0))).cast("long").alias("repeats"),
        record("call_id", "name", F.col("c.text"), "content").alias("record"),
    )
    lost = [("turn", "name"), ("turn", None)]
    for df, (turn, name) in zip((calls, results), lost):
        out = out.unionByName(
            df.filter(~named).select(
                *key,
                F.col(turn),
                F.lit(None).cast("int").alias("level"),
                (F.col(name) if name else F.lit(None).cast("string")).alias("name"),
                F.lit("no identifier").alias("status"),
                F.lit("").alias("faults"),
                F.lit(0).cast("long").alias("repeats"),
                F.lit(None).cast("string").alias("record"),
            )
        )
    return out
