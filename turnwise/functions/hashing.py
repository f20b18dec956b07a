"""Content hashes over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the compact JSON object with its keys in order."""
    record = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def hash_value(c: Column) -> Column:
    """SHA-256 of one value's JSON text (a lone value rather than an object)."""
    wrapped = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.sha2(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6), 256)


def draw(*parts: Column) -> Column:
    """A reproducible 60-bit number from the parts: the same under task retries."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def set_digest(c: Column, prefix: str = "") -> list[Column]:
    """Aggregates whose values identify a set of strings whatever its order.

    The hashes are added up in pieces, so the digest combines on the map side and
    never gathers the set in one place.
    """
    digest = F.sha2(c, 256)
    out = [F.count("*").alias(f"{prefix}n")]
    for i in range(4):
        piece = F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
        out.append(F.sum(piece).alias(f"{prefix}s{i}"))
    return out
