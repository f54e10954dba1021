"""Deterministic hashes: uniforms, canonical JSON digests and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, name: str) -> Column:
    """A uniform double in [0, 1) fixed by the key, the seed and a name; independent of partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}:{name}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def canonical_json(values: dict[str, Column]) -> Column:
    """JSON text with the keys in sorted order and without spaces; nulls left out."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def evidence_hash(values: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(values), 256)


def cache_key(namespace: str, values: dict[str, Column]) -> Column:
    """``namespace:`` and the MD5 of the canonical JSON."""
    return F.concat(F.lit(f"{namespace}:"), F.md5(canonical_json(values)))
