"""Hash-uniform random numbers.

``u = first 8 hex digits of md5(key) / 2^32``.  A draw depends only on its
key, never on partitioning, task retries or reruns, so every "random"
operator is deterministic and can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_uniform(*parts) -> Column:
    """Uniform [0, 1) from md5 of ``parts`` joined by ':'."""
    k = _key(*parts)
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def hash_order(*parts) -> Column:
    """A sort key: md5 hex string of the parts (total order, seeded)."""
    return F.md5(_key(*parts))


def sql_uniform(expr: str) -> str:
    """DuckDB form of :func:`hash_uniform` for oracle SQL (``expr`` is the key)."""
    return f"(cast(('0x' || substr(md5({expr}), 1, 8)) as ubigint) / 4294967296.0)"
