"""Stable hashes of a key, equal across runs, clusters and SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted_hash(salt: str, key: Column) -> Column:
    """A 32-bit unsigned number from the first 8 hex digits of md5('salt-key')."""
    digest = F.md5(F.concat(F.lit(f"{salt}-"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
