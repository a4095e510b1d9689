"""What the learned operators share: splits by document id and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sampled(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About bound rows, or all if there are fewer: those with the smallest hashes of key."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * bound / n))
