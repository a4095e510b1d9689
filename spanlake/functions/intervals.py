"""Column arithmetic on spans: overlap, IoU, coverage, duration buckets, safe ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.schema import DURATION_EDGES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def overlap(a0, a1, b0, b1) -> Column:
    a0, a1, b0, b1 = map(col, (a0, a1, b0, b1))
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a0, a1, b0, b1) -> Column:
    """Intersection over union of two spans; 0 when the union is empty."""
    a0, a1, b0, b1 = map(col, (a0, a1, b0, b1))
    inter = overlap(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def coverage(p0, p1, g0, g1) -> Column:
    """Share of span g that span p covers; 0 for an empty g."""
    p0, p1, g0, g1 = map(col, (p0, p1, g0, g1))
    return F.when(g1 > g0, overlap(p0, p1, g0, g1) / (g1 - g0)).otherwise(0.0)


def duration(start="start_s", end="end_s") -> Column:
    return col(end) - col(start)


def assert_ordered(df: DataFrame, start="start_s", end="end_s") -> DataFrame:
    """Fail the job on a span that ends before it starts."""
    bad = col(end) < col(start)
    return df.withColumn(start, F.when(
        bad, F.raise_error(F.format_string("span ends before it starts: %s > %s", col(start), col(end)))
    ).otherwise(col(start)))


def split_ordered(df: DataFrame, start="start_s", end="end_s") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    bad = F.coalesce(col(end) < col(start), F.lit(True))
    return df.filter(~bad), df.filter(bad)


def bucket_names(edges: Sequence[float] = DURATION_EDGES) -> list[str]:
    cuts = ["0", *(f"{e:g}" for e in edges), "inf"]
    return [f"{lo}-{hi}" for lo, hi in zip(cuts, cuts[1:])]


def duration_bucket(length, edges: Sequence[float] = DURATION_EDGES,
                    names: Sequence[str] | None = None) -> Column:
    """Half-open duration bucket; a negative length belongs to no range and falls in the last."""
    names = list(names or bucket_names(edges))
    length = col(length)
    out = F.when(length < 0, names[-1])
    for edge, name in zip(edges, names):
        out = out.when(length < edge, name)
    return out.otherwise(names[-1])


def taxonomy_bucket(length) -> Column:
    """The failure report's four buckets; there a negative length counts as the shortest."""
    length = col(length)
    return (F.when(length < 2, "<2s").when(length < 4, "2-4s").when(length < 8, "4-8s")
            .otherwise("8s+"))


def ratio(num, den) -> Column:
    num, den = col(num), col(den)
    return F.when(den > 0, num / den).otherwise(0.0)


def precision(matched, n_pred) -> Column:
    return ratio(matched, n_pred)


def recall(matched, n_gold) -> Column:
    return ratio(matched, n_gold)


def f1(matched, n_pred, n_gold) -> Column:
    p, r = ratio(matched, n_pred), ratio(matched, n_gold)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
