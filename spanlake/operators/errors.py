"""Why was a gold segment missed? One class per gold span, in priority order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions import intervals as iv
from spanlake.operators.layout import by_size, ordered
from spanlake.operators.scoring import greedy, inside_pairs, overlaps
from spanlake.schema import COVERAGE_CUT, RUN_KEYS, SHIFTED_CUT, TAXONOMY


@by_size("pred", "gold")
def merged(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """Gold spans (keys, idx) that one prediction covers by 0.7 together with a neighbour in the list."""
    covered = inside_pairs(pred, gold, COVERAGE_CUT, keys, split)
    o = ordered(covered, [*keys, "o_idx"], ["i_idx"], split).shift(prev={"_p": "i_idx"}, next={"_n": "i_idx"})
    together = (F.col("_p") == F.col("i_idx") - 1) | (F.col("_n") == F.col("i_idx") + 1)
    return o.df.filter(together).select(*keys, F.col("i_idx").alias("idx")).distinct()


@by_size("pred", "gold")
def split_up(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """Gold spans (keys, idx) with at least two predictions lying 0.7 inside them."""
    inside = inside_pairs(gold, pred, COVERAGE_CUT, keys, split)
    return inside.groupBy(*keys, F.col("o_idx").alias("idx")).agg(F.count("*").alias("n")).filter("n >= 2").drop("n")


@by_size("pred", "gold")
def classify(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """Gold rows with ``class``: ok, merged, split, shifted or missing.

    One interval join carries IoU and both coverages; every class is read off its rows.
    """
    keys = list(keys)
    covers, inside = iv.coverage("p0", "p1", "g0", "g1"), iv.coverage("g0", "g1", "p0", "p1")
    pairs = overlaps(pred, gold, keys, split).withColumns({"_covers": covers >= COVERAGE_CUT, "_inside": inside >= COVERAGE_CUT})
    pairs = pairs.filter(F.col("_covers") | F.col("_inside") | (F.col("iou") >= SHIFTED_CUT))
    hits = greedy(pairs.filter(F.col("iou") >= 0.5).drop("_covers", "_inside"), keys, split)
    o = ordered(pairs, [*keys, "p_idx", "_covers"], ["g_idx"], split).shift(prev={"_p": "g_idx"}, next={"_n": "g_idx"})
    together = F.col("_covers") & ((F.col("_p") == F.col("g_idx") - 1) | (F.col("_n") == F.col("g_idx") + 1))
    marks = o.df.groupBy(*keys, F.col("g_idx").alias("idx")).agg(
        F.max(together).alias("merged"), (F.count_if("_inside") >= 2).alias("split"), F.max(F.col("iou") >= SHIFTED_CUT).alias("shifted"))
    parts = [gold.select(*keys, "idx", "start_s", "end_s"), marks,
             hits.select(*keys, F.col("g_idx").alias("idx"), F.lit(True).alias("ok"))]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = union.groupBy(*keys, "idx").agg(F.max("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
                                           *(F.max(name).alias(name) for name in TAXONOMY[:-1]))
    verdict = reduce(lambda c, name: c.when(F.col(name), name), TAXONOMY[1:-1], F.when(F.col("ok"), "ok"))
    return rows.select(*keys, "idx", "start_s", "end_s", verdict.otherwise(TAXONOMY[-1]).alias("class"))


def taxonomy(classified: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of each class per group, with the group size ``n``."""
    return classified.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.avg((F.col("class") == c).cast("double")).alias(c) for c in TAXONOMY))


def by_duration(classified: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Class shares per gold-duration bucket."""
    return taxonomy(classified.withColumn("bucket", iv.taxonomy_bucket(iv.duration())), [*keys, "bucket"])
