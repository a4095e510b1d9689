"""Label accuracy on temporally matched pairs, from verdicts kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.rounding import round_true
from spanlake.operators.layout import ordered
from spanlake.schema import JUDGE_BATCH, RUN_KEYS

PAIR = ("p_idx", "g_idx")


def pairs(matches: DataFrame, pred: DataFrame, gold: DataFrame, rows: DataFrame | None = None,
          keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Matched (predicted, gold) labels with IoU to 3 decimals and the episode's columns."""
    keys = list(keys)
    p = pred.select(*keys, F.col("idx").alias("p_idx"), F.col("label").alias("predicted"))
    g = gold.select(*keys, F.col("idx").alias("g_idx"), F.col("label").alias("gold"))
    out = matches.select(*keys, *PAIR, round_true("iou", 3).alias("iou"))
    out = out.join(p, [*keys, "p_idx"]).join(g, [*keys, "g_idx"])
    return out if rows is None else out.join(rows, keys)


def numbered(pair_rows: DataFrame, by: Sequence[str] = ("run",), split: bool | None = None) -> DataFrame:
    """Consecutive numbers per run, by episode and prediction."""
    return ordered(pair_rows, by, ["episode_id", "p_idx"], split).number("pair_no").df


def render_batches(pair_rows: DataFrame, size: int = JUDGE_BATCH, by: Sequence[str] = ("run",),
                   split: bool | None = None) -> DataFrame:
    """One request text per ``size`` numbered pairs: (by, batch_no, n_pairs, request)."""
    rows = numbered(pair_rows, by, split).withColumn("batch_no", F.floor(F.col("pair_no") / size))
    line = F.format_string("%d. predicted: %s\n   human: %s", "pair_no", "predicted", "gold")
    lines = F.array_sort(F.collect_list(F.struct("pair_no", line.alias("line"))))
    out = rows.groupBy(*by, "batch_no").agg(F.count("*").alias("n_pairs"), lines.alias("_l"))
    text = F.concat(F.lit("Do the two labels of each pair name the same completed event?\n"),
                    F.array_join(F.col("_l.line"), "\n"))
    return out.select(*by, "batch_no", "n_pairs", text.alias("request"))


def attach(pair_rows: DataFrame, verdicts: DataFrame, keys: Sequence[str] = (*RUN_KEYS, *PAIR),
           version: str = "seq") -> DataFrame:
    """Add same_event and note. The last verdict on a pair wins; none at all counts as wrong."""
    latest = verdicts.groupBy(*keys).agg(F.max_by(F.struct("same_event", "note"), version).alias("_v"))
    out = pair_rows.join(latest, list(keys), "left")
    return out.withColumns({
        "same_event": F.coalesce(F.col("_v.same_event"), F.lit(False)),
        "note": F.when(F.col("_v").isNull(), "no verdict returned").otherwise(F.coalesce("_v.note", F.lit("")))}).drop("_v")


def accuracy(judged: DataFrame, by: str = "family") -> DataFrame:
    """Label accuracy per run, overall and by family."""
    out = judged.rollup("run", by).agg(
        F.count("*").alias("n"), F.avg(F.col("same_event").cast("double")).alias("accuracy"),
        F.grouping_id().alias("_g")).filter("_g < 3")
    return out.select("run", F.when(F.col("_g") == 1, "overall").otherwise(F.col(by)).alias("scope"), "n",
                      round_true("accuracy", 4).alias("accuracy"))


def discordant(judged_a: DataFrame, judged_b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Items both labellings were judged on: how often only one of them was right."""
    both = judged_a.select(*on, F.col("same_event").alias("a")).join(
        judged_b.select(*on, F.col("same_event").alias("b")), list(on))
    a, b = F.col("a"), F.col("b")
    return both.agg(F.count("*").alias("n"), F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_a"),
                    F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("both_wrong"))
