"""Run tables people read: usage, cost, comparison across runs, dataset profiles, drill-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions import intervals as iv
from spanlake.functions.rounding import round_true
from spanlake.operators.layout import by_size, ordered
from spanlake.operators.scoring import boundary_errors, match, quantile, scopes
from spanlake.schema import DEFAULT_PRICE, RUN_KEYS

# Published list prices per million tokens (input, output).
PRICES = (
    ("gemini-3.7-flash", 0.75, 3.75),
    ("gemini-3.6-flash", 0.75, 3.75),
    ("gemini-3.5-flash", 0.75, 3.75),
    ("gemini-3.5-flash-lite", 0.30, 2.50),
    ("gemini-3.1-pro-preview", 2.00, 12.00),
    ("gemini-robotics-er-2-preview", 2.00, 10.00),
    ("gemini-2.5-flash", 0.30, 2.50),
)


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, price_in double, price_out double")


def with_prices(runs: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Token prices by exact model name, the default price otherwise. The list is a few rows."""
    prices = F.broadcast(price_table(runs.sparkSession)) if prices is None else prices
    out = runs.join(prices, "model", "left")
    return out.withColumns({"price_in": F.coalesce("price_in", F.lit(DEFAULT_PRICE[0])),
                            "price_out": F.coalesce("price_out", F.lit(DEFAULT_PRICE[1]))})


def cost(tokens_in="prompt_tokens", tokens_out="output_tokens") -> Column:
    return iv.col(tokens_in) / 1e6 * F.col("price_in") + iv.col(tokens_out) / 1e6 * F.col("price_out")


def usage(calls: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Calls, tokens, retries and calls per stage (a map) from one row per model call."""
    staged = calls.groupBy(*keys, "stage").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("prompt_tokens", "output_tokens", "retries")))
    out = staged.groupBy(*keys).agg(
        F.sum("n").alias("calls"), *(F.sum(c).alias(c) for c in ("prompt_tokens", "output_tokens", "retries")),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("by_stage"))
    return out


def run_summary(rows: DataFrame) -> DataFrame:
    """Per run: episodes, failures, video seconds of successes, tokens of every row."""
    return rows.groupBy("run").agg(
        F.count("*").alias("episodes"), F.count_if(~F.col("ok")).alias("failed"),
        F.sum(F.when(F.col("ok"), F.col("duration_s"))).alias("video_seconds"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"))


def assert_any_ok(rows: DataFrame) -> DataFrame:
    """Pass rows through; fail the job for a run in which every row failed."""
    state = rows.groupBy("run").agg(F.bool_or("ok").alias("_any"))
    checked = state.select("run", F.when(F.col("_any"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("every episode failed in run "), "run"))).alias("_fine"))
    return rows.join(checked, "run").filter("_fine").drop("_fine")


def cost_per_hour(runs: DataFrame) -> Column:
    """Cost per hour of video to 2 decimals, null without video."""
    return round_true(F.try_divide(cost(), F.nullif(F.col("video_seconds") / 3600, F.lit(0.0))), 2)


def compare(summary: DataFrame, report: DataFrame, models: DataFrame, durations: DataFrame | None = None,
            accuracy: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """One row per run: scores, short-event recall, label accuracy, cost per video hour, failures."""
    scores = report.filter(F.col("scope") == "overall").drop("scope", "episodes")
    out = with_prices(summary.join(models, "run"), prices).join(scores, "run", "left")
    if durations is not None:
        short = durations.filter((F.col("scope") == "overall") & (F.col("bucket") == "1-2"))
        out = out.join(short.select("run", F.col("recall").alias("recall_1_2")), "run", "left")
    if accuracy is not None:
        overall = accuracy.filter(F.col("scope") == "overall")
        out = out.join(overall.select("run", F.col("accuracy").alias("label_accuracy")), "run", "left")
    return out.withColumn("cost_per_video_hour", cost_per_hour(out)).drop("price_in", "price_out")


def compare_families(report: DataFrame, families: Sequence[str], metric: str = "f1") -> DataFrame:
    """Runs as rows, families as columns."""
    by = report.filter(F.col("scope") != "overall")
    return by.groupBy("run").pivot("scope", list(families)).agg(F.max(metric))


def families(*reports: DataFrame) -> DataFrame:
    """Every family that occurs in any of the reports."""
    out = reports[0].select("scope")
    for r in reports[1:]:
        out = out.union(r.select("scope"))
    return out.filter(F.col("scope") != "overall").distinct()


def dataset_profile(episodes: DataFrame, gold: DataFrame, by: str = "family") -> DataFrame:
    """Per dataset: episodes, segments per episode, median segment length, minutes of video."""
    size = episodes.groupBy(by).agg(F.count("*").alias("episodes"), (F.sum("duration_s") / 60).alias("minutes"))
    spans = gold.join(episodes.select("episode_id", by), "episode_id").withColumn("length", iv.duration())
    n = spans.groupBy(by).agg(F.count("*").alias("segments"))
    median = quantile(spans, [by], "length", 0.5, "median_segment")
    return size.join(n, by, "left").join(median, by, "left").withColumn(
        "segments_per_episode", F.coalesce("segments", F.lit(0)) / F.col("episodes"))


@by_size("gold", keys=["episode_id"])
def _covered(gold: DataFrame, split: bool | None = None) -> DataFrame:
    o = ordered(gold, ["episode_id"], ["start_s", "end_s", "idx"], split).shift(prev={"_pe": "end_s"})
    return o.df.groupBy("episode_id").agg(
        F.sum(iv.duration()).alias("_covered"), F.max("end_s").alias("_end"),
        F.bool_or(F.coalesce(F.col("start_s") > F.col("_pe"), F.lit(False))).alias("_gap"))


def coverage_profile(episodes: DataFrame, gold: DataFrame, by: str = "family", split: bool | None = None) -> DataFrame:
    """Per family: median share of an episode that gold covers, episodes with internal gaps, median
    unannotated tail."""
    rows = episodes.join(_covered(gold, split), "episode_id", "left").na.fill(0.0, ["_covered", "_end"])
    rows = rows.withColumns({"coverage": iv.ratio("_covered", "duration_s"), "tail": F.col("duration_s") - F.col("_end")})
    out = rows.groupBy(by).agg(F.count("*").alias("episodes"), F.count_if("_gap").alias("with_gaps"))
    for c in ("coverage", "tail"):
        out = out.join(quantile(rows, [by], c, 0.5, f"median_{c}"), by, "left")
    return out


def grid_quantisation(boundaries: DataFrame, by: Sequence[str] = ("run",), step: float = 0.5,
                      eps: float = 1e-6) -> DataFrame:
    """Share of boundaries lying on the sampling grid."""
    x = F.col("t") / F.lit(step)
    on = F.abs(x - F.round(x)) < eps
    return boundaries.groupBy(*by).agg(F.count("*").alias("n"), F.avg(on.cast("double")).alias("on_grid"))


def worst(counts: DataFrame, n: int = 1) -> DataFrame:
    """The n episodes with the lowest F1."""
    return counts.withColumn("f1", iv.f1("m_0_5", "n_pred", "n_gold")).orderBy("f1", *(
        c for c in RUN_KEYS if c in counts.columns)).limit(n)


@by_size("pred", "gold", keys=RUN_KEYS)
def inspect(pred: DataFrame, gold: DataFrame, split: bool | None = None) -> DataFrame:
    """Everything to look at in the given episodes, one row per item: gold spans with a match mark,
    predicted spans, and gold boundaries with their distance to the nearest prediction."""
    keys = list(RUN_KEYS)
    hit = match(pred, gold, 0.5, split=split).select(*keys, F.col("g_idx").alias("idx"), F.lit(True).alias("matched"))
    g = gold.select(*keys, "idx", "start_s", "end_s", "label").join(hit, [*keys, "idx"], "left")
    g = g.select(*keys, F.lit("gold").alias("item"), "idx", "start_s", "end_s", "label",
                 F.coalesce("matched", F.lit(False)).alias("matched"), F.lit(None).cast("double").alias("err"))
    none = F.lit(None)
    p = pred.select(*keys, F.lit("pred").alias("item"), "idx", "start_s", "end_s", "label",
                    none.cast("boolean").alias("matched"), none.cast("double").alias("err"))
    b = boundary_errors(pred, gold, split=split).filter(F.col("side") == "gold").select(
        *keys, F.lit("boundary").alias("item"), F.col("b_idx").alias("idx"), F.col("t").alias("start_s"),
        F.col("t").alias("end_s"), none.cast("string").alias("label"), none.cast("boolean").alias("matched"), "err")
    return g.unionByName(p).unionByName(b)


__all__ = ["PRICES", "price_table", "with_prices", "cost", "usage", "run_summary", "assert_any_ok",
           "cost_per_hour", "compare", "compare_families", "families", "dataset_profile", "coverage_profile",
           "grid_quantisation", "worst", "inspect", "scopes"]
