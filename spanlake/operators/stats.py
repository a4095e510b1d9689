"""Is the difference between two runs real? Paired comparison and bootstrap over per-episode counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import intervals as iv
from spanlake.operators.layout import SPLIT_ROWS, durable, ordered
from spanlake.operators.scoring import COUNT_COLUMNS, quantile, report, tag
from spanlake.schema import ALPHA, BOOTSTRAP, SEED, TOLERANCES

# Rows of the paired table that may be broadcast: about 200 bytes each.
BROADCAST_ROWS = 200_000

SUMS = ["n_pred", "n_gold", "m_0_5", "m_snapped", "b_total"] + [f"b_hit_{tag(t)}" for t in TOLERANCES]


def paired_ids(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Episodes that succeeded in both runs."""
    ok = rows.filter("ok")
    return ok.filter(F.col("run") == a).select("episode_id").intersect(
        ok.filter(F.col("run") == b).select("episode_id"))


def paired(counts: DataFrame, a: str, b: str, columns: Sequence[str] = SUMS) -> DataFrame:
    """One row per episode both runs were scored on: a_<column>, b_<column>. One pass over the counts;
    an episode contributes at most one row per run."""
    sides = [F.max(F.when(F.col("run") == run, F.col(c))).alias(f"{p}_{c}") for p, run in (("a", a), ("b", b)) for c in columns]
    both = counts.filter(F.col("run").isin(a, b)).groupBy("episode_id").agg(F.count("*").alias("_n"), *sides)
    return both.filter(F.col("_n") == 2).drop("_n")


def _metrics(p: str) -> dict[str, Column]:
    out = {"f1": iv.f1(f"{p}_m_0_5", f"{p}_n_pred", f"{p}_n_gold"),
           "f1_snapped": iv.f1(f"{p}_m_snapped", f"{p}_n_pred", f"{p}_n_gold")}
    out |= {f"boundary_recall_{tag(t)}": iv.ratio(f"{p}_b_hit_{tag(t)}", f"{p}_b_total") for t in TOLERANCES}
    return out


METRICS = ["f1", "f1_snapped", *(f"boundary_recall_{tag(t)}" for t in TOLERANCES)]


def draw(b: Column, j: Column, n: Column, seed: int) -> Column:
    """Pseudo-random index in [0, n) for draw j of resample b; the same in any engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), b.cast("string"), F.lit(":"), j.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def poisson_steps() -> list[float]:
    """Values of the Poisson(1) distribution function at 0, 1, ..., 16."""
    out, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 18):
        total += p
        out.append(total)
        p /= k
    return out


def _uniform(b: Column, key: Column, seed: int) -> Column:
    """Number in [0, 1) from a hash; the same in any engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), b.cast("string"), F.lit(":"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _poisson(u: Column) -> Column:
    """Poisson(1) weight of a uniform number, by inverting the distribution function."""
    return reduce(lambda x, y: x + y, [(u >= t).cast("long") for t in poisson_steps()])


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def resample(pairs: DataFrame, n_boot: int = BOOTSTRAP, seed: int = SEED, method: str = "index",
             n: int | None = None, split: bool | None = None) -> DataFrame:
    """Summed counts of every resample, one row per ``b``; both runs share the drawn episodes.

    ``index`` draws n episodes with replacement. The paired table is broadcast when it is known to be
    small and joined by shuffle on the drawn number otherwise. ``poisson`` weights each episode
    independently: no join at all, for corpora where drawing n rows per resample is too much; its
    intervals agree statistically, not digit by digit. ``vectors`` counts episodes with equal counts once
    (``_by_vectors``): the distribution of ``index`` at the cost of the different ones. In every form sums combine before the shuffle.
    """
    columns = [c for c in pairs.columns if c != "episode_id"]
    boots = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))
    if method == "poisson":
        # A column of its own and no filter on the weight: either would hash a row once for every step of the distribution.
        rows = _spread(pairs).withColumn("b", boots).withColumn("_u", _uniform(F.col("b"), F.col("episode_id"), seed))
        rows = rows.withColumn("_w", _poisson(F.col("_u")))
        sums = rows.groupBy("b").agg(*(F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns), F.sum("_w").alias("_drawn"))
        return sums.filter("_drawn > 0").drop("_drawn")
    if method == "vectors":
        return _by_vectors(pairs, columns, n_boot, seed)
    if method != "index":
        raise ValueError(f"unknown resampling method {method!r}")
    if n is None:
        n = pairs.count()
    # All episodes are one group here, so their number decides, whatever the rows of an episode say.
    numbered = ordered(pairs.withColumn("_all", F.lit(0)), ["_all"], ["episode_id"],
                       n > SPLIT_ROWS or bool(split)).number("_j").df.drop("_all")
    # A few rows per task become thousands each: spread them before they multiply. A draw is never null; saying so keeps the
    # join from testing it, which would hash every draw twice.
    at = F.coalesce(draw(F.col("b"), F.col("_j"), F.lit(n).cast("long"), seed), F.lit(0).cast("long"))
    draws = _spread(numbered.select("_j")).withColumn("b", boots).select("b", at.alias("_j"))
    drawn = numbered.drop("episode_id")
    # Beyond the limit a partition's part of the table is hashed, so the draws are moved but not sorted.
    drawn = F.broadcast(drawn) if n <= BROADCAST_ROWS else drawn.hint("shuffle_hash")
    return draws.join(drawn, "_j").groupBy("b").agg(*(F.sum(c).alias(c) for c in columns))


# Different count vectors in one draw.
CHUNK_VECTORS = 20_000


def _by_vectors(pairs: DataFrame, columns: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Drawing n episodes with replacement gives every different count vector a multinomial number of copies, so episodes
    need not be told apart. The draw splits: first among chunks of vectors, by how many episodes each chunk has, then
    within each chunk, where a task draws all resamples of its vectors. No task holds all vectors, none are broadcast,
    and what leaves a chunk is one row of sums per resample."""
    vectors = pairs.groupBy(*columns).agg(F.count("*").alias("_m")).withColumn("_key", F.xxhash64(*columns))
    n_chunks = max(1, -(-vectors.count() // CHUNK_VECTORS))
    vectors = durable(vectors.withColumn("_chunk", F.pmod("_key", F.lit(n_chunks))))
    sizes = sorted((r._chunk, r.m) for r in vectors.groupBy("_chunk").agg(F.sum("_m").alias("m")).collect())  # one row a chunk
    total = sum(m for _, m in sizes)
    if not total:
        return pairs.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("b"), *(F.lit(None).cast("long").alias(c) for c in columns))
    chunks = [c for c, _ in sizes]
    share = np.array([m for _, m in sizes], float) / total

    def drawn(group: pa.Table) -> pa.Table:
        chunk = group.column("_chunk")[0].as_py()
        order = np.lexsort([group.column(c).to_numpy() for c in (*columns, "_key")])
        counts = np.stack([group.column(c).to_numpy()[order] for c in columns])
        m = group.column("_m").to_numpy()[order]
        sums = np.empty((n_boot, len(columns)), np.int64)
        for b in range(n_boot):
            # Every chunk draws the same split of the episodes among chunks, then its own part of it.
            here = np.random.default_rng([seed, b]).multinomial(total, share)[chunks.index(chunk)]
            sums[b] = counts @ np.random.default_rng([seed, b, chunk]).multinomial(here, m / m.sum())
        return pa.table({"b": np.arange(n_boot, dtype=np.int32), **{c: sums[:, k] for k, c in enumerate(columns)}})

    schema = ", ".join(["b int", *(f"{c} long" for c in columns)])
    return vectors.groupBy("_chunk").applyInArrow(drawn, schema).groupBy("b").agg(*(F.sum(c).alias(c) for c in columns))


def deltas(sums: DataFrame) -> DataFrame:
    """Metric differences b - a of every resample in long form: (b, metric, delta)."""
    a, b = _metrics("a"), _metrics("b")
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), (b[m] - a[m]).alias("delta")) for m in a))
    return sums.select("b", F.explode(parts).alias("_m")).select("b", "_m.*")


def ci(df: DataFrame, by: Sequence[str], value: str, n: int, alpha: float = ALPHA) -> DataFrame:
    """Percentile interval by 0-based ranks int(n*alpha/2) and min(n-1, int(n*(1-alpha/2))) over the
    ``n`` resamples of each group."""
    low, high = int(n * alpha / 2), min(n - 1, int(n * (1 - alpha / 2)))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = df.withColumn("_r", F.row_number().over(w) - 1)
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_r") == low, F.col(value))).alias("ci_low"),
                                   F.max(F.when(F.col("_r") == high, F.col(value))).alias("ci_high"),
                                   F.avg((F.col(value) > 0).cast("double")).alias("p_positive"))


def significance(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def paired_bootstrap(counts: DataFrame, a: str, b: str, n_boot: int = BOOTSTRAP, seed: int = SEED,
                     alpha: float = ALPHA, method: str = "index", split: bool | None = None) -> DataFrame:
    """Pooled metrics of two runs on their common episodes with bootstrap intervals of the difference:
    (metric, a, b, delta, ci_low, ci_high, p_positive, significant)."""
    # One small row per episode, read several times below: computed once.
    pairs = durable(paired(counts, a, b))
    sums = resample(pairs, n_boot, seed, method, split=split)
    intervals = significance(ci(deltas(sums), ["metric"], "delta", n_boot, alpha))
    pooled = pairs.agg(*(F.sum(c).alias(c) for c in pairs.columns if c != "episode_id"))
    ma, mb = _metrics("a"), _metrics("b")
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), ma[m].alias("a"), mb[m].alias("b")) for m in ma))
    point = pooled.select(F.explode(parts).alias("_m")).select("_m.*", (F.col("_m.b") - F.col("_m.a")).alias("delta"))
    return point.join(intervals, "metric")


def replicated(first: DataFrame, second: DataFrame) -> DataFrame:
    """A change counts as replicated when it is significant with the same sign in both comparisons."""
    both = first.select("metric", F.col("delta").alias("delta_1"), F.col("significant").alias("_s1")).join(
        second.select("metric", F.col("delta").alias("delta_2"), F.col("significant").alias("_s2")), "metric")
    same = F.signum("delta_1") == F.signum("delta_2")
    return both.select("metric", "delta_1", "delta_2", (F.col("_s1") & F.col("_s2") & same).alias("replicated"))


def paired_report(counts: DataFrame, a: str, b: str, by: str | None = "family",
                  errors: DataFrame | None = None) -> DataFrame:
    """Long comparison on the common episodes: (scope, metric, a, b, delta)."""
    # At most two rows share an episode here.
    both = counts.filter(F.col("run").isin(a, b)).withColumn("_n", F.count("*").over(Window.partitionBy("episode_id")))
    both = both.filter(F.col("_n") == 2).drop("_n")
    if errors is not None:
        errors = errors.join(both.select("run", "episode_id"), ["run", "episode_id"], "left_semi")
    wide = report(both, by, errors)
    metrics = [c for c in wide.columns if c not in ("run", "scope")]
    long = wide.select("run", "scope", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(
        ["run", "scope"], metrics, "metric", "value")
    out = long.groupBy("scope", "metric").agg(F.max(F.when(F.col("run") == a, F.col("value"))).alias("a"),
                                              F.max(F.when(F.col("run") == b, F.col("value"))).alias("b"))
    return out.withColumn("delta", F.col("b") - F.col("a"))


def delta_summary(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Per-episode F1 changes above 1e-9: how many, and median, mean and largest size."""
    pairs = paired(counts, a, b, ["m_0_5", "n_pred", "n_gold"])
    d = pairs.select(F.lit(0).alias("_all"), (iv.f1("b_m_0_5", "b_n_pred", "b_n_gold")
                                              - iv.f1("a_m_0_5", "a_n_pred", "a_n_gold")).alias("d"))
    d = d.withColumn("size", F.when(F.abs("d") > 1e-9, F.abs("d")))
    sums = d.groupBy("_all").agg(F.count("*").alias("n"), F.count("size").alias("changed"),
                                 F.avg("size").alias("mean_abs"), F.max("size").alias("max_abs"))
    return sums.join(quantile(d, ["_all"], "size", 0.5, "median_abs"), "_all", "left").select(
        "n", "changed", "median_abs", "mean_abs", "max_abs")
