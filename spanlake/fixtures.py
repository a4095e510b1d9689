"""Span tables derived from the driver's Parquet tables: one user is one episode.

Times stay integer milliseconds until the last step, so every engine produces the same doubles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.layout import SPLIT_ROWS, needs_split, ordered

# run -> (boundary events dropped where event_id % n = 0, jitter range, jitter offset in ms)
RUNS = {"a": (7, 1001, 500), "b": (4, 1801, 900)}
OK_RULE = {"a": 17, "b": 19}
WALL_US_PER_MS = 9_000_000


def seconds(ms) -> F.Column:
    return F.col(ms) / 1000.0 if isinstance(ms, str) else ms / 1000.0


class Tables:
    """Lazily built fixture tables for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, split: bool | None = None):
        self.spark, self.sf_dir, self._split = spark, sf_dir, split
        self._pred: dict[tuple[str, ...], DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def split(self) -> bool | None:
        """Measured once on the base table; derived tables hold at most twice its rows per episode. None if some episode is
        large: operators then divide large from small ones themselves."""
        if self._split is not None:
            return self._split
        return None if needs_split(self.raw("events"), ["user_id"], SPLIT_ROWS // 2) else False

    @cached_property
    def order_split(self) -> bool | None:
        """The same for tables keyed by order; sessions hold three rows per order line."""
        if self._split is not None:
            return self._split
        return None if needs_split(self.raw("lineitem"), ["l_orderkey"], SPLIT_ROWS // 3) else False

    @cached_property
    def timed(self) -> DataFrame:
        """events as (episode_id, event_id, event_type, value, idx, t_ms, next_ms)."""
        ev = self.raw("events").select(
            F.col("user_id").alias("episode_id"), "event_id", "event_type", "value",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        o = ordered(ev, ["episode_id"], ["us", "event_id"], self.split)
        o = o.total({"us0": ("min", "us")})
        o = o.with_columns({"t_ms": ((F.col("us") - F.col("us0")) / WALL_US_PER_MS).cast("long")})
        o = o.shift(next={"next_ms": "t_ms"}).number("idx")
        return o.df.drop("us", "us0")

    @cached_property
    def episodes(self) -> DataFrame:
        return (self.timed.groupBy("episode_id")
                .agg(((F.max("t_ms") + 1000) / 1000.0).alias("duration_s"))
                .select("episode_id", family(), F.concat(F.lit("episode "), "episode_id").alias("instruction"),
                        "duration_s"))

    @cached_property
    def gold(self) -> DataFrame:
        return (self.timed.filter(F.col("next_ms").isNotNull())
                .select("episode_id", "idx", seconds("t_ms").alias("start_s"),
                        seconds("next_ms").alias("end_s"), F.col("event_type").alias("label")))

    def boundaries(self, *runs: str) -> DataFrame:
        """Jittered boundaries of the runs, from one read: kept events plus some midpoints."""
        middle = (F.col("event_id") % 11 == 0) & F.col("next_ms").isNotNull()
        half = ((F.col("t_ms") + F.col("next_ms")) / 2).cast("long")
        marks = []
        for run in runs:
            drop, width, offset = RUNS[run]
            jitter = (F.col("event_id") * 37) % width - offset
            kept = (F.col("idx") == 0) | (F.col("event_id") % drop != 0)
            at = F.when(F.col("idx") == 0, F.col("t_ms")).otherwise(
                F.greatest(F.lit(0).cast("long"), F.col("t_ms") + jitter))
            marks += [F.when(kept, F.struct(F.lit(run).alias("run"), at.alias("b_ms"), F.lit(0).alias("part"),
                                            F.col("event_type").alias("label"))),
                      F.when(middle, F.struct(F.lit(run).alias("run"), half.alias("b_ms"), F.lit(1).alias("part"),
                                              F.concat("event_type", F.lit("_part")).alias("label")))]
        return (self.timed.select("episode_id", "event_id", "value", F.explode(F.array_compact(F.array(*marks))).alias("m"))
                .select("m.run", "episode_id", "event_id", "value", "m.b_ms", "m.part", "m.label"))

    def pred_ms(self, *runs: str) -> DataFrame:
        """Predicted spans in milliseconds, zero-length ones dropped."""
        if runs not in self._pred:
            o = ordered(self.boundaries(*runs), ["run", "episode_id"], ["b_ms", "event_id", "part"], self.split)
            self._pred[runs] = o.shift(next={"e_ms": "b_ms"}).where(F.col("e_ms") > F.col("b_ms")).number("idx").df
        return self._pred[runs]

    def pred(self, *runs: str) -> DataFrame:
        return self.pred_ms(*(runs or tuple(RUNS))).select(
            "run", "episode_id", "idx", seconds("b_ms").alias("start_s"),
            seconds("e_ms").alias("end_s"), "label")

    @cached_property
    def run_rows(self) -> DataFrame:
        """One row per (run, episode): outcome, length and token use."""
        base = self.timed.groupBy("episode_id").agg(
            F.count("*").alias("n"), ((F.max("t_ms") + 1000) / 1000.0).alias("duration_s"))
        rule = F.create_map(*[F.lit(x) for kv in OK_RULE.items() for x in kv])
        return (base.withColumn("run", F.explode(F.array(*map(F.lit, RUNS))))
                .select("run", "episode_id", family(),
                        (F.col("episode_id") % rule[F.col("run")] != 0).alias("ok"), "duration_s",
                        (F.col("n") * 1200).alias("prompt_tokens"), (F.col("n") * 90).alias("output_tokens")))

    def scored(self, *runs: str) -> DataFrame:
        """(run, episode_id, family) of the successful rows."""
        rows = self.run_rows.filter("ok")
        if runs:
            rows = rows.filter(F.col("run").isin(*runs))
        return rows.select("run", "episode_id", "family")

    def gold_of(self, *runs: str) -> DataFrame:
        """Gold spans once per run."""
        return self.gold.withColumn("run", F.explode(F.array(*map(F.lit, runs or tuple(RUNS)))))


def family() -> F.Column:
    return F.concat(F.lit("fam_"), F.col("episode_id") % 3).alias("family")


# ---- the same derivations as SQL text, for checking ---------------------------------------------

def _run_sql(run: str) -> str:
    drop, width, offset = RUNS[run]
    return f"""
marks_{run} AS (
  SELECT '{run}' AS run, episode_id, event_id, value, event_type AS label, 0 AS part,
         CASE WHEN idx = 0 THEN t_ms ELSE greatest(0, t_ms + (event_id*37) % {width} - {offset}) END AS b_ms
  FROM timed WHERE idx = 0 OR event_id % {drop} <> 0
  UNION ALL
  SELECT '{run}', episode_id, event_id, value, event_type || '_part', 1, (t_ms + next_ms) // 2
  FROM timed WHERE event_id % 11 = 0 AND next_ms IS NOT NULL)"""


SQL = f"""
raw_timed AS (
  SELECT user_id AS episode_id, event_id, event_type, value, epoch_us(ts) AS us,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // {WALL_US_PER_MS} AS t_ms
  FROM events),
timed AS (
  SELECT *, lead(t_ms) OVER w AS next_ms, row_number() OVER w - 1 AS idx
  FROM raw_timed WINDOW w AS (PARTITION BY episode_id ORDER BY us, event_id)),
episodes AS (
  SELECT episode_id, 'fam_' || (episode_id % 3) AS family, 'episode ' || episode_id AS instruction,
         (max(t_ms) + 1000) / 1000.0::DOUBLE AS duration_s
  FROM timed GROUP BY episode_id),
gold AS (
  SELECT episode_id, idx, t_ms / 1000.0::DOUBLE AS start_s, next_ms / 1000.0::DOUBLE AS end_s,
         event_type AS label
  FROM timed WHERE next_ms IS NOT NULL),{_run_sql('a')},{_run_sql('b')},
marks AS (SELECT * FROM marks_a UNION ALL SELECT * FROM marks_b),
pred_ms AS (
  SELECT run, episode_id, event_id, value, label, part, b_ms, e_ms,
         row_number() OVER (PARTITION BY run, episode_id ORDER BY b_ms, event_id, part) - 1 AS idx
  FROM (SELECT *, lead(b_ms) OVER (PARTITION BY run, episode_id ORDER BY b_ms, event_id, part) AS e_ms FROM marks)
  WHERE e_ms > b_ms),
pred AS (
  SELECT run, episode_id, idx, b_ms / 1000.0::DOUBLE AS start_s, e_ms / 1000.0::DOUBLE AS end_s, label
  FROM pred_ms),
run_rows AS (
  SELECT r.run, episode_id, 'fam_' || (episode_id % 3) AS family, episode_id % r.m <> 0 AS ok,
         (max(t_ms) + 1000) / 1000.0::DOUBLE AS duration_s,
         count(*) * 1200 AS prompt_tokens, count(*) * 90 AS output_tokens
  FROM timed, (VALUES ('a', 17), ('b', 19)) r(run, m) GROUP BY ALL),
scored AS (SELECT run, episode_id, family FROM run_rows WHERE ok)"""
