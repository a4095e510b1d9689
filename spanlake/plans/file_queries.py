"""Queries over the file layouts: tables are written in each layout to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.fixtures import Tables
from spanlake.functions import intervals as iv
from spanlake.operators.layout import scratch
from spanlake.plans.registry import block, query
from spanlake.sources import readers, writers


def _item(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.alias("start_sec"), end.alias("end_sec"), label.alias("subtask"))


def _document(rows: DataFrame) -> Column:
    """All columns but the file's name as JSON."""
    return F.to_json(F.struct(*(c for c in rows.columns if c != "file")))


# ---- benchmark Parquet ----------------------------------------------------------------------------

def benchmark_path(t: Tables) -> str:
    """One row per order with its lines as nested segments; a third names its family, half has metadata."""
    key = F.col("l_orderkey")
    start, end = (F.col("l_linenumber") * 4).cast("double"), F.col("l_linenumber") * 4 + F.col("l_quantity").cast("double") / 16
    listed = t.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", _item(start, end, F.col("l_returnflag")).alias("s")))).alias("_a"))
    rows = listed.select(
        F.concat_ws("_", F.concat(F.lit("fam"), key % 4), key).alias("id"), F.concat(F.lit("order "), key).alias("instruction"),
        F.lit(None).cast("binary").alias("video"), F.col("_a.s").alias("segments"),
        F.when(key % 2 == 0, F.to_json(F.struct((key % 7).cast("string").alias("lot")))).alias("metadata"),
        F.when(key % 3 == 0, F.struct(F.lit("arm").alias("robot_family"))).alias("perception_state"))
    path = scratch(t.spark, "benchmark")
    rows.write.parquet(path)
    return path


@query("benchmark_episodes", """
SELECT DISTINCT 'fam' || (l_orderkey % 4) || '_' || l_orderkey AS episode_id, 'order ' || l_orderkey AS instruction,
       CASE WHEN l_orderkey % 3 = 0 THEN 'arm' ELSE 'fam' || (l_orderkey % 4) END AS family,
       CASE WHEN l_orderkey % 2 = 0 THEN (l_orderkey % 7)::VARCHAR END AS lot FROM lineitem""")
def benchmark_episodes(t: Tables) -> DataFrame:
    episodes, _ = readers.read_benchmark(t.spark, benchmark_path(t))
    return episodes.select("episode_id", "instruction", "family", F.try_element_at("meta", F.lit("lot")).alias("lot"))


@query("benchmark_gold", """
SELECT 'fam' || (l_orderkey % 4) || '_' || l_orderkey AS episode_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS idx,
       (l_linenumber * 4)::DOUBLE AS start_s, l_linenumber * 4 + l_quantity::DOUBLE / 16 AS end_s, l_returnflag AS label FROM lineitem""")
def benchmark_gold(t: Tables) -> DataFrame:
    return readers.read_benchmark(t.spark, benchmark_path(t))[1]


# ---- sidecar JSON ---------------------------------------------------------------------------------

def sidecar_path(t: Tables) -> str:
    """One file per supplier, segments latest first; some have none, some name no family."""
    key = F.col("s_suppkey")
    late = _item((key % 5 + 6).cast("double"), (key % 5 + 8).cast("double"), F.lit("late"))
    early = _item((key % 5).cast("double"), (key % 5 + 2).cast("double"), F.concat(F.lit("early "), key % 3))
    rows = t.raw("supplier").select(
        F.concat_ws("_", F.concat(F.lit("site"), F.col("s_nationkey")), key).alias("id"), F.col("s_name").alias("instruction"),
        F.when(key % 9 != 0, F.array(late, early)).alias("segments"), F.when(key % 2 == 0, "").otherwise("lab").alias("family"),
        key.alias("file"))
    path = scratch(t.spark, "sidecars")
    writers.write_files(rows, path, "file", _document(rows), "json")
    return path


block("""
sidecars AS (
  SELECT 'site' || s_nationkey || '_' || s_suppkey AS episode_id, s_name AS instruction, s_suppkey,
         CASE WHEN s_suppkey % 2 = 0 THEN 'site' || s_nationkey ELSE 'lab' END AS family
  FROM supplier WHERE s_suppkey % 9 <> 0)""")


@query("sidecar_episodes", "SELECT episode_id, instruction, family FROM sidecars")
def sidecar_episodes(t: Tables) -> DataFrame:
    return readers.read_sidecars(t.spark, sidecar_path(t))[0].select("episode_id", "instruction", "family")


@query("sidecar_gold", """
SELECT episode_id, 0 AS idx, (s_suppkey % 5)::DOUBLE AS start_s, (s_suppkey % 5 + 2)::DOUBLE AS end_s, 'early ' || (s_suppkey % 3) AS label FROM sidecars
UNION ALL SELECT episode_id, 1, (s_suppkey % 5 + 6)::DOUBLE, (s_suppkey % 5 + 8)::DOUBLE, 'late' FROM sidecars""")
def sidecar_gold(t: Tables) -> DataFrame:
    return readers.read_sidecars(t.spark, sidecar_path(t))[1]


# ---- run files and checkpoints --------------------------------------------------------------------

def _triple(start, end, label) -> Column:
    return F.array(F.col(start).cast("string"), F.col(end).cast("string"), F.col(label))


def run_path(t: Tables) -> str:
    """One run file per supplier: its header and a row per episode, of which the third failed."""
    key = F.col("s_suppkey")
    rows = t.raw("supplier").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.withColumns({"a": (key % 4 + F.col("n")).cast("double"), "b": (key % 4 + F.col("n") + 3).cast("double"), "l": F.lit("go")})
    row = F.struct(F.concat_ws("_", F.lit("e"), "n").alias("id"), F.concat(F.lit("f"), key % 2).alias("family"), (F.col("n") < 2).alias("ok"),
                   F.array(_triple("a", "b", "l")).alias("pred"), F.array(_triple("a", "b", "l"), _triple("b", "b", "l")).alias("gold"))
    runs = rows.groupBy("s_suppkey", "s_name").agg(F.array_sort(F.collect_list(row)).alias("rows")).select(
        F.concat(F.lit("run "), key).alias("tag"), F.col("s_name").alias("model"), F.lit(3).alias("episodes"), F.lit(1).alias("failed"),
        "rows", key.alias("file"))
    path = scratch(t.spark, "runs")
    writers.write_files(runs, path, "file", _document(runs), "json")
    return path


@query("run_headers", "SELECT 'run ' || s_suppkey AS run, s_name AS model, 3::BIGINT AS episodes, 1::BIGINT AS failed FROM supplier")
def run_headers(t: Tables) -> DataFrame:
    return readers.read_runs(t.spark, run_path(t))[0].select("run", "model", "episodes", "failed")


RUN_ROWS = """
SELECT 'run ' || s_suppkey AS run, 'e_' || n AS episode_id, 'f' || (s_suppkey % 2) AS family, n < 2 AS ok FROM supplier, unnest(range(3)) u(n)"""


@query("run_file_rows", RUN_ROWS)
def run_file_rows(t: Tables) -> DataFrame:
    return readers.read_runs(t.spark, run_path(t))[1].select("run", "episode_id", "family", "ok")


@query("split_run_rows", RUN_ROWS)
def split_run_rows(t: Tables) -> DataFrame:
    """The same files through the reader that divides a document among tasks."""
    return readers.read_large_runs(t.spark, run_path(t))[1].select("run", "episode_id", "family", "ok")


RUN_SPANS = """
SELECT 'pred' AS side, 'run ' || s_suppkey AS run, 'e_' || n AS episode_id, 0 AS idx, (s_suppkey % 4 + n)::DOUBLE AS start_s,
       (s_suppkey % 4 + n + 3)::DOUBLE AS end_s, 'go' AS label FROM supplier, unnest(range(3)) u(n)
UNION ALL SELECT 'gold', 'run ' || s_suppkey, 'e_' || n, i, (s_suppkey % 4 + n + i * 3)::DOUBLE, (s_suppkey % 4 + n + 3)::DOUBLE, 'go'
FROM supplier, unnest(range(3)) u(n), unnest(range(2)) v(i)"""


@query("run_file_spans", RUN_SPANS)
def run_file_spans(t: Tables) -> DataFrame:
    _, _, pred, gold = readers.read_runs(t.spark, run_path(t))
    return pred.select(F.lit("pred").alias("side"), "*").unionByName(gold.select(F.lit("gold").alias("side"), "*"))


@query("split_run_spans", RUN_SPANS)
def split_run_spans(t: Tables) -> DataFrame:
    _, _, pred, gold = readers.read_large_runs(t.spark, run_path(t))
    return pred.select(F.lit("pred").alias("side"), "*").unionByName(gold.select(F.lit("gold").alias("side"), "*"))


@query("media_inventory", """
SELECT s_suppkey, length(s_name) * (s_suppkey % 5 + 1) + 1 AS length FROM supplier WHERE length(s_name) * (s_suppkey % 5 + 1) + 1 <= 60""")
def media_inventory(t: Tables) -> DataFrame:
    """One file per supplier, some too large; only names and sizes are read."""
    body = F.repeat("s_name", (F.col("s_suppkey") % 5 + 1).cast("int"))
    path = scratch(t.spark, "media")
    writers.write_files(t.raw("supplier"), path, "s_suppkey", body, "txt")
    found = readers.video_inventory(t.spark, path, 60, "txt")
    return found.select(F.col("stem").cast("long").alias("s_suppkey"), "length")


@query("checkpoint_rows", """
SELECT 'e' || o_orderkey AS id, o_orderkey % 5 = 0 OR o_orderkey % 4 <> 0 AS ok,
       CASE WHEN o_orderkey % 5 = 0 THEN 1.5::DOUBLE ELSE (o_orderkey % 11)::DOUBLE END AS elapsed FROM orders""")
def checkpoint_rows(t: Tables) -> DataFrame:
    """Resume: a first file of attempts, a later one that repeats every fifth, blank lines in both."""
    key = F.col("o_orderkey")
    ids = F.concat(F.lit("e"), key).alias("id")
    first = t.raw("orders").select(F.to_json(F.struct(ids, (key % 4 != 0).alias("ok"), (key % 11).cast("double").alias("elapsed"))).alias("line"), key)
    again = t.raw("orders").filter(key % 5 == 0).select(F.to_json(F.struct(ids, F.lit(True).alias("ok"), F.lit(1.5).alias("elapsed"))).alias("line"), key)
    path = scratch(t.spark, "checkpoint")
    for rows in (first, again):
        lines = rows.select(F.explode(F.when(key % 6 == 0, F.array(F.lit(""), "line")).otherwise(F.array("line"))).alias("value"))
        lines.write.mode("append").text(path)
    return readers.read_checkpoint(t.spark, path).select("id", "ok", "elapsed")


# ---- written tables -------------------------------------------------------------------------------

@query("written_episodes", """
SELECT episode_id, family, instruction, duration_s, 'recorder' AS source_dataset, 'CC-BY-4.0' AS license, 'people' AS annotation_provenance,
       CASE WHEN episode_id % 2 = 0 THEN 'short' || CASE WHEN episode_id % 3 = 0 THEN '; checked' ELSE '' END
            WHEN episode_id % 3 = 0 THEN 'checked' ELSE '' END AS notes FROM episodes""")
def written_episodes(t: Tables) -> DataFrame:
    e = F.col("episode_id")
    rows = writers.provenance(t.episodes, "recorder", "CC-BY-4.0", "people", F.when(e % 2 == 0, "short").otherwise(""),
                              F.when(e % 3 == 0, "checked"))
    path = scratch(t.spark, "episodes")
    writers.write_episodes(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query("written_runs", """
SELECT r.run, r.episode_id, r.ok, r.duration_s, s.n_ok, s.n_ok AS n_ok_in_header FROM run_rows r
JOIN (SELECT run, count(*) FILTER (ok) AS n_ok FROM run_rows GROUP BY run) s USING (run)""")
def written_runs(t: Tables) -> DataFrame:
    """A run as header, row and score tables, joined again after reading."""
    rows = t.run_rows
    scores = rows.groupBy("run").agg(F.count_if("ok").alias("n_ok"))
    path = scratch(t.spark, "run-tables")
    writers.write_run(scores, rows, scores, path)
    read = {n: t.spark.read.parquet(f"{path}/{n}") for n in ("runs", "rows", "scores")}
    header = read["runs"].select("run", F.get_json_object("header", "$.n_ok").cast("long").alias("n_ok_in_header"))
    # Two rows per run table here: the run list is as long as the number of runs, never of episodes.
    return (read["rows"].select("run", "episode_id", "ok", "duration_s").join(read["scores"].select("run", "n_ok"), "run")
            .join(header, "run"))


@query("valid_spans", """
SELECT run, episode_id, idx, s AS start_s, e AS end_s, e >= s AS valid, CASE WHEN e >= s THEN e - s END AS length FROM (
  SELECT run, episode_id, idx, start_s AS s, CASE WHEN idx % 7 = 3 THEN start_s - 0.5 WHEN idx % 11 = 5 THEN start_s ELSE end_s END AS e FROM pred)""")
def valid_spans(t: Tables) -> DataFrame:
    """Spans that end before they start set apart, the rest asserted and measured."""
    i = F.col("idx")
    end = F.when(i % 7 == 3, F.col("start_s") - 0.5).when(i % 11 == 5, F.col("start_s")).otherwise(F.col("end_s"))
    good, bad = iv.split_ordered(t.pred().select("run", "episode_id", "idx", "start_s", end.alias("end_s")))
    good = iv.assert_ordered(good).withColumns({"valid": F.lit(True), "length": iv.duration()})
    return good.unionByName(bad.withColumns({"valid": F.lit(False), "length": F.lit(None).cast("double")}))
