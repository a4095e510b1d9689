"""Readers: benchmark Parquet, sidecar JSON, run files, checkpoints, video inventory.

Every reader states its schema; nothing is inferred. Large binary columns are never selected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake import schema
from spanlake.operators.ingest import family_from_id
from spanlake.sources.documents import read_records

VIDEO_LIMIT = 2 * 1024 ** 3
UPLOAD_LIMIT = 200 * 1024 ** 2


def _family(given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), family_from_id("id")).alias("family")


def _gold(rows: DataFrame, segments: Column) -> DataFrame:
    return rows.select(F.col("id").alias("episode_id"), F.posexplode(segments).alias("idx", "s")).select(
        "episode_id", F.col("idx").cast("long").alias("idx"), F.col("s.start_sec").alias("start_s"),
        F.col("s.end_sec").alias("end_s"), F.col("s.subtask").alias("label"))


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(episodes, gold) from benchmark Parquet; the embedded video is not read. Segments keep their
    stored order, the family falls back to the id's prefix, metadata becomes a string map."""
    raw = spark.read.schema(schema.BENCHMARK).parquet(path)
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    episodes = raw.select(F.col("id").alias("episode_id"), "instruction", _family(F.col("perception_state.robot_family")),
                          meta.alias("meta"))
    return episodes, _gold(raw, F.col("segments"))


def video_inventory(spark: SparkSession, path: str, max_bytes: int = VIDEO_LIMIT, suffix: str = "mp4") -> DataFrame:
    """(path, stem, length) of the recordings up to ``max_bytes``; contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true")
             .load(path).select("path", "length"))
    return files.filter(F.col("length") <= max_bytes).withColumn("stem", F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1))


def read_sidecars(spark: SparkSession, path: str, videos: DataFrame | None = None,
                  family: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, gold) from one JSON file per episode. Files without segments are skipped; with
    ``videos`` (column stem), so are episodes without a video of the file's name. Gold is ordered by
    start time."""
    raw = spark.read.schema(schema.SIDECAR).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    raw = raw.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    raw = raw.filter(F.col("segments").isNotNull()).withColumn("family", _family(F.col("family")))
    if family is not None:
        raw = raw.filter(F.col("family") == family)
    if videos is not None:
        raw = raw.join(videos.select("stem"), "stem", "left_semi")
    episodes = raw.select(F.col("id").alias("episode_id"), F.coalesce("instruction", F.lit("")).alias("instruction"),
                          "family", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("meta"))
    # Stable sort by start: position breaks ties.
    keyed = F.transform("segments", lambda s, i: F.struct(s["start_sec"].alias("start_sec"), i.alias("i"), s["end_sec"].alias("end_sec"),
                                                          s["subtask"].alias("subtask")))
    return episodes, _gold(raw, F.array_sort(keyed))


def triples(c) -> Column:
    """[[start, end, label], ...] as text to (start_s, end_s, label) structs."""
    return F.transform(c, lambda t: F.struct(F.try_element_at(t, F.lit(1)).cast("double").alias("start_s"), F.try_element_at(t, F.lit(2)).cast("double").alias("end_s"),
                                             F.try_element_at(t, F.lit(3)).alias("label")))


def spans_of(rows: DataFrame, c: str) -> DataFrame:
    return rows.select("run", "episode_id", F.posexplode(triples(c)).alias("idx", "s")).select(
        "run", "episode_id", F.col("idx").cast("long").alias("idx"), "s.*")


def read_runs(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, rows, pred, gold) from run files: header, one row per episode, and the two span lists."""
    raw = spark.read.schema(schema.RUN_FILE).option("multiLine", "true").json(paths)
    runs = raw.drop("rows").withColumnRenamed("tag", "run")
    rows = raw.select(F.col("tag").alias("run"), F.explode("rows").alias("r")).select("run", "r.*")
    rows = rows.withColumnRenamed("id", "episode_id").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return runs, rows.drop("pred", "gold"), spans_of(rows, "pred"), spans_of(rows, "gold")


def read_large_runs(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``read_runs`` for run files of any size: each is read by many tasks (``documents.read_records``)."""
    header = T.StructType([f for f in schema.RUN_FILE.fields if f.name != "rows"])
    heads, records = read_records(spark, paths, "rows", schema.RUN_ROW, header)
    runs = heads.withColumnRenamed("tag", "run")
    rows = records.join(runs.select("file", "run"), "file").drop("file", "pos")  # one header a file
    rows = rows.withColumnRenamed("id", "episode_id").withColumn("ok", F.coalesce("ok", F.lit(False)))
    rows = rows.select("run", *(c for c in rows.columns if c != "run"))
    return runs.drop("file"), rows.drop("pred", "gold"), spans_of(rows, "pred"), spans_of(rows, "gold")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """JSONL checkpoint rows; blank lines are skipped and the last row of an id wins.

    A row's ``seq``, where it has one, tells which is the last, so copied or restored files change nothing. Others are older than
    any with a number; file time, file name and byte block order them, and inside a file the reader's row order."""
    numbered = T.StructType([*schema.RUN_ROW.fields, T.StructField("seq", T.LongType())])
    raw = spark.read.schema(numbered).json(path).filter(F.col("id").isNotNull())
    raw = raw.withColumn("_at", F.struct(F.col("seq"), F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"),
                                         F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    names = [c for c in raw.columns if c not in ("id", "seq", "_at")]
    last = raw.groupBy("id").agg(F.max_by(F.struct(*names), "_at").alias("_r"))
    return last.select("id", "_r.*")


def pending(episodes: DataFrame, checkpoint: DataFrame, key: str = "episode_id") -> DataFrame:
    """Episodes without a finished row."""
    done = checkpoint.select(F.col("id").alias(key)) if "id" in checkpoint.columns else checkpoint.select(key)
    return episodes.join(done, key, "left_anti")


def select_episodes(episodes: DataFrame, family: str | None = None, ids: Sequence[str] | None = None,
                    limit: int | None = None, any_order: bool = False) -> DataFrame:
    """Filter by family or ids; the first ``limit`` by id. With ``any_order`` any ``limit`` of them will do, and reading
    stops once they are found."""
    if family is not None:
        episodes = episodes.filter(F.col("family") == family)
    if ids is not None:
        episodes = episodes.filter(F.col("episode_id").isin(*ids))
    if limit is None:
        return episodes
    return episodes.limit(limit) if any_order else episodes.orderBy("episode_id").limit(limit)


def successful(rows: DataFrame) -> DataFrame:
    return rows.filter("ok")
