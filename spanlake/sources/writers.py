"""Writers: response JSON, JSONL, CSV, message tables, run tables, normalised episodes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.schema import EPISODE_KEYS

FORMATS = ("json", "jsonl", "csv")
TOPIC_SUBTASK = "/subtask_annotation"
TOPIC_INSTRUCTION = "/instruction"
CSV_COLUMNS = ("start_seconds", "end_seconds", "label", "result", "attributes", "confidence", "flags", "description")


def _segment(rename: dict[str, str] | None = None) -> Column:
    names = {"start_s": "start_seconds", "end_s": "end_seconds"} | (rename or {})
    fields = ("start_s", "end_s", "label", "result", "attributes", "description", "confidence", "flags")
    return F.struct(*(F.col(f).alias(names.get(f, f)) for f in fields))


def responses_json(segments: DataFrame, responses: DataFrame) -> DataFrame:
    """One JSON document per episode: (episode_id, document). ``responses``: episode_id, task,
    duration_seconds, warnings, metadata (map). The document is one response, so its segments are
    gathered by definition; use ``jsonl`` where episodes have no bound."""
    listed = segments.groupBy(*EPISODE_KEYS).agg(F.array_sort(F.collect_list(
        F.struct("idx", _segment().alias("segment")))).alias("_s"))
    rows = responses.join(listed, list(EPISODE_KEYS), "left")
    items = F.coalesce(F.col("_s.segment"), F.array().cast("array<struct<start_seconds:double,end_seconds:double,label:string,"
                       "result:string,attributes:array<string>,description:string,confidence:string,flags:array<string>>>"))
    return rows.select(*EPISODE_KEYS, F.to_json(F.struct(
        "task", "duration_seconds", items.alias("segments"), "warnings", "metadata")).alias("document"))


def write_json(segments: DataFrame, responses: DataFrame, path: str) -> None:
    responses_json(segments, responses).select("document").write.mode("overwrite").text(path)


def jsonl_rows(segments: DataFrame) -> DataFrame:
    return segments.select(*EPISODE_KEYS, "idx", F.to_json(_segment()).alias("line"))


def write_jsonl(segments: DataFrame, path: str) -> None:
    """One segment per line, ordered inside each file."""
    rows = segments.sortWithinPartitions(*EPISODE_KEYS, "idx")
    rows.select(_segment().alias("s")).select("s.*").write.mode("overwrite").json(path)


def csv_rows(segments: DataFrame) -> DataFrame:
    """The fixed CSV columns, lists joined by ';'."""
    flat = segments.withColumns({c: F.concat_ws(";", c) for c in ("attributes", "flags")})
    return flat.select(F.col("start_s").alias("start_seconds"), F.col("end_s").alias("end_seconds"), *CSV_COLUMNS[2:])


def write_csv(segments: DataFrame, path: str) -> None:
    rows = segments.sortWithinPartitions(*EPISODE_KEYS, "idx")
    csv_rows(rows).write.mode("overwrite").option("header", "true").csv(path)


def write(segments: DataFrame, path: str, fmt: str, responses: DataFrame | None = None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"no writer for {fmt!r}; there are {', '.join(FORMATS)}")
    if fmt == "json":
        write_json(segments, responses, path)
    else:
        {"jsonl": write_jsonl, "csv": write_csv}[fmt](segments, path)


def to_messages(segments: DataFrame, responses: DataFrame, origin_ns: int | Column = 0) -> DataFrame:
    """Time-based messages (episode_id, topic, log_time, data): the instruction at the origin, every
    segment at its end. Times inside the payload stay episode-relative."""
    origin = F.lit(origin_ns).cast("bigint") if isinstance(origin_ns, int) else origin_ns
    first = responses.select(*EPISODE_KEYS, F.lit(TOPIC_INSTRUCTION).alias("topic"), origin.alias("log_time"),
                             F.to_json(F.struct(F.col("task").alias("instruction"), "duration_seconds", "metadata")).alias("data"))
    payload = F.to_json(_segment({"start_s": "start_time", "end_s": "end_time"}))
    rest = segments.select(*EPISODE_KEYS, F.lit(TOPIC_SUBTASK).alias("topic"),
                           (origin + (F.col("end_s") * 1e9).cast("bigint")).alias("log_time"), payload.alias("data"))
    return first.unionByName(rest)


def write_episodes(episodes: DataFrame, path: str) -> None:
    """Normalised episodes with provenance columns, partitioned by family."""
    episodes.write.mode("overwrite").partitionBy("family").parquet(path)


def provenance(episodes: DataFrame, source: str, license_name: str, annotators: str, *notes: Column) -> DataFrame:
    """Stamp source, licence, kind of annotators and joined notes."""
    return episodes.withColumns({
        "source_dataset": F.lit(source), "license": F.lit(license_name), "annotation_provenance": F.lit(annotators),
        "notes": F.concat_ws("; ", *(F.nullif(n, F.lit("")) for n in notes))})


def write_run(summary: DataFrame, rows: DataFrame, report: DataFrame, path: str) -> None:
    """A run as three tables, each partitioned by run; header fields also as one JSON column."""
    header = summary.withColumn("header", F.to_json(F.struct(*[c for c in summary.columns if c != "run"])))
    for name, df in (("runs", header), ("rows", rows), ("scores", report)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")


# Folders that the files of ``write_files`` are spread over: listed side by side, each with its share of the files.
FOLDERS = 64


def write_files(rows: DataFrame, path: str, key: str, line: Column, suffix: str) -> None:
    """One text file per value of ``key``, ``<path>/folder=<n>/<key>.<suffix>``, with a line per row, written by many tasks.

    Spark's writer needs a folder per file, writes those of one input file in one task, and on a disk it starts a process for
    the permissions of each folder, file and checksum. Here the tasks write the files themselves, under a hidden name, then
    moved, so a task that runs again leaves the same files. ``path`` lies on a disk or on a file system that Arrow knows.
    """
    sc = rows.sparkSession.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = base.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(base).toString()
    lines = rows.select(F.col(key).alias("key"), line.alias("value"), F.pmod(F.xxhash64(key), F.lit(FOLDERS)).alias("folder"))
    # Spread by number, as the rows are few bytes for the time their files take; sorted, so that those of a file follow each other.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(tasks, "key").sortWithinPartitions("key").select(
        F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("key"), "value", "folder")
    _file_system(uri)[0].create_dir(_file_system(uri)[1])
    lines.mapInArrow(_file_writer(uri, suffix), "files long").write.format("noop").mode("overwrite").save()


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return (fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _file_writer(uri: str, suffix: str):
    """The function that a task runs over lines sorted by file."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "value", "folder")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (disk, path), made, n = _file_system(uri), set(), 0
        for (folder, key), group in groupby(lines(batches), lambda x: (x[2], x[0])):
            at = f"{path}/folder={folder}"
            if folder not in made:
                disk.create_dir(at)
                made.add(folder)
            draft = f"{at}/_{key}.{suffix}"
            with disk.open_output_stream(draft) as out:
                for _, value, _ in group:
                    out.write(f"{'' if value is None else value}\n".encode())
            disk.move(draft, f"{at}/{key}.{suffix}")
            n += 1
        yield pa.record_batch({"files": pa.array([n], pa.int64())})
    return run
