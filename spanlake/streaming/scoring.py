"""Incremental scoring: results are scored as files arrive, and a killed run resumes where it was."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spanlake import schema
from spanlake.operators.layout import durable
from spanlake.operators.scoring import COUNT_COLUMNS, episode_counts, pooled_columns
from spanlake.sources.readers import spans_of
from spanlake.streaming.batches import Batches

COUNTS_SCHEMA = T.StructType([T.StructField("run", T.StringType()), T.StructField("episode_id", T.StringType()),
                              T.StructField("family", T.StringType()),
                              *(T.StructField(c, T.LongType()) for c in COUNT_COLUMNS),
                              T.StructField("ok", T.BooleanType()), T.StructField("seq", T.LongType()), T.StructField("written", T.LongType()),
                              T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
                              T.StructField("place", T.LongType())])
# A row's own sequence number, where it has one, tells newer from older; the file's time and place do otherwise.
ORDER = ("seq", "written", "file", "block", "place")


def with_file(rows: DataFrame) -> DataFrame:
    """Add when and where a row was written: file time in microseconds, file name and block."""
    return rows.select("*", F.unix_micros("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_name").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"))


def row_schema() -> T.StructType:
    return T.StructType([T.StructField("run", T.StringType()), T.StructField("seq", T.LongType()), *schema.RUN_ROW.fields])


def stream_rows(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Result rows (JSONL, with a ``run`` field) as they arrive, with their files."""
    return with_file(spark.readStream.schema(row_schema()).option("maxFilesPerTrigger", max_files)
                      .option("pathGlobFilter", "*.jsonl").json(path))


def batch_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same rows, all at once."""
    return with_file(spark.read.schema(row_schema()).option("pathGlobFilter", "*.jsonl").json(path))


def latest(rows: DataFrame, keys=("run", "episode_id")) -> DataFrame:
    """The last written row of every episode, whether it succeeded or not."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*ORDER)).alias("r")).select(*keys, "r.*")


def score_rows(rows: DataFrame, split: bool | None = None) -> DataFrame:
    """Per-episode counts with their order; the last row of an episode wins, by file and then by the reader's row
    order. A failed row has null counts, so that it also replaces an earlier success."""
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.lit(None).cast("long"))
    last = latest(rows.withColumnRenamed("id", "episode_id").withColumns({
        "ok": F.coalesce("ok", F.lit(False)), "place": F.monotonically_increasing_id()}))
    good = last.filter("ok")
    counts = episode_counts(spans_of(good, "pred"), spans_of(good, "gold"), good.select("run", "episode_id", "family"), split=split)
    return last.select("run", "episode_id", "family", "ok", *ORDER).join(counts.drop("family"), ["run", "episode_id"], "left").select(
        *COUNTS_SCHEMA.names)


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str,
                 split: bool | None = None, feed: str | None = None) -> StreamingQuery:
    """Score every arriving file once and keep its counts under ``target`` (``Batches``), so a replayed batch counts
    once. With ``feed`` the batch's counts are also left there for ``total_stream``, which deletes what it has read.
    Processes what is there and stops; call again to resume."""
    store = _counts_store(spark, target)

    def score(batch: DataFrame, batch_id: int) -> None:
        counts = durable(score_rows(batch, split))
        if feed:
            counts.write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")
        store.add(counts, batch_id)

    return (stream_rows(spark, source).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _counts_store(spark: SparkSession, target: str) -> Batches:
    return Batches(spark, target, COUNTS_SCHEMA, latest)


def stored_counts(spark: SparkSession, target: str) -> DataFrame:
    """Counts of every episode over all batches so far: an episode that was delivered again counts once."""
    return _counts_store(spark, target).rows().filter("ok").drop("ok", *ORDER)


def pooled(sums: DataFrame) -> DataFrame:
    return sums.select("run", "family", "episodes", *pooled_columns())


def running_report(counts: DataFrame) -> DataFrame:
    """Pooled report per (run, family) of counts with one row per episode, such as ``stored_counts``."""
    return pooled(counts.groupBy("run", "family").agg(F.count("*").alias("episodes"), *(F.sum(c).alias(c) for c in COUNT_COLUMNS)))


# ---- totals without reading anything twice ---------------------------------------------------------------

_LONGS = ["episodes", *COUNT_COLUMNS]
CHANGES = T.StructType([T.StructField("run", T.StringType()), T.StructField("family", T.StringType()),
                        *(T.StructField(c, T.LongType()) for c in _LONGS)])
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastCounts(StatefulProcessor):
    """Holds the last written counts of one episode and gives what a newer row changes: minus the old, plus the new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", COUNTS_SCHEMA)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        old = tuple(self._last.get()) if self._last.exists() else None
        new = max(map(tuple, rows), key=_order)
        if old is not None and _order(old) >= _order(new):
            return  # delivered again, or late
        self._last.update(new)
        for row, sign in ((old, -1), (new, 1)):
            if row is not None and row[_OK]:
                values = (row[_RUN], row[_FAMILY], sign, *(sign * (row[k] or 0) for k in _COUNTS))
                yield Row(**dict(zip(CHANGES.names, values)))

    def close(self) -> None:
        pass


_NAMES = COUNTS_SCHEMA.names
_RUN, _FAMILY, _OK = (_NAMES.index(c) for c in ("run", "family", "ok"))
_COUNTS = [_NAMES.index(c) for c in COUNT_COLUMNS]
_PLACE = [_NAMES.index(c) for c in ORDER]


def _order(row: tuple) -> tuple:
    """Nulls first, as Spark compares them."""
    return tuple((row[k] is not None, row[k]) if row[k] is not None else (False, 0) for k in _PLACE)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "family").agg(*(F.sum(c).alias(c) for c in _LONGS))


def _totals_store(spark: SparkSession, target: str) -> Batches:
    return Batches(spark, target, CHANGES, _summed)


def total_stream(spark: SparkSession, feed: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep sums of counts per (run, family) up to date from the counts that ``score_stream`` feeds.

    The state is one row per episode, spread over the state store's partitions; an episode that is delivered again or
    fails later takes its old counts back. Batches of changes are summed before they are stored, so a report reads one
    row per family and folder, whatever the corpus.
    """
    store = _totals_store(spark, target)
    counts = (spark.readStream.schema(COUNTS_SCHEMA).option("cleanSource", "delete").option("pathGlobFilter", "*.parquet")
              .parquet(f"{feed}/*"))
    changes = counts.groupBy("run", "episode_id").transformWithState(LastCounts(), CHANGES, "Append", "None")
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)  # the query keeps the settings it starts with
    try:
        return (changes.writeStream.foreachBatch(lambda batch, batch_id: store.add(_summed(batch), batch_id))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.unset(_ROCKS[0]) if before is None else spark.conf.set(_ROCKS[0], before)


def total_report(spark: SparkSession, target: str) -> DataFrame:
    """``running_report`` from the sums alone."""
    return pooled(_totals_store(spark, target).rows().filter("episodes > 0"))


# ---- last write wins --------------------------------------------------------------------------------------

_VERSION = T.StructType([T.StructField(c, T.LongType()) for c in ("window_id", "row_idx")])


def _last_states(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("subtask", "version", "batch"), F.struct("version", "batch")).alias("r")
    return rows.groupBy("episode_id", "frame_idx").agg(newest).select("episode_id", "frame_idx", "r.*")


def _states_store(spark: SparkSession, target: str, episode: T.DataType) -> Batches:
    return Batches(spark, target, T.StructType([
        T.StructField("episode_id", episode), T.StructField("frame_idx", T.LongType()), T.StructField("subtask", T.StringType()),
        T.StructField("version", _VERSION), T.StructField("batch", T.LongType())]), _last_states)


def keep_latest(spark: SparkSession, states: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Streaming last-write-wins on (episode, frame): each batch is reduced to its latest rows and stored; ``Batches``
    merges batches as they come together, and ``latest_states`` resolves what is left against each other."""
    store = _states_store(spark, target, states.schema["episode_id"].dataType)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        version = F.struct(*(F.col(c).cast("long").alias(c) for c in _VERSION.names))
        store.add(_last_states(batch.select("episode_id", F.col("frame_idx").cast("long").alias("frame_idx"), "subtask", version.alias("version"),
                                            F.lit(batch_id).cast("long").alias("batch"))), batch_id)

    return (states.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_states(spark: SparkSession, target: str, episode: T.DataType = T.StringType()) -> DataFrame:
    """(episode_id, frame_idx, subtask); ``episode``: the type of the ids."""
    return _states_store(spark, target, episode).rows().select("episode_id", "frame_idx", "subtask")
