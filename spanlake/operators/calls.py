"""A ledger of calls in a shared folder: what was asked, what came back and what it took, one file an attempt.

A file is named by the keys of the rows it was asked for and appears complete or not at all (written under another name, then
moved), so a task that runs again finds every attempt that ended. Only an attempt under way when a task was killed can be
made twice. Attempts that failed stay in the ledger for their usage; answers are those that succeeded.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField("_key", T.StringType()), T.StructField("ok", T.BooleanType()), *(
    T.StructField(c, T.StringType()) for c in ("answer", "error", "trace")), *(
    T.StructField(c, T.LongType()) for c in ("prompt_tokens", "output_tokens", "retries")),
    T.StructField("came_through", T.BooleanType()), T.StructField("n_rows", T.LongType())])
_ARROW = pa.schema([(f.name, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in ENTRY.fields])
_LONGS = ("prompt_tokens", "output_tokens", "retries")


def key(requests: DataFrame) -> Column:
    """SHA-256 of a request: all its columns, nulls told from empty texts."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in requests.columns)), {"ignoreNullFields": "false"}), 256)


class Ledger:
    """A task's view of the folder: a path, or the address of a file system that Arrow knows."""

    def __init__(self, folder: str):
        self.fs, self.base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))

    def _path(self, keys: Iterable[str]) -> str:
        name = hashlib.sha256("\n".join(keys).encode()).hexdigest()
        return f"{self.base}/{name[:2]}/{name}.parquet"

    def read(self, keys: pd.Series) -> tuple[pd.DataFrame, bool] | None:
        """The answers of an attempt for exactly these rows, and whether it came through; None if none ended."""
        path = self._path(keys)
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        rows = pq.read_table(path, filesystem=self.fs).to_pandas()
        return rows.drop(columns=["came_through", "n_rows"]), bool(rows["came_through"].iloc[0])

    def write(self, keys: pd.Series, rows: pd.DataFrame, came_through: bool) -> None:
        path = self._path(keys)
        folder, _, name = path.rpartition("/")
        self.fs.create_dir(folder)
        draft = f"{folder}/_{uuid.uuid4().hex}"
        table = pa.Table.from_pandas(rows.assign(came_through=came_through, n_rows=len(rows)), _ARROW, preserve_index=False)
        pq.write_table(table, draft, filesystem=self.fs)
        self.fs.move(draft, path)


def attempts(spark: SparkSession, ledger: str) -> DataFrame | None:
    """All rows of all attempts, with the file of each; None while there are none."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(base):
        return None
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(ledger).withColumn(
        "attempt", F.col("_metadata.file_name"))


def answers(spark: SparkSession, ledger: str) -> DataFrame | None:
    """One successful answer per request."""
    rows = attempts(spark, ledger)
    if rows is None:
        return None
    rows = rows.filter(F.col("came_through") & F.col("ok"))
    names = [c for c in ENTRY.names if c not in ("_key", "came_through", "n_rows")]
    return rows.groupBy("_key").agg(F.min_by(F.struct(*names), "attempt").alias("r")).select("_key", "r.*")


def usage(spark: SparkSession, ledger: str) -> DataFrame:
    """Attempts, rows and tokens of calls that came through and of calls that did not. A failed batch took what its error says,
    once, not once a row."""
    rows = attempts(spark, ledger)
    if rows is None:
        rows = spark.createDataFrame([], T.StructType([*ENTRY.fields, T.StructField("attempt", T.StringType())]))
    per = rows.groupBy("attempt").agg(F.first("came_through").alias("came_through"), F.first("n_rows").alias("n_rows"), *(
        F.when(F.first("came_through"), F.sum(c)).otherwise(F.max(c)).alias(c) for c in _LONGS))
    return per.groupBy("came_through").agg(F.count("*").alias("attempts"), F.sum("n_rows").alias("requests"), *(F.sum(c).alias(c) for c in _LONGS))
