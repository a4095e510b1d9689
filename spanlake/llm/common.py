"""What the corpus operators share: scratch tables, word splitting in numpy, vectorised hashing.

Scratch tables live below ``spark.checkpoint.dir``, the folder driver and executors share, so a lost executor
only means that tasks run again. ``clear`` deletes those of this session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds in decoded form at once.
CHUNK_BYTES = 4_000_000

_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a folder of its own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spanlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the scratch tables of this session; results that still read them must be written before."""
    jvm = spark.sparkContext._jvm
    while _FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def others(docs: DataFrame, col: str = "text") -> Column:
    """All columns but one as a struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != col])


def restored(df: DataFrame, docs: DataFrame, col: str = "text") -> DataFrame:
    """The columns of docs, in their order, from the struct rest and the column col."""
    return df.select(*[F.col(col) if c == col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column, for sizing blocks and buckets."""
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of many texts, flat: per word the code of its form, and the texts' bounds."""

    def __init__(self, lists: pa.Array):
        """lists: per text its words; null texts have none."""
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.forms = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])

    @property
    def doc(self) -> np.ndarray:
        """Per word the row of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        return form_hashes(self.forms, seed)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def form_hashes(forms: pa.Array, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in forms.to_pylist()), np.uint64, len(forms))


def ascii_words(texts: pa.Array) -> pa.Array:
    """Lists of words between ASCII white space (space, tab, line feed, vertical tab, form feed, return)."""
    trimmed = pc.ascii_trim_whitespace(texts)
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))


#: Bytes with A-Z in lower case.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A"):ord("Z") + 1] += 32

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("0"):ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def folded_words(texts: pa.Array) -> pa.Array:
    """Runs of ASCII letters, digits and any character beyond ASCII, with A-Z in lower case."""
    if texts.nbytes == 0 or not len(texts):
        return pa.array([None] * len(texts), pa.list_(pa.string()))
    valid, offsets, data = texts.buffers()
    folded = pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)]) if data is not None and data.size else data
    texts = pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, folded], offset=texts.offset)
    trimmed = pc.ascii_trim_whitespace(texts)
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))
