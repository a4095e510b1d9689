"""Removal of lines that an earlier document already has, by range-partitioned hashes in document order.

1. hashes: every line long enough becomes one narrow row (128-bit hash of its key, document, position). No text moves.
2. stream: the rows are range-partitioned and sorted by (hash, document, position), so a line's first occurrence stands
   in front of all others and one pass finds it. The range covers the document and the position too: a line that a third of all
   documents share lies in many partitions. Where a line began in an earlier partition, only its first document there is
   undecided; the last line of every partition (one row each) decides it.
3. bitmaps: a document's dropped positions become one compressed bit per line. That is the result; texts are joined with it
   only by those who want texts.

A line's key is the line without the ASCII white space (space, tab, line feed, vertical tab, form feed, return) at its ends,
with A-Z in lower case. Keys of at least ``min_chars`` code points lose all their lines but those of the smallest doc_id that
has the key. Texts are split at line feeds only; a null or empty text is one empty line. Rows that repeat a doc_id are one
document: they drop none of each other's lines. A null doc_id counts as one document, larger than all others. Other columns
are carried whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import ASCII_LOWER, chunks, others, restored, written

#: Least code points of a key.
MIN_CHARS = 10
#: Lines in a range partition, on average.
PARTITION_LINES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_LINES = "hi long, lo long, doc long, text_key long, n_lines int, pos int, tie long"
_FOUND = "kind int, hi long, lo long, doc long, text_key long, n_lines int, pos int"
#: Kinds of rows that a pass over a range partition gives.
_DROPPED, _PENDING, _BORDER = 0, 1, 2


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts and the bounds of each text in them; null is empty."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def line_hashes(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hashes (n, 2), number of lines per row) of the lines whose keys are long enough."""
    data, bounds = _bytes(texts)
    feeds = np.flatnonzero(data == 10)
    first = np.searchsorted(feeds, bounds)  # feeds before each text
    n_lines = np.diff(first) + 1
    row = np.repeat(np.arange(len(texts)), n_lines)
    head = np.cumsum(n_lines) - n_lines
    pos = np.arange(len(row)) - head[row]
    start = np.empty(len(row), np.int64)
    end = np.empty(len(row), np.int64)
    start[head], end[head + n_lines - 1] = bounds[:-1], bounds[1:]
    inner, last = np.flatnonzero(pos > 0), np.flatnonzero(pos < n_lines[row] - 1)
    start[inner], end[last] = feeds + 1, feeds
    solid = np.flatnonzero(~_SPACE[data])
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    full = np.flatnonzero(hi > lo)
    start, end = solid[lo[full]], solid[hi[full] - 1] + 1
    long = points[end] - points[start] >= min_chars
    full, start, end = full[long], start[long], end[long]
    folded = memoryview(ASCII_LOWER[data].tobytes())
    hashes = b"".join([xxhash.xxh3_128_digest(folded[a:b]) for a, b in zip(start.tolist(), end.tolist())])
    return row[full], pos[full], np.frombuffer(hashes, ">i8").astype(np.int64).reshape(-1, 2), n_lines


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            texts, ids, keys = batch.column("text"), batch.column("doc"), batch.column("text_key")
            for lo, hi in chunks(texts):
                row, pos, hashes, n_lines = line_hashes(texts.slice(lo, hi - lo), min_chars)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), ids.take(take), keys.take(take), pa.array(n_lines[row].astype(np.int32)),
                     pa.array(pos.astype(np.int32)), pa.array(np.arange(made, made + len(row)))], ["hi", "lo", "doc", "text_key", "n_lines", "pos", "tie"])
                made += len(row)
    return run


def _rows(batch: pa.RecordBatch, mask: np.ndarray, kind: int) -> pa.RecordBatch:
    part = batch.filter(pa.array(mask))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), *(part.column(c) for c in ("hi", "lo", "doc", "text_key", "n_lines", "pos"))],
                                      ["kind", "hi", "lo", "doc", "text_key", "n_lines", "pos"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted range partition: what is surely dropped, what depends on earlier partitions, and the last line."""
    now, leading, last = None, True, None  # (hi, lo), its first document; still in the partition's first stretch
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        hi, lo = (batch.column(c).to_numpy() for c in ("hi", "lo"))
        null = batch.column("doc").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc").fill_null(0).to_numpy()
        starts = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
        at = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        first, first_null = doc[at], null[at]
        stretch = np.cumsum(starts)
        goes_on = now is not None and now[:2] == (hi[0], lo[0])
        if goes_on:
            mine = stretch == 1
            first, first_null = np.where(mine, now[2], first), np.where(mine, now[3], first_null)
        elif now is not None:
            leading = False
        other = (doc != first) | (null != first_null)
        yield _rows(batch, other, _DROPPED)
        if leading:
            yield _rows(batch, ~other & (stretch == 1), _PENDING)
            leading = stretch[-1] == 1
        if not goes_on or stretch[-1] > 1:
            last = batch.slice(int(at[-1]), 1)
        now = (hi[-1], lo[-1], first[-1], first_null[-1])
    if last is not None:
        yield _rows(last, np.ones(1, bool), _BORDER)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bitmaps = [], []
        for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("dropped")):
            keep = np.ones(n, bool)
            keep[dropped.values.to_numpy()] = False
            counts.append(n - int(keep.sum()))
            bitmaps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("text_key"), pa.array(batch.column("n_lines").cast(pa.int64())), pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary())],
            ["doc_id", "text_key", "n_lines", "n_dropped", "keep"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("text_key"),
                       F.col("text").cast("string").alias("text"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, partition_lines: int = PARTITION_LINES) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_key, n_lines, n_dropped, keep) of the documents that lose lines; all others keep all.

    text_key is Spark's xxhash64 of the text and tells rows that repeat a doc_id apart; keep is a zlib-compressed bitmap, one
    bit a line from the first, least significant bit first, 1 for a line that stays.
    """
    lines = written(_keyed(docs).mapInArrow(_hashed(min_chars), _LINES), "lines")
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // partition_lines))
    order = [F.col("hi"), F.col("lo"), F.col("doc").asc_nulls_last(), F.col("pos"), F.col("tie")]
    found = written(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_streamed, _FOUND), "line-passes")
    # One border a partition, so this side is bounded by their number.
    least = found.where(F.col("kind") == _BORDER).groupBy(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo")).agg(
        F.min(F.struct(F.col("doc").isNull().alias("is_null"), F.col("doc").alias("doc"))).alias("least"))
    own = F.struct(F.col("doc").isNull().alias("is_null"), F.col("doc").alias("doc"))
    cols = ["doc", "text_key", "n_lines", "pos"]
    late = found.where(F.col("kind") == _PENDING).join(F.broadcast(least), (F.col("hi") == F.col("b_hi")) & (F.col("lo") == F.col("b_lo"))).where(
        own > F.col("least")).select(*cols)
    dropped = found.where(F.col("kind") == _DROPPED).select(*cols).unionByName(late)
    return dropped.groupBy("doc", "text_key", "n_lines").agg(F.collect_set("pos").alias("dropped")).mapInArrow(
        _packed, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> str:
    """The text without the lines that a bitmap drops; no bitmap drops none."""
    text = text or ""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    return "\n".join([line for line, bit in zip(lines, bits.tolist()) if bit])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """text, the other columns as rest, and each row's bitmap (null: keep all)."""
    left = docs.select(F.col("text").cast("string").alias("text"), others(docs).alias("rest"), F.col("doc_id").cast("long").alias("l_doc"),
                       F.xxhash64(F.col("text").cast("string")).alias("l_key"))
    right = bitmaps.select(F.col("doc_id").alias("r_doc"), F.col("text_key").alias("r_key"), "keep")
    # Both sides grow with the input, so neither is broadcast whatever its compressed size.
    return left.join(right.hint("merge"), F.col("l_doc").eqNullSafe(F.col("r_doc")) & (F.col("l_key") == F.col("r_key")), "left").select("text", "rest", "l_doc", "keep")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the repeated lines cut from their texts; every row and all other columns stay. A null text becomes empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept_lines(t.as_py(), k.as_py()) for t, k in zip(batch.column("text"), batch.column("keep"))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], ["text", "rest"])

    joined = _with_bitmaps(docs, keep_bitmaps(docs, min_chars)).select("text", "rest", "keep")
    schema = joined.select("text", "rest").schema
    return restored(joined.mapInArrow(run, schema), docs)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, digests = [], [], []
        for text, keep in zip(batch.column("text"), batch.column("keep")):
            text = text.as_py() or ""
            left = kept_lines(text, keep.as_py())
            n = text.count("\n") + 1
            dropped = 0 if not keep.is_valid else n - int(np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=n, bitorder="little").sum())
            n_lines.append(n)
            n_dropped.append(dropped)
            digests.append(hashlib.sha256(left.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("l_doc"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())],
                                         ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, number of lines, lines dropped, and the SHA-256 of what is left."""
    bare = docs.select("doc_id", "text")
    return _with_bitmaps(bare, keep_bitmaps(bare)).select("text", "l_doc", "keep").mapInArrow(
        _digested, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flat AS (
    SELECT r, doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM flat),
firsts AS (
    SELECT key, min(doc_id) AS least FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
    SELECT k.*, f.key IS NOT NULL AND f.least IS DISTINCT FROM k.doc_id AS dropped
    FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
