"""Best-fit packing of documents into training sequences, in bulk-synchronous rounds.

Pieces of equal length are interchangeable, and so are gaps of equal size. So a round moves whole classes: the pieces
still to place, sorted by length, and the open gaps, sorted by size, are at most ``capacity`` classes each, however
large the corpus. In a round every class of pieces is swept onto its successor, the smallest class of gaps that holds
it; where several classes want the same gaps, rank decides, longer pieces first, and the others take the next
successor in the next round; then the gaps are updated. What finds no gap opens sequences. A class is a range of
ranks, so the rounds yield a table of runs: (length, ranks from, to) -> (sequences from, offset).

The rows meet the runs without a sort: a piece's rank within its length is its number in the task that tokenised it
plus the pieces of that length in earlier tasks. A length that a third of all pieces have is spread over all tasks.

Tokens are those of the ``tokenizers`` file (a path, never a copy). tiktoken with the same vocabulary gives the same
ids several times faster, so it is used for texts of characters on which both splitters agree by definition
(printable ASCII, line ends and Latin letters up to U+024F) and that hold no added token such as <|endoftext|>; all other
texts go through ``tokenizers`` itself, with its defaults.

Null texts are empty: one end token. Rows that repeat a doc_id are packed each.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import written

CAPACITY = 2048
END = 0
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")

_ENCODERS: dict[tuple[str, str], object] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, ranks_path: str | None):
    """text -> token ids, kept for the life of the Python worker."""
    if (path, ranks_path) in _ENCODERS:
        return _ENCODERS[path, ranks_path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if ranks_path and _PLAIN.fullmatch(text) and not any(a in text for a in added):
            return fast(text)
        return whole.encode(text, add_special_tokens=False).ids

    _ENCODERS[path, ranks_path] = encode
    return encode


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: a document that is too long starts with the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenised(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, task and number (of the piece among those of its length in its
    task), with with_ids also ids as little-endian unsigned 32-bit."""
    if path is None:
        path, ranks_path = default_paths()

    kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
             ("task", pa.int64()), ("number", pa.int64()), *([("ids", pa.binary())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path, ranks_path), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, text, task in zip(*(batch.column(k) for k in range(3))):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    raw = ids[start:start + length].tobytes()
                    rows.append((doc_id.as_py(), k, start, length, zlib.crc32(raw), task.as_py(), seen[length], raw))
                    seen[length] += 1
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, kinds)], [n for n, _ in kinds])

    # The task's number as a column: equal for all rows that one task numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("task"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, offset) that place counts[length] pieces of every length.

    Pieces that open sequences either share them with their own length or leave all the room to shorter ones. Neither
    is better for all counts, so both are planned and the one with fewer sequences is taken.
    """
    return min((_planned(counts, capacity, shared) for shared in (True, False)), key=lambda runs: max((first + n for *_, n, first, _ in runs), default=0))


def _planned(counts: dict[int, int], capacity: int, shared: bool) -> list[tuple[int, int, int, int, int]]:
    """The runs of one plan.

    State: per length the next rank to place; per gap size the runs of sequences with that gap, (first sequence, how
    many). A round sweeps the lengths that are left from the longest to the shortest over the gaps as they were when
    the round began, so a gap takes one piece a round. A length that no gap holds opens sequences: with shared as few
    as hold its pieces, capacity // length in each, otherwise one a piece.
    """
    left = {k: n for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be between 1 and the capacity")
    next_rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, gap: int, first: int, n: int, target: dict) -> None:
        runs.append((length, next_rank[length], n, first, capacity - gap))
        next_rank[length] += n
        left[length] -= n
        if gap > length:
            target.setdefault(gap - length, []).append((first, n))

    while any(left.values()):
        # Open sequences for the longest class that has no gap; the shorter ones may still fit what this opens.
        todo = sorted((k for k, n in left.items() if n), reverse=True)
        widest = max(gaps, default=0)
        if todo[0] > widest:
            length = todo[0]
            layers = capacity // length if shared else 1
            full, more = divmod(left[length], layers)
            for k in range(layers):
                last = k == layers - 1
                if full:
                    put(length, capacity - k * length, sequences, full, gaps if last else {})
                if k < more:
                    put(length, capacity - k * length, sequences + full, 1, gaps if k == more - 1 else {})
            sequences += full + bool(more)
            continue
        # One sweep: every class onto its successor gaps, longer pieces first; filled gaps reopen in the next round.
        sizes, after = np.array(sorted(gaps)), {}
        for length in todo:
            at = int(np.searchsorted(sizes, length))
            while left[length] and at < len(sizes):
                gap = int(sizes[at])
                while left[length] and gaps.get(gap):
                    first, n = gaps[gap].pop()
                    take = min(n, left[length])
                    if take < n:
                        gaps[gap].append((first + take, n - take))
                    put(length, gap, first, take, after)
                at += 1
            if left[length]:
                break   # nothing holds this length any more: it opens sequences before shorter ones go on
        for gap, more in after.items():
            gaps.setdefault(gap, []).extend(more)
        gaps = {k: v for k, v in gaps.items() if v}
    return runs


def packed(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and ids with with_ids)."""
    spark = docs.sparkSession
    pieces = written(tokenised(docs, path, ranks_path, capacity, with_ids), "packing-pieces")
    # Ranks: pieces of the same length in earlier tasks, plus the number in the own task. A row per task and length.
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(by_task.select("length", "task", "n", F.coalesce(earlier, F.lit(0)).alias("base")), "packing-bases")
    counts = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("n")).collect()}   # at most one row per length
    runs = plan(counts, capacity)

    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], [*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    base = bases.select(F.col("length").alias("base_length"), F.col("task").alias("base_task"), "base")
    ranked = pieces.join(base, (F.col("length") == F.col("base_length")) & (F.col("task") == F.col("base_task"))).select(
        *columns, (F.col("base") + F.col("number")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long")
