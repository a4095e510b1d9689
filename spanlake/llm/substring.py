"""Removal of word passages that an earlier document already has, by difference-cover anchors.

A position is an anchor if it is in {0, 1, 3} modulo 7, a difference cover: for any two positions some shift below 7
takes both to anchors. So two equal windows of 13 words always share an aligned anchor window of 7 words, and only
3 of 7 positions are compared over the corpus:

1. anchors: documents are dealt to blocks by a hash of doc_id and text, so rows that share a doc_id, or have none, spread over
   all blocks; answers compare ids strictly, so equal ids may lie in different ones. Each block sends, per bucket of anchor hashes, its
   sorted distinct 32-bit codes; a bucket answers with one bit per code: does another block have it. An anchor that
   millions of rows share is one code per block. Codes only select candidates, so a chance collision costs work, not
   correctness.
2. windows: every 13-word window around a shared anchor (the extension of the anchor by six words to either side) is
   compared exactly, by a 96-bit hash, the same way; a bucket answers whether a smaller doc_id of another block has it.
3. removal: each block marks the words of its windows that a smaller doc_id has.

The texts are dealt to blocks once; all three steps read that exchange. Blocks are sized by bytes of text, buckets by
the number of anchors, so what a task holds does not grow with the corpus.

Words are what stands between ASCII white space, unchanged. Null texts have none. Rows that repeat a doc_id do not
make each other's words repeat; a null doc_id counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import Words, ascii_words, form_hashes, mix, others, restored, text_bytes

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a block, on average: the first, or more once there are so many blocks, up to the last.
BLOCK_BYTES, BLOCKS, MOST_BLOCK_BYTES = 4_000_000, 4_000, 16_000_000
#: Anchor codes in a bucket, on average.
BUCKET_CODES = 1_000_000
_LAST = np.iinfo(np.int64).max

# A message: from block to bucket (or back), kind, and packed arrays.
_MESSAGE = "block long, bucket int, kind int, a binary, b binary, c binary"


def blocks_of(docs: DataFrame, total: int, extra: list[Column]) -> DataFrame:
    """doc_id, text and the block of each row."""
    size = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, total // BLOCKS))
    return docs.select(*extra, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(max(1, -(-total // size)))))


def buckets(docs_bytes: int) -> int:
    """Buckets for the anchors of so many bytes: about 6 bytes a word, 3 of 7 words."""
    return max(16, docs_bytes // 6 * len(COVER) // PERIOD // BUCKET_CODES)


class Block:
    """The words of a block, sorted by doc_id, and the hashes of their windows."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        order = np.argsort(ids.fill_null(_LAST).to_numpy(zero_copy_only=False), kind="stable")
        self.order = order
        self.texts = texts.take(pa.array(order))
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)[order]
        words = Words(ascii_words(self.texts))
        self.bounds, self.codes, self.forms = words.bounds, words.codes, words.forms
        self.doc = words.doc.astype(np.int32)
        self.hash = form_hashes(self.forms)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.codes))  # words from here to the text's end

    def windows(self, at: np.ndarray, length: int, salt: int) -> np.ndarray:
        """Hash of the length words from each position."""
        out = np.full(len(at), salt, np.uint64)
        for k in range(length):
            out = (out ^ self.hash[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return mix(out)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor positions and their hashes."""
        place = np.arange(len(self.codes)) - self.bounds[self.doc]
        at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (self.left >= ANCHOR))
        return at, self.windows(at, ANCHOR, 1)


def _coded(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the high 32 bits, code in the low ones."""
    return (hashes >> np.uint64(32)) % np.uint64(n) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _ranges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    for lo, hi in zip(cut, np.append(cut[1:], len(bucket))):
        yield int(bucket[lo]), int(lo), int(hi)


def _messages(rows: list[tuple]) -> pa.Table:
    types = (("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()))
    cols = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.table({name: pa.array(col, kind) for (name, kind), col in zip(types, cols)})


def _bits(answers: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    """The answers' bits, in the order in which a block sent its entries."""
    out = np.zeros(len(bucket), bool)
    for k, lo, hi in _ranges(bucket):
        if k in answers:
            out[lo:hi] = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=hi - lo).astype(bool)
    return out


def _answers(messages: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: a for b, k, a in zip(*(messages.column(c).to_pylist() for c in ("bucket", "kind", "a"))) if k == kind}


def _parts(table: pa.Table) -> Block:
    table = table.combine_chunks()
    get = lambda c: table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type)
    return Block(get("doc_id"), get("text"))


def send_anchors(n: int):
    def run(table: pa.Table) -> pa.Table:
        block = _parts(table)
        codes = np.unique(_coded(block.anchors()[1], n))
        bucket = codes >> np.uint64(32)
        number = table.column("block")[0].as_py()
        return _messages([(number, k, 0, codes[lo:hi].astype(np.uint32).tobytes(), None, None) for k, lo, hi in _ranges(bucket)])
    return run


def answer_anchors(table: pa.Table) -> pa.Table:
    """For every block, which of its codes in this bucket another block has too."""
    sent = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
    codes = np.concatenate(sent)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = np.zeros(len(codes), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    shared = np.zeros(len(codes), bool)
    shared[order] = same
    parts = np.split(shared, np.cumsum([len(x) for x in sent])[:-1])
    return _messages([(b, k, 1, np.packbits(x).tobytes(), None, None)
                      for b, k, x in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), parts) if x.any()])


class Windows:
    """The candidate windows of a block: those around anchors that another document has."""

    def __init__(self, block: Block, n: int, answers: dict[int, bytes]):
        at, hashes = block.anchors()
        codes = _coded(hashes, n)
        distinct, inverse = np.unique(codes, return_inverse=True)
        shared = _bits(answers, distinct >> np.uint64(32))
        # Within the block: codes of more than one document.
        least = np.full(len(distinct), _LAST)
        most = np.full(len(distinct), -1)
        np.minimum.at(least, inverse, block.doc[at])
        np.maximum.at(most, inverse, block.doc[at])
        shared |= least < most
        hit = at[shared[inverse]]
        near = np.zeros(len(block.codes) + PERIOD, np.int32)
        np.add.at(near, np.maximum(hit - (PERIOD - 1), block.bounds[block.doc[hit]]), 1)
        np.add.at(near, hit + 1, -1)
        self.at = np.flatnonzero((np.cumsum(near)[:len(block.codes)] > 0) & (block.left >= WINDOW))
        high, low = block.windows(self.at, WINDOW, 2), block.windows(self.at, WINDOW, 3) & np.uint64(0xFFFFFFFF)
        high = _rotated(high, n)
        # Sorted by bucket, hash, document: the first of each window is the block's smallest document.
        order = np.lexsort((block.doc[self.at], low, high))
        high, low = high[order], low[order]
        first = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])) if len(high) else np.zeros(0, bool)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1
        self.high, self.low = high[first], low[first].astype(np.uint32)
        self.least = block.ids[block.doc[self.at[order[first]]]] if len(order) else np.zeros(0, np.int64)
        self.bucket = self.high >> np.uint64(48)


def _rotated(high: np.ndarray, n: int) -> np.ndarray:
    """Put the bucket into the top 16 bits, keeping 48 bits of hash."""
    return (high >> np.uint64(40)) % np.uint64(min(n, 65_536)) << np.uint64(48) | high & np.uint64((1 << 48) - 1)


def send_windows(n: int):
    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        w = Windows(_parts(table), n, _answers(messages, 1))
        number = table.column("block")[0].as_py()
        return _messages([(number, k, 2, w.high[lo:hi].tobytes(), w.low[lo:hi].tobytes(), w.least[lo:hi].tobytes()) for k, lo, hi in _ranges(w.bucket)])
    return run


def answer_windows(table: pa.Table) -> pa.Table:
    """For every block, which of its windows in this bucket a smaller doc_id of another block has."""
    get = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    high, low, least = get("a", np.uint64), get("b", np.uint32), get("c", np.int64)
    sizes = np.cumsum([len(x) for x in high])[:-1]
    high, low, least = np.concatenate(high), np.concatenate(low), np.concatenate(least)
    order = np.lexsort((least, low, high))
    first = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
    smallest = np.empty(len(order), np.int64)
    smallest[order] = least[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return _messages([(b, k, 3, np.packbits(x).tobytes(), None, None) for b, k, x in
                      zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(smallest < least, sizes)) if x.any()])


def _covered(block: Block, n: int, messages: pa.Table) -> np.ndarray:
    """Words covered by a window that a smaller doc_id has."""
    w = Windows(block, n, _answers(messages, 1))
    earlier = _bits(_answers(messages, 3), w.bucket)[w.entry] if len(w.at) else np.zeros(0, bool)
    hit = w.at[earlier | (block.ids[block.doc[w.at]] > w.least[w.entry])] if len(w.at) else w.at
    mark = np.zeros(len(block.codes) + WINDOW + 1, np.int32)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + WINDOW, -1)
    return np.cumsum(mark)[:len(block.codes)] > 0


def cut(n: int, keep_rest: bool):
    """Per document what is left of it; with keep_rest, texts that lose nothing stay as they are."""
    def run(table: pa.Table, messages: pa.Table) -> pa.Table:
        rest = {"rest": table.column("rest").combine_chunks()} if keep_rest else {}
        if not table.num_rows:
            empty = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "text": pa.string()}
            return pa.table({**{c: pa.array([], kind) for c, kind in empty.items()}, **rest})
        block = _parts(table)
        gone = _covered(block, n, messages)
        words = np.diff(block.bounds)
        before = np.concatenate([[0], np.cumsum(gone)])
        lost = before[block.bounds[1:]] - before[block.bounds[:-1]]
        forms = block.forms.take(pa.array(block.codes[~gone])).cast(pa.string())
        kept = np.concatenate([[0], np.cumsum(words - lost)]).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), forms), " ")
        if keep_rest:
            texts = pc.if_else(pa.array(lost == 0), block.texts, texts)
        order = pa.array(block.order)
        return pa.table({"doc_id": table.column("doc_id").combine_chunks().take(order), "n_words": pa.array(words, pa.int64()),
                         "n_removed": pa.array(lost, pa.int64()), "text": texts, **{c: x.take(order) for c, x in rest.items()}})
    return run


def without_repeats(docs: DataFrame, *, keep_rest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and text: the kept words, joined by one space. With keep_rest, the text as it was where
    nothing is removed, and rest, the other columns of docs."""
    total = text_bytes(docs)
    dealt = blocks_of(docs, total, [others(docs).alias("rest")] if keep_rest else [])
    n = buckets(total)
    by_block = dealt.groupBy("block")
    anchors = by_block.applyInArrow(send_anchors(n), _MESSAGE)
    shared = anchors.groupBy("bucket").applyInArrow(answer_anchors, _MESSAGE)
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_windows(n), _MESSAGE)
    earlier = windows.groupBy("bucket").applyInArrow(answer_windows, _MESSAGE)
    both = shared.union(earlier)
    rest = f", rest {dealt.schema['rest'].dataType.simpleString()}" if keep_rest else ""
    return by_block.cogroup(both.groupBy("block")).applyInArrow(cut(n, keep_rest), f"doc_id long, n_words long, n_removed long, text string{rest}")


def digests(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with their texts cut; a text that lost no word stays as it is, and a document that lost all goes."""
    cut_rows = without_repeats(docs, keep_rest=True)
    return restored(cut_rows.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))), docs)


#: The same in DuckDB SQL.
SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS doc, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, doc, unnest(range(1, len(words) - 11)) AS i, unnest(list_transform(range(1, len(words) - 11), lambda j: md5(array_to_string(words[j:j + 12], ' ')))) AS h
      FROM w WHERE len(words) >= 13),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
hit AS (SELECT DISTINCT doc, unnest(range(i, i + 13)) AS pos FROM g JOIN m USING (h) WHERE g.doc_id > m.least OR (g.doc_id IS NULL AND m.least IS NOT NULL)),
gone AS (SELECT doc, list(pos) AS pos FROM hit GROUP BY doc),
kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(pos), 0) AS n_removed,
                CASE WHEN pos IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(pos, x[2])), lambda x: x[1]) END AS words
         FROM w LEFT JOIN gone USING (doc))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""
