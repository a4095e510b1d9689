"""Benchmark decontamination with an FM-index per training shard.

Every task builds, for each shard of a few MB of its documents, an FM-index over the shard's words: suffix array by
prefix doubling, Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled at every eighth
word. All test windows are searched backward at once; occurrences are located by walking to a sampled position, and
their words are merged into removal spans. The documents are never shuffled.

A window can only occur in a run of words that all appear in the benchmark and that is as long as the shortest
window, so only such runs are indexed; every other word is in no occurrence.

The test items go to the tasks in blocks of at most ``BLOCK_BYTES``; more items mean more passes over a document, not
a larger broadcast. Null texts have no words; an item without words is in no document. Item ids may be of any type; an item
without one hits words like any other but is not listed or counted among a document's items. Repeated rows count once as items
and row by row as documents; other columns are carried whatever their names, and empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import Words, chunks, folded_words, others, restored, text_bytes

WINDOW = 10
#: Bytes of test items in a block.
BLOCK_BYTES = 16_000_000
SAMPLE = 8
#: Bytes of text in a shard, on average.
SHARD_BYTES = 8_000_000

class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(text)
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Self-index of a sequence of codes of at least 1."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text, 0)
        order = suffix_array(text)
        last = text[order - 1]
        self.n, self.sigma = len(text), int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        sampled = order % sample == 0
        self.sampled, self.places = Bits(sampled), order[sampled]
        self.levels: list[tuple[int, Bits]] = []
        for shift in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (last >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            last = np.concatenate([last[~bit], last[bit]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of code before row i of the transform."""
        base = np.zeros_like(i)
        for shift, bits in self.levels:
            one = (code >> shift & 1).astype(bool)
            r, s = bits.rank(i), bits.rank(base)
            i = np.where(one, bits.zeros + r, i - r)
            base = np.where(one, bits.zeros + s, base - s)
        return i - base

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (right-aligned in the matrix) by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            live = live[(lengths[live] > k) & (hi[live] > lo[live])]
            if not len(live):
                break
            code = patterns[live, -1 - k]
            known = code < self.sigma
            hi[live[~known]] = lo[live[~known]] = 0
            on, code = live[known], code[known]
            lo[on] = self.first[code] + self.rank(code, lo[on])
            hi[on] = self.first[code] + self.rank(code, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps, todo = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.sampled.get(rows[todo]).astype(bool)
            done = todo[hit]
            out[done] = self.places[self.sampled.rank(rows[done])] + steps[done]
            todo = todo[~hit]
            i = rows[todo]
            code, base = np.zeros_like(i), np.zeros_like(i)
            for shift, bits in self.levels:
                one = bits.get(i).astype(bool)
                r, s = bits.rank(i), bits.rank(base)
                i = np.where(one, bits.zeros + r, i - r)
                base = np.where(one, bits.zeros + s, base - s)
                code |= one.astype(np.int64) << shift
            rows[todo] = self.first[code] + i - base
            steps[todo] += 1
        return out


class Patterns:
    """The distinct windows of some test items, and which items each is from."""

    def __init__(self, item_ids: list, texts: list[str | None], window: int = WINDOW):
        lists = folded_words(pa.array(texts, pa.string())).to_pylist()
        words = sorted({w for x in lists if x for w in x})
        code = {w: i + 2 for i, w in enumerate(words)}   # 0 ends the text, 1 separates runs
        seen: dict[tuple[int, ...], set[int]] = {}
        for i, x in enumerate(lists):
            codes = [code[w] for w in x or ()]
            for k in range(max(1, len(codes) - window + 1) if codes else 0):
                seen.setdefault(tuple(codes[k:k + window]), set()).add(i)
        self.items = [None if x is None else str(x) for x in item_ids]
        self.vocabulary = pa.array(words, pa.string())
        self.lengths = np.array([len(x) for x in seen], np.int64)
        self.codes = np.zeros((len(seen), window), np.int64)
        for i, x in enumerate(seen):
            self.codes[i, window - len(x):] = x
        self.owner = np.array([i for i, x in enumerate(seen.values()) for _ in x], np.int64)   # window of each (window, item)
        self.item = np.array([k for x in seen.values() for k in sorted(x)], np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Mask of the words inside occurrences, and distinct (row, item) pairs as an array of two columns."""
        n = len(words.codes)
        inside, none = np.zeros(n, bool), np.zeros((0, 2), np.int64)
        if not n or not len(self.lengths):
            return inside, none
        known = pc.index_in(words.forms, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known[words.codes] + 2                     # 1: not in the benchmark
        doc = words.doc
        # Runs of benchmark words within a document, as long as the shortest window.
        good = code > 1
        edge = np.append(True, (good[1:] != good[:-1]) | (doc[1:] != doc[:-1]))
        run = np.cumsum(edge) - 1
        long = (np.bincount(run) >= self.lengths.min())[run] & good
        at = np.flatnonzero(long)
        if not len(at):
            return inside, none
        gap = np.flatnonzero(np.append(False, run[at[1:]] != run[at[:-1]]))
        text, place = np.insert(code[at], gap, 1), np.insert(at, gap, -1)
        index = FMIndex(text)
        lo, hi = index.count(self.codes, self.lengths)
        found = np.flatnonzero(hi > lo)
        size = hi[found] - lo[found]
        window = np.repeat(found, size)
        ends = np.cumsum(size)
        rows = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo[found] - (ends - size), size)
        start = place[index.locate(rows)]
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + self.lengths[window], -1)
        inside = np.cumsum(mark)[:n] > 0
        pair = np.unique(doc[start] * np.int64(len(self.lengths)) + window) if len(start) else np.zeros(0, np.int64)
        hit_doc, hit_window = pair // len(self.lengths), pair % len(self.lengths)
        a, b = np.searchsorted(self.owner, hit_window), np.searchsorted(self.owner, hit_window, "right")
        at = np.arange(int((b - a).sum())) + np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) if len(a) else np.zeros(0, np.int64)
        return inside, np.unique(np.stack([np.repeat(hit_doc, b - a), self.item[at]], axis=1), axis=0)


def spans_of(inside: np.ndarray) -> list[dict]:
    """Maximal runs of marked words as half-open word ranges."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _merge(old: list[dict], new: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*old, *new], key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(dict(s))
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _search(held: Broadcast):
    """Add what these patterns find to the column found of (text, found, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Patterns = held.value
        for batch in batches:
            for lo, hi in chunks(batch.column("text"), SHARD_BYTES):
                part = batch.slice(lo, hi - lo)
                words = Words(folded_words(part.column("text")))
                inside, pairs = patterns.find(words)
                found = [{"n_words": int(n), "items": [], "spans": []} for n in np.diff(words.bounds)]
                starts = np.searchsorted(pairs[:, 0], np.arange(len(found) + 1)) if len(pairs) else None
                for i in np.unique(pairs[:, 0]) if len(pairs) else ():
                    found[i]["items"] = [x for k in pairs[starts[i]:starts[i + 1], 1] if (x := patterns.items[k]) is not None]
                    found[i]["spans"] = spans_of(inside[words.bounds[i]:words.bounds[i + 1]])
                for new, old in zip(found, part.column("found").to_pylist()):
                    if old and old["spans"]:
                        new["items"], new["spans"] = sorted({*old["items"], *new["items"]}), _merge(old["spans"], new["spans"])
                at = part.schema.get_field_index("found")
                yield part.set_column(at, "found", pa.array(found, _FOUND))
    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, *, keep_rest: bool = False, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, found: n_words, items (ids as strings) and spans (half-open word ranges, merged); with keep_rest also rest, the other columns."""
    blocks = max(1, -(-text_bytes(benchmark) // block_bytes))
    found = "struct<n_words: long, items: array<string>, spans: array<struct<start: long, end: long>>>"
    out = docs.select(*([others(docs).alias("rest")] if keep_rest else []), F.col("doc_id"), F.col("text").cast("string").alias("text"),
                      F.lit(None).cast(found).alias("found"))
    for k in range(blocks):
        # One block at a time is in the driver's memory; a broadcast keeps it in blocks of the store, on disk if need be.
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        held = docs.sparkSession.sparkContext.broadcast(Patterns([r[0] for r in rows], [r[1] for r in rows], window))
        out = out.mapInArrow(_search(held), out.schema)
    return out


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = occurrences(docs, benchmark).select("doc_id", "found")
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_sort(F.array_distinct("found.items"))
    return hits.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                       F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the spans out of the texts: from the first letter of a span to its last."""
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            if spans:
                at = [m.span() for m in word.finditer(texts[i])]
                end, kept = 0, []
                for s in spans:
                    kept.append(texts[i][end:at[s["start"]][0]])
                    end = at[s["end"] - 1][1]
                texts[i] = "".join([*kept, texts[i][end:]])
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with all occurrences cut out of their texts; a document of which no word is left goes."""
    hits = occurrences(docs, benchmark, keep_rest=True)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    left = hits.where((F.size("found.spans") == 0) | (n_hit < F.col("found.n_words"))).select("rest", "text", F.col("found.spans").alias("spans"))
    return restored(left.mapInArrow(_cut, left.schema), docs)


#: The same in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda i: array_to_string(words[i:i + 9], ' '))) AS win FROM b WHERE len(words) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc, n, unnest(range(1, len(words) - n + 2)) AS i, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS win FROM d, ns WHERE len(words) >= n),
occ AS (SELECT doc, i, dw.n, item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT doc, count(DISTINCT pos) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS pos FROM occ) GROUP BY doc),
it AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY doc)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc) LEFT JOIN it USING (doc)
"""
