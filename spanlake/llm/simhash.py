"""SimHash near-duplicate classes by a hierarchical index over Gray-ordered fingerprints.

Fingerprints are computed per document from 3-word shingles. Equal fingerprints are one entry. Two fingerprints that
differ in at most ``radius`` bits agree in at least one of ``radius + 1`` blocks of bits, so every entry goes once to
each block's node: the shared masked bit pattern. A node that gets too many entries is divided again by blocks of the
bits it has not fixed yet, which loses no link for the same reason. Within a node, entries are sorted by Gray rank
and factored into a tree of bit segments; pairs of tree nodes are descended together, adding up the differing bits,
and whole subtrees are pruned once the sum exceeds the radius. A node hands on a spanning forest of its links, fewer
than it has entries, never all pairs.

Null and empty texts have the fingerprint zero. Rows with a null doc_id are linked but never name a component; one
without any id has the component_id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written
from spanlake.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Entries above which a node is divided again.
NODE_ENTRIES = 500
#: Node pairs whose descent a task holds at once.
FRONTIER = 1 << 20
#: Bits of the tree's levels inside a node, from the top.
LEVELS = (16, 16, 8, 8, 8, 8)
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the XXH64 of all 3-word shingles (fewer words: the whole sequence)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(b" ".join(words), SEED)
    hashes = np.fromiter((h(x, SEED) for x in map(b" ".join, zip(words, words[1:], words[2:]))), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = hashes[i:i + COUNTED]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of up to 255 rows fit a byte, which is far faster to add.
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, counts[i] values."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def linked_pairs(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within equal groups whose fingerprints differ in at most radius bits.

    group and fp must be sorted by (group, Gray rank), so entries that share leading bits lie together and each tree
    node is a range. The frontier holds pairs of nodes of one level with the bits in which their prefixes differ.
    """
    n = len(fp)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.ones(n, bool)
    cut[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(cut)                       # node -> first entry; the roots are the groups
    left = right = np.arange(len(begin))
    diff = np.zeros(len(begin), np.int64)
    depth = 0
    for bits in LEVELS:
        depth += bits
        prefix = fp >> np.uint64(64 - depth)
        cut = cut.copy()
        cut[1:] |= prefix[1:] != prefix[:-1]
        below = np.flatnonzero(cut)
        first = np.searchsorted(below, begin)         # node -> first child
        count = np.diff(np.append(first, len(below)))
        segment = (fp[below] >> np.uint64(64 - depth)) & np.uint64((1 << bits) - 1)
        # Pairs of nodes become pairs of children: all of left's times all of right's.
        outer = np.repeat(np.arange(len(left)), count[left])
        a = _expand(first[left], count[left])
        per = count[right[outer]]
        b = _expand(first[right[outer]], per)
        a, outer = np.repeat(a, per), np.repeat(outer, per)
        diff = diff[outer] + np.bitwise_count(segment[a] ^ segment[b])
        near = (diff <= radius) & (a <= b)
        begin, left, right, diff = below, a[near], b[near], diff[near]
    # Entries are distinct within a group, so leaves are single entries.
    apart = left != right
    return begin[left[apart]], begin[right[apart]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n nodes the least node it is linked with, as (node, least) where they differ."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _masks(radius: int, level: int) -> list[int]:
    """Masks of the nodes of a level: level 0 fixes one block; each further level also one of radius + 1 blocks of the rest."""
    masks = [0]
    for _ in range(level + 1):
        out = []
        for m in masks:
            free = [i for i in range(64) if not m >> i & 1]
            size = -(-len(free) // (radius + 1))
            out += [m | sum(1 << i for i in free[k:k + size]) for k in range(0, len(free), size)]
        masks = list(dict.fromkeys(out))
    return masks


def links(entries: DataFrame, radius: int = RADIUS, node_entries: int = NODE_ENTRIES, max_level: int = 4) -> DataFrame:
    """Distinct fingerprints fp -> links (a, b) that connect all that differ in at most radius bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m

    def nodes(df: DataFrame, masks: list[int]) -> DataFrame:
        """A row per entry and mask; node: the mask and the masked bits."""
        made = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)]))
        return df.select("fp", made.alias("node"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by node; a node is searched when its last row has come."""
        def found(node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((gray_rank(fp), node))
            node, fp = node[order], fp[order]
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            work = np.cumsum(np.diff(np.append(starts, len(node))) ** 2) // FRONTIER
            for at in np.split(np.arange(len(starts)), np.flatnonzero(work[1:] != work[:-1]) + 1):
                lo, hi = starts[at[0]], starts[at[-1] + 1] if at[-1] + 1 < len(starts) else len(node)
                a, b = linked_pairs(node[lo:hi], fp[lo:hi], radius)
                child, root = forest(hi - lo, a, b)
                own = fp[lo:hi].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[child]), pa.array(own[root])], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            node, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "fp"))
            if not len(node):
                continue
            held.append((node, fp.view(np.uint64)))
            if held[0][0][0] == node[-1]:
                continue
            node, fp = (np.concatenate(x) for x in zip(*held))
            end = np.searchsorted(node, node[-1])
            yield from found(node[:end], fp[:end])
            held = [(node[end:], fp[end:])]
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held)))

    out, level, part = None, 0, nodes(entries.select("fp"), _masks(radius, 0))
    while True:
        large = None
        if level < max_level:
            part = written(part, "simhash-nodes")
            large = written(part.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > node_entries).select("node"), "simhash-large")
            large = None if large.isEmpty() else large
        small = part if large is None else part.join(large, "node", "left_anti")
        found = small.repartition("node").sortWithinPartitions("node").select("node", "fp").mapInArrow(search, "a long, b long")
        out = found if out is None else out.union(found)
        if large is None:
            return out
        level += 1
        # An entry may be in large nodes of several masks; it then goes to the finer nodes of all, which only adds searches.
        part = nodes(part.join(large, "node", "left_semi").select("fp").distinct(), _masks(radius, level))


def near_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id reachable over links of at most radius bits."""
    prints = written(fingerprints(docs), "simhash-prints")
    entries = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-entries")
    parts = written(components(links(entries, radius)), "simhash-components")
    inside = entries.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = inside.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = written(inside.join(names, "component").select(F.col("fp").alias("key"), "component_id"), "simhash-labels")
    # Both sides are plain scans here, so a fingerprint that very many rows share can be split.
    return prints.join(labels, prints.fp == labels.key).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each class, that with the smallest doc_id (one of the rows, where it repeats), with the columns
    of docs. Rows without a doc_id stay."""
    keep = near_classes(docs, radius).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"))
    best = rows.join(keep, F.col("row_id") == F.col("kept_id"), "left_semi").dropDuplicates(["row_id"])
    return best.union(rows.where("row_id is null")).select("row.*")
