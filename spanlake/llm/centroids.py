"""Clustering of integer vectors around centroids, each vector's nearest centroid found through a vantage-point tree.

Vectors become integers, floor(scale * x). Every round builds a vantage-point tree over the centroids and broadcasts it. A node
holds a vantage centroid and the centroids nearer and farther than the median, with the least and the greatest distance of either
half. Each vector searches best first: of its open nodes it takes the one with the least possible distance and drops those that
lie strictly beyond the best centroid so far, so a centroid at the same distance is always met and the smaller number wins.
The vectors of a batch search together: those that are at one node are measured in one numpy operation.

Distances and sums are exact integers of any size: in double arithmetic while every intermediate value is below 2^53, in 64-bit
integers below 2^63, in Python integers beyond. Only pruning is in floating point, with a margin wider than its error. The tree
is bounded by number and length of the centroids; beyond ``TREE_BYTES`` they are searched in blocks, one tree each.

A round sends, per task, the sums of each centroid's vectors, never the vectors. Sums travel in limbs of 40 bits, so that adding
them cannot overflow, and what reaches the driver is one number per centroid, component and limb.

Rows whose vector is null, has another length, or has a component that is null, not a number or infinite are left out. Repeated
vectors and ids are clustered row by row; equal hashes are ordered by the vector; a null id counts as empty text where the first centroids are chosen. With fewer
rows than k all of them are centroids; an empty table gives an empty result. A distance beyond a long is null, and so are sums
over it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written

#: Least centroids in a leaf; leaves of large trees hold the square root of all, so that lists of open nodes stay short.
LEAF = 4
#: Bytes of centroids in one broadcast tree.
TREE_BYTES = 32_000_000
#: Vectors that search together.
BATCH = 8_192

_LIMB = 40
_MARGIN = 1e-9
_LONG = 2**63


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as doubles if they are below 2^52, else as Python integers."""
    if not x.size or np.abs(x).max() < 2.0**52 / scale:
        return np.floor(scale * x)
    flat = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(scale * v)) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the cheapest type in which the squared distance of their rows is exact."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    top = 4 * most * most * max(1, arrays[0].shape[-1])
    kind = np.float64 if top < 2**53 else np.int64 if top < 2**63 else object
    if kind is object:
        return [np.array([int(v) for v in a.ravel().tolist()], object).reshape(a.shape) for a in arrays]
    return [a.astype(kind) for a in arrays]


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of q to c."""
    d = q - c
    return (d * d).sum(axis=1)


def _root(d) -> np.ndarray:
    """Lengths of squared distances; infinite beyond the range of doubles, where nothing is pruned."""
    d = np.asarray(d)
    if d.dtype == object:
        return np.array([math.sqrt(v) if v < 2**1020 else float(math.isqrt(int(v))) if v < 2**2040 else np.inf for v in d.ravel().tolist()]).reshape(d.shape)
    return np.sqrt(d.astype(np.float64))


@dataclass
class Node:
    points: np.ndarray  # of a leaf
    vantage: int = -1
    inner: int = -1
    outer: int = -1
    inner_range: tuple[float, float] = (0.0, 0.0)
    outer_range: tuple[float, float] = (0.0, 0.0)


class Tree:
    """A vantage-point tree over centroids, numbered from first."""

    def __init__(self, centroids: np.ndarray, first: int = 0):
        self.centroids, self.first, self.leaf = centroids, first, max(LEAF, math.isqrt(len(centroids)))
        self.nodes: list[Node] = []
        (self._exact,) = exact(centroids)
        self._build(np.arange(len(centroids)))
        self._exact = None

    def _build(self, points: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(Node(points))
        if len(points) > self.leaf:
            vantage, rest = points[0], points[1:]
            d = squared(self._exact[rest], self._exact[vantage])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], _root(d[order])
            half = len(rest) // 2
            inner, outer = self._build(rest[:half]), self._build(rest[half:])
            self.nodes[at] = Node(points[:0], int(vantage), inner, outer, (d[0], d[half - 1]), (d[half], d[-1]))
        return at

    def nearest(self, q: np.ndarray, number: np.ndarray, distance: np.ndarray) -> None:
        """Improve number and distance (-1 where there is none yet) of each row of q, integers."""
        q, centroids = exact(q, self.centroids)
        near = distance.astype(q.dtype)
        far = np.where(number < 0, np.inf, _root(np.where(number < 0, 0, distance)))  # the best so far, as a length
        width = len(self.nodes) + 1  # no vector meets a node twice, so there are no more steps than nodes
        bound = np.full((len(q), width), np.inf)
        node = np.zeros((len(q), width), np.int32)
        bound[:, 0] = 0
        active, free = np.arange(len(q)), 1

        def offer(rows: np.ndarray, c: int) -> np.ndarray:
            d = squared(q[rows], centroids[c])
            old, k = near[rows], c + self.first
            better = (number[rows] < 0) | (d < old) | (d == old) & (k < number[rows])
            won = rows[better]
            number[won], near[won] = k, d[better]
            length = _root(d)
            far[won] = length[better]
            return length

        while len(active):
            slot = bound[active, :free].argmin(axis=1)
            least = bound[active, slot]
            going = (least <= far[active] * (1 + _MARGIN) + _MARGIN) & np.isfinite(least)
            active, slot, least = active[going], slot[going], least[going]
            at = node[active, slot]
            bound[active, slot] = np.inf
            grown = False
            for k in np.unique(at):
                here = at == k
                rows, one = active[here], self.nodes[k]
                if len(one.points):
                    for c in one.points:
                        offer(rows, int(c))
                    continue
                d = offer(rows, one.vantage)
                for child, (lo, hi), place in ((one.inner, one.inner_range, slot[here]), (one.outer, one.outer_range, free)):
                    with np.errstate(invalid="ignore"):
                        gap = np.maximum(lo - d, d - hi)
                    gap = np.where(np.isfinite(gap), gap, 0)
                    bound[rows, place] = np.maximum(least[here], gap - _MARGIN * (d + hi))
                    node[rows, place] = child
                grown = True
            free += grown
        distance[:] = near


def _trees(centroids: np.ndarray) -> list[Tree]:
    block = max(1, TREE_BYTES // (8 * max(1, centroids.shape[1])))
    return [Tree(centroids[k:k + block], k) for k in range(0, len(centroids), block)]


def _searched(trees: list, scale: int, batches: Iterator[pa.RecordBatch]):
    """(batch slice, integers, number, distance) of the vectors, some thousand at a time."""
    for batch in batches:
        for start in range(0, len(batch), BATCH):
            part = batch.slice(start, BATCH)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            q = integers(x, scale)
            number, distance = np.full(len(part), -1, np.int64), np.full(len(part), -1, object)
            for tree in trees:
                tree.value.nearest(q, number, distance)
            yield part, q, number, distance


def _sums(trees: list, scale: int):
    """Per task: each centroid's number of vectors (dim -1) and sums of components, in limbs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for _, q, number, _ in _searched(trees, scale, batches):
            for c in np.unique(number).tolist():
                own = q[number == c]
                # Doubles are below 2^52 and a batch has at most 2^13 rows, so only Python's or 64-bit integers are added.
                own = own if own.dtype == object else own.astype(np.int64)
                s = own.sum(axis=0) if own.dtype == object or np.abs(own).max() < 2**49 else own.astype(object).sum(axis=0)
                total[c] = total.get(c, 0) + s.astype(object)
                count[c] = count.get(c, 0) + len(own)
        out = [(c, -1, 0, n) for c, n in count.items()]
        for c, s in total.items():
            for dim, v in enumerate(s.tolist()):
                v, limb = int(v), 0
                while v not in (0, -1):
                    out.append((c, dim, limb, v & (1 << _LIMB) - 1))
                    v, limb = v >> _LIMB, limb + 1
                if v:
                    out.append((c, dim, limb, -1))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in cols], ["cluster", "dim", "limb", "v"])
    return run


def _assign(trees: list, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, distance in _searched(trees, scale, batches):
            whole = [int(d) for d in distance]
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array([d if d < _LONG else None for d in whole], pa.int64())],
                ["vec_id", "cluster", "distance"])
    return run


@dataclass
class Clusters:
    assigned: DataFrame  # vec_id, cluster, distance (squared)
    centroids: np.ndarray  # integers, one row a centroid


def clusters(vectors: DataFrame, k: int, rounds: int, dim: int, scale: int, seed: str = "1:") -> Clusters:
    """vectors (vec_id, embedding) around k centroids after so many rounds and a last assignment.

    Centroids start as the k vectors with the smallest SHA-256 of seed and id, in that order. A round assigns every vector to
    the nearest centroid and moves each centroid that has vectors to floor(sum / count) of every component.
    """
    spark = vectors.sparkSession
    sound = (F.size("x") == dim) & F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).where(F.col("x").isNotNull() & sound), "vectors")
    start = rows.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = integers(np.array([r.x for r in start], np.float64).reshape(len(start), dim), scale)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids)
    for _ in range(rounds):
        trees = [spark.sparkContext.broadcast(t) for t in _trees(centroids)]
        sums = rows.mapInArrow(_sums(trees, scale), "cluster long, dim long, limb long, v long").groupBy("cluster", "dim", "limb").agg(F.sum("v").alias("v")).collect()
        for t in trees:
            t.destroy()
        count = {r.cluster: r.v for r in sums if r.dim < 0}
        moved = {c: [0] * dim for c in count}
        for r in sums:
            if r.dim >= 0:
                moved[r.cluster][r.dim] += r.v << _LIMB * r.limb
        whole = [[int(v) for v in c] for c in centroids.tolist()]
        for c, n in count.items():
            whole[c] = [s // n for s in moved[c]]
        centroids = np.array(whole, object)
    trees = [spark.sparkContext.broadcast(t) for t in _trees(centroids)]
    return Clusters(written(rows.mapInArrow(_assign(trees, scale), "vec_id long, cluster int, distance long"), "clusters"), centroids)


def digests(vectors: DataFrame) -> DataFrame:
    """Per vector: its cluster, squared distance, sums of distances and the SHA-256 of its final centroid: 16 centroids, 3 rounds."""
    found = clusters(vectors, 16, 3, 64, 64)
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.count("distance").alias("m")).collect()
    own = {r.cluster: int(r.s) if r.n == r.m else _LONG for r in sums}
    fit = lambda v: v if v < _LONG else None
    total = fit(sum(own.values()))
    one = [(c, fit(s), total, hashlib.sha256(",".join(str(int(v)) for v in found.centroids[c]).encode()).hexdigest()) for c, s in own.items()]
    each = vectors.sparkSession.createDataFrame(one, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid.
    return found.assigned.join(F.broadcast(each), F.col("cluster") == F.col("c")).drop("c")


def _sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    step = """
a{r} AS (
    SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c)) AS best
    FROM kept v CROSS JOIN c{r} c GROUP BY r)"""
    move = """,
s{n} AS (
    SELECT c, i, sum(x) AS s, count(*) AS n
    FROM (SELECT a.best.c AS c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{r} a JOIN kept v USING (r)) GROUP BY c, i),
m{n} AS (
    SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{n} GROUP BY c),
c{n} AS (
    SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{n} m ON c.c = m.c),"""
    head = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding,
           list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY h, embedding) - 1 AS INTEGER) AS c, q
    FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, embedding, q FROM kept) ORDER BY h, embedding LIMIT {k}),"""
    body = "".join(step.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds)) + step.format(r=rounds)
    return head + body + f"""
SELECT v.vec_id, a.best.c AS cluster, CAST(a.best.d AS BIGINT) AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept v USING (r) JOIN c{rounds} c ON c.c = a.best.c
"""


SQL = _sql()
