"""Line dedup, centroid clustering and spelling variants against brute force and on hard cases."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from spanlake.llm import centroids, lines, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, rest string, doc long, keep string, text_key int, n long, word string, x double"
EXTRA = (None, "r", 5, "k", 7, None, "w", 1.5)


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(parts)


# ---- lines --------------------------------------------------------------------------------------------

LOWER = {k: k + 32 for k in range(65, 91)}


def plain_lines(rows, least=10):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                first[key(s)] = min(first.get(key(s), d), d, key=order)
    out = Counter()
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [s for s in all_lines if not (key(s) in first and first[key(s)] != d)]
        out[d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def line_rows():
    rng = random.Random(11)
    pool = [f"a shared line number {k}" for k in range(30)] + ["  Padded LINE with Ünïcode\t", "padded line with Ünïcode", "short", "ÜÜÜÜÜÜÜÜÜ", "ÜÜÜÜÜÜÜÜÜÜ", "", " \r", "x\x0by\x1cz 0123456"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n\n", "one line only here", "the hot line of all\n" * 500 + "end", "y" * 200_000 + "\nThe hot line of all", " the hot line of all"]
    rows = [(i - 4, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[3][0], "a shared line number 3\nand more of it"), (None, texts[5]), (None, "a shared line number 4\nonly without an id\nonly without an id"), (None, None)]
    rows += [(100 + k, f"THE hot line of all\nown line of {k} here") for k in range(150)]
    rng.shuffle(rows)
    return rows


def test_line_dedup(spark):
    rows = line_rows()
    docs = table(spark, rows)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.digests(docs).collect())
    assert got == plain_lines(rows)
    whole = lines.deduplicated(docs)
    assert whole.columns == docs.columns
    assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in whole.collect()) == sum(
        (Counter({(d, h): n}) for (d, _, _, h), n in plain_lines(rows).items()), Counter())
    assert all(r.lang is None and r.rest == "r" and r.keep == "k" for r in whole.collect())


def test_line_dedup_over_many_range_partitions(spark):
    """A line of most documents spreads over many partitions; the first occurrence still decides."""
    rows = [(k, "one very common line\n" * 3 + f"a line that only {k} has\nanother common line {k % 7}") for k in range(400)]
    docs = table(spark, rows)
    marks = {(r.doc_id): (r.n_lines, r.n_dropped, r.keep) for r in lines.keep_bitmaps(docs, partition_lines=40).collect()}
    assert marks.keys() == set(range(1, 400))
    text = dict(rows)
    for d, (n, dropped, keep) in marks.items():
        assert n == 5 and dropped == (4 if d >= 7 else 3)
        assert lines.kept_lines(text[d], keep).split("\n")[0] == f"a line that only {d} has"


def test_line_dedup_empty(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert lines.digests(nothing).count() == 0 and lines.deduplicated(nothing).count() == 0 and lines.keep_bitmaps(nothing).count() == 0
    assert lines.keep_bitmaps(table(spark, [(1, None), (2, None), (3, "")])).count() == 0


def test_stream_across_batches():
    """The stream's state carries over Arrow batches: any cut gives the same rows."""
    rng = random.Random(2)
    rows = sorted((rng.randint(0, 3), 0, rng.randint(0, 4), k) for k in range(60))
    cols = list(zip(*rows))

    def run(cuts):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b], pa.int64()) for c in cols[:3]] + [pa.array(cols[3][a:b], pa.int64()), pa.array([9] * (b - a), pa.int32()), pa.array(cols[3][a:b], pa.int32())],
                                              ["hi", "lo", "doc", "text_key", "n_lines", "pos"]) for a, b in zip([0, *cuts], [*cuts, 60])]
        return sorted(tuple(r.values()) for b in lines._streamed(iter(batches)) for r in b.to_pylist())

    whole = run([])
    for _ in range(30):
        assert run(sorted(rng.sample(range(1, 60), rng.randint(1, 20)))) == whole


# ---- centroids ----------------------------------------------------------------------------------------

def plain_clusters(vectors, k, rounds, dim, scale):
    """vectors: (id, list); Python integers only."""
    from fractions import Fraction
    from math import floor, isfinite
    kept = [(i, tuple(floor(Fraction(x) * scale) for x in v), v) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [q for _, q, _ in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, p)), n) for n, p in enumerate(c)) for _, q, _ in kept]
    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, n), (_, q, _) in zip(assign(), kept):
            groups[n].append(q)
        c = [tuple(sum(col) // len(groups[n]) for col in zip(*groups[n])) if groups[n] else p for n, p in enumerate(c)]
    return Counter((i, n, d if d < 2**63 else None) for (i, _, _), (d, n) in zip(kept, assign())), c


def vector_table(spark, vectors, kind="double"):
    return spark.createDataFrame([(i, v, "l", 3, 4) for i, v in vectors], f"vec_id long, embedding array<{kind}>, label string, x int, cluster int").repartition(3)


@pytest.mark.parametrize("size", [1.0, 3e6, 1e12, 1e300])
def test_clusters(spark, size):
    """In double arithmetic, in 64-bit integers and in Python's; with ties, repeats and rows that are left out."""
    rng = np.random.default_rng(4)
    data = [(int(i), [float(x) for x in rng.normal(size=3) * size]) for i in range(150)]
    data += [(200 + i, [float(i % 3), float(i % 2), 0.0]) for i in range(60)] + [(7, data[7][1])] * 3
    data += [(300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 2.0]), (304, [float("inf"), 0.0, 0.0]), (305, []), (None, [0.5, 0.25, -0.125]), (-3, [-0.0, 0.0, 0.0])]
    found = centroids.clusters(vector_table(spark, data), 9, 3, 3, 64)
    expected, c = plain_clusters(data, 9, 3, 3, 64)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.assigned.collect()) == expected
    assert [tuple(int(v) for v in row) for row in found.centroids] == c


def test_clusters_edge_cases(spark):
    assert centroids.clusters(vector_table(spark, []), 4, 2, 3, 64).assigned.count() == 0
    few = [(1, [1.0, 0.0]), (2, [1.0, 0.0])]
    got = centroids.clusters(vector_table(spark, few), 5, 2, 2, 64).assigned.collect()
    assert {(r.vec_id, r.distance) for r in got} == {(1, 0), (2, 0)} and len({r.cluster for r in got}) == 1
    assert centroids.digests(vector_table(spark, few)).count() == 0


@pytest.mark.parametrize("leaf_root", [16, 700])
def test_tree_against_all_distances(leaf_root, monkeypatch):
    """Many centroids, many equal distances, several trees."""
    rng = np.random.default_rng(8)
    c = rng.integers(-4, 5, (leaf_root, 5)).astype(object)
    q = rng.integers(-5, 6, (3_000, 5)).astype(np.float64)
    d = ((q[:, None, :].astype(int) - c.astype(int)[None]) ** 2).sum(axis=2)
    monkeypatch.setattr(centroids, "TREE_BYTES", 5 * 8 * 300)
    number, distance = np.full(len(q), -1, np.int64), np.full(len(q), -1, object)
    for tree in centroids._trees(c):
        tree.nearest(q, number, distance)
    assert (number == d.argmin(axis=1)).all() and (distance.astype(int) == d.min(axis=1)).all()


# ---- spelling -----------------------------------------------------------------------------------------

def plain_variants(counts):
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[w] = [form, n, len(close), counts[form] if form else None]
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def found_variants(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_words():
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdeéß") for _ in range(rng.randint(7, 10))) for _ in range(150)}
    for w in list(words)[:100]:
        for _ in range(3):
            k = rng.randrange(len(w))
            words |= {w[:k] + w[k + 1:], w[:k] + rng.choice("abcé×ÿ") + w[k:], w[:k] + rng.choice("abcdeÀ") + w[k + 1:]}
    words |= {"a" * 40, "a" * 41, "a" * 39 + "b", "a" * 300, "a" * 299 + "i", "a" * 301, "abcdefg", "abcdefgh", "iiiiiiié", "iiiiiiii"}
    words = sorted(w for w in words if len(w) >= 7)
    return {w: rng.choice([2, 3, 3, 25, 40, 300, 4_000, 50_000]) for w in words}


@pytest.mark.parametrize("node_words", [50_000, 60, 3])
def test_variants(spark, node_words):
    """With one node, a trie of some levels, and whole vectors that are divided by their ends."""
    counts = some_words()
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = spelling.variants(words, node_words=node_words)
    assert found_variants(got) == plain_variants(counts)


def test_variants_in_one_vector(spark):
    """Anagrams: every word has the same letters, so their node is divided by first and last letters."""
    rng = random.Random(1)
    counts = {}
    for _ in range(400):
        letters = list("aaabbbccc")
        rng.shuffle(letters)
        counts["".join(letters)] = rng.randint(2, 500)
    counts |= {w[:4] + w[5:]: 7 for w in list(counts)[:50]} | {"x" + w: 9 for w in list(counts)[:50]}
    # Letters of one group: one replacement leaves the vector as it is.
    counts |= {w.replace("a", "Á".lower() if k % 2 else "Ã", 1): 5 for k, w in enumerate(list(counts)[:50])}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert spelling.upper_nodes(spark.createDataFrame([(bytearray(b"\0\0\0\1" * 33),)] * 9, "vec binary"), 3) == {b"\0\0\0\1" * 33: True}
    assert found_variants(spelling.variants(words, node_words=5)) == plain_variants(counts)


def test_vocabulary(spark):
    import re
    rng = random.Random(9)
    pool = ["Strasse", "straßen", "naïvement", "ÉCOLIERS", "écoliers", "letters", "lettersx", "sh", "under_score", "don't", "mañanero", "日本語テキスト", "x÷y×zabcd", "tail9digits"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))) for k in range(120)]
    rows += [(None, "letters letters null-id"), (5, None), (6, ""), (rows[3][0], rows[3][1]), (2**40, "L" * 60_000 + " " + "letters " * 900)]
    def plain(every):
        n = Counter()
        for d, t in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = w.translate(LOWER)
                h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
                if every and h % every == 0:
                    w = w[:h % len(w)] + w[h % len(w) + 1:]
                if len(w) >= 7:
                    n[w] += 1
        return {w: k for w, k in n.items() if k >= 2}
    docs = table(spark, rows)
    for every in (0, 31, 2):
        assert {r.word: r.n for r in spelling.vocabulary(docs, every).collect()} == plain(every)
    assert found_variants(spelling.digests(docs)) == plain_variants(plain(31))
    assert spelling.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_edit_in_numpy():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (7, 8) for _ in range(60)]
    for a in words:
        for b in words:
            if len(a) - len(b) in (0, 1):
                array = pa.array([a, b])
                letters, length = spelling._letters(array), np.array([len(a), len(b)])
                assert bool(spelling._verified(np.array([0]), np.array([1]), letters, length, letters, length)[0]) == (a != b and spelling.one_edit(a, b))


# ---- rows without ids in earlier operators --------------------------------------------------------------

def test_rows_without_ids_spread_over_all_blocks(spark):
    from spanlake.llm import substring
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))
    passage = prose(30)
    rows = [(k if k % 2 else None, prose(40) + " " + passage * (k % 3 == 0) + " " + prose(20)) for k in range(600)]
    docs = table(spark, rows)
    total = substring.text_bytes(docs)
    dealt = substring.blocks_of(docs, total * 4_000_000 // (total // 20), []).groupBy("block").count().collect()
    assert len(dealt) == 20 and max(r["count"] for r in dealt) < 3 * 600 / 20

    def plain():
        split = [(d, t.split()) for d, t in rows]
        order = lambda d: (d is None, d or 0)
        least = {}
        for d, w in split:
            for i in range(len(w) - 12):
                key = tuple(w[i:i + 13])
                least[key] = min(least.get(key, d), d, key=order)
        out = Counter()
        for d, w in split:
            gone = {i + j for i in range(len(w) - 12) if order(least[tuple(w[i:i + 13])]) < order(d) for j in range(13)}
            out[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
        return out
    # Many blocks, whatever the size of the table.
    old = substring.BLOCK_BYTES, substring.MOST_BLOCK_BYTES
    substring.BLOCK_BYTES = substring.MOST_BLOCK_BYTES = total // 20
    try:
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect())
    finally:
        substring.BLOCK_BYTES, substring.MOST_BLOCK_BYTES = old
    assert got == plain()


def test_test_items_without_ids_hit_but_have_no_name(spark):
    from spanlake.llm import decontaminate
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(None, item), ("b", "alpha beta gamma"), (None, None)], "item_id string, text string")
    docs = table(spark, [(1, f"x {item} y"), (2, "no alpha beta gamma"), (3, "nothing"), (None, item)])
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digests(docs, benchmark).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (11, 0, sha(""), True), 2: (3, 1, sha("b"), True), 3: (0, 0, sha(""), False), None: (11, 0, sha(""), True)}
    blocks = decontaminate.occurrences(docs, benchmark, block_bytes=8).select("doc_id", "found").collect()
    assert {r.doc_id: (r.found["items"], [tuple(s) for s in r.found["spans"]]) for r in blocks} == {
        1: ([], [(1, 12)]), 2: (["b"], [(1, 4)]), 3: ([], []), None: ([], [(0, 11)])}
