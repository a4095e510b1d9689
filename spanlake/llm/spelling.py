"""Spelling variants: words one edit apart, found in a trie over frequency vectors.

A word's frequency vector is its length, then how many of its letters are in each group. One inserted, deleted or replaced
letter changes it by at most one surplus and one deficit. Words are arranged in a trie by these counts, one level a count, and a
search walks it depth first with a budget of one surplus and one deficit. Each pair is sought from one of its words: the longer
one, which lacks one letter in the other (a deficit), or of two equally long ones that whose first difference is a surplus; within one
vector the smaller one. Words at the leaves are verified letter by letter.

* The trie's upper nodes are counted in Spark, level by level, until a node holds at most ``NODE_WORDS`` words. They are as many as
  the vocabulary needs, about its size over ``NODE_WORDS``, and never over ``MOST_NODES`` times the branching. A word goes to its own node as an
  entry and along its search to the nodes within budget as a query, so no task holds more than one node's words and a batch of queries.
* If very many words have one vector (anagrams), its node is divided by the first ``HALF`` letters and again by the last ``HALF``: of
  words of at least 2 * HALF + 1 letters, one edit leaves one of the two unchanged.
* A node returns, for each word, how many near words it found there and the most frequent one, never the pairs.
* Below the upper nodes the same walk runs over a sorted array of vectors, with all queries that reach a node taken together.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case. Null and empty texts have none, repeated
rows count each time, a null doc_id counts as empty text, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import ASCII_LOWER, Words, chunks, written

#: Letters are grouped by code point modulo this: A-Z alone, each accented letter with one of them.
GROUPS = 32
#: Groups in the order of the trie's levels: that of the letters' frequency in Latin script, the other groups last. It affects speed only.
LEVELS = [ord(c) % GROUPS for c in "eaintrosldcumphgbfvykwzxqj"] + [0, 27, 28, 29, 30, 31]
#: Most words in a node before it is divided, and nodes from which on it holds more.
NODE_WORDS, MOST_NODES = 50_000, 20_000
#: Least letters of a word, and letters at either end by which a node of one vector is divided.
MIN_CHARS = 7
HALF = (MIN_CHARS - 1) // 2
#: Queries that search a node together, and words below which the walk ends.
QUERIES, LEAF = 200_000, 8
_WIDTH = 24  # words up to this length are verified in numpy

_FOUND = "word string, n_near long, near_n long, near string"


# ---- words ------------------------------------------------------------------------------------------

def latin_words(texts: pa.Array) -> pa.Array:
    """Lists of the runs of letters, A-Z in lower case."""
    if texts.nbytes == 0 or not len(texts):
        return pa.array([None] * len(texts), pa.list_(pa.string()))
    valid, offsets, data = texts.buffers()
    if data is not None and data.size:
        raw = np.frombuffer(data, np.uint8)
        low = ASCII_LOWER[raw]
        lead = raw == 0xC3  # of U+00C0 to U+00FF
        letter = (low >= 97) & (low <= 122) | lead
        letter[1:] |= lead[:-1]
        data = pa.py_buffer(np.where(letter, low, 32).astype(np.uint8))
    texts = pa.Array.from_buffers(texts.type, len(texts), [valid, offsets, data], offset=texts.offset)
    trimmed = pc.ascii_trim_whitespace(texts)
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))


def _counted(every: int, min_chars: int):
    """Words and their counts in parts of a table; where the checksum of document and word says so, one letter is deleted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column("text")):
                words = Words(latin_words(batch.column("text").slice(lo, hi - lo)))
                if not len(words.codes):
                    continue
                long = pc.greater_equal(pc.utf8_length(words.forms), min_chars).to_numpy(zero_copy_only=False)
                use = long[words.codes]
                pairs, n = np.unique(words.doc[use] * len(long) + words.codes[use], return_counts=True)
                doc, code = np.divmod(pairs, len(long))
                starts = [zlib.crc32(f"{d}:".encode()) for d in batch.column("doc").slice(lo, hi - lo).to_pylist()]
                forms = words.forms.to_pylist()
                raw = [f.encode() for f in forms]
                h = np.fromiter((zlib.crc32(raw[c], starts[d]) for d, c in zip(doc.tolist(), code.tolist())), np.int64, len(code)) if every else np.ones(len(code))
                cut = h % every == 0 if every else np.zeros(len(code), bool)
                whole = np.bincount(code[~cut], n[~cut], len(long)).astype(np.int64)
                there = np.flatnonzero(whole)
                out = [forms[c] for c in there.tolist()]
                count = whole[there].tolist()
                for c, x, k in zip(code[cut].tolist(), h[cut].tolist(), n[cut].tolist()):
                    at = x % len(forms[c])
                    if len(forms[c]) > min_chars:
                        out.append(forms[c][:at] + forms[c][at + 1:])
                        count.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(count, pa.int64())], ["word", "n"])
    return run


def vocabulary(docs: DataFrame, delete_every: int = 0, min_chars: int = MIN_CHARS, min_count: int = 2) -> DataFrame:
    """docs (doc_id, text) -> (word, n). With delete_every = e, the letter at crc32("doc_id:word") modulo the word's length is deleted
    from all of the document's occurrences where e divides the checksum: a made-up source of misspellings."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(delete_every, min_chars), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- frequency vectors --------------------------------------------------------------------------------

def vectors(words: pa.Array) -> np.ndarray:
    """Length and letters in each group, one row a word."""
    bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0]:bounds[-1]].astype(np.int64) if bounds[-1] > bounds[0] else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(words)), np.diff(bounds))
    letter = data != 0xC3
    group = (data + np.where(data >= 0x80, 0x40, 0)) % GROUPS
    counts = np.bincount(row[letter] * GROUPS + group[letter], minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return np.column_stack([counts.sum(axis=1), counts[:, LEVELS]]).astype(np.int32)


def _stepped(count: int, own: np.ndarray, state: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which queries may go to the child with this count, and their states there.

    State 2: nothing spent; 1: a surplus spent, or a longer word's start, so a deficit is due; 0: all spent.
    """
    diff = count - own
    if level == 0:
        go = (diff == 0) | (diff == -1)
        return go, (2 + diff)[go]
    go = (diff == 0) | (diff == 1) & (state == 2) | (diff == -1) & (state == 1)
    return go, state[go] - (diff[go] != 0)


# ---- the upper trie -------------------------------------------------------------------------------------

def _prefix(level: int):
    return F.expr(f"substring(vec, 1, {4 * level})")


def upper_nodes(words: DataFrame, node_words: int) -> dict[bytes, bool]:
    """Prefixes of vectors with at most so many words, by counting the children of larger ones; true where a whole vector has more."""
    total = words.count()
    limit = max(node_words, total // MOST_NODES)
    if total <= limit:
        return {b"": False}
    nodes, large = {}, [b""]
    for level in range(1, GROUPS + 2):
        part = words
        if level > 1:
            those = words.sparkSession.createDataFrame([(bytearray(p),) for p in large], "p binary")
            part = words.join(F.broadcast(those), _prefix(level - 1) == F.col("p"), "left_semi")  # no more than the vocabulary over the limit
        large = []
        for p, n in part.groupBy(_prefix(level).alias("p")).count().collect():
            if n > limit and level <= GROUPS:
                large.append(bytes(p))
            else:
                nodes[bytes(p)] = n > limit
        if not large:
            break
    return nodes


def _routes(nodes: dict[bytes, bool]):
    """Rows (node, own, word, n): every word at its own node and at those that its search may reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: dict = {}
        for p in nodes:
            here = tree
            for k in range(0, len(p), 4):
                here = here.setdefault(int.from_bytes(p[k:k + 4]), {})
            here[None] = p

        for batch in batches:
            words = batch.column("word")
            vecs = vectors(words)
            out: list[tuple[bytes, np.ndarray, np.ndarray]] = []

            def walk(here: dict, level: int, rows: np.ndarray, state: np.ndarray, own: np.ndarray):
                if None in here:
                    out.append((here[None], rows, own))
                    return
                for count, child in here.items():
                    go, after = _stepped(count, vecs[rows, level], state, level)
                    if go.any():
                        walk(child, level + 1, rows[go], after, own[go] & (vecs[rows[go], level] == count))

            n = len(words)
            walk(tree, 0, np.arange(n), np.full(n, 2), np.ones(n, bool))
            for p, rows, own in out:
                there, name = batch.take(pa.array(rows)), p.hex()
                if not nodes[p]:
                    yield _routed(pa.array([name] * len(rows)), own, there)
                    continue
                for mark, (a, b) in (("p", (0, HALF)), ("s", (-HALF, None))):
                    key = [f"{name}{mark}{w[a:b]}" for w in there.column("word").to_pylist()]
                    yield _routed(pa.array(key), own, there)
    return run


def _routed(node: pa.Array, own: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([node, pa.array(own), part.column("word"), part.column("n")], ["node", "own", "word", "n"])


# ---- the search below a node ------------------------------------------------------------------------------

class Entries:
    """A node's words, sorted by vector."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        vecs = vectors(words)
        order = np.lexsort(vecs.T[::-1])
        self.words, self.n, self.vecs = words.take(pa.array(order)), n[order], vecs[order]
        self.letters, self.length = _letters(self.words), self.vecs[:, 0]

    def candidates(self, vecs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, entries) whose vectors are within budget; for equal vectors both directions."""
        stack = [(0, len(self.n), 0, np.arange(len(vecs)), np.full(len(vecs), 2, np.int32))]
        while stack:
            lo, hi, level, rows, state = stack.pop()
            if hi - lo <= LEAF and level or level > GROUPS:
                yield from self._leaf(lo, hi, level, vecs, rows, state)
                continue
            column = self.vecs[lo:hi, level]
            cuts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            own = vecs[rows, level]
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], hi - lo).tolist()):
                go, after = _stepped(int(column[a]), own, state, level)
                if len(after):
                    stack.append((lo + a, lo + b, level + 1, rows[go], after))

    def _leaf(self, lo: int, hi: int, level: int, vecs: np.ndarray, rows: np.ndarray, state: np.ndarray):
        step = max(1, 2_000_000 // ((hi - lo) * GROUPS))
        for k in range(0, len(rows), step):
            part, due = rows[k:k + step], state[k:k + step, None]
            diff = self.vecs[None, lo:hi, level:] - vecs[part, None, level:]
            spent = np.abs(diff).sum(axis=2)
            # Two differences are a surplus, then a deficit; the lengths make sure that their sum fits.
            fit = (spent == 0) & (due != 1) | (spent == 1) & (due == 1)
            two = np.argwhere((spent == 2) & (due == 2))
            if len(two):
                d = diff[two[:, 0], two[:, 1]]
                first = d[np.arange(len(d)), (d != 0).argmax(axis=1)]
                good = two[(first == 1) & (d.min(axis=1) == -1)]
                fit[good[:, 0], good[:, 1]] = True
            q, e = np.nonzero(fit)
            if len(q):
                yield part[q], lo + e


def _letters(words: pa.Array) -> np.ndarray:
    """Letters of words up to _WIDTH in rows of that width; longer ones are empty rows."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    return np.array([w if len(w) <= _WIDTH else b"" for w in raw], f"S{_WIDTH}").view(np.uint8).reshape(len(raw), _WIDTH)


def one_edit(a: str, b: str) -> bool:
    """True if one inserted, deleted or replaced letter makes a into b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1:] == (b[k + 1:] if len(a) == len(b) else b[k:])


def _verified(q: np.ndarray, e: np.ndarray, q_letters: np.ndarray, q_length: np.ndarray, e_letters: np.ndarray, e_length: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; the query is as long as the entry or one letter longer. Words within _WIDTH only."""
    a, b = q_letters[q], e_letters[e]
    differ = a != b
    same = q_length[q] == e_length[e]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), _WIDTH)
    moved = np.pad(a[:, 1:], ((0, 0), (0, 1))) != b
    last = np.where(moved.any(axis=1), _WIDTH - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return np.where(same, differ.sum(axis=1) == 1, last < first)


def _near(entries: Entries, words: pa.Array, n: np.ndarray, rule: str) -> Iterator[pa.RecordBatch]:
    """What a node tells about a batch of queries and about its entries."""
    vecs = vectors(words)
    letters, length = _letters(words), vecs[:, 0]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        q, e = (np.concatenate(x) for x in zip(*held))
        held.clear()
        short = (length[q] <= _WIDTH) & (entries.length[e] <= _WIDTH)
        good = np.zeros(len(q), bool)
        good[short] = _verified(q[short], e[short], letters, length, entries.letters, entries.length)
        for k in np.flatnonzero(~short).tolist():
            good[k] = one_edit(words[int(q[k])].as_py(), entries.words[int(e[k])].as_py())
        q, e = q[good], e[good]
        if not len(q):
            return
        left, right = words.take(pa.array(q)), entries.words.take(pa.array(e))
        # One vector: both words seek each other, the smaller counts. A pair that also shares its first letters was met there.
        once = ~(vecs[q] == entries.vecs[e]).all(axis=1) | pc.less(left, right).to_numpy(zero_copy_only=False)
        if rule == "s":
            once &= pc.not_equal(pc.utf8_slice_codeunits(left, 0, HALF), pc.utf8_slice_codeunits(right, 0, HALF)).to_numpy(zero_copy_only=False)
        keep = pa.array(once)
        left, right, q, e = left.filter(keep), right.filter(keep), q[once], e[once]
        yield from _best(left, right, entries.n[e])
        yield from _best(right, left, n[q])

    size = 0
    for q, e in entries.candidates(vecs):
        held.append((q, e))
        size += len(q)
        if size >= 500_000:
            yield from flush()
            size = 0
    yield from flush()


def _best(word: pa.Array, near: pa.Array, near_n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per word the number of near words and the most frequent one, the smallest of equals."""
    if not len(word):
        return
    code = word.dictionary_encode()
    rank = pc.rank(near, tiebreaker="dense").to_numpy()
    at = code.indices.to_numpy()
    order = np.lexsort((rank, -near_n, at))
    first = order[np.append(True, at[order][1:] != at[order][:-1])]
    yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(at[first])), pa.array(np.bincount(at)[at[first]]), pa.array(near_n[first]), near.take(pa.array(first))],
                                     ["word", "n_near", "near_n", "near"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by (node, entries first): each node's entries are held, its queries come in batches."""
    node, owned, entries, waiting, size = None, [], None, [], 0

    def ask() -> Iterator[pa.RecordBatch]:
        nonlocal entries, waiting, size
        if entries is None and owned:
            t = pa.Table.from_batches(owned).combine_chunks()
            entries = Entries(t.column("word").chunk(0), t.column("n").to_numpy())
            owned.clear()
        if waiting and entries is not None:
            t = pa.Table.from_batches(waiting).combine_chunks()
            rule = "s" if "s" in node else "p"
            yield from _near(entries, t.column("word").chunk(0), t.column("n").to_numpy(), rule)
        waiting, size = [], 0

    for batch in batches:
        nodes = batch.column("node").dictionary_encode()
        codes = nodes.indices.to_numpy()
        cuts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(codes)).tolist()):
            here = nodes.dictionary[int(codes[a])].as_py()
            if here != node:
                yield from ask()
                node, entries = here, None
                owned.clear()
            part = batch.slice(a, b - a)
            own = part.filter(part.column("own"))
            if len(own):
                owned.append(own)
            waiting.append(part)
            size += len(part)
            # Entries come first, so all are known once a row is none of them.
            if size >= QUERIES and len(own) < len(part):
                yield from ask()
    yield from ask()


def near_words(words: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """words (word, n) -> (word, n, n_near, near, near_n): the number of words one edit away and the most frequent of them."""
    def with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = vectors(batch.column("word")).astype(">u4")
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([v.tobytes() for v in vecs], pa.binary())], ["word", "n", "vec"])

    words = written(words.select("word", "n").mapInArrow(with_vectors, "word string, n long, vec binary"), "vocabulary")
    nodes = upper_nodes(words, node_words)
    routed = words.select("word", "n").mapInArrow(_routes(nodes), "node string, own boolean, word string, n long")
    found = routed.repartition(F.col("node")).sortWithinPartitions("node", F.col("own").desc()).mapInArrow(_searched, _FOUND)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))))
    each = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    merged = each.unionByName(found.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", F.col("b.word").alias("near"), (-F.col("b.n")).alias("near_n"))


def variants(words: DataFrame, ratio: int = 10, node_words: int = NODE_WORDS) -> DataFrame:
    """words (word, n) -> (word, form, root, n, n_near, form_n).

    A word's form is its most frequent near word, if that has at least ratio times its count. Forms grow by that factor from step to step,
    so chains are short; roots come by doubling the steps, at most five rounds of joins for counts below 10^19 and a ratio of 10.
    """
    near = near_words(words, node_words)
    is_form = F.col("near_n") >= ratio * F.col("n")
    known = written(near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    steps = known.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("w"), F.col("root").alias("further"))
        # Both sides grow with the vocabulary.
        steps = written(steps.join(on.hint("merge"), F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not steps.where("moved").head(1):
            break
        steps = steps.select("word", "root")
    roots = steps.select(F.col("word").alias("w"), "root")
    return known.join(roots.hint("merge"), F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digests(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole documents, with made-up misspellings: one letter is gone where 31 divides a checksum."""
    return variants(vocabulary(docs, delete_every=31))


SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(t ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) AS t FROM range(256) r(i))),
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM documents),
counted AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
bytes AS (
    SELECT w, n, list_transform(range(strlen(s)), lambda i: CAST(('0x' || substr(hex(encode(s)), 2 * i + 1, 2)) AS BIGINT)) AS b FROM counted),
summed AS (
    SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS h
    FROM bytes, crc_table),
made AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM summed),
words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(m := -near_n, near := near)) AS b FROM pairs GROUP BY word),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.near END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
    FROM words w LEFT JOIN best USING (word)),
chain AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
