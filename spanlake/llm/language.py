"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3 letters, words padded by a blank) in order. A
document's profile, over its whole text, is compared to each by the out-of-place distance: how far each n-gram's rank
is from its rank in the language, a full profile length where it is missing. The nearest language wins, ties go to the
first in alphabetical order.

Training uses at most about ``TRAIN_ROWS`` labelled rows. Null texts and texts without a letter are ``und``. Letters
that no language profile has are one class.

Null texts and texts without a letter are ``und`` with score 0; languages that are equally far are told apart by name. Repeated
rows are judged alike and count each time they are learned from, other columns are not read whatever their names, and an
empty table gives an empty result; without anything learned every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import chunks
from spanlake.llm.training import remainder, sampled

FOLDS, HELD = 4, 2
TRAIN_ROWS = 40_000
PROFILE = 400
ORDERS = (1, 2, 3)
#: Bytes of text whose n-grams are counted at once.
COUNT_BYTES = 2_000_000
UNKNOWN = "und"


BLANK = 1


class Letters:
    """Code points as codes: BLANK for what is no letter, 2... for an alphabet's letters, the last for all others.

    Without an alphabet, a letter's code is its code point.
    """

    def __init__(self, alphabet: str | None = None):
        self.known = None if alphabet is None else np.array(sorted(map(ord, alphabet)), np.int64)
        self.bits = 21 if alphabet is None else int(len(alphabet) + 2).bit_length()

    def code(self, points: np.ndarray) -> np.ndarray:
        table = np.zeros(0x110000, np.int64)
        table[points] = 1
        distinct = np.flatnonzero(table)
        letter = np.array([chr(p).isalpha() for p in distinct.tolist()], bool)
        code = distinct
        if self.known is not None:
            at = np.searchsorted(self.known, distinct)
            code = np.full(len(distinct), len(self.known) + 2)
            there = at < len(self.known)
            there[there] = self.known[at[there]] == distinct[there]
            code[there] = at[there] + 2
        table[distinct] = np.where(letter, code, BLANK)
        return table[points]

    def pack(self, gram: str) -> int:
        out = 0
        for c in self.code(np.array(list(map(ord, gram)), np.int64)).tolist():
            out = out << self.bits | c
        return out

    def unpack(self, value: int) -> str:
        """Only without an alphabet."""
        out = ""
        while value:
            out, value = chr(value & ((1 << self.bits) - 1)) + out, value >> self.bits
        return out.replace(chr(BLANK), " ")


def grams(texts: list[str | None], letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of the texts, as rows of texts and packed values; and which texts have a letter."""
    lowered = ["\n" + (t or "").lower() + "\n" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    code = letters.code(points)
    keep = np.append(True, (code[1:] > BLANK) | (code[:-1] > BLANK) | (doc[1:] != doc[:-1]))[:len(code)]   # runs of blanks are one
    code, doc = code[keep], doc[keep]
    has = np.zeros(len(texts), bool)
    has[doc[code > BLANK]] = True
    rows, values = [], []
    for k in ORDERS:
        n = len(code) - k + 1
        if n <= 0:
            continue
        value = code[:n]
        for i in range(1, k):
            value = value << letters.bits | code[i:n + i]
        good = doc[:n] == doc[k - 1:]
        # Within a word and its two blanks.
        good &= code[1:n + 1] > BLANK if k == 3 else code > BLANK if k == 1 else (code[:n] > BLANK) | (code[1:] > BLANK)
        rows.append(doc[:n][good])
        values.append(value[good])
    return np.concatenate(rows), np.concatenate(values), has


def counted(rows: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) and their counts."""
    key = np.sort(rows << bits | values)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> bits, key[first] & ((1 << bits) - 1), np.diff(np.append(first, len(key)))


def _pieces(batch: pa.RecordBatch, col: str) -> Iterator[tuple[int, list[str | None]]]:
    for lo, hi in chunks(batch.column(col), COUNT_BYTES):
        yield lo, batch.column(col).slice(lo, hi - lo).to_pylist()


def profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[str]]:
    """Per language its most frequent n-grams, most frequent first; labelled has text and a non-null lang."""
    plain = Letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _pieces(batch, "text"):
                langs = batch.column("lang").slice(lo, len(texts)).dictionary_encode()
                names = langs.dictionary.to_pylist()
                lang = langs.indices.to_numpy(zero_copy_only=False)
                rows, values, _ = grams(texts, plain)
                for k, name in enumerate(names):
                    value, n = np.unique(values[lang[rows] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(value, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
    counts = labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    out: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "place").collect():   # size rows per language
        out.setdefault(r["lang"], []).append(plain.unpack(r["gram"]))
    return out


def fit(docs: DataFrame, size: int = PROFILE) -> dict[str, list[str]]:
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD)).select(
        F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return profiles(sampled(own, F.col("doc_id"), TRAIN_ROWS), size)


class Matcher:
    """Distances of texts to language profiles."""

    def __init__(self, learned: dict[str, list[str]], size: int = PROFILE):
        self.size, self.langs = size, sorted(learned)
        self.letters = Letters("".join(sorted({c for x in learned.values() for g in x for c in g if c.isalpha()})))
        ranks: dict[int, np.ndarray] = {}
        for k, lang in enumerate(self.langs):
            for r, gram in enumerate(learned[lang]):
                ranks.setdefault(self.letters.pack(gram), np.full(len(self.langs), -1))[k] = r
        self.grams = np.array(sorted(ranks), np.int64)
        self.ranks = np.array([ranks[g] for g in sorted(ranks)], np.int64).reshape(len(ranks), len(self.langs))

    def match(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 - nearest / second nearest distance. Nothing learned: all unknown."""
        if not len(self.grams):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows, values, has = grams(texts, self.letters)
        bits = 3 * self.letters.bits
        doc, gram, n = counted(rows, values, bits)
        order = np.lexsort((gram, -n, doc)) if bits + 42 > 62 or (len(n) and n.max() >= 1 << 22) or len(texts) >= 1 << 20 else None
        if order is None:   # one sort of packed keys: row, falling count, n-gram
            key = np.sort(doc << (bits + 22) | ((1 << 22) - 1 - n) << bits | gram)
            doc, gram = key >> (bits + 22), key & ((1 << bits) - 1)
        else:
            doc, gram = doc[order], gram[order]
        starts = np.searchsorted(doc, np.arange(len(texts)))
        place = np.arange(len(doc)) - starts[doc]
        top = place < self.size
        doc, gram, place = doc[top], gram[top], place[top]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        there = self.grams[at] == gram
        distance = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            rank = np.where(there, self.ranks[at, k], -1)
            distance[:, k] = np.bincount(doc, np.where(rank >= 0, np.abs(rank - place), self.size), len(texts))
        # Texts of two languages may be equally far from both: the first by name.
        best = distance.argmin(axis=1)
        ordered = np.sort(distance, axis=1)
        worst = np.maximum(np.bincount(doc, minlength=len(texts)) * self.size, 1)
        second = ordered[:, 1] if len(self.langs) > 1 else worst
        score = np.where(has, np.clip(1 - ordered[:, 0] / np.maximum(second, 1e-9), 0, 1), 0.0)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)], score


def identified(docs: DataFrame, learned: dict[str, list[str]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(learned, size)
        for batch in batches:
            for lo, texts in _pieces(batch, "text"):
                lang, score = matcher.match(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 ["doc_id", "lang_pred", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the others' lang."""
    return identified(docs, fit(docs)).select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
