"""Toxic passages by maximum-scoring segments.

Token scores are log-odds between toxic and other labelled texts with an informative Dirichlet prior: the prior of a
token is its share of all labelled text, so rare tokens are drawn to zero; tokens whose log-odds are within the noise
score only the drift, a small negative value. A linear-time scan finds all maximal scoring segments of a text. Their
scores are calibrated as extreme values: with lambda from the score distribution of clean text, a segment's excess is
lambda * S - ln(K n) in a text of n tokens, and exp(-excess) texts of that length are expected to hold one as good by
chance. The excesses of a text's segments are joined to a probability by a logistic fit on the training rows.

Null and empty texts have no segment. Labels that are null or repeat a doc_id count as they come. At most about
``TRAIN_ROWS`` labelled rows are used for training; all documents are scored, over their whole text.

Null and empty texts are scored like any text without a scoring token. Rows that repeat a doc_id are learned from each time their id
is labelled and are judged alike; ids without a document and null labels are left out; with labels of one kind, or none, every text
gets that kind's score. Other columns are not read whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import Words, ascii_words, chunks, written
from spanlake.llm.training import remainder, sampled

FOLDS = 5
#: Bound of the training sample. The model holds every token that scores there, and every one seen often.
TRAIN_ROWS = 40_000
#: Weight of the prior in tokens, least z of a scoring token, largest |score|, score of all other tokens.
PRIOR = 1_000.0
LEAST_Z = 4.0
LARGEST = 8.0
DRIFT = -0.5
#: Letters of the stems that stand in for tokens not seen in training; a stem is scored like a token.
STEM = 4
_EDGES = ".,;:!?\"'()[]{}<>-*#"


def normal(forms: list[str]) -> list[str]:
    """Tokens as they are counted: lower case, without punctuation at the ends."""
    return [x.lower().strip(_EDGES) or x for x in forms]


def stem(token: str) -> str:
    return "\0" + token[:STEM]


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    known: frozenset[str]      # tokens frequent enough in training to be judged by themselves
    rate: float                # lambda
    log_k: float
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def of(self, forms: pa.Array) -> np.ndarray:
        """Score of every word form."""
        out = []
        for t in normal(forms.to_pylist()):
            s = self.scores.get(t)
            if s is None:
                s = DRIFT if t in self.known or len(t) <= STEM else self.scores.get(stem(t), DRIFT)
            out.append(s)
        return np.array(out, np.float64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Candidates carry the sum of all scores before them (low) and up to their end (high). A new positive score is
    joined with the nearest earlier candidate that begins lower, as long as that one does not end higher.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.cumsum(scores)
    found: list[tuple[int, int, float, float]] = []
    for i, low, high in zip(positive.tolist(), (total[positive] - scores[positive]).tolist(), total[positive].tolist()):
        start = i
        while True:
            j = len(found) - 1
            # Candidates that begin no lower can't be joined with, but later ones may still be; skip over them.
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def summary(model: Model, scores: np.ndarray) -> tuple[tuple[float, float], list[tuple[int, int, float]]]:
    """Features of a text (excess of the best segment; log of the summed excesses) and its significant segments."""
    excess = [(a, b, model.rate * s - model.log_k - np.log(max(2, len(scores)))) for a, b, s in segments(scores)]
    good = [x for x in excess if x[2] > 0]
    best = max((x[2] for x in excess), default=-10.0)
    return (float(np.clip(best, -10, 40)), float(np.log1p(sum(x[2] for x in good)))), good


def _texts(batch: pa.RecordBatch, col: str) -> Iterator[tuple[int, Words]]:
    for lo, hi in chunks(batch.column(col)):
        yield lo, Words(ascii_words(batch.column(col).slice(lo, hi - lo)))


def count_tokens(labelled: DataFrame) -> DataFrame:
    """token, n0, n1: texts labelled 0 and 1 that have a token, or a stem. Counting texts, not occurrences, keeps a
    single text that repeats a token from making it look telling."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").fill_null(0).to_numpy(zero_copy_only=False) == 1
            for lo, words in _texts(batch, "text"):
                tokens = normal(words.forms.to_pylist())
                for kind in (tokens, [stem(t) for t in tokens]):
                    coded = pa.array(kind, pa.string()).dictionary_encode()
                    forms = coded.dictionary
                    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.codes] if len(words.codes) else words.codes
                    pair = np.unique(words.doc * np.int64(max(1, len(forms))) + code)
                    label = toxic[lo + pair // max(1, len(forms))]
                    n1 = np.bincount(pair[label] % max(1, len(forms)), minlength=len(forms))
                    n0 = np.bincount(pair[~label] % max(1, len(forms)), minlength=len(forms))
                    yield pa.RecordBatch.from_arrays([forms, pa.array(n0), pa.array(n1)], ["token", "n0", "n1"])
    found = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "token string, n0 long, n1 long")
    return found.groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def token_scores(counts: DataFrame) -> tuple[dict[str, float], frozenset[str], float]:
    """Scores, tokens known without a score, and lambda."""
    counts = written(counts.where("n0 + n1 >= 3"), "toxicity-counts")
    kind = F.when(F.col("token").startswith("\0"), 1).otherwise(0)
    totals = {r[0]: (float(r[1]), float(r[2])) for r in counts.groupBy(kind.alias("k")).agg(F.sum("n0"), F.sum("n1")).collect()}
    t0, t1 = totals.get(0, (0.0, 0.0))
    if not t0 or not t1:
        return {}, frozenset(), 1.0
    prior = (F.col("n0") + F.col("n1")) * (PRIOR / (t0 + t1))
    y0, y1 = F.col("n0") + prior, F.col("n1") + prior
    odds = F.log(y1 / (t1 + PRIOR - y1)) - F.log(y0 / (t0 + PRIOR - y0))
    # Significance by the root of the likelihood ratio, which also holds for counts of zero.
    part = lambda n, share: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("n0") + F.col("n1")) * share))).otherwise(0.0)
    ratio = part("n0", t0 / (t0 + t1)) + part("n1", t1 / (t0 + t1))
    scored = counts.select("token", "n0", odds.alias("odds"), F.sqrt(2 * F.greatest(ratio, F.lit(0.0))).alias("z")).where(F.col("z") >= LEAST_Z)
    rows = scored.orderBy(F.desc("z"), "token").collect()    # tokens of the bounded sample
    scores = {r["token"]: float(np.clip(r["odds"] + DRIFT, -LARGEST, LARGEST)) for r in rows}
    # Tokens that are frequent but score nothing must not fall back to their stem.
    known = frozenset(r[0] for r in counts.where((F.col("n0") + F.col("n1") >= 8) & ~F.col("token").startswith("\0"))
                      .select("token").collect())
    # lambda: the mean of exp(lambda * score) over clean tokens is 1.
    value = np.array([scores[r["token"]] for r in rows if r["token"][0] != "\0"] + [DRIFT])
    share = np.array([r["n0"] + 0.5 for r in rows if r["token"][0] != "\0"] + [0.0])
    share[-1] = max(t0 - share.sum(), 1.0)
    share /= share.sum()
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(np.minimum(mid * value, 500)) < 1 else (low, mid)
    return scores, known, max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights with a small ridge, intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents outside the held-out fold."""
    own = labels.where((remainder(F.col("doc_id"), FOLDS) != 0) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("label_id"), "toxic")
    # Bounded by TRAIN_ROWS, so it can be broadcast.
    own = F.broadcast(sampled(own, F.col("label_id"), TRAIN_ROWS))
    labelled = written(docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("label_id")).select("text", "toxic"), "toxicity-labelled")
    scores, known, rate = token_scores(count_tokens(labelled))
    raw = Model(scores, known, rate, 0.0)

    def features(model: Model) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, words in _texts(batch, "text"):
                    s = model.of(words.forms)[words.codes] if len(words.codes) else np.zeros(0)
                    rows = [summary(model, s[a:b])[0] for a, b in zip(words.bounds, words.bounds[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()),
                                                      batch.column("toxic").slice(lo, len(rows)).cast(pa.int32())], ["best", "sum", "toxic"])
        rows = np.array(labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "best double, sum double, toxic int").collect(), float).reshape(-1, 3)
        return rows[:, :2], rows[:, 2]

    x, y = features(raw)
    clean = x[(y == 0) & (x[:, 0] > -10), 0]
    log_k = float(np.mean(clean) - np.euler_gamma) if len(clean) else 0.0   # the mean of a standard extreme value
    model = Model(scores, known, rate, log_k)
    x, y = features(model)
    if not len(y) or y.min() == y.max():
        return Model(scores, known, rate, log_k, (0.0, 0.0, 5.0 if len(y) and y.max() == 1 else -5.0))
    return Model(scores, known, rate, log_k, _logistic(x, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages: significant segments as word ranges with their excess."""
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        for batch in batches:
            for lo, words in _texts(batch, "text"):
                s = model.of(words.forms)[words.codes] if len(words.codes) else np.zeros(0)
                found = [summary(model, s[a:b]) for a, b in zip(words.bounds, words.bounds[1:])]
                x = np.array([f for f, _ in found]).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(x @ w[:2] + w[2], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(found)), pa.array(p), pa.array(
                    [[{"start": a, "end": b, "excess": e} for a, b, e in good] for _, good in found], passage)], ["doc_id", "score", "passages"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, passages array<struct<start: long, end: long, excess: double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every document."""
    return scored(docs, fit(docs, labels)).select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                                                  (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
