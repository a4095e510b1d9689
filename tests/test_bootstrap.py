"""Resampling by count vectors against resampling by episodes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import stats

COLUMNS = [f"{p}_{c}" for p in "ab" for c in stats.SUMS]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        n = rng.randrange(1, 5)
        a, b = rng.randrange(0, n + 1), rng.randrange(0, n + 1)
        rows.append((f"e{k}", *(int(v) for v in (n, n, a, a, n, a, a, a, n, n, n, b, b, n, b, b, b, n))))
    return spark.createDataFrame(rows, "episode_id string, " + ", ".join(f"{c} long" for c in COLUMNS)).cache()


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_vectors_have_the_distribution_of_the_index_form(spark, pairs, monkeypatch, chunk):
    monkeypatch.setattr(stats, "CHUNK_VECTORS", chunk)
    n = 2_000
    a, b = (np.array([[r[c] for c in COLUMNS] for r in stats.resample(pairs, n, 5, m).select(*COLUMNS).collect()], float) for m in ("index", "vectors"))
    assert a.shape == b.shape == (n, len(COLUMNS))
    error = np.sqrt((a.var(axis=0) + b.var(axis=0)) / n)
    assert (np.abs(a.mean(axis=0) - b.mean(axis=0)) <= 4.5 * error + 1e-9).all()
    assert (np.abs(a.std(axis=0) / np.maximum(b.std(axis=0), 1e-9) - 1) < 0.1)[a.std(axis=0) > 0].all()
    # Sums of one resample hang together: correlations agree too.
    varying = a.std(axis=0) > 0
    assert np.abs(np.corrcoef(a[:, varying].T) - np.corrcoef(b[:, varying].T)).max() < 0.12


def test_every_resample_draws_all_episodes(spark):
    rows = [(f"e{k}", *([1] * len(COLUMNS))) for k in range(90)]
    same = spark.createDataFrame(rows, "episode_id string, " + ", ".join(f"{c} long" for c in COLUMNS))
    assert {r[COLUMNS[0]] for r in stats.resample(same, 50, 1, "vectors").collect()} == {90}
    assert stats.resample(same.limit(0), 5, 1, "vectors").count() == 5


def test_draws_repeat(pairs):
    one, two = (sorted(stats.resample(pairs, 20, 9, "vectors").collect()) for _ in range(2))
    assert one == two


@pytest.mark.parametrize("method", ["poisson", "index"])
def test_a_draw_is_hashed_once(pairs, method):
    plan = stats.resample(pairs, 20, 9, method)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def _hash(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_poisson_sums_against_plain_weights(spark, pairs):
    rows = [r for r in pairs.collect() if r.episode_id in {f"e{k}" for k in range(12)}]
    few = spark.createDataFrame(rows, pairs.schema).unionByName(pairs.limit(1).withColumn("episode_id", F.lit(None).cast("string")))
    got = {r.b: r for r in stats.resample(few, 50, 9, "poisson").collect()}
    steps = stats.poisson_steps()
    weights = {b: {r.episode_id: sum(_hash(9, b, r.episode_id) / 2 ** 32 >= t for t in steps) for r in rows} for b in range(50)}
    assert set(got) == {b for b, w in weights.items() if sum(w.values())}
    assert all(got[b][c] == sum(weights[b][r.episode_id] * r[c] for r in rows) for b in got for c in COLUMNS)


def test_index_sums_are_the_same_beyond_the_broadcast(pairs, monkeypatch):
    near = sorted(stats.resample(pairs, 20, 9).collect())
    monkeypatch.setattr(stats, "BROADCAST_ROWS", 10)
    far = stats.resample(pairs, 20, 9)
    assert sorted(far.collect()) == near and "ShuffledHashJoin" in far._jdf.queryExecution().executedPlan().toString()
