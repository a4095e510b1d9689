import random

import plain
import pytest
from pyspark.sql import functions as F

from spanlake.functions import intervals as iv
from spanlake.functions.rounding import round_true
from spanlake.operators import errors, report, scoring, stats

GOLD = [(0, 2), (2, 5), (5, 9)]
K = ("run", "e")


def one(df):
    return df.first().asDict()


def score(spans, pred, gold=GOLD):
    p, g = spans({("r", "1"): pred}), spans({("r", "1"): gold})
    return one(scoring.segmentation_score(p, g, split=False))


def test_iou(spark):
    df = spark.createDataFrame([(0., 4., 2., 6.), (0., 2., 2., 4.), (0., 2., 0., 2.), (1., 1., 1., 1.)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(iv.iou("a", "b", "c", "d")).collect()] == [2 / 6, 0.0, 1.0, 0.0]


def test_rounding_equals_python(spark):
    rng = random.Random(1)
    values = [rng.randrange(0, 10 ** 6) / 1000 for _ in range(3000)] + [2.675, 0.125, 0.375, 1.005, -1.005, -0.125]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_true(F.col("x"), 2)).collect()
    assert all(r[1] == round(r[0], 2) for r in rows)


def test_perfect_one_to_one_over_and_blob(spans):
    assert score(spans, GOLD)["f1"] == 1.0
    assert score(spans, [(0, 2), (0.1, 2), (0, 1.9)], [(0, 2)])["n_matched"] == 1
    over = score(spans, [(0, 1), (1, 2), (2, 3), (3, 5), (5, 7), (7, 9)])
    assert over["recall"] == 1.0 and over["precision"] < 0.6
    assert score(spans, [(0, 9)])["f1"] == 0.0


@pytest.mark.parametrize("given,expected", [(GOLD, [2, 5]), ([(0, 9)], []), ([(0, 2), (3, 5)], [2.5]), ([(0, 2), (2, 2), (2, 5)], [2]),
                                            ([(0, 1), (1 + 8e-7, 2), (1.0000016, 1.0000016), (1.0000016, 3)], None)])
def test_internal_boundaries(spans, given, expected):
    got = [r.t for r in scoring.internal_boundaries(spans({("r", "1"): given}), split=False).orderBy("b_idx").collect()]
    assert got == (plain.boundaries(given) if expected is None else expected)


def test_boundary_tolerance(spans):
    p, g = spans({("r", "1"): [(0, 2.4), (2.4, 5.4), (5.4, 9)]}), spans({("r", "1"): GOLD})
    row = one(scoring.boundary_score(p, g, split=False))
    assert row["recall_0_25"] == 0.0 and row["recall_0_5"] == 1.0 and abs(row["median_error"] - 0.4) < 1e-6


def test_pooling_buckets_and_snapping(spans, spark):
    pred = spans({("r", "1"): GOLD, ("r", "2"): [(0, 9)], ("s", "1"): [(0, 2), (2, 9)], ("t", "1"): [(0.4, 2), (2, 5), (5, 8)]})
    gold = spans({(r, e): GOLD for r, e in (("r", "1"), ("r", "2"), ("r", "3"), ("s", "1"), ("t", "1"))})
    rows = spark.createDataFrame([(r, e, "f") for r, e in (("r", "1"), ("r", "2"), ("r", "3"), ("s", "1"), ("t", "1"))],
                                 "run string, episode_id string, family string")
    counts = scoring.episode_counts(pred, gold, rows, split=False).cache()
    rep = {r.run: r for r in scoring.report(counts).collect()}
    assert (rep["r"].episodes, rep["r"].segments_gold, rep["r"].segments_matched) == (3, 9, 3)
    assert rep["r"].boundary_recall_0_25 == 2 / 6
    assert rep["t"].f1_snapped == 1.0
    short = {r.bucket: (r.recall, r.n) for r in scoring.recall_by_duration(counts).filter("run = 's'").collect()}
    assert short == {"2-4": (0.5, 2), "4-8": (1.0, 1)}


@pytest.fixture(scope="module")
def random_case(spans):
    rng = random.Random(7)
    pred = {("r", str(e)): plain.random_spans(rng, rng.randrange(0, 12), e % 2 == 0) for e in range(30)}
    gold = {("r", str(e)): plain.random_spans(rng, rng.randrange(1, 12), e % 3 == 0) for e in range(30)}
    return pred, gold, spans(pred).cache(), spans(gold).cache()


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("least", [0.1, 0.5])
def test_matching_equals_brute_force(random_case, split, least):
    pred, gold, p, g = random_case
    got = {}
    for r in scoring.match(p, g, least, split=split).collect():
        got.setdefault((r.run, r.episode_id), []).append((r.p_idx, r.g_idx))
    want = {k: m for k in gold if (m := plain.match(pred[k], gold[k], least))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_rounds_equal_fold_and_prefix_is_stable(random_case):
    _, _, p, g = random_case
    pairs = scoring.candidates(p, g, 0.1, split=False)
    whole = scoring.greedy(pairs, split=False).select("episode_id", "p_idx", "g_idx", "iou")
    rounds = scoring._match_rounds(pairs, ["run", "episode_id"]).select("episode_id", "p_idx", "g_idx", "iou")
    assert sorted(whole.collect()) == sorted(rounds.collect())
    half = scoring.match(p, g, 0.5, split=False).select("episode_id", "p_idx", "g_idx", "iou")
    assert sorted(whole.filter("iou >= 0.5").collect()) == sorted(half.collect())


def test_split_counts_equal_plain(random_case):
    _, _, p, g = random_case
    assert sorted(scoring.episode_counts(p, g, split=True).collect()) == sorted(scoring.episode_counts(p, g, split=False).collect())


def test_taxonomy(spans):
    pred = spans({("r", "1"): [(0, 5), (5, 6), (6, 8.9), (12, 15), (30, 31)]})
    gold = spans({("r", "1"): [(0, 2), (2, 5), (5, 9), (10, 14), (20, 22)]})
    for split in (False, True):
        got = [r["class"] for r in errors.classify(pred, gold, split=split).orderBy("idx").collect()]
        assert got == ["merged", "ok", "ok", "shifted", "missing"]


def test_quantile_paths(spark):
    df = spark.createDataFrame([("a", float(x % 17)) for x in range(100)] + [("b", 1.0), ("b", 2.0)], "k string, x double")
    want = sorted(scoring.quantile(df, ["k"], "x", 0.5, "q", True).collect())
    assert want == sorted(scoring.quantile(df, ["k"], "x", 0.5, "q").collect()) and want[1].q == 1.5


def test_bootstrap_ranks_and_guard(spark):
    df = spark.createDataFrame([("m", float(x)) for x in range(4000)], "metric string, delta double")
    row = stats.ci(df, ["metric"], "delta", 4000).first()
    assert (row.ci_low, row.ci_high) == (100.0, 3900.0)
    rows = spark.createDataFrame([("r", False), ("r", False)], "run string, ok boolean")
    with pytest.raises(Exception, match="every episode failed"):
        report.assert_any_ok(rows).collect()


def test_all_overlaps_however_small(spark, spans):
    pred, gold = {("r", "e"): [(0.0, 1e7), (3.0, 4.0), (9.0, 9.0)]}, {("r", "e"): [(5.0, 5.001), (3.0, 3.5), (3.5, 20.0), (4.0, 5.0)]}
    expected = {(i, j) for i, p in enumerate(pred["r", "e"]) for j, g in enumerate(gold["r", "e"]) if p[0] < g[1] and g[0] < p[1]}
    for split in (False, True):
        got = scoring.overlaps(spans(pred), spans(gold), split=split).collect()
        assert len(got) == len(expected) and {(r.p_idx, r.g_idx) for r in got} == expected


def test_boundary_near_the_last_kept_goes(spark, spans):
    """Midpoints 1, 1 + 0.9e-6, 1 - 0.2e-6: the third is far from the second but near the first, which was kept."""
    ends = [1.0, 1.0 + 0.9e-6, 1.0 - 0.2e-6]
    rows = [(0.0, ends[0])] + [(ends[k], ends[k + 1]) for k in range(2)] + [(ends[2], 5.0)]
    for split in (False, True):
        got = scoring.internal_boundaries(spans({("r", "e"): rows}), split=split).collect()
        assert len(got) == 1
