"""Large and small groups in one query, and the rules that no longer need a sequence, against folds and plain loops."""

import math
import random

import plain
import pytest
from pyspark.sql import functions as F

from spanlake.operators import clean, errors, ingest, layout, proposals, scoring

SEG = "episode_id string, idx long, start_s double, end_s double, label string"


@pytest.fixture
def rounds(monkeypatch):
    """How many tables the pointer rules write."""
    made, write = [], layout.durable

    def counted(df):
        made.append(1)
        return write(df)
    monkeypatch.setattr(layout, "durable", counted)
    return made


def routed(operator, limit):
    """The operator with another limit of size: by_size around the function it wraps."""
    inner = operator.__wrapped__
    names = {scoring.overlaps: ("pred", "gold"), scoring.candidates: ("pred", "gold"), scoring._counts_and_errors: ("pred", "gold"), errors.classify: ("pred", "gold"),
             clean.clean: ("segments",), proposals.stitch: ("proposals",), proposals.apply_refinement: ("segments",)}[operator]
    return layout.by_size(*names, limit=limit)(inner)


@pytest.fixture(scope="module")
def mixed(spans):
    rng = random.Random(21)
    sizes = {str(e): rng.randrange(1, 12) for e in range(20)} | {"hot": 150, "warm": 90}
    pred = {("r", e): plain.random_spans(rng, n, e == "hot") for e, n in sizes.items()}
    gold = {("r", e): plain.random_spans(rng, n, True) for e, n in sizes.items()}
    return spans(pred).cache(), spans(gold).cache()


@pytest.mark.parametrize("operator", [scoring.overlaps, scoring.candidates, errors.classify])
def test_hot_and_cold_groups_give_one_result(mixed, operator):
    pred, gold = mixed
    assert sorted(routed(operator, 50)(pred, gold).collect()) == sorted(operator(pred, gold, split=False).collect())


def test_counts_of_hot_and_cold_groups(mixed):
    pred, gold = mixed
    keys = list(scoring.RUN_KEYS)
    for got, want in zip(routed(scoring._counts_and_errors, 50)(pred, gold, keys, None), scoring._counts_and_errors(pred, gold, keys, False)):
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_null_keys_belong_to_one_branch(spark):
    rows = [(None, i, float(i), i + 1.5, "a") for i in range(80)] + [("e", i, float(i), i + 1.5, "a") for i in range(3)]
    df = spark.createDataFrame(rows, SEG)
    hot = layout.hot_groups([df], ["episode_id"], 50)
    small, large = layout.divide(df, hot, ["episode_id"])
    assert small.count() == 3 and large.count() == 80 and layout.hot_groups([df], ["episode_id"], 100) is None


def test_clean_of_hot_and_cold_groups(spark):
    rng = random.Random(4)
    rows = [(e, i, 2.0 * i + rng.random(), 2.0 * i + 1.5 + rng.random(), "ab"[i % 2]) for e, n in (("hot", 90), ("a", 5), ("b", 7)) for i in range(n)]
    segments = clean.to_segments(spark.createDataFrame(rows, SEG))
    episodes = spark.createDataFrame([(e, 150.0) for e in ("hot", "a", "b", "none")], "episode_id string, duration_s double")
    got, want = routed(clean.clean, 50)(segments, episodes), clean.clean(segments, episodes, split=False)
    assert sorted(got.segments.collect()) == sorted(want.segments.collect())
    assert sorted(got.warnings.collect()) == sorted(want.warnings.collect())
    plan = got.segments._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Union") == 1 and "LeftAnti" in plan  # the other branch starts from its written rows
    windows = [line for line in plan.splitlines() if " Window " in line or "Window [" in line]
    assert any("_chunk" in line for line in windows) and any("_chunk" not in line for line in windows)


# ---- sessions ------------------------------------------------------------------------------------------

def sessions(rng, n_sessions, n, tie):
    rows = []
    for k in range(n_sessions):
        t = 0.0
        for i in range(rng.randrange(1, n)):
            t = t if rng.random() < 0.3 else t + rng.randrange(0, 30) / tie
            length = rng.choice([rng.randrange(0, 60), rng.randrange(0, 60), 100, 101, 500]) / tie
            rows.append((f"s{k}", i, t, t + length, rng.choice(["x", "y"])))
    return rows


@pytest.mark.parametrize("seed,tie", [(1, 10.0), (2, 3.0), (3, 7.0), (4, 1000.0)])
def test_chunks_by_pointers_equal_the_fold(spark, seed, tie):
    """Ties at the limit, equal starts, actions inside others and actions longer than the limit."""
    rows = spark.createDataFrame(sessions(random.Random(seed), 25, 60, tie), "session string, idx long, start_s double, end_s double, text string").cache()
    limit = 100 / tie
    want = sorted(ingest.chunk_sessions(rows, limit, split=False).collect())
    got = ingest.chunk_sessions(rows, limit, split=True)
    assert sorted(got.select("session", "idx", "start_s", "end_s", "text", "chunk").collect()) == sorted(
        (r.session, r.idx, r.start_s, r.end_s, r.text, r.chunk) for r in want)


@pytest.mark.parametrize("seed,unit", [(1, 0.01), (2, 0.05), (3, 0.025), (4, 1.0)])
def test_trimming_by_path_equals_the_fold(spark, seed, unit):
    rng = random.Random(seed)
    rows = []
    for k in range(25):
        cs, t = rng.randrange(0, 5) * unit, 0.0
        for i in range(rng.randrange(1, 50)):
            t += rng.choice([0, 0, 1, 2, 3, 7]) * unit
            f1 = t + rng.choice([1, 1, 2, 3, 4, 8, 25]) * unit
            s = max(t, cs)
            if f1 > s:
                rows.append((f"s{k}", k % 3, i, t, f1, rng.choice(["x", "y", ""]), cs, 1e9, s, f1))
    df = spark.createDataFrame(rows, "session string, chunk long, idx long, f0 double, f1 double, text string, cs double, ce double, s double, t double").cache()
    assert sorted(ingest.trim_fine(df, split=True).collect()) == sorted(ingest.trim_fine(df, split=False).collect())


def test_a_long_session_takes_few_rounds(spark, rounds):
    n = 200_000
    rows = spark.range(n).select(F.lit("s").alias("session"), F.col("id").alias("idx"), (F.col("id") * 0.5).alias("start_s"),
                                 (F.col("id") * 0.5 + 0.4).alias("end_s"), F.lit("x").alias("text"))
    got = ingest.chunk_sessions(rows, 10.0, split=True)
    sizes = {r["count"] for r in got.groupBy("chunk").count().collect()}
    assert got.agg(F.max("chunk")).first()[0] == n / 20 - 1 and sizes == {20}
    # Two tables a round, besides those of the ordered scans.
    assert len(rounds) <= 2 * math.ceil(math.log2(n / 20)) + 10


# ---- refinement ----------------------------------------------------------------------------------------

def test_refinement_by_composition_equals_the_fold(spark):
    rng = random.Random(5)
    rows, picks = [], []
    for e, n in [("hot", 400), *((str(k), rng.randrange(1, 9)) for k in range(30))]:
        t = rng.random()
        for i in range(n):
            length = rng.choice([0.02, 0.05, 0.06, 0.1, 0.3, 2.0, rng.random() * 3])
            rows.append((e, i, t, t + length, "ab"[i % 2]))
            if rng.random() < 0.8:
                picks.append((e, i, round(t + length + rng.choice([-0.9, -0.3, -0.05, 0.0, 0.05, 0.4, 0.9]), 3)))
            t += length + rng.choice([0.0, 0.0, 0.01, 0.2])
    segments = clean.to_segments(spark.createDataFrame(rows, SEG)).cache()
    choices = spark.createDataFrame(picks, "episode_id string, boundary_idx long, boundary_s double")
    episodes = spark.createDataFrame([(e, 2000.0) for e in {r[0] for r in rows}], "episode_id string, duration_s double")
    want = proposals.apply_refinement(segments, choices, episodes, split=False)
    for got in (proposals.apply_refinement(segments, choices, episodes, split=True), routed(proposals.apply_refinement, 100)(segments, choices, episodes)):
        for a, b in zip(got, want):
            assert sorted(a.select(b.columns).collect()) == sorted(b.collect())


def test_scan_composes_in_order(spark):
    """A composition that does not commute: text put together, null items left out."""
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("k"), "id", F.when(F.col("id") % 5 != 0, F.concat(F.col("id").cast("string"), F.lit(","))).alias("x"))
    for split in (False, True):
        got = {(r.k, r.id): r.all for r in layout.ordered(df, ["k"], ["id"], split).scan("all", F.col("x"), lambda a, b: F.concat(a, b)).df.collect()}
        for k in range(3):
            said = ""
            for i in range(k, 300, 3):
                said += "" if i % 5 == 0 else f"{i},"
                assert (got[str(k), i] or "") == said


# ---- matching ------------------------------------------------------------------------------------------

def staircase(spark, n):
    """Pairs p0-g0, g0-p1, p1-g1, ... whose IoU rises all the way: each is blocked by the next."""
    return spark.range(n).select(F.lit("r").alias("run"), F.lit("e").alias("episode_id"), F.floor((F.col("id") + 1) / 2).alias("p_idx"),
                                 F.floor(F.col("id") / 2).alias("g_idx"), ((F.col("id") + 1) / n).alias("iou"),
                                 F.col("id").cast("double").alias("p0"), (F.col("id") + 2.0).alias("p1"), F.col("id").cast("double").alias("g0"), (F.col("id") + 2.0).alias("g1"))


def test_a_long_chain_of_pairs_takes_few_rounds(spark, rounds, monkeypatch):
    monkeypatch.setattr(scoring, "durable", layout.durable)
    n = 100_000
    won = scoring.greedy(staircase(spark, n), split=True)
    assert sorted(r[0] for r in won.select(F.col("p_idx") + F.col("g_idx")).collect()) == list(range(1, n, 2))
    # Two tables a round of the chain: at most 20 rounds in all.
    assert len(rounds) <= 2 * 20


def test_chains_equal_the_fold(spark):
    """Dense random pairs: chains, ties, spans with many partners."""
    rng = random.Random(13)
    rows = []
    for e in range(12):
        for _ in range(rng.randrange(1, 120)):
            rows.append(("r", str(e), rng.randrange(0, 25), rng.randrange(0, 25), rng.randrange(1, 8) / 8))
    rows = sorted(set(rows))
    seen, unique = set(), []
    for r in rows:
        if r[:4] not in seen:
            seen.add(r[:4])
            unique.append((*r, 0.0, 1.0, 0.0, 1.0))
    pairs = spark.createDataFrame(unique, "run string, episode_id string, p_idx long, g_idx long, iou double, p0 double, p1 double, g0 double, g1 double").cache()
    a = scoring.greedy(pairs, split=False)
    b = scoring._match_rounds(pairs, ["run", "episode_id"])
    assert sorted(a.select(b.columns).collect()) == sorted(b.collect())
    small = staircase(spark, 41)
    assert sorted(scoring.greedy(small, split=False).collect()) == sorted(scoring._match_rounds(small, ["run", "episode_id"]).select(small.columns).collect())


def test_last_within_moves_no_tie(spark):
    rng = random.Random(3)
    rows = [(rng.choice([rng.random() * 10 ** rng.randrange(-3, 7), rng.randrange(0, 10 ** 6) / 10, 0.0]),) for _ in range(2_000)]
    for limit in (0.05, 100.0, 180.0):
        for r in spark.createDataFrame(rows, "s double").select("s", layout.last_within(F.col("s"), limit).alias("x")).collect():
            assert r.x - r.s <= limit < math.nextafter(r.x, math.inf) - r.s
