"""Snapping to a shared vocabulary by joins against the same rule applied row by row to the whole list."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions import text
from spanlake.operators.vocabulary import snap_shared

WORDS = [f"w{k}" for k in range(14)] + ["hot"] * 6


def phrases(rng, n, longest):
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, longest))]
        words = [w.upper() if rng.random() < 0.2 else w for w in words]
        out.append(rng.choice(["_", " ", "  "]).join(words) + rng.choice(["", "", " "]))
    return out


@pytest.mark.parametrize("seed,longest,set_words", [(1, 6, 8), (2, 14, 8), (3, 7, 2), (4, 7, 1)])
def test_joins_equal_the_row_rule(spark, seed, longest, set_words):
    rng = random.Random(seed)
    entries = list(dict.fromkeys(phrases(rng, 60, longest)))
    labels = phrases(rng, 150, longest) + entries[:10] + [e.swapcase() for e in entries[10:25]] + ["none of these", "", " "]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(labels)] + [(-1, None)] + [(1_000 + k, labels[0]) for k in range(50)], "id long, label string")
    vocabulary = spark.createDataFrame(list(enumerate(entries)), "pos long, entry string").repartition(3)
    got = snap_shared(rows, vocabulary, set_words=set_words)
    listed = F.array(*map(F.lit, entries))
    want = rows.select("*", F.when(F.col("label").isNotNull(), text.snap_to_vocabulary("label", listed)).alias("snapped"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_no_entries_and_no_labels(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, label string")
    none = spark.createDataFrame([], "pos long, entry string")
    assert {r.id: r.snapped for r in snap_shared(rows, none).collect()} == {1: "a b", 2: None}
    assert snap_shared(rows.limit(0), spark.createDataFrame([(0, "a")], "pos long, entry string")).count() == 0


def test_a_word_that_all_share_is_no_hot_key(spark):
    """Half of the entries and all labels have one word: the joins stay as large as the labels' own sets."""
    entries = spark.range(20_000).select(F.col("id").alias("pos"), F.concat(F.lit("hot e"), F.col("id")).alias("entry"))
    labels = spark.range(20_000).select(F.concat(F.lit("hot l"), F.col("id")).alias("label"))
    got = snap_shared(labels, entries).groupBy("snapped").count().collect()
    assert [(r[0], r[1]) for r in got] == [("hot e0", 20_000)]
