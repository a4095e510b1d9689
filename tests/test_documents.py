"""Run files divided among tasks against the reader that takes each whole."""

import json
import random

import pytest

from spanlake.sources import readers

NASTY = ['plain', 'a } b', '{"rows": [', 'quote \\" }', 'back\\\\slash', 'tab\tline\n}', '] } , {', 'é }  }', '', '"}"', 'ends with \\\\']


def document(rng, n, **extra):
    word = lambda: rng.choice(NASTY)
    rows = [{"id": f"e{k}", "family": word(), "ok": rng.choice([True, False, None]), "elapsed": k / 4,
             "pred": [["0", str(k + 1), word()] for _ in range(rng.randrange(0, 3))], "gold": [["0.5", "2", word()]],
             "warnings": [word() for _ in range(rng.randrange(0, 3))], "error": word(),
             "usage": {"input_tokens": k, "output_tokens": 1}} for k in range(n)]
    items = [("tag", f"run {word()}"), ("model", word()), ("settings", {"rows": [{"a": {"b": 1}}], "x": [1, {"y": "}"}]}), ("rows", rows),
             ("scores", {"f1": {"overall": 0.5}, "list": [{"rows": []}]}), ("episodes", n), ("failed", 0)]
    if extra.get("shuffle"):
        rng.shuffle(items)
    return dict(items)


def same(a, b):
    for x, y in zip(a, b):
        assert sorted(map(str, x.select(y.columns).collect())) == sorted(map(str, y.collect()))


@pytest.mark.parametrize("indent,size", [(None, 400), (None, 37), (2, 200), (None, 10_000_000)])
def test_split_documents_equal_whole_ones(spark, tmp_path, indent, size):
    rng = random.Random(size)
    for k, n in enumerate([30, 1, 0, 7]):
        (tmp_path / f"{k}.json").write_text(json.dumps(document(rng, n, shuffle=k % 2), indent=indent, ensure_ascii=k % 2 == 0) + "\n" * (k % 3))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    want = readers.read_runs(spark, str(tmp_path))
    want = [spark.createDataFrame(x.collect(), x.schema) for x in want]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = readers.read_large_runs(spark, str(tmp_path))
        if size < 1_000:
            assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 10
        same(got, want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
