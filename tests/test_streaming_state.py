"""Totals held in streaming state, and batch folders that stay few, under re-deliveries, restarts and crashes."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.sources import readers
from spanlake.streaming import scoring as live
from spanlake.streaming.batches import FAN, Batches


def line(i, ok=True, cut=None, family=None, seq=None):
    cut = 2 + i * 0.1 if cut is None else cut
    row = {"run": "r", "id": f"e{i}", "family": family or f"f{i % 2}", "ok": ok, "elapsed": 1.0,
           "pred": [[0, cut, "a"], [cut, 9, "b"]], "gold": [[0, 2, "a"], [2, 9, "b"]]}
    return json.dumps(row if seq is None else row | {"seq": seq})


def put(folder, name, lines, at):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    os.utime(folder / name, (at, at))


def test_totals_equal_the_batch_answer(spark, tmp_path):
    src, out, feed, totals = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "feed"), str(tmp_path / "totals")

    def step():
        """Both streams are stopped and started anew each time."""
        live.score_stream(spark, str(src), out, str(tmp_path / "m1"), split=False, feed=feed).awaitTermination()
        live.total_stream(spark, feed, totals, str(tmp_path / "m2")).awaitTermination()
        got = sorted(live.total_report(spark, totals).collect())
        rows = live.score_rows(live.batch_rows(spark, str(src)), split=False).filter("ok")
        assert got == sorted(live.running_report(rows).collect()) == sorted(live.running_report(live.stored_counts(spark, out)).collect())
        return {r.family: r.episodes for r in got}

    put(src, "1.jsonl", [line(i, i != 2) for i in range(5)], 1_000_000_000)
    assert step() == {"f0": 2, "f1": 2}
    # Corrected, delivered again, failing now, succeeding now, and moved to another family.
    put(src, "2.jsonl", [line(0, cut=8.5), line(1), line(3, ok=False), line(2), line(4, family="f1")], 1_000_001_000)
    assert step() == {"f0": 2, "f1": 2}
    # A file that is older than those before it changes nothing for the episodes they hold.
    put(src, "0.jsonl", [line(0, cut=4.0), line(9)], 999_999_000)
    assert step() == {"f0": 2, "f1": 3}
    assert step() == {"f0": 2, "f1": 3}
    # Everything of a family is taken back.
    put(src, "3.jsonl", [line(0, ok=False), line(2, ok=False)], 1_000_002_000)
    assert step() == {"f1": 3}


def test_a_replayed_feed_counts_once(spark, tmp_path):
    src, feed, totals = tmp_path / "in", tmp_path / "feed", str(tmp_path / "totals")
    put(src, "1.jsonl", [line(i) for i in range(4)], 1_000_000_000)
    live.score_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "m1"), split=False, feed=str(feed)).awaitTermination()
    again = live.score_rows(live.batch_rows(spark, str(src)), split=False)
    live.total_stream(spark, str(feed), totals, str(tmp_path / "m2")).awaitTermination()
    want = live.total_report(spark, totals).collect()
    again.write.parquet(str(feed / "batch=0-again"))
    live.total_stream(spark, str(feed), totals, str(tmp_path / "m2")).awaitTermination()
    assert sorted(live.total_report(spark, totals).collect()) == sorted(want)


def test_a_sequence_number_beats_the_file_time(spark, tmp_path):
    put(tmp_path / "c", "a.jsonl", [line(1, seq=7, family="new"), "", line(2, family="old")], 1_000_000_000)
    put(tmp_path / "c", "b.jsonl", [line(1, seq=5, family="restored"), line(2, family="late"), line(1, family="unnumbered")], 1_500_000_000)
    assert {r.id: r.family for r in readers.read_checkpoint(spark, str(tmp_path / "c")).collect()} == {"e1": "new", "e2": "late"}
    rows = live.score_rows(live.batch_rows(spark, str(tmp_path / "c")), split=False)
    assert {r.episode_id: r.family for r in rows.collect()} == {"e1": "new", "e2": "late"}


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def sums(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def folders(path):
    return len(os.listdir(path / "data"))


def test_batches_leave_few_folders(spark, tmp_path):
    store = Batches(spark, str(tmp_path), SCHEMA, sums)
    assert store.rows().count() == 0
    n = 3 * FAN * (FAN - 1) // 8
    one = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).coalesce(1)
    most = 0
    for b in range(n):
        store.add(one, b)
        most = max(most, folders(tmp_path))
    assert {r.k: r.n for r in store.rows().collect()} == {"a": n, "b": 2 * n}
    # Those in force, and those that the last merge of a level replaced.
    assert most <= 4 * FAN and len(os.listdir(tmp_path / "manifest")) <= 5  # two versions, and their checksums
    entries = store.entries()
    assert [e["first"] for e in entries[1:]] == [e["last"] + 1 for e in entries[:-1]]
    store.add(one, n - 1)  # replayed before it was merged
    store.add(one, 0)      # and long after
    assert {r.k: r.n for r in store.rows().collect()} == {"a": n, "b": 2 * n}


@pytest.mark.parametrize("at", ["before the manifest", "after the manifest"])
def test_a_crash_in_a_merge_is_harmless(spark, tmp_path, monkeypatch, at):
    one = spark.createDataFrame([("a", 1)], SCHEMA).coalesce(1)
    store = Batches(spark, str(tmp_path), SCHEMA, sums)
    for b in range(FAN - 1):
        store.add(one, b)

    class Killed(Exception):
        pass

    commit = Batches._commit

    def killed(self, entries):
        if not any(e["level"] for e in entries):
            return commit(self, entries)
        if at == "after the manifest":
            commit(self, entries)
        raise Killed

    monkeypatch.setattr(Batches, "_commit", killed)
    with pytest.raises(Killed):
        store.add(one, FAN - 1)
    monkeypatch.undo()
    again = Batches(spark, str(tmp_path), SCHEMA, sums)
    assert again.rows().first().n == FAN
    again.add(one, FAN - 1)  # the batch was not committed by the stream and comes again
    assert again.rows().first().n == FAN
    for b in range(FAN, 2 * FAN + 2):
        again.add(one, b)
    assert again.rows().first().n == 2 * FAN + 2 and folders(tmp_path) <= 3 * FAN
