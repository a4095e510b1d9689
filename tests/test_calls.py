"""The call ledger: killed tasks, retried batches and later jobs repeat no finished call, and every attempt is counted."""

import json
import os

import pandas as pd
import pytest

from spanlake.operators import calls, proposals


def scripted(log, bad=(), limit=100):
    """A callable that notes what it is asked, fails on some rows and on large batches, and says what a failure took."""
    def call(rows: pd.DataFrame) -> pd.DataFrame:
        with open(log, "a") as out:
            out.write(json.dumps(rows["x"].tolist()) + "\n")
        if len(rows) > limit or set(rows["x"]) & set(bad):
            exc = RuntimeError("no answer")
            exc.prompt_tokens = 3
            raise exc
        return pd.DataFrame({"answer": rows["x"].astype(str), "prompt_tokens": 10, "output_tokens": 1})
    return call


def asked(log):
    return [x for line in open(log) for x in json.loads(line)] if os.path.exists(log) else []


def batches(n, size):
    rows = pd.DataFrame({"x": range(n), "_key": [f"k{i:03}" for i in range(n)]})
    return [rows.iloc[k:k + size].reset_index(drop=True) for k in range(0, n, size)]


def test_a_task_that_runs_again_repeats_no_call(tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "ledger")
    run = proposals._caller(scripted(log, bad=[7]), ["_key"], folder)
    first = run(iter(batches(20, 5)))
    seen = [next(first) for _ in range(4)]  # killed in the middle of the second batch, which is asked row by row
    first.close()
    before = asked(log)
    out = pd.concat(run(iter(batches(20, 5))))
    after = asked(log)[len(before):]
    assert not set(before) - {7, 5, 6, 8, 9} & set(after) and sorted(out["_key"]) == sorted(f"k{i:03}" for i in range(20))
    assert sorted(after) == [8, 9, *range(10, 20)] and len(seen) == 4
    assert out.set_index("_key")["ok"].to_dict() == {f"k{i:03}": i != 7 for i in range(20)}
    n = len(asked(log))
    pd.concat(run(iter(batches(20, 5))))
    assert len(asked(log)) == n


def test_later_jobs_ask_only_what_is_new_or_failed(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "ledger")
    few = spark.range(40).selectExpr("id % 20 AS x", "CAST(null AS string) AS nothing", "id AS row")
    asks = few.drop("row")
    out = proposals.propose(asks, scripted(log), ["x"], ledger=folder)
    assert sorted((r.x, r.answer, r.ok) for r in out.collect()) == sorted((x % 20, str(x % 20), True) for x in range(40))
    assert sorted(asked(log)) == list(range(20))
    more = spark.range(25).selectExpr("id AS x", "CAST(null AS string) AS nothing")
    out = proposals.propose(more, scripted(log), ["x"], ledger=folder)
    assert sorted(r.x for r in out.collect()) == list(range(25)) and sorted(asked(log)) == list(range(25))


def test_usage_counts_every_attempt(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "ledger")
    assert calls.usage(spark, folder).count() == 0
    rows = spark.range(6).selectExpr("id AS x").coalesce(1)
    out = proposals.propose(rows, scripted(log, bad=[3], limit=1), ["x"], ledger=folder).collect()
    assert {r.x: r.ok for r in out} == {x: x != 3 for x in range(6)}
    got = {r.came_through: r for r in calls.usage(spark, folder).collect()}
    assert (got[True].attempts, got[True].prompt_tokens, got[True].output_tokens) == (5, 50, 5)
    # Failed batches of more than one row, and the row that never comes through.
    tries = len(list(open(log)))
    assert got[False].attempts == tries - 5 and got[False].prompt_tokens == 3 * (tries - 5)


@pytest.mark.parametrize("address", ["path", "file"])
def test_the_folder_may_be_an_address(tmp_path, address):
    folder = str(tmp_path) if address == "path" else f"file://{tmp_path}"
    book = calls.Ledger(folder)
    keys = pd.Series(["a", "b"])
    assert book.read(keys) is None
    rows = pd.DataFrame({"_key": keys, "ok": True, "answer": ["1", None], "error": None, "trace": None, "prompt_tokens": 1, "output_tokens": 2, "retries": 0})
    book.write(keys, rows, True)
    found, fine = book.read(keys)
    assert fine and found["answer"].tolist() == ["1", None] and book.read(keys[::-1]) is None
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.startswith("_")]
