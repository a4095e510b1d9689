import random

import pandas as pd
import plain
import pytest
from pyspark.sql import functions as F

from spanlake.functions import text
from spanlake.operators import clean, frames, proposals
from spanlake.operators.layout import fold_groups, needs_split, ordered
from spanlake.plans import annotate as an
from spanlake.schema import NO_EVENT_LABEL

SEG = "episode_id string, idx long, start_s double, end_s double, label string"


def segs(spark, rows):
    df = spark.createDataFrame([("1", i, float(r[0]), float(r[1]), r[2] if len(r) > 2 else "x") for i, r in enumerate(rows)], SEG)
    return clean.to_segments(df)


def ep(spark, duration):
    return spark.createDataFrame([("1", float(duration))], "episode_id string, duration_s double")


def req(spark, subtasks=(), attributes=()):
    return spark.createDataFrame([("1", "p", list(subtasks), list(attributes))],
                                 "episode_id string, prompt string, subtasks array<string>, attributes array<string>")


def run_clean(spark, rows, duration, subtasks=(), attributes=()):
    out, warn = clean.clean(segs(spark, rows), ep(spark, duration), req(spark, subtasks, attributes), split=False)
    return out.orderBy("idx").collect(), [r.warning for r in warn.collect()]


def test_clean_cases(spark):
    out, warn = run_clean(spark, [(-3, 5), (5, 99)], 10)
    assert out[0].start_s == 0.0 and out[-1].end_s == 10.0 and any(w.startswith("outside the recording") for w in warn)
    assert len(run_clean(spark, [(0, 5), (5, 5.01), (5.01, 9)], 9)[0]) == 2
    out, warn = run_clean(spark, [(0, 6, "a"), (4, 9, "b")], 9)
    assert out[0].end_s == out[1].start_s == 4.0 and "'a' ends 2.00 s earlier, where 'b' starts" in warn
    out, _ = run_clean(spark, [(0, 5, "grabbing the box thing")], 5, ["Pick Box", "Fold Left"])
    assert out[0].label == "Pick Box" and out[0].confidence == "low" and "label_outside_vocabulary" in out[0].flags
    out, _ = run_clean(spark, [(0, 3, "a"), (6, 9, "b")], 9)
    assert out[0].end_s == out[1].start_s == 4.5
    out, warn = run_clean(spark, [], 9)
    assert out == [] and warn == ["nothing was proposed for this episode"]
    out, warn = run_clean(spark, [(0, 4, "Pick Up Block"), (4, 9, NO_EVENT_LABEL)], 10, ["Pick Up Block", "Place Block"])
    assert out[1].label == NO_EVENT_LABEL and out[1].result == "fail" and NO_EVENT_LABEL in out[1].flags
    assert not any("vocabulary" in w for w in warn)


def test_rubric(spark):
    rows = segs(spark, [(0, 5)]).withColumn("attributes", F.array(F.lit("Retry"), F.lit("invented")))
    out, warn = clean.clean(rows, ep(spark, 5), req(spark, attributes=["retry"]), split=False)
    assert out.first().attributes == ["retry"]
    assert warn.first().warning == "the rubric does not have ['invented']"


@pytest.mark.parametrize("split", [False, True])
def test_trim_and_gaps_equal_loop(spark, split):
    rng = random.Random(3)
    cases = {str(e): sorted((round(rng.random() * 20, 2), 0) for _ in range(rng.randrange(1, 15))) for e in range(25)}
    cases = {e: [(s, round(s + rng.choice([0.16, 0.5, 3]), 2)) for s, _ in rows] for e, rows in cases.items()}
    df = spark.createDataFrame([(e, i, s, t, "x") for e, rows in cases.items() for i, (s, t) in enumerate(rows)], SEG)
    eps = spark.createDataFrame([(e, 99.0) for e in cases], "episode_id string, duration_s double")
    got = {}
    for r in clean.clean(clean.to_segments(df), eps, split=split)[0].orderBy("episode_id", "idx").collect():
        got.setdefault(r.episode_id, []).append((r.start_s, r.end_s))
    assert got == {e: plain.trimmed(sorted(rows)) for e, rows in cases.items()}


@pytest.mark.parametrize("split", [False, True])
def test_stitch_equals_loop(spark, split):
    rng = random.Random(5)
    cases = {str(e): [(rng.randrange(20), rng.choice(["pick", "Pick ", "place"])) for _ in range(12)] for e in range(25)}
    cases = {e: [(float(s), s + rng.choice([1.0, 2.0, 6.0]), x) for s, x in rows] for e, rows in cases.items()}
    rows = [(e, 0, i, 2, s, t, x) for e, items in cases.items() for i, (s, t, x) in enumerate(items)]
    df = spark.createDataFrame(rows, "episode_id string, window_id long, idx long, n_windows long, start_s double, end_s double, label string")
    got = {}
    for r in proposals.stitch(df, split=split).orderBy("episode_id", "idx").collect():
        got.setdefault(r.episode_id, []).append((r.start_s, r.end_s, r.label))
    assert got == {e: plain.stitched(items) for e, items in cases.items()}


@pytest.mark.parametrize("split", [False, True])
def test_smooth_equals_loop(spark, split):
    rng = random.Random(9)
    cases = {str(e): [rng.choice("abB") for _ in range(rng.randrange(1, 12))] for e in range(40)}
    df = spark.createDataFrame([(e, i, i * 0.5, x) for e, xs in cases.items() for i, x in enumerate(xs)],
                               "episode_id string, frame_idx long, t double, label string")
    got = {}
    for r in frames.smooth(df, split=split).orderBy("episode_id", "frame_idx").collect():
        got.setdefault(r.episode_id, []).append(r.label)
    assert got == {e: plain.smoothed(xs) for e, xs in cases.items()}


def states(spark, labels):
    df = spark.createDataFrame([("1", i, i * 0.5, x) for i, x in enumerate(labels)], "episode_id string, frame_idx long, t double, subtask string")
    grid = df.select("episode_id", "frame_idx", "t")
    rows = frames.smooth(frames.fill_grid(df.filter("subtask is not null"), grid), split=False)
    return [(r.start_s, r.end_s, r.label) for r in frames.rows_to_segments(rows, split=False).orderBy("idx").collect()]


def test_state_sequences(spark):
    assert states(spark, ["pick"] * 3 + ["place"] * 2 + ["none"] * 2) == [(0.0, 1.25, "pick"), (1.25, 2.25, "place")]
    assert states(spark, ["pick", "pick", "place", "pick", "pick", "pick"]) == [(0.0, 2.75, "pick")]
    assert states(spark, ["pick", "pick", None, None]) == [(0.0, 0.75, "pick")]
    assert states(spark, ["none", "none", "pick", "pick", "pick"])[0][::2] == (0.0, "pick")


def test_run_expansion_and_snapping(spark):
    grid = spark.createDataFrame([("1", i, i * 0.5) for i in range(5)], "episode_id string, frame_idx long, t double")
    runs = spark.createDataFrame([("1", 0, 0.0, "pick"), ("1", 1, 1.0, "place"), ("1", 2, 2.0, "none")], "episode_id string, idx long, t double, subtask string")
    got = [r.subtask for r in frames.expand_runs(runs, grid, split=False).orderBy("frame_idx").collect()]
    assert got == ["pick", "pick", "place", "place", "none"]
    window = spark.createDataFrame([("1", 0, 0, 2)], "episode_id string, window_id long, first_frame long, last_frame long")
    rows = spark.createDataFrame([("1", 0, 0, 0.49, "a"), ("1", 0, 1, 3.0, "b")], "episode_id string, window_id long, row_idx long, t double, subtask string")
    assert [(r.frame_idx, r.subtask) for r in frames.snap_rows(rows, window).collect()] == [(1, "a")]


def test_grid_and_windows(spark):
    six = spark.createDataFrame([("1", 6.0)], "episode_id string, duration_s double")
    grid = frames.sample_grid(six)
    assert [r.t for r in grid.orderBy("t").limit(4).collect()] == [0.0, 0.5, 1.0, 1.5]
    part = frames.sample_grid(six, 0.5, F.lit(2.0), F.lit(4.0)).orderBy("t").collect()
    assert part[0].t == 2.0 and part[-1].t == 4.0
    with pytest.raises(ValueError):
        frames.sample_grid(six, 0)
    for n in (1, 5, 6, 7, 13, 17, 40):
        spans = spark.createDataFrame([("1", i, float(i), i + 0.9, 20) for i in range(n)],
                                      "episode_id string, sheet_idx long, start_s double, end_s double, n_frames long")
        w = frames.sheet_windows(spans).orderBy("window_id").collect()
        assert all(r.last_sheet - r.first_sheet < 6 for r in w) and w[-1].last_sheet == n - 1
        assert all(b.first_sheet <= a.last_sheet for a, b in zip(w, w[1:])) and (len(w) == 1) == (n <= 6)


def test_subdivision_and_refinement(spark):
    parent = segs(spark, [(2, 8, "a"), (8, 9, "b")]).select("episode_id", "idx", "start_s", "end_s", "label")
    pieces = spark.createDataFrame([("1", 0, 0, 0.0, 5.0, "a"), ("1", 0, 1, 5.0, 99.0, "b"), ("1", 1, 0, 8.0, 8.5, "c"), ("1", 1, 1, 8.5, 9.0, "d")],
                                   "episode_id string, parent_idx long, idx long, start_s double, end_s double, label string")
    for split in (False, True):
        got = [(r.start_s, r.end_s, r.label) for r in proposals.apply_subdivision(parent, pieces, split=split).orderBy("idx").collect()]
        assert got == [(2.0, 5.0, "a"), (5.0, 8.0, "b"), (8.0, 9.0, "b")]
    choice = spark.createDataFrame([("1", 0, 3.5)], "episode_id string, boundary_idx long, boundary_s double")
    out, notes = proposals.apply_refinement(segs(spark, [(0, 5, "a"), (5, 10, "b")]), choice, ep(spark, 10), split=False)
    rows = out.orderBy("idx").collect()
    assert rows[0].end_s == rows[1].start_s == 3.5 and rows[0].flags == rows[1].flags == ["boundary_moved_1.50s"]
    assert rows[0].confidence == "low" and notes.count() == 1
    low = spark.createDataFrame([("1", 0, 0.0)], "episode_id string, boundary_idx long, boundary_s double")
    rows = proposals.apply_refinement(segs(spark, [(4, 5), (5, 10)]), low, ep(spark, 10), split=False)[0].collect()
    assert all(r.end_s > r.start_s for r in rows)


def test_labels_and_vocabulary(spark):
    labels = spark.createDataFrame([("1", 0, "place_cup", "fail", [], "")],
                                   "episode_id string, idx long, label string, result string, attributes array<string>, description string")
    row = proposals.apply_labels(segs(spark, [(0, 10, "pick_cup")]), labels).first()
    assert row.flags == ["label_disagreement"] and row.result == "fail" and row.label == "place_cup"
    df = spark.createDataFrame([("pick_up_banana", "pick_banana"), ("pick", "place")], "a string, b string")
    assert [r[0] for r in df.select(text.disagrees("a", "b", F.lit(False))).collect()] == [False, True]


@pytest.mark.parametrize("quality,flags", [("fast", False), ("strict", True)])
def test_annotate_presets(spark, quality, flags):
    cols = "episode_id string, window_id long, idx long, start_s double, end_s double, label string"
    first = spark.createDataFrame([("1", 0, 0, 0.0, 5.0, "a"), ("1", 0, 1, 5.0, 999.0, "b")], cols)
    second = spark.createDataFrame([("1", 0, 0, 0.0, 10.0, "a")], cols)
    windows = frames.clip_windows(ep(spark, 10))
    choice = spark.createDataFrame([("1", 0, 5.25)], "episode_id string, boundary_idx long, boundary_s double")
    tables = an.Tables(ep(spark, 10), req(spark), first, windows, second=second, choices=choice)
    rows = an.annotate(tables, quality, split=False)[0].orderBy("idx").collect()
    assert rows[-1].end_s == 10.0 and rows[0].end_s == (5.25 if flags else 5.0)
    assert all(("segment_count_unstable" in r.flags) == flags for r in rows)


def test_fold_slices(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 7 % 13).cast("double").alias("v"))

    def fold(split, rows):
        return sorted(fold_groups(df, ["k"], ["id"], F.struct("id", "v"), F.lit(0.0), lambda s, x: F.when(s + x["v"] > 50, F.lit(0.0)).otherwise(s + x["v"]),
                                  split, rows).collect())
    assert fold(False, 2000) == fold(True, 60)


def test_batch_hook_isolates_failures(spark):
    def call(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["x"] == 3).any():
            raise RuntimeError("y" * 500)
        return pd.DataFrame({"answer": rows["x"].astype(str)})
    out = proposals.propose(spark.range(6).withColumnRenamed("id", "x"), call, ["x"]).orderBy("x").collect()
    assert [r.ok for r in out] == [True, True, True, False, True, True]
    assert out[3].error.startswith("RuntimeError: y") and len(out[3].error) == 300 and out[2].answer == "2"


def test_request_text(spark):
    df = spark.createDataFrame([("", 50.0, 109.5, "Pick Box", ["Pick Box", "Fold Left"])],
                               "prompt string, lo double, hi double, previous_label string, subtasks array<string>")
    body = proposals.render_requests(df).first().request
    assert "50.00s to 109.50s" in body and "'Pick Box'" in body and "The task is not stated" in body
    assert "Choose every label" in body and "- Fold Left" in body and "{" not in body


def test_hot_groups_are_counted_and_split(spark):
    rows = [("hot", i, float(i), i + 0.8, "a" if i % 3 else "b") for i in range(300)] + [("cold", 0, 0.0, 1.0, "a")]
    df = spark.createDataFrame(rows, SEG)
    assert needs_split(df, ["episode_id"], 100) and not needs_split(df, ["episode_id"], 300)
    wide = ordered(df, ["episode_id"], ["idx"], True)
    assert wide.rows.filter("episode_id = 'hot'").select("_chunk").distinct().count() > 1
    # Column names of the caller may look like anything.
    out = wide.with_columns({"_last": F.when(F.col("idx") % 50 == 0, F.col("label"))}).running({"seen": ("last", "_last")}).df
    plain_out = ordered(df, ["episode_id"], ["idx"], False).with_columns(
        {"_last": F.when(F.col("idx") % 50 == 0, F.col("label"))}).running({"seen": ("last", "_last")}).df
    assert sorted(out.select(plain_out.columns).collect(), key=str) == sorted(plain_out.collect(), key=str)


def test_requests_of_one_task_are_asked_by_many(spark):
    rows = spark.range(64).withColumnRenamed("id", "x").coalesce(1)
    out = proposals.propose(rows, lambda r: pd.DataFrame({"answer": [str(len(r))] * len(r)}), ["x"]).collect()
    tasks = proposals.TASKS * spark.sparkContext.defaultParallelism
    assert sorted(r.x for r in out) == list(range(64)) and {r.answer for r in out} == {str(64 // tasks)}


def test_a_failed_batch_comes_back_as_one_frame():
    import pandas as pd

    def call(rows):
        if rows["x"].isin([1, 3]).any():
            raise ValueError("odd")
        return pd.DataFrame({"answer": "a" + rows["x"].astype(str), "prompt_tokens": rows["x"] * 10})

    rows = pd.DataFrame({"x": range(5), "other": 1})
    out = list(proposals._caller(call, ["x"], None)(iter([rows])))
    assert len(out) == 1
    got = out[0]
    assert got["x"].tolist() == list(range(5)) and got["ok"].tolist() == [True, False, True, False, True]
    assert got["answer"].tolist() == ["a0", None, "a2", None, "a4"] and got["prompt_tokens"].tolist() == [0, 0, 20, 0, 40]
    assert got["error"].tolist() == [None, "ValueError: odd", None, "ValueError: odd", None] and got["trace"][1].endswith("ValueError: odd\n")
    assert got["output_tokens"].tolist() == got["retries"].tolist() == [0] * 5


def test_a_row_asked_alone_takes_little_work_beside_its_call():
    """Counted in function calls: frames cut, cells read and stacks formatted for every row are most of a cheap hook's time."""
    import sys

    answer = pd.DataFrame({"answer": ["yes"], "prompt_tokens": [10]})

    def call(rows):
        if len(rows) > 1 or rows.index[0] % 5 == 0:
            raise ValueError("odd")
        return answer

    rows = pd.DataFrame({"x": range(500), "s": "text"})
    list(proposals._caller(call, ["x"], None)(iter([rows[:10]])))
    made = 0

    def count(frame, event, arg):
        nonlocal made
        made += event in ("call", "c_call")
    sys.setprofile(count)
    try:
        out = list(proposals._caller(call, ["x"], None)(iter([rows])))
    finally:
        sys.setprofile(None)
    assert len(out) == 1 and out[0]["ok"].tolist() == [i % 5 != 0 for i in range(500)]
    assert made / len(rows) < 160


def test_rows_asked_alone_give_their_cells_and_traces_as_they_are():
    import traceback

    def deeper(x):
        if x == 7:
            raise ValueError(f"no {x}") from KeyError("cause")
        raise ValueError(f"no {x}")

    def call(rows):
        x = int(rows["x"].iloc[0])
        if len(rows) > 1 or x in (1, 5):
            deeper(x)
        if x == 2:
            return pd.DataFrame({"prompt_tokens": [2**53 + 1], "output_tokens": [1.0], "ok": [False], "error": ["said so"], "other": [object()]})
        if x == 3:
            return pd.DataFrame({"answer": pd.array(["z"], "string"), "prompt_tokens": pd.array([None], "Int64")}, index=[9])
        if x == 4:
            return pd.DataFrame({"answer": ["a", "b"]})
        if x == 6:
            return propsals  # noqa: F821 - Python names what may be meant
        if x in (7, 8):
            deeper(x)
        return pd.DataFrame({"answer": [None], "retries": [x]})

    rows = pd.DataFrame({"x": range(9)})
    out = list(proposals._caller(call, ["x"], None)(iter([rows, rows[1:1]])))
    got = out[0].set_index("x")
    assert got["ok"].tolist() == [True, False, False, True, False, False, False, False, False]
    assert got["prompt_tokens"].tolist()[2] == 2**53 + 1 and got["prompt_tokens"][3] is pd.NA and got["output_tokens"][2] == 1
    assert got["answer"].tolist() == [None, None, None, "z", *[None] * 5] and got["error"][2] == "said so" and got["retries"][0] == 0
    assert got["error"][4] == "ValueError: expected 1 answers, got 2" and got["error"][5] == "ValueError: no 5"
    for x in (1, 5, 6, 7, 8):
        try:
            call(rows[x:x + 1])
        except Exception:  # noqa: BLE001
            want = traceback.format_exc()
        assert got["trace"][x].endswith(want.rpartition(", in call\n")[2])
    assert "Did you mean: 'proposals'" in got["trace"][6]
    assert not len(out[1]) and list(out[1].columns) == list(out[0].columns)
