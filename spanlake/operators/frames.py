"""Sampling grids, sheet and clip windows, and frame-state sequences.

Times are arithmetic: no pixels are read. Grids can be long, so sequences are unrolled in two steps and
no row ever carries a whole episode's frame numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions import text
from spanlake.functions.rounding import round_true
from spanlake.operators.layout import by_size, ordered
from spanlake.schema import (CLIP_OVERLAP, CLIP_WINDOW, EPISODE_KEYS, EPS, FRAMES_PER_SHEET, GRID_INTERVAL,
                             SHEET_COLUMNS, SHEET_OVERLAP, SHEETS_PER_WINDOW)

_BLOCK = 4096


def count_up(df: DataFrame, n: str, name: str) -> DataFrame:
    """One row per integer 0 .. n-1, block by block."""
    n_ = F.col(n).cast("long")
    df = df.filter(n_ > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n_ - 1) / _BLOCK))))
    lo = F.col("_block") * _BLOCK
    hi = F.least(lo + _BLOCK - 1, n_ - 1)
    return df.withColumn(name, F.explode(F.sequence(lo, hi))).drop("_block")


def sample_grid(episodes: DataFrame, interval: float = GRID_INTERVAL, start: Column | None = None,
                end: Column | None = None, keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Frame times every ``interval`` seconds within [start, end] of each episode:
    (keys, frame_idx, t), t rounded to 1 ms. Nothing for an empty range."""
    if interval <= 0:
        raise ValueError(f"frames cannot be {interval} s apart")
    t0 = F.greatest(F.lit(0.0), start) if start is not None else F.lit(0.0)
    t1 = F.least(F.col("duration_s"), end) if end is not None else F.col("duration_s")
    ranges = episodes.withColumns({"_t0": t0, "_t1": t1}).filter(F.col("_t1") > F.col("_t0"))
    ranges = ranges.withColumn("_n", F.floor((F.col("_t1") - F.col("_t0")) / interval) + 2)
    grid = count_up(ranges.select(*keys, "_t0", "_t1", "_n"), "_n", "frame_idx")
    grid = grid.withColumn("_t", F.col("_t0") + F.col("frame_idx") * interval)
    return grid.filter(F.col("_t") <= F.col("_t1") + EPS).select(*keys, "frame_idx", round_true("_t", 3).alias("t"))


def sheets(grid: DataFrame, per_sheet: int = FRAMES_PER_SHEET, columns: int = SHEET_COLUMNS) -> DataFrame:
    """Place every frame on its sheet: adds sheet_idx, sheet_col, sheet_row."""
    if min(per_sheet, columns) < 1:
        raise ValueError(f"a sheet of {per_sheet} frames in {columns} columns holds nothing")
    cell = F.col("frame_idx") % per_sheet
    return grid.withColumns({"sheet_idx": F.floor(F.col("frame_idx") / per_sheet),
                             "sheet_col": cell % columns, "sheet_row": F.floor(cell / columns)})


def sheet_spans(placed: DataFrame, keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """First and last time of each sheet."""
    return placed.groupBy(*keys, "sheet_idx").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("n_frames"))


def sheet_windows(spans: DataFrame, max_sheets: int = SHEETS_PER_WINDOW, overlap: int = SHEET_OVERLAP,
                  keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Runs of at most ``max_sheets`` sheets sharing ``overlap`` sheets with the next, until the last
    sheet is covered: (keys, window_id, n_windows, first_sheet, last_sheet, lo, hi, first_frame,
    last_frame)."""
    keys = list(keys)
    step = max(1, max_sheets - overlap)
    totals = spans.groupBy(*keys).agg((F.max("sheet_idx") + 1).alias("_n"), F.max("n_frames").alias("_per"))
    n_windows = F.when(F.col("_n") <= max_sheets, F.lit(1).cast("long")).otherwise(
        F.ceil((F.col("_n") - max_sheets) / step) + 1)
    w = count_up(totals.withColumn("n_windows", n_windows), "n_windows", "window_id")
    w = w.withColumn("first_sheet", F.col("window_id") * step)
    w = w.withColumn("last_sheet", F.least(F.col("first_sheet") + max_sheets, F.col("_n")) - 1)
    lo = spans.select(*keys, F.col("sheet_idx").alias("first_sheet"), F.col("start_s").alias("lo"))
    hi = spans.select(*keys, F.col("sheet_idx").alias("last_sheet"), F.col("end_s").alias("hi"),
                      F.col("n_frames").alias("_tail"))
    w = w.join(lo, [*keys, "first_sheet"]).join(hi, [*keys, "last_sheet"])
    return w.select(*keys, "window_id", "n_windows", "first_sheet", "last_sheet", "lo", "hi",
                    (F.col("first_sheet") * F.col("_per")).alias("first_frame"),
                    (F.col("last_sheet") * F.col("_per") + F.col("_tail") - 1).alias("last_frame"))


def clip_windows(episodes: DataFrame, window: float = CLIP_WINDOW, overlap: float = CLIP_OVERLAP,
                 keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Overlapping time windows from 0 until the end is covered; one window when ``window`` is not
    positive or the episode fits: (keys, window_id, n_windows, lo, hi)."""
    step = max(window - overlap, 1.0)
    d = F.col("duration_s")
    # The last window is the first whose end reaches duration - 1e-6.
    more = F.greatest(F.ceil((d - EPS - window) / step), F.lit(0).cast("long"))
    fits = d <= window if window > 0 else F.lit(True)
    n = F.when(fits, F.lit(1).cast("long")).otherwise(more + 1)
    w = count_up(episodes.select(*keys, "duration_s", n.alias("n_windows")), "n_windows", "window_id")
    lo = F.col("window_id") * F.lit(step)
    hi = d if window <= 0 else F.least(d, lo + window)
    return w.select(*keys, "window_id", "n_windows", lo.alias("lo"), hi.alias("hi"))


# ---- frame states ---------------------------------------------------------------------------------

def snap_rows(states: DataFrame, windows: DataFrame, interval: float = GRID_INTERVAL,
              keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Assign each state row to the nearest frame of its window; beyond 0.51 intervals it is dropped and
    a tie goes to the earlier frame. ``windows`` carries first_frame/last_frame: the grid is regular, so
    the frame number is arithmetic and no frame table is joined."""
    rows = states.join(windows.select(*keys, "window_id", "first_frame", "last_frame"), [*keys, "window_id"])
    guess = F.floor(F.col("t") / interval)
    near = F.array(*(F.least(F.greatest(guess + k, F.col("first_frame")), F.col("last_frame")) for k in (-1, 0, 1, 2)))
    rows = rows.withColumn("_near", near)
    best = F.array_min(F.transform("_near", lambda i: F.struct(
        F.abs(round_true(i * F.lit(interval), 3) - F.col("t")).alias("gap"), i.alias("frame"))))
    rows = rows.withColumn("_best", best).filter(F.col("_best.gap") <= interval * 0.51)
    return rows.withColumn("frame_idx", F.col("_best.frame")).drop("_near", "_best", "first_frame", "last_frame")


def upsert_states(states: DataFrame, keys: Sequence[str] = EPISODE_KEYS,
                  version: Sequence[str] = ("window_id", "row_idx")) -> DataFrame:
    """Last write wins per frame: later windows and later rows overwrite earlier ones."""
    return states.groupBy(*keys, "frame_idx").agg(F.max_by("subtask", F.struct(*version)).alias("subtask"))


@by_size("grid", "runs")
def expand_runs(runs: DataFrame, grid: DataFrame, interval: float = GRID_INTERVAL,
                keys: Sequence[str] = EPISODE_KEYS, split: bool | None = None) -> DataFrame:
    """One row per frame from run starts: the label of the last start no later than 0.49 intervals after
    the frame, 'none' before the first."""
    points = grid.select(*keys, (F.col("t") + interval * 0.49).alias("_at"), F.lit(1).alias("_kind"),
                         F.col("frame_idx").alias("_pos"), "frame_idx", "t", F.lit(None).cast("string").alias("_label"))
    starts = runs.select(*keys, F.col("t").alias("_at"), F.lit(0).alias("_kind"), F.col("idx").alias("_pos"),
                         F.lit(None).cast("long").alias("frame_idx"), F.lit(None).cast("double").alias("t"),
                         F.col("subtask").alias("_label"))
    o = ordered(points.unionByName(starts), keys, ["_at", "_kind", "_pos"], split)
    o = o.running({"subtask": ("last", "_label")})
    return o.df.filter(F.col("_kind") == 1).select(*keys, "frame_idx", "t", F.coalesce("subtask", F.lit("none")).alias("subtask"))


def fill_grid(states: DataFrame, grid: DataFrame, keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Every frame with its label; frames without a row, and all spellings of "nothing", are 'none'."""
    joined = grid.join(states.select(*keys, "frame_idx", "subtask"), [*keys, "frame_idx"], "left")
    label = text.strip(F.coalesce("subtask", F.lit("none")))
    joined = joined.withColumn("label", label)
    return joined.withColumn("label", F.when(text.is_none("label"), "none").otherwise(F.col("label"))).select(
        *keys, "frame_idx", "t", "label")


@by_size("rows")
def smooth(rows: DataFrame, keys: Sequence[str] = EPISODE_KEYS, split: bool | None = None) -> DataFrame:
    """Absorb single-frame runs into the run on their left; leading ones take the second frame's label.
    Sequences under three frames stay as they are; labels compare exactly."""
    o = ordered(rows, keys, ["frame_idx"], split).shift(prev={"_p": "label"}, next={"_n": "label"}).number("_i")
    solid = F.coalesce(F.col("label") == F.col("_p"), F.lit(False)) | F.coalesce(F.col("label") == F.col("_n"), F.lit(False))
    o = o.with_columns({"_solid": F.when(solid, F.col("label"))})
    o = o.running({"_keep": ("last", "_solid")}, inclusive=True)
    o = o.total({"_second": ("max", F.when(F.col("_i") == 1, F.col("label"))), "_top": ("max", "_i")})
    label = F.when(F.col("_top") < 2, F.col("label")).otherwise(F.coalesce("_keep", "_second"))
    return o.df.withColumn("label", label).drop("_p", "_n", "_i", "_solid", "_keep", "_second", "_top")


@by_size("rows")
def rows_to_segments(rows: DataFrame, interval: float = GRID_INTERVAL, keys: Sequence[str] = EPISODE_KEYS,
                     split: bool | None = None) -> DataFrame:
    """Label runs to segments: borders halfway between frames, 'none' runs are gaps, the first segment
    starts at 0. Input as from ``fill_grid``/``smooth``; (keys, idx, start_s, end_s, label)."""
    keys = list(keys)
    low = F.lower("label")
    o = ordered(rows.withColumn("_low", low), keys, ["frame_idx"], split)
    o = o.shift(prev={"_p": "_low", "_pt": "t"})
    o = o.islands("_run", F.coalesce(F.col("_low") != F.col("_p"), F.lit(True)))
    runs = o.df.groupBy(*keys, "_run").agg(
        F.min_by("label", "frame_idx").alias("label"),
        F.min_by(F.coalesce((F.col("_pt") + F.col("t")) / 2.0, F.col("t")), "frame_idx").alias("_s"),
        F.max("t").alias("_last"))
    runs = runs.filter(~text.is_none("label")).withColumn("_e", F.col("_last") + interval / 2.0)
    runs = runs.withColumn("end_s", round_true("_e", 2))
    o = ordered(runs, keys, ["_run"], split).shift(prev={"_pe": "end_s"})
    o = o.with_columns({"_s": F.greatest("_s", "_pe")}).number("idx")
    start = F.when(F.col("idx") == 0, F.lit(0.0)).otherwise(round_true("_s", 2))
    return o.df.withColumn("start_s", start).select(*keys, "idx", "start_s", "end_s", "label")
