"""From raw proposals (answers of people, rules or models, kept as tables) to assembled segments."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions import text
from spanlake.functions.rounding import round_true
from spanlake.operators import calls, frames
from spanlake.operators.clean import fixed2
from spanlake.operators.layout import by_size, fold_groups, ordered
from spanlake.schema import (EPISODE_KEYS, EPS, LABEL_CONTEXT, LABEL_MAX_FRAMES, MIN_PIECE, NO_EVENT_LABEL,
                             REFINE_FLAG, REFINE_GUARD, REFINE_HALF_WINDOW, REFINE_INTERVAL, RESULTS,
                             SUBDIVIDE_INTERVAL, SUBDIVIDE_MAX_FRAMES, SUBDIVIDE_MIN_FRAMES, SUBDIVIDE_MIN_SPAN, struct)

# ---- windows and stitching ------------------------------------------------------------------------


def parse(answers: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Typed parse of JSON answers; unreadable text leaves nulls and is kept in ``_corrupt``."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    parsed = F.from_json(F.col(column), ddl, {"mode": "PERMISSIVE"})
    out = answers.withColumn("parsed", parsed)
    broken = F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull()
    return out.withColumn("_corrupt", F.when(broken, F.col(column)))


def to_episode_time(proposals: DataFrame, windows: DataFrame, keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Clip-relative proposals to episode time: clamp to the clip, shift, keep positive length, round."""
    rows = proposals.join(windows.select(*keys, "window_id", "n_windows", "lo", "hi"), [*keys, "window_id"])

    def place(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col(c), F.col("hi") - F.col("lo"))) + F.col("lo")

    rows = rows.withColumns({"_s": place("start_s"), "_e": place("end_s")}).filter(F.col("_e") > F.col("_s"))
    return rows.withColumns({"start_s": round_true("_s", 2), "end_s": round_true("_e", 2)}).drop(
        "_s", "_e", "lo", "hi")


def in_window(proposals: DataFrame, windows: DataFrame, keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Keep proposals that touch their own window; with a single window everything is kept."""
    rows = proposals.join(windows.select(*keys, "window_id", "n_windows", "lo", "hi"), [*keys, "window_id"])
    own = (F.col("end_s") > F.col("lo") - EPS) & (F.col("start_s") < F.col("hi") + EPS)
    return rows.filter((F.col("n_windows") == 1) | own).drop("lo", "hi")


@by_size("proposals")
def stitch(proposals: DataFrame, keys: Sequence[str] = EPISODE_KEYS, order: Sequence[str] = ("window_id", "idx"),
           split: bool | None = None) -> DataFrame:
    """Merge neighbours (by start, end) with the same normalised label that touch: (keys, idx, start_s,
    end_s, label). The first label is kept. Rows with ``n_windows`` = 1 pass through in list order.

    Two levels of stretches: equal-label runs first, then breaks inside a run where a row starts after
    everything before it has ended. One running maximum over all rows would merge too much.
    """
    keys = list(keys)
    single = F.col("n_windows") == 1 if "n_windows" in proposals.columns else F.lit(False)
    rows = proposals.withColumns({"_single": single, "_name": text.normal("label")})
    sort = [F.when(F.col("_single"), F.lit(0.0)).otherwise(F.col(c)) for c in ("start_s", "end_s")]
    o = ordered(rows.withColumns({"_o0": sort[0], "_o1": sort[1]}), keys, ["_o0", "_o1", *order], split)
    o = o.shift(prev={"_p": "_name"})
    o = o.islands("_run", F.coalesce(F.col("_name") != F.col("_p"), F.lit(True)))
    o = o.within("_run").running({"_reach": ("max", "end_s")})
    start = F.col("_single") | F.coalesce(F.col("start_s") > F.col("_reach") + EPS, F.lit(True))
    o = type(o)(o.rows, keys, o.order, o.split).islands("_piece", start)
    merged = o.df.groupBy(*keys, "_piece").agg(
        F.min(F.struct("_o0", "_o1", *order, "start_s", "label")).alias("_f"), F.max("end_s").alias("end_s"))
    merged = merged.select(*keys, "_piece", F.col("_f.start_s").alias("start_s"), "end_s", F.col("_f.label").alias("label"))
    return ordered(merged, keys, ["_piece"], split).number("idx").df.select(*keys, "idx", "start_s", "end_s", "label")


@by_size("windows")
def previous_label(windows: DataFrame, proposals: DataFrame, keys: Sequence[str] = EPISODE_KEYS,
                   split: bool | None = None) -> DataFrame:
    """The label still in progress at the start of each window: the last label of the closest earlier
    window that has any."""
    keys = list(keys)
    last = proposals.groupBy(*keys, "window_id").agg(F.max_by("label", "idx").alias("_last"))
    rows = windows.join(last, [*keys, "window_id"], "left")
    return ordered(rows, keys, ["window_id"], split).running({"previous_label": ("last", "_last")}).df.drop("_last")


def assemble(proposals: DataFrame, windows: DataFrame, mode: str = "sheets", keys: Sequence[str] = EPISODE_KEYS,
             grid: DataFrame | None = None, interval: float = 0.5, split: bool | None = None) -> DataFrame:
    """Coarse segments (keys, idx, start_s, end_s, label) from window answers.

    ``sheets``: proposals in episode time; ``video``: clip-relative; ``state``: one row per frame
    (window_id, row_idx, t, subtask); ``runs``: one row per change (window_id, idx, t, subtask).
    """
    keys = list(keys)
    if mode == "sheets":
        return stitch(in_window(proposals, windows, keys), keys, split=split)
    if mode == "video":
        return stitch(to_episode_time(proposals, windows, keys), keys, split=split)
    if mode not in ("state", "runs"):
        raise ValueError(f"unknown input mode {mode!r}")
    if mode == "state":
        rows = frames.snap_rows(proposals, windows, interval, keys)
    else:
        # The grid is regular, so a window's frames are counted out; no frame table is joined.
        shown = windows.select(*keys, "window_id", F.explode(F.sequence("first_frame", "last_frame")).alias("frame_idx"))
        shown = shown.withColumn("t", round_true(F.col("frame_idx") * F.lit(float(interval)), 3))
        rows = frames.expand_runs(proposals, shown, interval, [*keys, "window_id"], split)
        rows = rows.withColumn("row_idx", F.col("frame_idx"))
    latest = frames.upsert_states(rows, keys)
    smoothed = frames.smooth(frames.fill_grid(latest, grid, keys), keys, split)
    return frames.rows_to_segments(smoothed, interval, keys, split)


# ---- subdivision ----------------------------------------------------------------------------------

def subdivide_windows(segments: DataFrame, min_span: float = SUBDIVIDE_MIN_SPAN,
                      interval: float = SUBDIVIDE_INTERVAL, max_frames: int = SUBDIVIDE_MAX_FRAMES) -> DataFrame:
    """Segments long enough to hide a second event, with their sampling interval and frame count."""
    rows = segments.withColumn("span", F.col("end_s") - F.col("start_s")).filter(F.col("span") >= min_span)
    rows = rows.withColumn("interval", F.greatest(F.lit(float(interval)), F.col("span") / max_frames))
    rows = rows.withColumn("n_frames", F.floor((F.col("span") + EPS) / F.col("interval")) + 1)
    return rows.filter(F.col("n_frames") >= SUBDIVIDE_MIN_FRAMES)


@by_size("segments", "pieces")
def apply_subdivision(segments: DataFrame, pieces: DataFrame, keys: Sequence[str] = EPISODE_KEYS,
                      relative: bool = False, split: bool | None = None) -> DataFrame:
    """Replace segments by their pieces (keys, parent_idx, idx, start_s, end_s, label).

    Pieces are clamped to the parent, those under 0.4 s dropped; with fewer than two left the parent
    stays. The outer borders never move and no piece starts before the previous one ends.
    """
    keys = list(keys)
    parts = pieces.select(*keys, F.col("idx").alias("_i"), F.col("parent_idx"), F.col("start_s").alias("_s"),
                          F.col("end_s").alias("_e"), F.col("label").alias("_l"))
    rows = segments.select(*keys, F.col("idx").alias("parent_idx"), "start_s", "end_s", "label").join(
        parts, [*keys, "parent_idx"], "left")
    lo, hi = F.col("start_s"), F.col("end_s")
    shift = lo if relative else F.lit(0.0)
    rows = rows.withColumns({"_s0": F.col("_s") + shift, "_e0": F.col("_e") + shift})
    rows = rows.withColumns({"_s": F.least(F.greatest("_s0", lo), hi), "_e": F.least(F.greatest("_e0", lo), hi)})
    good = (hi - lo >= SUBDIVIDE_MIN_SPAN) & (F.col("_e0") - F.col("_s0") >= MIN_PIECE) & (F.col("_e") - F.col("_s") >= MIN_PIECE)
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    # Usable pieces first in their order, then the rest; a parent keeps its first row when it stays whole.
    o = ordered(rows.withColumn("_bad", ~F.col("_good")), [*keys, "parent_idx"], ["_bad", "_s0", "_i"], split)
    o = o.number("_k").total({"_n": ("sum", F.col("_good").cast("int"))})
    cut = F.col("_n") >= 2
    o = o.where((cut & F.col("_good")) | (~cut & (F.col("_k") == 0)))
    o = o.with_columns({
        "start_s": F.when(cut & (F.col("_k") > 0), F.col("_s")).otherwise(lo),
        "end_s": F.when(cut & (F.col("_k") < F.col("_n") - 1), F.col("_e")).otherwise(hi),
        "label": F.when(cut, F.col("_l")).otherwise(F.col("label"))})
    o = o.shift(prev={"_pe": "end_s"}).with_columns({"start_s": F.greatest("start_s", "_pe")})
    kept = o.df.filter(~cut | (F.col("end_s") - F.col("start_s") >= MIN_PIECE))
    return ordered(kept, keys, ["parent_idx", "_k"], split).number("idx").df.select(
        *keys, "idx", "start_s", "end_s", "label")


# ---- refinement -----------------------------------------------------------------------------------

@by_size("segments")
def refine_windows(segments: DataFrame, episodes: DataFrame, keys: Sequence[str] = EPISODE_KEYS,
                   half: float = REFINE_HALF_WINDOW, interval: float = REFINE_INTERVAL, mode: str = "sheets",
                   split: bool | None = None) -> DataFrame:
    """One row per border between neighbours: candidate time, inspected window, whether it is worth a
    look, and the neighbours' labels: (keys, boundary_idx, candidate, low, high, inspect, before, after)."""
    rows = _borders(segments, episodes, keys, half, interval, mode, split).filter(F.col("candidate").isNotNull())
    return rows.select(*keys, F.col("idx").alias("boundary_idx"), "candidate", "low", "high", "inspect",
                       F.col("label").alias("before"), F.col("_nl").alias("after"))


def _borders(segments: DataFrame, episodes: DataFrame, keys, half: float, interval: float, mode: str,
             split: bool | None) -> DataFrame:
    """Segments with their successor (``_ns``, ``_ne``, ``_nl``) and the window around the border to it."""
    o = ordered(segments, keys, ["idx"], split).shift(next={"_ns": "start_s", "_ne": "end_s", "_nl": "label"})
    rows = o.df.join(episodes.select("episode_id", "duration_s"), "episode_id")
    rows = rows.withColumn("candidate", (F.col("end_s") + F.col("_ns")) / 2.0)
    rows = rows.withColumns({"low": F.greatest(F.lit(0.0), F.col("candidate") - half),
                             "high": F.least(F.col("duration_s"), F.col("candidate") + half)})
    least = interval * 2 if mode == "sheets" else 0.5
    inspect = F.col("high") - F.col("low") >= least
    if mode == "sheets":
        inspect = inspect & (_frame_count(interval) >= 3)
    return rows.withColumn("inspect", inspect).drop("duration_s")


def _frame_count(interval: float) -> Column:
    return F.floor((F.col("high") - F.col("low") + EPS) / interval) + 1


def snap_to_frames(t: Column, low: Column, n: Column, interval: float) -> Column:
    """The inspected frame time nearest to ``t``, the earlier one on ties."""
    guess = F.floor((t - low) / interval)
    frames_ = F.array(*(F.least(F.greatest(guess + k, F.lit(0).cast("long")), n - 1) for k in (-1, 0, 1, 2)))
    return F.array_min(F.transform(frames_, lambda i: F.struct(
        F.abs(round_true(low + i * F.lit(interval), 3) - t).alias("gap"), round_true(low + i * F.lit(interval), 3).alias("t"))))["t"]


def choose(borders: DataFrame, choices: DataFrame, keys: Sequence[str] = EPISODE_KEYS,
           interval: float = REFINE_INTERVAL, mode: str = "sheets", on: str = "boundary_idx") -> DataFrame:
    """The refined time of each border: the answer snapped to an inspected frame (``sheets``) or shifted
    and rounded (``video``); the candidate when there is no answer or it lies outside the window."""
    rows = borders.join(choices.select(*keys, F.col("boundary_idx").alias(on), "boundary_s"), [*keys, on], "left")
    answer = F.col("boundary_s")
    if mode == "video":
        span = F.col("high") - F.col("low")
        rows = rows.withColumn("_at", F.col("low") + answer)
        good = F.col("inspect") & (answer >= -EPS) & (answer <= span + EPS)
        value = round_true("_at", 2)
    else:
        rows = rows.withColumn("_n", _frame_count(interval))
        rows = rows.withColumn("_hi", F.col("low") + (F.col("_n") - 1) * F.lit(interval))
        first, last = round_true("low", 3), round_true("_hi", 3)
        good = F.col("inspect") & (answer >= first - EPS) & (answer <= last + EPS)
        value = snap_to_frames(answer, F.col("low"), F.col("_n"), interval)
    refined = F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.col("candidate"))
    return rows.withColumn("t", refined).drop("_at", "_n", "_hi", "boundary_s")


@by_size("segments")
def apply_refinement(segments: DataFrame, choices: DataFrame, episodes: DataFrame,
                     keys: Sequence[str] = EPISODE_KEYS, half: float = REFINE_HALF_WINDOW,
                     interval: float = REFINE_INTERVAL, mode: str = "sheets",
                     split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Re-place every internal border: (segments, notes).

    A border may not invert the segment on its left, whose start was just set by the border before it,
    so times are settled in order: by a fold carrying that one start in small episodes, by composing what each border does to
    it in large ones. Borders moved by 0.75 s or more flag both neighbours and lower their confidence.
    """
    keys = list(keys)
    rows = choose(_borders(segments, episodes, keys, half, interval, mode, split), choices, keys, interval, mode, "idx")
    rows = rows.select(*segments.columns, "_ns", "_ne", "_nl", "t")
    settled = _settled_by_scan(rows, keys) if split else _settled_by_fold(rows, keys)
    settled = settled.withColumn("_moved", F.abs(F.col("_t") - (F.col("end_s") + F.col("_ns")) / 2.0))
    big = F.col("_moved") >= REFINE_FLAG
    settled = settled.withColumn("_flag", F.when(big, F.concat(F.lit("boundary_moved_"), fixed2("_moved"), F.lit("s"))))
    o = ordered(settled, keys, ["idx"], split).shift(prev={"_pf": "_flag"})
    touched = F.col("_pf").isNotNull() | F.col("_flag").isNotNull()
    out = o.df.withColumns({
        "start_s": F.coalesce("_from", "start_s"), "end_s": F.coalesce("_to", "end_s"),
        "flags": F.concat("flags", F.array_compact(F.array("_pf", "_flag"))),
        "confidence": F.when(touched, "low").otherwise(F.col("confidence"))}).select(*segments.columns)
    notes = settled.filter(big).select(*keys, F.col("idx").alias("boundary_idx"), F.concat(
        F.lit("refinement shifted '"), "label", F.lit("' | '"), "_nl", F.lit("' by "), fixed2("_moved"),
        F.lit("s")).alias("warning"))
    return out, notes


def _placed(start: Column, t: Column, end: Column) -> Column:
    """Where a border goes, given the start of the segment before it and the end of the one after; null without one."""
    return F.when(end.isNotNull(), F.least(F.greatest(t, start + REFINE_GUARD), end - REFINE_GUARD))


def _settled_by_fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_from`` and ``_to``, the rounded borders around each segment, and ``_t``, the right one before rounding."""
    item = F.struct(*[c for c in rows.columns if c not in keys])

    def step(state: Column, x: Column) -> Column:
        t = _placed(F.coalesce(state["start"], x["start_s"]), x["t"], x["_ne"])
        return F.struct(round_true(t, 2).alias("start"), t.alias("t"))

    nothing = F.lit(None).cast("double")
    settled = fold_groups(rows, keys, ["idx"], item, F.struct(nothing.alias("start"), nothing.alias("t")), step, False)
    return settled.withColumns({"_from": F.col("before.start"), "_to": F.col("after.start"), "_t": F.col("after.t")}).drop("before", "after")


def _settled_by_scan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same without a sequence. In hundredths, the step of a border is s -> min(max(s + shift, low), high): rounding never
    changes an order, so it may be applied to the three parts. Such steps compose to one of their kind; the first border
    of a group does not depend on a start before it."""
    guard = round(REFINE_GUARD * 100)

    def hundredths(c: Column) -> Column:
        return F.round(round_true(c, 2) * 100).cast("long")

    def after(a: Column, b: Column) -> Column:
        low = F.greatest(a["low"] + b["shift"], b["low"])
        return F.struct((a["shift"] + b["shift"]).alias("shift"), low.alias("low"),
                        F.least(F.greatest(a["high"] + b["shift"], b["low"]), b["high"]).alias("high"))

    o = ordered(rows, keys, ["idx"], True).shift(prev={"_before": "idx"})
    first = hundredths(_placed(F.col("start_s"), F.col("t"), F.col("_ne")))
    step = F.when(F.col("_before").isNull(), F.struct(F.lit(0).cast("long").alias("shift"), first.alias("low"), first.alias("high"))).otherwise(
        F.struct(F.lit(guard).cast("long").alias("shift"), hundredths(F.col("t")).alias("low"), hundredths(F.col("_ne") - REFINE_GUARD).alias("high")))
    o = o.scan("_step", F.when(F.col("_ne").isNotNull(), step), after)
    value = F.least(F.greatest(F.col("_step.shift"), F.col("_step.low")), F.col("_step.high")) / F.lit(100.0)
    o = o.with_columns({"_to": F.when(F.col("_ne").isNotNull(), value)}).shift(prev={"_from": "_to"})
    return o.df.withColumn("_t", _placed(F.coalesce("_from", "start_s"), F.col("t"), F.col("_ne"))).drop("_before", "_step")


# ---- labelling ------------------------------------------------------------------------------------

@by_size("segments")
def with_neighbours(segments: DataFrame, keys: Sequence[str] = EPISODE_KEYS, split: bool | None = None) -> DataFrame:
    """Labels of the previous and the following segment."""
    return ordered(segments, keys, ["idx"], split).shift(prev={"previous": "label"}, next={"following": "label"}).df


def label_windows(segments: DataFrame, episodes: DataFrame, context: float = LABEL_CONTEXT,
                  max_frames: int = LABEL_MAX_FRAMES) -> DataFrame:
    """The stretch shown when labelling a segment and its sampling interval."""
    rows = segments.join(episodes.select("episode_id", "duration_s"), "episode_id")
    rows = rows.withColumns({"lo": F.greatest(F.lit(0.0), F.col("start_s") - context),
                             "hi": F.least(F.col("duration_s"), F.col("end_s") + context)})
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.5))
    return rows.withColumn("interval", F.greatest(span / max_frames, F.lit(0.1)))


def apply_labels(segments: DataFrame, labels: DataFrame, requests: DataFrame | None = None,
                 keys: Sequence[str] = EPISODE_KEYS) -> DataFrame:
    """Take over label, result, attributes and description from a labelling pass (keys, idx, ...).

    Segments without an answer stay as they are. A segment with the reserved label keeps it and fails.
    When the two passes named different events the segment is flagged and its confidence lowered.
    """
    keys = list(keys)
    answer = labels.select(*keys, "idx", F.lit(True).alias("_a"), F.col("label").alias("_l"), F.col("result").alias("_r"),
                           F.col("attributes").alias("_at"), F.col("description").alias("_d"))
    rows = segments.join(answer, [*keys, "idx"], "left")
    if requests is None:
        rows = rows.withColumn("_schema", F.lit(False))
    else:
        rows = rows.join(requests.select("episode_id", (F.size("subtasks") > 0).alias("_schema")), "episode_id", "left")
        rows = rows.withColumn("_schema", F.coalesce("_schema", F.lit(False)))
    has = F.col("_a").isNotNull()
    reserved = text.normal("label") == NO_EVENT_LABEL
    free = has & ~reserved
    named = F.coalesce(F.col("_l"), F.lit("")) != ""
    differs = free & named & (F.col("label") != "") & text.disagrees("label", "_l", "_schema")
    rows = rows.withColumns({"_free": free, "_res": has & reserved, "_diff": F.coalesce(differs, F.lit(False)),
                             "_named": named})
    return rows.withColumns({
        "label": F.when(F.col("_free") & F.col("_named"), F.col("_l")).otherwise(F.col("label")),
        "result": F.when(F.col("_res"), "fail").when(
            F.col("_free"), text.coerce(F.coalesce("_r", F.lit("")), RESULTS, "unknown")).otherwise(F.col("result")),
        "attributes": F.when(has, F.coalesce("_at", text.empty())).otherwise(F.col("attributes")),
        "description": F.when(has, text.strip(F.coalesce("_d", F.lit("")))).otherwise(F.col("description")),
        "flags": F.when(F.col("_diff"), F.concat("flags", F.array(F.lit("label_disagreement")))).otherwise(F.col("flags")),
        "confidence": F.when(F.col("_diff"), "low").otherwise(F.col("confidence"))}).select(*segments.columns)


# ---- request text and the batch hook --------------------------------------------------------------

# Wording of our own: {task}, {window}, {vocabulary}, {neighbours} and {attributes} are filled per row.
SEGMENT_TEMPLATE = ("List the completed events of this recording as start, end and label.\n"
                    "{task}\n{window}\n{vocabulary}")
LABEL_TEMPLATE = ("Name the event that completes in this stretch and say whether it succeeded.\n"
                  "{task}\n{window}\n{neighbours}\n{vocabulary}\n{attributes}")


def render_requests(df: DataFrame, template: str = SEGMENT_TEMPLATE, name: str = "request") -> DataFrame:
    """Fill a request template from whichever of these columns exist: prompt, lo, hi, previous_label,
    previous, following, subtasks, attributes."""
    have = set(df.columns)
    empty = F.lit("")

    def some(c: str) -> Column:
        return F.coalesce(F.col(c), empty) if c in have else empty

    task = F.when(text.strip(some("prompt")) != "", F.concat(F.lit("Task: "), text.strip(some("prompt")))).otherwise(
        "The task is not stated.")
    window = empty
    if {"lo", "hi"} <= have:
        window = F.concat(F.lit("This excerpt runs "), fixed2("lo"), F.lit("s to "), fixed2("hi"),
                          F.lit("s, and all times lie within it."))
        window = F.when(F.col("lo").isNull(), empty).otherwise(window)
        window = F.concat(window, F.when(some("previous_label") != "", F.concat(
            F.lit(" It opens in the middle of '"), some("previous_label"), F.lit("'."))).otherwise(""))
    around = F.concat(
        F.when(some("previous") != "", F.concat(F.lit("Before: "), some("previous"), F.lit("\n"))).otherwise(""),
        F.when(some("following") != "", F.concat(F.lit("After: "), some("following"))).otherwise(""))
    free_choice = F.lit("Label each event with a few words, action first.")
    vocabulary = free_choice
    if "subtasks" in have:
        listed = F.array_join(F.transform("subtasks", lambda s: F.concat(F.lit("    - "), s)), "\n")
        vocabulary = F.when(F.coalesce(F.size("subtasks"), F.lit(0)) > 0, F.concat(
            F.lit("Choose every label from this list:\n"), listed,
            F.lit(f"\n    - {NO_EVENT_LABEL}"))).otherwise(free_choice)
    attributes = F.lit("There is no list of attributes.")
    if "attributes" in have:
        attributes = F.when(F.coalesce(F.size("attributes"), F.lit(0)) > 0, F.concat(
            F.lit("Attributes to choose from: "), F.array_join("attributes", ", "))).otherwise(attributes)
    parts = {"{task}": task, "{window}": window, "{neighbours}": around, "{vocabulary}": vocabulary,
             "{attributes}": attributes}
    filled = reduce(lambda out, kv: F.replace(out, F.lit(kv[0]), kv[1]), parts.items(), F.lit(template))
    return df.withColumn(name, filled)


CALL_SCHEMA = struct(ok=T.BooleanType(), answer=T.StringType(), error=T.StringType(), trace=T.StringType(),
                     prompt_tokens=T.LongType(), output_tokens=T.LongType(), retries=T.LongType())
# Tasks of calls a core, and stacks of failed calls whose lines a task keeps.
TASKS, PLACES = 4, 1_000


def propose(requests: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], keep: Sequence[str],
            ledger: str | None = None) -> DataFrame:
    """Run a user's batch callable over request rows: pandas in, one answer row per request out, with
    any of the ``CALL_SCHEMA`` columns. A batch that raises is retried row by row, and a row that
    raises becomes ``ok = false`` with the error (300 characters) and trace (last 400). A batch holds any rows in any order.

    With ``ledger``, a folder that all executors share, equal requests are one call, every attempt is written there
    before its answer is used, and no finished call is repeated: not by a task that runs again after it was
    killed, not by a retried batch, and not by a later job over the same or more requests. ``calls.usage`` sums what all
    attempts took, failed ones included. Failed requests are asked again by a later job.
    """
    keep = list(keep)
    schema = T.StructType([requests.schema[k] for k in keep] + CALL_SCHEMA.fields)
    if ledger is None:
        # Dealt evenly: the calls take the time, and tasks cut by size of rows are few and end far apart.
        n = TASKS * requests.sparkSession.sparkContext.defaultParallelism
        return requests.repartition(n).mapInPandas(_caller(call, keep, None), schema)
    asked = requests.withColumn("_key", calls.key(requests))
    unique = asked.dropDuplicates(["_key"])
    known = calls.answers(requests.sparkSession, ledger)
    if known is not None:
        unique = unique.join(known.select("_key"), "_key", "left_anti")
    # Sorted, so that a task that runs again cuts the same batches.
    unique = unique.repartition("_key").sortWithinPartitions("_key")
    answered = unique.mapInPandas(_caller(call, ["_key"], ledger), T.StructType([T.StructField("_key", T.StringType()), *CALL_SCHEMA.fields]))
    if known is not None:
        answered = answered.unionByName(known)
    return asked.select(*keep, "_key").join(answered, "_key").select(*schema.names)


def _caller(call: Callable[[pd.DataFrame], pd.DataFrame], keep: list[str], ledger: str | None):
    """The function that a task runs over its batches."""
    fields = [(f.name, f.dataType.simpleString()) for f in CALL_SCHEMA.fields]
    defaults = [{"boolean": True, "bigint": 0}.get(kind) for _, kind in fields]
    places: dict[tuple, tuple[str, list]] = {}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        got = call(rows.drop(columns="_key", errors="ignore")).reset_index(drop=True)
        if len(got) != len(rows):
            raise ValueError(f"expected {len(rows)} answers, got {len(got)}")
        out = rows[keep].reset_index(drop=True)
        out["ok"] = got["ok"].astype(bool) if "ok" in got else True
        for name, kind in fields[1:]:
            out[name] = got[name] if name in got else (0 if kind == "bigint" else None)
        return out

    def failed(rows: pd.DataFrame, exc: Exception) -> pd.DataFrame:
        return rows[keep].reset_index(drop=True).assign(**failure(exc))

    def failure(exc: Exception) -> dict[str, object]:
        """Inside the handler of ``exc``: the columns of a row whose call raised."""
        # What a failed call took, if the error says so.
        took = {name: int(getattr(exc, name, 0) or 0) for name, kind in fields if kind == "bigint"}
        return {"ok": False, "answer": None, "error": f"{type(exc).__name__}: {exc}"[:300], "trace": trace(exc)[-400:], **took}

    def trace(exc: Exception) -> str:
        """``traceback.format_exc()`` inside the handler of ``exc``. The stack's lines are formatted once a place, as that takes
        longer than many calls; the error itself every time."""
        if exc.__cause__ is not None or exc.__context__ is not None or isinstance(exc, BaseExceptionGroup):
            return traceback.format_exc()
        said = "".join(traceback.TracebackException(type(exc), exc, exc.__traceback__, limit=0, compact=True).format_exception_only())
        steps, tb = [], exc.__traceback__
        while tb is not None:
            steps.append((tb.tb_frame.f_code, tb.tb_lasti))
            tb = tb.tb_next
        place = tuple((id(code), at) for code, at in steps)
        if place not in places:
            if len(places) == PLACES:
                places.clear()
            places[place] = traceback.format_exc().removesuffix(said), steps  # the steps keep their ids from being given again
        return places[place][0] + said

    def apart(rows: pd.DataFrame) -> pd.DataFrame:
        """Row by row, gathered: one frame for all answers instead of one a row, which would take longer than most calls."""
        asked, answers, names = rows.drop(columns="_key", errors="ignore"), [], None
        for i in range(len(asked)):
            try:
                got = call(asked.iloc[i:i + 1])
                if len(got) != 1:
                    raise ValueError(f"expected 1 answers, got {len(got)}")
                if (have := got.columns.tolist()) != names:
                    names, at = have, [have.index(name) if name in have else -1 for name, _ in fields]
                # All cells at once and as they are; a column at a time would take twice the call.
                cells = got.to_numpy(dtype=object)[0]
                answer = [cells[k] if k >= 0 else default for k, default in zip(at, defaults)]
                answer[0] = bool(answer[0])
            except Exception as exc:  # noqa: BLE001 - isolate the failing rows
                said = failure(exc)
                answer = [said[name] for name, _ in fields]
            answers.append(answer)
        out = rows[keep].reset_index(drop=True)
        for k, (name, kind) in enumerate(fields):
            out[name] = pd.Series([answer[k] for answer in answers], dtype=bool if kind == "boolean" else object)
        return out

    def attempt(rows: pd.DataFrame, book: calls.Ledger | None) -> tuple[pd.DataFrame, bool]:
        """The answers to some rows, from the ledger if they are there, and whether the call came through."""
        if book is not None and (found := book.read(rows["_key"])) is not None:
            return found
        try:
            out, fine = one(rows), True
        except Exception as exc:  # noqa: BLE001 - isolate the failing rows
            out, fine = failed(rows, exc), False
        if book is not None:
            book.write(rows["_key"], out, fine)
        return out, fine

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = calls.Ledger(ledger) if ledger is not None else None
        for rows in batches:
            out, fine = attempt(rows, book)
            if fine or len(rows) == 1 and book is not None:
                yield out
                continue
            if book is None:
                yield apart(rows)
                continue
            for i in range(len(rows)):
                yield attempt(rows.iloc[i:i + 1], book)[0]
    return run


# ---- relabelling ----------------------------------------------------------------------------------

def relabel(pred: DataFrame, rows: DataFrame, episodes: DataFrame, labels: DataFrame, run: str,
            requests: DataFrame | None = None, split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Re-run only the labelling over the stored segments of one run: (segments, warnings).

    Keeps rows that succeeded and whose episode is in the dataset; labels join on (episode_id, idx).
    """
    from spanlake.operators.clean import clean, to_segments
    good = rows.filter(F.col("ok") & (F.col("run") == run)).select("episode_id")
    spans = pred.filter(F.col("run") == run).drop("run")
    spans = spans.join(good, "episode_id", "left_semi").join(episodes.select("episode_id"), "episode_id", "left_semi")
    return clean(apply_labels(to_segments(spans), labels, requests), episodes, requests, split=split)
