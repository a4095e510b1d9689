"""Normalise raw step annotations of different layouts into one episode/segment layout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import text
from spanlake.functions.intervals import col
from spanlake.functions.phrases import skill_phrase
from spanlake.functions.rounding import round_true
from spanlake.operators.layout import (SPLIT_ROWS, by_size, durable, first_beyond, fold_groups, last_within,
                                       on_path, ordered)
from spanlake.operators.scoring import point_join

COARSE, FINE = "Coarse grained action", "Fine grained action"
MIN_CHUNK = 2.0
MIN_REST = 0.05
SESSION, CHUNK = ["session"], ["session", "chunk"]


# ---- scalar rules ---------------------------------------------------------------------------------

def fps_from_ratio(c) -> Column:
    """'30000/1001' -> 29.97...; 0 when the denominator is missing or 0."""
    parts = F.split(col(c), "/")
    den = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("double"), F.lit(0.0))
    return F.coalesce(F.try_divide(F.try_element_at(parts, F.lit(1)).cast("double"), den), F.lit(0.0))


def frames_to_seconds(frame, fps, duration) -> Column:
    """Frame number to seconds, clamped to the recording."""
    return F.least(col(frame) / col(fps), col(duration))


def family_from_id(c) -> Column:
    return F.split(col(c), "_")[0]


def track_episode_id(h5_path, archive, episode_no) -> Column:
    """Task and episode numbers from the storage path, or from the archive name when it has none."""
    h5, archive, no = F.coalesce(col(h5_path), F.lit("")), col(archive), col(episode_no)
    pattern = r"/(\d+)/(\d+)/proprio_stats\.h5$"
    known = F.regexp_extract(h5, pattern, 0) != ""
    stem = F.split(F.element_at(F.split(archive, "/"), -1), r"\.")[0]
    number = F.when(F.length(no.cast("string")) < 3, F.lpad(no.cast("string"), 3, "0")).otherwise(no.cast("string"))
    return F.concat(F.lit("task"), F.when(known, F.concat_ws("_", F.regexp_extract(h5, pattern, 1), F.regexp_extract(h5, pattern, 2)))
                    .otherwise(F.concat_ws("_", F.regexp_extract(archive, r"task_(\d+)", 1), stem, number)))


def mismatch_note(last_end, n_frames, trailing: bool = True) -> Column:
    """Note when annotation and recording differ by more than two frames."""
    last_end, n = col(last_end), col(n_frames)
    if not trailing:
        return F.when(F.abs(n - last_end) > 2, F.format_string(
            "; the recording is %+d frames off the last step, times are cut to it", n - last_end)).otherwise("")
    return (F.when(last_end > n + 2, F.format_string(
        "; steps run %d frames past the end and are cut to it", last_end - n))
        .when(n - last_end > 2, F.format_string("; no step in the last %d frames", n - last_end)).otherwise(""))


def fine_text(attributes) -> Column:
    """Verb, adjective, noun and adverbial joined; blanks and 'none' left out."""
    a = col(attributes)
    parts = F.array(*(F.coalesce(a[k], F.lit("")) for k in ("Verb", "Adjective", "Noun", "adverbial")))
    kept = F.filter(F.transform(parts, text.strip), lambda p: (p != "") & (F.lower(p) != "none"))
    return text.strip(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


# ---- whole-episode rules --------------------------------------------------------------------------

@by_size("steps")
def drop_non_monotonic(steps: DataFrame, keys: Sequence[str] = ("episode_id",), start: str = "start_frame",
                       end: str = "end_frame", split: bool | None = None) -> DataFrame:
    """Remove episodes in which any step is empty, inverted or starts before the previous one ends."""
    o = ordered(steps, keys, ["idx"], split).shift(prev={"_pe": end})
    bad = (F.col(end) <= F.col(start)) | F.coalesce(F.col(start) < F.col("_pe"), F.lit(False))
    o = o.with_columns({"_bad": bad.cast("int")}).total({"_any": ("max", "_bad")})
    return o.where("_any = 0").df.drop("_pe", "_bad", "_any")


def to_seconds(steps: DataFrame, videos: DataFrame, trailing: bool = True) -> DataFrame:
    """Frame-indexed steps to gold segments: clamp to the recording, drop what becomes empty, round to
    1 ms. ``videos``: (episode_id, fps, n_frames, duration_s). Adds the episode's mismatch ``note``."""
    rows = steps.join(videos.select("episode_id", "fps", "n_frames", "duration_s"), "episode_id")
    rows = rows.withColumns({"_s": frames_to_seconds("start_frame", "fps", "duration_s"),
                             "_e": frames_to_seconds("end_frame", "fps", "duration_s")})
    last = steps.groupBy("episode_id").agg(F.max_by("end_frame", "idx").alias("_last"))
    rows = rows.join(last, "episode_id").withColumn("note", mismatch_note("_last", "n_frames", trailing))
    rows = rows.withColumns({"start_s": round_true("_s", 3), "end_s": round_true("_e", 3)})
    kept = F.col("end_s") > F.col("start_s") if trailing else F.col("_e") > F.col("_s")
    return rows.filter(kept).select("episode_id", "idx", "start_s", "end_s", "label", "note")


def steps_from_frames(raw: DataFrame) -> DataFrame:
    """Simulator steps (``schema.SIMULATOR_STEPS``) to (episode_id, idx, start_frame, end_frame, label)."""
    return raw.select("episode_id", F.posexplode("steps").alias("idx", "s")).select(
        "episode_id", F.col("idx").cast("long").alias("idx"), F.col("s.timestep.start").alias("start_frame"),
        F.col("s.timestep.end").alias("end_frame"), text.strip("s.subtask_description").alias("label"))


def _track_rows(raw: DataFrame) -> DataFrame:
    rows = raw.select("archive", "h5_path", F.explode("instruction_segments").alias("episode_no", "segments"))
    rows = rows.withColumn("episode_id", track_episode_id(
        F.try_element_at("h5_path", "episode_no"), "archive", F.col("episode_no").cast("int")))
    return rows.select("episode_id", F.col("episode_no").cast("long").alias("episode_no"),
                       F.posexplode("segments").alias("pos", "s")).select(
        "episode_id", "episode_no", "pos", "s.track", text.strip(F.coalesce("s.instruction", F.lit(""))).alias("label"),
        F.coalesce("s.skill", F.lit("")).alias("skill"), F.col("s.start_frame_index").alias("start_frame"),
        F.col("s.end_frame_index").alias("end_frame"))


def steps_from_tracks(raw: DataFrame, split: bool | None = None) -> DataFrame:
    """The 'default' track of instruction segments, in time order, blank instructions left out."""
    rows = _track_rows(raw).filter((F.col("track") == "default") & (F.col("label") != ""))
    return ordered(rows, ["episode_id"], ["start_frame", "end_frame", "pos"], split).number("idx").df.select(
        "episode_id", "episode_no", "idx", "start_frame", "end_frame", "label", "skill")


def track_instructions(raw: DataFrame, tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episode instruction: the distinct coarse 'Subtask' sentences in order, else the task text."""
    rows = _track_rows(raw)
    coarse = rows.filter((F.lower("track") == "subtask") & (F.col("label") != ""))
    joined = instruction_text(coarse, ["episode_id"], ["start_frame", "pos"], "label")
    ids = rows.select("episode_id", "episode_no").distinct()
    return join_meta(ids.join(joined, "episode_id", "left"), tasks, episodes).select(
        "episode_id", F.coalesce("instruction", "task").alias("instruction"), F.col("task").alias("task_name"))


def join_meta(rows: DataFrame, tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Task text by episode number, defaulting to task 0 and then to the first task listed."""
    first = tasks.agg(F.min_by("task", "task_index")).scalar()
    out = rows.join(episodes.select(F.col("episode_index").alias("episode_no"), "task_index", "length"), "episode_no", "left")
    out = out.withColumn("task_index", F.coalesce("task_index", F.lit(0).cast("long"))).join(tasks, "task_index", "left")
    return out.withColumn("task", F.coalesce(F.col("task"), first, F.lit("")))


def instruction_text(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sentence: str,
                     distinct: bool = True) -> DataFrame:
    """Sentences of each group in order, joined by spaces; repeats dropped unless told otherwise."""
    if distinct:  # first occurrences only, found before anything is gathered
        rows = rows.groupBy(*keys, sentence).agg(F.min(F.struct(*order)).alias("_at"))
    else:
        rows = rows.withColumn("_at", F.struct(*order))
    listed = F.array_sort(F.collect_list(F.struct("_at", sentence)))
    return rows.filter(F.col(sentence) != "").groupBy(*keys).agg(listed.alias("_l")).select(
        *keys, F.array_join(F.col("_l")[sentence], " ").alias("instruction"))


def steps_from_skills(raw: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Skill annotations to steps with composed text. ``words``: (episode_id, vocabulary array)."""
    rows = raw.select("episode_id", F.posexplode("skill_annotation").alias("idx", "s"))
    if words is not None:
        rows = rows.join(words, "episode_id", "left")
    else:
        rows = rows.withColumn("vocabulary", text.empty())
    label = skill_phrase(F.col("s.skill_description"), F.col("s.object_id"), F.col("s.memory_prefix"),
                         F.col("s.spatial_prefix"), F.col("s.manipulating_object_id"), F.col("vocabulary"))
    return rows.select("episode_id", F.col("idx").cast("long").alias("idx"), F.col("s.frame_duration")[0].alias("start_frame"),
                       F.col("s.frame_duration")[1].alias("end_frame"), label.alias("label"))


# ---- coarse/fine sessions -------------------------------------------------------------------------

def session_events(raw: DataFrame) -> DataFrame:
    """(session, idx, kind, start_s, end_s, text): coarse rows carry their sentence, fine rows their
    composed text."""
    rows = raw.select(F.col("video_name").alias("session"), F.col("taskType").alias("task_type"),
                      F.posexplode("events").alias("idx", "e"))
    sentence = text.strip(F.coalesce(F.col("e.attributes")["Action sentence"], F.lit("")))
    return rows.select("session", "task_type", F.col("idx").cast("long").alias("idx"),
                       F.when(F.col("e.label") == COARSE, "coarse").when(F.col("e.label") == FINE, "fine").alias("kind"),
                       F.col("e.start").alias("start_s"), F.col("e.end").alias("end_s"),
                       F.when(F.col("e.label") == COARSE, sentence).otherwise(fine_text(F.col("e.attributes"))).alias("text"))


@by_size("events", keys=SESSION)
def eligible_sessions(events: DataFrame, min_fine: int = 3, min_coarse: int = 1, split: bool | None = None) -> DataFrame:
    """Events of the sessions with enough fine and coarse actions. Small sessions are counted in the window whose
    shuffle later steps reuse; otherwise counts are combined before they move."""
    fine, coarse = F.col("kind") == "fine", F.col("kind") == "coarse"
    if not split:
        w = Window.partitionBy("session")
        rows = events.withColumns({"_f": F.count_if(fine).over(w), "_c": F.count_if(coarse).over(w)})
        return rows.filter((F.col("_f") >= min_fine) & (F.col("_c") >= min_coarse)).drop("_f", "_c")
    good = events.groupBy("session").agg(F.count_if(fine).alias("_f"), F.count_if(coarse).alias("_c"))
    good = good.filter((F.col("_f") >= min_fine) & (F.col("_c") >= min_coarse))
    return events.join(good.select("session"), "session", "left_semi")


@by_size("coarse", keys=SESSION)
def chunk_sessions(coarse: DataFrame, max_sec: float = 180.0, split: bool | None = None) -> DataFrame:
    """Cut sessions at coarse-action borders: a new chunk starts when the action would end more than
    ``max_sec`` after the running chunk began. Returns the coarse rows with ``chunk`` and chunk bounds.

    In small sessions this is a fold carrying the start of the running chunk. In large ones every action points to the one
    that would start the next chunk if a chunk began with it, and the chunks are the path along these pointers.
    """
    def breaks(start: Column, end: Column) -> Column:
        return start.isNull() | (end - start > max_sec)

    if split:
        return _chunk_by_pointers(coarse, max_sec)
    item = F.struct(*[c for c in coarse.columns if c != "session"])
    rows = fold_groups(coarse, SESSION, ["start_s", "idx"], item, F.lit(None).cast("double"),
                       lambda start, x: F.when(breaks(start, x["end_s"]), x["start_s"]).otherwise(start), False)
    o = ordered(rows, SESSION, ["start_s", "idx"], False)
    o = o.islands("_n", breaks(F.col("before"), F.col("end_s")))
    return o.df.withColumn("chunk", F.col("_n") - 1).drop("_n", "before", "after")


def _chunk_by_pointers(coarse: DataFrame, max_sec: float) -> DataFrame:
    """The first action that ends beyond the limit of an earlier start: an action longer than the limit always does, for
    whichever start before it. Of the others, none before a start can end beyond its limit, so their running maximum
    tells which is the first."""
    long = F.col("end_s") - F.col("start_s") > max_sec
    o = ordered(coarse, SESSION, ["start_s", "idx"], True).number("_pos")
    o = o.running({"_until": ("max", F.when(~long, F.col("end_s")))})
    o = o.running({"_long": ("min", F.when(long, F.col("_pos")))}, backwards=True)
    rows = durable(o.df)
    record = ~long & (F.col("_until").isNull() | (F.col("end_s") > F.col("_until")))
    points = rows.filter(record).select("session", F.col("end_s").alias("v"), F.lit(0).alias("kind"), F.col("_pos").alias("pos")).unionByName(
        rows.select("session", last_within(F.col("start_s"), max_sec).alias("v"), F.lit(1).alias("kind"), F.col("_pos").alias("pos")))
    found = first_beyond(points, SESSION)
    links = found.join(rows.select("session", F.col("_pos").alias("pos"), "_long"), ["session", "pos"]).select(
        "session", "pos", F.least("nxt", "_long").alias("nxt"), (F.col("pos") == 0).alias("start"))
    starts = on_path(links, SESSION).select("session", F.col("pos").alias("_pos"), F.lit(True).alias("_starts"))
    marked = rows.drop("_until", "_long").join(starts, ["session", "_pos"], "left")
    o = ordered(marked, SESSION, ["_pos"], True).islands("_n", F.col("_starts").isNotNull())
    return o.df.withColumn("chunk", F.col("_n") - 1).drop("_n", "_pos", "_starts")


def chunk_bounds(chunked: DataFrame) -> DataFrame:
    """(session, chunk, cs, ce, instruction): the end is that of the last action in order."""
    # One grouping for bounds and text, as either would cut the sessions again.
    at = F.struct("start_s", "idx")
    said = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(at.alias("_at"), "text"))))
    rows = chunked.groupBy("session", "chunk").agg(F.min("start_s").alias("cs"), F.max_by("end_s", at).alias("ce"), said.alias("_said"))
    named = F.col("session").isNotNull() & (F.size("_said") > 0)
    return rows.withColumn("instruction", F.when(named, F.array_join(F.col("_said")["text"], " "))).drop("_said")


@by_size("fine", keys=SESSION)
def assign_to_chunks(fine: DataFrame, chunks: DataFrame, split: bool | None = None) -> DataFrame:
    """Fine actions whose midpoint lies in a chunk, clipped to it. Blank texts are kept for counting."""
    points = fine.select("session", "idx", F.col("start_s").alias("f0"), F.col("end_s").alias("f1"), "text",
                         ((F.col("start_s") + F.col("end_s")) / 2).alias("_mid"))
    rows = point_join(chunks.select("session", "chunk", "cs", "ce"), points, ["session"], "cs", "ce", "_mid", split)
    rows = rows.withColumns({"s": F.greatest("f0", "cs"), "t": F.least("f1", "ce")}).drop("_mid")
    return rows.filter(F.col("t") > F.col("s"))


@by_size("assigned", keys=CHUNK)
def trim_fine(assigned: DataFrame, split: bool | None = None) -> DataFrame:
    """Start overlapping fine actions where the previous kept one ends; drop those left with 0.05 s or
    less. A dropped action may end later than the kept one, so only kept ends count: a fold in small chunks, the path of
    the kept actions in large ones."""
    said = assigned.filter(F.col("text") != "")
    kept = _kept_by_pointers(said) if split else _kept_by_fold(said)
    kept = kept.withColumn("s", F.greatest("s", "before"))
    o = ordered(kept, CHUNK, ["f0", "f1", "idx"], split)
    return o.number("_pos").df.select(
        *CHUNK, F.col("_pos").alias("idx"), round_true(F.col("s") - F.col("cs"), 3).alias("start_s"),
        round_true(F.col("t") - F.col("cs"), 3).alias("end_s"), F.col("text").alias("label"))


def _kept_by_fold(said: DataFrame) -> DataFrame:
    item = F.struct(*[c for c in said.columns if c not in CHUNK])

    def dropped(prev: Column, s: Column, t: Column) -> Column:
        return (s < prev) & (t - prev <= MIN_REST)

    rows = fold_groups(said, CHUNK, ["f0", "f1", "idx"], item, F.lit(0.0),
                       lambda prev, x: F.when(dropped(prev, x["s"], x["t"]), prev).otherwise(x["t"]), False)
    return rows.filter(~dropped(F.col("before"), F.col("s"), F.col("t"))).drop("after")


def _kept_by_pointers(said: DataFrame) -> DataFrame:
    """After a kept action the next one kept is the first that starts at its end or later, or ends more than the rest
    beyond it. Starts never fall along the order. Ends do, but an action that ends well before an earlier one is itself never
    kept: kept ends rise, and whatever kept or dropped the earlier one drops it too. So a running maximum serves for the others.
    The path begins at an action before all others that ends at 0."""
    o = ordered(said, CHUNK, ["f0", "f1", "idx"], True).number("_pos").running({"_until": ("max", "t")})
    rows = durable(o.df)
    within = last_within(F.col("t"), MIN_REST)
    sources = rows.filter(F.col("_until").isNull() | (F.col("_until") <= within)).select(*CHUNK, F.col("_pos").alias("pos"), "t")
    sources = sources.unionByName(rows.filter("_pos = 0").select(*CHUNK, F.lit(-1).cast("long").alias("pos"), F.lit(0.0).alias("t")))
    record = F.col("_until").isNull() | (F.col("t") > F.col("_until"))
    by_start, by_end = F.lit("start").alias("by"), F.lit("end").alias("by")
    points = reduce(DataFrame.unionByName, (
        rows.select(*CHUNK, by_start, F.col("s").alias("v"), F.lit(2).alias("kind"), F.col("_pos").alias("pos")),
        sources.select(*CHUNK, by_start, F.col("t").alias("v"), F.lit(1).alias("kind"), "pos"),
        rows.filter(record).select(*CHUNK, by_end, F.col("t").alias("v"), F.lit(0).alias("kind"), F.col("_pos").alias("pos")),
        sources.select(*CHUNK, by_end, last_within(F.col("t"), MIN_REST).alias("v"), F.lit(1).alias("kind"), "pos")))
    found = first_beyond(points, [*CHUNK, "by"]).groupBy(*CHUNK, "pos").agg(F.min("nxt").alias("nxt"))
    path = on_path(found.withColumn("start", F.col("pos") == -1), CHUNK)
    kept = rows.drop("_until").join(path.select(*CHUNK, F.col("pos").alias("_pos")), [*CHUNK, "_pos"])
    o = ordered(kept, CHUNK, ["_pos"], True).shift(prev={"before": "t"})
    return o.df.withColumn("before", F.coalesce("before", F.lit(0.0))).drop("_pos")


def steps_from_events(raw: DataFrame, videos: DataFrame | None = None, max_sec: float = 180.0,
                      split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """``session_steps`` of nested sessions (``schema.SESSION_EVENTS``)."""
    return session_steps(session_events(raw), videos, max_sec, split)


@by_size("events", keys=SESSION)
def session_steps(events: DataFrame, videos: DataFrame | None = None, max_sec: float = 180.0,
                  split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, gold) from the events of coarse/fine sessions, as from ``session_events``: chunks of at least
    2 s become episodes ``<session>_<nn>``, fine actions their segments. ``videos``: (session, duration_s)."""
    events = eligible_sessions(events, split=split)
    chunks = chunk_bounds(chunk_sessions(events.filter("kind = 'coarse'"), max_sec, split))
    if videos is not None:
        chunks = chunks.join(videos.select("session", "duration_s"), "session").withColumn(
            "ce", F.least("ce", "duration_s")).drop("duration_s")
    chunks = chunks.filter(F.col("ce") - F.col("cs") >= MIN_CHUNK)
    gold = trim_fine(assign_to_chunks(events.filter("kind = 'fine'"), chunks, split), split)
    number = F.col("chunk").cast("string")
    episode = F.concat("session", F.lit("_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    gold = gold.withColumn("episode_id", episode)
    kinds = events.groupBy("session").agg(F.max("task_type").alias("task_type"))
    used = chunks.join(gold.select("session", "chunk").distinct(), ["session", "chunk"], "left_semi")
    episodes = used.join(kinds, "session").select(
        episode.alias("episode_id"), F.coalesce(F.nullif("instruction", F.lit("")), "task_type", F.lit("")).alias("instruction"),
        (F.col("ce") - F.col("cs")).alias("duration_s"), "session", "chunk", "cs", "ce")
    return episodes, gold.select("episode_id", "idx", "start_s", "end_s", "label")


# ---- selection ------------------------------------------------------------------------------------

def gold_vocabulary(gold: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Each episode's distinct labels ignoring case, first spelling, first-seen order:
    (keys, subtasks). One entry per distinct label is gathered, not one per segment."""
    first = gold.groupBy(*keys, F.lower("label").alias("_l")).agg(F.min(F.struct("idx", "label")).alias("_f"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("_f")).alias("_a")).select(
        *keys, F.col("_a.label").alias("subtasks"))


def first_per_task(rows: DataFrame, limit: int, n_tasks: int, order: Sequence[str], task: str = "task_index",
                   split: bool | None = None) -> DataFrame:
    """The first ceil(limit / n_tasks) rows of each task, ``limit`` in all."""
    per_task = -(-limit // n_tasks)
    o = ordered(rows, [task], order, split).number("_k")
    return o.where(F.col("_k") < per_task).df.drop("_k").orderBy(task, *order).limit(limit)


def natural_order(c) -> list[Column]:
    """Sort 'case2' before 'case10'."""
    return [F.regexp_replace(col(c), r"\d+$", ""), F.regexp_extract(col(c), r"(\d+)$", 1).cast("long")]


def quota(groups: DataFrame, limit: int, order: str) -> DataFrame:
    """Split ``limit`` over the groups: the first limit % n get one more. Adds ``k``."""
    n = groups.count()
    o = ordered(groups.withColumn("_all", F.lit(0)), ["_all"], [order], n > SPLIT_ROWS).number("_i")
    k = F.lit(limit // n) + (F.col("_i") < limit % n).cast("int")
    return o.df.withColumn("k", k).drop("_all", "_i")


def spread(rows: DataFrame, k, by: Sequence[str], order: Sequence, split: bool | None = None) -> DataFrame:
    """k rows per group spread evenly over its order: positions round(i*(n-1)/(k-1)), halves to even;
    all rows when k >= n. ``k`` is a number or a column."""
    k = F.lit(k) if isinstance(k, int) else col(k)
    o = ordered(rows, by, order, split).number("_r").total({"_n": ("sum", F.lit(1).cast("long"))})
    gaps = F.greatest(k - 1, F.lit(1))
    guess = F.floor(F.col("_r") * gaps / F.greatest(F.col("_n") - 1, F.lit(1)))
    picked = F.exists(F.array(*(guess + d for d in (-1, 0, 1, 2))), lambda i: (i >= 0) & (i < k) & (
        F.rint(i * (F.col("_n") - 1) / gaps) == F.col("_r")))
    return o.where((k >= F.col("_n")) | picked).df.drop("_r", "_n")
