"""Frame, proposal, cleaning and annotation queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanlake.fixtures import Tables, seconds
from spanlake.functions import text
from spanlake.functions.rounding import round_true_sql
from spanlake.operators import calls
from spanlake.operators import clean as cl
from spanlake.operators import frames as fr
from spanlake.operators import proposals as pr
from spanlake.operators import vocabulary as vc
from spanlake.operators.layout import ordered, scratch
from spanlake.plans import annotate as an
from spanlake.plans.registry import block, query
from spanlake.sources import readers, writers

PER_SHEET, COLUMNS = 5, 5

# ---- inputs ---------------------------------------------------------------------------------------


def requests(t: Tables):
    """Even episodes have a closed vocabulary, two of three a rubric."""
    vocabulary = F.array(*map(F.lit, ("Click", "view part", "Purchase_Item", "ERROR", "signup", "Error")))
    rubric = F.array(*map(F.lit, ("retry", "Drop")))
    return t.episodes.select(
        "episode_id", F.col("instruction").alias("prompt"),
        F.when(F.col("episode_id") % 2 == 0, vocabulary).otherwise(text.empty()).alias("subtasks"),
        F.when(F.col("episode_id") % 3 != 0, rubric).otherwise(text.empty()).alias("attributes"))


def raw_segments(t: Tables):
    """Run a with overlaps, gaps, out-of-range times, foreign labels and attributes."""
    e = F.col("event_id")
    shift = (e % 5 - 2) * 400
    label = (F.when(e % 23 == 0, " No_Completed_Subtask ").when(e % 3 == 0, F.upper("label"))
             .when(e % 3 == 1, F.replace(F.col("label"), F.lit("_"), F.lit(" "))).otherwise(F.concat("label", F.lit(" item"))))
    result = F.when(e % 4 == 0, "pass").when(e % 4 == 1, " FAIL ").when(e % 4 == 2, "maybe").otherwise("unknown")
    attributes = F.when(e % 2 == 0, F.array(F.lit("Retry"), F.lit("slip"), F.lit("it's"))).otherwise(F.array(F.lit("DROP")))
    return t.pred_ms("a").select(
        "episode_id", "idx", seconds(F.col("b_ms") + shift).alias("start_s"),
        seconds(F.col("e_ms") + shift - F.when(e % 7 == 0, F.lit(300)).otherwise(F.lit(0))).alias("end_s"), label.alias("label"), result.alias("result"),
        attributes.alias("attributes"), F.lit("").alias("description"), F.lit("medium").alias("confidence"),
        text.empty().alias("flags"))


def proposals(t: Tables, relative: bool = False):
    """Run a seen through overlapping clip windows; labels repeat so that stitching has work to do."""
    e = F.col("event_id")
    label = F.element_at(F.array(F.lit("pick"), F.lit("Place"), F.lit("pick ")), (F.floor(e / 2) % 3 + 1).cast("int"))
    rows = t.pred_ms("a").select("episode_id", "idx", "event_id", seconds("b_ms").alias("start_s"),
                                 seconds("e_ms").alias("end_s"), label.alias("label"))
    windows = fr.clip_windows(t.episodes)
    seen = rows.join(windows.select("episode_id", "window_id", "lo", "hi"), "episode_id").filter(
        ((F.col("start_s") < F.col("hi")) & (F.col("end_s") > F.col("lo"))) | ((e % 31 == 0) & (F.col("window_id") == 0)))
    if relative:
        seen = seen.withColumns({c: F.round(F.col(c) * 1000 - F.col("lo") * 1000) / 1000.0 for c in ("start_s", "end_s")})
    return seen.select("episode_id", "window_id", "idx", "start_s", "end_s", "label")


def frame_episodes(t: Tables):
    return t.timed.groupBy("episode_id").agg((F.count("*") * 0.5).alias("duration_s"))


def frame_windows(t: Tables):
    grid = fr.sample_grid(frame_episodes(t))
    return grid, fr.sheet_windows(fr.sheet_spans(fr.sheets(grid, PER_SHEET, COLUMNS)))


def frame_states(t: Tables):
    """One state per event and window that saw it, off the grid by up to 0.3 s."""
    _, windows = frame_windows(t)
    e, w = F.col("event_id"), F.col("window_id")
    label = (F.when((e + w) % 6 == 0, "other").when(e % 9 == 0, "Idle").when(F.floor(F.col("idx") / 4) % 3 == 0, "pick")
             .when(F.floor(F.col("idx") / 4) % 3 == 1, "Place").otherwise("none"))
    rows = t.timed.join(windows.select("episode_id", "window_id", "first_frame", "last_frame"), "episode_id")
    rows = rows.filter((F.col("idx") >= F.col("first_frame")) & (F.col("idx") <= F.col("last_frame")))
    return rows.select("episode_id", "window_id", F.col("idx").alias("row_idx"),
                       ((F.col("idx") * 500 + (e % 7 - 3) * 100) / 1000.0).alias("t"), label.alias("subtask"))


def window_runs(t: Tables):
    """The runs as every window reports them: those that start at its frames, some under another label."""
    _, windows = frame_windows(t)
    seen = windows.select("episode_id", "window_id", F.explode(F.sequence("first_frame", "last_frame")).alias("idx"))
    label = F.when((F.col("idx") + F.col("window_id")) % 6 == 0, "other").otherwise(F.col("subtask"))
    return state_runs(t).join(seen, ["episode_id", "idx"]).select("episode_id", "window_id", "idx", "t", label.alias("subtask"))


def state_runs(t: Tables):
    """Every event starts a run at an uneven time."""
    e = F.col("event_id")
    return t.timed.select(
        "episode_id", "idx", ((F.col("idx") * 500 + (e % 5) * 130) / 1000.0).alias("t"),
        F.when(e % 3 == 0, "none").otherwise(F.col("event_type")).alias("subtask"))


def coarse(t: Tables):
    return t.pred("a").drop("run")


def pieces(t: Tables, relative: bool = False):
    """Three ragged pieces for three of four parents, in episode time or from the parent's start."""
    e = F.col("event_id")
    rows = t.pred_ms("a").filter(e % 4 != 0).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    third = F.floor((F.col("e_ms") - F.col("b_ms")) / 3)
    origin = F.lit(0).cast("long") if relative else F.col("b_ms")
    start = origin + F.col("k") * third - 300
    end = origin + (F.col("k") + 1) * third + (e % 3) * 200
    return rows.select("episode_id", F.col("idx").alias("parent_idx"), F.col("k").cast("long").alias("idx"),
                       seconds(start).alias("start_s"), seconds(end).alias("end_s"),
                       F.concat("label", F.lit("_"), F.col("k").cast("string")).alias("label"))


def choices(t: Tables, relative: bool = False):
    """An answer for nine of ten borders, up to 1.8 s off; relative ones count from the window's start."""
    e = F.col("event_id")
    at = (e % 17) * 210 - 60 if relative else F.col("e_ms") + (e % 9 - 4) * 450
    return t.pred_ms("a").filter(e % 10 != 0).select(
        "episode_id", F.col("idx").alias("boundary_idx"), seconds(at).alias("boundary_s"))


def labels(t: Tables):
    e = F.col("event_id")
    name = (F.when(e % 5 == 0, F.col("label")).when(e % 5 == 1, F.concat(F.lit("the "), "label"))
            .when(e % 5 == 2, "other thing").when(e % 5 == 3, "").otherwise(F.concat("label", F.lit("-twice"))))
    return t.pred_ms("a").filter(e % 12 != 0).select(
        "episode_id", "idx", name.alias("label"), F.when(e % 2 == 0, " PASS").otherwise("nope").alias("result"),
        F.array(F.lit("retry")).alias("attributes"), F.lit(" seen \n").alias("description"))


# ---- the same as SQL ------------------------------------------------------------------------------

def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(replace({x}, '_', ' ')), '\\s+'), lambda w: w <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / {union} ELSE 0.0 END)"


def snap_sql(x: str, vocab: str) -> str:
    best = (f"list_sort(list_transform({vocab}, lambda v, i: {{'s': {jaccard_sql(words_sql(x), words_sql('v'))}, 'r': -i, 'v': v}}), 'DESC')[1].v")
    same = f"list_filter({vocab}, lambda v: lower(v) = lower({x}))"
    return (f"(CASE WHEN len({vocab}) = 0 THEN {x} WHEN list_contains({vocab}, {x}) THEN {x} "
            f"WHEN len({same}) > 0 THEN {same}[-1] ELSE {best} END)")


STOP = "['the','a','an','to','on','in','of','up','down','and','with','at','into']"


def tokens_sql(x: str) -> str:
    raw = f"list_distinct(list_filter(string_split_regex(translate(lower({x}), '_-', '  '), '\\s+'), lambda w: w <> ''))"
    kept = f"list_filter({raw}, lambda w: NOT list_contains({STOP}, w))"
    return f"(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {raw} END)"


def clean_sql(p: str, src: str) -> str:
    """CTEs ``<p>`` (segments) and ``<p>_w`` (warnings) for cleaning table ``src``."""
    return f"""
{p}_1 AS (
  SELECT x.*, e.duration_s, r.subtasks, r.attributes AS rubric, least(greatest(x.start_s, 0), e.duration_s) AS s1,
         least(greatest(x.end_s, 0), e.duration_s) AS e1
  FROM {src} x JOIN episodes e USING (episode_id) JOIN requests r USING (episode_id)),
{p}_2 AS (
  SELECT *, {round_true_sql('s1', 2)} AS s2, {round_true_sql('e1', 2)} AS e2, s1 <> start_s OR e1 <> end_s AS moved,
         e1 - s1 < 0.15 AS short, lower({strip_sql('label')}) = 'no_completed_subtask' AS reserved,
         {snap_sql('label', 'subtasks')} AS snap,
         list_filter(attributes, lambda a: NOT list_contains(list_transform(rubric, lambda r: lower(r)), lower(a))) AS foreign_
  FROM {p}_1),
{p}_3 AS (
  SELECT *, NOT short AND NOT reserved AND len(subtasks) > 0 AND snap <> label AS snapped,
         NOT short AND NOT reserved AND len(rubric) > 0 AS checked FROM {p}_2),
{p}_4 AS (
  SELECT episode_id, idx, start_s AS o0, end_s AS o1, s2, e2, description,
    CASE WHEN reserved THEN 'no_completed_subtask' WHEN snapped THEN snap ELSE label END AS label,
    CASE WHEN reserved THEN 'fail' WHEN lower({strip_sql('result')}) IN ('pass', 'fail', 'unknown') THEN lower({strip_sql('result')}) ELSE 'unknown' END AS result,
    CASE WHEN checked THEN list_transform(list_filter(attributes, lambda a: NOT list_contains(foreign_, a)),
         lambda a: list_filter(rubric, lambda r: lower(r) = lower(a))[-1]) ELSE attributes END AS attributes,
    CASE WHEN snapped THEN 'low' ELSE confidence END AS confidence,
    CASE WHEN reserved AND NOT list_contains(flags, 'no_completed_subtask') THEN list_append(flags, 'no_completed_subtask')
         WHEN snapped THEN list_append(flags, 'label_outside_vocabulary') ELSE flags END AS flags
  FROM {p}_3 WHERE NOT short),
{p}_5 AS (SELECT *, lead(s2) OVER w AS ns, lead(label) OVER w AS nl FROM {p}_4 WINDOW w AS (PARTITION BY episode_id ORDER BY o0, o1, idx)),
{p}_6 AS (SELECT *, CASE WHEN ns < e2 THEN ns ELSE e2 END AS e3, coalesce(ns < e2, false) AS trimmed FROM {p}_5),
{p}_7 AS (
  SELECT *, lag(e3) OVER w AS pe, lead(s2) OVER w AS ns2, row_number() OVER w - 1 AS pos FROM {p}_6
  WHERE NOT (trimmed AND e3 - s2 < 0.15) WINDOW w AS (PARTITION BY episode_id ORDER BY o0, o1, idx)),
{p}_8 AS (SELECT *, (pe + s2) / 2 AS back, (e3 + ns2) / 2 AS ahead FROM {p}_7),
{p} AS (
  SELECT episode_id, pos AS idx, CASE WHEN s2 > pe THEN {round_true_sql('back', 2)} ELSE s2 END AS start_s,
         CASE WHEN ns2 > e3 THEN {round_true_sql('ahead', 2)} ELSE e3 END AS end_s, label, result, attributes, description, confidence, flags
  FROM {p}_8),
{p}_w AS (
  SELECT episode_id, 'outside the recording: ''' || label || ''' moves from ' || printf('%.2f', start_s) || '..' || printf('%.2f', end_s)
         || ' to ' || printf('%.2f', s1) || '..' || printf('%.2f', e1) AS warning FROM {p}_3 WHERE moved
  UNION ALL SELECT episode_id, 'left out: ''' || label || ''' lasts less than 0.15 s' FROM {p}_3 WHERE short
  UNION ALL SELECT episode_id, 'not in the vocabulary: ''' || label || ''', read as ''' || snap || '''' FROM {p}_3 WHERE snapped
  UNION ALL SELECT episode_id, 'the rubric does not have [' || array_to_string(list_transform(list_sort(list_distinct(foreign_)),
         lambda a: CASE WHEN contains(a, '''') THEN '"' || a || '"' ELSE '''' || a || '''' END), ', ') || ']'
    FROM {p}_3 WHERE checked AND len(foreign_) > 0
  UNION ALL SELECT episode_id, '''' || label || ''' ends ' || printf('%.2f', e2 - ns) || ' s earlier, where ''' || nl || ''' starts' FROM {p}_6 WHERE trimmed
  UNION ALL SELECT episode_id, 'nothing usable was proposed' FROM {p}_3 GROUP BY episode_id HAVING bool_and(short)
  UNION ALL SELECT episode_id, 'nothing was proposed for this episode' FROM episodes ANTI JOIN {src} USING (episode_id))"""


def fresh_sql(src: str) -> str:
    """Spans as fresh segments."""
    return (f"SELECT episode_id, idx, start_s, end_s, label, 'unknown' AS result, []::VARCHAR[] AS attributes, '' AS description, "
            f"'medium' AS confidence, []::VARCHAR[] AS flags FROM {src}")


def stitch_sql(src: str) -> str:
    """Stitching as a plain fold over the sorted list of each episode."""
    name = f"lower({strip_sql('label')})"
    one = "STRUCT(s DOUBLE, e DOUBLE, l VARCHAR, n VARCHAR)"
    item = f"{{'s': start_s, 'e': end_s, 'l': label, 'n': {name}, 'acc': []::{one}[]}}"
    dummy = f"{{'s': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'l': '', 'n': '', 'acc': []::{one}[]}}"
    last = "a.acc[len(a.acc)]"
    merged = f"{{'s': {last}.s, 'e': greatest({last}.e, x.e), 'l': {last}.l, 'n': {last}.n}}"
    step = (f"lambda a, x: {{'s': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'l': '', 'n': '', 'acc': CASE "
            f"WHEN len(a.acc) > 0 AND {last}.n = x.n AND x.s <= {last}.e + 1e-6 "
            f"THEN list_append(a.acc[1:len(a.acc)-1], {merged}) ELSE list_append(a.acc, {{'s': x.s, 'e': x.e, 'l': x.l, 'n': x.n}}) END}}")
    return f"""
  SELECT episode_id, i - 1 AS idx, acc[i].s AS start_s, acc[i].e AS end_s, acc[i].l AS label FROM (
    SELECT episode_id, acc, unnest(range(1, len(acc) + 1)) AS i FROM (
      SELECT episode_id, list_reduce(list_prepend({dummy}, list({item} ORDER BY start_s, end_s, window_id, idx)), {step}).acc AS acc
      FROM {src} WHERE n_windows > 1 GROUP BY episode_id
      UNION ALL SELECT episode_id, list({{'s': start_s, 'e': end_s, 'l': label, 'n': ''}} ORDER BY window_id, idx)
      FROM {src} WHERE n_windows = 1 GROUP BY episode_id))"""


def refine_sql(p: str, src: str, choices: str = "choices", mode: str = "sheets") -> str:
    """CTEs ``<p>`` (refined segments of ``src``) and ``<p>_n`` (notes)."""
    chosen = "CASE WHEN c >= 3 AND high - low >= 0.5 AND ans >= mn - 1e-6 AND ans <= mx + 1e-6 THEN best ELSE cand END"
    if mode == "video":
        chosen = ("CASE WHEN high - low >= 0.5 AND ans >= -1e-6 AND ans <= high - low + 1e-6 "
                  f"THEN {round_true_sql('(low + ans)', 2)} ELSE cand END")
    return f"""
{p}_b AS (
  SELECT x.*, lead(x.start_s) OVER w AS ns, lead(x.end_s) OVER w AS ne, lead(x.label) OVER w AS nl, e.duration_s
  FROM {src} x JOIN episodes e USING (episode_id) WINDOW w AS (PARTITION BY x.episode_id ORDER BY x.idx)),
{p}_c AS (
  SELECT *, (end_s + ns) / 2.0 AS cand, greatest(0, (end_s + ns) / 2.0 - 1.5) AS low, least(duration_s, (end_s + ns) / 2.0 + 1.5) AS high FROM {p}_b),
{p}_d AS (
  SELECT d.*, c.boundary_s AS ans, floor((high - low + 1e-6) / 0.25) + 1 AS n
  FROM {p}_c d LEFT JOIN {choices} c ON c.episode_id = d.episode_id AND c.boundary_idx = d.idx),
{p}_f AS (
  SELECT episode_id, idx, f, {round_true_sql('ft', 3)} AS ft FROM (
    SELECT episode_id, idx, f, low + f * 0.25 AS ft FROM {p}_d, unnest(range(n::BIGINT)) u(f) WHERE ns IS NOT NULL)),
{p}_fa AS (
  SELECT f.episode_id, f.idx, count(*) AS c, min(ft) AS mn, max(ft) AS mx, arg_min(ft, {{'g': abs(ft - ans), 'f': ft}}) AS best
  FROM {p}_f f JOIN {p}_d d ON d.episode_id = f.episode_id AND d.idx = f.idx WHERE ans IS NOT NULL GROUP BY ALL),
{p}_g AS (
  SELECT d.*, {chosen} AS t
  FROM {p}_d d LEFT JOIN {p}_fa f ON f.episode_id = d.episode_id AND f.idx = d.idx),
{p}_h AS (
  SELECT episode_id, list_reduce(list_prepend({{'t': 0.0::DOUBLE, 's': NULL::DOUBLE, 'ne': NULL::DOUBLE, 'carry': NULL::DOUBLE, 'acc': []::STRUCT(b DOUBLE, a DOUBLE, t DOUBLE)[]}},
      list({{'t': t, 's': start_s, 'ne': ne, 'carry': NULL::DOUBLE, 'acc': []::STRUCT(b DOUBLE, a DOUBLE, t DOUBLE)[]}} ORDER BY idx)),
    lambda a, x: {{'t': 0.0::DOUBLE, 's': NULL::DOUBLE, 'ne': NULL::DOUBLE,
      'carry': {round_true_sql('least(greatest(x.t, coalesce(a.carry, x.s) + 0.05), x.ne - 0.05)', 2)},
      'acc': list_append(a.acc, {{'b': a.carry, 'a': {round_true_sql('least(greatest(x.t, coalesce(a.carry, x.s) + 0.05), x.ne - 0.05)', 2)},
                                 't': least(greatest(x.t, coalesce(a.carry, x.s) + 0.05), x.ne - 0.05)}})}}).acc AS acc
  FROM (SELECT * REPLACE (CASE WHEN ne IS NULL THEN NULL ELSE t END AS t) FROM {p}_g) GROUP BY episode_id),
{p}_i AS (
  SELECT g.*, acc[idx + 1].b AS b, CASE WHEN ne IS NOT NULL THEN acc[idx + 1].a END AS a,
         CASE WHEN ne IS NOT NULL THEN abs(acc[idx + 1].t - (end_s + ns) / 2.0) END AS moved
  FROM {p}_g g JOIN {p}_h USING (episode_id)),
{p}_j AS (SELECT *, CASE WHEN moved >= 0.75 THEN 'boundary_moved_' || printf('%.2f', moved) || 's' END AS flag FROM {p}_i),
{p}_k AS (SELECT *, lag(flag) OVER (PARTITION BY episode_id ORDER BY idx) AS pf FROM {p}_j),
{p} AS (
  SELECT episode_id, idx, coalesce(b, start_s) AS start_s, coalesce(a, end_s) AS end_s, label, result, attributes, description,
         CASE WHEN flag IS NOT NULL OR pf IS NOT NULL THEN 'low' ELSE confidence END AS confidence,
         list_concat(flags, list_filter([pf, flag], lambda f: f IS NOT NULL)) AS flags FROM {p}_k),
{p}_n AS (
  SELECT episode_id, idx AS boundary_idx, 'refinement shifted ''' || label || ''' | ''' || nl || ''' by ' || printf('%.2f', moved) || 's' AS warning
  FROM {p}_j WHERE flag IS NOT NULL)"""


def label_sql(p: str, src: str) -> str:
    ta, tb = tokens_sql("s.label"), tokens_sql("a.label")
    differs = f"lower({strip_sql('s.label')}) <> lower({strip_sql('a.label')})"
    return f"""
{p}_a AS (
  SELECT s.*, a.label AS al, a.result AS ar, a.attributes AS aa, a.description AS ad, a.episode_id IS NOT NULL AS has,
         lower({strip_sql('s.label')}) = 'no_completed_subtask' AS reserved,
         CASE WHEN a.label IS NULL OR a.label = '' OR s.label = '' THEN false WHEN len(r.subtasks) > 0 OR len({ta}) = 0 OR len({tb}) = 0 THEN {differs}
              ELSE {jaccard_sql(ta, tb)} < 0.34 END AS differs
  FROM {src} s JOIN requests r USING (episode_id) LEFT JOIN labels a ON a.episode_id = s.episode_id AND a.idx = s.idx),
{p} AS (
  SELECT episode_id, idx, start_s, end_s, CASE WHEN has AND NOT reserved AND al <> '' THEN al ELSE label END AS label,
    CASE WHEN has AND reserved THEN 'fail' WHEN has THEN CASE WHEN lower({strip_sql('ar')}) IN ('pass', 'fail', 'unknown') THEN lower({strip_sql('ar')}) ELSE 'unknown' END
         ELSE result END AS result,
    CASE WHEN has THEN aa ELSE attributes END AS attributes, CASE WHEN has THEN {strip_sql('ad')} ELSE description END AS description,
    CASE WHEN has AND NOT reserved AND differs THEN 'low' ELSE confidence END AS confidence,
    CASE WHEN has AND NOT reserved AND differs THEN list_append(flags, 'label_disagreement') ELSE flags END AS flags
  FROM {p}_a)"""


def subdivide_sql(src: str, pieces: str = "pieces") -> str:
    return f"""
  SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY parent_idx, k) - 1 AS idx, start_s, end_s, label FROM (
    SELECT episode_id, parent_idx, k, greatest(s, lag(e) OVER (PARTITION BY episode_id, parent_idx ORDER BY k)) AS start_s, e AS end_s, label FROM (
      SELECT episode_id, parent_idx, k, CASE WHEN k = 0 THEN lo ELSE s END AS s, CASE WHEN k = n - 1 THEN hi ELSE e END AS e, label FROM (
        SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY episode_id, parent_idx) AS n FROM (
          SELECT p.episode_id, p.parent_idx, p.idx AS pi, p.start_s AS s0, least(greatest(p.start_s, c.start_s), c.end_s) AS s,
                 least(greatest(p.end_s, c.start_s), c.end_s) AS e, p.label, c.start_s AS lo, c.end_s AS hi
          FROM {pieces} p JOIN {src} c ON c.episode_id = p.episode_id AND c.idx = p.parent_idx
          WHERE c.end_s - c.start_s >= 3.0 AND p.end_s - p.start_s >= 0.4)
        WHERE e - s >= 0.4 WINDOW w AS (PARTITION BY episode_id, parent_idx ORDER BY s0, pi)) WHERE n >= 2)
    QUALIFY end_s - start_s >= 0.4
    UNION ALL
    SELECT episode_id, idx, 0, start_s, end_s, label FROM {src} c WHERE NOT EXISTS (
      SELECT 1 FROM {pieces} p WHERE p.episode_id = c.episode_id AND p.parent_idx = c.idx AND c.end_s - c.start_s >= 3.0 AND p.end_s - p.start_s >= 0.4
        AND least(greatest(p.end_s, c.start_s), c.end_s) - least(greatest(p.start_s, c.start_s), c.end_s) >= 0.4
      GROUP BY p.parent_idx HAVING count(*) >= 2))"""


def frames_sql(p: str, src: str) -> str:
    """CTEs from the latest state of every frame (``src``) to ``<p>state_segments``."""
    return f"""
{p}filled AS (
  SELECT g.episode_id, g.frame_idx, g.t, CASE WHEN lower({strip_sql("coalesce(subtask, 'none')")}) IN ('', 'none', 'null', 'idle', 'no subtask', 'n/a', '-')
    THEN 'none' ELSE {strip_sql("coalesce(subtask, 'none')")} END AS label
  FROM grid g LEFT JOIN {src} USING (episode_id, frame_idx)),
{p}run_ids AS (
  SELECT *, sum(brk) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM (
    SELECT *, (lag(label) OVER (PARTITION BY episode_id ORDER BY frame_idx) IS DISTINCT FROM label)::INT AS brk FROM {p}filled)),
{p}run_sizes AS (SELECT *, count(*) OVER (PARTITION BY episode_id, run) AS size, count(*) OVER (PARTITION BY episode_id) AS total FROM {p}run_ids),
{p}smoothed AS (
  SELECT episode_id, frame_idx, t, CASE WHEN total < 3 THEN label ELSE coalesce(
    last_value(CASE WHEN size >= 2 THEN label END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx),
    max(CASE WHEN frame_idx = 1 THEN label END) OVER (PARTITION BY episode_id)) END AS label FROM {p}run_sizes),
{p}low_runs AS (
  SELECT *, sum(brk) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM (
    SELECT *, lag(t) OVER w AS pt, (lag(lower(label)) OVER w IS DISTINCT FROM lower(label))::INT AS brk FROM {p}smoothed WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))),
{p}state_spans AS (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY run) - 1 AS idx FROM (
    SELECT episode_id, run, arg_min(label, frame_idx) AS label, arg_min(coalesce((pt + t) / 2.0, t), frame_idx) AS s, max(t) + 0.25 AS e
    FROM {p}low_runs GROUP BY episode_id, run) WHERE label <> 'none'),
{p}state_segments AS (
  SELECT episode_id, idx, CASE WHEN idx = 0 THEN 0.0::DOUBLE ELSE {round_true_sql('s2', 2)} END AS start_s, {round_true_sql('e', 2)} AS end_s, label
  FROM (SELECT *, greatest(s, lag({round_true_sql('e', 2)}) OVER (PARTITION BY episode_id ORDER BY idx)) AS s2 FROM {p}state_spans))"""


block(f"""
requests AS (
  SELECT episode_id, instruction AS prompt,
    CASE WHEN episode_id % 2 = 0 THEN ['Click', 'view part', 'Purchase_Item', 'ERROR', 'signup', 'Error'] ELSE []::VARCHAR[] END AS subtasks,
    CASE WHEN episode_id % 3 <> 0 THEN ['retry', 'Drop'] ELSE []::VARCHAR[] END AS attributes FROM episodes),
pred_a AS (SELECT * FROM pred_ms WHERE run = 'a'),
coarse AS (SELECT episode_id, idx, start_s, end_s, label FROM pred WHERE run = 'a'),
raw_segments AS (
  SELECT episode_id, idx, (b_ms + (event_id % 5 - 2) * 400) / 1000.0::DOUBLE AS start_s,
    (e_ms + (event_id % 5 - 2) * 400 - CASE WHEN event_id % 7 = 0 THEN 300 ELSE 0 END) / 1000.0::DOUBLE AS end_s,
    CASE WHEN event_id % 23 = 0 THEN ' No_Completed_Subtask ' WHEN event_id % 3 = 0 THEN upper(label)
         WHEN event_id % 3 = 1 THEN replace(label, '_', ' ') ELSE label || ' item' END AS label,
    CASE event_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN ' FAIL ' WHEN 2 THEN 'maybe' ELSE 'unknown' END AS result,
    CASE WHEN event_id % 2 = 0 THEN ['Retry', 'slip', 'it''s'] ELSE ['DROP'] END AS attributes,
    '' AS description, 'medium' AS confidence, []::VARCHAR[] AS flags FROM pred_a),
clips AS (
  SELECT episode_id, k AS window_id, count(*) OVER (PARTITION BY episode_id) AS n_windows, k * 55.0::DOUBLE AS lo, least(duration_s, k * 55.0::DOUBLE + 60) AS hi
  FROM episodes, unnest(range((duration_s / 55)::BIGINT + 2)) u(k) WHERE k = 0 OR (duration_s > 60 AND (k - 1) * 55.0::DOUBLE + 60 < duration_s - 1e-6)),
proposals AS (
  SELECT p.episode_id, w.window_id, p.idx, w.n_windows, w.lo, w.hi, b_ms / 1000.0::DOUBLE AS start_s, e_ms / 1000.0::DOUBLE AS end_s,
         ['pick', 'Place', 'pick '][(event_id // 2) % 3 + 1] AS label
  FROM pred_a p JOIN clips w USING (episode_id)
  WHERE (b_ms / 1000.0::DOUBLE < hi AND e_ms / 1000.0::DOUBLE > lo) OR (event_id % 31 = 0 AND window_id = 0)),
own AS (SELECT * FROM proposals WHERE n_windows = 1 OR (end_s > lo - 1e-6 AND start_s < hi + 1e-6)),
stitched AS ({stitch_sql('own')}),
clip_times AS (
  SELECT *, greatest(0, least(round(start_s * 1000 - lo * 1000) / 1000.0::DOUBLE, hi - lo)) + lo AS s,
         greatest(0, least(round(end_s * 1000 - lo * 1000) / 1000.0::DOUBLE, hi - lo)) + lo AS e FROM proposals),
placed AS (
  SELECT episode_id, window_id, idx, label, n_windows, {round_true_sql('s', 2)} AS start_s, {round_true_sql('e', 2)} AS end_s FROM clip_times WHERE e > s),
pieces AS (
  SELECT episode_id, idx AS parent_idx, k AS idx, (b_ms + k * ((e_ms - b_ms) // 3) - 300) / 1000.0::DOUBLE AS start_s,
         (b_ms + (k + 1) * ((e_ms - b_ms) // 3) + (event_id % 3) * 200) / 1000.0::DOUBLE AS end_s, label || '_' || k AS label
  FROM pred_a, unnest(range(3)) u(k) WHERE event_id % 4 <> 0),
choices AS (
  SELECT episode_id, idx AS boundary_idx, (e_ms + (event_id % 9 - 4) * 450) / 1000.0::DOUBLE AS boundary_s FROM pred_a WHERE event_id % 10 <> 0),
pieces_placed AS (
  SELECT p.episode_id, p.idx AS parent_idx, k AS idx, (k * ((e_ms - b_ms) // 3) - 300) / 1000.0::DOUBLE + b_ms / 1000.0::DOUBLE AS start_s,
         ((k + 1) * ((e_ms - b_ms) // 3) + (event_id % 3) * 200) / 1000.0::DOUBLE + b_ms / 1000.0::DOUBLE AS end_s, label || '_' || k AS label
  FROM pred_a p, unnest(range(3)) u(k) WHERE event_id % 4 <> 0),
clip_choices AS (
  SELECT episode_id, idx AS boundary_idx, ((event_id % 17) * 210 - 60) / 1000.0::DOUBLE AS boundary_s FROM pred_a WHERE event_id % 10 <> 0),
labels AS (
  SELECT episode_id, idx, CASE event_id % 5 WHEN 0 THEN label WHEN 1 THEN 'the ' || label WHEN 2 THEN 'other thing' WHEN 3 THEN '' ELSE label || '-twice' END AS label,
    CASE WHEN event_id % 2 = 0 THEN ' PASS' ELSE 'nope' END AS result, ['retry'] AS attributes, ' seen ' || chr(10) AS description
  FROM pred_a WHERE event_id % 12 <> 0),
frame_eps AS (SELECT episode_id, count(*) * 0.5::DOUBLE AS duration_s FROM timed GROUP BY episode_id),
grid AS (SELECT episode_id, k AS frame_idx, k * 0.5::DOUBLE AS t FROM frame_eps, unnest(range((duration_s / 0.5)::BIGINT + 2)) u(k) WHERE k * 0.5 <= duration_s + 1e-6),
sheet_spans AS (SELECT episode_id, frame_idx // {PER_SHEET} AS sheet_idx, min(t) AS start_s, max(t) AS end_s, count(*) AS n_frames FROM grid GROUP BY ALL),
sheet_n AS (SELECT episode_id, count(*) AS n FROM sheet_spans GROUP BY ALL),
frame_windows AS (
  SELECT w.episode_id, k AS window_id, count(*) OVER (PARTITION BY w.episode_id) AS n_windows, k * 5 AS first_sheet, least(k * 5 + 6, n) - 1 AS last_sheet,
         a.start_s AS lo, b.end_s AS hi, k * 5 * {PER_SHEET} AS first_frame, (least(k * 5 + 6, n) - 1) * {PER_SHEET} + b.n_frames - 1 AS last_frame
  FROM (SELECT episode_id, n, k FROM sheet_n, unnest(range(n // 5 + 2)) u(k) WHERE k = 0 OR (n > 6 AND (k - 1) * 5 + 6 < n)) w
  JOIN sheet_spans a ON a.episode_id = w.episode_id AND a.sheet_idx = k * 5
  JOIN sheet_spans b ON b.episode_id = w.episode_id AND b.sheet_idx = least(k * 5 + 6, n) - 1),
frame_states AS (
  SELECT t.episode_id, w.window_id, t.idx AS row_idx, (t.idx * 500 + (event_id % 7 - 3) * 100) / 1000.0::DOUBLE AS t,
    CASE WHEN (event_id + w.window_id) % 6 = 0 THEN 'other' WHEN event_id % 9 = 0 THEN 'Idle' WHEN (t.idx // 4) % 3 = 0 THEN 'pick'
         WHEN (t.idx // 4) % 3 = 1 THEN 'Place' ELSE 'none' END AS subtask, w.first_frame, w.last_frame
  FROM timed t JOIN frame_windows w ON w.episode_id = t.episode_id AND t.idx BETWEEN w.first_frame AND w.last_frame),
snapped_rows AS (
  SELECT s.episode_id, s.window_id, s.row_idx, s.subtask, g.frame_idx FROM frame_states s JOIN grid g
    ON g.episode_id = s.episode_id AND g.frame_idx BETWEEN s.first_frame AND s.last_frame AND abs(g.t - s.t) <= 0.5 * 0.51
  QUALIFY row_number() OVER (PARTITION BY s.episode_id, s.window_id, s.row_idx ORDER BY abs(g.t - s.t), g.frame_idx) = 1),
latest AS (SELECT episode_id, frame_idx, arg_max(subtask, {{'w': window_id, 'r': row_idx}}) AS subtask FROM snapped_rows GROUP BY ALL),
filled AS (
  SELECT g.episode_id, g.frame_idx, g.t, CASE WHEN lower({strip_sql("coalesce(subtask, 'none')")}) IN ('', 'none', 'null', 'idle', 'no subtask', 'n/a', '-')
    THEN 'none' ELSE {strip_sql("coalesce(subtask, 'none')")} END AS label
  FROM grid g LEFT JOIN latest USING (episode_id, frame_idx)),
run_ids AS (
  SELECT *, sum(brk) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM (
    SELECT *, (lag(label) OVER (PARTITION BY episode_id ORDER BY frame_idx) IS DISTINCT FROM label)::INT AS brk FROM filled)),
run_sizes AS (SELECT *, count(*) OVER (PARTITION BY episode_id, run) AS size, count(*) OVER (PARTITION BY episode_id) AS total FROM run_ids),
smoothed AS (
  SELECT episode_id, frame_idx, t, CASE WHEN total < 3 THEN label ELSE coalesce(
    last_value(CASE WHEN size >= 2 THEN label END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx),
    max(CASE WHEN frame_idx = 1 THEN label END) OVER (PARTITION BY episode_id)) END AS label FROM run_sizes),
low_runs AS (
  SELECT *, sum(brk) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM (
    SELECT *, lag(t) OVER w AS pt, (lag(lower(label)) OVER w IS DISTINCT FROM lower(label))::INT AS brk FROM smoothed WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))),
state_spans AS (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY run) - 1 AS idx FROM (
    SELECT episode_id, run, arg_min(label, frame_idx) AS label, arg_min(coalesce((pt + t) / 2.0, t), frame_idx) AS s, max(t) + 0.25 AS e
    FROM low_runs GROUP BY episode_id, run) WHERE label <> 'none'),
state_segments AS (
  SELECT episode_id, idx, CASE WHEN idx = 0 THEN 0.0::DOUBLE ELSE {round_true_sql('s2', 2)} END AS start_s, {round_true_sql('e', 2)} AS end_s, label
  FROM (SELECT *, greatest(s, lag({round_true_sql('e', 2)}) OVER (PARTITION BY episode_id ORDER BY idx)) AS s2 FROM state_spans)),
state_runs AS (
  SELECT episode_id, idx, (idx * 500 + (event_id % 5) * 130) / 1000.0::DOUBLE AS t, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE event_type END AS subtask
  FROM timed),
expanded AS (
  SELECT g.episode_id, g.frame_idx, g.t, coalesce((SELECT arg_max(r.subtask, {{'t': r.t, 'i': r.idx}}) FROM state_runs r
    WHERE r.episode_id = g.episode_id AND r.t <= g.t + 0.5 * 0.49), 'none') AS subtask FROM grid g),
window_runs AS (
  SELECT r.episode_id, w.window_id, r.idx, r.t, CASE WHEN (r.idx + w.window_id) % 6 = 0 THEN 'other' ELSE r.subtask END AS subtask
  FROM state_runs r JOIN frame_windows w ON w.episode_id = r.episode_id AND r.idx BETWEEN w.first_frame AND w.last_frame),
run_latest AS (
  SELECT episode_id, frame_idx, arg_max(subtask, window_id) AS subtask FROM (
    SELECT w.episode_id, w.window_id, g.frame_idx, coalesce((SELECT arg_max(r.subtask, {{'t': r.t, 'i': r.idx}}) FROM window_runs r
      WHERE r.episode_id = w.episode_id AND r.window_id = w.window_id AND r.t <= g.t + 0.5 * 0.49), 'none') AS subtask
    FROM frame_windows w JOIN grid g ON g.episode_id = w.episode_id AND g.frame_idx BETWEEN w.first_frame AND w.last_frame) GROUP BY ALL),
{frames_sql('run_', 'run_latest')}""")

# ---- frames ---------------------------------------------------------------------------------------


@query("sample_grid", """
SELECT episode_id, k AS frame_idx, k * 0.25::DOUBLE AS t FROM episodes, unnest(range((duration_s / 0.25)::BIGINT + 2)) u(k) WHERE k * 0.25 <= duration_s + 1e-6""")
def sample_grid(t: Tables):
    return fr.sample_grid(t.episodes, 0.25)


@query("frame_sheets", f"""
SELECT episode_id, frame_idx, t, frame_idx // {PER_SHEET} AS sheet_idx, (frame_idx % {PER_SHEET}) % 3 AS sheet_col,
       (frame_idx % {PER_SHEET}) // 3 AS sheet_row FROM grid""")
def frame_sheets(t: Tables):
    return fr.sheets(fr.sample_grid(frame_episodes(t)), PER_SHEET, 3)


@query("sheet_windows", "SELECT * FROM frame_windows")
def sheet_windows(t: Tables):
    return frame_windows(t)[1]


@query("clip_windows", "SELECT * FROM clips")
def clip_windows(t: Tables):
    return fr.clip_windows(t.episodes)


@query("snap_rows", "SELECT * FROM snapped_rows")
def snap_rows(t: Tables):
    return fr.snap_rows(frame_states(t), frame_windows(t)[1]).drop("t")


@query("upsert_states", "SELECT * FROM latest")
def upsert_states(t: Tables):
    return fr.upsert_states(snap_rows(t))


@query("smooth_states", "SELECT * FROM smoothed")
def smooth_states(t: Tables):
    return fr.smooth(fr.fill_grid(upsert_states(t), frame_windows(t)[0]), split=t.split)


@query("state_segments", "SELECT * FROM state_segments")
def state_segments(t: Tables):
    grid, windows = frame_windows(t)
    return pr.assemble(frame_states(t), windows, "state", grid=grid, split=t.split)


@query("expand_runs", "SELECT * FROM expanded")
def expand_runs(t: Tables):
    return fr.expand_runs(state_runs(t), frame_windows(t)[0], split=t.split)


@query("run_segments", "SELECT * FROM run_state_segments")
def run_segments(t: Tables):
    """Assembly from one row per change instead of one per frame."""
    grid, windows = frame_windows(t)
    return pr.assemble(window_runs(t), windows, "runs", grid=grid, split=t.split)


# ---- proposals ------------------------------------------------------------------------------------

@query("window_discipline", "SELECT episode_id, window_id, idx, start_s, end_s, label, n_windows FROM own")
def window_discipline(t: Tables):
    return pr.in_window(proposals(t), fr.clip_windows(t.episodes))


@query("clip_to_episode_time", "SELECT * FROM placed")
def clip_to_episode_time(t: Tables):
    return pr.to_episode_time(proposals(t, relative=True), fr.clip_windows(t.episodes))


@query("stitch_sheets", "SELECT * FROM stitched")
def stitch_sheets(t: Tables):
    return pr.assemble(proposals(t), fr.clip_windows(t.episodes), "sheets", split=t.split)


@query("stitch_video", stitch_sql("placed"))
def stitch_video(t: Tables):
    return pr.assemble(proposals(t, relative=True), fr.clip_windows(t.episodes), "video", split=t.split)


@query("previous_label", """
SELECT w.*, (SELECT arg_max(p.label, {'w': p.window_id, 'i': p.idx}) FROM own p WHERE p.episode_id = w.episode_id AND p.window_id < w.window_id) AS previous_label
FROM clips w""")
def previous_label(t: Tables):
    return pr.previous_label(fr.clip_windows(t.episodes), window_discipline(t), split=t.split)


@query("neighbour_labels", """
SELECT episode_id, idx, label, lag(label) OVER w AS previous, lead(label) OVER w AS following FROM coarse
WINDOW w AS (PARTITION BY episode_id ORDER BY idx)""")
def neighbour_labels(t: Tables):
    return pr.with_neighbours(coarse(t), split=t.split).select("episode_id", "idx", "label", "previous", "following")


@query("subdivide_windows", """
SELECT *, floor((span + 1e-6) / interval)::BIGINT + 1 AS n_frames FROM (
  SELECT *, greatest(0.25::DOUBLE, span / 168) AS interval FROM (SELECT *, end_s - start_s AS span FROM coarse) WHERE span >= 3.0)
WHERE floor((span + 1e-6) / interval) + 1 >= 4""")
def subdivide_windows(t: Tables):
    return pr.subdivide_windows(coarse(t))


@query("apply_subdivision", subdivide_sql("coarse"))
def apply_subdivision(t: Tables):
    return pr.apply_subdivision(coarse(t), pieces(t), split=t.split)


@query("subdivide_clips", subdivide_sql("coarse", "pieces_placed"))
def subdivide_clips(t: Tables):
    """Pieces timed from their parent's start."""
    return pr.apply_subdivision(coarse(t), pieces(t, relative=True), relative=True, split=t.split)


@query("refine_windows", """
SELECT episode_id, idx AS boundary_idx, cand AS candidate, low, high, high - low >= 0.5 AND floor((high - low + 1e-6) / 0.25) + 1 >= 3 AS inspect, before, after FROM (
  SELECT *, greatest(0, cand - 1.5) AS low, least(duration_s, cand + 1.5) AS high FROM (
    SELECT c.episode_id, idx, label AS before, lead(label) OVER w AS after, (end_s + lead(start_s) OVER w) / 2.0 AS cand, duration_s
    FROM coarse c JOIN episodes e ON e.episode_id = c.episode_id WINDOW w AS (PARTITION BY c.episode_id ORDER BY idx)) WHERE cand IS NOT NULL)""")
def refine_windows(t: Tables):
    return pr.refine_windows(coarse(t), t.episodes, split=t.split)


block(f"fresh AS ({fresh_sql('coarse')}),{refine_sql('refined', 'fresh')},"
      f"{refine_sql('refined_v', 'fresh', 'clip_choices', 'video')},{label_sql('labelled', 'fresh')}")


@query("apply_refinement", "SELECT * FROM refined")
def apply_refinement(t: Tables):
    return pr.apply_refinement(cl.to_segments(coarse(t)), choices(t), t.episodes, split=t.split)[0]


@query("refine_clips", "SELECT * FROM refined_v")
def refine_clips(t: Tables):
    """Borders answered in seconds from the start of the inspected clip."""
    return pr.apply_refinement(cl.to_segments(coarse(t)), choices(t, relative=True), t.episodes, mode="video", split=t.split)[0]


@query("refinement_notes", "SELECT * FROM refined_n")
def refinement_notes(t: Tables):
    return pr.apply_refinement(cl.to_segments(coarse(t)), choices(t), t.episodes, split=t.split)[1]


@query("label_windows", """
SELECT c.*, duration_s, greatest(0, start_s - 1) AS lo, least(duration_s, end_s + 1) AS hi,
       greatest(greatest(least(duration_s, end_s + 1) - greatest(0, start_s - 1), 0.5) / 20, 0.1) AS interval
FROM coarse c JOIN episodes USING (episode_id)""".replace("SELECT c.*, duration_s", "SELECT c.*, duration_s"))
def label_windows(t: Tables):
    return pr.label_windows(coarse(t), t.episodes)


@query("apply_labels", "SELECT * FROM labelled")
def apply_labels(t: Tables):
    return pr.apply_labels(cl.to_segments(coarse(t)), labels(t), requests(t))


@query("flag_unstable", """
SELECT s.episode_id, idx, start_s, end_s, label, result, attributes, description,
  CASE WHEN n1 <> n2 THEN 'low' ELSE confidence END AS confidence,
  CASE WHEN n1 <> n2 THEN list_append(flags, 'segment_count_unstable') ELSE flags END AS flags
FROM fresh s JOIN (SELECT episode_id, count(*) FILTER (run = 'a') AS n1, count(*) FILTER (run = 'b') AS n2 FROM pred GROUP BY ALL) USING (episode_id)""")
def flag_unstable(t: Tables):
    return cl.flag_unstable(cl.to_segments(coarse(t)), cl.to_segments(t.pred("b").drop("run")), split=t.split)[0]


@query("unflagged_segments", """
SELECT f.* FROM fresh f JOIN (SELECT episode_id, count(*) FILTER (run = 'a') AS n1, count(*) FILTER (run = 'b') AS n2 FROM pred GROUP BY ALL) USING (episode_id)
WHERE n1 = n2""".replace("SELECT f.*", "SELECT f.episode_id, f.idx, f.start_s, f.end_s, f.label, f.result, f.attributes, f.description, f.confidence, f.flags"))
def unflagged_segments(t: Tables):
    return cl.unflagged(flag_unstable(t))


@query("request_text", """
SELECT c.episode_id, c.window_id, 'List the completed events of this recording as start, end and label.' || chr(10) || 'Task: ' || prompt || chr(10)
  || 'This excerpt runs ' || printf('%.2f', lo) || 's to ' || printf('%.2f', hi) || 's, and all times lie within it.' || chr(10)
  || CASE WHEN len(subtasks) > 0 THEN 'Choose every label from this list:' || chr(10)
     || array_to_string(list_transform(subtasks, lambda s: '    - ' || s), chr(10)) || chr(10) || '    - no_completed_subtask'
     ELSE 'Label each event with a few words, action first.' END AS request
FROM clips c JOIN requests USING (episode_id)""")
def request_text(t: Tables):
    rows = fr.clip_windows(t.episodes).join(requests(t), "episode_id")
    return pr.render_requests(rows).select("episode_id", "window_id", "request")


@query("parse_answers", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (props->>'k')::BIGINT END AS k,
       CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 1) END AS _corrupt FROM events""")
def parse_answers(t: Tables):
    """Event properties as answers, every tenth damaged."""
    raw = t.raw("events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("answer"))
    out = pr.parse(raw, "answer", "k bigint")
    return out.select("event_id", F.when(F.col("_corrupt").isNull(), F.col("parsed.k")).alias("k"), "_corrupt")


@query("propose_batch", """
SELECT episode_id, idx, label <> 'error' AS ok, CASE WHEN label <> 'error' THEN upper(label) END AS answer,
  CASE WHEN label = 'error' THEN 'ValueError: unusable label' END AS error FROM gold""")
def propose_batch(t: Tables):
    """The batch hook with a callable that fails on some rows."""
    columns = pd.Index(["answer", "prompt_tokens"])

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        labels = rows["label"].tolist()
        if "error" in labels:
            raise ValueError("unusable label")
        # Most calls are for one row: a frame of one block takes them a third of the time of one made of columns.
        answers = [(None if label is None else label.upper(), 10) for label in labels]
        return pd.DataFrame(np.array(answers, dtype=object).reshape(-1, 2), rows.index, columns, dtype=object)
    return pr.propose(t.gold, call, ["episode_id", "idx"]).select("episode_id", "idx", "ok", "answer", "error")


@query("ledger_usage", """
SELECT came_through, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(CASE WHEN came_through THEN 10 * n ELSE 7 END) AS BIGINT) AS prompt_tokens FROM (
  SELECT label <> 'error' AS came_through, count(*) AS n FROM (SELECT DISTINCT label FROM gold) GROUP BY label) GROUP BY 1""")
def ledger_usage(t: Tables):
    """What all attempts took, in one call a label. The second run over the same requests asks only what failed, and finds that
    attempt in the ledger too."""
    def call(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > 1 or (rows["label"] == "error").any():
            failure = ValueError("unusable label" if len(rows) == 1 else "one at a time")
            failure.prompt_tokens = 7 if len(rows) == 1 else 0
            raise failure
        return pd.DataFrame({"answer": rows["label"].str.upper(), "prompt_tokens": 10})
    path = scratch(t.spark, "calls")
    asked = t.gold.select("label")
    for _ in range(2):
        pr.propose(asked, call, ["label"], ledger=path).write.format("noop").mode("overwrite").save()
    rows = calls.attempts(t.spark, path).filter("n_rows = 1")
    return rows.groupBy("came_through").agg(F.sum("n_rows").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"))


# ---- cleaning -------------------------------------------------------------------------------------

block(clean_sql("cleaned", "raw_segments"))


@query("clamp_and_drop", f"""
SELECT episode_id, idx, {round_true_sql('s1', 2)} AS start_s, {round_true_sql('e1', 2)} AS end_s FROM cleaned_3 WHERE NOT short""")
def clamp_and_drop(t: Tables):
    rows = cl.with_context(raw_segments(t), t.episodes, requests(t))
    return cl.round_times(cl.drop_short(cl.clamp(rows))).filter("kept").select("episode_id", "idx", "start_s", "end_s")


@query("closed_vocabulary", f"""
SELECT p_partkey, p_name, {snap_sql('p_name', "['Small_Ring','RED widget','blue bolt','Hot plate','hot_plate','large rod','tiny gear','green_plate x']")} AS snapped FROM part""")
def closed_vocabulary(t: Tables):
    vocabulary = F.array(*map(F.lit, ("Small_Ring", "RED widget", "blue bolt", "Hot plate", "hot_plate", "large rod", "tiny gear", "green_plate x")))
    return t.raw("part").select("p_partkey", "p_name", text.snap_to_vocabulary("p_name", vocabulary).alias("snapped"))


block("""
shared_entries AS (
  SELECT entry, row_number() OVER (ORDER BY entry) - 1 AS pos FROM (
    SELECT DISTINCT p_type || ' ' || p_name AS entry FROM part
    UNION SELECT DISTINCT p_type || ' ' || upper(p_name) || ' of_the set' FROM part WHERE p_type <> 'LARGE')),
shared_list AS (SELECT list(entry ORDER BY pos) AS entries FROM shared_entries),
shared_labels AS (
  SELECT p_partkey, 0 AS form, p_name || ' ' || lower(p_type) || ' ' || p_brand AS label FROM part
  UNION ALL SELECT p_partkey, 1, lower(p_type || ' ' || p_name) FROM part
  UNION ALL SELECT p_partkey, 2, p_type || ' ' || p_name FROM part
  UNION ALL SELECT p_partkey, 3, p_brand FROM part
  UNION ALL SELECT p_partkey, 4, 'set of_the ' || p_name || ' and one more that is not very short' FROM part)""")


@query("shared_vocabulary", f"""
SELECT l.p_partkey, l.form, d.snapped FROM shared_labels l JOIN (
  SELECT label, {snap_sql('label', 'entries')} AS snapped FROM (SELECT DISTINCT label FROM shared_labels) CROSS JOIN shared_list) d USING (label)""")
def shared_vocabulary(t: Tables):
    part = t.raw("part")
    entry = F.concat_ws(" ", "p_type", "p_name")
    entries = part.select(entry.alias("entry")).union(part.filter("p_type <> 'LARGE'").select(
        F.concat_ws(" ", "p_type", F.upper("p_name"), F.lit("of_the set")))).distinct()
    entries = ordered(entries.withColumn("_all", F.lit(0)), ["_all"], ["entry"], True).number("pos").df
    forms = (F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand"), F.lower(entry), entry, F.col("p_brand"),
             F.concat_ws(" ", F.lit("set of_the"), "p_name", F.lit("and one more that is not very short")))
    labels = part.select("p_partkey", F.posexplode(F.array(*forms)).alias("form", "label"))
    return vc.snap_shared(labels, entries).select("p_partkey", "form", "snapped")


@query("label_disagreement", f"""
SELECT a.p_partkey, {jaccard_sql(tokens_sql('a.p_name'), tokens_sql("b.p_name || ' on the-' || b.p_type"))} < 0.34 AS differs,
       lower(a.p_name) <> lower(b.p_name || ' on the-' || b.p_type) AS differs_exactly
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def label_disagreement(t: Tables):
    part = t.raw("part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" on the-"), "p_type").alias("o"))
    return part.join(other, "p_partkey").select(
        "p_partkey", text.disagrees("p_name", "o", F.lit(False)).alias("differs"),
        text.disagrees("p_name", "o", F.lit(True)).alias("differs_exactly"))


@query("list_cleaning", """
SELECT p_partkey, list_filter(list_transform(string_split(p_brand || ' ,, ' || p_name || ',' || upper(p_name), ','), lambda x: trim(x)), lambda x: x <> '') AS items,
       [p_brand, p_name] AS vocabulary FROM part""")
def list_cleaning(t: Tables):
    joined = F.concat("p_brand", F.lit(" ,, "), "p_name", F.lit(","), F.upper("p_name"))
    return t.raw("part").select("p_partkey", text.split_list(joined).alias("items"), text.clean_vocab(text.split_list(joined)).alias("vocabulary"))


@query("clean_segments", "SELECT * FROM cleaned")
def clean_segments(t: Tables):
    return cl.clean(raw_segments(t), t.episodes, requests(t), split=t.split)[0]


@query("clean_warnings", "SELECT * FROM cleaned_w")
def clean_warnings(t: Tables):
    return cl.clean(raw_segments(t), t.episodes, requests(t), split=t.split)[1].select("episode_id", "warning")


# ---- annotation -----------------------------------------------------------------------------------

def annotation_tables(t: Tables) -> an.Tables:
    half = proposals(t).filter("idx % 6 <> 5")
    return an.Tables(t.episodes, requests(t), proposals(t), fr.clip_windows(t.episodes), None, half, pieces(t), choices(t), labels(t))


block(f"""
fast_in AS ({fresh_sql('stitched')}),{clean_sql('fast', 'fast_in')},{label_sql('balanced_in', 'fast')},{clean_sql('balanced', 'balanced_in')},
strict_cut AS ({subdivide_sql('stitched')}),
half_own AS (SELECT * FROM own WHERE idx % 6 <> 5),
second AS ({stitch_sql('half_own')}),
strict_fresh AS ({fresh_sql('strict_cut')}),
strict_in AS (
  SELECT f.* REPLACE (CASE WHEN n1 <> n2 THEN 'low' ELSE confidence END AS confidence,
                      CASE WHEN n1 <> n2 THEN list_append(flags, 'segment_count_unstable') ELSE flags END AS flags)
  FROM strict_fresh f JOIN (
    SELECT episode_id, count(*) AS n1, coalesce(any_value(n), 0) AS n2 FROM strict_fresh LEFT JOIN (
      SELECT episode_id, count(*) AS n FROM second GROUP BY ALL) USING (episode_id) GROUP BY episode_id) USING (episode_id)),
{clean_sql('strict_1', 'strict_in')},{refine_sql('strict_2', 'strict_1')},{label_sql('strict_3', 'strict_2')},{clean_sql('strict_4', 'strict_3')}""")

SEGMENT = "episode_id, idx, start_s, end_s, label, result, attributes, description, confidence, flags"


@query("annotate_fast", f"SELECT {SEGMENT} FROM fast")
def annotate_fast(t: Tables):
    return an.annotate(annotation_tables(t), "fast", t.split)[0]


@query("annotate_balanced", f"SELECT {SEGMENT} FROM balanced")
def annotate_balanced(t: Tables):
    return an.annotate(annotation_tables(t), "balanced", t.split)[0]


@query("annotate_strict", f"SELECT {SEGMENT} FROM strict_4")
def annotate_strict(t: Tables):
    return an.annotate(annotation_tables(t), "strict", t.split)[0]


@query("annotate_warnings", "SELECT episode_id, warning FROM fast_w UNION ALL SELECT episode_id, warning FROM balanced_w")
def annotate_warnings(t: Tables):
    return an.annotate(annotation_tables(t), "balanced", t.split)[1].select("episode_id", "warning")


block(f"""
relabel_src AS (SELECT f.* FROM fresh f SEMI JOIN (SELECT episode_id FROM run_rows WHERE run = 'a' AND ok) USING (episode_id)),
{label_sql('relabel_in', 'relabel_src')},{clean_sql('relabelled', 'relabel_in')}""")


@query("relabel_run", f"SELECT {SEGMENT} FROM relabelled")
def relabel_run(t: Tables):
    return pr.relabel(t.pred("a"), t.run_rows, t.episodes, labels(t), "a", requests(t), t.split)[0]


# ---- renderings -----------------------------------------------------------------------------------

def responses(t: Tables):
    return t.episodes.select("episode_id", F.col("instruction").alias("task"), F.col("duration_s").alias("duration_seconds"),
                             text.empty().alias("warnings"), F.create_map(F.lit("quality"), F.lit("fast")).alias("metadata"))


@query("csv_rows", """
SELECT start_s AS start_seconds, end_s AS end_seconds, label, result, array_to_string(attributes, ';') AS attributes, confidence,
       array_to_string(flags, ';') AS flags, description FROM cleaned""")
def csv_rows(t: Tables):
    return writers.csv_rows(clean_segments(t))


@query("jsonl_rows", """
SELECT episode_id, idx, start_s AS start_seconds, label, len(attributes) AS n_attributes, flags FROM cleaned""")
def jsonl_rows(t: Tables):
    """Each line parsed back."""
    rows = writers.jsonl_rows(clean_segments(t))
    parsed = F.from_json("line", "start_seconds double, label string, attributes array<string>, flags array<string>")
    return rows.withColumn("p", parsed).select("episode_id", "idx", "p.start_seconds", "p.label", F.size("p.attributes").alias("n_attributes"), "p.flags")


@query("response_documents", """
SELECT episode_id, any_value(instruction) AS task, count(c.idx) AS n_segments, coalesce(max(c.end_s), 0) AS last_end
FROM episodes LEFT JOIN cleaned c USING (episode_id) GROUP BY episode_id""")
def response_documents(t: Tables):
    """Each document parsed back."""
    docs = writers.responses_json(clean_segments(t), responses(t))
    parsed = F.from_json("document", "task string, segments array<struct<end_seconds: double>>")
    return docs.withColumn("p", parsed).select("episode_id", "p.task", F.size("p.segments").cast("long").alias("n_segments"),
                                               F.coalesce(F.array_max("p.segments.end_seconds"), F.lit(0.0)).alias("last_end"))


@query("messages", """
SELECT episode_id, '/instruction' AS topic, 1700000000000000000 AS log_time, instruction AS text FROM episodes
UNION ALL SELECT episode_id, '/subtask_annotation', 1700000000000000000 + trunc(end_s * 1e9)::BIGINT, label FROM cleaned""")
def messages(t: Tables):
    out = writers.to_messages(clean_segments(t), responses(t), 1_700_000_000_000_000_000)
    return out.select("episode_id", "topic", "log_time", F.coalesce(
        F.get_json_object("data", "$.instruction"), F.get_json_object("data", "$.label")).alias("text"))


@query("run_file_triples", "SELECT run, episode_id, idx, start_s, end_s, label FROM pred")
def run_file_triples(t: Tables):
    """Predictions written as [start, end, label] text triples and read back."""
    triple = F.array(F.col("start_s").cast("string"), F.col("end_s").cast("string"), F.col("label"))
    rows = t.pred().groupBy("run", "episode_id").agg(F.array_sort(F.collect_list(F.struct("idx", triple.alias("t")))).alias("a"))
    return readers.spans_of(rows.select("run", "episode_id", F.col("a.t").alias("pred")), "pred")


@query("pending_episodes", "SELECT episode_id, family FROM episodes ANTI JOIN (SELECT episode_id FROM run_rows WHERE run = 'a' AND ok) USING (episode_id)")
def pending_episodes(t: Tables):
    return readers.pending(t.episodes, t.run_rows.filter("run = 'a' and ok")).select("episode_id", "family")


@query("select_family", "SELECT episode_id, family, duration_s FROM episodes WHERE family = 'fam_1' ORDER BY episode_id LIMIT 7")
def select_family(t: Tables):
    return readers.select_episodes(t.episodes, "fam_1", limit=7).select("episode_id", "family", "duration_s")
