"""Queries that normalise raw annotations; order lines play the recorded steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.fixtures import Tables
from spanlake.functions import phrases
from spanlake.functions.rounding import round_true_sql
from spanlake.operators import ingest as ing
from spanlake.operators.layout import ordered
from spanlake.plans.registry import block, query

MAX_SEC = 90.0


def lines(t: Tables):
    """Order lines with their position in the order."""
    rows = t.raw("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"),
        "l_returnflag", "l_linestatus", "l_extendedprice")
    o = ordered(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "qty"],
                t.order_split)
    return o.number("pos").df


def _frames(pos="pos"):
    start = F.col(pos) * 48
    return start, start + F.col("qty")


def simulator_raw(t: Tables):
    start, end = _frames()
    step = F.struct(F.struct(start.alias("start"), end.alias("end")).alias("timestep"),
                    F.concat(F.lit(" step "), "l_returnflag", F.lit("\n")).alias("subtask_description"))
    rows = lines(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", step.alias("s")))).alias("_a"))
    return rows.select(F.col("l_orderkey").alias("episode_id"), F.lit("tidy up").alias("high_level_instruction"),
                       F.col("_a.s").alias("steps"))


def videos(t: Tables):
    """Recordings up to four frames longer or shorter than their annotation."""
    last = lines(t).groupBy("l_orderkey").agg(F.max_by(F.col("pos") * 48 + F.col("qty"), "pos").alias("_last"))
    ratio = F.when(F.col("l_orderkey") % 2 == 0, "30/1").otherwise("30000/1001")
    rows = last.select(F.col("l_orderkey").alias("episode_id"), ing.fps_from_ratio(ratio).alias("fps"),
                       (F.col("_last") + F.col("l_orderkey") % 9 - 4).alias("n_frames"))
    return rows.withColumn("duration_s", F.col("n_frames") / F.col("fps"))


block(f"""
lines AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity::BIGINT AS qty, l_returnflag, l_linestatus,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos
  FROM lineitem),
steps AS (SELECT l_orderkey AS episode_id, pos AS idx, pos * 48 AS start_frame, pos * 48 + qty AS end_frame, 'step ' || l_returnflag AS label FROM lines),
monotonic AS (
  SELECT episode_id, idx, start_frame, end_frame, label FROM (
    SELECT *, bool_or(bad) OVER (PARTITION BY episode_id) AS any_bad FROM (
      SELECT *, end_frame <= start_frame OR coalesce(start_frame < lag(end_frame) OVER (PARTITION BY episode_id ORDER BY idx), false) AS bad FROM steps))
  WHERE NOT any_bad),
last_frames AS (SELECT episode_id, arg_max(end_frame, idx) AS last_end FROM steps GROUP BY ALL),
videos AS (
  SELECT *, n_frames / fps AS duration_s FROM (
    SELECT episode_id, CASE WHEN episode_id % 2 = 0 THEN 30.0::DOUBLE ELSE 30000.0::DOUBLE / 1001.0::DOUBLE END AS fps,
           last_end + episode_id % 9 - 4 AS n_frames, last_end FROM last_frames)),
in_seconds AS (
  SELECT episode_id, idx, {round_true_sql('s', 3)} AS start_s, {round_true_sql('e', 3)} AS end_s, label,
    CASE WHEN last_end > n_frames + 2 THEN '; steps run ' || (last_end - n_frames) || ' frames past the end and are cut to it'
         WHEN n_frames - last_end > 2 THEN '; no step in the last ' || (n_frames - last_end) || ' frames' ELSE '' END AS note
  FROM (SELECT m.*, n_frames, last_end, least(start_frame / fps, duration_s) AS s, least(end_frame / fps, duration_s) AS e
        FROM monotonic m JOIN videos USING (episode_id)))""")


@query("simulator_steps", "SELECT * FROM steps")
def simulator_steps(t: Tables):
    return ing.steps_from_frames(simulator_raw(t))


@query("monotonic_episodes", "SELECT * FROM monotonic")
def monotonic_episodes(t: Tables):
    return ing.drop_non_monotonic(simulator_steps(t), split=t.order_split)


@query("frames_to_segments", "SELECT * FROM in_seconds WHERE end_s > start_s")
def frames_to_segments(t: Tables):
    return ing.to_seconds(monotonic_episodes(t), videos(t))


@query("strict_frames", f"""
SELECT m.episode_id, idx, {round_true_sql('s', 3)} AS start_s, {round_true_sql('e', 3)} AS end_s, label,
  CASE WHEN abs(n_frames - last_end) > 2 THEN '; the recording is ' || printf('%+d', n_frames - last_end) || ' frames off the last step, times are cut to it' ELSE '' END AS note
FROM (SELECT m.*, n_frames, last_end, least(start_frame / fps, duration_s) AS s, least(end_frame / fps, duration_s) AS e
      FROM monotonic m JOIN videos USING (episode_id)) m WHERE e > s""")
def strict_frames(t: Tables):
    """One note for a difference in either direction."""
    return ing.to_seconds(monotonic_episodes(t), videos(t), trailing=False)


# ---- instruction tracks ---------------------------------------------------------------------------

def order_numbers(t: Tables):
    o = ordered(t.raw("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])
    return o.number("no").df


def track_raw(t: Tables):
    """One archive per customer, one episode per order, one segment per line."""
    p = F.col("l_partkey")
    start, end = _frames()
    segment = F.struct(
        F.when(F.col("l_linenumber") % 3 == 0, "Subtask").otherwise("default").alias("track"),
        F.when(p % 11 == 0, "  ").otherwise(F.concat(F.lit(" move part "), (p % 5).cast("string"))).alias("instruction"),
        F.col("l_linestatus").alias("skill"), start.alias("start_frame_index"), end.alias("end_frame_index"))
    episodes = lines(t).groupBy("l_orderkey").agg(F.collect_list(F.struct("pos", segment.alias("s"))).alias("_a"))
    rows = episodes.join(order_numbers(t), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("_no", F.col("no").cast("string"))
    segments = F.sort_array("_a")["s"]
    h5 = F.concat(F.lit("/data/"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("/proprio_stats.h5"))
    raw = rows.groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct("_no", segments.alias("v")))).alias("instruction_segments"),
        F.map_from_entries(F.collect_list(F.when(F.col("l_orderkey") % 2 == 0, F.struct("_no", h5.alias("v"))))).alias("h5_path"))
    return raw.withColumn("archive", F.concat(F.lit("x/task_"), (F.col("o_custkey") % 50).cast("string"), F.lit("/chunk_"),
                                              F.col("o_custkey").cast("string"), F.lit(".tar.gz")))


block("""
order_no AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS no FROM orders),
track_rows AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'task' || (o_custkey % 50) || '_' || l_orderkey
              ELSE 'task' || (o_custkey % 50) || '_chunk_' || o_custkey || '_' || lpad(no::VARCHAR, greatest(3, length(no::VARCHAR))::INT, '0') END AS episode_id,
         no AS episode_no, pos, CASE WHEN l_linenumber % 3 = 0 THEN 'Subtask' ELSE 'default' END AS track,
         CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'move part ' || (l_partkey % 5) END AS label, l_linestatus AS skill,
         pos * 48 AS start_frame, pos * 48 + qty AS end_frame
  FROM lines JOIN order_no ON l_orderkey = o_orderkey),
coarse_text AS (
  SELECT episode_id, string_agg(label, ' ' ORDER BY first_at) AS instruction FROM (
    SELECT episode_id, label, min({'f': start_frame, 'p': pos}) AS first_at FROM track_rows WHERE track = 'Subtask' AND label <> '' GROUP BY ALL) GROUP BY episode_id)""")


@query("track_steps", """
SELECT episode_id, episode_no, row_number() OVER (PARTITION BY episode_id ORDER BY start_frame, end_frame, pos) - 1 AS idx, start_frame, end_frame, label, skill
FROM track_rows WHERE track = 'default' AND label <> ''""")
def track_steps(t: Tables):
    return ing.steps_from_tracks(track_raw(t), t.order_split)


def task_tables(t: Tables):
    tasks = t.raw("nation").filter("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("task_index"), F.col("n_name").alias("task"))
    episodes = t.raw("supplier").filter("s_suppkey % 3 <> 0").select(
        F.col("s_suppkey").cast("long").alias("episode_index"), (F.col("s_suppkey") % 30).cast("long").alias("task_index"),
        F.lit(100).cast("long").alias("length"))
    return tasks, episodes


@query("track_instructions", """
SELECT DISTINCT r.episode_id, coalesce(c.instruction, coalesce(n_name, 'NATION_1')) AS instruction, coalesce(n_name, 'NATION_1') AS task_name
FROM (SELECT DISTINCT episode_id, episode_no FROM track_rows) r LEFT JOIN coarse_text c USING (episode_id)
LEFT JOIN supplier s ON s.s_suppkey = r.episode_no AND s.s_suppkey % 3 <> 0
LEFT JOIN nation n ON n.n_nationkey = coalesce(s.s_suppkey % 30, 0) AND n.n_nationkey > 0""")
def track_instructions(t: Tables):
    return ing.track_instructions(track_raw(t), *task_tables(t))


# ---- skills ---------------------------------------------------------------------------------------

SKILLS = ("pick up from", "place on next to", "open door", "pour", "hand over", "move to", "chop", "hang")
THINGS = ("radio_89", "coffee_table_koagbh_0", "bowl_73", "left", "right", "half_onion_75_0")


def skill_raw(t: Tables):
    p = F.col("l_partkey")
    start, end = _frames()

    def pick(values, n):
        return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))

    objects = F.slice(F.array(pick(THINGS, p), pick(THINGS, F.floor(p / 7)), pick(THINGS, F.floor(p / 31))), F.lit(1), (p % 3 + 1).cast("int"))
    skill = F.struct(
        F.array(start, end).alias("frame_duration"), F.array(pick(SKILLS, p)).alias("skill_description"), F.array(objects).alias("object_id"),
        F.when(p % 4 == 0, F.array(F.lit("back"))).otherwise(F.array().cast("array<string>")).alias("memory_prefix"),
        F.when(p % 5 == 0, F.array(F.lit(""), F.lit("right"))).otherwise(F.array().cast("array<string>")).alias("spatial_prefix"),
        F.array(pick(THINGS, p)).alias("manipulating_object_id"))
    rows = lines(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", skill.alias("s")))).alias("_a"))
    return rows.select(F.col("l_orderkey").alias("episode_id"), F.col("_a.s").alias("skill_annotation"))


_WORDS = "|".join(phrases.PREPOSITIONS)
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

SKILL_SQL = f"""
SELECT episode_id, idx, start_frame, end_frame,
       CASE WHEN len(names) > 1 AND verb IN ({', '.join(f"'{v}'" for v in phrases.TOOL_VERBS)}) THEN concat_ws(' ', verb, array_to_string(names[2:], ' and '), 'with', names[1])
            WHEN text = 'hand over' AND len(names) = 3 AND names[2] IN ('left', 'right') AND names[3] IN ('left', 'right')
              THEN 'hand over ' || names[1] || ' from ' || names[2] || ' hand to ' || names[3] || ' hand'
            ELSE concat_ws(' ', CASE
              WHEN len(names) > 1 THEN concat_ws(' ', verb, names[1], CASE WHEN back THEN 'back' END)
              WHEN len(links) > 0 THEN concat_ws(' ', verb, CASE WHEN back THEN 'back' END, array_to_string(links, ' '), names[1])
              WHEN last_word IN ({', '.join(f"'{v}'" for v in phrases.TRAILING_NOUNS)}) THEN concat_ws(' ', regexp_replace(verb, '\\s\\S+$', ''), names[1], CASE WHEN back THEN 'back' END, last_word)
              ELSE concat_ws(' ', text, names[1], CASE WHEN back THEN 'back' END) END,
              CASE WHEN len(names) > 1 THEN concat_ws(' ', CASE WHEN placed THEN 'to the right of' ELSE usual[1] END, names[2]) END,
              CASE WHEN len(names) > 2 THEN concat_ws(' ', usual[least(2, len(usual))], names[3]) END) END AS label
FROM (
  SELECT *, regexp_extract(verb, '\\s(\\S+)$', 1) AS last_word,
         CASE WHEN len(links) > 0 THEN links {' '.join(f"WHEN verb = '{v}' THEN {_LIST(x)}" for v, x in phrases.DEFAULT_PREPOSITIONS.items())} ELSE ['and'] END AS usual
  FROM (
    SELECT *, CASE WHEN regexp_matches(text, '^.+?(\\s+({_WORDS}))+$') THEN trim(regexp_extract(text, '^(.+?)((\\s+({_WORDS}))+)$', 1)) ELSE text END AS verb,
           regexp_extract_all(regexp_extract(text, '^(.+?)((\\s+({_WORDS}))+)$', 2), '\\s+({_WORDS})', 1) AS links,
           list_transform(objects, lambda o: replace(regexp_replace(regexp_replace(o, '(_\\d+)+$', ''), '(.)_[a-z]{{6}}$', '\\1'), '_', ' ')) AS names
    FROM (
      SELECT l_orderkey AS episode_id, pos AS idx, pos * 48 AS start_frame, pos * 48 + qty AS end_frame, ({_LIST(SKILLS)})[l_partkey % {len(SKILLS)} + 1] AS text,
             ([t[l_partkey % 6 + 1], t[l_partkey // 7 % 6 + 1], t[l_partkey // 31 % 6 + 1]])[1:l_partkey % 3 + 1] AS objects,
             l_partkey % 4 = 0 AS back, l_partkey % 5 = 0 AS placed
      FROM lines, (SELECT {_LIST(THINGS)} AS t))))"""


@query("skill_steps", SKILL_SQL)
def skill_steps(t: Tables):
    return ing.steps_from_skills(skill_raw(t))


# ---- coarse/fine sessions -------------------------------------------------------------------------

def _session_parts(t: Tables):
    """Every line is a coarse action with two ragged fine actions inside and around it: (l_orderkey, x)."""
    p, q = F.col("l_partkey"), F.col("qty")
    s10 = (F.col("pos") * 30 + p % 7) * 10
    sentence = F.concat(F.lit("do "), (p % 9).cast("string"))
    verb = F.when(p % 13 == 0, "none").otherwise(F.concat(F.lit("turn "), (p % 4).cast("string")))
    noun = F.when(p % 13 == 0, "").otherwise(F.lit(" big  knob"))

    def event(k, s, e):
        return F.struct("pos", F.lit(k).alias("k"), (s / 10.0).alias("s"), (e / 10.0).alias("e"),
                        sentence.alias("a"), verb.alias("v"), noun.alias("n"))

    events = F.array(event(0, s10, s10 + q * 10), event(1, s10 - 5, s10 + q * 5), event(2, s10 + q * 4, s10 + q * 9 + (p % 3) * 20))
    return lines(t).select("l_orderkey", F.explode(events).alias("x"))


def _fine(x):
    return F.create_map(F.lit("Verb"), x["v"], F.lit("Adjective"), F.lit(" None "), F.lit("Noun"), x["n"])


def session_raw(t: Tables):
    """The sessions as their layout nests them."""
    raw = _session_parts(t).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("_a"))

    def shape(x):
        coarse, fine = x["k"] == 0, _fine(x)
        return F.struct(F.when(coarse, ing.COARSE).otherwise(ing.FINE).alias("label"), x["s"].alias("start"), x["e"].alias("end"),
                        F.when(coarse, F.create_map(F.lit("Action sentence"), x["a"])).otherwise(fine).alias("attributes"))

    return raw.select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("video_name"), F.lit("assembly").alias("taskType"),
                      F.transform("_a", shape).alias("events"))


FIXED = "CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 'turn ' || (l_partkey % 4) || ' big knob' END"
block(f"""
session_events AS (
  SELECT 's' || l_orderkey AS session, pos * 3 AS idx, 'coarse' AS kind, (pos * 300 + l_partkey % 7 * 10) / 10.0::DOUBLE AS start_s,
         (pos * 300 + l_partkey % 7 * 10 + qty * 10) / 10.0::DOUBLE AS end_s, 'do ' || (l_partkey % 9) AS text FROM lines
  UNION ALL SELECT 's' || l_orderkey, pos * 3 + 1, 'fine', (pos * 300 + l_partkey % 7 * 10 - 5) / 10.0::DOUBLE,
         (pos * 300 + l_partkey % 7 * 10 + qty * 5) / 10.0::DOUBLE, {FIXED} FROM lines
  UNION ALL SELECT 's' || l_orderkey, pos * 3 + 2, 'fine', (pos * 300 + l_partkey % 7 * 10 + qty * 4) / 10.0::DOUBLE,
         (pos * 300 + l_partkey % 7 * 10 + qty * 9 + (l_partkey % 3) * 20) / 10.0::DOUBLE, {FIXED} FROM lines),
eligible AS (SELECT * FROM session_events SEMI JOIN (SELECT session FROM session_events GROUP BY ALL
  HAVING count(*) FILTER (kind = 'fine') >= 3 AND count(*) FILTER (kind = 'coarse') >= 1) USING (session)),
coarse_lists AS (
  SELECT session, list_reduce(list_prepend({{'s': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'i': -1::BIGINT, 'cs': NULL::DOUBLE, 'n': -1::BIGINT, 'acc': []::STRUCT(i BIGINT, n BIGINT)[]}},
      list({{'s': start_s, 'e': end_s, 'i': idx, 'cs': NULL::DOUBLE, 'n': 0::BIGINT, 'acc': []::STRUCT(i BIGINT, n BIGINT)[]}} ORDER BY start_s, idx)),
    lambda a, x: {{'s': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'i': -1::BIGINT,
      'cs': CASE WHEN a.cs IS NULL OR x.e - a.cs > {MAX_SEC} THEN x.s ELSE a.cs END,
      'n': CASE WHEN a.cs IS NULL OR x.e - a.cs > {MAX_SEC} THEN a.n + 1 ELSE a.n END,
      'acc': list_append(a.acc, {{'i': x.i, 'n': CASE WHEN a.cs IS NULL OR x.e - a.cs > {MAX_SEC} THEN a.n + 1 ELSE a.n END}})}}).acc AS acc
  FROM eligible WHERE kind = 'coarse' GROUP BY session),
chunked AS (SELECT e.*, u.n AS chunk FROM eligible e JOIN (SELECT session, unnest(acc) AS u FROM coarse_lists) x ON x.session = e.session AND u.i = e.idx WHERE kind = 'coarse'),
chunks AS (
  SELECT session, chunk, min(start_s) AS cs, arg_max(end_s, {{'s': start_s, 'i': idx}}) AS ce, string_agg(text, ' ' ORDER BY start_s, idx) AS instruction
  FROM chunked GROUP BY ALL HAVING arg_max(end_s, {{'s': start_s, 'i': idx}}) - min(start_s) >= 2),
assigned AS (
  SELECT f.session, chunk, f.idx, f.start_s AS f0, f.end_s AS f1, f.text, cs, ce, greatest(f.start_s, cs) AS s, least(f.end_s, ce) AS t
  FROM eligible f JOIN chunks c ON c.session = f.session AND (f.start_s + f.end_s) / 2 BETWEEN cs AND ce
  WHERE f.kind = 'fine' AND least(f.end_s, ce) > greatest(f.start_s, cs)),
fine_lists AS (
  SELECT session, chunk, any_value(cs) AS cs, list_reduce(list_prepend({{'s': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'x': '', 'p': 0.0::DOUBLE, 'acc': []::STRUCT(s DOUBLE, t DOUBLE, x VARCHAR)[]}},
      list({{'s': s, 't': t, 'x': text, 'p': 0.0::DOUBLE, 'acc': []::STRUCT(s DOUBLE, t DOUBLE, x VARCHAR)[]}} ORDER BY f0, f1, idx)),
    lambda a, x: CASE WHEN x.s < a.p AND x.t - a.p <= 0.05 THEN a
      ELSE {{'s': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'x': '', 'p': x.t, 'acc': list_append(a.acc, {{'s': greatest(x.s, a.p), 't': x.t, 'x': x.x}})}} END).acc AS acc
  FROM assigned WHERE text <> '' GROUP BY ALL),
session_gold AS (
  SELECT session || '_' || lpad(chunk::VARCHAR, greatest(2, length(chunk::VARCHAR))::INT, '0') AS episode_id, i - 1 AS idx,
         {round_true_sql('s', 3)} AS start_s, {round_true_sql('e', 3)} AS end_s, label
  FROM (SELECT session, chunk, i, acc[i].s - cs AS s, acc[i].t - cs AS e, acc[i].x AS label
        FROM (SELECT *, unnest(range(1, len(acc) + 1)) AS i FROM fine_lists)))""")


def session_flat(t: Tables):
    """The same sessions as flat events, so that no session is ever one row."""
    x = F.col("x")
    coarse = x["k"] == 0
    return _session_parts(t).select(
        F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("session"), F.lit("assembly").alias("task_type"),
        (x["pos"] * 3 + x["k"]).cast("long").alias("idx"), F.when(coarse, "coarse").otherwise("fine").alias("kind"),
        x["s"].alias("start_s"), x["e"].alias("end_s"), F.when(coarse, x["a"]).otherwise(ing.fine_text(_fine(x))).alias("text"))


@query("session_events", "SELECT *, 'assembly' AS task_type FROM session_events")
def session_events(t: Tables):
    return ing.session_events(session_raw(t))


@query("eligible_sessions", "SELECT *, 'assembly' AS task_type FROM eligible")
def eligible_sessions(t: Tables):
    return ing.eligible_sessions(session_flat(t), split=t.order_split)


@query("session_chunks", "SELECT * FROM chunks")
def session_chunks(t: Tables):
    coarse = eligible_sessions(t).filter("kind = 'coarse'")
    return ing.chunk_bounds(ing.chunk_sessions(coarse, MAX_SEC, t.order_split)).filter(F.col("ce") - F.col("cs") >= ing.MIN_CHUNK)


@query("fine_assignment", "SELECT * FROM assigned")
def fine_assignment(t: Tables):
    return ing.assign_to_chunks(eligible_sessions(t).filter("kind = 'fine'"), session_chunks(t).drop("instruction"), t.order_split)


@query("session_segments", "SELECT * FROM session_gold")
def session_segments(t: Tables):
    return ing.session_steps(session_flat(t), max_sec=MAX_SEC, split=t.order_split)[1]


@query("session_episodes", """
SELECT DISTINCT g.episode_id, instruction, ce - cs AS duration_s, session, chunk, cs, ce
FROM chunks JOIN (SELECT DISTINCT episode_id FROM session_gold) g
  ON g.episode_id = session || '_' || lpad(chunk::VARCHAR, greatest(2, length(chunk::VARCHAR))::INT, '0')""")
def session_episodes(t: Tables):
    return ing.steps_from_events(session_raw(t), max_sec=MAX_SEC, split=t.order_split)[0]


# ---- selection ------------------------------------------------------------------------------------

@query("gold_vocabulary", """
SELECT episode_id, list(label ORDER BY idx) AS subtasks FROM (
  SELECT episode_id, arg_min(label, idx) AS label, min(idx) AS idx FROM (
    SELECT episode_id, idx, CASE WHEN idx % 3 = 0 THEN upper(label) ELSE label END AS label FROM gold) GROUP BY episode_id, lower(label)) GROUP BY episode_id""")
def gold_vocabulary(t: Tables):
    mixed = F.when(F.col("idx") % 3 == 0, F.upper("label")).otherwise(F.col("label"))
    return ing.gold_vocabulary(t.gold.withColumn("label", mixed))


@query("first_per_task", """
SELECT o_orderkey, task_index FROM (
  SELECT o_orderkey, o_custkey % 25 AS task_index, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS k FROM orders)
WHERE k <= 8 ORDER BY task_index, o_orderkey LIMIT 190""")
def first_per_task(t: Tables):
    rows = t.raw("orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("task_index"))
    return ing.first_per_task(rows, 190, 25, ["o_orderkey"])


def _cases(t: Tables):
    return t.raw("customer").select(F.concat(F.lit("case"), F.col("c_custkey").cast("string")).alias("case_id"),
                                    F.concat(F.lit("scene_"), (F.col("c_nationkey") % 3).cast("string")).alias("scene"))


@query("spread_sample", """
SELECT case_id, scene FROM (
  SELECT case_id, scene, row_number() OVER (PARTITION BY scene ORDER BY no) - 1 AS r, count(*) OVER (PARTITION BY scene) AS n FROM (
    SELECT 'case' || c_custkey AS case_id, 'scene_' || (c_nationkey % 3) AS scene, c_custkey AS no FROM customer))
WHERE r IN (SELECT round_even(i * (n - 1)::DOUBLE / 12, 0) FROM range(13) u(i))""")
def spread_sample(t: Tables):
    return ing.spread(_cases(t), 13, ["scene"], ing.natural_order("case_id"))


@query("quota_sample", """
SELECT scene, k::INT AS k FROM (SELECT scene, 40 // 3 + (CASE WHEN row_number() OVER (ORDER BY scene) - 1 < 40 % 3 THEN 1 ELSE 0 END) AS k
  FROM (SELECT DISTINCT 'scene_' || (c_nationkey % 3) AS scene FROM customer))""")
def quota_sample(t: Tables):
    return ing.quota(_cases(t).select("scene").distinct(), 40, "scene")


@query("natural_order", "SELECT 'case' || c_custkey AS case_id, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
def natural_order(t: Tables):
    prefix, number = ing.natural_order("case_id")
    rows = _cases(t).select("case_id", prefix.alias("prefix"), number.alias("number"), F.lit(0).alias("all_rows"))
    # One group of all rows: always numbered in ranges.
    return ordered(rows, ["all_rows"], ["prefix", "number", "case_id"], True).number("position").df.select("case_id", "position")


@query("id_rules", """
SELECT o_orderkey, split_part('fam' || (o_custkey % 4) || '_' || o_orderkey, '_', 1) AS family,
       CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 3 = 1 THEN 30000.0::DOUBLE / 1001 ELSE 25.0::DOUBLE END AS fps FROM orders""")
def id_rules(t: Tables):
    ratio = F.when(F.col("o_orderkey") % 3 == 0, "30/0").when(F.col("o_orderkey") % 3 == 1, "30000/1001").otherwise("25/1")
    ids = F.concat(F.lit("fam"), (F.col("o_custkey") % 4).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"))
    return t.raw("orders").select("o_orderkey", ing.family_from_id(ids).alias("family"), ing.fps_from_ratio(ratio).alias("fps"))
