"""Scoring, error, judging, statistics and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.fixtures import Tables
from spanlake.functions import intervals as iv
from spanlake.operators import errors as er
from spanlake.operators import judging as jd
from spanlake.operators import report as rp
from spanlake.operators import scoring as sc
from spanlake.operators import stats as st
from spanlake.operators.layout import durable
from spanlake.operators.scoring import BUCKETS, COUNT_COLUMNS, tag
from spanlake.plans.registry import block, cov_sql, f1_sql, greedy_sql, iou_sql, query, ratio_sql
from spanlake.functions.rounding import round_true_sql
from spanlake.schema import BOOTSTRAP, IOU_THRESHOLDS, SEED, TAXONOMY, TOLERANCES
from spanlake.streaming.scoring import running_report

IOU = iou_sql("p.start_s", "p.end_s", "g.start_s", "g.end_s")

block(f"""
gold_run AS (SELECT r.run, g.* FROM gold g, (VALUES ('a'), ('b')) r(run)),
pairs AS (
  SELECT p.run, p.episode_id, p.idx AS p_idx, g.idx AS g_idx, {IOU} AS iou,
         p.start_s AS p0, p.end_s AS p1, g.start_s AS g0, g.end_s AS g1
  FROM pred p JOIN gold g ON p.episode_id = g.episode_id AND p.start_s < g.end_s AND g.start_s < p.end_s),
pairs_01 AS (SELECT * FROM pairs WHERE iou >= 0.1),
matches AS ({greedy_sql('pairs_01')}),
ends AS (SELECT episode_id, arg_min(start_s, idx) AS g0, arg_max(end_s, idx) AS g1 FROM gold GROUP BY ALL),
edge AS (SELECT run, episode_id, min(idx) AS i0, max(idx) AS i1 FROM pred GROUP BY ALL),
snapped_start AS (
  SELECT p.run, p.episode_id, p.idx, CASE WHEN p.idx = i0 THEN least(coalesce(g0, p.start_s), p.end_s) ELSE p.start_s END AS start_s,
         p.end_s, i1, g1
  FROM pred p JOIN edge USING (run, episode_id) LEFT JOIN ends USING (episode_id)),
snapped AS (
  SELECT run, episode_id, idx, start_s, CASE WHEN idx = i1 THEN greatest(coalesce(g1, end_s), start_s) ELSE end_s END AS end_s
  FROM snapped_start),
snapped_pairs AS (
  SELECT * FROM (SELECT p.run, p.episode_id, p.idx AS p_idx, g.idx AS g_idx, {IOU} AS iou
    FROM snapped p JOIN gold g ON p.episode_id = g.episode_id AND p.start_s < g.end_s AND g.start_s < p.end_s)
  WHERE iou >= 0.75),
snapped_matches AS ({greedy_sql('snapped_pairs')}),
sided AS (
  SELECT run, episode_id, 0 AS side, idx, start_s, end_s FROM pred
  UNION ALL SELECT run, episode_id, 1, idx, start_s, end_s FROM gold_run),
mids AS (
  SELECT run, episode_id, side, idx, (end_s + n0) / 2.0 AS t FROM (
    SELECT *, lead(start_s) OVER (PARTITION BY run, episode_id, side ORDER BY idx) AS n0 FROM sided)
  WHERE n0 IS NOT NULL),
folded AS (
  SELECT run, episode_id, side, list_reduce(
    list_prepend({{'i': -1::BIGINT, 't': 0.0::DOUBLE, 'kept': []::STRUCT(i BIGINT, t DOUBLE)[]}},
                 list({{'i': idx, 't': t, 'kept': []::STRUCT(i BIGINT, t DOUBLE)[]}} ORDER BY idx)),
    lambda a, x: {{'i': -1::BIGINT, 't': 0.0::DOUBLE, 'kept': CASE WHEN len(a.kept) > 0 AND abs(x.t - a.kept[-1].t) <= 1e-6 THEN a.kept
                                                          ELSE list_append(a.kept, {{'i': x.i, 't': x.t}}) END}}).kept AS kept
  FROM mids GROUP BY ALL),
bounds AS (SELECT run, episode_id, side, k.i AS b_idx, k.t AS t FROM (SELECT run, episode_id, side, unnest(kept) AS k FROM folded)),
errors AS (
  SELECT b.run, b.episode_id, b.side, b.b_idx, b.t, min(abs(b.t - o.t)) AS err
  FROM bounds b LEFT JOIN bounds o ON b.run = o.run AND b.episode_id = o.episode_id AND b.side <> o.side
  GROUP BY ALL)""")


@query("span_arithmetic", f"""
SELECT run, episode_id, p_idx, g_idx, iou, {cov_sql('p0', 'p1', 'g0', 'g1')} AS coverage,
       p1 - p0 AS p_len, g1 - g0 AS g_len FROM pairs""")
def span_arithmetic(t: Tables):
    pairs = sc.overlaps(t.pred(), t.gold_of(), split=t.split)
    return pairs.select("run", "episode_id", "p_idx", "g_idx", "iou", iv.coverage("p0", "p1", "g0", "g1").alias("coverage"),
                        iv.duration("p0", "p1").alias("p_len"), iv.duration("g0", "g1").alias("g_len"))


BUCKET_SQL = ("CASE WHEN end_s-start_s < 1 THEN '0-1' WHEN end_s-start_s < 2 THEN '1-2' WHEN end_s-start_s < 4 THEN '2-4' "
              "WHEN end_s-start_s < 8 THEN '4-8' ELSE '8-inf' END")
TAX_SQL = ("CASE WHEN end_s-start_s < 2 THEN '<2s' WHEN end_s-start_s < 4 THEN '2-4s' WHEN end_s-start_s < 8 THEN '4-8s' "
           "ELSE '8s+' END")


@query("duration_buckets", f"""
SELECT bucket, taxonomy_bucket, count(*) AS n FROM (
  SELECT {BUCKET_SQL} AS bucket, {TAX_SQL} AS taxonomy_bucket FROM gold) GROUP BY ALL""")
def duration_buckets(t: Tables):
    return t.gold.groupBy(iv.duration_bucket(iv.duration()).alias("bucket"),
                          iv.taxonomy_bucket(iv.duration()).alias("taxonomy_bucket")).agg(F.count("*").alias("n"))


@query("iou_candidates", "SELECT run, episode_id, p_idx, g_idx, iou FROM pairs_01")
def iou_candidates(t: Tables):
    return sc.candidates(t.pred(), t.gold_of(), 0.1, split=t.split).select("run", "episode_id", "p_idx", "g_idx", "iou")


@query("match_disjoint", "SELECT run, episode_id, p_idx, g_idx, iou FROM pairs WHERE iou >= 0.75")
def match_disjoint(t: Tables):
    return sc.match(t.pred(), t.gold_of(), 0.75, assume_disjoint=True, split=t.split).select(
        "run", "episode_id", "p_idx", "g_idx", "iou")


@query("greedy_match", f"""
SELECT run, episode_id, p_idx, g_idx, iou FROM ({greedy_sql('(SELECT * FROM pairs WHERE iou >= 0.25)')})""")
def greedy_match(t: Tables):
    return sc.match(t.pred(), t.gold_of(), 0.25, split=t.split).select("run", "episode_id", "p_idx", "g_idx", "iou")


@query("match_thresholds", """
SELECT m.run, m.episode_id, t.threshold, count(*) AS matched, sum(p_idx) AS p_sum, sum(g_idx) AS g_sum
FROM matches m, (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(threshold)
WHERE iou >= threshold GROUP BY ALL""")
def match_thresholds(t: Tables):
    pairs = sc.candidates(t.pred(), t.gold_of(), 0.1, split=t.split)
    return sc.match_all(pairs, split=t.split).groupBy("run", "episode_id", "threshold").agg(
        F.count("*").alias("matched"), F.sum("p_idx").alias("p_sum"), F.sum("g_idx").alias("g_sum"))


@query("snap_ends", "SELECT run, episode_id, idx, start_s, end_s FROM snapped")
def snap_ends(t: Tables):
    return sc.snap_ends(t.pred(), t.gold_of(), split=t.split)


@query("match_snapped", "SELECT run, episode_id, p_idx, g_idx, iou FROM snapped_matches")
def match_snapped(t: Tables):
    return sc.match_snapped(t.pred(), t.gold_of(), split=t.split).select("run", "episode_id", "p_idx", "g_idx", "iou")


@query("internal_boundaries", "SELECT run, episode_id, b_idx, t FROM bounds WHERE side = 0")
def internal_boundaries(t: Tables):
    return sc.internal_boundaries(t.pred(), split=t.split)


@query("nearest_boundary", """
SELECT run, episode_id, CASE side WHEN 0 THEN 'pred' ELSE 'gold' END AS side, b_idx, t, err FROM errors""")
def nearest_boundary(t: Tables):
    return sc.boundary_errors(t.pred(), t.gold_of(), split=t.split)


MEDIAN = "(list_sort(list(err))[(count(err)+1)//2] + list_sort(list(err))[(count(err)+2)//2]) / 2.0"


@query("segmentation_score", f"""
SELECT run, episode_id, n_pred, n_gold, n_matched, {ratio_sql('n_matched', 'n_pred')} AS precision,
       {ratio_sql('n_matched', 'n_gold')} AS recall, {f1_sql('n_matched', 'n_pred', 'n_gold')} AS f1
FROM (SELECT s.run, s.episode_id, count(*) FILTER (side = 0) AS n_pred, count(*) FILTER (side = 1) AS n_gold,
             coalesce(any_value(m.n), 0) AS n_matched
      FROM sided s LEFT JOIN (SELECT run, episode_id, count(*) AS n FROM matches WHERE iou >= 0.5 GROUP BY ALL) m
        ON s.run = m.run AND s.episode_id = m.episode_id GROUP BY ALL)""")
def segmentation_score(t: Tables):
    return sc.segmentation_score(t.pred(), t.gold_of(), split=t.split)


@query("boundary_score", f"""
SELECT run, episode_id, n_gold, n_pred,
       {', '.join(f"CASE WHEN n_gold > 0 THEN {ratio_sql(f'g{i}', 'n_gold')} END AS recall_{tag(x)}" for i, x in enumerate(TOLERANCES))},
       {', '.join(f"CASE WHEN n_gold > 0 THEN {ratio_sql(f'p{i}', 'n_pred')} END AS precision_{tag(x)}" for i, x in enumerate(TOLERANCES))},
       median_error
FROM (SELECT run, episode_id, count(*) FILTER (side = 1) AS n_gold, count(*) FILTER (side = 0) AS n_pred,
        {', '.join(f"count(*) FILTER (side = 1 AND err <= {x}) AS g{i}, count(*) FILTER (side = 0 AND err <= {x}) AS p{i}" for i, x in enumerate(TOLERANCES))}
      FROM errors GROUP BY ALL)
LEFT JOIN (SELECT run, episode_id, {MEDIAN} AS median_error FROM errors WHERE side = 1 AND err IS NOT NULL GROUP BY ALL) USING (run, episode_id)""")
def boundary_score(t: Tables):
    return sc.boundary_score(t.pred(), t.gold_of(), split=t.split)


def _dur(b: str, kind: str) -> str:
    return f"dur_{kind}_{b.replace('-', '_')}"


LEN_BUCKET = BUCKET_SQL.replace("end_s-start_s", "g1-g0")
block(f"""
span_counts AS (
  SELECT run, episode_id, count(*) FILTER (side = 0) AS n_pred, count(*) FILTER (side = 1) AS n_gold,
    {', '.join(f"count(*) FILTER (side = 1 AND ({BUCKET_SQL}) = '{b}') AS {_dur(b, 'n')}" for b in BUCKETS)}
  FROM sided GROUP BY ALL),
match_counts AS (
  SELECT m.run, m.episode_id, {', '.join(f"count(*) FILTER (m.iou >= {x}) AS m_{tag(x)}" for x in IOU_THRESHOLDS)},
    {', '.join(f"count(*) FILTER (m.iou >= 0.5 AND ({LEN_BUCKET}) = '{b}') AS {_dur(b, 'hit')}" for b in BUCKETS)}
  FROM matches m JOIN pairs p USING (run, episode_id, p_idx, g_idx) GROUP BY ALL),
snap_counts AS (SELECT run, episode_id, count(*) AS m_snapped FROM snapped_matches GROUP BY ALL),
bound_counts AS (
  SELECT run, episode_id, count(*) FILTER (side = 1) AS b_total, count(*) FILTER (side = 0) AS pb_total,
    {', '.join(f"count(*) FILTER (side = 1 AND err <= {x}) AS b_hit_{tag(x)}, count(*) FILTER (side = 0 AND err <= {x}) AS pb_hit_{tag(x)}" for x in TOLERANCES)}
  FROM errors GROUP BY ALL),
counts AS (
  SELECT scored.run, scored.episode_id, scored.family, {', '.join(f"coalesce({c}, 0) AS {c}" for c in COUNT_COLUMNS)}
  FROM scored LEFT JOIN span_counts USING (run, episode_id) LEFT JOIN match_counts USING (run, episode_id)
  LEFT JOIN snap_counts USING (run, episode_id) LEFT JOIN bound_counts USING (run, episode_id)),
scoped AS (SELECT *, unnest(['overall', family]) AS scope FROM counts),
pooled AS (SELECT run, scope, count(*) AS episodes, {', '.join(f"sum({c})::BIGINT AS {c}" for c in COUNT_COLUMNS)} FROM scoped GROUP BY ALL),
scored_errors AS (SELECT e.*, family FROM errors e JOIN scored USING (run, episode_id) WHERE side = 1 AND err IS NOT NULL),
medians AS (
  SELECT run, scope, {MEDIAN} AS median_boundary_error
  FROM (SELECT run, err, unnest(['overall', family]) AS scope FROM scored_errors) GROUP BY ALL)""")

REPORT_SQL = f"""episodes, n_pred AS segments_pred, n_gold AS segments_gold, m_0_5 AS segments_matched,
  {ratio_sql('m_0_5', 'n_pred')} AS precision, {ratio_sql('m_0_5', 'n_gold')} AS recall, {f1_sql('m_0_5', 'n_pred', 'n_gold')} AS f1,
  {', '.join(f"{f1_sql(f'm_{tag(x)}', 'n_pred', 'n_gold')} AS f1_at_{tag(x)}" for x in IOU_THRESHOLDS)},
  {f1_sql('m_snapped', 'n_pred', 'n_gold')} AS f1_snapped,
  {', '.join(f"b_hit_{tag(x)}::DOUBLE / nullif(b_total, 0) AS boundary_recall_{tag(x)}" for x in TOLERANCES)},
  {', '.join(f"pb_hit_{tag(x)}::DOUBLE / nullif(pb_total, 0) AS boundary_precision_{tag(x)}" for x in TOLERANCES)}"""
block(f"report AS (SELECT run, scope, {REPORT_SQL} FROM pooled)")


@query("episode_counts", "SELECT * FROM counts")
def episode_counts(t: Tables):
    return sc.episode_counts(t.pred(), t.gold_of(), t.scored(), split=t.split)


@query("corpus_report", "SELECT * FROM report WHERE scope = 'overall'")
def corpus_report(t: Tables):
    return sc.report(episode_counts(t))


@query("recall_by_duration", f"""
SELECT * FROM ({' UNION ALL '.join(f"SELECT run, scope, '{b}' AS bucket, {_dur(b, 'n')} AS n, {_dur(b, 'hit')} AS hits, {_dur(b, 'hit')}::DOUBLE / nullif({_dur(b, 'n')}, 0) AS recall FROM pooled" for b in BUCKETS)})
WHERE n > 0""")
def recall_by_duration(t: Tables):
    return sc.recall_by_duration(episode_counts(t), "family")


@query("evaluate_run", "SELECT report.*, median_boundary_error FROM report LEFT JOIN medians USING (run, scope)")
def evaluate_run(t: Tables):
    return sc.evaluate(t.pred(), t.gold_of(), t.scored(), "family", t.split)


@query("running_report", f"""
SELECT run, scope AS family, {REPORT_SQL} FROM pooled WHERE scope <> 'overall'""")
def running_report_query(t: Tables):
    return running_report(episode_counts(t))


# ---- failure taxonomy -----------------------------------------------------------------------------

block(f"""
covers AS (
  SELECT p.run, p.episode_id, p.idx AS p_idx, g.idx AS g_idx,
         {cov_sql('p.start_s', 'p.end_s', 'g.start_s', 'g.end_s')} AS p_on_g,
         {cov_sql('g.start_s', 'g.end_s', 'p.start_s', 'p.end_s')} AS g_on_p
  FROM pred p JOIN gold g ON p.episode_id = g.episode_id AND p.start_s < g.end_s AND g.start_s < p.end_s),
merged AS (
  SELECT DISTINCT a.run, a.episode_id, a.g_idx AS idx FROM covers a JOIN covers b
    ON a.run = b.run AND a.episode_id = b.episode_id AND a.p_idx = b.p_idx AND abs(a.g_idx - b.g_idx) = 1
  WHERE a.p_on_g >= 0.7 AND b.p_on_g >= 0.7),
splits AS (SELECT run, episode_id, g_idx AS idx FROM covers WHERE g_on_p >= 0.7 GROUP BY ALL HAVING count(*) >= 2),
matched AS (SELECT run, episode_id, g_idx AS idx FROM matches WHERE iou >= 0.5),
near AS (SELECT DISTINCT run, episode_id, g_idx AS idx FROM pairs WHERE iou >= 0.2),
classified AS (
  SELECT g.run, g.episode_id, g.idx, g.start_s, g.end_s,
    CASE WHEN EXISTS (SELECT 1 FROM matched x WHERE x.run = g.run AND x.episode_id = g.episode_id AND x.idx = g.idx) THEN 'ok'
         WHEN EXISTS (SELECT 1 FROM merged x WHERE x.run = g.run AND x.episode_id = g.episode_id AND x.idx = g.idx) THEN 'merged'
         WHEN EXISTS (SELECT 1 FROM splits x WHERE x.run = g.run AND x.episode_id = g.episode_id AND x.idx = g.idx) THEN 'split'
         WHEN EXISTS (SELECT 1 FROM near x WHERE x.run = g.run AND x.episode_id = g.episode_id AND x.idx = g.idx) THEN 'shifted'
         ELSE 'missing' END AS class
  FROM gold_run g)""")
SHARES = ", ".join(f"avg((class = '{c}')::INT::DOUBLE) AS \"{c}\"" for c in TAXONOMY)


@query("coverage_pairs", "SELECT run, episode_id, p_idx AS o_idx, g_idx AS i_idx FROM covers WHERE p_on_g >= 0.7")
def coverage_pairs(t: Tables):
    return sc.inside_pairs(t.pred(), t.gold_of(), 0.7, split=t.split)


@query("merged_gold", "SELECT * FROM merged")
def merged_gold(t: Tables):
    return er.merged(t.pred(), t.gold_of(), split=t.split)


@query("split_gold", "SELECT * FROM splits")
def split_gold(t: Tables):
    return er.split_up(t.pred(), t.gold_of(), split=t.split)


@query("failure_classes", "SELECT * FROM classified")
def failure_classes(t: Tables):
    return er.classify(t.pred(), t.gold_of(), split=t.split)


@query("failure_by_family", f"""
SELECT c.run, s.family, count(*) AS n, {SHARES} FROM classified c JOIN scored s USING (run, episode_id) GROUP BY ALL""")
def failure_by_family(t: Tables):
    return er.taxonomy(failure_classes(t).join(t.scored(), ["run", "episode_id"]), ["run", "family"])


@query("failure_by_duration", f"""
SELECT run, {TAX_SQL} AS bucket, count(*) AS n, {SHARES} FROM classified SEMI JOIN scored USING (run, episode_id) GROUP BY ALL""")
def failure_by_duration(t: Tables):
    return er.by_duration(failure_classes(t).join(t.scored(), ["run", "episode_id"], "left_semi"))


# ---- judging --------------------------------------------------------------------------------------

block(f"""
label_pairs AS (
  SELECT m.run, m.episode_id, m.p_idx, m.g_idx, {round_true_sql('m.iou', 3)} AS iou, p.label AS predicted, g.label AS gold, s.family
  FROM matches m JOIN scored s USING (run, episode_id)
  JOIN pred p ON p.run = m.run AND p.episode_id = m.episode_id AND p.idx = m.p_idx
  JOIN gold g ON g.episode_id = m.episode_id AND g.idx = m.g_idx WHERE m.iou >= 0.5),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY episode_id, p_idx) - 1 AS pair_no FROM label_pairs),
verdicts AS (
  SELECT run, episode_id, p_idx, g_idx, 1 AS seq, predicted = gold AS same_event, 'first look' AS note FROM label_pairs
  WHERE (episode_id * 7 + p_idx) % 13 <> 0
  UNION ALL
  SELECT run, episode_id, p_idx, g_idx, 2, predicted <> gold, 'revised' FROM label_pairs WHERE (episode_id + p_idx) % 17 = 0),
judged AS (
  SELECT l.*, coalesce(v.same_event, false) AS same_event, coalesce(v.note, 'no verdict returned') AS note
  FROM label_pairs l LEFT JOIN (
    SELECT run, episode_id, p_idx, g_idx, arg_max(same_event, seq) AS same_event, arg_max(note, seq) AS note
    FROM verdicts GROUP BY ALL) v USING (run, episode_id, p_idx, g_idx))""")


def _label_pairs(t: Tables):
    matches = sc.match(t.pred(), t.gold_of(), 0.5, split=t.split)
    return jd.pairs(matches, t.pred(), t.gold_of(), t.scored())


def _verdicts(pairs):
    """Two looks at the pairs: most are judged, some are withheld, some judged twice."""
    keep = [*sc.RUN_KEYS, "p_idx", "g_idx"]
    same = F.col("predicted") == F.col("gold")
    looks = F.array(
        F.when((F.col("episode_id") * 7 + F.col("p_idx")) % 13 != 0, F.struct(
            F.lit(1).alias("seq"), same.alias("same_event"), F.lit("first look").alias("note"))),
        F.when((F.col("episode_id") + F.col("p_idx")) % 17 == 0, F.struct(
            F.lit(2).alias("seq"), (~same).alias("same_event"), F.lit("revised").alias("note"))))
    return pairs.select(*keep, F.explode(F.array_compact(looks)).alias("v")).select(*keep, "v.*")


def _judged(t: Tables):
    pairs = _label_pairs(t)
    return jd.attach(pairs, _verdicts(pairs))


@query("label_pairs", "SELECT * FROM label_pairs")
def label_pairs(t: Tables):
    return _label_pairs(t)


@query("judge_batches", """
SELECT run, pair_no // 20 AS batch_no, count(*) AS n_pairs,
  'Do the two labels of each pair name the same completed event?' || chr(10) || string_agg(
    pair_no || '. predicted: ' || predicted || chr(10) || '   human: ' || gold, chr(10) ORDER BY pair_no) AS request
FROM numbered GROUP BY ALL""")
def judge_batches(t: Tables):
    return jd.render_batches(_label_pairs(t))


@query("attach_verdicts", "SELECT * FROM judged")
def attach_verdicts(t: Tables):
    return _judged(t)


@query("label_accuracy", f"""
SELECT run, scope, n, {round_true_sql('acc', 4)} AS accuracy FROM (
  SELECT run, scope, count(*) AS n, avg(same_event::INT::DOUBLE) AS acc
  FROM (SELECT *, unnest(['overall', family]) AS scope FROM judged) GROUP BY ALL)""")
def label_accuracy(t: Tables):
    return jd.accuracy(_judged(t))


@query("label_discordance", """
SELECT count(*) AS n, count(*) FILTER (a AND b) AS both_right, count(*) FILTER (a AND NOT b) AS only_a,
       count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS both_wrong
FROM (SELECT x.same_event AS a, y.same_event AS b FROM judged x JOIN judged y USING (episode_id, g_idx)
      WHERE x.run = 'a' AND y.run = 'b')""")
def label_discordance(t: Tables):
    judged = _judged(t)
    return jd.discordant(judged.filter("run = 'a'"), judged.filter("run = 'b'"), ["episode_id", "g_idx"])


# ---- paired statistics ----------------------------------------------------------------------------

BOOT = ["n_pred", "n_gold", "m_0_5", "m_snapped", "b_total"] + [f"b_hit_{tag(x)}" for x in TOLERANCES]


def _metric_list(p: str) -> str:
    rows = [("f1", f1_sql(f"{p}_m_0_5", f"{p}_n_pred", f"{p}_n_gold")),
            ("f1_snapped", f1_sql(f"{p}_m_snapped", f"{p}_n_pred", f"{p}_n_gold"))]
    rows += [(f"boundary_recall_{tag(x)}", ratio_sql(f"{p}_b_hit_{tag(x)}", f"{p}_b_total")) for x in TOLERANCES]
    return "[" + ", ".join(f"{{'metric': '{n}', 'v': {e}}}" for n, e in rows) + "]"


def _bootstrap_sql(p: str, source: str, weights: str) -> str:
    """CTEs {p}paired, ..., {p}bootstrap over per-episode counts; weights: a relation (b, episode_id, w)."""
    return f"""
{p}paired AS (
  SELECT a.episode_id, {', '.join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in BOOT)},
         row_number() OVER (ORDER BY a.episode_id) - 1 AS j, count(*) OVER () AS n
  FROM ({source}) a JOIN ({source}) b USING (episode_id) WHERE a.run = 'a' AND b.run = 'b'),
{p}weights AS ({weights}),
{p}boot AS (SELECT b, {', '.join(f"sum(w * {s}_{c})::BIGINT AS {s}_{c}" for s in 'ab' for c in BOOT)} FROM {p}weights JOIN {p}paired USING (episode_id) WHERE w > 0 GROUP BY b),
{p}boot_deltas AS (
  SELECT b, x.metric AS metric, y.v - x.v AS delta
  FROM (SELECT b, unnest({_metric_list('a')}) AS x, unnest({_metric_list('b')}) AS y FROM {p}boot)),
{p}ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY delta) - 1 AS r FROM {p}boot_deltas),
{p}cis AS (
  SELECT metric, max(delta) FILTER (r = {int(BOOTSTRAP * 0.05 / 2)}) AS ci_low,
         max(delta) FILTER (r = {int(BOOTSTRAP * (1 - 0.05 / 2))}) AS ci_high, avg((delta > 0)::INT::DOUBLE) AS p_positive
  FROM {p}ranked GROUP BY metric),
{p}point AS (
  SELECT x.metric AS metric, x.v AS a, y.v AS b, y.v - x.v AS delta
  FROM (SELECT unnest({_metric_list('a')}) AS x, unnest({_metric_list('b')}) AS y
        FROM (SELECT {', '.join(f"sum({s}_{c})::BIGINT AS {s}_{c}" for s in 'ab' for c in BOOT)} FROM {p}paired))),
{p}bootstrap AS (SELECT {p}point.*, ci_low, ci_high, p_positive, ci_low > 0 OR ci_high < 0 AS significant FROM {p}point JOIN {p}cis USING (metric))"""


def _draws_sql(p: str) -> str:
    return f"""SELECT d.b, q.episode_id, count(*) AS w FROM (
      SELECT b, ('0x' || substr(md5('{SEED}:' || b || ':' || j), 1, 8))::BIGINT % n AS j
      FROM {p}paired, (SELECT unnest(range({BOOTSTRAP})) AS b)) d JOIN {p}paired q USING (j) GROUP BY d.b, q.episode_id"""


POISSON_SQL = f"""SELECT b, episode_id, {' + '.join(f'(u >= {t!r}::DOUBLE)::BIGINT' for t in st.poisson_steps())} AS w FROM (
      SELECT b, episode_id, ('0x' || substr(md5('{SEED}:' || b || ':' || episode_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM poisson_paired, (SELECT unnest(range({BOOTSTRAP})) AS b))"""

# Two independent samples of the episodes, by the parity of a hash of the id.
HALF_SQL = "SELECT * FROM counts WHERE ('0x' || substr(md5(episode_id::VARCHAR), 1, 8))::BIGINT % 2 = {}"

block(f"""
common AS (SELECT episode_id FROM run_rows WHERE run = 'a' AND ok INTERSECT SELECT episode_id FROM run_rows WHERE run = 'b' AND ok),
{_bootstrap_sql('', 'SELECT * FROM counts', _draws_sql('')).strip()}""")


@query("paired_episodes", "SELECT * FROM common")
def paired_episodes(t: Tables):
    return st.paired_ids(t.run_rows, "a", "b")


@query("paired_bootstrap", "SELECT * FROM bootstrap")
def paired_bootstrap(t: Tables):
    return st.paired_bootstrap(episode_counts(t), "a", "b", split=t.split)


@query("poisson_bootstrap", f"SELECT * FROM (WITH {_bootstrap_sql('poisson_', 'SELECT * FROM counts', POISSON_SQL)} SELECT * FROM poisson_bootstrap)")
def poisson_bootstrap(t: Tables):
    return st.paired_bootstrap(episode_counts(t), "a", "b", method="poisson", split=t.split)


@query("vector_bootstrap")
def vector_bootstrap(t: Tables):
    """Multinomial draws of different count vectors; SQL has no such draw, so tests hold it against the index form."""
    return st.paired_bootstrap(episode_counts(t), "a", "b", method="vectors", split=t.split)


@query("replicated_change", f"""
SELECT metric, x.delta AS delta_1, y.delta AS delta_2, x.significant AND y.significant AND sign(x.delta) = sign(y.delta) AS replicated
FROM (WITH {_bootstrap_sql('even_', HALF_SQL.format(0), _draws_sql('even_'))}, {_bootstrap_sql('odd_', HALF_SQL.format(1), _draws_sql('odd_')).strip()}
      SELECT even_bootstrap.metric AS metric, even_bootstrap AS x, odd_bootstrap AS y FROM even_bootstrap JOIN odd_bootstrap USING (metric))""")
def replicated_change(t: Tables):
    """The change from run a to run b, measured on two samples of episodes that share none."""
    counts = durable(episode_counts(t))  # read by both samples
    half = F.conv(F.substring(F.md5(F.col("episode_id").cast("string")), 1, 8), 16, 10).cast("long") % 2
    return st.replicated(*(st.paired_bootstrap(counts.filter(half == k), "a", "b", split=t.split) for k in (0, 1)))


PAIRED_METRICS = (["episodes", "segments_pred", "segments_gold", "segments_matched", "precision", "recall", "f1"]
                  + [f"f1_at_{tag(x)}" for x in IOU_THRESHOLDS] + ["f1_snapped"]
                  + [f"boundary_recall_{tag(x)}" for x in TOLERANCES] + [f"boundary_precision_{tag(x)}" for x in TOLERANCES])


@query("paired_report", f"""
SELECT a.scope, m.metric, a.v[m.i] AS a, b.v[m.i] AS b, b.v[m.i] - a.v[m.i] AS delta
FROM (SELECT run, scope, [{', '.join(f'{m}::DOUBLE' for m in PAIRED_METRICS)}] AS v FROM (
        SELECT run, scope, {REPORT_SQL} FROM (
          SELECT run, scope, count(*) AS episodes, {', '.join(f"sum({c})::BIGINT AS {c}" for c in COUNT_COLUMNS)}
          FROM scoped SEMI JOIN common USING (episode_id) GROUP BY ALL))) a
JOIN (SELECT run, scope, [{', '.join(f'{m}::DOUBLE' for m in PAIRED_METRICS)}] AS v FROM (
        SELECT run, scope, {REPORT_SQL} FROM (
          SELECT run, scope, count(*) AS episodes, {', '.join(f"sum({c})::BIGINT AS {c}" for c in COUNT_COLUMNS)}
          FROM scoped SEMI JOIN common USING (episode_id) GROUP BY ALL))) b USING (scope),
     (VALUES {', '.join(f"({i + 1}, '{m}')" for i, m in enumerate(PAIRED_METRICS))}) m(i, metric)
WHERE a.run = 'a' AND b.run = 'b'""")
def paired_report(t: Tables):
    return st.paired_report(episode_counts(t), "a", "b", "family")


@query("delta_summary", f"""
SELECT count(*) AS n, count(size) AS changed,
  (list_sort(list(size) FILTER (size IS NOT NULL))[(count(size)+1)//2] + list_sort(list(size) FILTER (size IS NOT NULL))[(count(size)+2)//2]) / 2.0 AS median_abs,
  round(avg(size), 9) AS mean_abs, max(size) AS max_abs
FROM (SELECT CASE WHEN abs(d) > 1e-9 THEN abs(d) END AS size FROM (
  SELECT {f1_sql('b_m_0_5', 'b_n_pred', 'b_n_gold')} - {f1_sql('a_m_0_5', 'a_n_pred', 'a_n_gold')} AS d FROM paired))""")
def delta_summary(t: Tables):
    return st.delta_summary(episode_counts(t), "a", "b").withColumn("mean_abs", F.round("mean_abs", 9))


# ---- reports --------------------------------------------------------------------------------------

block("""
calls AS (
  SELECT r.run, t.episode_id, CASE WHEN t.event_id % 5 = 0 THEN 'label' WHEN t.event_id % 7 = 0 THEN 'refine' ELSE 'segment' END AS stage,
         1000 + t.event_id % 300 AS prompt_tokens, 80 + t.event_id % 40 AS output_tokens, (t.event_id % 50 = 0)::INT AS retries
  FROM timed t, (VALUES ('a'), ('b')) r(run)),
summary AS (
  SELECT run, count(*) AS episodes, count(*) FILTER (NOT ok) AS failed,
         (sum(CASE WHEN ok THEN (duration_s * 1000)::BIGINT END) / 1000.0::DOUBLE) AS video_seconds,
         sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens
  FROM run_rows GROUP BY run),
models AS (SELECT * FROM (VALUES ('a', 'gemini-2.5-flash'), ('b', 'unlisted-model')) m(run, model)),
prices AS (SELECT * FROM (VALUES ('gemini-2.5-flash', 0.30::DOUBLE, 2.50::DOUBLE)) p(model, price_in, price_out))""")


def _calls(t: Tables):
    stage = F.when(F.col("event_id") % 5 == 0, "label").when(F.col("event_id") % 7 == 0, "refine").otherwise("segment")
    return t.timed.withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b")))).select(
        "run", "episode_id", stage.alias("stage"), (1000 + F.col("event_id") % 300).alias("prompt_tokens"),
        (80 + F.col("event_id") % 40).alias("output_tokens"), (F.col("event_id") % 50 == 0).cast("int").alias("retries"))


@query("usage_totals", """
SELECT run, episode_id, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       sum(retries)::BIGINT AS retries, count(*) FILTER (stage = 'label') AS label_calls, count(*) FILTER (stage = 'refine') AS refine_calls,
       count(*) FILTER (stage = 'segment') AS segment_calls
FROM calls GROUP BY ALL""")
def usage_totals(t: Tables):
    out = rp.usage(_calls(t))
    return out.select("run", "episode_id", "calls", "prompt_tokens", "output_tokens", "retries", *(
        F.coalesce(F.try_element_at("by_stage", F.lit(s)), F.lit(0)).alias(f"{s}_calls") for s in ("label", "refine", "segment")))


def _summary(t: Tables):
    return rp.run_summary(rp.assert_any_ok(t.run_rows)).withColumn("video_seconds", F.round("video_seconds", 3))


@query("run_summary", "SELECT * FROM summary")
def run_summary(t: Tables):
    return _summary(t)


COST_SQL = ("prompt_tokens/1e6*coalesce(price_in, 0.75::DOUBLE)+output_tokens/1e6*coalesce(price_out, 3.75::DOUBLE)")


def _models(t: Tables):
    return t.spark.createDataFrame([("a", "gemini-2.5-flash"), ("b", "unlisted-model")], "run string, model string")


@query("run_cost", f"""
SELECT run, model, round(cost, 6) AS cost, {round_true_sql('per_hour', 2)} AS cost_per_video_hour FROM (
  SELECT run, model, {COST_SQL} AS cost, ({COST_SQL}) / (video_seconds / 3600) AS per_hour
  FROM summary JOIN models USING (run) LEFT JOIN prices USING (model))""")
def run_cost(t: Tables):
    priced = rp.with_prices(_summary(t).join(_models(t), "run"))
    return priced.select("run", "model", F.round(rp.cost(), 6).alias("cost"), rp.cost_per_hour(priced).alias("cost_per_video_hour"))


@query("compare_runs", f"""
SELECT s.run, m.model, s.episodes, s.failed, s.video_seconds, s.prompt_tokens, s.output_tokens, r.f1, r.f1_snapped, r.precision, r.recall,
       p.dur_hit_1_2::DOUBLE / p.dur_n_1_2 AS recall_1_2, l.accuracy AS label_accuracy, c.cost_per_video_hour
FROM summary s JOIN models m USING (run) JOIN report r ON r.run = s.run AND r.scope = 'overall'
JOIN pooled p ON p.run = s.run AND p.scope = 'overall'
JOIN (SELECT run, {round_true_sql('acc', 4)} AS accuracy FROM (SELECT run, avg(same_event::INT::DOUBLE) AS acc FROM judged GROUP BY run)) l ON l.run = s.run
JOIN (SELECT run, {round_true_sql('per_hour', 2)} AS cost_per_video_hour FROM (
  SELECT run, ({COST_SQL}) / (video_seconds / 3600) AS per_hour FROM summary JOIN models USING (run) LEFT JOIN prices USING (model))) c ON c.run = s.run""")
def compare_runs(t: Tables):
    counts = durable(episode_counts(t))  # read by both reports
    out = rp.compare(_summary(t), sc.report(counts), _models(t), sc.recall_by_duration(counts), jd.accuracy(_judged(t)))
    return out.select("run", "model", "episodes", "failed", "video_seconds", "prompt_tokens", "output_tokens", "f1", "f1_snapped",
                      "precision", "recall", "recall_1_2", "label_accuracy", "cost_per_video_hour")


@query("compare_families", """
SELECT run, max(f1) FILTER (scope = 'fam_0') AS fam_0, max(f1) FILTER (scope = 'fam_1') AS fam_1,
       max(f1) FILTER (scope = 'fam_2') AS fam_2 FROM report GROUP BY run""")
def compare_families(t: Tables):
    return rp.compare_families(sc.report(episode_counts(t), "family"), ["fam_0", "fam_1", "fam_2"])


@query("family_union", "SELECT DISTINCT scope FROM pooled WHERE scope <> 'overall'")
def family_union(t: Tables):
    counts = t.scored().withColumn("scope", F.col("family"))
    return rp.families(*(counts.filter(F.col("run") == r) for r in ("a", "b")))


def _median_sql(x: str) -> str:
    return f"(list_sort(list({x}))[(count({x})+1)//2] + list_sort(list({x}))[(count({x})+2)//2]) / 2.0"


@query("dataset_profile", f"""
SELECT family, any_value(e.episodes) AS episodes, any_value(e.minutes) AS minutes, count(*) AS segments,
       {_median_sql('length')} AS median_segment, count(*)::DOUBLE / any_value(e.episodes) AS segments_per_episode
FROM (SELECT family, end_s - start_s AS length FROM gold JOIN episodes USING (episode_id)) g
JOIN (SELECT family, count(*) AS episodes, round(sum(duration_s) / 60, 6) AS minutes FROM episodes GROUP BY family) e USING (family)
GROUP BY family""")
def dataset_profile(t: Tables):
    return rp.dataset_profile(t.episodes, t.gold).withColumn("minutes", F.round("minutes", 6))


@query("coverage_profile", f"""
SELECT family, count(*) AS episodes, count(*) FILTER (gap) AS with_gaps, round({_median_sql('coverage')}, 9) AS median_coverage,
       {_median_sql('tail')} AS median_tail
FROM (SELECT e.family, coalesce(covered, 0) / duration_s AS coverage, duration_s - coalesce(last_end, 0) AS tail, coalesce(gap, false) AS gap
      FROM episodes e LEFT JOIN (
        SELECT episode_id, sum(end_s - start_s) AS covered, max(end_s) AS last_end, bool_or(coalesce(start_s > pe, false)) AS gap
        FROM (SELECT *, lag(end_s) OVER (PARTITION BY episode_id ORDER BY start_s, end_s, idx) AS pe FROM thinned) GROUP BY episode_id) USING (episode_id))
GROUP BY family""".replace("FROM thinned)", "FROM (SELECT * REPLACE (CASE WHEN idx % 9 = 4 THEN (start_s + end_s) / 2 ELSE end_s END AS end_s) FROM gold))"))
def coverage_profile(t: Tables):
    """Gold with every ninth span cut in half, so that there are gaps to find."""
    end = F.when(F.col("idx") % 9 == 4, (F.col("start_s") + F.col("end_s")) / 2).otherwise(F.col("end_s"))
    out = rp.coverage_profile(t.episodes, t.gold.withColumn("end_s", end), split=t.split)
    return out.withColumn("median_coverage", F.round("median_coverage", 9))


@query("grid_quantisation", """
SELECT run, count(*) AS n, avg((abs(t / 0.5 - round(t / 0.5)) < 1e-6)::INT::DOUBLE) AS on_grid FROM bounds WHERE side = 0 GROUP BY run""")
def grid_quantisation(t: Tables):
    return rp.grid_quantisation(sc.internal_boundaries(t.pred(), split=t.split))


@query("worst_episodes", f"""
SELECT run, episode_id, {f1_sql('m_0_5', 'n_pred', 'n_gold')} AS f1 FROM counts ORDER BY f1, run, episode_id LIMIT 10""")
def worst_episodes(t: Tables):
    return rp.worst(episode_counts(t), 10).select("run", "episode_id", "f1")


@query("inspect_run", """
SELECT g.run, g.episode_id, 'gold' AS item, g.idx, g.start_s, g.end_s, g.label, m.g_idx IS NOT NULL AS matched, NULL::DOUBLE AS err
FROM gold_run g LEFT JOIN (SELECT * FROM matches WHERE iou >= 0.5) m ON m.run = g.run AND m.episode_id = g.episode_id AND m.g_idx = g.idx WHERE g.run = 'a'
UNION ALL SELECT run, episode_id, 'pred', idx, start_s, end_s, label, NULL, NULL FROM pred WHERE run = 'a'
UNION ALL SELECT run, episode_id, 'boundary', b_idx, t, t, NULL, NULL, err FROM errors WHERE side = 1 AND run = 'a'""")
def inspect_run(t: Tables):
    return rp.inspect(t.pred("a"), t.gold_of("a"), t.split)
