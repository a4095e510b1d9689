"""Scoring predicted spans against gold: candidate pairs, one-to-one matching, boundaries, reports.

Inputs are span tables with (run, episode_id, idx, start_s, end_s); a gold table shared by several runs
is repeated per run by the caller. All corpus metrics are ratios of summed per-episode counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import intervals as iv
from spanlake.operators.layout import SPLIT_ROWS, Ordered, by_size, chain_wins, durable, ordered
from spanlake.schema import (DURATION_EDGES, EPS, IOU_THRESHOLDS, RUN_KEYS, SNAPPED_IOU, TOLERANCES)

BUCKETS = iv.bucket_names(DURATION_EDGES)


def tag(value: float) -> str:
    """0.25 -> '0_25', for column names."""
    return f"{value:g}".replace(".", "_")


# ---- candidate pairs ------------------------------------------------------------------------------

def _sides(pred: DataFrame, gold: DataFrame, keys, carry=()) -> tuple[DataFrame, DataFrame]:
    p = pred.select(*keys, F.col("idx").alias("p_idx"), F.col("start_s").alias("p0"),
                    F.col("end_s").alias("p1"), *carry)
    g = gold.select(*keys, F.col("idx").alias("g_idx"), F.col("start_s").alias("g0"),
                    F.col("end_s").alias("g1"))
    return p, g


def _in_cells(df: DataFrame, start: str, end: str, base: float, side: str) -> DataFrame:
    """Place each span in the time cells of its own length class and of the next one up.

    Class k holds lengths in [base^k, base^(k+1)) and its cells are base^(k+1) wide, so a span touches
    at most two cells per class however long it is or however dense its episode.
    """
    level = F.floor(F.log(F.col(end) - F.col(start)) / F.log(F.lit(base)))
    df = df.filter(F.col(end) > F.col(start)).withColumn(f"{side}_level", level)
    df = df.withColumn("level", F.explode(F.array(f"{side}_level", F.col(f"{side}_level") + 1)))
    width = F.pow(F.lit(base), F.col("level") + 1)
    df = df.withColumn(f"{side}_cell", F.floor(F.col(start) / width))
    return df.withColumn("cell", F.explode(F.sequence(f"{side}_cell", F.floor(F.col(end) / width))))


@by_size("pred", "gold")
def candidates(pred: DataFrame, gold: DataFrame, min_iou: float = IOU_THRESHOLDS[0],
               keys: Sequence[str] = RUN_KEYS, split: bool | None = None, carry=()) -> DataFrame:
    """All pairs with IoU >= ``min_iou`` (> 0): (keys, p_idx, g_idx, iou, p0, p1, g0, g1, *carry).

    Small episodes join on the episode with the test as join condition. With ``split`` the join key is
    an (episode, length class, time cell): two spans can only reach IoU t when their lengths differ by
    at most 1/t, so comparable spans always share a class within one step, and a hot episode spreads
    over its cells. A pair meeting in two cells is kept in the later first cell only.
    """
    if min_iou <= 0:
        raise ValueError("min_iou must be positive")
    p, g = _sides(pred, gold, keys, carry)
    score = iv.iou("p0", "p1", "g0", "g1")
    touching = (F.col("p0") < F.col("g1")) & (F.col("g0") < F.col("p1"))
    if not split:
        pairs = p.join(g, list(keys)).filter(touching)
    else:
        base = max(16.0, 2.0 / min_iou)
        p, g = _in_cells(p, "p0", "p1", base, "p"), _in_cells(g, "g0", "g1", base, "g")
        pairs = p.join(g, [*keys, "level", "cell"]).filter(
            touching & (F.col("level") == F.greatest("p_level", "g_level"))
            & (F.col("cell") == F.greatest("p_cell", "g_cell")))
    return (pairs.withColumn("iou", score).filter(F.col("iou") >= min_iou)
            .select(*keys, "p_idx", "g_idx", "iou", "p0", "p1", "g0", "g1", *carry))


def point_join(outer: DataFrame, points: DataFrame, keys: Sequence[str], o0: str, o1: str, at: str,
               split: bool) -> DataFrame:
    """Pairs of an interval and a point of the same group with o0 <= at <= o1.

    With ``split`` each interval sits in the cells of its own length class and each point asks every
    class that occurs, so a hot group spreads over its cells and no long interval is unrolled.
    """
    holds = (F.col(at) >= F.col(o0)) & (F.col(at) <= F.col(o1))
    if not split:
        return outer.join(points, list(keys)).filter(holds)
    base, low, high = 16.0, -9, 12   # lengths from 1e-10 s to 1e15 s; others clamp to the ends
    length = F.greatest(F.col(o1) - F.col(o0), F.lit(1e-12))
    level = F.least(F.greatest(F.floor(F.log(length) / F.log(F.lit(base))), F.lit(low).cast("long")),
                    F.lit(high).cast("long"))
    outer = outer.filter(F.col(o1) >= F.col(o0)).withColumn("_level", level)
    width = F.pow(F.lit(base), F.col("_level") + 1)
    outer = outer.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(o0) / width), F.floor(F.col(o1) / width))))
    # At most high - low + 1 classes can occur.
    used = sorted(r[0] for r in outer.select("_level").distinct().collect())
    asked = F.array(*(F.lit(k).cast("long") for k in used)).cast("array<bigint>")
    points = points.withColumn("_level", F.explode(asked))
    points = points.withColumn("_cell", F.floor(F.col(at) / F.pow(F.lit(base), F.col("_level") + 1)))
    return outer.join(points, [*keys, "_level", "_cell"]).filter(holds).drop("_level", "_cell")


@by_size("pred", "gold")
def overlaps(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """All pairs that share time, however little: (keys, p_idx, g_idx, iou, p0, p1, g0, g1).

    Small episodes join on the episode. With ``split``: of two spans that overlap, one starts inside the
    other, so this is two point lookups.
    """
    p, g = _sides(pred, gold, keys)
    touching = (F.col("p0") < F.col("g1")) & (F.col("g0") < F.col("p1"))
    if not split:
        return (p.join(g, list(keys)).filter(touching).select(*keys, "p_idx", "g_idx", "p0", "p1", "g0", "g1")
                .withColumn("iou", iv.iou("p0", "p1", "g0", "g1")))
    later_gold = point_join(p, g, keys, "p0", "p1", "g0", split).filter(touching & (F.col("g0") >= F.col("p0")))
    later_pred = point_join(g, p, keys, "g0", "g1", "p0", split).filter(touching & (F.col("p0") > F.col("g0")))
    columns = [*keys, "p_idx", "g_idx", "p0", "p1", "g0", "g1"]
    return later_gold.select(columns).union(later_pred.select(columns)).withColumn("iou", iv.iou("p0", "p1", "g0", "g1"))


@by_size("outer", "inner")
def inside_pairs(outer: DataFrame, inner: DataFrame, min_cov: float, keys: Sequence[str] = RUN_KEYS,
                 split: bool | None = None) -> DataFrame:
    """Pairs where ``outer`` covers at least ``min_cov`` (> 0.5) of ``inner``: (keys, o_idx, i_idx).

    More than half of a span always includes its midpoint, so this is a point lookup.
    """
    if min_cov <= 0.5:
        raise ValueError("min_cov must exceed one half")
    o = outer.select(*keys, F.col("idx").alias("o_idx"), F.col("start_s").alias("o0"), F.col("end_s").alias("o1"))
    i = inner.select(*keys, F.col("idx").alias("i_idx"), F.col("start_s").alias("i0"), F.col("end_s").alias("i1"))
    i = i.filter(F.col("i1") > F.col("i0")).withColumn("_mid", (F.col("i0") + F.col("i1")) / 2)
    pairs = point_join(o, i, keys, "o0", "o1", "_mid", split)
    return (pairs.filter(iv.coverage("o0", "o1", "i0", "i1") >= min_cov)
            .select(*keys, "o_idx", "i_idx"))


# ---- one-to-one matching --------------------------------------------------------------------------

def _rank() -> Column:
    return F.struct((-F.col("iou")).alias("n_iou"), F.col("p_idx"), F.col("g_idx"))


def _match_rounds(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy matching without sequence. A pair wins exactly if every better pair of its two spans loses, so:

    * a pair that ranks first for both its spans wins;
    * a pair with a single better one wins if that one loses, which along a chain of such pairs is decided by its distance
      to the chain's end (``chain_wins``, rounds in the logarithm of the chain);
    * all others wait until the pairs of the winners' spans are gone.

    The ranking is a strict total order, so the accepted set equals the greedy one.
    """
    keys, left, done = list(keys), durable(pairs), None
    key = F.struct("p_idx", "g_idx")
    while not left.isEmpty():
        by_p, by_g = (Window.partitionBy(*keys, c).orderBy(_rank()) for c in ("p_idx", "g_idx"))
        ranked = left.select(*keys, key.alias("pair"), F.row_number().over(by_p).alias("_np"), F.lag(key).over(by_p).alias("_up"),
                             "p_idx", "g_idx", "iou").withColumns({"_ng": F.row_number().over(by_g), "_ug": F.lag(key).over(by_g)})
        better = F.col("_np") + F.col("_ng") - 2
        nodes = ranked.select(*keys, "pair", F.when(better == 1, F.coalesce("_up", "_ug")).alias("above"),
                              F.when(better == 0, F.lit(True)).alias("wins"))
        won = durable(chain_wins(nodes, keys, "pair", "above").filter("wins").select(*keys, "pair.*"))
        hits = left.join(won, [*keys, "p_idx", "g_idx"], "left_semi")
        done = hits if done is None else done.unionByName(hits)
        left = durable(left.join(won.select(*keys, "p_idx"), [*keys, "p_idx"], "left_anti")
                       .join(won.select(*keys, "g_idx"), [*keys, "g_idx"], "left_anti"))
    return pairs.limit(0) if done is None else done


@by_size("pairs")
def greedy(pairs: DataFrame, keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """Keep pairs one-to-one by descending IoU, then pred index, then gold index.

    Pairs that share a span overlap in time, so stretches of overlapping pairs are independent; each is
    folded on its own. The result filtered to iou >= t is the matching at t (greedy is prefix-stable).
    """
    o = ordered(pairs.withColumns({"_h0": F.least("p0", "g0"), "_h1": F.greatest("p1", "g1")}),
                keys, ["_h0", "_h1", "p_idx", "g_idx"], split)
    o = o.running({"_reach": ("max", "_h1")})
    o = o.islands("_island", F.coalesce(F.col("_h0") >= F.col("_reach"), F.lit(True)))
    stretches = o.df.drop("_h0", "_h1", "_reach")
    group = [*keys, "_island"]
    if not split:
        return _fold(stretches, group).drop("_island")
    stretches = durable(stretches)
    sizes = durable(stretches.groupBy(*group).count().filter(F.col("count") > SPLIT_ROWS))
    if sizes.isEmpty():
        return _fold(stretches, group).drop("_island")
    small = _fold(stretches.join(sizes, group, "left_anti"), group)
    return small.unionByName(_match_rounds(stretches.join(sizes, group, "left_semi"), group)).drop("_island")


def _fold(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    fields = [c for c in pairs.columns if c not in group]
    rest = [c for c in fields if c not in ("p_idx", "g_idx", "iou")]
    item = F.struct((-F.col("iou")).alias("n_iou"), "p_idx", "g_idx", *rest)
    ranked = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    nothing = F.filter("_c", lambda _: F.lit(False))
    # The spans taken so far stand beside the pairs, in lists of numbers that are searched without a lambda.
    taken = F.struct(nothing.alias("pairs"), F.transform(nothing, lambda x: x["p_idx"]).alias("p"), F.transform(nothing, lambda x: x["g_idx"]).alias("g"))
    accepted = F.aggregate("_c", taken, lambda acc, x: F.when(
        F.array_contains(acc["p"], x["p_idx"]) | F.array_contains(acc["g"], x["g_idx"]), acc)
        .otherwise(F.struct(F.concat(acc["pairs"], F.array(x)).alias("pairs"), F.concat(acc["p"], F.array(x["p_idx"])).alias("p"),
                            F.concat(acc["g"], F.array(x["g_idx"])).alias("g"))), lambda acc: acc["pairs"])
    # A stretch of one pair, the common case, needs no fold.
    accepted = F.when(F.size("_c") == 1, F.col("_c")).otherwise(accepted)
    # The outer form (no list is empty) keeps the optimizer from folding once more to test for that.
    return (ranked.select(*group, F.explode_outer(accepted).alias("_m"))
            .select(*group, *(F.col("_m")[c].alias(c) if c != "iou" else (-F.col("_m")["n_iou"]).alias("iou")
                              for c in fields)))


@by_size("pred", "gold")
def match(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, keys: Sequence[str] = RUN_KEYS,
          assume_disjoint: bool = False, split: bool | None = None) -> DataFrame:
    """One-to-one matches at one threshold: (keys, p_idx, g_idx, iou, p0, p1, g0, g1).

    ``assume_disjoint`` skips the matching step: above IoU 0.5 a span has at most one partner when
    both sides are free of overlaps.
    """
    pairs = candidates(pred, gold, threshold, keys, split)
    if assume_disjoint:
        if threshold <= 0.5:
            raise ValueError("partners are unique only above IoU 0.5")
        return pairs
    return greedy(pairs, keys, split)


def match_all(pairs: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS,
              keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """Matches at several thresholds from one candidate set, one row per (threshold, match)."""
    best = greedy(pairs.filter(F.col("iou") >= min(thresholds)), keys, split)
    reached = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col("iou") >= t)
    return best.withColumn("threshold", F.explode(reached))


# ---- ends and boundaries --------------------------------------------------------------------------

PRED, GOLD = 0, 1


def _sided(pred: DataFrame | None, gold: DataFrame | None, keys: Sequence[str], split: bool) -> Ordered:
    """Both sides in one table, ordered by (side, idx): one shuffle that every later piece reuses.

    Adds ``first``/``last`` of the side, the midpoint ``t`` to the next span of the side and the gold
    ends ``g0``/``g1`` of the episode.
    """
    sides = [df.select(*keys, F.lit(side).alias("side"), "idx", "start_s", "end_s")
             for side, df in ((PRED, pred), (GOLD, gold)) if df is not None]
    o = ordered(reduce(DataFrame.unionByName, sides), keys, ["side", "idx"], split)
    o = o.shift(prev={"_ps": "side"}, next={"_ns": "side", "_n0": "start_s"})
    first = F.coalesce(F.col("_ps") != F.col("side"), F.lit(True))
    last = F.coalesce(F.col("_ns") != F.col("side"), F.lit(True))
    o = o.with_columns({"first": first, "last": last,
                        "t": F.when(~last, (F.col("end_s") + F.col("_n0")) / 2.0)}).drop("_ps", "_ns", "_n0")
    of_gold = F.col("side") == GOLD
    return o.total({"g0": ("max", F.when(of_gold & F.col("first"), F.col("start_s"))),
                    "g1": ("max", F.when(of_gold & F.col("last"), F.col("end_s")))})


def _with_boundaries(o: Ordered) -> DataFrame:
    """Add ``b``, the internal boundary after each span; null where there is none or where it lies
    within 1e-6 s of the last one kept."""
    o = o.shift(prev={"_t": "t"})
    # An exact repeat never survives and never becomes the last one kept.
    fresh = F.col("t").isNotNull() & F.coalesce(F.col("t") != F.col("_t"), F.lit(True))
    o = o.with_columns({"_u": F.when(fresh, F.col("t"))}).running({"_t": ("last", "_u")})
    # A stretch ends where the next value is over 2 EPS from the one before: that one is kept or within EPS of the
    # last kept, so the next is over EPS from the last kept and starts afresh. Inside a stretch the fold decides.
    near = ~F.col("first") & F.coalesce(F.abs(F.col("_u") - F.col("_t")) <= 2 * EPS, F.col("_u").isNull())
    o = o.islands("_near", ~near)
    earlier = (Window.partitionBy(*o.keys, "_near").orderBy("idx")
               .rowsBetween(Window.unboundedPreceding, -1))
    kept = F.aggregate(F.collect_list("_u").over(earlier), F.lit(None).cast("double"), lambda last, x: F.when(
        last.isNull() | (F.abs(x - last) > EPS), x).otherwise(last))
    alone = F.col("_kept").isNull() | (F.abs(F.col("_u") - F.col("_kept")) > EPS)
    rows = o.df.withColumn("_kept", kept).withColumn("b", F.when(alone, F.col("_u")))
    return rows.drop("t", "_t", "_u", "_near", "_kept")


def _with_errors(rows: DataFrame, keys: Sequence[str], split: bool) -> DataFrame:
    """Add ``err``: distance from boundary ``b`` to the nearest one of the other side."""
    of_gold = F.col("side") == GOLD
    scans = {"_p": ("last", F.when(~of_gold, F.col("b"))), "_g": ("last", F.when(of_gold, F.col("b")))}
    o = ordered(rows, keys, ["b", "side", "idx"], split)
    o = o.running({f"{n}0": s for n, s in scans.items()})
    o = o.running({f"{n}1": s for n, s in scans.items()}, backwards=True)
    before = F.when(of_gold, F.col("_p0")).otherwise(F.col("_g0"))
    after = F.when(of_gold, F.col("_p1")).otherwise(F.col("_g1"))
    err = F.least(F.col("b") - before, after - F.col("b"))
    return o.df.withColumn("err", err).drop("_p0", "_g0", "_p1", "_g1")


def _snapped() -> tuple[Column, Column]:
    start = F.when(F.col("first") & F.col("g0").isNotNull(), F.least("g0", "end_s")).otherwise(F.col("start_s"))
    end = F.when(F.col("last") & F.col("g1").isNotNull(), F.greatest("g1", start)).otherwise(F.col("end_s"))
    return start, end


@by_size("pred", "gold")
def snap_ends(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS,
              split: bool | None = None) -> DataFrame:
    """Move the first start and the last end of an episode's predictions to its gold ends, never past
    the other end of the same span: (keys, idx, start_s, end_s). No gold: unchanged."""
    start, end = _snapped()
    return (_sided(pred, gold, keys, split).df.filter(F.col("side") == PRED)
            .select(*keys, "idx", start.alias("start_s"), end.alias("end_s")))


@by_size("pred", "gold")
def match_snapped(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS,
                  split: bool | None = None) -> DataFrame:
    """Matches at IoU 0.75 after ``snap_ends``."""
    return match(snap_ends(pred, gold, keys, split), gold, SNAPPED_IOU, keys, split=split)


@by_size("spans")
def internal_boundaries(spans: DataFrame, keys: Sequence[str] = RUN_KEYS,
                        split: bool | None = None) -> DataFrame:
    """Midpoints between neighbouring spans in index order, without repeats closer than 1e-6 s to the
    last one kept: (keys, b_idx, t)."""
    rows = _with_boundaries(_sided(spans, None, keys, split)).filter(F.col("b").isNotNull())
    return rows.select(*keys, F.col("idx").alias("b_idx"), F.col("b").alias("t"))


@by_size("left", "right")
def nearest_boundary(left: DataFrame, right: DataFrame, keys: Sequence[str] = RUN_KEYS,
                     split: bool | None = None) -> DataFrame:
    """Distance from every boundary (keys, b_idx, t) to the nearest one of the other side, both
    directions in one scan: (keys, side, b_idx, t, err); err is null when the other side is empty."""
    both = reduce(DataFrame.unionByName, (
        df.select(*keys, F.lit(side).alias("side"), F.col("b_idx").alias("idx"), F.col("t").alias("b"))
        for side, df in ((PRED, left), (GOLD, right))))
    return _with_errors(both, keys, split).select(
        *keys, F.when(F.col("side") == PRED, "left").otherwise("right").alias("side"),
        F.col("idx").alias("b_idx"), F.col("b").alias("t"), "err")


@by_size("pred", "gold")
def boundary_errors(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS,
                    split: bool | None = None) -> DataFrame:
    """Nearest-boundary distances of the gold and the predicted internal boundaries:
    (keys, side 'gold'/'pred', b_idx, t, err)."""
    rows = _with_errors(_with_boundaries(_sided(pred, gold, keys, split)), keys, split)
    return rows.filter(F.col("b").isNotNull()).select(
        *keys, F.when(F.col("side") == GOLD, "gold").otherwise("pred").alias("side"),
        F.col("idx").alias("b_idx"), F.col("b").alias("t"), "err")


# ---- per-episode counts ---------------------------------------------------------------------------

COUNT_COLUMNS = (
    ["n_pred", "n_gold"] + [f"m_{tag(t)}" for t in IOU_THRESHOLDS] + ["m_snapped"]
    + ["b_total"] + [f"b_hit_{tag(t)}" for t in TOLERANCES]
    + ["pb_total"] + [f"pb_hit_{tag(t)}" for t in TOLERANCES]
    + [f"dur_{kind}_{b.replace('-', '_')}" for b in BUCKETS for kind in ("n", "hit")])


def _variants(sided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions with a ``use`` array: untouched spans serve the plain and the end-snapped matching,
    a span moved by snapping appears once for each."""
    start, end = _snapped()
    rows = sided.filter(F.col("side") == PRED).withColumns({"_s": start, "_e": end})
    same = (F.col("start_s") == F.col("_s")) & (F.col("end_s") == F.col("_e"))
    plain, snapped = F.lit("plain"), F.lit("snapped")
    shared = F.struct("start_s", "end_s", F.array(plain, snapped).alias("use"))
    own = F.struct("start_s", "end_s", F.array(plain).alias("use"))
    moved = F.struct(F.col("_s").alias("start_s"), F.col("_e").alias("end_s"), F.array(snapped).alias("use"))
    pick = F.when(same, F.array(shared)).otherwise(F.array(own, moved))
    return rows.select(*keys, "idx", F.explode(pick).alias("_v")).select(*keys, "idx", "_v.*")


@by_size("pred", "gold")
def _counts_and_errors(pred: DataFrame, gold: DataFrame, keys: Sequence[str],
                       split: bool | None) -> tuple[DataFrame, DataFrame]:
    keys = list(keys)
    # Written once: everything below reads this table, and neither input again.
    sided = _sided(pred, gold, keys, split)
    sided = Ordered(durable(sided.rows), keys, sided.order, split)
    spans = durable(_with_errors(_with_boundaries(sided), keys, split).select(*keys, "side", "start_s", "end_s", "b", "err"))
    of_gold, has = F.col("side") == GOLD, F.col("b").isNotNull()
    bucket = iv.duration_bucket(iv.duration())

    def name(b: str, kind: str) -> str:
        return f"dur_{kind}_{b.replace('-', '_')}"

    sums = {"n_pred": ~of_gold, "n_gold": of_gold, "b_total": of_gold & has, "pb_total": ~of_gold & has}
    sums |= {f"b_hit_{tag(t)}": of_gold & (F.col("err") <= t) for t in TOLERANCES}
    sums |= {f"pb_hit_{tag(t)}": ~of_gold & (F.col("err") <= t) for t in TOLERANCES}
    sums |= {name(b, "n"): of_gold & (bucket == b) for b in BUCKETS}
    by_span = spans.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in sums.items()))

    gold = sided.df.filter(F.col("side") == GOLD)
    pairs = candidates(_variants(sided.df, keys), gold, IOU_THRESHOLDS[0], keys, split, carry=("use",))
    pairs = pairs.withColumn("use", F.explode("use")).filter((F.col("use") == "plain") | (F.col("iou") >= SNAPPED_IOU))
    plain, hit = F.col("use") == "plain", F.col("iou") >= 0.5
    g_bucket = iv.duration_bucket(iv.duration("g0", "g1"))
    hits = {f"m_{tag(t)}": plain & (F.col("iou") >= t) for t in IOU_THRESHOLDS} | {"m_snapped": ~plain}
    hits |= {name(b, "hit"): plain & hit & (g_bucket == b) for b in BUCKETS}
    by_match = greedy(pairs, [*keys, "use"], split).groupBy(*keys).agg(
        *(F.count_if(c).alias(n) for n, c in hits.items()))
    counts = by_span.join(by_match, keys, "left").na.fill(0, list(hits)).select(*keys, *COUNT_COLUMNS)
    errors = spans.filter(has).select(*keys, F.when(of_gold, "gold").otherwise("pred").alias("side"), "err")
    return counts, errors


def episode_counts(pred: DataFrame, gold: DataFrame, rows: DataFrame | None = None,
                   keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """Everything a corpus metric needs, as integer counts per episode.

    ``rows`` (keys plus any episode columns, such as family) lists the scored episodes; without it the
    episodes are those seen in either table. Plain and end-snapped matching share one candidate join.
    """
    counts, _ = _counts_and_errors(pred, gold, keys, split)
    if rows is None:
        return counts
    return rows.join(counts, list(keys), "left").na.fill(0, COUNT_COLUMNS)


# ---- corpus reports -------------------------------------------------------------------------------

def quantile(df: DataFrame, by: Sequence[str], value: str, p: float = 0.5, name: str = "quantile",
             small: bool = False) -> DataFrame:
    """Exact interpolated quantile per group.

    Equal values are counted first. With ``small`` (groups known to be small) the built-in percentile
    reads those counts. Otherwise the values are spread over at most some 200,000 logarithmic buckets
    per sign; running totals over the buckets tell which one or two hold the wanted ranks, and only
    their values are ranked, so no task ever gathers a group's values however large the corpus.
    """
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    if small:
        return counted.groupBy(*by).agg(F.percentile(value, p, F.col("_n")).alias(name))
    v = F.col(value)
    counted = counted.withColumn("_bucket", F.floor(F.signum(v) * F.floor(F.log1p(F.abs(v)) * 10_000)))
    totals = counted.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_in"))
    w = Window.partitionBy(*by)
    running = w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumns({"_before": F.sum("_in").over(running) - F.col("_in"), "_total": F.sum("_in").over(w)})
    pos = (F.col("_total") - 1) * F.lit(p)
    low, high = F.floor(pos), F.ceil(pos)

    def holds(rank: Column, size: str) -> Column:
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col(size))

    wanted = totals.filter(holds(low, "_in") | holds(high, "_in")).select(*by, "_bucket", F.col("_before").alias("_base"), "_total")
    near = counted.join(wanted, [*by, "_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_before", F.col("_base") + F.sum("_n").over(inside) - F.col("_n"))
    ends = near.groupBy(*by).agg(
        F.max(F.when(holds(low, "_n"), v)).alias("_lo"), F.max(F.when(holds(high, "_n"), v)).alias("_hi"),
        F.first(pos - low).alias("_w"))
    return ends.select(*by, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        (1 - F.col("_w")) * F.col("_lo") + F.col("_w") * F.col("_hi")).alias(name))


def pooled_columns() -> list[Column]:
    """Report columns over a table that already holds summed counts."""
    out = [F.col("n_pred").alias("segments_pred"), F.col("n_gold").alias("segments_gold"),
           F.col("m_0_5").alias("segments_matched"),
           iv.precision("m_0_5", "n_pred").alias("precision"), iv.recall("m_0_5", "n_gold").alias("recall"),
           iv.f1("m_0_5", "n_pred", "n_gold").alias("f1")]
    out += [iv.f1(f"m_{tag(t)}", "n_pred", "n_gold").alias(f"f1_at_{tag(t)}") for t in IOU_THRESHOLDS]
    out.append(iv.f1("m_snapped", "n_pred", "n_gold").alias("f1_snapped"))
    out += [F.try_divide(f"b_hit_{tag(t)}", "b_total").alias(f"boundary_recall_{tag(t)}") for t in TOLERANCES]
    out += [F.try_divide(f"pb_hit_{tag(t)}", "pb_total").alias(f"boundary_precision_{tag(t)}") for t in TOLERANCES]
    return out


def scopes(df: DataFrame, by: str | None) -> DataFrame:
    """Repeat rows under 'overall' and under their own ``by`` value, in column ``scope``."""
    if by is None:
        return df.withColumn("scope", F.lit("overall"))
    return df.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col(by).cast("string"))))


def report(counts: DataFrame, by: str | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Pooled corpus report per run: 'overall' plus one row per value of ``by``.

    Counts are pooled, not averaged per episode. ``errors`` (rows of ``boundary_errors`` with the ``by``
    column) adds the exact median distance of gold boundaries. Recall and precision of boundaries are
    null when there are none.
    """
    summed = scopes(counts, by).groupBy("run", "scope").agg(
        F.count("*").alias("episodes"), *(F.sum(c).alias(c) for c in COUNT_COLUMNS))
    out = summed.select("run", "scope", "episodes", *pooled_columns())
    if errors is not None:
        gold_side = scopes(errors.filter(F.col("side") == "gold"), by)
        median = quantile(gold_side, ["run", "scope"], "err", 0.5, "median_boundary_error")
        out = out.join(median, ["run", "scope"], "left")
    return out


def recall_by_duration(counts: DataFrame, by: str | None = None) -> DataFrame:
    """Pooled recall per gold-duration bucket; empty buckets are left out."""
    summed = scopes(counts, by).groupBy("run", "scope").agg(
        *(F.sum(c).alias(c) for c in COUNT_COLUMNS if c.startswith("dur_")))
    parts = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(f"dur_n_{b.replace('-', '_')}").alias("n"),
                               F.col(f"dur_hit_{b.replace('-', '_')}").alias("hits")) for b in BUCKETS))
    return (summed.select("run", "scope", F.explode(parts).alias("_b")).select("run", "scope", "_b.*")
            .filter(F.col("n") > 0).withColumn("recall", F.col("hits") / F.col("n")))


@by_size("pred", "gold")
def segmentation_score(pred: DataFrame, gold: DataFrame, threshold: float = 0.5,
                       keys: Sequence[str] = RUN_KEYS, split: bool | None = None) -> DataFrame:
    """Precision, recall and F1 per episode."""
    keys = list(keys)
    one = F.lit(1).cast("long")
    parts = [pred.select(*keys, one.alias("n_pred")), gold.select(*keys, one.alias("n_gold")),
             match(pred, gold, threshold, keys, split=split).select(*keys, one.alias("n_matched"))]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = union.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pred", "n_gold", "n_matched")))
    return counts.withColumns({"precision": iv.precision("n_matched", "n_pred"),
                               "recall": iv.recall("n_matched", "n_gold"),
                               "f1": iv.f1("n_matched", "n_pred", "n_gold")})


@by_size("pred", "gold")
def boundary_score(pred: DataFrame, gold: DataFrame, keys: Sequence[str] = RUN_KEYS,
                   split: bool | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Per episode: boundary recall and precision within each tolerance and the median error. Without
    gold boundaries the shares are null, with gold but no predicted ones they are 0."""
    keys = list(keys)
    errors = boundary_errors(pred, gold, keys, split)
    of_gold = F.col("side") == "gold"
    hits = {f"{name}_{tag(t)}": F.count_if(side & (F.col("err") <= t))
            for side, name in ((of_gold, "recall"), (~of_gold, "precision")) for t in TOLERANCES}
    sums = errors.groupBy(*keys).agg(F.count_if(of_gold).alias("n_gold"), F.count_if(~of_gold).alias("n_pred"),
                                     *(c.alias(n) for n, c in hits.items()))
    median = quantile(errors.filter(of_gold), keys, "err", 0.5, "median_error", small=not split)
    out = sums.join(median, keys, "left")
    if rows is not None:
        out = rows.select(*keys).join(out, keys, "left").na.fill(0, ["n_gold", "n_pred", *hits])

    def share(n: str) -> Column:
        den = F.col("n_gold") if n.startswith("recall") else F.col("n_pred")
        return F.when(F.col("n_gold") > 0, iv.ratio(n, den))

    return out.select(*keys, "n_gold", "n_pred", *(share(n).alias(n) for n in hits), "median_error")


def evaluate(pred: DataFrame, gold: DataFrame, rows: DataFrame, by: str | None = "family",
             split: bool | None = None) -> DataFrame:
    """A run's full report: per-episode counts and boundary errors pooled overall and by family."""
    counts, errors = _counts_and_errors(pred, gold, RUN_KEYS, split)
    counts = rows.join(counts, list(RUN_KEYS), "left").na.fill(0, COUNT_COLUMNS)
    return report(counts, by, errors.join(rows, list(RUN_KEYS)))
