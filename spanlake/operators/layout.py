"""Ordered scans inside a group that stay bounded when one group is huge.

A window partitioned by episode puts the whole episode in one task. That is the best plan while every
episode is small, and a failure once a single episode holds a large share of the table. ``ordered``
gives both plans one interface:

* small groups: ordinary windows over the group, one shuffle;
* ``split=True``: the rows are range-sorted by (keys, order), so a hot group spans many partitions, and
  each range partition becomes a *chunk*. Every scan then runs per (group, chunk). What has to cross a
  chunk border goes through its edge rows only, at most two per chunk, gathered per group in a second
  window. No row is dropped and no group is ever held by one task.

Which group takes which plan is counted, never assumed: ``by_size`` wraps an operator, counts its groups and
sends only the large ones through the split plan; all others keep their windows in the same query.

Rules that look sequential are restated so that they are not: as an associative composition of maps
(``Ordered.scan``), as a path through successor pointers (``on_path``) or as a chain of yes and no (``chain_wins``), each in
a number of rounds that grows with the logarithm of a group.
"""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions.intervals import col

# Rows one group may hold before its scans are split into chunks.
SPLIT_ROWS = 2_000
# Keys of large groups that may be broadcast; beyond, the tables are divided by shuffle joins.
HOT_BROADCAST = 100_000

_CHUNK, _SEQ = "_chunk", "_seq"


def needs_split(df: DataFrame, keys: Sequence[str], limit: int = SPLIT_ROWS) -> bool:
    """True when some group of ``keys`` has more than ``limit`` rows (one map-side combined count)."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (top or 0) > limit


def decide(split: bool | None, *inputs: tuple[DataFrame, Sequence[str]]) -> bool:
    """Resolve a ``split`` argument for all groups alike: an explicit choice wins, None means measure the inputs."""
    if split is not None:
        return split
    return any(needs_split(df, keys) for df, keys in inputs)


def hot_groups(inputs: Sequence[DataFrame], keys: Sequence[str], limit: int = SPLIT_ROWS) -> DataFrame | None:
    """The groups with more than ``limit`` rows in one of the inputs, or None. They are at most the inputs' rows over
    the limit; the table is marked for broadcast only if its counted size allows that."""
    large = [df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys) for df in inputs]
    hot = durable(reduce(DataFrame.union, large).distinct())
    n = hot.count()
    if not n:
        return None
    return F.broadcast(hot) if n <= HOT_BROADCAST else hot


def divide(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of all other groups, rows of the hot groups); a null key is a group like any other."""
    named = hot.select(*(F.col(k).alias(f"_hot_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys))
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")


def _together(a, b):
    """The results of both branches as one."""
    if isinstance(a, tuple):
        return tuple(_together(x, y) for x, y in zip(a, b))
    return a.together(b) if hasattr(a, "together") else a.unionByName(b)


def by_size(*measured: str, keys: str | Sequence[str] = "keys", limit: int | None = None) -> Callable:
    """Decorator for an operator that works group by group and takes ``split``.

    With ``split=None`` the groups of the tables named by ``measured`` are counted. If some are large, every table
    argument that has the key columns is divided, the large groups go through the split plan and all others through
    windows, and the results are put together. ``keys``: the argument that names the group, or the columns.
    """
    def wrap(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            given = bound.arguments
            if given["split"] is not None:
                return operator(*bound.args, **bound.kwargs)
            by = list(given[keys] if isinstance(keys, str) else keys)
            hot = hot_groups([given[name] for name in measured if given[name] is not None], by, limit or SPLIT_ROWS)
            if hot is None:
                given["split"] = False
                return operator(*bound.args, **bound.kwargs)
            tables = {name: divide(v, hot, by) for name, v in given.items() if isinstance(v, DataFrame) and set(by) <= set(v.columns)}
            results = []
            for side, split in enumerate((False, True)):
                given.update({name: parts[side] for name, parts in tables.items()}, split=split)
                results.append(operator(*bound.args, **bound.kwargs))
            return _together(*results)
        return run
    return wrap


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    path = tempfile.mkdtemp(prefix="spanlake-")
    spark.conf.set("spark.checkpoint.dir", path)  # one folder a session
    return path


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; ``clear`` deletes all of this session's."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete the scratch paths of this session; results that still read them must be written before."""
    jvm = spark.sparkContext._jvm
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which survives the loss of executors and which
    ``clear`` deletes."""
    path = scratch(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCANS = {"sum": F.sum, "max": F.max, "min": F.min,
          "last": lambda c: F.last(c, ignorenulls=True)}

# Neighbours that one pass of an associative scan composes.
_RADIX = 8


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    return F.coalesce(here, before)


class Ordered:
    """Rows of each group in a total order. Methods add columns and return a new ``Ordered``."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[Column], split: bool):
        self.rows, self.keys, self.order, self.split = rows, tuple(keys), tuple(order), split

    def _with(self, rows: DataFrame) -> "Ordered":
        return Ordered(rows, self.keys, self.order, self.split)

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(_CHUNK, _SEQ) if self.split else self.rows

    def where(self, condition) -> "Ordered":
        return self._with(self.rows.filter(condition))

    def with_columns(self, columns: dict[str, Column]) -> "Ordered":
        return self._with(self.rows.withColumns(columns))

    def within(self, *names: str) -> "Ordered":
        """The same order inside finer groups (contiguous stretches named by ``names``)."""
        return Ordered(self.rows, (*self.keys, *names), self.order, self.split)

    def drop(self, *names: str) -> "Ordered":
        return self._with(self.rows.drop(*names))

    # -- windows ---------------------------------------------------------------------------------

    def _window(self, backwards: bool = False):
        by = list(self.order) if not self.split else [F.col(_SEQ)]
        if backwards:
            by = [c.desc() for c in by]
        keys = [*self.keys, _CHUNK] if self.split else list(self.keys)
        return Window.partitionBy(*keys).orderBy(*by)

    def _edges(self) -> tuple[DataFrame, object]:
        """Mark chunk edges; the returned window holds the edge rows of a group, all other rows stay
        in their chunk."""
        w = self._window()
        rows = self.rows.withColumns({
            "_at_first": F.lag(F.lit(1)).over(w).isNull(),
            "_at_last": F.lead(F.lit(1)).over(w).isNull()})
        rows = rows.withColumn("_at_lane", F.when(F.col("_at_first") | F.col("_at_last"), -1)
                               .otherwise(F.col(_CHUNK)))
        return rows, Window.partitionBy(*self.keys, "_at_lane")

    # -- scans -----------------------------------------------------------------------------------

    def shift(self, prev: dict | None = None, next: dict | None = None) -> "Ordered":
        """Values of the neighbouring row: ``prev={"new": column}``, ``next={"new": column}``."""
        wanted = [(name, col(c), F.lag, "_at_first") for name, c in (prev or {}).items()]
        wanted += [(name, col(c), F.lead, "_at_last") for name, c in (next or {}).items()]
        if not self.split:
            w = self._window()
            return self._with(self.rows.withColumns({n: f(c).over(w) for n, c, f, _ in wanted}))
        rows, lane = self._edges()
        w, across = self._window(), lane.orderBy(_SEQ)
        rows = rows.withColumns({f"_here_{n}": f(c).over(w) for n, c, f, _ in wanted})
        rows = rows.withColumns({f"_over_{n}": f(c).over(across) for n, c, f, _ in wanted})
        rows = rows.withColumns({n: F.when(F.col(edge), F.col(f"_over_{n}")).otherwise(F.col(f"_here_{n}"))
                                 for n, _, _, edge in wanted})
        return self._with(rows.drop("_at_first", "_at_last", "_at_lane",
                                    *(f"{p}{n}" for n, *_ in wanted for p in ("_here_", "_over_"))))

    def running(self, scans: dict[str, tuple[str, object]], inclusive: bool = False,
                backwards: bool = False) -> "Ordered":
        """Running ``sum``/``max``/``min``/``last`` (last = latest non-null) over the rows before this
        one, plus itself when ``inclusive``; ``backwards`` scans from the end of the group."""
        frame_end = 0 if inclusive else -1
        w = self._window(backwards)
        upto = w.rowsBetween(Window.unboundedPreceding, frame_end)
        if not self.split:
            out = {}
            for name, (kind, c) in scans.items():
                value = _SCANS[kind](col(c)).over(upto)
                out[name] = F.coalesce(value, F.lit(0)) if kind == "sum" else value
            return self._with(self.rows.withColumns(out))
        rows, lane = self._edges()
        enter, leave = ("_at_last", "_at_first") if backwards else ("_at_first", "_at_last")
        across = lane.orderBy(F.col(_SEQ).desc() if backwards else F.col(_SEQ))
        whole = w.rowsBetween(Window.unboundedPreceding, 0)
        inside = Window.partitionBy(*self.keys, _CHUNK)
        rows = rows.withColumns({f"_here_{n}": _SCANS[k](col(c)).over(upto) for n, (k, c) in scans.items()}
                                | {f"_sum_{n}": _SCANS[k](col(c)).over(whole) for n, (k, c) in scans.items()})
        rows = rows.withColumns({
            f"_in_{n}": _SCANS[k](F.when(F.col(leave), F.col(f"_sum_{n}")))
            .over(across.rowsBetween(Window.unboundedPreceding, -1)) for n, (k, _) in scans.items()})
        rows = rows.withColumns({
            f"_in_{n}": F.max(F.when(F.col(enter), F.col(f"_in_{n}"))).over(inside) for n in scans})
        rows = rows.withColumns({
            n: _combine(k, F.col(f"_in_{n}"), F.col(f"_here_{n}")) for n, (k, _) in scans.items()})
        return self._with(rows.drop("_at_first", "_at_last", "_at_lane",
                                    *(f"{p}{n}" for n in scans for p in ("_here_", "_sum_", "_in_"))))

    def scan(self, name: str, item: Column, combine: Callable[[Column, Column], Column]) -> "Ordered":
        """Running composition, this row included, of ``item`` by the associative ``combine(before, here)``; null items
        change nothing. A pass composes ``_RADIX`` neighbours at growing strides, so a group takes as many passes over
        the same window as its size has digits. Split, the chunks' totals are composed the same way in between."""
        rows = self.rows.withColumn(name, item)
        if not self.split:
            return self._with(_composed(rows, name, self._window(), combine, SPLIT_ROWS))
        chunk = [*self.keys, _CHUNK]
        inner = self._window()
        rows = durable(_composed(rows, name, inner, combine, _largest(self.rows, chunk))
                       .withColumn("_at_last", F.lead(F.lit(1)).over(inner).isNull()))
        totals = rows.filter("_at_last").select(*chunk, F.col(name).alias("_enter"))
        across = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        # One row a chunk and group.
        totals = _composed(totals, "_enter", across, combine, _largest(totals, self.keys)).withColumn("_enter", F.lag("_enter").over(across))
        named = totals.select(*(F.col(c).alias(f"_t{c}") for c in chunk), "_enter")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in chunk))
        both = F.when(F.col("_enter").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("_enter")).otherwise(combine(F.col("_enter"), F.col(name)))
        return self._with(rows.join(named, same, "left").withColumn(name, both).drop("_at_last", "_enter", *(f"_t{c}" for c in chunk)))

    def total(self, scans: dict[str, tuple[str, object]]) -> "Ordered":
        """``sum``/``max``/``min`` over the whole group, on every row."""
        if not self.split:
            w = Window.partitionBy(*self.keys)
            return self._with(self.rows.withColumns(
                {n: _SCANS[k](col(c)).over(w) for n, (k, c) in scans.items()}))
        rows, lane = self._edges()
        inside = Window.partitionBy(*self.keys, _CHUNK)
        rows = rows.withColumns({n: _SCANS[k](col(c)).over(inside) for n, (k, c) in scans.items()})
        rows = rows.withColumns({n: _SCANS[k](F.when(F.col("_at_last"), F.col(n))).over(lane)
                                 for n, (k, _) in scans.items()})
        rows = rows.withColumns({n: F.max(F.when(F.col("_at_last"), F.col(n))).over(inside) for n in scans})
        return self._with(rows.drop("_at_first", "_at_last", "_at_lane"))

    def number(self, name: str = "idx") -> "Ordered":
        """Position in the group, from 0."""
        if not self.split:
            return self._with(self.rows.withColumn(
                name, (F.row_number().over(self._window()) - 1).cast("long")))
        return self.running({name: ("sum", F.lit(1).cast("long"))})

    def islands(self, name: str, breaks: Column) -> "Ordered":
        """Number the stretches that start wherever ``breaks`` is true."""
        return self.running({name: ("sum", breaks.cast("long"))}, inclusive=True)


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence, split: bool | None = None) -> Ordered:
    """Order each group of ``keys`` by ``order``, which should end in a column that breaks ties."""
    split = decide(split, (df, keys))
    by = [col(c) for c in order]
    if split:
        df = df.repartitionByRange(*map(F.col, keys), *by).sortWithinPartitions(*map(F.col, keys), *by)
        df = durable(df.withColumns({_CHUNK: F.spark_partition_id(),
                                     _SEQ: F.monotonically_increasing_id()}))
    return Ordered(df, keys, by, split)


def _largest(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _composed(rows: DataFrame, name: str, window, combine: Callable[[Column, Column], Column], n: int) -> DataFrame:
    """The running composition of a column over windows of at most n rows."""
    nothing = F.lit(None).cast(rows.schema[name].dataType)
    stride = 1
    while stride < n:
        lags = [f"_lag{j}" for j in range(_RADIX - 1, 0, -1)]
        rows = rows.withColumns({lag: F.lag(name, stride * j).over(window) for lag, j in zip(lags, range(_RADIX - 1, 0, -1))})
        rows = rows.withColumn(name, F.aggregate(F.array(*lags, name), nothing, lambda a, x: F.when(a.isNull(), x).when(x.isNull(), a).otherwise(combine(a, x)))).drop(*lags)
        stride *= _RADIX
    return rows


# Rows one sequential fold may take at a time.
FOLD_ROWS = 2_000


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence, item: Column, state: Column,
                step, split: bool | None = None, rows: int = FOLD_ROWS) -> DataFrame:
    """Truly sequential recurrences, for rules that are neither a ``scan`` nor a path: ``step(state, item) -> state`` along
    the order of each group.

    Returns the item fields plus ``before`` and ``after``, the state on either side of each row. Groups
    are cut into slices of ``rows``; the first slices of all groups are folded together, their last
    states carried into the second slices, and so on, so no task ever holds more than one slice of a
    group. With groups under ``rows`` this is a single grouped fold.
    """
    keys = list(keys)
    source = ordered(df, keys, order, split)
    numbered = source.number("_pos").df.withColumn("_item", item)

    def run(slice_rows: DataFrame, start: Column, extra: list[Column]) -> DataFrame:
        lists = slice_rows.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_items"), *extra)

        def merge(acc, x):
            after = step(acc["state"], x["_item"])
            return F.struct(after.alias("state"), F.concat(acc["trail"], F.array(F.struct(
                x["_item"].alias("item"), acc["state"].alias("before"), after.alias("after")))).alias("trail"))

        empty_trail = F.filter(F.transform(F.slice("_items", 1, 1), lambda x: F.struct(
            x["_item"].alias("item"), start.alias("before"), step(start, x["_item"]).alias("after"))),
            lambda _: F.lit(False))
        folded = F.aggregate("_items", F.struct(start.alias("state"), empty_trail.alias("trail")), merge)
        return lists.select(*keys, folded.alias("_f"))

    def rows_of(folded: DataFrame) -> DataFrame:
        # No slice is empty; the outer form keeps the optimizer from folding once more to test for that.
        return folded.select(*keys, F.explode_outer("_f.trail").alias("_t")).select(
            *keys, "_t.item.*", F.col("_t.before").alias("before"), F.col("_t.after").alias("after"))

    if not source.split:
        biggest = 0  # the group sizes were measured small by the caller
    else:
        numbered = durable(numbered)
        biggest = numbered.agg(F.max("_pos")).first()[0] or 0
    if biggest < rows:
        return rows_of(run(numbered, state, []))
    done, carried = None, None
    for k in range(biggest // rows + 1):
        part = numbered.filter((F.col("_pos") >= k * rows) & (F.col("_pos") < (k + 1) * rows))
        if carried is None:
            folded = durable(run(part, state, []))
        else:
            folded = durable(run(part.join(carried, keys), F.col("_carried"),
                                 [F.first("_carried").alias("_carried")]))
        carried = folded.select(*keys, F.col("_f.state").alias("_carried"))
        done = rows_of(folded) if done is None else done.unionByName(rows_of(folded))
    return done


# ---- pointers -----------------------------------------------------------------------------------------

def last_within(start: Column, limit: Column | float) -> Column:
    """The largest double x for which x - start, as doubles subtract, does not exceed ``limit``. It turns a test on a
    difference into a comparison with a sort key without moving a single tie."""
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    about = start + limit
    # Half a unit in the last place of start, limit and their sum, whichever is largest.
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(about), F.abs(start), F.abs(limit), F.lit(1e-300)))) - 53)
    near = F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda k: about + k * unit)
    return F.array_max(F.filter(near, lambda x: x - start <= limit))


def first_beyond(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For queries among records whose values never fall along their positions: the first record beyond each.

    points (keys, v, kind, pos): kind 0 is a record that counts for queries below its value, 1 a query, 2 a record that counts for
    queries at its value too. Returns the queries (keys, pos, nxt); null where no record is beyond.
    """
    o = ordered(points, keys, ["v", "kind", "pos"], True)
    o = o.running({"nxt": ("min", F.when(F.col("kind") != 1, F.col("pos")))}, backwards=True)
    return o.df.filter("kind = 1").select(*keys, "pos", "nxt")


def on_path(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows (keys, pos) that are met from each group's ``start`` by following ``nxt``: (keys, pos). links: (keys, pos, nxt, start).

    Pointers double their length in every round while the rows met so far jump along them, so there are as many rounds as
    the longest path has binary digits.
    """
    keys = list(keys)
    on = [*keys, "pos"]
    jump = durable(links.filter("nxt IS NOT NULL").select(*on, "nxt"))
    met = durable(links.filter("start").select(*on))
    while True:
        new = durable(met.join(jump, on).select(*keys, F.col("nxt").alias("pos")))
        if new.isEmpty():
            return met
        met = met.unionByName(new)
        further = jump.select(*keys, F.col("pos").alias("nxt"), F.col("nxt").alias("_n"))
        jump = durable(jump.join(further, [*keys, "nxt"]).select(*on, F.col("_n").alias("nxt")))


def chain_wins(nodes: DataFrame, keys: Sequence[str], node: str, up: str) -> DataFrame:
    """Chains in which a node wins exactly if the one above loses: nodes (keys, node, up, ``wins``) -> the same, with ``wins`` of
    every node whose chain leads to one that is known. A null ``up`` ends a chain; its ``wins`` is true, false or unknown.

    A round follows two pointers at once, so the distance to the end of a chain falls to a quarter.
    """
    keys = list(keys)
    now = nodes.select(*keys, node, up, "wins", F.lit(True).alias("_flip"))

    def followed(df: DataFrame) -> DataFrame:
        above = df.select(*keys, F.col(node).alias(up), F.col(up).alias("_up"), F.col("wins").alias("_wins"), F.col("_flip").alias("_f"))
        j = df.filter(F.col(up).isNotNull()).join(above, [*keys, up])
        ended = F.col("_up").isNull()
        j = j.select(*keys, node, F.col("_up").alias(up), F.when(ended, F.col("_wins") != F.col("_flip")).alias("wins"),
                     (F.col("_flip") != F.col("_f")).alias("_flip"))
        return df.filter(F.col(up).isNull()).unionByName(j)

    now = durable(now)
    while not now.filter(F.col(up).isNotNull()).isEmpty():
        now = durable(followed(durable(followed(now))))
    return now.drop("_flip")
