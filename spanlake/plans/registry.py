"""Named queries over the fixture tables, each with equivalent SQL for checking where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlake import fixtures
from spanlake.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared SQL building blocks, in dependency order.
BLOCKS: list[str] = [fixtures.SQL]


def block(sql: str) -> None:
    BLOCKS.append(sql.strip())


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` may use every block defined so far. The registered
    callable takes ``split`` to choose the plan for hot groups instead of measuring."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir, split=None: fn(Tables(spark, sf_dir, split))
        if sql is not None:
            ORACLES[name] = "WITH " + ",\n".join(b.strip() for b in BLOCKS) + "\n" + sql.strip()
        return fn
    return wrap


def iou_sql(a0: str, a1: str, b0: str, b1: str) -> str:
    inter = f"greatest(0.0::DOUBLE, least({a1},{b1})-greatest({a0},{b0}))"
    union = f"(({a1}-{a0})+({b1}-{b0})-{inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter}/{union} ELSE 0.0::DOUBLE END)"


def cov_sql(p0: str, p1: str, g0: str, g1: str) -> str:
    return (f"(CASE WHEN {g1} > {g0} THEN greatest(0.0::DOUBLE, least({p1},{g1})-greatest({p0},{g0}))"
            f"/({g1}-{g0}) ELSE 0.0::DOUBLE END)")


def greedy_sql(source: str, keys: str = "run, episode_id") -> str:
    """Greedy one-to-one matching as a list fold (the first element only carries the empty state)."""
    item = "{'p': p_idx, 'g': g_idx, 'iou': iou, 'n': -iou, 'acc': []::STRUCT(p BIGINT, g BIGINT, iou DOUBLE)[]}"
    dummy = "{'p': -1::BIGINT, 'g': -1::BIGINT, 'iou': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'acc': []::STRUCT(p BIGINT, g BIGINT, iou DOUBLE)[]}"
    step = ("lambda a, x: {'p': -1::BIGINT, 'g': -1::BIGINT, 'iou': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'acc': "
            "CASE WHEN len(list_filter(a.acc, lambda m: m.p = x.p OR m.g = x.g)) > 0 THEN a.acc "
            "ELSE list_append(a.acc, {'p': x.p, 'g': x.g, 'iou': x.iou}) END}")
    return f"""
  SELECT {keys}, m.p AS p_idx, m.g AS g_idx, m.iou AS iou FROM (
    SELECT {keys}, unnest(list_reduce(list_prepend({dummy}, list({item} ORDER BY iou DESC, p_idx, g_idx)), {step}).acc) AS m
    FROM {source} GROUP BY {keys})"""


def f1_sql(m: str, p: str, g: str) -> str:
    pr, rc = (f"(CASE WHEN {d} > 0 THEN {m}::DOUBLE/{d} ELSE 0.0::DOUBLE END)" for d in (p, g))
    return f"(CASE WHEN {pr}+{rc} > 0 THEN 2*{pr}*{rc}/({pr}+{rc}) ELSE 0.0::DOUBLE END)"


def ratio_sql(n: str, d: str) -> str:
    return f"(CASE WHEN {d} > 0 THEN {n}::DOUBLE/{d} ELSE 0.0::DOUBLE END)"
