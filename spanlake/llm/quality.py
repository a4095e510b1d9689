"""Quality rules with adaptive thresholds.

Every document gets a few integer measures. For each (lang, source) the measures fill fixed-grid histograms, which
are quantile sketches: adding two of them merges them exactly, each quantile is right to one grid step, and the
result does not depend on the order of the rows, so a task that runs again cannot change a verdict. Groups with few
documents take the merged sketch of their language, small languages that of the corpus. A document is dropped where
it lies beyond the fence of its group: third quartile + 3 times the interquartile range + a slack per measure.

Null texts count as empty. Null lang or source is a group of its own. Only the columns named here are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import written

#: Measure: (numerator, denominator, steps per unit, slack in steps, last step). A value beyond the last step counts there.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1000, 50, 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 400, 1000),
    "repeats": ("n_repeat_words", "n_words", 1000, 400, 1000),
    "word_length": ("word_chars", "n_words", 100, 400, 5000),
}
#: Documents that a group needs for a threshold of its own.
MIN_ROWS = 200
#: Up to so many (lang, source) groups the thresholds are broadcast, beyond it they are joined by shuffle.
BROADCAST_GROUPS = 50_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_features(df: DataFrame, text: Column) -> DataFrame:
    """Add the base measures of a text.

    Equal 3-word windows are found by the 64-bit hashes of their words. Sorting (hash, position) pairs brings them
    together, which only texts that repeat a hash at all need.
    """
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    df = df.select("*", words.alias("_w"))
    df = df.select("*", F.size("_w").alias("_n"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
                   F.expr("""transform(if(size(_w) < 3, array(), arrays_zip(slice(_w, 1, size(_w) - 2), slice(_w, 2, size(_w) - 2), slice(_w, 3, size(_w) - 2))),
                                       x -> xxhash64(x.`0`, x.`1`, x.`2`))""").alias("_h"))
    repeated = """
      aggregate(
        sort_array(transform(array(sort_array(transform(_h, (x, i) -> struct(x AS h, i AS p)))),
          s -> transform(filter(s, (x, i) -> x.h = get(s, i - 1).h OR x.h = get(s, i + 1).h), x -> x.p))[0]),
        struct(0 AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"""
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return df.select(
        "*", long(F.col("_n")).alias("n_words"), long(F.char_length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.when(F.col("_lines").isNotNull(), F.size("_lines"))).alias("n_lines"),
        long(F.when(F.col("_lines").isNotNull(), F.size("_lines") - F.size(F.array_distinct("_lines")))).alias("n_dup_lines"),
        F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.expr(repeated)).otherwise(0).cast("long").alias("n_repeat_words"),
    ).drop("_w", "_n", "_lines", "_h")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def step(name: str) -> Column:
    """The grid step of a measure, in whole numbers throughout."""
    over, under, scale, _, last = MEASURES[name]
    return F.least(F.expr(f"{scale} * {over} div greatest({under}, 1)"), F.lit(last))


def thresholds(features: DataFrame) -> DataFrame:
    """Per (lang, source): the steps at which each measure is too high, and for word_length also too low."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), step(m).alias("step")) for m in MEASURES]))
    own = features.where(~base_failed()).select("lang", "source", grid.alias("g")).groupBy(
        "lang", "source", "g.measure", "g.step").agg(F.count("*").alias("n"))
    own = written(own, "quality-sketches")
    levels = [own.withColumn("level", F.lit(0)),
              own.groupBy("lang", "measure", "step").agg(F.sum("n").alias("n")).withColumns({"source": F.lit(None).cast("string"), "level": F.lit(1)}),
              own.groupBy("measure", "step").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "level": F.lit(2)})]
    sketches = levels[0].unionByName(levels[1]).unionByName(levels[2])
    # At most as many rows a window as the grid has steps.
    key = Window.partitionBy("level", "lang", "source", "measure")
    at = sketches.withColumns({"below": F.sum("n").over(key.orderBy("step")), "total": F.sum("n").over(key)})
    quartile = lambda q: F.min(F.when(4 * F.col("below") >= q * F.col("total"), F.col("step")))
    slack = F.create_map(*[x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[3]))])[F.col("measure")]
    fences = at.groupBy("level", "lang", "source", "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("total")).select(
        "level", "lang", "source", "measure", "total", (F.col("q3") + 3 * (F.col("q3") - F.col("q1")) + slack).alias("hi"),
        (F.col("q1") - 3 * (F.col("q3") - F.col("q1")) - slack).alias("lo"))
    wide = fences.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("measure") == m, F.col("hi"))).alias(f"hi_{m}") for m in MEASURES],
        F.max(F.when(F.col("measure") == "word_length", F.col("lo"))).alias("lo_word_length"))
    limits = [f"hi_{m}" for m in MEASURES] + ["lo_word_length"]
    pick = lambda level, *keys: wide.where(F.col("level") == level).select(
        F.col("level").alias(f"level{level}"), *[F.col(k).alias(f"{k}{level}") for k in keys], F.col("total").alias(f"total{level}"), F.struct(*limits).alias(f"t{level}"))
    joined = pick(0, "lang", "source").join(pick(1, "lang"), F.col("lang0").eqNullSafe(F.col("lang1"))).join(pick(2), F.col("level0") + 2 == F.col("level2"))
    best = F.when(F.col("total0") >= MIN_ROWS, F.col("t0")).when(F.col("total1") >= MIN_ROWS, F.col("t1")).otherwise(F.col("t2"))
    return written(joined.select(F.col("lang0").alias("t_lang"), F.col("source0").alias("t_source"), best.alias("t")), "quality-thresholds")


def within() -> Column:
    """True where no measure lies beyond its fence; groups without a threshold have base failures only."""
    inside = [step(m) <= F.col(f"t.hi_{m}") for m in MEASURES] + [step("word_length") >= F.col("t.lo_word_length")]
    out = inside[0]
    for x in inside[1:]:
        out = out & x
    return F.coalesce(out, F.lit(True))


def judge(docs: DataFrame, *, keep_rows: bool = False) -> DataFrame:
    """Measures, base_failed and kept of every document: doc_id, n_words, ..., or with keep_rows the whole row as row."""
    carried = [F.struct("*").alias("row")] if keep_rows else []
    narrow = docs.select(*carried, F.col("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string").alias("_text"))
    features = written(with_features(narrow, F.col("_text")).drop("_text"), "quality-features")
    limits = thresholds(features)
    few = limits.count() <= BROADCAST_GROUPS
    joined = features.join(F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select(*(["row"] if keep_rows else []), "doc_id", *FEATURES, base_failed().alias("base_failed"), (~base_failed() & within()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judge(docs, keep_rows=True).where("kept").select("row.*")


_STEPS = "\n UNION ALL ".join(
    f"SELECT lang, source, doc, '{m}' AS measure, least({scale} * {over} // greatest({under}, 1), {last}) AS step, {slack} AS slack FROM f"
    for m, (over, under, scale, slack, last) in MEASURES.items())

#: CTEs in DuckDB SQL over a relation docs_in(doc_id, text, lang, source); the last, judged, has a row per document.
CTES = rf"""
d AS (SELECT row_number() OVER () AS doc, doc_id, lang, source, coalesce(text, '') AS text FROM docs_in),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda j: words[j:j + 2])) AS tri FROM w WHERE len(words) >= 3),
gg AS (SELECT doc, i, count(*) OVER (PARTITION BY doc, tri) AS n FROM g),
rep AS (SELECT doc, count(DISTINCT pos) AS n FROM (SELECT doc, unnest([i, i + 1, i + 2]) AS pos FROM gg WHERE n >= 2) GROUP BY doc),
f AS (SELECT w.doc, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT x.*, b.base_failed FROM ({_STEPS}) x JOIN b USING (doc)),
q AS (SELECT CASE WHEN grouping(lang) = 1 THEN 2 WHEN grouping(source) = 1 THEN 1 ELSE 0 END AS level, lang, source, measure,
             count(*) AS total, list_sort(list(step)) AS steps, max(slack) AS slack
      FROM s WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))),
qq AS (SELECT *, steps[CAST(ceil(total / 4.0) AS BIGINT)] AS q1, steps[CAST(ceil(3 * total / 4.0) AS BIGINT)] AS q3 FROM q),
fence AS (SELECT level, lang, source, measure, total, q3 + 3 * (q3 - q1) + slack AS hi,
                 CASE WHEN measure = 'word_length' THEN q1 - 3 * (q3 - q1) - slack END AS lo FROM qq),
best AS (SELECT a.lang, a.source, a.measure,
                CASE WHEN a.total >= {MIN_ROWS} THEN a.hi WHEN l.total >= {MIN_ROWS} THEN l.hi ELSE c.hi END AS hi,
                CASE WHEN a.total >= {MIN_ROWS} THEN a.lo WHEN l.total >= {MIN_ROWS} THEN l.lo ELSE c.lo END AS lo
         FROM fence a JOIN fence l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM a.lang AND l.measure = a.measure
                      JOIN fence c ON c.level = 2 AND c.measure = a.measure WHERE a.level = 0),
bad AS (SELECT DISTINCT s.doc FROM s JOIN best t ON s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source AND s.measure = t.measure
        WHERE s.step > t.hi OR s.step < t.lo),
judged AS (SELECT b.*, NOT base_failed AND doc NOT IN (SELECT doc FROM bad) AS kept FROM b)"""

SQL = f"""
WITH docs_in AS (SELECT doc_id, text, lang, source FROM documents), {CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""
