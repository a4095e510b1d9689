"""Column functions on labels, vocabularies and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.intervals import col
from spanlake.schema import DISAGREEMENT, NONE_LABELS, STOPWORDS

_NO_STRINGS = "array<string>"


def strip(c) -> Column:
    """Trim every kind of white space (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def normal(c) -> Column:
    return F.lower(strip(c))


def empty() -> Column:
    return F.array().cast(_NO_STRINGS)


def split_list(c) -> Column:
    """Comma list to array: trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")


def clean_vocab(arr) -> Column:
    """Trim, drop blanks, keep the first spelling of each case-insensitive entry, in order."""
    kept = F.filter(F.transform(col(arr), strip), lambda x: x != "")
    lowered = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def words(c) -> Column:
    """Distinct lower-case words with underscores read as spaces."""
    spaced = strip(F.replace(F.lower(col(c)), F.lit("_"), F.lit(" ")))
    return F.array_distinct(F.filter(F.split(spaced, r"\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def snap_to_vocabulary(label, vocab) -> Column:
    """Closest vocabulary entry: exact, then case-insensitive (last spelling), then best word overlap
    (first entry on ties). Never a label outside the list; an empty list leaves the label alone."""
    label, vocab = col(label), col(vocab)
    same_case = F.filter(vocab, lambda v: F.lower(v) == F.lower(label))
    scored = F.transform(vocab, lambda v, i: F.struct(
        jaccard(words(label), words(v)).alias("score"), (-i).alias("rank"), v.alias("entry")))
    return (F.when(F.coalesce(F.size(vocab), F.lit(0)) <= 0, label)
            .when(F.array_contains(vocab, label), label)
            .when(F.size(same_case) > 0, F.try_element_at(same_case, F.lit(-1)))
            .otherwise(F.array_max(scored)["entry"]))


def tokens(label) -> Column:
    """Meaning-bearing words: lower case, ``_`` and ``-`` as spaces, stopwords dropped unless nothing
    would be left."""
    spaced = strip(F.translate(F.lower(col(label)), "_-", "  "))
    raw = F.array_distinct(F.filter(F.split(spaced, r"\s+"), lambda x: x != ""))
    kept = F.array_except(raw, F.array(*map(F.lit, STOPWORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def disagrees(first, second, schema_mode) -> Column:
    """Do two labels name different events? Exact under a closed vocabulary, word overlap otherwise."""
    a, b = tokens(first), tokens(second)
    differs = normal(first) != normal(second)
    return (F.when(col(schema_mode) | (F.size(a) == 0) | (F.size(b) == 0), differs)
            .otherwise(jaccard(a, b) < DISAGREEMENT))


def is_none(label) -> Column:
    return normal(label).isin(*NONE_LABELS)


def coerce(value, allowed, default: str) -> Column:
    v = normal(value)
    return F.when(v.isin(*allowed), v).otherwise(default)
