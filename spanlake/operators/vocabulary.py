"""Labels against one large shared vocabulary: the rule of ``text.snap_to_vocabulary`` as joins, for 10^5 entries and more.

The best entry by word overlap is found through an index of word sets. For every set of words that some entry contains, the index holds
one champion, the shortest such entry (the first of equals). The entry that overlaps a label best shares with it exactly some
set S; the champion of S has S too and is no longer, so it scores as high, and a label only asks for the champions of its own sets. Keys
are sets, so a word that half of the vocabulary has is no hot key.

Sets are counted out for up to ``SET_WORDS`` words. Pairs in which one side has more meet on single words instead: a label joins
its rarest words only, as many as any entry at least as good as its champion must share one of, and entries whose length rules such a
score out are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions import text
from spanlake.operators.layout import durable

#: Distinct words up to which all sets of a phrase's words are counted out (2^n - 1 of them).
SET_WORDS = 8


def _hashed(words: Column) -> Column:
    """Words as sorted 64-bit hashes."""
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def _sets(words: Column) -> Column:
    """All non-empty subsets of a sorted array, each in its order."""
    nothing = F.array().cast("array<array<bigint>>")
    return F.aggregate(words, nothing, lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(w))), F.array(F.array(w))))


def _score(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def snap_shared(labels: DataFrame, vocabulary: DataFrame, label: str = "label", entry: str = "entry", pos: str = "pos",
                name: str = "snapped", set_words: int = SET_WORDS) -> DataFrame:
    """labels with ``name``: the closest of the vocabulary's entries (entry, pos): the label itself if it is one, else
    the last entry that differs in case only, else the one of best word overlap, the first of equals; the first entry of all
    if no word is shared, the label if there are no entries. A null label stays null.

    Labels are told apart before anything is joined, so a label that a third of all rows have is one row here.
    """
    entries = durable(vocabulary.select(F.col(entry).alias("entry"), F.col(pos).cast("long").alias("pos")).filter("entry IS NOT NULL")
                      .withColumn("words", _hashed(text.words("entry"))).withColumn("n", F.size("words")))
    asked = labels.select(F.col(label).alias("label")).filter("label IS NOT NULL").distinct()
    exact = entries.select(F.col("entry").alias("label"), F.lit(True).alias("exact")).distinct()
    lowered = entries.groupBy(F.lower("entry").alias("low")).agg(F.max_by("entry", "pos").alias("same"))
    asked = asked.join(exact, "label", "left").withColumn("low", F.lower("label")).join(lowered, "low", "left")
    asked = durable(asked.select("label", F.when(F.col("exact"), F.col("label")).otherwise(F.col("same")).alias("found")))
    left = asked.filter("found IS NULL").select("label", _hashed(text.words("label")).alias("words")).withColumn("n", F.size("words"))
    left = durable(left)
    best = _best(left, entries, set_words)
    first = entries.agg(F.min_by("entry", "pos").alias("first"))  # one row
    solved = asked.join(best, "label", "left").crossJoin(F.broadcast(first))
    solved = solved.select("label", F.coalesce("found", "best", "first", "label").alias("_snap"))
    named = solved.select(F.col("label").alias("_label"), "_snap")
    return labels.join(named, F.col(label) == F.col("_label"), "left").drop("_label").withColumnRenamed("_snap", name)


def _best(left: DataFrame, entries: DataFrame, set_words: int) -> DataFrame:
    """(label, best) of the labels that share a word with an entry."""
    short, small = left.filter(F.col("n") <= set_words), entries.filter(F.col("n") <= set_words)
    index = small.select(F.explode(_sets(F.col("words"))).alias("s"), "n", "pos", "entry").groupBy("s").agg(
        F.min(F.struct("n", "pos", "entry", F.lit(0).alias("_"))).alias("e"))
    # The champion may share more than the set it was asked by; another set of the label then finds that.
    asked = short.select("label", F.col("n").alias("a"), F.explode(_sets(F.col("words"))).alias("s"))
    score = _score(F.size("s"), F.col("a"), F.col("e.n"))
    found = asked.join(index, "s").select("label", F.struct(score.alias("score"), (-F.col("e.pos")).alias("rank"), F.col("e.entry").alias("entry")).alias("c"))
    champions = durable(found.groupBy("label").agg(F.max("c").alias("c")))
    # Pairs with a long side. Without a champion any shared word will do.
    long_entries = entries.filter(F.col("n") > set_words)
    both = left.join(champions, "label", "left").withColumn("t", F.coalesce("c.score", F.lit(0.0)))
    parts = [champions]
    for some, others in ((both.filter(F.col("n") <= set_words), long_entries), (both.filter(F.col("n") > set_words), entries)):
        parts.append(_by_words(some, others))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("label").agg(F.max("c").alias("c")).select("label", F.col("c.entry").alias("best"))


def _by_words(some: DataFrame, entries: DataFrame) -> DataFrame:
    """(label, c) of the pairs that share a word among the label's rarest ones and may reach the score t."""
    postings = entries.select(F.explode("words").alias("w"), "pos")
    rarity = postings.groupBy("w").agg(F.count("*").alias("df"))
    each = some.select("label", "n", "t", F.explode("words").alias("w")).join(rarity, "w").groupBy("label").agg(
        F.first("n").alias("a"), F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("df", "w"))).alias("by_rarity"))
    # Words that no entry has cannot be shared, so at least ceil(t * a) of those left must be.
    need = F.greatest(F.ceil(F.col("t") * F.col("a") - 1e-9), F.lit(1))
    prefix = F.size("by_rarity") - need + 1
    asked = each.filter(prefix > 0).select("label", "a", "t", F.explode(F.slice("by_rarity.w", 1, prefix.cast("int"))).alias("w"))
    fits = (F.col("n") >= F.col("t") * F.col("a") - 1e-9) & (F.col("n") * F.col("t") <= F.col("a") + 1e-9)
    pairs = asked.join(postings, "w").select("label", "a", "t", "pos").distinct()
    pairs = pairs.join(entries.select("pos", "entry", F.col("words").alias("e_words"), "n"), "pos").filter(fits)
    pairs = pairs.join(some.select("label", "words"), "label")
    shared = F.size(F.array_intersect("words", "e_words"))
    return pairs.select("label", F.struct(_score(shared, F.col("a"), F.col("n")).alias("score"), (-F.col("pos")).alias("rank"), "entry").alias("c"))
