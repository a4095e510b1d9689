"""One JSON document with a long list of records, read by as many tasks as its bytes deserve.

The document is read as text that ends at every closing brace, which Spark splits by byte ranges. A task cannot know whether its
part starts inside a string or how deep it is nested, but what a piece does to either is a sum: quotes flip the one, brackets
add to the other. Running sums in the order of the pieces (``layout.ordered``, split, so no task holds a document) tell both, and
with them where the list begins and ends and which closing braces end a record. Pieces of a record are put together and
parsed by its schema; what is outside the list is the document's header.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.layout import ordered

_STRING = r'"[^"]*"'


def _count(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, characters, ""))


def _outside(c: Column) -> Column:
    """Text without its strings; it must start outside of one."""
    return F.regexp_replace(F.regexp_replace(c, _STRING, ""), '"[^"]*$', "")


def _nesting(c: Column) -> Column:
    return _count(c, "{[") - _count(c, "}]")


def read_records(spark: SparkSession, paths: str | Sequence[str], field: str, record: T.StructType,
                 header: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(headers, records) of documents whose top-level ``field`` is a list of objects: headers (file, *header) without the
    list, records (file, pos, *record). Other lists and objects may stand anywhere beside it."""
    raw = spark.read.text(paths, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    # Escaped characters change nothing but must not look like quotes.
    bare = F.regexp_replace("value", r"\\.", "")
    o = ordered(raw.withColumns({"bare": bare, "flips": _count(bare, '"') % 2}), ["file"], ["block", "at"], True)
    o = o.running({"before": ("sum", "flips")}).number("piece").shift(next={"_after": "piece"})
    quoted, leaves = F.col("before") % 2 == 1, (F.col("before") + F.col("flips")) % 2 == 1
    # A piece that starts inside a string is read from that string's end; without one it is all string.
    plain = F.when(~quoted, F.col("bare")).when(F.contains("bare", F.lit('"')), F.regexp_replace("bare", '^[^"]*"', "")).otherwise("")
    o = o.with_columns({"plain": plain}).with_columns({"text": _outside(F.col("plain"))})
    # The brace that ended the piece is gone; it closes something unless it is part of a string.
    closes = ~leaves & F.col("_after").isNotNull()
    o = o.with_columns({"closes": closes, "change": _nesting(F.col("text")) - closes.cast("int")}).running({"depth": ("sum", "change")})
    opening = rf'"{field}"\s*:\s*\['
    lead = F.regexp_extract("plain", rf"^((?s:.*?)){opening}", 1)
    begins = F.col("plain").rlike(opening) & (F.col("depth") + _nesting(_outside(lead)) == 1)
    o = o.with_columns({"begins": begins}).running({"begun": ("max", F.col("begins").cast("int"))})
    # In the list, a piece at its level that starts with a bracket ends it; a list may also end in the piece that begins it.
    rest = F.regexp_extract("value", rf"^(?s:.*?){opening}((?s:.*))$", 1)
    begun = F.coalesce(F.col("begun") == 1, F.lit(False))
    ends = (begun & (F.col("depth") == 2) & ~quoted & F.col("value").rlike(r"^\s*\]")) | (F.col("begins") & rest.rlike(r"^\s*\]"))
    o = o.with_columns({"ends": ends}).running({"ended": ("max", F.col("ends").cast("int"))})
    inside = (begun | F.col("begins")) & F.coalesce(F.col("ended") == 0, F.lit(True)) & ~F.col("ends")
    # A last piece that is still inside the document ended with its brace; one after it is white space.
    full = F.concat("value", F.when(F.col("_after").isNotNull() | (F.col("depth") > 0), "}").otherwise(""))
    last = inside & F.col("closes") & (F.col("depth") + F.col("change") == 2)
    # The first piece belongs to the header up to the list, and to the first record from there.
    o = o.with_columns({"inside": inside, "last": last, "full": full}).running({"pos": ("sum", F.col("last").cast("long"))})
    rows = o.df
    body = F.when(F.col("begins"), F.regexp_extract("full", rf"^(?s:.*?){opening}((?s:.*))$", 1)).otherwise(F.col("full"))
    parts = rows.filter("inside").select("file", "pos", "piece", body.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "")
    records = parts.groupBy("file", "pos").agg(F.regexp_replace(joined, r"^\s*,?\s*", "").alias("json"))
    parsed = F.from_json("json", record.simpleString())
    records = records.filter(F.col("json") != "").select("file", "pos", parsed.alias("r")).select("file", "pos", "r.*")
    outer = F.when(F.col("begins") & ~F.col("ends"), F.regexp_extract("full", rf"^((?s:.*?){opening})", 1)).otherwise(F.col("full"))
    heads = rows.filter("begins OR NOT inside").select("file", "piece", outer.alias("part"))
    heads = heads.groupBy("file").agg(joined.alias("json")).select("file", F.from_json("json", header.simpleString()).alias("h"))
    return heads.select("file", "h.*"), records
