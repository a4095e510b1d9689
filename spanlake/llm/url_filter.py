"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule runs its regular expression only on URLs that contain the rule's index token. Of a rule's literal tokens
the one that fewest URLs contain is the index token, counted over the URLs at hand. Everything is DataFrame
operations; the rule table is the only broadcast, and it is as long as the rule lists that the caller passes.

Null, empty or scheme-less URLs have an empty host and path and get the default verdict. Equal URLs are judged
once. Further columns of the input are not returned, so their names cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import written

#: (verdict, host and path prefix): fits the host and its subdomains where the path starts with the prefix.
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: (verdict, regular expression over the lower-cased URL, literal tokens that every match contains).
PATTERN_RULES = (
    ("block", r"(^|[^a-z0-9])casino([^a-z0-9]|$)", ("casino",)),
    ("block", r"(^|[^a-z0-9])poker([^a-z0-9]|$)", ("poker",)),
    ("block", r"(^|[^a-z0-9])(porn|xxx)([^a-z0-9]|$)", ()),
    ("block", r"://[^/?#]*[^a-z0-9]adult[^a-z0-9]", ("adult",)),
    ("block", r"[?&]replytocom=", ("replytocom",)),
)

#: Beyond so many rules the index is joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case."""
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))


def literal_tokens(prefix: str) -> list[str]:
    """Tokens of a host and path prefix that a fitting URL contains whole; the last may go on in the URL."""
    found = re.findall("[a-z0-9]+", prefix.lower())
    return found[:-1] if "/" in prefix and prefix[-1:].isalnum() else found


def rule_table(spark: SparkSession, host_rules, pattern_rules) -> DataFrame:
    """One row per rule: its text, verdict, regular expression, what it runs on, and its literal tokens."""
    rows = []
    for verdict, text in host_rules:
        host, slash, path = text.partition("/")
        rows.append((text, verdict, rf"^(?:[^/]*\.)?\Q{host.lower()}\E(?:\Q{slash + path}\E|$)" if not slash
                     else rf"^(?:[^/]*\.)?\Q{host.lower()}{slash}{path}\E", True, literal_tokens(text)))
    rows += [(text, verdict, text, False, list(tokens)) for verdict, text, tokens in pattern_rules]
    return spark.createDataFrame(rows, "text string, verdict string, regex string, is_host boolean, tokens array<string>")


def url_filter(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, *, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL: id, host, path, rule (the longest fitting host rule), verdict, pattern (the blocking or
    allowing pattern that fits, a block before an allow). The host rule decides, else the pattern, else default.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, host_rules, pattern_rules)
    few = len(host_rules) + len(pattern_rules) <= BROADCAST_RULES
    small = F.broadcast if few else (lambda df: df)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = rows.where("url is not null").select("url").distinct()
    by_token = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))

    # Rules without a literal token are indexed under the empty token, which every URL fetches.
    wanted = rules.select("text", F.explode("tokens").alias("token"))
    seen = by_token.join(small(wanted.select("token").distinct()), "token").groupBy("token").count()
    rarest = wanted.join(seen, "token", "left").groupBy("text").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = rules.join(rarest, "text", "left").select("text", "verdict", "regex", "is_host", F.coalesce("token", F.lit("")).alias("token"))

    probes = urls.select("url", F.explode(F.array_union(tokens_of(F.col("url")), F.array(F.lit("")))).alias("token"))
    subject = F.when(F.col("is_host"), F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.lower("url"))
    fits = probes.join(small(index), "token").where(F.rlike(subject, F.col("regex")))
    longest = F.struct(F.char_length("text").alias("n"), F.col("text"), F.col("verdict"))
    worst = F.struct((F.col("verdict") == "block").alias("n"), F.col("text"), F.col("verdict"))
    judged = fits.groupBy("url").agg(F.max(F.when(F.col("is_host"), longest)).alias("host_rule"),
                                     F.max(F.when(~F.col("is_host"), worst)).alias("pattern_rule"))
    # Written, so that the join below can split a URL that very many rows share.
    judged = written(judged.select(F.col("url").alias("key"), "host_rule", "pattern_rule"), "url-verdicts")

    apart = F.coalesce(F.col("url"), F.concat(F.lit("\0"), F.col("page_id").cast("string")))
    # As many verdicts as different URLs: no side is broadcast, however small its files are.
    return rows.join(judged.hint("merge"), apart == F.col("key"), "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("host_rule.text").alias("rule"),
        F.coalesce("host_rule.verdict", "pattern_rule.verdict", F.lit(default)).alias("verdict"),
        F.col("pattern_rule.text").alias("pattern"))


#: The same verdicts in DuckDB SQL, over the table pages.
SQL = r"""
WITH u AS (
  SELECT page_id, lower(url) AS url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, rhost, rpath) AS (VALUES """ + ", ".join(
    f"('{v}', '{t}', '{t.partition('/')[0]}', '{''.join(t.partition('/')[1:])}')" for v, t in HOST_RULES) + r"""),
p(verdict, pattern) AS (VALUES """ + ", ".join(f"('{v}', '{t}')" for v, t, _ in PATTERN_RULES) + r""")
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, hit.rule AS rule, coalesce(hit.verdict, pat.verdict, 'allow') AS verdict, pat.pattern AS pattern
FROM h
LEFT JOIN LATERAL (SELECT rule, verdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
                   ORDER BY length(rule) DESC, rule DESC LIMIT 1) hit ON true
LEFT JOIN LATERAL (SELECT pattern, verdict FROM p WHERE regexp_matches(url, pattern) ORDER BY verdict = 'block' DESC, pattern DESC LIMIT 1) pat ON true
"""
