"""URL filter by host-suffix and path-prefix expressions.

A URL expands into every suffix of its host at a label boundary joined with
every prefix of its path whose length some rule has.  Expressions meet rules
in an equi-join on a short hash prefix; the full digest confirms a match, and
the longest rule wins.  Distinct URLs are judged once, so a very common URL
or host costs no more than a rare one; rows of very common URLs meet their
verdict by broadcast, and rows without a URL take no part in any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import ascii_lower, checkpoint, join_counted, local_table, unused

#: (verdict, rule): host, a slash, and the rest of the path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of the short prefix; the rest of the digest is compared after the join.
PREFIX = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return local_table(spark, list(rules), "verdict string, rule string")


def split_url(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no '://'."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (verdict, rule); a rule fits its host and all subdomains if the
    url's path starts with the rule's.  The longest rule wins, then the one
    with the longer host, then the greater text, then `block` over `allow`.
    URLs that no rule fits get `default`.  Up to broadcast_rules rules are
    broadcast after a count; more are shuffled.  Null urls and those without
    `://` have an empty host and path.  Repeated rows are judged each; empty
    tables give no rows, and no rules give `default`.  Columns of pages called
    host, path, rule or verdict are replaced; others may have any name.
    """
    rule = F.col("rule")
    parts = rules.filter("rule IS NOT NULL AND instr(rule, '/') > 0").select(
        "verdict", "rule", ascii_lower(F.substring_index(rule, "/", 1)).alias("rule_host"), F.expr("substr(rule, instr(rule, '/'))").alias("rule_path")
    )
    digest = lambda host, path: F.sha2(F.concat_ws("\n", host, path), 256)
    parts = parts.select("verdict", "rule", "rule_host", digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"), F.char_length("rule_path").alias("n"))
    size = parts.agg(F.count("*"), F.collect_set("n")).first()
    lengths = sorted(size[1])
    parts = parts.drop("n").withColumn("short", F.substring("rule_digest", 1, PREFIX))

    url = F.col(url_col)
    named = F.coalesce(url.contains("://"), F.lit(False))
    urls = pages.filter(named).groupBy(url.alias("_url")).agg(F.count("*").alias("n_rows"))
    host, path = split_url(F.col("_url"))
    labels = F.split(F.col("_host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("_path"))
    expressions = (
        urls.select("_url", host.alias("_host"), path.alias("_path"))
        .select("_url", "_path", F.explode(suffixes).alias("_suffix"))
        .select("_url", "_path", "_suffix", F.explode(F.transform(prefixes, lambda n: n)).alias("_n"))
        .select("_url", digest(F.col("_suffix"), F.substring(F.col("_path"), F.lit(1), F.col("_n"))).alias("_digest"))
        .withColumn("short", F.substring("_digest", 1, PREFIX))
    )
    if size[0] <= broadcast_rules:
        met = expressions.join(F.broadcast(parts), "short")
    else:  # an expression like a whole top-level domain stands in very many urls
        met = join_counted(expressions, checkpoint(parts.join(expressions.groupBy("short").agg(F.count("*").alias("n_rows")), "short")), "short")
    order = F.struct(F.char_length("rule"), F.char_length("rule_host"), "rule", F.col("verdict") == "block", "verdict")
    best = met.filter("_digest = rule_digest").groupBy("_url").agg(F.max(order).alias("_best"))
    key, won = unused(pages.columns, "_url"), unused(pages.columns, "_best")
    judged = checkpoint(urls.join(best, "_url", "left").select(F.col("_url").alias(key), F.col("_best").alias(won), "n_rows"))
    own = pages.drop("host", "path", "rule", "verdict")
    found = join_counted(own.filter(named).withColumn(key, url), judged, key)
    found = found.unionByName(own.filter(~named).withColumns({key: F.lit(None).cast("string"), won: F.lit(None).cast(judged.schema[won].dataType)}))
    host, path = split_url(url)
    return found.select(*[f"`{c}`" for c in own.columns], host.alias("host"), path.alias("path"), F.col(f"{won}.rule").alias("rule"), F.coalesce(F.col(f"{won}.verdict"), F.lit(default)).alias("verdict"))
