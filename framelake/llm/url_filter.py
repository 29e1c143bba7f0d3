"""URL filter lists by host-suffix / path-prefix expressions and short hash prefixes; built-in functions only.

Each distinct URL is expanded into ``host suffix + path prefix`` expressions, expressions meet rules in an equi-join on
the first 32 bits of SHA-256, and the full digest then confirms the match.  Only suffixes of as many labels and prefixes
of the lengths that some rule has are expanded, since no other expression can equal a rule.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; repeated rows each get
the verdict of their URL; an empty page or rule table is fine; further columns of the pages are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) tuples as a relation whose size the optimizer knows."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS r(action, rule_host, rule_path)")


def filter_urls(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for every page: ``key, host, path, rule, verdict``.

    ``rules`` has (action, rule_host, rule_path).  A rule fits its host and all subdomains of it when the URL's path
    starts with the rule's path.  The longest rule (host plus path) wins; at equal length the longer host, then
    ``block``, then the later string.  The rule side is broadcast only if its known size is under Spark's own
    threshold; otherwise this is a sort-merge join on hash prefixes, where AQE splits a hot prefix.
    """
    rules = rules.select("action", "rule_host", "rule_path", F.concat("rule_host", "rule_path").alias("rule"))
    # both lists are bounded by the longest host and path, not by the number of rules
    labels = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]
    host, path = url_host(F.col("u")), url_path(F.col("u"))
    asked = pages.select(F.coalesce(F.col(url), F.lit("")).alias("u")).distinct().select("u", host.alias("host"), path.alias("path"))
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in labels]).cast("array<int>"), lambda k: k <= F.size(F.split("host", r"\."))),
        lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k),
    )
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    opened = asked.select("u", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    opened = opened.select("u", "suffix", F.explode("prefixes").alias("prefix"))
    opened = opened.select("u", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest")).select("u", "digest", F.substring("digest", 1, 8).alias("short"))
    listed = rules.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substring("rule_digest", 1, 8))
    met = opened.join(listed, "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), (F.col("action") == "block").alias("b"), "rule", "action")
    best = met.groupBy("u").agg(F.max(rank).alias("best"))
    return (
        pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("u"))
        .join(best, "u", "left")
        .select(F.col(key), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    )
