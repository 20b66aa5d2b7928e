"""robots rules as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import PATH, SCHEME, url_host, url_part


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs that the first rule of their scheme and host whose prefix their path has (by rule_no) allows, or none meets.

    ``rules``: scheme, host, rule_no, allow, path_prefix. URLs that do not parse are refused. A host's rules stay rows: a
    path offers its beginnings of the lengths that the host's prefixes have, each meets one rule at most (the first of its prefix),
    and the least rule number decides. So a row holds a host's lengths, not its rules, and each path is judged once.
    """
    at = ["__scheme", "__host"]
    parsed = urls.withColumns({"__scheme": F.lower(url_part(F.col("url"), SCHEME)), "__host": url_host(F.col("url")), "__path": F.coalesce(F.nullif(url_part(F.col("url"), PATH), F.lit("")), F.lit("/"))})
    parsed = parsed.where("__scheme <> '' and __host <> ''")
    named = rules.where("path_prefix is not null").select(F.col("scheme").alias("__scheme"), F.col("host").alias("__host"), F.col("path_prefix").alias("__start"), "rule_no", "allow")
    first = named.groupBy(*at, "__start").agg(F.min(F.struct("rule_no", "allow")).alias("__rule"))
    lengths = named.groupBy(*at).agg(F.collect_set(F.length("__start")).alias("__lengths"))
    offered = parsed.select(*at, "__path").distinct().join(lengths, at)
    offered = offered.select(*at, "__path", F.explode(F.filter("__lengths", lambda n: n <= F.length("__path"))).alias("__n"))
    met = offered.withColumn("__start", F.substr("__path", F.lit(1), F.col("__n"))).join(first, [*at, "__start"])
    judged = met.groupBy(*at, "__path").agg(F.min("__rule").alias("__rule"))
    return parsed.join(judged, [*at, "__path"], "left").where(F.coalesce(F.col("__rule.allow"), F.lit(True))).select(*urls.columns)
