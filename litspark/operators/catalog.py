"""The source catalogue, the action log, the search cache, and keyword search over them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import redact_headers, redact_map, redact_secrets, redact_url
from ..functions.urls import SCHEME, canonical_source_id, url_host, url_part

LOG_COLUMNS = ("agent_name", "action_type", "outcome", "source_name", "target_url", "request_summary", "audit_level")
CATALOG_COLUMNS = ("source_id", "canonical_url", "host", "source_type")
# Canonical URLs of known providers.
PROVIDERS = {
    "arxiv": "https://arxiv.org",
    "semantic_scholar": "https://api.semanticscholar.org",
    "crossref": "https://api.crossref.org",
    "openalex": "https://api.openalex.org",
    "serp": "https://serpapi.com",
}
EXPORT_ROWS = 10_000


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def _all_tokens(columns: Iterable[str]) -> Column:
    return tokens(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def build_token_index(docs: DataFrame, id_col: str, columns: Iterable[str]) -> DataFrame:
    """(token, id): each token of the columns once a row."""
    return docs.select(F.col(id_col).alias("id"), F.explode(_all_tokens(columns)).alias("token"))


def keyword_search(docs: DataFrame, columns: Iterable[str], query: str) -> DataFrame:
    """Rows that hold any token of ``query`` in the columns; all rows if it has none."""
    wanted = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    return docs.where(F.arrays_overlap(_all_tokens(columns), F.array(*map(F.lit, wanted)))) if wanted else docs


def search_many(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) of all matches of many queries (query_id, query), by the index."""
    wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token"))
    return index.join(wanted, "token").select("query_id", "id").distinct()


def history_filter(log: DataFrame, start=None, end=None, **equal) -> DataFrame:
    """Conjunction of the given equalities and an inclusive time range."""
    for column, value in equal.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    if start is not None:
        log = log.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        log = log.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return log


def search_history(log: DataFrame, query: str = "", most: int = 100, **filters) -> DataFrame:
    return keyword_search(history_filter(log, **filters), LOG_COLUMNS, query).orderBy(F.desc("ts"), F.desc("history_id")).limit(most)


def export_range(log: DataFrame, start, end, campaign_id=None, most: int = EXPORT_ROWS) -> DataFrame:
    """The newest ``most`` rows of the range as JSON."""
    rows = history_filter(log, start, end, campaign_id=campaign_id).orderBy(F.desc("ts"), F.desc("history_id")).limit(most)
    return rows.select("history_id", F.to_json(F.struct(*log.columns)).alias("json"))


def history_summary(log: DataFrame) -> DataFrame:
    """Per campaign: total, maps of counts by outcome and action, sources, first and last time."""
    counts = lambda c: log.groupBy("campaign_id", c).agg(F.count("*").alias("n")).groupBy("campaign_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    base = log.groupBy("campaign_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_set("source_name")).alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return base.join(counts("outcome"), "campaign_id").join(counts("action_type"), "campaign_id")


def history_stats(log: DataFrame) -> DataFrame:
    """(what, value, n): the total, counts by outcome and agent, and of sensitive rows, in one pass."""
    rows = log.groupBy("outcome", "agent_name").agg(F.count("*").alias("n"), F.count_if(F.col("audit_level") == "sensitive").alias("s"))
    part = lambda what, value, n: F.struct(F.lit(what).alias("what"), value.alias("value"), F.col(n).alias("n"))
    parts = F.array(part("total", F.lit(""), "n"), part("outcome", F.col("outcome"), "n"), part("agent", F.col("agent_name"), "n"), part("sensitive", F.lit(""), "s"))
    return rows.select(F.explode(parts).alias("p")).groupBy("p.what", "p.value").agg(F.sum("p.n").alias("n"))


def redact_log(log: DataFrame) -> DataFrame:
    """``log`` as it may be stored: URLs, free text, headers and maps redacted where present."""
    rules = {"target_url": redact_url, "request_summary": redact_secrets, "response_summary": redact_secrets, "reason": redact_secrets, "request_headers": redact_headers, "meta": redact_map}
    return log.withColumns({c: rule(F.col(c)) for c, rule in rules.items() if c in log.columns})


def valid_source_url(observations: DataFrame) -> DataFrame:
    return observations.where(F.coalesce(F.lower(url_part(F.col("canonical_url"), SCHEME)).isin("http", "https"), F.lit(False)))


def redact_catalog(observations: DataFrame) -> DataFrame:
    """Observations (canonical_url, source_type, reliability_score, topic_tags, ...) as catalogue rows with source_id and host."""
    rows = observations.withColumn("canonical_url", redact_url(F.col("canonical_url")))
    rows = valid_source_url(rows).withColumns({"source_id": canonical_source_id(F.col("canonical_url")), "host": url_host(F.col("canonical_url"))})
    rows = rows.withColumn("reliability_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("reliability_score", F.lit(0.5)))))
    for c in ("topic_tags", "information_types"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))))
    for c in ("search_hints", "meta"):
        if c in rows.columns:
            rows = rows.withColumn(c, redact_map(F.col(c)))
    return rows


def remember_sources(catalog: DataFrame | None, observations: DataFrame) -> DataFrame:
    """The catalogue after an upsert by source_id: newest values, created_at of the first, seen last at the newest.

    ``observations`` come from ``redact_catalog`` with ``seen_at``; ties go to the larger obs_id.
    """
    rows = observations.withColumns({"created_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")})
    if catalog is not None:
        rows = catalog.withColumn("seen_at", F.col("last_seen_at")).unionByName(rows, allowMissingColumns=True)
    held = [c for c in rows.columns if c not in ("source_id", "created_at", "seen_at")]
    newest = F.max_by(F.struct(*held), F.struct("seen_at", "obs_id"))
    return rows.groupBy("source_id").agg(newest.alias("v"), F.min("created_at").alias("created_at")).select("source_id", "v.*", "created_at")


def source_tags(catalog: DataFrame) -> DataFrame:
    """(source_id, tag, kind) of topic tags, information types and the type."""
    tagged = catalog.select("source_id", F.explode("topic_tags").alias("tag"), F.lit("topic").alias("kind"))
    if "information_types" in catalog.columns:
        tagged = tagged.unionByName(catalog.select("source_id", F.explode("information_types").alias("tag"), F.lit("information").alias("kind")))
    return tagged.unionByName(catalog.select("source_id", F.col("source_type").alias("tag"), F.lit("type").alias("kind"))).distinct()


def with_all_tags(sources: DataFrame, tags: DataFrame, wanted: list[str], kind: str = "topic") -> DataFrame:
    """Sources that carry every wanted tag."""
    wanted = sorted(set(wanted))
    if not wanted:
        return sources
    has = tags.where((F.col("kind") == kind) & F.col("tag").isin(wanted)).groupBy("source_id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(wanted))
    return sources.join(has, "source_id", "left_semi")


def by_tag(sources: DataFrame, tags: DataFrame, tag: str, kind: str, most: int = 50) -> DataFrame:
    found = sources.join(tags.where((F.col("tag") == tag) & (F.col("kind") == kind)).select("source_id"), "source_id", "left_semi")
    return found.orderBy(F.desc("reliability_score"), F.desc("last_seen_at"), "source_id").limit(most)


def search_sources(sources: DataFrame, tags: DataFrame, query: str = "", source_type: str | None = None, min_reliability: float | None = None, topic_tags: list[str] | None = None, most: int = 50) -> DataFrame:
    found = keyword_search(sources, CATALOG_COLUMNS, query)
    if source_type is not None:
        found = found.where(F.col("source_type") == source_type)
    if min_reliability is not None:
        found = found.where(F.col("reliability_score") >= min_reliability)
    return with_all_tags(found, tags, topic_tags or []).orderBy(F.desc("reliability_score"), F.desc("last_seen_at"), "source_id").limit(most)


def delete_sources(catalog: DataFrame, tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue and its tags without the given source_ids."""
    gone = ids.select("source_id").distinct()
    return catalog.join(gone, "source_id", "left_anti"), tags.join(gone, "source_id", "left_anti")


def removed_counts(catalog: DataFrame, tags: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row: sources and tags that ``delete_sources`` takes away, or, without ids, that the catalogue holds."""
    if ids is not None:
        gone = ids.select("source_id").distinct()
        catalog, tags = catalog.join(gone, "source_id", "left_semi"), tags.join(gone, "source_id", "left_semi")
    return catalog.agg(F.count("*").alias("sources")).join(F.broadcast(tags.agg(F.count("*").alias("tags"))))


def clear_catalog(catalog: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue and its tags without rows, and what was removed."""
    return catalog.limit(0), tags.limit(0), removed_counts(catalog, tags)


def source_profiles(sources: DataFrame, tags: DataFrame) -> DataFrame:
    """Each source with its sorted topic and information tags."""
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("tag"))))
    lists = tags.groupBy("source_id").agg(of("topic").alias("topics"), of("information").alias("informations"))
    empty = F.array().cast("array<string>")
    return sources.join(lists, "source_id", "left").withColumns({c: F.coalesce(c, empty) for c in ("topics", "informations")})


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """(source_type, n, average_reliability) and the whole as source_type null; 0.0 when empty."""
    return catalog.rollup("source_type").agg(F.count("*").alias("n"), F.coalesce(F.avg("reliability_score"), F.lit(0.0)).alias("average_reliability"))


def list_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order, without blanks and nulls."""
    return df.select(column).where(F.col(column) != "").distinct().orderBy(column)


def cache_put(cache: DataFrame | None, new: DataFrame) -> DataFrame:
    """The cache after an upsert on (query, source, paper_key): the row of the latest cached_at, then the latest pos, wins."""
    rows = new if cache is None else cache.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy("query", "source", "paper_key").orderBy(F.desc("cached_at"), F.desc("pos"))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def cache_get(cache: DataFrame, query: str, source: str | None = None, schema: str = "title string, year int") -> DataFrame:
    """Cached papers of a query, newest first; rows whose JSON does not parse are left out."""
    rows = cache.where(F.col("query") == query)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    rows = rows.withColumn("paper", F.from_json("paper_json", schema)).where(F.try_parse_json("paper_json").isNotNull())
    return rows.orderBy(F.desc("cached_at"), "paper_key")


def cache_papers(cache: DataFrame, query: str, source: str | None = None, schema: str = "title string, year int") -> DataFrame:
    """The papers alone of ``cache_get``."""
    return cache_get(cache, query, source, schema).select("paper.*")


def cache_has(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (query, source; null for any source) with ``cached``: whether the cache holds a row of it."""
    keys = cache.select("query", "source").distinct()
    keys = keys.unionByName(keys.select("query", F.lit(None).cast("string").alias("source"))).distinct().toDF("__query", "__source")
    found = wanted.join(keys, (F.col("query") == F.col("__query")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    return found.withColumn("cached", F.col("__query").isNotNull()).drop("__query", "__source")


def cache_clear(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cache without rows, and one row with the number of those removed."""
    return cache.limit(0), cache.agg(F.count("*").alias("removed"))


def cache_lookup(plan: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached papers of the plan's queries, queries to fetch)."""
    keys = ["source", "query"]
    return cache.join(plan.select(*keys).distinct(), keys, "left_semi").withColumn("cached", F.lit(True)), plan.join(cache.select(*keys).distinct(), keys, "left_anti")


def action_log_from_results(results: DataFrame) -> DataFrame:
    """Log rows of search results (campaign_id, source, query, n_papers, error)."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    return results.select(
        "campaign_id",
        F.col("source").alias("agent_name"),
        F.lit("discovery_search").alias("action_type"),
        F.col("query").alias("api_endpoint"),
        F.substring(F.when(failed, F.col("error")).otherwise(F.concat(F.col("n_papers").cast("string"), F.lit(" papers"))), 1, 500).alias("response_summary"),
        F.when(failed, "error").otherwise("success").alias("outcome"),
        F.coalesce("error", F.lit("")).alias("reason"),
        F.col("source").alias("source_name"),
        F.lit("normal").alias("audit_level"),
    )


def catalog_from_results(results: DataFrame, keywords: Column) -> DataFrame:
    """Catalogue observations of results from known providers."""
    urls = F.create_map(*[F.lit(x) for pair in PROVIDERS.items() for x in pair])
    rows = results.withColumn("canonical_url", F.try_element_at(urls, "source")).where("canonical_url is not null")
    return rows.select(
        "campaign_id",
        "canonical_url",
        F.lit("academic_api").alias("source_type"),
        F.array(*map(F.lit, ("paper_metadata", "abstracts", "citations"))).alias("information_types"),
        keywords.alias("topic_tags"),
        F.lit("api").alias("access_method"),
        F.lit(0.7).alias("reliability_score"),
        F.coalesce("error", F.lit("")).alias("quality_notes"),
    )
