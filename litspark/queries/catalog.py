"""Queries of the source catalogue, the action log, the search cache and keyword search."""

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators.token_index import TokenIndex
from ..registry import query
from .sources import _shared
from ..testviews import table, view

_LOG = " || ' ' || ".join(f"coalesce({c}, '')" for c in C.LOG_COLUMNS)
_TOK = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
_HIT = lambda *w: " OR ".join(f"list_contains({_TOK.format(x=_LOG)}, '{x}')" for x in w)
_ID = "lower(regexp_replace(regexp_extract(canonical_url, '^[a-z]+://[^?#]*'), '/+$', ''))"
_OBS = f"o AS (SELECT obs_id, {_ID} AS source_id, canonical_url, source_type, greatest(0.0, least(1.0, reliability_score)) AS reliability_score, topic_tag, obs_id % 100 AS seen FROM v_sources)"
_CAT = f"{_OBS}, cat AS (SELECT source_id, arg_max(source_type, obs_id) AS source_type, arg_max(reliability_score, obs_id) AS reliability_score, arg_max(topic_tag, obs_id) AS topic_tag, max(obs_id) AS obs_id, min(obs_id) AS first_obs FROM o GROUP BY 1)"
_CACHE = "ca AS (SELECT 'q' || (paper_id % 7) AS query, source, coalesce(lower(doi), paper_id::VARCHAR) AS paper_key, paper_id AS pos FROM v_papers), c AS (SELECT query, source, paper_key, max(pos) AS pos FROM ca GROUP BY 1, 2, 3)"


def _observations(spark, d):
    o = view(spark, d, "v_sources").withColumns({"seen_at": F.timestamp_seconds(F.col("obs_id")), "topic_tags": F.array("topic_tag", "topic_tag")}).drop("topic_tag")
    return C.redact_catalog(o)


def _catalog(spark, d):
    return C.remember_sources(None, _observations(spark, d))


def _cache(spark, d):
    p = view(spark, d, "v_papers")
    rows = p.select(
        F.concat(F.lit("q"), (F.col("paper_id") % 7).cast("string")).alias("query"),
        "source",
        F.coalesce(F.lower("doi"), F.col("paper_id").cast("string")).alias("paper_key"),
        F.when(F.col("paper_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("title", "year"))).alias("paper_json"),
        F.timestamp_seconds(F.col("paper_id")).alias("cached_at"),
        "pos",
    )
    return C.cache_put(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))


def _results(spark, d):
    c = view(spark, d, "v_campaigns")
    return c.select("campaign_id", F.when(c.campaign_id % 3 == 0, "arxiv").when(c.campaign_id % 3 == 1, "crossref").otherwise("custom").alias("source"), "query", c.max_sources.alias("n_papers"), F.when(c.campaign_id % 5 == 0, F.repeat(F.lit("x"), 600)).alias("error"))


@query("joi_07_keyword_search", f"SELECT history_id FROM v_log WHERE {_HIT('purchase', 'abcdef10007')}")
def _(spark, d):
    return C.keyword_search(view(spark, d, "v_log"), C.LOG_COLUMNS, "Purchase? OR-abcdef10007!").select("history_id")


@query("joi_07b_search_many", f"SELECT q AS query_id, history_id AS id FROM (VALUES (1, 'purchase'), (2, 'agent3')) v(q, w), v_log WHERE list_contains({_TOK.format(x=_LOG)}, w)")
def _(spark, d):
    queries = spark.createDataFrame([(1, "purchase"), (2, "Agent3 ...")], "query_id int, query string")
    return C.search_many(C.build_token_index(view(spark, d, "v_log"), "history_id", C.LOG_COLUMNS), queries)


@query("joi_07c_search_stored_index", f"SELECT history_id AS id, 1 + (list_contains({_TOK.format(x=_LOG)}, 'purchase') AND list_contains({_TOK.format(x=_LOG)}, 'agent3'))::BIGINT AS words FROM v_log WHERE history_id % 5 <> 2 AND ({_HIT('purchase', 'agent3')})")
def _(spark, d):
    """Two segments that overlap, a removal and a merge between them."""
    log, index = view(spark, d, "v_log"), TokenIndex(spark, _shared(spark, "tokens"), buckets=16)
    index.add(log.where("history_id % 3 <> 0").withColumn("agent_name", F.lit("agent3")), "history_id", C.LOG_COLUMNS)
    index.merge()
    index.add(log, "history_id", C.LOG_COLUMNS)
    index.remove(log.where("history_id % 5 = 2").select(F.col("history_id").alias("id")))
    return index.search("Purchase? OR: agent3".replace("OR", ""))


@query("joi_08_build_token_index", f"SELECT history_id AS id, unnest(list_distinct({_TOK.format(x=_LOG)})) AS token FROM v_log")
def _(spark, d):
    return C.build_token_index(view(spark, d, "v_log"), "history_id", C.LOG_COLUMNS)


@query("fil_10_history_filter", "SELECT history_id FROM v_log WHERE campaign_id = 3 AND outcome = 'success' AND ts >= (SELECT min(ts) FROM v_log) AND ts <= TIMESTAMP '2030-01-01'")
def _(spark, d):
    return C.history_filter(view(spark, d, "v_log"), start="1990-01-01", end="2030-01-01", campaign_id=3, outcome="success", agent_name=None).select("history_id")


@query("srt_04_search_history", f"SELECT history_id, ts FROM v_log WHERE campaign_id = 3 AND ({_HIT('click')}) ORDER BY ts DESC, history_id DESC LIMIT 100")
def _(spark, d):
    return C.search_history(view(spark, d, "v_log"), "click", campaign_id=3).select("history_id", "ts")


@query("srt_05_export_range", "SELECT history_id FROM v_log WHERE campaign_id = 4 ORDER BY ts DESC, history_id DESC LIMIT 10000")
def _(spark, d):
    return C.export_range(view(spark, d, "v_log"), "1990-01-01", "2030-01-01", 4).where("json like '{\"history_id\":%'").select("history_id")


@query("agg_12_history_summary", "SELECT campaign_id, count(*) AS total, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (action_type = 'view') AS views, array_to_string(list_sort(list(DISTINCT source_name)), ',') AS sources, min(ts) AS first_ts, max(ts) AS last_ts FROM v_log GROUP BY 1")
def _(spark, d):
    s = C.history_summary(view(spark, d, "v_log"))
    n = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0)).alias(k + "s")
    return s.select("campaign_id", "total", n("by_outcome", "error"), n("by_action_type", "view"), F.array_join("sources", ",").alias("sources"), "first_ts", "last_ts")


@query("agg_13_history_stats", "SELECT 'total' AS what, '' AS value, count(*) AS n FROM v_log UNION ALL SELECT 'outcome', outcome, count(*) FROM v_log GROUP BY 2 UNION ALL SELECT 'agent', agent_name, count(*) FROM v_log GROUP BY 2 UNION ALL SELECT 'sensitive', '', count(*) FILTER (audit_level = 'sensitive') FROM v_log")
def _(spark, d):
    return C.history_stats(view(spark, d, "v_log"))


@query("str_33_redact_log", "SELECT history_id, target_url, 'step ' || action_type || ' token=[REDACTED]' AS request_summary FROM v_log")
def _(spark, d):
    return C.redact_log(view(spark, d, "v_log")).select("history_id", "target_url", "request_summary")


@query("str_33b_redact_catalog", f"WITH {_OBS} SELECT obs_id, source_id, reliability_score, topic_tag AS tags FROM o")
def _(spark, d):
    return _observations(spark, d).select("obs_id", "source_id", "reliability_score", F.array_join("topic_tags", ",").alias("tags"))


@query("fil_08_valid_source_url", "SELECT obs_id FROM v_sources WHERE obs_id % 3 <> 0")
def _(spark, d):
    s = view(spark, d, "v_sources")
    return C.valid_source_url(s.withColumn("canonical_url", F.when(s.obs_id % 3 == 0, F.concat(F.lit("ftp"), F.regexp_replace("canonical_url", "^[a-z]+", ""))).otherwise(s.canonical_url))).select("obs_id")


@query("joi_13_remember_sources", f"WITH {_CAT} SELECT source_id, source_type, reliability_score, obs_id, first_obs FROM cat")
def _(spark, d):
    o = _observations(spark, d)
    first = C.remember_sources(None, o.where("obs_id % 2 = 0"))
    merged = C.remember_sources(first, o.where("obs_id % 2 = 1"))
    return merged.select("source_id", "source_type", "reliability_score", "obs_id", F.unix_seconds("created_at").alias("first_obs"))


@query("joi_09_with_all_tags", f"WITH {_OBS}, t AS (SELECT DISTINCT source_type AS source_id, topic_tag FROM o) SELECT source_id FROM t WHERE topic_tag IN ('tag1', 'tag3') GROUP BY 1 HAVING count(DISTINCT topic_tag) = 2")
def _(spark, d):
    s = view(spark, d, "v_sources").select(F.col("source_type").alias("source_id"), F.col("topic_tag").alias("tag"), F.lit("topic").alias("kind"))
    return C.with_all_tags(s.select("source_id").distinct(), s, ["tag1", "tag3"])


@query("joi_10_by_tag", f"WITH {_CAT} SELECT source_id, reliability_score FROM cat WHERE topic_tag = 'tag2' ORDER BY reliability_score DESC, obs_id DESC, source_id LIMIT 50")
def _(spark, d):
    cat = _catalog(spark, d)
    return C.by_tag(cat, C.source_tags(cat), "tag2", "topic").select("source_id", "reliability_score")


@query("joi_14_delete_sources", f"WITH {_CAT} SELECT source_id FROM cat WHERE topic_tag <> 'tag0'")
def _(spark, d):
    cat = _catalog(spark, d)
    tags = C.source_tags(cat)
    return C.delete_sources(cat, tags, tags.where("tag = 'tag0'"))[0].select("source_id")


@query("joi_14b_removed_counts", f"WITH {_CAT} SELECT count(*) AS sources, 2 * count(*) AS tags FROM cat WHERE topic_tag = 'tag0'")
def _(spark, d):
    cat = _catalog(spark, d)
    tags = C.source_tags(cat)
    return C.removed_counts(cat, tags, tags.where("tag = 'tag0'"))


@query("joi_15_source_profiles", f"WITH {_CAT} SELECT source_id, topic_tag AS topics, '' AS informations FROM cat")
def _(spark, d):
    cat = _catalog(spark, d)
    return C.source_profiles(cat, C.source_tags(cat)).select("source_id", F.array_join("topics", ",").alias("topics"), F.array_join("informations", ",").alias("informations"))


@query("srt_03_search_sources", f"WITH {_CAT} SELECT source_id FROM cat WHERE source_type = 'type1' AND reliability_score >= 0.2 AND topic_tag = 'tag1' ORDER BY reliability_score DESC, obs_id DESC, source_id LIMIT 50")
def _(spark, d):
    cat = _catalog(spark, d)
    return C.search_sources(cat, C.source_tags(cat), "https", "type1", 0.2, ["tag1"]).select("source_id")


@query("agg_14_catalog_stats", f"WITH {_CAT} SELECT source_type, count(*) AS n, round(avg(reliability_score), 6) AS average_reliability FROM cat GROUP BY ROLLUP (source_type)")
def _(spark, d):
    return C.catalog_stats(_catalog(spark, d)).withColumn("average_reliability", F.round("average_reliability", 6))


@query("agg_15_list_values", f"WITH {_CAT} SELECT DISTINCT topic_tag AS tag FROM cat")
def _(spark, d):
    return C.list_values(C.source_tags(_catalog(spark, d)).where("kind = 'topic'"), "tag")


@query("src_10_cache_put", f"WITH {_CACHE} SELECT * FROM c")
def _(spark, d):
    return _cache(spark, d).select("query", "source", "paper_key", "pos")


@query("src_11_cache_get", f"WITH {_CACHE} SELECT paper_key, pos, CAST(1995 + pos % 30 AS INT) AS year FROM c WHERE query = 'q3' AND pos % 5 <> 0")
def _(spark, d):
    return C.cache_get(_cache(spark, d), "q3").select("paper_key", "pos", F.col("paper.year").alias("year"))


@query("src_11b_cache_papers", f"WITH {_CACHE} SELECT CAST(1995 + pos % 30 AS INT) AS year FROM c WHERE query = 'q3' AND pos % 5 <> 0")
def _(spark, d):
    return C.cache_papers(_cache(spark, d), "q3").select("year")


@query("src_11c_cache_has", f"WITH {_CACHE}, w AS (SELECT DISTINCT query, s AS source FROM c, (VALUES ('arxiv'), ('none'), (NULL)) v(s)) SELECT query, source, EXISTS (SELECT 1 FROM c WHERE c.query = w.query AND (w.source IS NULL OR c.source = w.source)) AS cached FROM w")
def _(spark, d):
    cache = _cache(spark, d)
    sources = F.array(F.lit("arxiv"), F.lit("none"), F.lit(None).cast("string"))
    return C.cache_has(cache.select("query").distinct().withColumn("source", F.explode(sources)), cache)


@query("src_11d_cache_clear", f"WITH {_CACHE} SELECT count(*) AS removed FROM c")
def _(spark, d):
    return C.cache_clear(_cache(spark, d))[1]


@query("joi_06_cache_lookup", f"WITH {_CACHE}, plan AS (SELECT 'q' || k AS query, s AS source FROM range(10) r(k), (VALUES ('arxiv'), ('serp')) v(s)) SELECT query, source, false AS cached, 1::BIGINT AS n FROM plan p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query = p.query AND c.source = p.source) UNION ALL SELECT query, source, true, count(*) FROM c WHERE source = 'arxiv' GROUP BY 1, 2")
def _(spark, d):
    plan = spark.range(10).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), F.explode(F.array(F.lit("arxiv"), F.lit("serp"))).alias("source"))
    hits, misses = C.cache_lookup(plan, _cache(spark, d))
    return misses.select("query", "source", F.lit(False).alias("cached"), F.lit(1).cast("long").alias("n")).unionByName(hits.groupBy("query", "source", "cached").agg(F.count("*").alias("n")))


@query("rul_09_action_log_from_results", "SELECT campaign_id, CASE campaign_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'crossref' ELSE 'custom' END AS agent_name, CASE WHEN campaign_id % 5 = 0 THEN 'error' ELSE 'success' END AS outcome, CASE WHEN campaign_id % 5 = 0 THEN repeat('x', 500) ELSE max_sources || ' papers' END AS response_summary FROM v_campaigns")
def _(spark, d):
    return C.action_log_from_results(_results(spark, d)).select("campaign_id", "agent_name", "outcome", "response_summary")


@query("rul_10_catalog_from_results", "SELECT campaign_id, CASE campaign_id % 3 WHEN 0 THEN 'https://arxiv.org' ELSE 'https://api.crossref.org' END AS canonical_url, 0.7::DOUBLE AS reliability_score FROM v_campaigns WHERE campaign_id % 3 < 2")
def _(spark, d):
    return C.catalog_from_results(_results(spark, d), F.array(F.lit("x"))).select("campaign_id", "canonical_url", "reliability_score")
