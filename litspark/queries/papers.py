"""Queries of deduplication, citation graphs, resolution, screening and planning."""

from pyspark.sql import functions as F

from ..functions.text import paper_key
from ..operators import dedup, graph, plan, resolve, screen
from ..registry import query
from ..testviews import table, view

_KEYS = "WITH p AS (SELECT paper_id, pos, campaign_id, lower(doi) AS d, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^https?://', ''), 'www\\.', '', 'g'), '/+$', '') AS u FROM v_papers)"
_PAIRS = """, pairs AS (SELECT a.paper_id AS later, b.paper_id AS earlier, a.pos AS pa, b.pos AS pb, CASE WHEN a.d = b.d THEN 'doi_exact' ELSE 'url_exact' END AS reason
  FROM p a JOIN p b ON a.pos > b.pos AND ((a.d = b.d) OR ((a.d IS NULL OR b.d IS NULL) AND a.u <> '' AND a.u = b.u)))"""
_MATCH = "CASE WHEN c.d IS NOT NULL AND p.d IS NOT NULL THEN c.d = p.d ELSE coalesce(c.u = p.u, false) END"
_GROUPS = f"""WITH RECURSIVE p AS (SELECT paper_id, pos, row_number() OVER (ORDER BY pos) AS n, lower(trim(doi)) AS d, nullif(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^https?://', ''), 'www\\.', '', 'g'), '/+$', ''), '') AS u FROM v_papers),
  walk(n, canon) AS (SELECT 0::BIGINT, CAST([] AS STRUCT(id BIGINT, pos BIGINT, d VARCHAR, u VARCHAR)[])
    UNION ALL SELECT p.n, CASE WHEN len(list_filter(canon, lambda c: {_MATCH})) > 0 THEN canon ELSE list_append(canon, {{'id': p.paper_id, 'pos': p.pos, 'd': p.d, 'u': p.u}}) END FROM walk w JOIN p ON p.n = w.n + 1),
  m AS (SELECT paper_id, pos, p.d, list_filter(canon, lambda c: c.pos <= p.pos AND {_MATCH})[1] AS c FROM p, (SELECT canon FROM walk ORDER BY n DESC LIMIT 1)),
  g AS (SELECT paper_id, coalesce(c.id, paper_id) AS canonical_id, CASE WHEN coalesce(c.pos, pos) = pos THEN 'canonical' WHEN d IS NOT NULL AND c.d IS NOT NULL THEN 'doi_exact' ELSE 'url_exact' END AS reason FROM m)"""
_OA = "select distinct doi, concat('https://oa.example.org/', substr(doi, 9)) as url_for_pdf, true as is_oa from v_papers where doi is not null and paper_id % 2 = 1"
_RESOLVED = f"""r AS (SELECT p.*, coalesce(lower(doi), lower(url), lower(trim(title)) || '::' || coalesce(year::VARCHAR, 'None')) AS paper_key,
  CASE WHEN pdf_url IS NOT NULL THEN pdf_url WHEN source = 'arxiv' THEN 'https://arxiv.org/pdf/' || source_id || '.pdf' WHEN o.u IS NOT NULL THEN o.u WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi END AS full_text_url,
  CASE WHEN pdf_url IS NOT NULL THEN 'adapter_pdf_url' WHEN source = 'arxiv' THEN 'arxiv' WHEN o.u IS NOT NULL THEN 'unpaywall' WHEN doi IS NOT NULL THEN 'doi_landing' ELSE 'none' END AS resolved_by,
  pdf_url IS NOT NULL OR source = 'arxiv' OR o.u IS NOT NULL AS is_oa
  FROM v_papers p LEFT JOIN (SELECT lower(doi) AS d, min(url_for_pdf) AS u FROM ({_OA}) GROUP BY 1) o ON lower(p.doi) = o.d)"""


def _oa(papers):
    return papers.where("doi is not null and paper_id % 2 = 1").select("doi", F.concat(F.lit("https://oa.example.org/"), F.substring("doi", 9, 100)).alias("url_for_pdf"), F.lit(None).cast("string").alias("url"), F.lit(True).alias("is_oa")).distinct()


def _relevant(spark, d):
    """Papers with a relevance score from the labels."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") * 3 + 2).alias("relevance"))
    return view(spark, d, "v_papers").join(labels, "paper_id", "left")


_SCORES = "s AS (SELECT p.*, l.quality * 3 + 2 AS relevance FROM v_papers p LEFT JOIN labels l ON l.doc_id = p.paper_id)"
_TOTAL = "round((CASE WHEN pdf_url IS NOT NULL THEN 1.0 ELSE 0.0 END) + 0.5 * (CASE WHEN year >= 2000 THEN 1.0 ELSE 0.0 END) + CASE WHEN relevance IS NULL THEN 0.0 ELSE (greatest(3, least(5, relevance)) - 3) / 2.0 END, 4)"


@query("joi_01_dedup_pairs", f"{_KEYS}{_PAIRS} SELECT later, earlier, reason FROM pairs")
def _(spark, d):
    return dedup.dedup_pairs(view(spark, d, "v_papers"), threshold=None)


@query("joi_01b_dedup_pairs_by_title")
def _(spark, d):
    return dedup.dedup_pairs(view(spark, d, "v_papers"))


@query("joi_02_dedup_groups", f"{_GROUPS} SELECT * FROM g")
def _(spark, d):
    return dedup.dedup_groups(view(spark, d, "v_papers"), threshold=None)


@query("joi_02b_dedup_groups_by_title")
def _(spark, d):
    return dedup.dedup_groups(view(spark, d, "v_papers"))


@query(
    "agg_01_dedup_stats",
    f"""{_GROUPS} SELECT canonical_id, array_to_string(coalesce(list(paper_id ORDER BY paper_id) FILTER (paper_id <> canonical_id), []), ',') AS duplicates, (SELECT count(*) FROM g) AS input_count,
      (SELECT count(*) FROM g WHERE reason = 'canonical') AS canonical_count, (SELECT count(*) FROM g WHERE reason <> 'canonical') AS duplicate_count FROM g GROUP BY canonical_id""",
)
def _(spark, d):
    stats = dedup.dedup_stats(dedup.dedup_groups(view(spark, d, "v_papers"), threshold=None))
    return stats.withColumn("duplicates", F.array_join("duplicates", ","))


@query(
    "agg_18_pair_quality",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM labels)
       SELECT tp, fp, tn, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
)
def _(spark, d):
    return dedup.pair_quality(table(spark, d, "labels").select((F.col("quality") == 1).alias("predicted"), (F.col("toxic") == 0).alias("truth")))


@query(
    "joi_03_snowball",
    """WITH RECURSIVE ways AS (SELECT src, dst FROM v_edges UNION SELECT dst, src FROM v_edges), hops AS (SELECT src, dst FROM ways WHERE dst IN (SELECT p_partkey FROM part)),
       walk(seed, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT w.seed, h.dst, w.depth + 1 FROM walk w JOIN hops h ON h.src = w.node WHERE w.depth < 2)
       SELECT seed, node, min(depth)::INT AS depth FROM walk GROUP BY seed, node HAVING min(depth) > 0""",
)
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return graph.snowball(parts.select(F.col("node").alias("seed")), view(spark, d, "v_edges"), parts, 2)


@query("joi_04_resolve_fulltext", f"WITH {_RESOLVED} SELECT paper_id, paper_key, full_text_url, resolved_by, is_oa FROM r")
def _(spark, d):
    p = view(spark, d, "v_papers")
    return resolve.resolve_fulltext(p, _oa(p)).select("paper_id", "paper_key", F.col("resolved.url").alias("full_text_url"), F.col("resolved.source").alias("resolved_by"), F.col("resolved.is_oa").alias("is_oa"))


@query("joi_05_attach_resolution", f"WITH {_RESOLVED}, k AS (SELECT paper_key, max(full_text_url) AS full_text_url, bool_or(is_oa) AS is_oa FROM r WHERE paper_id % 3 <> 1 GROUP BY 1) SELECT r.paper_id, k.full_text_url, coalesce(k.is_oa, false) AS is_oa FROM r LEFT JOIN k USING (paper_key)")
def _(spark, d):
    p = view(spark, d, "v_papers")
    resolved = resolve.resolve_fulltext(p, _oa(p))
    one = resolved.where("paper_id % 3 <> 1").groupBy("paper_key").agg(F.struct(F.max("resolved.url").alias("url"), F.bool_or("resolved.is_oa").alias("is_oa")).alias("resolved"))
    return resolve.attach_resolution(resolved.select("paper_id", "paper_key"), one).select("paper_id", "full_text_url", "is_oa")


@query("fil_11_open_access_gate", f"WITH {_RESOLVED} SELECT paper_id, CASE WHEN full_text_url IS NOT NULL AND is_oa THEN 'full ' || title ELSE abstract END AS text, CASE WHEN full_text_url IS NOT NULL AND is_oa THEN 'markdownify' ELSE 'abstract' END AS tool, CASE WHEN full_text_url IS NOT NULL AND NOT is_oa THEN 'URL is not open-access; fetch refused' END AS error FROM r")
def _(spark, d):
    p = view(spark, d, "v_papers")
    r = resolve.resolve_fulltext(p, _oa(p)).select("*", F.col("resolved.url").alias("full_text_url"), F.col("resolved.is_oa").alias("is_oa"), F.concat(F.lit("full "), F.col("title")).alias("content"))
    return resolve.open_access_gate(r).select("paper_id", "text", "tool", "error")


@query("rul_02_boolean_criterion", "SELECT paper_id, doi IS NOT NULL AND doi <> '' AS has_doi, NOT (citation_count <> 0) AS uncited FROM v_papers")
def _(spark, d):
    p = view(spark, d, "v_papers")
    return p.select("paper_id", screen.boolean_passes(p.doi, "string", True).alias("has_doi"), screen.boolean_passes(p.citation_count, "int", False).alias("uncited"))


@query("rul_03_numeric_criterion", "SELECT paper_id, coalesce(year BETWEEN 2000 AND 2010, false) AS in_years FROM v_papers")
def _(spark, d):
    return view(spark, d, "v_papers").select("paper_id", screen.numeric_passes(F.col("year"), 2000, 2010).alias("in_years"))


@query("rul_04_rubric_criterion", f"WITH {_SCORES} SELECT paper_id, CASE WHEN relevance IS NOT NULL THEN round((greatest(3, least(5, relevance)) - 3) / 2.0, 4) END AS rubric FROM s")
def _(spark, d):
    return _relevant(spark, d).select("paper_id", screen.rubric_score(F.col("relevance"), 3, 5).alias("rubric"))


@query("rul_05_screen", "SELECT paper_id, round(2.0 * (year >= 2005)::INT + 0.25 * (doi IS NOT NULL)::INT, 4)::DOUBLE AS total_score, year >= 2005 AS included, CASE WHEN year >= 2005 THEN 'passed all must criteria' ELSE 'failed a must criterion' END AS reason FROM v_papers")
def _(spark, d):
    criteria = (screen.Criterion("recent", "numeric", "year", low=2005, must=True, weight=2.0), screen.Criterion("doi", "boolean", "doi", weight=0.25))
    return screen.screen(view(spark, d, "v_papers"), criteria).select("paper_id", "total_score", "included", "reason")


@query("rul_06_screen_default", f"WITH {_SCORES} SELECT paper_id, {_TOTAL} AS total_score, pdf_url IS NOT NULL AS included FROM s")
def _(spark, d):
    return screen.screen(_relevant(spark, d)).select("paper_id", "total_score", "included")


@query(
    "rul_07_screen_by_rows",
    """SELECT 'a' AS criteria_set, paper_id, round(1.0 * (year >= 2005)::INT + 0.5 * (pdf_url IS NOT NULL)::INT, 4)::DOUBLE AS total_score, year >= 2005 AS included FROM v_papers
       UNION ALL SELECT 'b', paper_id, round((greatest(3, least(5, citation_count)) - 3) / 2.0, 4), true FROM v_papers""",
)
def _(spark, d):
    rows = [("a", "numeric", "year", None, 2005.0, None, True, None), ("a", None, "pdf", None, None, None, False, 0.5), ("b", "rubric", "cited", None, None, None, None, None)]
    criteria = spark.createDataFrame(rows, "criteria_set string, kind string, field string, expected boolean, low double, high double, must boolean, weight double")
    p = view(spark, d, "v_papers")
    fields = F.create_map(F.lit("year"), F.col("year").cast("string"), F.lit("pdf"), F.col("pdf_url").isNotNull().cast("string"), F.lit("cited"), F.col("citation_count").cast("string"))
    return screen.screen_by_rows(p.withColumn("fields", fields), criteria)


@query("srt_01_rank_scorecards", f"WITH {_SCORES} SELECT paper_id, row_number() OVER (ORDER BY {_TOTAL} DESC, pos) AS place FROM s QUALIFY place <= 100")
def _(spark, d):
    top = screen.rank(screen.screen(_relevant(spark, d)).select("paper_id", "total_score", "pos")).limit(100)
    from pyspark.sql import Window

    return top.select("paper_id", F.row_number().over(Window.orderBy(F.desc("total_score"), "pos")).alias("place"))


@query("srt_02_include_top", f"WITH {_SCORES} SELECT campaign_id, paper_id, row_number() OVER (PARTITION BY campaign_id ORDER BY {_TOTAL} DESC, pos) AS rank FROM s WHERE pdf_url IS NOT NULL QUALIFY rank <= 5")
def _(spark, d):
    return screen.include_top(screen.screen(_relevant(spark, d)), 5).select("campaign_id", "paper_id", "rank")


@query("udf_01_score_with", "SELECT paper_id, CASE WHEN paper_id % 7 = 0 THEN NULL ELSE length(title)::DOUBLE END AS score, paper_id % 7 = 0 AS failed FROM v_papers")
def _(spark, d):
    p = view(spark, d, "v_papers").withColumn("abstract", (F.col("paper_id") % 7).cast("string"))
    return screen.score_with(p, lambda title, abstract, prompt: len(title) / (abstract != "0"), "rate").select("paper_id", "score", F.col("score_error").isNotNull().alias("failed"))


@query("fil_03_validate_requests", "SELECT campaign_id, CASE WHEN max_sources < 1 THEN 'max_sources must be at least 1' ELSE '' END AS reasons FROM v_campaigns")
def _(spark, d):
    return plan.validate_requests(view(spark, d, "v_campaigns")).select("campaign_id", F.array_join("reasons", ";").alias("reasons"))


@query("fil_04_classify_blocker", "SELECT campaign_id, CASE WHEN campaign_id % 3 = 0 THEN 'unblocking' END AS campaign_type FROM v_campaigns")
def _(spark, d):
    c = view(spark, d, "v_campaigns").withColumn("query", F.when(F.col("campaign_id") % 3 == 0, F.concat(F.lit("How TO "), F.col("query"))).otherwise(F.col("query")))
    return plan.classify_blocker(c).select("campaign_id", "campaign_type")


@query(
    "rul_01_plan_queries",
    """WITH q AS (SELECT campaign_id, 'find a ' || query AS query FROM v_campaigns)
       SELECT campaign_id, 0 AS plan_pos, 'serp' AS source, query || ' tutorial example solution' AS planned, 0 AS priority FROM q
       UNION ALL SELECT campaign_id, 1, 'arxiv', query, 1 FROM q UNION ALL SELECT campaign_id, 2, 'arxiv', CASE WHEN length(split_part(query, ' ', 4)) > 3 THEN 'find query ' || split_part(query, ' ', 4) ELSE 'find query' END, 2 FROM q
       UNION ALL SELECT campaign_id, 3, 'custom', query, 1 FROM q UNION ALL SELECT campaign_id, 4, 'web_crawl', query, 3 FROM q""",
)
def _(spark, d):
    c = view(spark, d, "v_campaigns").withColumn("query", F.concat(F.lit("find a "), F.col("query")))
    return plan.plan_queries(c, ["web_crawl", "custom", "arxiv"])


@query("srt_07_resolve_budget", "SELECT campaign_id, paper_id, row_number() OVER (PARTITION BY campaign_id ORDER BY CASE WHEN paper_id % 3 = 0 THEN 0 ELSE 1 END, pos) AS rank FROM v_papers QUALIFY rank <= 50")
def _(spark, d):
    p = view(spark, d, "v_papers")
    return resolve.resolve_budget(p.where("paper_id % 3 = 0"), p.where("paper_id % 3 <> 0"), 50).select("campaign_id", "paper_id", "rank")


@query("str_01b_paper_keys_distinct", "SELECT count(DISTINCT coalesce(lower(doi), lower(url), lower(trim(title)) || '::' || coalesce(year::VARCHAR, 'None'))) AS n FROM v_papers")
def _(spark, d):
    p = view(spark, d, "v_papers")
    return p.agg(F.countDistinct(paper_key(p.doi, p.url, p.title, p.year)).alias("n"))
