"""Queries of providers' payloads, pages, bytes and files (SRC-01..09, 12..14, 16; SET-01; AGG-17; FIL-07)."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.robots import robots_filter
from ..operators.shared import shared_dir
from ..registry import query
from ..sources import files as S
from ..sources import providers as P
from ..sources.files import newest_per_key
from ..testviews import table, view
from .html import VISIBLE


def _shared(spark, name):
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _payloads(spark, d, made):
    return view(spark, d, "v_papers").select("paper_id", F.to_json(made).alias("payload"))


@query("src_01_to_paper_schema", "SELECT coalesce(title, '') AS title, year, CASE WHEN paper_id % 2 = 0 THEN source ELSE 'unknown' END AS source, 0 AS n_authors FROM v_papers")
def _(spark, d):
    p = view(spark, d, "v_papers").withColumn("source", F.when(F.col("paper_id") % 2 == 0, F.col("source"))).drop("abstract")
    return P.to_paper_schema(p).select("title", "year", "source", F.size("authors").alias("n_authors"))


@query("src_02_normalize_semantic_scholar", "SELECT paper_id, title, 'A' || paper_id || ';C D' AS authors, year, doi, 'https://www.semanticscholar.org/paper/' || source_id AS url, pdf_url, citation_count::VARCHAR AS cited FROM v_papers")
def _(spark, d):
    c = F.col
    person = lambda n, a, b: F.struct(n.alias("name"), F.lit(a).alias("firstName"), F.lit(b).alias("lastName"))
    people = F.array(person(F.concat(F.lit("A"), c("source_id")), "", ""), person(F.lit(""), "C", "D"), person(F.lit(""), "", ""))
    made = F.struct(c("source_id").alias("paperId"), "title", people.alias("authors"), "year", "abstract", F.struct(c("doi").alias("DOI")).alias("externalIds"), F.struct(c("pdf_url").alias("url")).alias("openAccessPdf"), c("citation_count").alias("citationCount"))
    return P.normalize_semantic_scholar(_payloads(spark, d, made), ["paper_id"]).select("paper_id", "title", F.array_join("authors", ";").alias("authors"), "year", "doi", "url", "pdf_url", F.col("meta")["citation_count"].alias("cited"))


def _crossref(spark, d):
    c = F.col
    date = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    made = F.struct(
        F.array("title").alias("title"),
        F.array(F.struct(F.lit("Jane").alias("given"), c("source").alias("family"))).alias("author"),
        F.when(c("paper_id") % 2 == 0, date(c("year"))).alias("published-print"),
        date(c("year") + 1).alias("created"),
        c("doi").alias("DOI"),
        F.when(c("paper_id") % 4 == 0, F.array(F.struct(c("url").alias("URL")))).alias("link"),
    )
    return P.normalize_crossref(_payloads(spark, d, made), ["paper_id"])


@query("src_03_normalize_crossref", "SELECT paper_id, title, 'Jane ' || source AS authors, doi, coalesce(CASE WHEN paper_id % 4 = 0 THEN url END, 'https://doi.org/' || doi) AS url FROM v_papers")
def _(spark, d):
    return _crossref(spark, d).select("paper_id", "title", F.array_join("authors", ";").alias("authors"), "doi", "url")


@query("src_04_crossref_year", "SELECT paper_id, (CASE WHEN paper_id % 2 = 0 THEN year ELSE year + 1 END)::INT AS year FROM v_papers")
def _(spark, d):
    return _crossref(spark, d).select("paper_id", "year")


@query("src_05_normalize_openalex", "SELECT paper_id, title, CASE WHEN paper_id % 3 = 0 THEN NULL ELSE year END AS year, doi, pdf_url, 'https://openalex.org/W' || source_id AS source_id, 'x, y' AS concepts FROM v_papers")
def _(spark, d):
    c = F.col
    made = F.struct(
        F.concat(F.lit("https://openalex.org/W"), c("source_id")).alias("id"),
        c("title").alias("display_name"),
        F.concat(F.lit("https://doi.org/"), c("doi")).alias("doi"),
        F.when(c("paper_id") % 3 == 0, "n.d.").otherwise(F.concat(c("year").cast("string"), F.lit("-05-01"))).alias("publication_date"),
        F.struct(c("pdf_url").alias("oa_url")).alias("open_access"),
        F.array(F.struct(F.lit("x").alias("display_name")), F.struct(F.lit("y").alias("display_name"))).alias("concepts"),
    )
    return P.normalize_openalex(_payloads(spark, d, made), ["paper_id"]).select("paper_id", "title", "year", "doi", "pdf_url", "source_id", "concepts")


@query("src_06_normalize_arxiv", "SELECT paper_id, trim(replace(chr(10) || title || chr(10) || 'x', chr(10), ' ')) AS title, year, source_id, 'https://arxiv.org/pdf/' || source_id || '.pdf' AS pdf_url FROM v_papers")
def _(spark, d):
    e = view(spark, d, "v_papers").select(
        "paper_id",
        F.concat(F.lit("http://arxiv.org/abs/"), F.col("source_id"), F.lit("v3")).alias("id"),
        F.concat(F.lit("\n"), F.col("title"), F.lit("\nx")).alias("title"),
        F.concat(F.col("year").cast("string"), F.lit("-01-01T00:00:00Z")).alias("published"),
        F.col("abstract").alias("summary"),
        F.array(F.struct(F.lit("A").alias("name"))).alias("author"),
    )
    return P.normalize_arxiv(e, ["paper_id"]).select("paper_id", "title", "year", "source_id", "pdf_url")


@query("src_07_parse_serp_html", "SELECT page_id, 0 AS pos, 'Page ' || page_id AS title, url FROM pages UNION ALL SELECT page_id, 1, 'Next', 'https://b.org/' || page_id FROM pages")
def _(spark, d):
    html = F.concat(F.lit("<h3 class=x> Page "), F.col("page_id").cast("string"), F.lit("</h3><p>\n<a x href=\""), F.col("url"), F.lit('">u</a>{"title": "Next"} <a href="https://b.org/'), F.col("page_id").cast("string"), F.lit('">')) 
    return P.parse_serp_html(table(spark, d, "pages").withColumn("made", html), "made", keep=["page_id"])


@query(
    "src_08_snapshot_pages",
    rf"""WITH t AS (SELECT *, {VISIBLE} AS visible FROM pages)
        SELECT page_id, url, coalesce(trim(nullif(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1), '')), url) AS title, substr(visible, 1, 1000) AS abstract, length(html) AS content_length, length(visible) AS text_length, 'web_crawl' AS source FROM t""",
)
def _(spark, d):
    counts = {c: F.col(c).cast("long") for c in ("content_length", "text_length")}
    return P.snapshot_pages(table(spark, d, "pages")).withColumns(counts)


@query("src_09_search_page_meta", "SELECT campaign_id, CASE WHEN max_sources + 10 < 50 THEN max_sources + 10 END AS next_offset, campaign_id % 2 = 0 AS ok FROM v_campaigns")
def _(spark, d):
    c = view(spark, d, "v_campaigns")
    return P.search_page_meta(c.select("campaign_id", F.lit(10).alias("n"), F.lit(50).alias("total"), F.col("max_sources").alias("offset"), F.when(c.campaign_id % 2 == 1, "x").alias("error"))).select("campaign_id", "next_offset", "ok")


@query("set_01_union_results", "SELECT campaign_id AS plan_pos, unnest([0, 1]) AS row_pos, unnest([query, query || '!']) AS title FROM v_campaigns WHERE campaign_id % 4 <> 0")
def _(spark, d):
    c = view(spark, d, "v_campaigns")
    papers = F.array(F.struct(c.query.alias("title")), F.struct(F.concat(c.query, F.lit("!")).alias("title")))
    return P.union_results(c.select(c.campaign_id.alias("plan_pos"), F.when(c.campaign_id % 4 == 0, "x").alias("error"), papers.alias("papers"))).select("plan_pos", "row_pos", "paper.title")


@query("src_12_assemble_pages", "SELECT conv_id, coalesce(string_agg('## Page ' || turn || chr(10) || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY turn, trim(text, ' ' || chr(10) || chr(9) || chr(13))) FILTER (trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> ''), '') AS markdown, count(*) AS pages FROM conversations GROUP BY 1")
def _(spark, d):
    return S.assemble_pages(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "markdown", "pages")


@query("src_13_decode_bytes", "SELECT doc_id, text, 'é' AS latin FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.decode_bytes(F.col("text").cast("binary")).alias("text"), S.decode_bytes(F.unhex(F.lit("E9"))).alias("latin"))


@query("src_14_write_briefs", "SELECT lower(r_name) AS slug, '# ' || r_name AS brief FROM region")
def _(spark, d):
    path = _shared(spark, "briefs")
    S.write_briefs(table(spark, d, "region").select(F.lower("r_name").alias("slug"), F.concat(F.lit("# "), "r_name").alias("brief"), F.lit("{}").alias("evidence_json")), path)
    return S.read_back_briefs(spark, path).select("slug", "brief")


@query("src_16_append_events", "SELECT event_id, event_type FROM events")
def _(spark, d):
    path, e = _shared(spark, "events"), table(spark, d, "events").select("event_id", "event_type", "props")
    S.append_events(e.where("event_id % 2 = 0"), path)
    S.append_events(e.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).select("event_id", "event_type")


@query("agg_17_file_duplicates", "WITH f AS (SELECT text, min(doc_id) AS first, count(*) AS n, max(strlen(text)) AS b FROM documents WHERE strlen(text) >= 10 GROUP BY text) SELECT sum(n)::BIGINT AS scanned, sum(n - 1)::BIGINT AS removed, sum((n - 1) * b)::BIGINT AS bytes_saved FROM f")
def _(spark, d):
    f = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"))
    return S.duplicate_totals(S.file_duplicates(f, 10))


_RULES = "rules(host, rule_no, allow, prefix) AS (SELECT host, unnest([1, 2, 3]), unnest([false, true, false]), unnest(['/1', '/', '/2']) FROM (SELECT DISTINCT host FROM u WHERE n % 2 = 0))"


@query(
    "fil_07_robots_filter",
    f"WITH u AS (SELECT page_id, page_id % 7 AS n, 'h' || (page_id % 7) || '.org' AS host, '/' || page_id AS path FROM pages), {_RULES} SELECT page_id FROM u WHERE coalesce((SELECT arg_min(allow, rule_no) FROM rules r WHERE r.host = u.host AND starts_with(u.path, r.prefix)), true)",
)
def _(spark, d):
    p = table(spark, d, "pages")
    urls = p.select("page_id", F.concat(F.lit("https://h"), (p.page_id % 7).cast("string"), F.lit(".org/"), p.page_id.cast("string")).alias("url"))
    hosts = p.where("page_id % 7 % 2 = 0").select(F.lit("https").alias("scheme"), F.concat(F.lit("h"), (p.page_id % 7).cast("string"), F.lit(".org")).alias("host")).distinct()
    rules = hosts.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(a).alias("allow"), F.lit(x).alias("path_prefix")) for i, a, x in ((1, False, "/1"), (2, True, "/"), (3, False, "/2"))])).alias("r"))
    return robots_filter(urls, rules.select("scheme", "host", "r.*")).select("page_id")


@query("srt_06b_newest_per_key", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events QUALIFY n <= 3")
def _(spark, d):
    newest = newest_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return newest.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("n"))
