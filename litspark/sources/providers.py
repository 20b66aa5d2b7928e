"""Providers' payloads to one paper schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import html_title, visible_text
from ..functions.text import filled, strip

PAPER = (
    "title string, authors array<string>, year int, doi string, url string, pdf_url string, abstract string, source string, source_id string, "
    "citations_in array<string>, citations_out array<string>, meta map<string,string>"
)
SEMANTIC_SCHOLAR = "paperId string, title string, authors array<struct<name string, firstName string, lastName string>>, year int, abstract string, externalIds struct<DOI string>, openAccessPdf struct<url string>, citationCount int"
_PARTS = "struct<`date-parts` array<array<int>>>"
CROSSREF = f"title array<string>, author array<struct<given string, family string>>, `published-print` {_PARTS}, `published-online` {_PARTS}, created {_PARTS}, DOI string, abstract string, link array<struct<URL string>>"
OPENALEX = "id string, display_name string, doi string, publication_date string, authorships array<struct<author struct<display_name string>>>, abstract string, open_access struct<oa_url string>, cited_by_count int, concepts array<struct<display_name string>>"
ATOM = "id string, title string, published string, summary string, author array<struct<name string>>"
SERP = r'(?is)(?:<h[123][^>]*>|"title"\s*:\s*")([^<"]+)(?:</h[123]|").*?<a[^>]+href="(https?://[^"]+)"'


def to_paper_schema(df: DataFrame) -> DataFrame:
    """``df`` with the paper columns: missing ones null or empty, title and source with their defaults."""
    defaults = {"title": F.lit(""), "abstract": F.lit(""), "source": F.lit("unknown")}
    out = []
    for field in df.sparkSession.createDataFrame([], PAPER).schema.fields:
        c = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if field.name in defaults:
            c = F.coalesce(c, defaults[field.name])
        elif field.dataType.typeName() == "array":
            c = F.coalesce(c, F.array().cast(field.dataType))
        elif field.dataType.typeName() == "map":
            c = F.coalesce(c, F.create_map().cast(field.dataType))
        out.append(c.alias(field.name))
    return df.select(*out)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return to_paper_schema(spark.read.schema(PAPER).json(path))


def _names(people: Column, name) -> Column:
    return F.filter(F.transform(F.coalesce(people, F.array()), name), lambda n: F.coalesce(n != "", F.lit(False)))


def _full(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def normalize_semantic_scholar(raw: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``raw``: a column ``payload`` of JSON text; ``keep``: columns to hand on."""
    r = raw.withColumn("r", F.from_json("payload", SEMANTIC_SCHOLAR))
    return r.select(
        *keep,
        F.coalesce("r.title", F.lit("")).alias("title"),
        _names(F.col("r.authors"), lambda a: F.coalesce(F.nullif(a["name"], F.lit("")), _full(a["firstName"], a["lastName"]))).alias("authors"),
        F.col("r.year").alias("year"),
        F.col("r.externalIds.DOI").alias("doi"),
        F.when(filled(F.col("r.paperId")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("r.paperId"))).alias("url"),
        F.col("r.openAccessPdf.url").alias("pdf_url"),
        F.coalesce("r.abstract", F.lit("")).alias("abstract"),
        F.lit("semantic_scholar").alias("source"),
        F.col("r.paperId").alias("source_id"),
        F.create_map(F.lit("citation_count"), F.col("r.citationCount").cast("string")).alias("meta"),
    )


def crossref_year(r: Column) -> Column:
    """First of the print, online and created dates that has a year."""
    return F.coalesce(*[F.get(F.get(r[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "created")])


def normalize_crossref(raw: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    r = raw.withColumn("r", F.from_json("payload", CROSSREF))
    by_doi = F.when(filled(F.col("r.DOI")), F.concat(F.lit("https://doi.org/"), F.col("r.DOI")))
    return r.select(
        *keep,
        F.coalesce(F.get("r.title", F.lit(0)), F.lit("")).alias("title"),
        _names(F.col("r.author"), lambda a: _full(a["given"], a["family"])).alias("authors"),
        crossref_year(F.col("r")).alias("year"),
        F.col("r.DOI").alias("doi"),
        F.coalesce(F.nullif(F.get("r.link", F.lit(0))["URL"], F.lit("")), by_doi).alias("url"),
        F.lit(None).cast("string").alias("pdf_url"),
        F.coalesce("r.abstract", F.lit("")).alias("abstract"),
        F.lit("crossref").alias("source"),
        F.col("r.DOI").alias("source_id"),
    )


def normalize_openalex(raw: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    r = raw.withColumn("r", F.from_json("payload", OPENALEX))
    return r.select(
        *keep,
        F.coalesce("r.display_name", F.lit("")).alias("title"),
        _names(F.col("r.authorships"), lambda a: a["author"]["display_name"]).alias("authors"),
        F.when(F.length("r.publication_date") >= 4, F.substring("r.publication_date", 1, 4).try_cast("int")).alias("year"),
        F.replace("r.doi", F.lit("https://doi.org/"), F.lit("")).alias("doi"),
        F.col("r.id").alias("url"),
        F.col("r.open_access.oa_url").alias("pdf_url"),
        F.coalesce("r.abstract", F.lit("")).alias("abstract"),
        F.lit("openalex").alias("source"),
        F.col("r.id").alias("source_id"),
        F.array_join(F.transform("r.concepts", lambda c: c["display_name"]), ", ").alias("concepts"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)


def normalize_arxiv(entries: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``entries``: the columns of ATOM."""
    own = F.substring_index(F.substring_index("id", "/", -1), "v", 1)
    flat = lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    return entries.select(
        *keep,
        flat("title").alias("title"),
        _names(F.col("author"), lambda a: a["name"]).alias("authors"),
        F.substring("published", 1, 4).try_cast("int").alias("year"),
        F.concat(F.lit("https://arxiv.org/abs/"), own).alias("url"),
        F.when(own != "", F.concat(F.lit("https://arxiv.org/pdf/"), own, F.lit(".pdf"))).alias("pdf_url"),
        flat("summary").alias("abstract"),
        F.lit("arxiv").alias("source"),
        own.alias("source_id"),
    )


def parse_serp_html(pages: DataFrame, html_col: str, most: int = 10, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(keep, pos, title, url): the first ``most`` pairs of a heading and the link after it."""
    of = lambda g: F.regexp_extract_all(F.col(html_col), F.lit(SERP), F.lit(g))
    pairs = F.slice(F.arrays_zip(of(1).alias("t"), of(2).alias("u")), 1, most)
    return pages.select(*keep, F.posexplode(pairs).alias("pos", "m")).select(*keep, "pos", strip(F.col("m.t")).alias("title"), F.col("m.u").alias("url"))


def snapshot_pages(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as papers."""
    rows = pages.withColumn("text", visible_text(F.col("html")))
    return rows.select("page_id", F.coalesce(html_title(F.col("html")), F.col("url")).alias("title"), "url", F.substring("text", 1, 1000).alias("abstract"), F.length("html").alias("content_length"), F.length("text").alias("text_length"), F.lit("web_crawl").alias("source"))


def search_page_meta(results: DataFrame) -> DataFrame:
    """``results`` (n, total, offset, error) with next_offset and ok."""
    after = F.col("offset") + F.col("n")
    return results.withColumns({"next_offset": F.when(after < F.col("total"), after), "ok": F.col("error").isNull()})


def union_results(results: DataFrame) -> DataFrame:
    """Papers of the ok results (plan_pos, error, papers array), in plan order with row_pos."""
    return results.where("error is null").select("plan_pos", F.posexplode("papers").alias("row_pos", "paper"))
