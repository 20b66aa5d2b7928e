"""Claims: mining, citations, conflicts, challenges and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import cut

# Shapes of citations.
AUTHOR_YEAR = r"[A-Z][a-zA-Z\-]+(?:\s+(?:and|et\s+al\.)?\s*[A-Z][a-zA-Z\-]+)*\s*\(\d{4}\)"
NUMBERED = r"\[\d{1,3}\]"
# Severity, kind, reason and requested evidence of each challenge.
CHALLENGES = (
    ("high", "missing_evidence", "Claim lacks supporting evidence or evidence is too short.", "Provide the sentence or table from the source that supports this claim."),
    ("medium", "low_confidence", "Extractor assigned low confidence to this claim.", "Re-run extraction with more context or flag for manual review."),
    ("high", "missing_source", "No DOI, PDF URL, or landing page available for the source.", "Resolve a stable URL or DOI for the source."),
    ("low", "coverage", "Claim is very short; may omit nuance or caveats.", "Restate the claim with full context and any stated limitations."),
)
# What a verification says.
PASSED = "claim checks passed"
NO_QUOTE, NOT_FOUND = "claim has no quoted evidence", "quoted evidence not found in extracted source text"
NO_PLACE, BAD_DOI, UNREACHABLE = "source has no DOI, PDF URL, or landing page", "DOI does not match expected shape", "source URL is not reachable"
#: Characters of the runs that claims and facts meet by.
GRAM = 4
DOI = r"10\.\d{4,9}/[-._;()/:\p{L}\p{N}_]+"


def extract_claims(docs: DataFrame, markers=T.CLAIM_MARKERS) -> DataFrame:
    """(paper_id, claim_index, claim, evidence, confidence) of each document's first ten claims."""
    rows = docs.select("paper_id", F.posexplode(T.claims(F.col("text"), markers)).alias("claim_index", "claim"))
    return rows.select("paper_id", "claim_index", "claim", F.col("claim").alias("evidence"), F.lit("low").alias("confidence"))


def citations_in(text: Column) -> Column:
    """array<struct(kind, nth, raw, authors, year, doi, context)>: Author (Year), then [n], then bare DOIs."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(T.match_offsets(text, pattern), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), m.alias("m")))

    def told(c: Column) -> Column:
        raw, kind = c["m"]["raw"], c["kind"]
        names = F.filter(F.transform(F.split(F.substring_index(raw, "(", 1), r"\s+(?:and|et\s+al\.)\s*"), T.strip), lambda a: a != "")
        return F.struct(
            kind.alias("kind"),
            c["nth"].alias("nth"),
            raw.alias("raw"),
            F.when(kind == "author_year", names).alias("authors"),
            F.when(kind == "author_year", F.regexp_extract(raw, r"\((\d{4})\)", 1).cast("int")).alias("year"),
            F.when(kind == "doi", raw).alias("doi"),
            T.context(text, c["m"]).alias("context"),
        )

    return F.transform(F.concat(of("author_year", AUTHOR_YEAR), of("numbered", NUMBERED), of("doi", DOI)), told)


def extract_citations(docs: DataFrame) -> DataFrame:
    """(paper_id, kind, nth, raw, authors, year, doi, context) of each document's ``citations_in``."""
    return docs.select("paper_id", F.inline(citations_in(F.col("text"))))


def conflicts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_id, fact_id, claim): per source and fact the first claim that holds the fact's text or over 0.8 of its words.

    Nulls and blank facts match nothing. Distinct claims and facts meet by what a match must share, so no pair is left
    out: over 0.8 of n words leave at most n - floor(0.8 n) - 1 of the fact's words out, so one of its n - floor(0.8 n) rarest
    is in the claim; a claim that holds a fact's text holds its rarest run of ``GRAM`` characters (a shorter fact: its whole
    text). Rare means in few claims, so common words and runs bring no pairs. Each candidate is then tested.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    size = lambda c: F.least(F.length(c), F.lit(GRAM))
    # a look-ahead at each character, so a long claim is read once
    runs = lambda c, k: F.array_distinct(F.regexp_extract_all(c, F.concat(F.lit("(?s)(?=(.{"), k.cast("string"), F.lit("}))")), F.lit(1)))
    f = cut(facts.where(F.trim("text") != "").groupBy(F.lower("text").alias("fact")).agg(F.collect_set("fact_id").alias("ids")).withColumn("fw", words(F.col("fact"))))
    c = cut(claims.where("claim is not null").select("claim").distinct().select("claim", F.lower("claim").alias("low")))

    def met(of_fact: Column, of_claim: Column, most: Column) -> DataFrame:
        """(claim, fact) that share one of the ``most`` pieces of the fact that are in the fewest claims."""
        pieces = f.select("fact", most.alias("most"), F.explode(of_fact).alias("piece"))
        found = cut(c.select("claim", F.explode(of_claim).alias("piece")).join(pieces.select("piece").distinct(), "piece"))
        often = found.groupBy("piece").agg(F.count("*").alias("often"))
        rarest = pieces.join(often, "piece", "left").groupBy("fact", "most").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece"))).alias("all"))
        wanted = rarest.select("fact", F.explode(F.slice("all", 1, F.col("most"))).alias("of")).select("fact", "of.piece")
        return found.join(wanted, "piece").select("claim", "fact")

    by_word = met(F.col("fw"), words(F.col("claim")), F.size("fw") - F.floor(F.size("fw") * 0.8).cast("int"))
    lengths = [r.k for r in f.select(size(F.col("fact")).alias("k")).distinct().collect()]
    grams = F.concat(*[F.when(F.length("low") >= k, runs(F.col("low"), F.lit(k))).otherwise(F.array().cast("array<string>")) for k in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    by_text = met(runs(F.col("fact"), size(F.col("fact"))), grams, F.lit(1))
    both = by_word.union(by_text).distinct().join(f, "fact")
    held = F.size(F.array_intersect(words(F.col("claim")), F.col("fw"))) / F.size("fw") > 0.8
    over = both.where(F.contains(F.lower("claim"), F.col("fact")) | held).select("claim", F.explode("ids").alias("fact_id"))
    first = claims.join(over, "claim").groupBy("source_id", "fact_id").agg(F.min_by("claim", F.struct("claim_index", "claim")).alias("claim"))
    return first


def _no_locator() -> Column:
    return ~(T.filled(F.col("doi")) | T.filled(F.col("pdf_url")) | T.filled(F.col("url")))


def challenge_claims(claims: DataFrame) -> DataFrame:
    """One row per weakness of a claim (claim, evidence, confidence; doi, pdf_url and url of its source)."""
    short = F.size(F.filter(F.split("claim", r"\s+"), lambda w: w != "")) < 6
    when = (F.length(T.strip(F.coalesce("evidence", F.lit("")))) < 20, F.col("confidence") == "low", _no_locator(), short)
    told = lambda c: F.struct(*[F.lit(v).alias(name) for v, name in zip(c, ("severity", "kind", "reason", "requested_evidence"), strict=True)])
    found = F.array(*[F.when(w, told(c)) for w, c in zip(when, CHALLENGES, strict=True)])
    return claims.select("campaign_id", "source_id", "claim_index", F.col("claim").alias("claim_text"), F.explode(F.array_compact(found)).alias("c")).select("campaign_id", "source_id", "claim_index", "claim_text", "c.*")


def verify_claims(claims: DataFrame, url_status: DataFrame | None = None) -> DataFrame:
    """``ok`` and ``reason`` for each claim with its source's text (source_text, doi, pdf_url, url).

    ``url_status`` (url, status): a URL of 400 or more, or without a row, is not reachable. A claim's ``place``, where there is one, is handed on.
    """
    evidence = F.coalesce("evidence", F.lit(""))
    reasons = [
        F.when(evidence == "", NO_QUOTE).when(~F.contains(T.normalize_ws(F.coalesce("source_text", F.lit(""))), T.normalize_ws(evidence)), NOT_FOUND),
        F.when(_no_locator(), NO_PLACE).when(T.filled(F.col("doi")) & ~T.doi_is_valid(F.col("doi"), loose=True), BAD_DOI),
    ]
    if url_status is not None:
        claims = claims.withColumn("__url", F.coalesce("pdf_url", "url")).join(url_status.select(F.col("url").alias("__url"), "status"), "__url", "left")
        reasons.append(F.when(F.col("__url").isNotNull() & (F.coalesce("status", F.lit(999)) >= 400), UNREACHABLE))
    reason = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return claims.withColumn("__r", reason).select("campaign_id", "source_id", "claim_index", F.col("claim").alias("claim_text"), (F.col("__r") == "").alias("ok"), F.when(F.col("__r") == "", PASSED).otherwise(F.col("__r")).alias("reason"), *[c for c in ("place",) if c in claims.columns])


def parse_review_lines(replies: DataFrame, claims: DataFrame) -> DataFrame:
    """Challenges of kind llm_audit from replies of ``severity | number | reason | requested`` lines; claims have ``flat_index``."""
    lines = replies.select("campaign_id", F.explode(F.split(T.strip(F.col("reply")), "\n")).alias("line"))
    parts = F.transform(F.split("line", r"[|]", -1), T.strip)
    rows = lines.select("campaign_id", parts.alias("p")).where(F.size("p") == 4).where(F.get("p", F.lit(0)).isin("high", "medium", "low"))
    rows = rows.select("campaign_id", F.get("p", F.lit(0)).alias("severity"), F.get("p", F.lit(1)).try_cast("int").alias("flat_index"), F.get("p", F.lit(2)).alias("reason"), F.get("p", F.lit(3)).alias("requested_evidence"))
    return rows.join(claims.select("campaign_id", "flat_index", "source_id", F.col("claim").alias("claim_text")), ["campaign_id", "flat_index"]).withColumn("kind", F.lit("llm_audit"))


def parse_audit_sections(replies: DataFrame) -> DataFrame:
    """(reply_id, section, nth, item): bullets by the heading above them, anomalies before any."""
    lines = replies.select("reply_id", F.posexplode(F.split("reply", "\n")).alias("nth", "line")).withColumn("line", T.strip(F.col("line")))
    heading = F.when(F.startswith(F.upper("line"), F.lit("ANOMALIES")), "anomalies").when(F.startswith(F.upper("line"), F.lit("RECOMMENDATIONS")), "recommendations")
    above = Window.partitionBy("reply_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(above), F.lit("anomalies")))
    return rows.where(F.startswith("line", F.lit("-"))).select("reply_id", "section", "nth", T.strip(F.regexp_replace("line", "^-+", "")).alias("item"))
