"""Queries of claims, citations, challenges, verification, scores and the flagship."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import evaluate as E
from ..operators.shared import cut, few
from ..plans.campaign import extract_sources, run_campaigns
from ..plans.store import StageStore, run_stored
from ..registry import query
from ..sources.files import read_documents, write_documents
from ..testviews import table, view
from .sources import _shared

_SENT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_MARKED = "regexp_matches(lower(s), 'we find|we found|results show|demonstrates|indicates|suggests') AND len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) >= 5"
_CLAIMS = f"c AS (SELECT paper_id, campaign_id, trim(unnest(l), ' ' || chr(10)) AS claim, unnest(range(len(l)))::INT AS claim_index FROM (SELECT paper_id, campaign_id, list_filter({_SENT}, lambda s: {_MARKED})[1:10] AS l FROM v_texts))"
_LOCATED = "l AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN '10.5555/x' END AS doi, CASE WHEN source_id % 5 = 0 THEN 'https://x.org' END AS url FROM v_claims)"
_CH = f"""{_LOCATED}, ch AS (SELECT campaign_id, source_id, claim_index, claim AS claim_text, 'high' AS severity, 'missing_evidence' AS kind FROM l WHERE length(trim(evidence)) < 20
  UNION ALL SELECT campaign_id, source_id, claim_index, claim, 'medium', 'low_confidence' FROM l WHERE confidence = 'low'
  UNION ALL SELECT campaign_id, source_id, claim_index, claim, 'high', 'missing_source' FROM l WHERE doi IS NULL AND url IS NULL
  UNION ALL SELECT campaign_id, source_id, claim_index, claim, 'low', 'coverage' FROM l WHERE len(string_split(trim(claim), ' ')) < 6)"""
_VE = """ve AS (SELECT campaign_id, source_id, claim_index, claim AS claim_text, concat_ws('; ', CASE WHEN evidence = '' THEN 'claim has no quoted evidence' WHEN claim_index % 2 = 1 THEN 'quoted evidence not found in extracted source text' END,
  CASE WHEN doi IS NULL AND url IS NULL THEN 'source has no DOI, PDF URL, or landing page' END) AS r FROM l)"""
_REPORT = f"""{_CH}, {_VE}, r AS (SELECT campaign_id, count(DISTINCT source_id) AS total_sources, count(*) AS total_claims, count(*) FILTER (claim_index = 0) AS citation_count FROM v_claims GROUP BY 1),
  h AS (SELECT campaign_id, count(DISTINCT (source_id, claim_index, kind)) AS challenged_count, count(*) FILTER (severity = 'high') AS high_severity_count FROM ch GROUP BY 1),
  v AS (SELECT campaign_id, count(*) FILTER (r = '') AS verified_count, count(*) FILTER (r <> '') AS failed_verification_count FROM ve GROUP BY 1),
  report AS (SELECT r.*, coalesce(challenged_count, 0) AS challenged_count, coalesce(high_severity_count, 0) AS high_severity_count, coalesce(verified_count, 0) AS verified_count, coalesce(failed_verification_count, 0) AS failed_verification_count
    FROM r LEFT JOIN h USING (campaign_id) LEFT JOIN v USING (campaign_id)),
  scored AS (SELECT *, 0.5 + 0.25 * (total_claims > 0)::INT + 0.25 * (citation_count > 0)::INT AS coverage_score,
    round(greatest(0.0, 1 - 0.2 * least(challenged_count / total_claims, 1.0) - 0.4 * least(high_severity_count / total_claims, 1.0) - 0.4 * least(failed_verification_count / total_claims, 1.0)), 4) AS quality_score FROM report)"""


def _located(spark, d, place_in=None):
    c = view(spark, d, "v_claims", place_in)
    return c.withColumns({"doi": F.when(c.source_id % 3 == 0, "10.5555/x"), "url": F.when(c.source_id % 5 == 0, "https://x.org"), "pdf_url": F.lit(None).cast("string"), "source_text": F.when(c.claim_index % 2 == 0, F.concat(F.lit("Seen:  "), F.upper(c.evidence)))})


def _report(spark, d):
    c = _located(spark, d)
    return E.evaluate(c.select("campaign_id", "source_id").distinct(), c, c.where("claim_index = 0"), C.challenge_claims(c), C.verify_claims(c))


@query("str_27_extract_claims", f"WITH {_CLAIMS} SELECT paper_id, claim_index, claim FROM c")
def _(spark, d):
    return C.extract_claims(view(spark, d, "v_texts")).select("paper_id", "claim_index", "claim")


@query(
    "str_28_extract_citations",
    r"""WITH a AS (SELECT paper_id, regexp_extract_all(text, '[A-Z][a-zA-Z\-]+(?:\s+(?:and|et\s+al\.)?\s*[A-Z][a-zA-Z\-]+)*\s*\(\d{4}\)') AS l1, regexp_extract_all(text, '\[\d{1,3}\]') AS l2, regexp_extract_all(text, '10\.\d{4,9}/[-._;()/:\p{L}\p{N}_]+') AS l3 FROM v_texts),
        c AS (SELECT paper_id, 'author_year' AS kind, unnest(range(len(l1)))::INT AS nth, unnest(l1) AS raw FROM a UNION ALL SELECT paper_id, 'numbered', unnest(range(len(l2)))::INT, unnest(l2) FROM a UNION ALL SELECT paper_id, 'doi', unnest(range(len(l3)))::INT, unnest(l3) FROM a)
        SELECT *, CASE WHEN kind = 'author_year' THEN array_to_string(list_filter(list_transform(string_split_regex(string_split(raw, '(')[1], '\s+(?:and|et\s+al\.)\s*'), lambda n: trim(n, ' ' || chr(10) || chr(9))), lambda n: n <> ''), ';') END AS authors,
          CASE WHEN kind = 'author_year' THEN regexp_extract(raw, '\((\d{4})\)', 1)::INT END AS year, CASE WHEN kind = 'doi' THEN raw END AS doi FROM c""",
)
def _(spark, d):
    return C.extract_citations(view(spark, d, "v_texts")).select("paper_id", "kind", "nth", "raw", F.array_join("authors", ";").alias("authors"), "year", "doi")


@query("str_28b_citation_context", r"WITH t AS (SELECT paper_id, text, strpos(text, 'See [') + 4 AS p, length(regexp_extract(text, 'See (\[\d{1,3}\])', 1)) AS n FROM v_texts) SELECT paper_id, trim(replace(substr(text, greatest(1, p - 120), p + n + 120 - greatest(1, p - 120)), chr(10), ' '), ' ' || chr(9)) AS context FROM t")
def _(spark, d):
    return C.extract_citations(view(spark, d, "v_texts")).where("kind = 'numbered'").select("paper_id", "context")


_FACTS = "f AS (SELECT min(p_partkey) AS fact_id, lower('claim ' || p_name) AS fact, list_distinct(string_split('claim ' || p_name, ' ')) AS fw FROM part GROUP BY p_name)"


@query(
    "joi_11_conflicts",
    f"WITH {_FACTS}, m AS (SELECT DISTINCT claim, fact_id FROM (SELECT DISTINCT claim FROM v_claims), f WHERE contains(lower(claim), fact) OR len(list_intersect(fw, string_split(lower(claim), ' '))) / len(fw) > 0.8) SELECT source_id, fact_id, min({{'i': claim_index, 'c': claim}}).c AS claim FROM v_claims JOIN m USING (claim) GROUP BY 1, 2",
)
def _(spark, d):
    facts = table(spark, d, "part").groupBy(F.concat(F.lit("claim "), F.col("p_name")).alias("text")).agg(F.min("p_partkey").alias("fact_id"))
    return C.conflicts(view(spark, d, "v_claims"), facts)


@query("rul_08_challenge_claims", f"WITH {_CH} SELECT * FROM ch")
def _(spark, d):
    return C.challenge_claims(_located(spark, d)).select("campaign_id", "source_id", "claim_index", "claim_text", "severity", "kind")


@query("joi_12_verify_claims", f"WITH {_LOCATED}, {_VE} SELECT campaign_id, source_id, claim_index, claim_text, r = '' AS ok, CASE WHEN r = '' THEN 'claim checks passed' ELSE r END AS reason FROM ve")
def _(spark, d):
    return C.verify_claims(_located(spark, d))


@query("str_35_parse_review_lines", "SELECT p_partkey AS campaign_id, 0 AS flat_index, 'high' AS severity, 'thin' AS reason, 'more' AS requested_evidence, p_size AS source_id, 'claim ' || p_name AS claim_text, 'llm_audit' AS kind FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    claims = part.select(F.col("p_partkey").alias("campaign_id"), F.lit(0).alias("flat_index"), F.col("p_size").alias("source_id"), F.concat(F.lit("claim "), F.col("p_name")).alias("claim"))
    replies = part.select(F.col("p_partkey").alias("campaign_id"), F.lit("high | 0 | thin | more\nnone\nhuge | 0 | x | y\nlow | 7 | x | y\nlow | a | b | c").alias("reply"))
    return C.parse_review_lines(replies, claims)


@query("str_36_parse_audit_sections", "SELECT conv_id * 1000 + turn AS reply_id, unnest(['anomalies', 'recommendations']) AS section, unnest([1, 5]) AS nth, unnest(['turn ' || turn, 'check ' || role]) AS item FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    reply = F.concat(F.lit("Hello\n- turn "), F.col("turn").cast("string"), F.lit("\n\nRecommendations:\nplain\n -- check "), F.col("role"))
    return C.parse_audit_sections(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), reply.alias("reply")))


@query("agg_03_evaluate", f"WITH {_REPORT} SELECT * FROM scored")
def _(spark, d):
    return _report(spark, d)


@query("agg_04_coverage_score", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE 0.5 + 0.25 * (n_nationkey % 3 > 0)::INT + 0.25 * (n_nationkey % 2 > 0)::INT END AS coverage FROM nation")
def _(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", E.coverage_score(k % 5, k % 3, k % 2).alias("coverage"))


@query("agg_05_quality_score", f"WITH {_REPORT} SELECT campaign_id, quality_score FROM scored")
def _(spark, d):
    return _report(spark, d).select("campaign_id", "quality_score")


@query("agg_06_challenge_triage", f"WITH {_CH} SELECT campaign_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM ch GROUP BY 1")
def _(spark, d):
    return E.challenge_triage(C.challenge_claims(_located(spark, d)))


@query("agg_07_improvement_proposals", f"WITH {_REPORT} SELECT campaign_id, 'verifier' AS area, failed_verification_count || ' claims failed verification' AS issue FROM scored WHERE failed_verification_count > 0 UNION ALL SELECT campaign_id, 'devil', high_severity_count || ' high-severity challenges raised' FROM scored WHERE high_severity_count > 0")
def _(spark, d):
    return E.improvement_proposals(_report(spark, d)).select("campaign_id", "area", "issue")


_TOLD = " ".join(f"WHEN '{kind}' THEN '{reason}' || chr(10) || '  - Claim: ' || claim_text || chr(10) || '  - Requested evidence: {wanted}'" for _, kind, reason, wanted in C.CHALLENGES)
_BRIEF = f"""WITH {_REPORT}, cl AS (SELECT campaign_id, list(claim || chr(10) ORDER BY source_id, claim_index, claim) AS l FROM (SELECT campaign_id, source_id, claim_index, '. **' || claim || '**' || chr(10) || '   - Evidence: ' || coalesce(nullif(evidence, ''), 'none') || chr(10) || '   - Confidence: ' || confidence || chr(10) || '   - Source: paper ' || source_id || ' (' || coalesce(url, 'no URL') || ')' AS claim FROM l) GROUP BY 1),
  hl AS (SELECT campaign_id, string_agg('- **[' || upper(severity) || ']** ' || kind || ': ' || CASE kind {_TOLD} END || chr(10), chr(10) ORDER BY source_id, claim_index, kind, claim_text) AS lines FROM ch GROUP BY 1),
  vl AS (SELECT campaign_id, string_agg('- ' || claim_text || chr(10) || '  - Reason: ' || r || chr(10), chr(10) ORDER BY source_id, claim_index, claim_text) AS lines FROM ve WHERE r <> '' GROUP BY 1)
  SELECT campaign_id, '# Research Brief: q' || campaign_id || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- Sources reviewed: **' || total_sources || '**' || chr(10) || '- Claims extracted: **' || total_claims || '**' || chr(10) || '- Citations found: **' || citation_count || '**' || chr(10)
    || '- Claims challenged: **' || challenged_count || '** (' || high_severity_count || ' high severity)' || chr(10) || '- Verifications passed: **' || verified_count || '/' || (verified_count + failed_verification_count) || '**' || chr(10)
    || '- Coverage score: **' || format('{{:.2f}}', coverage_score::DOUBLE) || '**' || chr(10) || '- Quality score: **' AS head, quality_score, array_to_string(list_transform(l, lambda x, i: i || x), chr(10)) || chr(10) AS claims,
    '## Challenges' || chr(10) || chr(10) || hl.lines || chr(10) AS challenged, '## Failed Verifications' || chr(10) || chr(10) || vl.lines || chr(10) AS failed
  FROM scored JOIN cl USING (campaign_id) LEFT JOIN hl USING (campaign_id) LEFT JOIN vl USING (campaign_id)"""


def _brief_inputs(spark, d):
    c = _located(spark, d, "lineitem").withColumns({"title": F.concat(F.lit("paper "), F.col("source_id").cast("string")), "full_text_url": F.col("url")})
    report = cut(_report(spark, d).withColumn("query", F.concat(F.lit("q"), F.col("campaign_id").cast("string"))))
    return report, c, C.challenge_claims(c), C.verify_claims(c)


def _brief_parts(brief, report):
    """The whole brief in its parts; the quality score as a number, as the engines round halves apart."""
    score, claims = "Quality score: **", f"\n{E.CLAIMS}\n\n"
    # by UTF-8 bytes, as a pattern would take copies of the whole brief
    after = lambda mark, skip: F.when(F.contains("brief", F.lit(mark)), F.substr("brief", F.instr("brief", mark) + skip))
    until = lambda text, *marks: F.nullif(reduce(lambda t, m: F.substring_index(t, m, 1), marks, text), F.lit(""))
    return brief.join(few(report.select("campaign_id", "quality_score")), "campaign_id").select(
        "campaign_id",
        "quality_score",
        F.concat(F.substring_index("brief", score, 1), F.lit(score)).alias("head"),
        until(after(claims, len(claims)), "## Challenges", "## Failed", "## Caveats").alias("claims"),
        until(after(f"\n{E.CHALLENGED}\n\n", 1), "## Failed", "## Caveats").alias("challenged"),
        until(after(f"\n{E.FAILED}\n\n", 1), "## Caveats").alias("failed"),
    )


@query("agg_08_render_brief", _BRIEF)
def _(spark, d):
    report, *more = _brief_inputs(spark, d)
    return _brief_parts(E.render_brief(report, *more), report)


@query("agg_08b_brief_documents", _BRIEF)
def _(spark, d):
    """Briefs written line by line, a file a campaign, and read back."""
    inputs, path = _brief_inputs(spark, d), _shared(spark, "briefs")
    write_documents(E.brief_lines(*inputs), "campaign_id", list(E.LINE_ORDER), path, lie=True)
    return _brief_parts(read_documents(spark, path).select(F.col("campaign_id").cast("long").alias("campaign_id"), F.col("value").alias("brief")), inputs[0])


@query("src_15_brief_index", "SELECT '# Research Insights' || chr(10) || chr(10) || 'Aggregated insight briefs from all research campaigns.' || chr(10) || chr(10) || '## Campaigns' || chr(10) || chr(10) || string_agg('- [' || CASE WHEN r_regionkey = 0 THEN lower(r_name) ELSE 'On ' || r_name END || '](./' || lower(r_name) || '/' || lower(r_name) || '_Insights.MD) — `' || lower(r_name) || '`', chr(10) ORDER BY lower(r_name)) || chr(10) AS index FROM region")
def _(spark, d):
    r = table(spark, d, "region")
    return E.brief_index(r.select(F.lower("r_name").alias("slug"), F.when(F.col("r_regionkey") == 0, F.lit("none")).otherwise(F.concat(F.lit("x\n# On "), F.col("r_name"), F.lit("\n# no"))).alias("brief")))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _section(words):
    wanted = " OR ".join(f"contains(lower(s), '{w}')" for w in words)
    marks = f"list_transform(lines, lambda s: starts_with(trim(s, {_BLANK}), '#') AND ({wanted}))"
    after = f"lines[list_position({marks}, true) + 1:]"
    stop = f"list_position(list_transform({after}, lambda s: starts_with(trim(s, {_BLANK}), '#')), true)"
    return f"CASE WHEN list_contains({marks}, true) THEN trim(array_to_string(CASE WHEN {stop} > 0 THEN {after}[:{stop} - 1] ELSE {after} END, chr(10)), {_BLANK}) ELSE '' END"


_SPACED = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'), " + _BLANK + ")"
_READ = rf"""lined AS (SELECT *, string_split(text, chr(10)) AS lines, coalesce(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: trim(b, {_BLANK})), lambda b: b <> '')[1], coalesce(abstract, '')) AS summary FROM src),
  sections AS (SELECT *, {_section(("method", "methodology", "approach"))} AS methodology, {_section(("data", "dataset", "materials", "corpus"))} AS data_summary, {_section(("results", "findings", "evaluation"))} AS results_summary,
    list_transform(list_filter({_SENT}, lambda s: {_MARKED})[1:10], lambda s: trim(s, {_BLANK})) AS claims,
    len(regexp_extract_all(text, '[A-Z][a-zA-Z\-]+(?:\s+(?:and|et\s+al\.)?\s*[A-Z][a-zA-Z\-]+)*\s*\(\d{{4}}\)')) + len(regexp_extract_all(text, '\[\d{{1,3}}\]')) + len(regexp_extract_all(text, '10\.\d{{4,9}}/[-._;()/:\p{{L}}\p{{N}}_]+')) AS n_citations FROM lined)"""
_SOURCE_FACTS = "f AS (SELECT r_regionkey AS fact_id, fact, list_distinct(string_split(fact, ' ')) AS fw FROM (SELECT r_regionkey, lower(CASE WHEN r_regionkey % 2 = 0 THEN 'suggests that the of' ELSE 'in it. the of ' || r_name END) AS fact FROM region))"


@query(
    "rul_11_extract_sources",
    rf"""WITH src AS (SELECT paper_id, text, NULL::VARCHAR AS abstract FROM v_texts), {_READ}, {_SOURCE_FACTS}
        SELECT paper_id, summary, methodology, data_summary, results_summary, array_to_string(claims, '|') AS claims, n_citations AS citation_count, length(text) AS char_count,
          (SELECT count(*) FROM f WHERE len(list_filter(claims, lambda c: contains(lower(c), fact) OR len(list_intersect(fw, string_split_regex(lower(c), '\s+'))) / len(fw) > 0.8)) > 0) AS conflict_count FROM sections""",
)
def _(spark, d):
    fact = F.when(F.col("r_regionkey") % 2 == 0, "suggests that the of").otherwise(F.concat(F.lit("in it. the of "), F.col("r_name")))
    facts = table(spark, d, "region").select(F.col("r_regionkey").alias("fact_id"), fact.alias("text"))
    found = extract_sources(view(spark, d, "v_texts").withColumn("abstract", F.lit(None).cast("string")), facts)
    counts = [F.col(c).cast("long").alias(c) for c in ("citation_count", "char_count", "conflict_count")]
    return found.select("paper_id", "summary", "methodology", "data_summary", "results_summary", F.array_join("claims.claim", "|").alias("claims"), *counts)


_URL = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^https?://', ''), 'www\.', '', 'g'), '/+$', '')"
_CAMPAIGNS = rf"""WITH RECURSIVE plan AS (SELECT campaign_id, max_sources, s.source, 2 * s.nth + k AS plan_pos, CASE k WHEN 0 THEN query ELSE 'evidence topic' END AS query FROM v_requests, (VALUES (0, 'arxiv'), (1, 'crossref'), (2, 'openalex'), (3, 'semantic_scholar')) s(nth, source), range(2) r(k)),
  answered AS (SELECT campaign_id, max_sources, plan_pos::BIGINT * 4294967296 + row_pos AS pos, v.* FROM plan JOIN v_results v USING (source, query)),
  p AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY pos) AS n, lower(trim(doi)) AS d, nullif({_URL}, '') AS u, coalesce(lower(doi), lower(url), lower(trim(title)) || '::' || coalesce(year::VARCHAR, 'None')) AS paper_key FROM answered WHERE error IS NULL),
  walk(campaign_id, n, canon) AS (SELECT DISTINCT campaign_id, 0::BIGINT, CAST([] AS STRUCT(pos BIGINT, d VARCHAR, u VARCHAR)[]) FROM p
    UNION ALL SELECT p.campaign_id, p.n, CASE WHEN len(list_filter(canon, lambda c: CASE WHEN c.d IS NOT NULL AND p.d IS NOT NULL THEN c.d = p.d ELSE coalesce(c.u = p.u, false) END)) > 0 THEN canon ELSE list_append(canon, {{'pos': p.pos, 'd': p.d, 'u': p.u}}) END
    FROM walk w JOIN p ON p.campaign_id = w.campaign_id AND p.n = w.n + 1),
  canon AS (SELECT campaign_id, unnest(canon).pos AS pos FROM (SELECT * FROM walk QUALIFY n = max(n) OVER (PARTITION BY campaign_id))),
  k AS (SELECT p.*, row_number() OVER (PARTITION BY campaign_id ORDER BY pos) AS nth FROM p JOIN canon USING (campaign_id, pos)),
  ways AS (SELECT src, dst FROM v_citations UNION SELECT dst, src FROM v_citations),
  snow AS (SELECT k.campaign_id, k.max_sources, k.pos AS seed_pos, v.* FROM k JOIN ways w ON w.src = k.paper_id JOIN v_papers v ON v.paper_id = w.dst WHERE nth <= max_sources AND w.dst <> w.src),
  both_ AS (SELECT campaign_id, max_sources, 0 AS late, pos AS seed_pos, NULL::BIGINT AS node, doi, url, title, year, pdf_url, source, source_id FROM k
    UNION ALL SELECT campaign_id, max_sources, 1, seed_pos, paper_id, doi, url, title, year, pdf_url, source, source_id FROM snow),
  budget AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY late, seed_pos, node) AS rank FROM both_ QUALIFY rank <= max_sources),
  places AS (SELECT campaign_id, coalesce(lower(doi), lower(url), lower(trim(title)) || '::' || coalesce(year::VARCHAR, 'None')) AS paper_key,
    max({{'rank': rank, 'url': CASE WHEN pdf_url IS NOT NULL THEN pdf_url WHEN source = 'arxiv' THEN 'https://arxiv.org/pdf/' || source_id || '.pdf' WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi END, 'is_oa': pdf_url IS NOT NULL OR source = 'arxiv'}}) AS place FROM budget GROUP BY 1, 2),
  cards AS (SELECT *, {{score}} AS total_score FROM k),
  included AS (SELECT * FROM cards WHERE pdf_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY total_score DESC, pos) <= max_sources),
  content AS (SELECT 'https://pdf.example.org/' || paper_id || '.pdf' AS place_url, text AS content FROM v_texts UNION ALL SELECT 'https://arxiv.org/pdf/' || paper_id || '.pdf', text FROM v_texts),
  src AS (SELECT i.*, CASE WHEN place.is_oa AND content IS NOT NULL THEN content ELSE coalesce(abstract, '') END AS text FROM included i LEFT JOIN places USING (campaign_id, paper_key) LEFT JOIN content ON place_url = place.url),
  {_READ},
  claim AS (SELECT campaign_id, pos, doi, c AS claim, contains({_SPACED.format("concat_ws(' ', summary, methodology, data_summary, results_summary)")}, {_SPACED.format("c")}) AS held FROM (SELECT *, unnest(claims) AS c FROM sections)),
  counted AS (SELECT campaign_id, count(*) AS total_sources, sum(len(claims))::BIGINT AS total_claims, sum(n_citations)::BIGINT AS citation_count FROM sections GROUP BY 1),
  judged AS (SELECT campaign_id, count(*) + count(*) FILTER (length(trim(claim, {_BLANK})) < 20) + count(*) FILTER (len(list_filter(string_split_regex(claim, '\s+'), lambda w: w <> '')) < 6) AS challenged_count,
    count(*) FILTER (length(trim(claim, {_BLANK})) < 20) AS high_severity_count, count(*) FILTER (held) AS verified_count, count(*) FILTER (NOT held) AS failed_verification_count FROM claim GROUP BY 1),
  n AS (SELECT v.campaign_id, v.query, (SELECT count(*) FROM p WHERE p.campaign_id = v.campaign_id) AS raw, (SELECT count(*) FROM k WHERE k.campaign_id = v.campaign_id) AS canonical, (SELECT count(*) FROM snow WHERE snow.campaign_id = v.campaign_id) AS snowball,
    (SELECT count(*) FROM budget b WHERE b.campaign_id = v.campaign_id) AS resolved, (SELECT coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') FROM answered a WHERE a.campaign_id = v.campaign_id AND error IS NOT NULL) AS errors,
    coalesce(total_sources, 0) AS total_sources, coalesce(total_claims, 0) AS total_claims, coalesce(citation_count, 0) AS citation_count, coalesce(challenged_count, 0) AS challenged_count, coalesce(high_severity_count, 0) AS high_severity_count,
    coalesce(verified_count, 0) AS verified_count, coalesce(failed_verification_count, 0) AS failed_verification_count FROM v_requests v LEFT JOIN counted USING (campaign_id) LEFT JOIN judged USING (campaign_id))
  SELECT *, CASE WHEN total_sources = 0 THEN 0.0 ELSE 0.5 + 0.25 * (total_claims > 0)::INT + 0.25 * (citation_count > 0)::INT END AS coverage_score,
    CASE WHEN total_claims = 0 THEN 0.0 ELSE round(greatest(0.0, 1 - 0.2 * least(challenged_count / total_claims, 1.0) - 0.4 * least(high_severity_count / total_claims, 1.0) - 0.4 * least(failed_verification_count / total_claims, 1.0)), 4) END AS quality_score FROM n"""
_SCORE = "round((CASE WHEN pdf_url IS NOT NULL THEN 1.0 ELSE 0.0 END) + 0.5 * (CASE WHEN year >= 2000 THEN 1.0 ELSE 0.0 END) + CASE WHEN relevance IS NULL THEN 0.0 ELSE (greatest(3, least(5, relevance)) - 3) / 2.0 END, 4)"


def _inputs(spark, d):
    """Two sources are answered by the cache, which ``found`` answers too, so that only one of both may count. Search results are a table of their own."""
    results = view(spark, d, "v_results")
    fields = [c for c in results.columns if c not in ("query", "row_pos", "error")]
    path = _shared(spark, "results")
    results.select("source", "query", "row_pos", "error", F.struct(*fields).alias("paper")).write.parquet(path)
    found = spark.read.parquet(path)
    papers = view(spark, d, "v_papers").withColumn("relevance", F.lit(None).cast("int"))
    texts = view(spark, d, "v_texts")
    place = lambda host: F.concat(F.lit(host), F.col("paper_id").cast("string"), F.lit(".pdf")).alias("url")
    content = texts.select(place("https://pdf.example.org/"), F.col("text").alias("content")).unionByName(texts.select(place("https://arxiv.org/pdf/"), F.col("text").alias("content")))
    known = papers.select(F.struct(*fields).alias("paper"))
    cache = found.where("source in ('arxiv', 'openalex')")
    return {"requests": view(spark, d, "v_requests"), "cache": cache, "found": found, "known": known, "content": content, "edges": view(spark, d, "v_citations")}


@query("rul_12_run_campaigns", _CAMPAIGNS.replace("{score}", _SCORE))
def _(spark, d):
    return run_campaigns(**_inputs(spark, d)).report.withColumn("errors", F.array_join("errors", ","))


@query("rul_12b_stored_campaigns", _CAMPAIGNS.replace("{score}", _SCORE))
def _(spark, d):
    """Run twice over one store: the report is what the second run reads again."""
    store, inputs = StageStore(spark, _shared(spark, "campaigns")), _inputs(spark, d)
    run_stored(store, **inputs)
    again, state = run_stored(store, **inputs)
    return again.report.join(state.where("not fresh").select("campaign_id"), "campaign_id", "left_semi").withColumn("errors", F.array_join("errors", ","))
