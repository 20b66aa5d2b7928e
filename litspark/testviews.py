"""Views over the driver's tables that stand in for papers, claims, logs and campaigns.

The same text runs on Spark and DuckDB but for the slots in angle brackets.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
STAGES = ("init", "plan", "discover", "screen", "extract", "adversarial", "evaluate", "deliver", "finalize")
_SPARK = {"<json_k>": "get_json_object(props, '$.k')", "<seconds>": "make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 5000)", "<t>": "timestamp"}
_DUCK = {"<json_k>": "json_extract_string(props, '$.k')", "<seconds>": "to_seconds(o_orderkey % 5000)", "<t>": "timestamp"}

VIEWS = {
    "v_papers": """
        select d.doc_id as paper_id, d.doc_id as pos, split_part(d.text, chr(10), 1) as title,
          cast(1995 + d.doc_id % 30 as int) as year,
          case when d.doc_id % 3 = 0 then concat('10.5555/X', cast(d.doc_id % 97 as string)) end as doi,
          case when d.doc_id % 5 <> 0 then concat('https://www.', d.source, '.example.org/', cast(d.doc_id % 211 as string), '/') end as url,
          case when d.doc_id % 2 = 0 then concat('https://pdf.example.org/', cast(d.doc_id as string), '.pdf') end as pdf_url,
          d.text as abstract,
          case d.doc_id % 4 when 0 then 'semantic_scholar' when 1 then 'crossref' when 2 then 'arxiv' else 'openalex' end as source,
          cast(d.doc_id as string) as source_id, cast(d.n_chars % 100 as int) as citation_count, d.doc_id % 10 as campaign_id
        from {documents} d""",
    "v_texts": """
        select d.doc_id as paper_id, d.doc_id % 10 as campaign_id,
          concat('# Paper ', cast(d.doc_id as string), chr(10), chr(10), 'We find that ', substr(d.text, 1, 200), '.', chr(10), chr(10),
            '## Method', chr(10), substr(d.text, 201), chr(10), '## Data', chr(10), 'See [', cast(d.doc_id % 50 as string), '] and 10.5555/x', cast(d.doc_id % 97 as string), chr(10),
            '## Results', chr(10), 'Doe (', cast(1990 + d.doc_id % 30 as string), ') suggests that the of and in it.', chr(10)) as text
        from {documents} d""",
    "v_requests": """
        select doc_id % 10 as campaign_id, concat('evidence about topic ', cast(doc_id % 10 as string)) as query, '' as context, 60 as max_sources
        from {documents} group by doc_id % 10""",
    "v_results": """
        select source, query, pos as row_pos, case when source = 'crossref' and campaign_id = 3 then 'no answer' end as error, paper_id, title, year, doi, url, pdf_url, abstract, source_id, citation_count, relevance
        from (select concat('evidence about topic ', cast(d.doc_id % 10 as string)) as query, d.doc_id as pos, d.doc_id % 10 as campaign_id from {documents} d
          union all select 'evidence topic', d.doc_id, -1 from {documents} d where d.doc_id % 7 = 0) q
        join (select d.doc_id as paper_id, split_part(d.text, chr(10), 1) as title, cast(1995 + d.doc_id % 30 as int) as year,
            case when d.doc_id % 3 = 0 then concat('10.5555/X', cast(d.doc_id % 97 as string)) end as doi,
            case when d.doc_id % 5 <> 0 then concat('https://www.', d.source, '.example.org/', cast(d.doc_id % 211 as string), '/') end as url,
            case when d.doc_id % 2 = 0 then concat('https://pdf.example.org/', cast(d.doc_id as string), '.pdf') end as pdf_url, d.text as abstract,
            case d.doc_id % 4 when 0 then 'semantic_scholar' when 1 then 'crossref' when 2 then 'arxiv' else 'openalex' end as source,
            cast(d.doc_id as string) as source_id, cast(d.n_chars % 100 as int) as citation_count, l.quality * 3 + 2 as relevance
          from {documents} d left join {labels} l on l.doc_id = d.doc_id) p on p.paper_id = q.pos""",
    "v_citations": """
        select d.doc_id as src, (d.doc_id * 7 + 3) % (select count(*) from {documents}) as dst from {documents} d""",
    "v_campaigns": """
        select o_orderkey as campaign_id, concat('query ', cast(o_custkey as string)) as query, '' as context,
          cast(o_orderkey % 60 as int) as max_sources,
          case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'paused' end as status,
          cast(o_orderkey % 9 as int) as stage_pos, cast(o_orderdate as <t>) as created_at, cast(o_orderdate + <seconds> as <t>) as updated_at
        from {orders}""",
    "v_events": """
        select event_id, user_id as campaign_id, case when event_type in ('view', 'click') then 'stage_enter' else 'stage_exit' end as type,
          cast(cast(<json_k> as int) % 9 as int) as stage_pos, event_type <> 'error' as ok, cast(ts as <t>) as ts
        from {events}""",
    "v_edges": """
        select distinct l_partkey as src, (l_partkey * 7 + l_linenumber * 13) % (select count(*) from {part}) as dst
        from {lineitem} where l_linenumber <= 2""",
    "v_log": """
        select e.event_id as history_id, cast(e.ts as <t>) as ts, e.user_id % 20 as campaign_id, concat('agent', cast(e.user_id % 7 as string)) as agent_name,
          e.event_type as action_type, case e.event_type when 'error' then 'error' when 'signup' then 'cached' else 'success' end as outcome,
          concat('src', cast(e.event_id % 5 as string)) as source_name, p.url as target_url,
          concat('step ', e.event_type, ' token=abcdef', cast(10000 + e.event_id as string)) as request_summary,
          case when e.event_id % 11 = 0 then 'sensitive' else 'normal' end as audit_level
        from {events} e left join {pages} p on p.page_id = e.event_id % 50""",
    "v_sources": """
        select page_id as obs_id, url as canonical_url, concat('type', cast(page_id % 4 as string)) as source_type,
          cast(page_id % 13 as double) / 10 - 0.1 as reliability_score, concat('tag', cast(page_id % 6 as string)) as topic_tag
        from {pages}""",
    "v_claims": """
        select l_orderkey % 50 as campaign_id, l_orderkey as source_id, l_linenumber - 1 as claim_index,
          concat('claim ', p_name, ' ', p_type, ' has size ', cast(p_size as string)) as claim,
          case when l_partkey % 4 = 0 then '' else concat('size ', cast(p_size as string), ' of ', p_name, ' by ', p_brand) end as evidence,
          case l_linenumber % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence
        from {lineitem} join {part} on l_partkey = p_partkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, place_in: str | None = None) -> DataFrame:
    """A view; with ``place_in``, a table that it reads, each row has its ``place``: the file and line of that table it comes from."""
    text = VIEWS[name]
    tables = {}
    if place_in is not None:
        text = text.replace("select ", "select place, ", 1)
        tables[place_in] = table(spark, sf_dir, place_in).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    for slot, sql in _SPARK.items():
        text = text.replace(slot, sql)
    used = sorted({t for t in re.findall(r"\{(\w+)\}", text)})
    return spark.sql(text, **{t: tables[t] if t in tables else table(spark, sf_dir, t) for t in used})


def for_duckdb(sql: str) -> str:
    """The SQL with the views that it names before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    parts = []
    for v in used:
        text = re.sub(r"\{(\w+)\}", r"\1", VIEWS[v])
        for slot, with_ in _DUCK.items():
            text = text.replace(slot, with_)
        parts.append(f"{v} AS ({text})")
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE", sql, re.I) else ""
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", ", ", sql, flags=re.I) if re.match(r"\s*WITH\b", sql, re.I) else f" {sql}"
    return f"WITH {recursive}" + ", ".join(parts) + rest
