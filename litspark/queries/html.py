"""Queries of the HTML, redaction and URL rules (STR-07, 08, 12..19, 21..23, 29..32; FIL-05, 06)."""

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import redact as R
from ..functions import urls as U
from ..registry import query
from ..testviews import table, view

_CLEAN = r"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"
_NL = "chr(10)"


def _sub(x: str, pattern: str, into: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {into}, 'g')"


def _splice(x: str, pattern: str, group: int, render: str) -> str:
    """``render`` is SQL over m, the matches' ``group``."""
    gaps, hits = f"string_split_regex({x}, '{pattern}')", f"list_transform(regexp_extract_all({x}, '{pattern}', {group}), lambda m: {render})"
    return f"array_to_string(flatten(list_transform(list_zip({gaps}, {hits}), lambda z: [z[1], coalesce(z[2], '')])), '')"


def _noise(x: str) -> str:
    for tag in H.NOISE:
        x = _sub(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "''")
    return x


def _emphasis(x: str) -> str:
    for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*")):
        x = _sub(x, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", rf"'{mark}\1{mark}'")
    return x


_H1 = lambda x: _splice(x, "(?is)<h1[^>]*>(.*?)</h1>", 1, f"'# ' || {_CLEAN.format(x='m')} || chr(10) || chr(10)")
_LINK = lambda x: _sub(x, r'(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>', r"'[\2](\1)'")
_ITEMS = f"array_to_string(list_transform(regexp_extract_all(m, '(?is)<li\\b[^>]*>(.*?)</li>', 1), lambda i: '- ' || {_CLEAN.format(x='i')}), chr(10)) || chr(10) || chr(10)"
_LISTS = lambda x: _splice(x, r"(?is)<ul\b[^>]*>(.*?)</ul>", 1, _ITEMS)
_TITLE = "trim(coalesce(nullif(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1), ''), nullif(regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1), '')))"


def _paragraphs(x: str) -> str:
    x = _sub(x, "(?i)</?(?:div|section|article|main|body)[^>]*>", "chr(10) || chr(10)")
    x = _sub(x, r"(?i)<br\s*/?>", "chr(10)")
    return _sub(_sub(x, r"(?i)</p\b[^>]*>", "chr(10) || chr(10)"), "<[^>]+>", "''")


def _collapse(x: str) -> str:
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '\\s+$', '')), chr(10))"
    return f"trim({_sub(x, chr(92) + 'n{3,}', 'chr(10) || chr(10)')}, ' ' || chr(9) || chr(10) || chr(13))"


VISIBLE = _CLEAN.format(x=_sub(_sub(_sub('html', '(?is)<script[^>]*>.*?</script>', chr(39) * 2), '(?is)<style[^>]*>.*?</style>', chr(39) * 2), '(?i)</(p|div|h[1-6]|li)>', _NL))


@query("str_12_visible_text", f"SELECT page_id, {VISIBLE} AS visible FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.visible_text(F.col("html")).alias("visible"))


@query("str_13_html_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.html_title(F.col("html")).alias("title"))


@query("str_14_drop_noise", f"SELECT page_id, {_noise('html')} AS clean FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.drop_noise(F.col("html")).alias("clean"))


@query("str_15_html_headings", f"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda m: '1:' || {_CLEAN.format(x='m')}), '|') AS headings, {_H1('html')} AS rendered FROM pages")
def _(spark, d):
    listed = F.array_join(F.transform(H.headings(F.col("html")), lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])), "|")
    return table(spark, d, "pages").select("page_id", listed.alias("headings"), H.render_headings(F.col("html")).alias("rendered"))


@query("str_16_html_emphasis", f"SELECT page_id, {_emphasis('html')} AS rendered FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.emphasis(F.col("html")).alias("rendered"))


@query("str_17_html_links", f"""SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<a\\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1), '|') AS hrefs, {_LINK('html')} AS rendered FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(H.links(F.col("html")), lambda x: x["href"]), "|").alias("hrefs"), H.render_links(F.col("html")).alias("rendered"))


@query("str_18_html_lists", f"SELECT page_id, {_LISTS('html')} AS rendered FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.render_lists(F.col("html")).alias("rendered"))


@query(
    "str_19_html_tables",
    "SELECT page_id, '| page | url |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | ' || url || ' |' || chr(10) || chr(10) AS rendered FROM pages",
)
def _(spark, d):
    made = F.concat(F.lit("<table><tr><th>page</th><th> url</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td><b>"), F.col("url"), F.lit("</b></td></tr></table><table></table>"))
    return table(spark, d, "pages").select("page_id", H.render_tables(made).alias("rendered"))


@query("str_21_html_paragraphs", f"SELECT page_id, {_paragraphs('html')} AS rendered FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.paragraphs(F.col("html")).alias("rendered"))


@query("str_22_collapse_blank_lines", f"SELECT page_id, {_collapse(_paragraphs('html'))} AS rendered FROM pages")
def _(spark, d):
    return table(spark, d, "pages").withColumn("p", H.paragraphs(F.col("html"))).select("page_id", H.collapse_blank_lines(F.col("p")).alias("rendered"))


@query(
    "str_23_html_to_markdown",
    f"""WITH a AS (SELECT page_id, {_TITLE} AS title, {_noise('html')} AS n FROM pages), b AS (SELECT page_id, title, {_H1('n')} AS x FROM a),
        c AS (SELECT page_id, title, {_LINK(_emphasis('x'))} AS x FROM b), e AS (SELECT page_id, title, {_LISTS('x')} AS x FROM c)
        SELECT page_id, title, {_collapse(_paragraphs('x'))} AS markdown FROM e""",
)
def _(spark, d):
    return H.markdown_columns(table(spark, d, "pages"), "html").select("page_id", "title", "markdown")


_WORDS_SQL = R.WORDS
_Q = r"[\x27\x22]?"
_SECRETS = lambda x: (
    rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?i)({_WORDS_SQL})(\s*[:=]\s*){_Q}[\w\-/+=.]{{8,}}{_Q}', '\1\2[REDACTED]', 'g'), "
    rf"'(?i)(Bearer\s+){_Q}[\w\-/+=.]{{8,}}{_Q}', '\1[REDACTED]', 'g'), '(?i)(Basic\s+){_Q}[A-Za-z0-9+/=]{{8,}}{_Q}', '\1[REDACTED]', 'g')"
)


@query("str_29_redact_secrets", f"SELECT doc_id, {_SECRETS('text')} AS redacted FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", R.redact_secrets(F.col("text")).alias("redacted"))


@query("str_30_redact_url", "SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?q=a+b&token=[REDACTED]&x=' AS redacted FROM pages")
def _(spark, d):
    url = F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^(https?://)", "$1me:secret@"), F.lit("?q=a+b&token=abc&x"))
    return table(spark, d, "pages").select("page_id", R.redact_url(url).alias("redacted"))


@query("str_31_redact_map", "SELECT history_id, '[REDACTED]' AS token, 'step ' || action_type || ' token=[REDACTED]' AS note, outcome FROM v_log")
def _(spark, d):
    m = F.create_map(F.lit("Token"), F.lit("x"), F.lit("note"), F.col("request_summary"), F.lit("outcome"), F.col("outcome"))
    log = view(spark, d, "v_log").withColumn("m", R.redact_map(m))
    return log.select("history_id", F.col("m")["Token"].alias("token"), F.col("m")["note"].alias("note"), F.col("m")["outcome"].alias("outcome"))


@query("str_31b_redact_json", """SELECT event_id, '{"k": {"list": ["password=[REDACTED]", 1], "Api-Key": "[REDACTED]"}, "type": "' || event_type || '"}' AS redacted FROM events""")
def _(spark, d):
    made = F.concat(F.lit('{"k": {"list": ["password=abcdefgh1", 1], "Api-Key": 5}, "type": "'), F.col("event_type"), F.lit('"}'))
    return table(spark, d, "events").select("event_id", R.redact_json(made).alias("redacted"))


@query("str_32_redact_headers", "SELECT history_id, '[REDACTED]' AS auth, '[REDACTED]' AS cookie, agent_name AS agent FROM v_log")
def _(spark, d):
    m = F.create_map(F.lit("Authorization"), F.lit("x"), F.lit("Set-Cookie"), F.lit("y"), F.lit("User-Agent"), F.col("agent_name"))
    log = view(spark, d, "v_log").withColumn("m", R.redact_headers(m))
    return log.select("history_id", F.col("m")["Authorization"].alias("auth"), F.col("m")["Set-Cookie"].alias("cookie"), F.col("m")["User-Agent"].alias("agent"))


@query("str_07_canonical_source_id", "SELECT obs_id, lower(regexp_replace(regexp_extract(canonical_url, '^[a-z]+://[^?#]*'), '/+$', '')) AS canonical_id FROM v_sources")
def _(spark, d):
    return view(spark, d, "v_sources").select("obs_id", U.canonical_source_id(F.col("canonical_url")).alias("canonical_id"))


@query("str_08_url_host", "SELECT obs_id, lower(regexp_extract(canonical_url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM v_sources")
def _(spark, d):
    return view(spark, d, "v_sources").select("obs_id", U.url_host(F.col("canonical_url")).alias("host"))


_URLS = """CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN 'ftp://x.org/' || page_id WHEN 2 THEN 'https://me@x.org/' || page_id WHEN 3 THEN 'http://127.0.0.' || (page_id % 250) || '/'
  WHEN 4 THEN 'http://0x7f.1/' WHEN 5 THEN 'http://x.org:' || (8000 + page_id) || '/' WHEN 6 THEN 'http://8.8.' || (page_id % 250) || '.1/' WHEN 7 THEN 'https://a.local/' ELSE 'http://%6cocalhost/' END"""
_VERDICTS = """CASE page_id % 9 WHEN 0 THEN 'allowed' WHEN 1 THEN 'scheme ''ftp'' not allowed' WHEN 2 THEN 'URLs with credentials are not allowed' WHEN 3 THEN 'non-public numeric host 127.0.0.' || (page_id % 250) || ' blocked'
  WHEN 4 THEN 'non-public numeric host 0x7f.1 blocked' WHEN 5 THEN 'port ' || (8000 + page_id) || ' not allowed' WHEN 6 THEN 'allowed' WHEN 7 THEN 'local hostname blocked' ELSE 'localhost/loopback blocked' END"""


@query("fil_05_url_policy", f"SELECT page_id, {_VERDICTS} AS reason, page_id % 9 IN (0, 6) AS allowed FROM pages")
def _(spark, d):
    return table(spark, d, "pages").withColumn("v", U.url_policy(F.expr(_URLS))).select("page_id", F.col("v.reason").alias("reason"), F.col("v.allowed").alias("allowed"))


@query(
    "fil_06_numeric_host_public",
    """WITH h AS (SELECT user_id, event_id, (event_id * 7919 % 4294967296) AS n FROM events), p AS (SELECT event_id, n, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c FROM h)
       SELECT event_id, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
         OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS is_public FROM p""",
)
def _(spark, d):
    n = F.expr("event_id * 7919 % 4294967296")
    dotted = F.concat_ws(".", *[F.floor(n / 256**k).cast("long") % 256 for k in (3, 2, 1, 0)])
    host = F.when(F.col("event_id") % 3 == 0, n.cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("0x"), F.lower(F.hex(n)))).otherwise(dotted)
    return table(spark, d, "events").select("event_id", U.numeric_host_public(host).alias("is_public"))
