"""Operators on small fixtures: literal cases, and plain Python versions of ordered rules."""

import difflib
import ipaddress
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from litspark.functions import html, redact, text, urls
from litspark.operators import catalog, claims, dedup, evaluate, graph, plan, screen, telemetry
from litspark.operators.shared import shared_dir
from litspark.sources import files, providers
from litspark.streaming import streams
from litspark.streaming.buckets import BucketStore

PAPER = "paper_id long, pos long, title string, year int, doi string, url string"


def one(spark, value, column, type="string"):
    return spark.createDataFrame([(value,)], f"v {type}").select(column(F.col("v")).alias("r")).first().r


def papers(spark, rows):
    return spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], PAPER)


# -- deduplication


def matches(a, b, threshold=0.85):
    title = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", re.sub(r"\s*[:;—–-]\s*.*$", "", t.lower()))).strip()
    url = lambda u: re.sub(r"www\.", "", re.sub("^https?://", "", (u or "").lower().strip())).rstrip("/")
    if a[2] and b[2]:
        return "doi_exact" if a[2].lower().strip() == b[2].lower().strip() else ""
    if url(a[3]) and url(a[3]) == url(b[3]):
        return "url_exact"
    ta, tb = title(a[0]), title(b[0])
    if ta and tb:
        r = difflib.SequenceMatcher(None, ta, tb).ratio()
        if r >= threshold and not (a[1] and b[1] and a[1] != b[1]):
            return f"title_similarity:{r:.2f}"
    return ""


def sequential(rows):
    groups, where = [], {}
    for i, a in enumerate(rows):
        for c in groups:
            reason = matches(a, rows[c])
            if reason:
                where[i] = (c, reason)
                break
        else:
            groups.append(i)
            where[i] = (i, "canonical")
    return where


def test_known_duplicates(spark):
    rows = [
        ("A", 2020, "10.1/X", None),
        ("B", 2021, " 10.1/x", None),
        ("C", 2020, None, "https://example.com/paper-a"),
        ("D", 2020, None, "http://www.example.com/paper-a/"),
        ("Attention is All You Need", 2017, None, None),
        ("Attention Is All You Need: A Survey", 2017, None, None),
        ("Annual Report", 2022, None, None),
        ("Annual Report", 2023, None, None),
        ("Attention is all you need", 2017, "10.2/y", None),
        ("Attention is all you need", 2017, "10.3/z", None),
        ("", None, None, None),
        ("", None, None, None),
    ]
    got = {r.paper_id: (r.canonical_id, r.reason) for r in dedup.dedup_groups(papers(spark, rows)).collect()}
    assert got == sequential(rows)
    assert got[1] == (0, "doi_exact") and got[3] == (2, "url_exact") and got[5][0] == 4 and got[7][0] == 7 and got[9][0] == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    stems = ["deep learning for text", "graph mining at scale", "a study of cats and dogs", "tides"]
    rows = []
    for _ in range(60):
        t = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcdexyz ")
        rows.append(("".join(t), rng.choice([None, 2000, 2001]), rng.choice([None, None, "10.1/a", "10.1/b"]), rng.choice([None, None, "http://x.org/1", "https://www.x.org/2/"])))
    got = {r.paper_id: (r.canonical_id, r.reason) for r in dedup.dedup_groups(papers(spark, rows)).collect()}
    assert got == sequential(rows)


def test_common_subsequence_bounds_the_ratio():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert dedup.common_subsequence(a, b) == table[-1][-1]
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert dedup.title_ratio(a, b, 0.6) in (ratio, 0.0) and (ratio < 0.6 or dedup.title_ratio(a, b, 0.6) == ratio)


def test_snowball_visits_each_paper_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1), (1, 99)], "src long, dst long")
    known = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "node long")
    seeds = spark.createDataFrame([(1,), (1,)], "seed long")
    at = lambda d: {(r.node, r.depth) for r in graph.snowball(seeds, edges, known, d).collect()}
    assert at(0) == set() and at(1) == {(2, 1), (3, 1), (9, 1)} and at(5) == {(2, 1), (3, 1), (9, 1), (4, 2)}


# -- text, HTML, URLs, redaction


def test_match_offsets_equal_slicing(spark):
    rng = random.Random(4)
    texts = ["", "none", "[1][2] é [33] 10.1234/ab ÄÖ [4]\n", "".join(rng.choice("[]12é \n") for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for row in df.select("v", text.match_offsets(F.col("v"), r"\[\d{1,3}\]").alias("m")).collect():
        assert [(m.raw, m.start, m.end) for m in row.m] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\[\d{1,3}\]", row.v)]


def test_citations_of_authors(spark):
    docs = spark.createDataFrame([(1, "As Doe and Smith (2020) show [7].")], "paper_id long, text string")
    got = {r.kind: r for r in claims.extract_citations(docs).collect()}
    assert got["author_year"].year == 2020 and got["numbered"].raw == "[7]"
    assert got["author_year"].authors == ["As Doe", "Smith"]
    assert got["numbered"].context == "As Doe and Smith (2020) show [7]."


def test_sections_and_claims(spark):
    doc = "# T\n\nFirst one.\n\n## Methods used\nm1\nm2\n# Next\nWe find that it works well. Short suggests. No.\n"
    assert one(spark, doc, lambda c: text.section(c, ["method"])) == "m1\nm2"
    assert one(spark, doc, lambda c: text.section(c, ["nothing"])) == ""
    assert one(spark, doc, lambda c: text.paragraph(c, 1)) == "First one."
    assert one(spark, doc, text.claims)[-1].endswith("We find that it works well.")
    assert len(one(spark, "We find that a b c. " * 30, text.claims)) == 10


def test_markdown(spark):
    page = """<html><head><title>T</title><style>x</style></head><body><h1 id=a>Big <i>one</i></h1><nav>no</nav><H2>two</H2><p style="x">a <b>b</b><br>c</p>
    <a class=k href='u2'>two</a><a href="u1"></a><ol><li>x</li><li>y <em>z</em></li></ol><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><table></table></body></html>"""
    row = html.markdown_columns(spark.createDataFrame([(page,)], "html string"), "html").first()
    assert row.title == "T"
    assert [(h.level, h.text) for h in row.headings] == [(1, "Big one"), (2, "two")]
    assert [(x.href, x.text) for x in row.links] == [("u1", "u1"), ("u2", "two")]
    for part in ("# Big one\n\n## two", "a **b**\nc", "[two](u2)[u1](u1)", "1. x\n1. y *z*", "| a | b |\n| --- | --- |\n| 1 | 2 |"):
        assert part in row.markdown
    assert "no" not in row.markdown.split()


@pytest.mark.parametrize(
    ("url", "allowed"),
    [
        ("https://example.org/x", True),
        ("http://8.8.8.8/", True),
        ("http://[2606:4700::1111]/", True),
        ("http://[::1]/", False),
        ("http://[fe80::1]/", False),
        ("http://[2001:db8::1]/", False),
        ("http://2130706433/", False),
        ("http://0177.0.0.1/", False),
        ("http://0x7f000001/", False),
        ("http://127.1/", False),
        ("http://192.168.0.1/", False),
        ("http://%6c%6fcalhost/", False),
        ("http://%256c%256fcalhost/", False),
        ("http://printer.local/", False),
        ("http://ехample.org/", False),
        ("http://example.org:8080/", False),
        ("http://example.org:443/", True),
        ("http://example.org:bad/", False),
        ("ftp://example.org/", False),
        ("javascript:alert(1)", False),
        ("http://me:pw@example.org/", False),
        ("http:///x", False),
        ("", False),
        (None, False),
    ],
)
def test_url_policy(spark, url, allowed):
    assert one(spark, url, urls.url_policy).allowed is allowed


def test_ipv4_ranges_equal_ipaddress(spark):
    rng = random.Random(6)
    numbers = [rng.randrange(1 << 32) for _ in range(500)] + [int(ipaddress.ip_address(a)) for a in ("10.0.0.0", "9.255.255.255", "172.31.255.255", "172.32.0.0", "100.64.0.1", "223.255.255.255", "224.0.0.1")]
    df = spark.createDataFrame([(str(ipaddress.ip_address(n)),) for n in numbers], "v string")
    for r in df.select("v", urls.numeric_host_public(F.col("v")).alias("p")).collect():
        ip = ipaddress.ip_address(r.v)
        if not r.v.startswith("192.0.0."):
            assert r.p == (ip.is_global and not ip.is_multicast), r.v


def test_redaction(spark):
    assert one(spark, "api-key = 'abcdefgh12' and Bearer abcdefghi, token=short", redact.redact_secrets) == "api-key = [REDACTED] and Bearer [REDACTED], token=short"
    url = one(spark, "https://user:pass@API.example.com:80/p;x?api_key=abc&a=b c*~&empty#frag", redact.redact_url)
    assert url == "https://api.example.com:80/p;x?api_key=[REDACTED]&a=b+c%2A~&empty=#frag"
    assert one(spark, '{"a": [{"password": 1}, "secret=abcdefgh1"], "n": 2}', redact.redact_json) == '{"a": [{"password": "[REDACTED]"}, "secret=[REDACTED]"], "n": 2}'
    assert one(spark, None, redact.redact_json) is None


def test_decode_bytes(spark):
    assert one(spark, bytearray("é".encode()), files.decode_bytes, "binary") == "é"
    assert one(spark, bytearray(b"caf\xe9"), files.decode_bytes, "binary") == "café"


# -- screening, planning, scores


def test_screen(spark):
    df = spark.createDataFrame([(1, 0, "http://x.org/a.pdf", 2021, 4.0), (2, 1, None, 1990, 9.0), (3, 2, "u", None, None)], "paper_id long, pos long, pdf_url string, year int, relevance double")
    got = {r.paper_id: (r.total_score, r.included) for r in screen.screen(df).collect()}
    assert got == {1: (2.0, True), 2: (1.0, False), 3: (1.0, True)}


def test_blank_requests_have_no_plan(spark):
    df = spark.createDataFrame([(1, " ", ""), (2, "how to cite cats properly", "")], "campaign_id long, query string, context string")
    got = plan.plan_queries(df, ["crossref"]).orderBy("plan_pos").collect()
    assert [(r.campaign_id, r.source, r.priority) for r in got] == [(2, "serp", 0), (2, "crossref", 1), (2, "crossref", 2)]
    assert got[2].planned == "cite cats properly"


def test_quality_score_without_claims(spark):
    assert one(spark, 0, lambda c: evaluate.quality_score(c, c, c, c), "int") == 0.0


def test_semantic_scholar_nulls(spark):
    got = providers.normalize_semantic_scholar(spark.createDataFrame([("{}",), ("{broken",)], "payload string")).collect()
    assert [(r.title, r.authors, r.doi) for r in got] == [("", [], None)] * 2


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2301.1v2</id><title>A\n B</title><published>2023-01-02</published><author><name>X</name></author></entry></feed>")
    row = providers.normalize_arxiv(providers.read_atom(spark, str(tmp_path))).first()
    assert (row.source_id, row.title, row.year, row.authors) == ("2301.1", "A  B", 2023, ["X"])


# -- events


def events(seed, n=400):
    rng = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += rng.choice([0, 5, 400])
        out.append((i, rng.randrange(3), rng.choice(["stage_enter", "stage_exit"]), rng.choice([None, 0, 1, 2]), rng.choice([True, False, None]), None, at))
    return out


def event_frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, campaign_id long, type string, stage_pos int, ok boolean, error string, at long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("at") + 86_400)).drop("at")  # a stream drops what is as old as its first watermark, 1970


def test_stage_durations_equal_walks(spark):
    rows = events(1)
    e = event_frame(spark, rows)
    total, means, last = {}, {}, {}
    before, entered = {}, {}
    for _, c, kind, stage, _, _, at in rows:
        if stage is None:
            continue
        k = (c, stage)
        if k in before and before[k][0] == "stage_enter":
            total[k] = total.get(k, 0) + max(0, at - before[k][1])
        before[k] = (kind, at)
        total.setdefault(k, 0)
        if kind == "stage_enter":
            entered[k] = at
        elif k in entered:
            means.setdefault(k, []).append(at - entered[k])
        last.setdefault(k, {})[kind] = at
    as_dict = lambda df: {(r.campaign_id, r.stage_pos): r.seconds for r in df.collect()}
    assert as_dict(telemetry.stage_durations(e)) == total
    assert as_dict(telemetry.mean_stage_durations(e)) == pytest.approx({k: sum(v) / len(v) for k, v in means.items()})
    assert as_dict(telemetry.last_stage_durations(e)) == {k: v["stage_exit"] - v["stage_enter"] for k, v in last.items() if len(v) == 2 and v["stage_exit"] >= v["stage_enter"]}


def test_streams_equal_batches(spark):
    rows = events(2)
    e = event_frame(spark, rows).withColumn("meta", F.create_map(F.lit("stage"), F.lit("x")))
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for k in range(3):  # a stream reads files by age
        e.where(F.floor(F.col("event_id") / 150) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = lambda: spark.readStream.schema(streams.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    end = lambda writer, name: writer.option("checkpointLocation", f"{base}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, telemetry.stage_durations(e).collect()))
    for name, keep in (("durations", None), ("short", "1 second")):
        end(streams.stream_stage_durations(source(), f"{base}/{name}", keep, buckets=4), name)
        got = sorted(map(tuple, streams.stage_totals(spark, f"{base}/{name}").collect()))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        if keep is None:
            assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))
    left = lambda name: BucketStore(spark, f"{base}/{name}").snapshot().count()
    assert left("short") <= left("durations")
    stuck = streams.run_available(streams.stream_stuck(source()), f"{base}/stuck", "append", f"{base}/stuck-state")
    waits, newest = [], max(r[6] for r in rows if r[3] is not None)
    for c in range(3):
        stage = since = None
        for _, own, kind, pos, _, _, at in rows:
            if own != c or pos is None:
                continue
            if stage is not None and at - since > 300:
                waits.append((c, stage))
                stage = None
            if kind == "stage_enter":
                stage, since = pos, at
            elif pos == stage:
                stage = None
        if stage is not None and newest - 1 - since > 300:
            waits.append((c, stage))
    assert sorted((r.campaign_id, r.stage_pos) for r in stuck.collect()) == sorted(waits)


def test_bucket_store_rewrites_what_it_touches(spark):
    store = BucketStore(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", buckets=8)
    add = lambda old, new: (new if old is None else old.unionByName(new)).groupBy("k").agg(F.sum("n").alias("n"))
    frame = lambda rows: spark.createDataFrame(rows, "k long, n long")
    store.merge(0, frame([(k, 1) for k in range(100)]), F.col("k"), add)
    for _ in range(2):  # a batch tried again gives the same
        store.merge(1, frame([(3, 5), (3, 1), (200, 1)]), F.col("k"), add)
        assert {r.k: r.n for r in store.snapshot().collect()} == {k: 7 if k == 3 else 1 for k in [*range(100), 200]}
        assert sum(b == 1 for b in store.manifest(1).values()) <= 2
    assert store.merge(2, frame([]), F.col("k"), add) is None
    assert store.last() == 2 and store.snapshot().count() == 101 and store.snapshot(0).count() == 100


def test_keyword_search_without_tokens_returns_all(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, name string")
    assert catalog.keyword_search(df, ["name"], "?!").count() == 2
    assert catalog.keyword_search(df, ["name"], "B").count() == 1


@pytest.mark.parametrize("held", [1, 50])
def test_exact_median(spark, held):
    rng = random.Random(held)
    for values in ([5.0], [1.0, 2.0], [7.0] * 9, [rng.expovariate(1) ** 9 for _ in range(301)], [float(rng.randrange(20)) for _ in range(200)], []):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        got = telemetry.exact_median(df, F.col("x"), held, bins=8)
        ordered, n = sorted(values), len(values)
        assert got == (None if not n else (ordered[(n - 1) // 2] + ordered[n // 2]) / 2)


def test_robots_of_many_rules(spark):
    """A host of many rules: the first that meets decides, as in a plain loop."""
    from litspark.operators.robots import robots_filter

    rng = random.Random(4)
    letters = lambda: "/" + "".join(rng.choice("ab") for _ in range(rng.randrange(7)))
    rules = [("https", "x.org", k, rng.random() < 0.5, letters()) for k in rng.sample(range(1000), 60)] + [("https", "y.org", 1, False, ""), ("https", "z.org", 1, False, None)]
    urls = [(k, f"https://x.org{letters()}") for k in range(200)] + [(900, "https://y.org/a"), (901, "https://z.org/a"), (902, "no url"), (903, "https://x.org")]
    got = {r.k for r in robots_filter(spark.createDataFrame(urls, "k long, url string"), spark.createDataFrame(rules, "scheme string, host string, rule_no int, allow boolean, path_prefix string")).collect()}
    want = {901}
    for k, url in urls[:200] + urls[-1:]:
        path = url[len("https://x.org") :] or "/"
        met = sorted(r[2:4] for r in rules[:60] if path.startswith(r[4]))
        if not met or met[0][1]:
            want.add(k)
    assert got == want


def test_empty_metrics(spark):
    df = spark.createDataFrame([], "status string, created_at timestamp, updated_at timestamp")
    row = telemetry.campaign_metrics(df).first()
    assert row.total == 0 and row.average_seconds is None and row.median_seconds is None


RESULT = "source string, query string, row_pos long, error string, paper struct<paper_id:long,title:string,year:int,doi:string,url:string,pdf_url:string,abstract:string,source:string,source_id:string,relevance:int>"


def campaign_inputs(spark, asked, results, content=(), edges=()):
    """Requests (campaign, query), results (query, row_pos, error, paper) of arxiv, texts by URL and citations."""
    requests = spark.createDataFrame([(c, q, "", 3) for c, q in asked], "campaign_id long, query string, context string, max_sources int")
    found = spark.createDataFrame([("arxiv", *r) for r in results], RESULT)
    known = found.where("paper is not null").select("paper").distinct()
    return requests, found.limit(0), found, known, spark.createDataFrame(list(content), "url string, content string"), spark.createDataFrame(list(edges), "src long, dst long")


def paper(i, doi=None, pdf=True, url=None, relevance=5):
    return (i, f"Title {i}", 2020, doi, url, f"https://x.org/{i}.pdf" if pdf else None, "We find that it is so here.", "crossref", str(i), relevance)


def test_campaigns_keep_papers_of_other_campaigns(spark):
    """One paper in two campaigns is one source in each; repeated inside a campaign it is one, too."""
    from litspark.operators.dedup import dedup_groups
    from litspark.plans.campaign import run_campaigns

    ids = spark.createDataFrame([(1, 1, 1, "10.1/X"), (2, 2, 1, "10.1/x"), (1, 1, 2, "10.1/x"), (4, 4, None, "10.1/x"), (5, 5, None, "10.1/x")], "paper_id long, pos long, campaign_id long, doi string")
    papers = ids.withColumns({"year": F.lit(2020), "title": F.lit("t"), "url": F.lit(None).cast("string")})
    for threshold in (None, 0.85):
        got = {(r.campaign_id, r.paper_id): r.canonical_id for r in dedup_groups(papers, threshold, within="campaign_id").collect()}
        assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (None, 4): 4, (None, 5): 4}
    shared = paper(7, "10.1/x")
    results = [("alpha beta", 0, None, shared), ("gamma beta", 0, None, shared), ("gamma beta", 1, None, paper(8, "10.1/X"))]
    run = run_campaigns(*campaign_inputs(spark, [(1, "alpha beta"), (2, "gamma beta")], results, [("https://x.org/7.pdf", "# Results\n\nWe found that it is so.")]))
    got = {r.campaign_id: (r.raw, r.canonical, r.total_sources, r.total_claims, r.verified_count) for r in run.report.collect()}
    assert got == {1: (2, 1, 1, 1, 1), 2: (4, 1, 1, 1, 1)}  # each planned query twice: as asked, and by its keywords
    briefs = {r.campaign_id: r.brief for r in run.briefs.collect()}
    assert briefs[2].startswith("# Research Brief: gamma beta") and briefs[2].count("https://x.org/7.pdf") == 1


def test_campaign_stages(spark):
    """Cache before search, failed queries, citations, the budget, closed places and a campaign without papers."""
    from litspark.plans.campaign import run_campaigns

    results = [("alpha", k, None, paper(k, pdf=k != 3, relevance=k)) for k in range(5)] + [("omega", 0, "no answer", None), ("beta", 0, None, paper(20, pdf=False, url="http://10.0.0.1/x"))]
    requests, _, found, known, content, edges = campaign_inputs(spark, [(1, "alpha"), (2, "omega"), (3, "beta"), (4, " ")], results, [("https://x.org/4.pdf", "# A\n\n## Materials\nm\n## Evaluation\nWe found that all of it holds.")], [(0, 20), (1, 0)])
    cache = spark.createDataFrame([("arxiv", "alpha", 9, None, paper(9)), ("arxiv", "alpha", 10, None, paper(4, relevance=4))], RESULT)
    run = run_campaigns(requests, cache, found, known, content, edges, facts=spark.createDataFrame([(1, "all of it"), (2, "none")], "fact_id long, text string"))
    got = {r.campaign_id: r for r in run.report.collect()}
    assert sorted(got) == [1, 2, 3]  # a blank request is left out
    assert (got[1].raw, got[1].canonical, got[1].snowball, got[1].resolved) == (4, 4, 0, 3)  # the cached two, once for each of two plans
    assert got[2].errors == ["arxiv"] and (got[2].raw, got[2].total_sources, got[2].coverage_score) == (0, 0, 0.0)
    assert (got[3].raw, got[3].total_sources, got[3].snowball) == (2, 0, 1)
    read = {r.paper_id: r for r in run.sources.where("campaign_id = 1").collect()}
    assert read[4].tool == "markdownify" and read[4].data_summary == "m" and read[4].results_summary == "We found that all of it holds." and read[4].conflict_count == 1
    assert read[9].tool == "abstract" and read[9].summary == "We find that it is so here."


def test_groups_of_one_large_key(spark):
    """Papers of one DOI are judged by their distinct keys, not in pairs."""
    many = spark.range(20_000).selectExpr("id as paper_id", "id as pos", "2020 as year", "'10.1/x' as doi", "concat('http://x.org/', id % 50) as url", "'t' as title")
    assert [tuple(r) for r in dedup.dedup_groups(many, None).groupBy("canonical_id").count().collect()] == [(0, 20_000)]


@pytest.mark.parametrize("seed", [4, 5])
def test_exact_groups_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [("", None, rng.choice([None, None, *(f"10.1/{k}" for k in range(9))]), rng.choice([None, *(f"http://x.org/{k}" for k in range(12))])) for _ in range(200)]
    got = {r.paper_id: (r.canonical_id, r.reason) for r in dedup.dedup_groups(papers(spark, rows), None).collect()}
    assert got == sequential(rows)


def test_conflicts_equal_brute_force(spark):
    """Facts inside words of a claim, short facts, shared words at and over the bound, blank and repeated facts."""
    from litspark.operators.claims import conflicts

    claims = ["We find accuracy (95%).", "a third-party tool", "one two three four five", "one two three four six", "x", None, "", "ÄB the A"]
    facts = ["95%", "party", "one two three four seven", "five four three two one", "ONE TWO THREE FOUR SIX", "x", " ", None, "äb", "e", "party", "no such"]
    c = spark.createDataFrame([(s, i, t) for s in (1, 2) for i, t in enumerate(claims)], "source_id long, claim_index int, claim string")
    f = spark.createDataFrame(list(enumerate(facts)), "fact_id long, text string")

    def match(claim, fact):
        if not (fact or "").strip() or claim is None:
            return False
        low, words = fact.lower(), set(fact.lower().split())
        return low in claim.lower() or len(words & set(claim.lower().split())) / len(words) > 0.8

    want = {(s, n, next(t for t in claims if match(t, fact))) for s in (1, 2) for n, fact in enumerate(facts) if any(match(t, fact) for t in claims)}
    assert {tuple(r) for r in conflicts(c, f).select("source_id", "fact_id", "claim").collect()} == want
    assert {"95%", "party"} <= {facts[n] for _, n, _ in want}
    assert conflicts(c, f.limit(0)).count() == 0 and conflicts(c.limit(0), f).count() == 0


def test_rubric_rows_of_equal_bounds(spark):
    from litspark.operators.screen import screen_by_rows

    papers = spark.createDataFrame([(1, {"s": "4"}), (2, {"s": "2"}), (3, {})], "paper_id long, fields map<string,string>")
    criteria = spark.createDataFrame([("a", "rubric", "s", None, 3.0, 3.0, False, 1.0)], "criteria_set string, kind string, field string, expected boolean, low double, high double, must boolean, weight double")
    assert {r.paper_id: r.total_score for r in screen_by_rows(papers, criteria).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


def test_dashboard_breakdowns(spark):
    rows = [(i, f"q{i}", "running" if i else "completed", i % 2, f"2024-01-0{i + 1}", f"2024-01-0{i + 1}") for i in range(3)]
    c = spark.createDataFrame(rows, "campaign_id long, query string, status string, stage_pos int, a string, b string")
    c = c.withColumns({"created_at": F.to_timestamp("a"), "updated_at": F.to_timestamp("b")})
    report = telemetry.render_dashboard(telemetry.campaign_metrics(c), "now", telemetry.stage_counts(c), telemetry.newest_queries(c)).first().report
    tail = "### Status Breakdown\n\n- completed: 1\n- running: 2\n\n### Current Stage Breakdown\n\n- init: 2\n- plan: 1\n\n### Recent Queries\n\n- q2\n- q1\n- q0"
    assert report.endswith("\n\n" + tail)


def test_telemetry_json(spark):
    of = lambda v: one(spark, v, telemetry.telemetry_sanitize_json)
    assert of('{"stage": "x", "duration_ms": 1.5, "model": true, "provider": [1], "status": {"a": 1}, "user": "u"}') == {"stage": "x", "duration_ms": "1.5", "model": "true"}
    assert of("{}") == of("not json") == of(None) == {}


def test_stored_campaigns_work_out_what_is_new(spark):
    """A rerun reads all stages again; a changed result, text or fact renews just the campaigns and stages it reaches."""
    from litspark.plans.campaign import run_campaigns
    from litspark.plans.store import StageStore, run_stored

    store = StageStore(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    results = [("alpha", 0, None, paper(1)), ("alpha", 1, None, paper(2)), ("omega", 0, None, paper(5))]
    texts = [(f"https://x.org/{i}.pdf", f"# Results\n\nWe found that number {i} is so.") for i in (1, 2, 5)]
    asked = [(1, "alpha"), (2, "omega")]

    def both(results, texts, facts=None, compared=False):
        requests, cache, found, known, content, edges = campaign_inputs(spark, asked, results, texts, [(1, 5)])
        known = known.where("paper.paper_id < 9")
        facts = facts and spark.createDataFrame(facts, "fact_id long, text string")
        got, state = run_stored(store, requests, cache, found, known, content, edges, facts=facts)
        if compared:
            want = run_campaigns(requests, cache, found, known, content, edges, facts=facts)
            for mine, plain in ((got.report, want.report), (got.briefs, want.briefs)):
                assert sorted(map(str, mine.select(*sorted(mine.columns)).collect())) == sorted(map(str, plain.select(*sorted(plain.columns)).collect()))
        return {r.campaign_id for r in state.where("fresh").collect()}

    assert both(results, texts) == {1, 2}
    assert both(results, texts) == set()
    assert both(results + [("omega", 1, None, paper(9))], texts, compared=True) == {2}
    assert both(results, [*texts[1:], (texts[0][0], "# Results\n\nWe found that it is otherwise now.")]) == {1, 2}  # a neighbour of 5, too
    assert both(results, texts) == set()
    assert both(results, texts, [(1, "number 5")]) == {1, 2}


def test_snowball_of_many_seeds(spark):
    """More seeds than share one number, against a walk from each."""
    rng = random.Random(8)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(160)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    known = [k for k in range(150) if k % 10]
    want = set()
    for seed in range(150):
        seen, front = {seed}, {seed}
        for level in (1, 2, 3):
            front = {m for n in front for m in near.get(n, ()) if m % 10} - seen
            seen |= front
            want |= {(seed, n, level) for n in front}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.snowball(frame([(k,) for k in range(150)], "seed long"), frame(links, "src long, dst long"), frame([(k,) for k in known], "node long"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stored_token_index(spark):
    """Searches read their words' buckets only, and follow updates, removals and merges."""
    from litspark.operators.token_index import TokenIndex

    index = TokenIndex(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", buckets=32)
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    ids = lambda query: sorted(r.id for r in index.search(query).collect())
    index.add(frame([(1, "red fox"), (2, "Red hen"), (3, "blue hen"), (3, "blue hen")]), "id", ["name"])
    assert ids("RED") == [1, 2] and ids("hen fox") == [1, 2, 3]
    index.add(frame([(2, "green hen"), (4, "red")]), "id", ["name"])
    assert ids("red") == [1, 4] and ids("green") == [2]
    index.remove(frame([(1, "")]).select("id"))
    assert ids("red") == [4] and ids("fox") == []
    index.merge()
    assert ids("red") == [4] and ids("hen") == [2, 3]
    index.add(frame([(1, "red again")]), "id", ["name"])
    assert ids("red") == [1, 4]
    plan = index.search("red")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", plan), plan


def test_brief_documents_equal_strings(spark):
    report = spark.createDataFrame([(1, "q", 2, 12, 0, 1, 1, 11, 1, 0.75, 0.5), (2, "", 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0)], "campaign_id long, query string, total_sources long, total_claims long, citation_count long, challenged_count long, high_severity_count long, verified_count long, failed_verification_count long, coverage_score double, quality_score double")
    c = spark.createDataFrame([(1, k % 2, k, f"claim {k}", None, "low", "T", None) for k in range(12)], "campaign_id long, source_id long, claim_index int, claim string, evidence string, confidence string, title string, full_text_url string")
    challenges = c.select("campaign_id", "source_id", "claim_index", F.col("claim").alias("claim_text"), F.lit("high").alias("severity"), F.lit("coverage").alias("kind"), F.lit("r").alias("reason"), F.lit("e").alias("requested_evidence"))
    checks = challenges.select("campaign_id", "source_id", "claim_index", "claim_text", (F.col("claim_index") > 3).alias("ok"), "reason")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    files.write_documents(evaluate.brief_lines(report, c, challenges, checks), "campaign_id", list(evaluate.LINE_ORDER), path)
    got = {r.campaign_id: r.value for r in files.read_documents(spark, path).collect()}
    assert got == {r.campaign_id: r.brief + "\n" for r in evaluate.render_brief(report, c, challenges, checks).collect()}
    assert got[1].index("12. **claim 11") > got[1].index("2. **claim 2")
