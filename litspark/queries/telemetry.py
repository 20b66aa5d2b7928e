"""Queries of campaign events and dashboards (FIL-01, 02, 09; WIN-01..09; AGG-02, 09..11, 16)."""

from pyspark.sql import functions as F

from ..operators import telemetry as T
from ..operators.resolve import discovery_counters
from ..registry import query
from ..testviews import view

_S = "(epoch_us({b}) - epoch_us({a})) / 1e6"
_GAPS = f"g AS (SELECT campaign_id, stage_pos, lag(type) OVER w AS before, greatest(0.0, {_S.format(a='lag(ts) OVER w', b='ts')}) AS gap FROM v_events WINDOW w AS (PARTITION BY campaign_id, stage_pos ORDER BY event_id))"
_DUR = f"{_GAPS}, dur AS (SELECT campaign_id, stage_pos, coalesce(sum(gap) FILTER (before = 'stage_enter'), 0.0) AS seconds FROM g GROUP BY 1, 2)"
_EXITS = f"e AS (SELECT campaign_id, stage_pos, type, ts, last_value(CASE WHEN type = 'stage_enter' THEN ts END IGNORE NULLS) OVER (PARTITION BY campaign_id, stage_pos ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS entered FROM v_events), x AS (SELECT campaign_id, stage_pos, {_S.format(a='entered', b='ts')} AS seconds FROM e WHERE type = 'stage_exit' AND entered IS NOT NULL AND ts >= entered)"
_LAST = f"z AS (SELECT campaign_id, stage_pos, arg_max(ts, event_id) FILTER (type = 'stage_enter') AS a, arg_max(ts, event_id) FILTER (type = 'stage_exit') AS b FROM v_events GROUP BY 1, 2), last AS (SELECT campaign_id, stage_pos, {_S.format(a='a', b='b')} AS seconds FROM z WHERE b >= a)"
_ETA = f"{_LAST}, eta AS (SELECT c.campaign_id, count(s) AS n, count(l.seconds) AS known, floor(coalesce(sum(CASE WHEN s IS NOT NULL THEN coalesce(l.seconds, 60.0) END), 0.0))::BIGINT AS seconds FROM v_campaigns c LEFT JOIN range(9) r(s) ON s > c.stage_pos LEFT JOIN last l ON l.campaign_id = c.campaign_id AND l.stage_pos = s GROUP BY 1)"
_AS_OF = "TIMESTAMP '2030-01-01 00:00:00'"
_STUCK = f"k AS (SELECT campaign_id, arg_max(stage_pos, event_id) FILTER (type = 'stage_enter') AS stage_pos, arg_max(stage_pos, event_id) FILTER (type = 'stage_exit') AS left_pos, arg_max(ts, event_id) FILTER (type = 'stage_enter') AS since FROM v_events GROUP BY 1), stuck AS (SELECT campaign_id, stage_pos, {_S.format(a='since', b=_AS_OF)} AS elapsed_seconds FROM k WHERE since IS NOT NULL AND stage_pos IS DISTINCT FROM left_pos)"
_NAMES = "['init', 'plan', 'discover', 'screen', 'extract', 'adversarial', 'evaluate', 'deliver', 'finalize']"


def _as_of():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


def _events(spark, d):
    return view(spark, d, "v_events").withColumn("error", F.lit(None).cast("string"))


@query("fil_01_events_for", "SELECT event_id, stage_pos FROM v_events WHERE campaign_id = 1 AND type = 'stage_enter'")
def _(spark, d):
    return T.events_for(_events(spark, d), 1, "stage_enter").select("event_id", "stage_pos")


@query("fil_02_list_campaigns", "SELECT campaign_id, created_at FROM v_campaigns WHERE status = 'running'")
def _(spark, d):
    return T.list_campaigns(view(spark, d, "v_campaigns"), "running").select("campaign_id", "created_at")


@query("fil_09_telemetry_sanitize", "SELECT event_id, type AS stage, 'x' AS model, 2 AS n_keys FROM v_events")
def _(spark, d):
    m = F.create_map(F.lit("stage"), F.col("type"), F.lit("model"), F.lit("x"), F.lit("user"), F.col("campaign_id").cast("string"))
    return _events(spark, d).withColumn("m", T.telemetry_sanitize(m)).select("event_id", F.col("m")["stage"].alias("stage"), F.col("m")["model"].alias("model"), F.size("m").alias("n_keys"))


@query("fil_01b_parse_payload", "SELECT event_id, 's' || stage_pos AS stage, ok FROM v_events")
def _(spark, d):
    payload = F.concat(F.lit('{"stage": "s'), F.col("stage_pos").cast("string"), F.lit('", "result": {"ok": '), F.col("ok").cast("string"), F.lit("}}"))
    return _events(spark, d).withColumn("p", T.parse_payload(payload)).select("event_id", F.col("p.stage").alias("stage"), F.col("p.result.ok").alias("ok"))


@query("win_01_stage_durations", f"WITH {_DUR} SELECT campaign_id, stage_pos, round(seconds, 3) AS seconds FROM dur")
def _(spark, d):
    return T.stage_durations(_events(spark, d)).withColumn("seconds", F.round("seconds", 3))


@query("win_02_mean_stage_durations", f"WITH {_EXITS} SELECT campaign_id, stage_pos, round(avg(seconds), 3) AS seconds FROM x GROUP BY 1, 2")
def _(spark, d):
    return T.mean_stage_durations(_events(spark, d)).withColumn("seconds", F.round("seconds", 3))


@query("win_03_last_stage_durations", f"WITH {_LAST} SELECT campaign_id, stage_pos, seconds FROM last")
def _(spark, d):
    return T.last_stage_durations(_events(spark, d))


@query("win_04_eta", f"WITH {_ETA} SELECT campaign_id, seconds, CASE WHEN n = 0 THEN 'No remaining stages' WHEN known > 0 THEN 'Estimated ' || n || ' remaining stages using history for ' || known || ' stage(s)' ELSE 'Estimated ' || n || ' remaining stages using conservative heuristics' END AS note FROM eta")
def _(spark, d):
    return T.eta(view(spark, d, "v_campaigns"), T.last_stage_durations(_events(spark, d)))


@query("win_05_progress", f"SELECT campaign_id, floor((stage_pos + 1.0) / 9 * 100)::INT AS percent, array_to_string({_NAMES}[stage_pos + 2:], ',') AS remaining FROM v_campaigns")
def _(spark, d):
    return T.progress(view(spark, d, "v_campaigns")).withColumn("remaining", F.array_join("remaining", ","))


@query("win_06_stuck_alerts", f"WITH {_STUCK} SELECT campaign_id, 'stuck' AS kind, stage_pos, elapsed_seconds FROM stuck WHERE elapsed_seconds > 300")
def _(spark, d):
    return T.stuck_alerts(_events(spark, d), _as_of())


@query("win_07_failure_alerts", "SELECT campaign_id, event_id, 'stage_failure' AS kind, stage_pos, 'unknown' AS reason FROM v_events WHERE type = 'stage_exit' AND NOT ok")
def _(spark, d):
    return T.failure_alerts(_events(spark, d))


@query("win_08_thrash_alerts", "SELECT campaign_id, 'thrashing' AS kind, stage_pos, count(*) AS enter_count FROM v_events WHERE type = 'stage_enter' GROUP BY campaign_id, stage_pos HAVING count(*) > 3")
def _(spark, d):
    return T.thrash_alerts(_events(spark, d))


@query(
    "win_09_status_snapshot",
    f"""WITH {_ETA}, {_STUCK} SELECT c.campaign_id, c.stage_pos, c.status, floor((c.stage_pos + 1.0) / 9 * 100)::INT AS percent, eta.seconds AS eta_seconds, (SELECT count(*) FROM stuck s WHERE s.campaign_id = c.campaign_id AND elapsed_seconds > 300) AS stuck,
        (SELECT count(*) FROM v_events e WHERE e.campaign_id = c.campaign_id AND type = 'stage_exit' AND NOT ok) AS failures FROM v_campaigns c JOIN eta ON eta.campaign_id = c.campaign_id""",
)
def _(spark, d):
    return T.status_snapshot(view(spark, d, "v_campaigns"), _events(spark, d), _as_of()).select("campaign_id", "stage_pos", "status", "percent", "eta_seconds", "stuck", "failures")


@query("agg_16_calibrate_weights", f"WITH {_EXITS}, m AS (SELECT stage_pos, avg(seconds) AS mean FROM x GROUP BY 1), w AS (SELECT s::INT AS stage_pos, CASE WHEN mean IS NULL THEN 1.0 ELSE greatest(0.1, mean / (SELECT avg(mean) FROM m)) END AS w FROM range(9) r(s) LEFT JOIN m ON m.stage_pos = s) SELECT stage_pos, round(w / (SELECT sum(w) FROM w), 4) AS weight FROM w")
def _(spark, d):
    return T.calibrate_weights(_events(spark, d))


@query("agg_09_campaign_metrics", f"WITH s AS (SELECT status, greatest(0.0, {_S.format(a='created_at', b='updated_at')}) AS seconds FROM v_campaigns) SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, 0::BIGINT AS failed, 0::BIGINT AS killed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'paused') AS paused, round(avg(seconds), 3) AS average_seconds, median(seconds) AS median_seconds FROM s")
def _(spark, d):
    return T.campaign_metrics(view(spark, d, "v_campaigns")).withColumn("average_seconds", F.round("average_seconds", 3))


@query("agg_09b_stage_counts", "SELECT stage_pos, count(*) AS campaigns FROM v_campaigns GROUP BY 1")
def _(spark, d):
    return T.stage_counts(view(spark, d, "v_campaigns"))


@query("agg_09c_newest_queries", "SELECT campaign_id, query FROM v_campaigns ORDER BY created_at DESC, campaign_id LIMIT 5")
def _(spark, d):
    return T.newest_queries(view(spark, d, "v_campaigns")).drop("created_at")


@query("agg_10_campaign_summaries", f"WITH {_DUR}, m AS (SELECT campaign_id, round(sum(seconds), 3) AS in_stages, count(*) AS n_stages FROM dur GROUP BY 1) SELECT c.campaign_id, greatest(0.0, {_S.format(a='created_at', b='updated_at')}) AS duration_seconds, coalesce(in_stages, 0.0) AS in_stages, coalesce(n_stages, 0) AS n_stages FROM v_campaigns c LEFT JOIN m ON m.campaign_id = c.campaign_id")
def _(spark, d):
    s = T.campaign_summaries(view(spark, d, "v_campaigns"), _events(spark, d))
    total = F.round(F.aggregate(F.map_values("stage_seconds"), F.lit(0.0), lambda a, x: a + x), 3)
    return s.select("campaign_id", "duration_seconds", F.coalesce(total, F.lit(0.0)).alias("in_stages"), F.coalesce(F.size("stage_seconds"), F.lit(0)).cast("long").alias("n_stages"))


_STATUS = ("completed", "failed", "killed", "running", "paused")


@query(
    "agg_11_render_dashboard",
    f"""WITH c AS (SELECT *, ['init', 'plan', 'discover', 'screen', 'extract', 'adversarial', 'evaluate', 'deliver', 'finalize'][stage_pos + 1] AS stage, greatest(0.0, {_S.format(a='created_at', b='updated_at')})::DOUBLE AS seconds FROM v_campaigns),
        n AS (SELECT count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _STATUS)}, avg(seconds) AS mean, median(seconds) AS mid FROM c),
        by_stage AS (SELECT string_agg('- ' || stage || ': ' || k, chr(10) ORDER BY stage) AS lines FROM (SELECT stage, count(*) AS k FROM c GROUP BY 1)),
        newest AS (SELECT string_agg('- ' || query, chr(10) ORDER BY created_at DESC, campaign_id) AS lines FROM (SELECT * FROM c ORDER BY created_at DESC, campaign_id LIMIT 5))
        SELECT concat_ws(chr(10), '# Campaign Report' || chr(10) || chr(10) || '_Generated at 2030-01-01T00:00:00+00:00_' || chr(10) || chr(10) || '## Aggregate Metrics' || chr(10), '- **Total campaigns**: ' || total, {', '.join(f"'- **{s.capitalize()}**: ' || {s}" for s in _STATUS)},
          '- **Average duration**: ' || format('{{:.1f}}', mean) || 's', '- **Median duration**: ' || format('{{:.1f}}', mid) || 's',
          chr(10) || '### Status Breakdown' || chr(10) || chr(10) || concat_ws(chr(10), {', '.join(f"CASE WHEN {s} > 0 THEN '- {s}: ' || {s} END" for s in sorted(_STATUS))}),
          chr(10) || '### Current Stage Breakdown' || chr(10) || chr(10) || by_stage.lines, chr(10) || '### Recent Queries' || chr(10) || chr(10) || newest.lines) AS report FROM n, by_stage, newest""",
)
def _(spark, d):
    c = view(spark, d, "v_campaigns")
    return T.render_dashboard(T.campaign_metrics(c), "2030-01-01T00:00:00+00:00", T.stage_counts(c), T.newest_queries(c))


@query(
    "agg_11b_campaign_sections",
    f"""WITH {_DUR}, n AS (SELECT campaign_id, ['init', 'plan', 'discover', 'screen', 'extract', 'adversarial', 'evaluate', 'deliver', 'finalize'][stage_pos + 1] AS stage, seconds FROM dur),
        m AS (SELECT campaign_id, string_agg('  - ' || stage || ': ' || format('{{:.1f}}', seconds) || 's', chr(10) ORDER BY stage) AS stages FROM n GROUP BY 1)
        SELECT c.campaign_id, concat_ws(chr(10), '### ' || replace(query, ' ', '_') || ' (' || c.campaign_id || ')' || chr(10), '- **Query**: ' || query, '- **Status**: ' || status,
          '- **Stage**: ' || ['init', 'plan', 'discover', 'screen', 'extract', 'adversarial', 'evaluate', 'deliver', 'finalize'][stage_pos + 1],
          '- **Created**: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '- **Updated**: ' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S'),
          '- **Duration**: ' || format('{{:.1f}}', greatest(0.0, {_S.format(a='created_at', b='updated_at')})::DOUBLE) || 's', '- **Stage durations**:' || chr(10) || stages) || chr(10) AS section
        FROM v_campaigns c LEFT JOIN m ON m.campaign_id = c.campaign_id""",
)
def _(spark, d):
    return T.campaign_sections(T.campaign_summaries(view(spark, d, "v_campaigns"), _events(spark, d)))


@query("fil_09b_telemetry_sanitize_json", "SELECT event_id, type AS stage, event_id::VARCHAR AS duration_ms, 2 AS n_keys FROM v_events")
def _(spark, d):
    e = _events(spark, d)
    meta = F.concat(F.lit('{"user": 1, "provider": {"k": 1}, "model": [1], "status": null, "stage": "'), e.type, F.lit('", "duration_ms": '), e.event_id.cast("string"), F.lit("}"))
    m = F.col("m")
    return e.withColumn("m", T.telemetry_sanitize_json(meta)).select("event_id", m["stage"].alias("stage"), m["duration_ms"].alias("duration_ms"), F.size(m).alias("n_keys"))


@query(
    "agg_02_discovery_counters",
    """WITH e AS (SELECT src % 10 AS campaign_id, count(*) AS snowball FROM v_edges GROUP BY 1),
       p AS (SELECT campaign_id, count(*) AS raw, count(DISTINCT doi) AS canonical, count(*) FILTER (pdf_url IS NOT NULL) AS resolved, array_to_string(list_sort(list(DISTINCT source) FILTER (source <> 'arxiv')), ',') AS errors FROM v_papers GROUP BY 1)
       SELECT campaign_id, coalesce(raw, 0) AS raw, coalesce(canonical, 0) AS canonical, coalesce(snowball, 0) AS snowball, coalesce(resolved, 0) AS resolved, coalesce(errors, '') AS errors FROM p FULL JOIN e USING (campaign_id)""",
)
def _(spark, d):
    p = view(spark, d, "v_papers")
    canonical = p.where("doi is not null").select("campaign_id", "doi").distinct()
    found = view(spark, d, "v_edges").select((F.col("src") % 10).alias("campaign_id"))
    failed = p.select("campaign_id", "source", F.when(p.source != "arxiv", "timeout").alias("error"))
    return discovery_counters(p, canonical, found, p.where("pdf_url is not null"), failed).withColumn("errors", F.array_join("errors", ","))
