"""Queries that run streams over the driver's tables to their end (STM-01..05)."""

from pyspark.sql import functions as F

from ..operators.catalog import redact_catalog
from ..registry import query
from ..streaming import streams as S
from ..streaming.buckets import BucketStore
from ..testviews import view
from .sources import _shared
from .telemetry import _DUR


def _lay_down(df, path, order, parts=2):
    """Files of ranges of ``order`` one after the other, as a log would grow: a stream reads them by age.

    Rows are worked out by all tasks, and one writes them: ``coalesce(1)`` would have it read, join and sort them, too.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    for k in range(parts):
        lower, upper = (low + (high + 1 - low) * x // parts for x in (k, k + 1))
        df.where((F.col(order) >= lower) & (F.col(order) < upper)).repartition(1).write.mode("append").parquet(path)
    return path


def _stream(spark, d, parts=2):
    e = view(spark, d, "v_events").withColumns({"error": F.lit(None).cast("string"), "meta": F.create_map(F.lit("stage"), F.col("type"), F.lit("user"), F.lit("x"), F.lit("model"), F.lit("token=abcdefgh"))})
    path = _lay_down(e, _shared(spark, "stream-in"), "event_id", parts)
    return spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, stream, mode):
    return S.run_available(stream, _shared(spark, "stream-out"), mode, _shared(spark, "stream-state"))


def _to_end(spark, writer):
    writer.option("checkpointLocation", _shared(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()


@query("stm_01_stream_events", "SELECT event_id, type AS stage, 'token=[REDACTED]' AS model, 2 AS n_keys FROM v_events")
def _(spark, d):
    done = _run(spark, S.sanitized(_stream(spark, d)), "append")
    return done.select("event_id", F.col("meta")["stage"].alias("stage"), F.col("meta")["model"].alias("model"), F.size("meta").alias("n_keys"))


@query("stm_02_stream_stage_durations", f"WITH {_DUR} SELECT campaign_id, stage_pos, round(seconds, 3) AS seconds FROM dur")
def _(spark, d):
    out = _shared(spark, "durations")
    _to_end(spark, S.stream_stage_durations(_stream(spark, d), out))
    return S.stage_totals(spark, out).withColumn("seconds", F.round("seconds", 3))


@query("stm_03_stream_alerts", "SELECT campaign_id, stage_pos, 'thrashing' AS kind, 1::BIGINT AS n FROM v_events WHERE type = 'stage_enter' GROUP BY 1, 2 HAVING count(*) > 3 UNION ALL SELECT campaign_id, stage_pos, 'stage_failure', count(*) FROM v_events WHERE type = 'stage_exit' AND NOT ok GROUP BY 1, 2")
def _(spark, d):
    events = _stream(spark, d)
    thrash = _run(spark, S.stream_thrashing(events), "append").select("campaign_id", "stage_pos", "kind")
    failed = _run(spark, S.stream_failures(events), "append").select("campaign_id", "stage_pos", "kind")
    return thrash.unionByName(failed).groupBy("campaign_id", "stage_pos", "kind").agg(F.count("*").alias("n"))


@query(
    "stm_03b_stream_stuck",
    """WITH e AS (SELECT * FROM v_events WHERE stage_pos IS NOT NULL), a AS (SELECT *, (SELECT min(b.event_id) FROM e b WHERE b.campaign_id = e.campaign_id AND b.event_id > e.event_id AND (b.type = 'stage_enter' OR b.stage_pos = e.stage_pos)) AS next_id FROM e WHERE type = 'stage_enter')
       SELECT a.campaign_id, a.stage_pos, 'stuck' AS kind FROM a LEFT JOIN e n ON n.event_id = next_id WHERE coalesce(epoch_ms(n.ts), (SELECT max(epoch_ms(ts)) - 1000 FROM e)) - epoch_ms(a.ts) > 300000""",
)
def _(spark, d):
    return _run(spark, S.stream_stuck(_stream(spark, d, 4)), "append")


@query("stm_04_stream_action_stats", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, outcome, agent_name, count(*) AS n FROM v_log GROUP BY 1, 2, 3")
def _(spark, d):
    log = view(spark, d, "v_log")
    path = _lay_down(log, _shared(spark, "stream-in"), "history_id")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    done = _run(spark, S.action_stats(stream, late="60 days"), "update")
    return done.groupBy("start", "outcome", "agent_name").agg(F.max("n").alias("n"))


@query(
    "stm_05_stream_catalog_upsert",
    "SELECT lower(regexp_replace(regexp_extract(canonical_url, '^[a-z]+://[^?#]*'), '/+$', '')) AS source_id, arg_max(source_type, obs_id) AS source_type, min(obs_id) AS first_obs FROM v_sources GROUP BY 1",
)
def _(spark, d):
    o = redact_catalog(view(spark, d, "v_sources").withColumns({"seen_at": F.timestamp_seconds(F.col("obs_id")), "topic_tags": F.array("topic_tag")}))
    path, out = _lay_down(o, _shared(spark, "stream-in"), "obs_id"), _shared(spark, "catalog")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(path)
    _to_end(spark, S.upsert_catalog(stream, out))
    return BucketStore(spark, out).snapshot().select("source_id", "source_type", F.unix_seconds("created_at").alias("first_obs"))
