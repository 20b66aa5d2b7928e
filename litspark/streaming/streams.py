"""Campaign events and action logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.redact import redact_map
from ..functions.text import elapsed_seconds
from ..operators.catalog import remember_sources
from ..operators.telemetry import ALLOWED_KEYS
from .buckets import BucketStore

EVENT = "event_id long, campaign_id long, type string, stage_pos int, ok boolean, error string, ts timestamp, meta map<string,string>"
MAX_ENTERS = 3
#: Groups of campaigns whose state is held together.
STATE_BUCKETS = 4096


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def sanitized(events: DataFrame) -> DataFrame:
    """Events with only allowed keys of ``meta``, redacted; batch and stream alike."""
    return events.withColumn("meta", redact_map(F.map_filter("meta", lambda k, _: k.isin(*ALLOWED_KEYS))))


def fold_durations(old: DataFrame | None, events: DataFrame) -> DataFrame:
    """(campaign_id, stage_pos, type, ts, seconds): each stage's last event and its sum of time after enters, with a batch's events."""
    key = ["campaign_id", "stage_pos"]
    by = Window.partitionBy(*key).orderBy("event_id")
    gap = elapsed_seconds(F.lag("ts").over(by), F.col("ts"))
    rows = events.withColumn("gap", F.when(F.lag("type").over(by) == "stage_enter", gap))
    at = lambda f, c: f(c, "event_id").alias(f"{'first' if f is F.min_by else 'last'}_{c}")
    new = rows.groupBy(*key).agg(at(F.min_by, "ts"), at(F.max_by, "ts"), at(F.max_by, "type"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("more"))
    if old is None:
        return new.select(*key, F.col("last_type").alias("type"), F.col("last_ts").alias("ts"), F.col("more").alias("seconds"))
    between = F.when(F.col("type") == "stage_enter", elapsed_seconds(F.col("ts"), F.col("first_ts"))).otherwise(0.0)
    seconds = F.coalesce("seconds", F.lit(0.0)) + F.coalesce(F.when(F.col("first_ts").isNotNull(), between), F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
    both = old.join(new, key, "full_outer")
    return both.select(*key, F.coalesce("last_type", "type").alias("type"), F.coalesce("last_ts", "ts").alias("ts"), seconds.alias("seconds"))


def stream_stage_durations(events: DataFrame, path: str, keep: str | None = None, buckets: int = 64):
    """A writer that keeps the running (campaign_id, stage_pos, seconds) of all stages in a ``BucketStore`` at ``path``.

    Events of a key are taken in order of event_id inside a batch, and batches in their order. What lies between batches
    is a stage's last event and its sum; a batch rewrites the buckets of its campaigns. With ``keep`` (an interval), stages
    without an event for so long, seen from a batch's last event, leave the buckets that the batch touches, for good, to ``path``/ended:
    what comes later is a new row, and ``stage_totals`` adds up both.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        store = BucketStore(batch.sparkSession, path, buckets)
        rows = batch.where("stage_pos is not null")
        if keep is None:
            store.merge(batch_id, rows, F.col("campaign_id"), fold_durations)
            return
        now = rows.agg(F.max("ts").alias("now")).first()["now"]
        over = F.col("ts") < F.lit(now) - F.expr(f"interval {keep}")

        def split(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                return fold_durations(old, new)
            ended = old.where(over).select("campaign_id", "stage_pos", "seconds")
            ended.write.mode("overwrite").parquet(f"{path}/ended/batch={batch_id}")
            return fold_durations(old.where(~over), new)

        store.merge(batch_id, rows, F.col("campaign_id"), split)

    return events.writeStream.foreachBatch(fold)


def stage_totals(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """(campaign_id, stage_pos, seconds) after ``batch`` (default: the last), with what ended."""
    rows = BucketStore(spark, path).snapshot(batch).select("campaign_id", "stage_pos", "seconds")
    try:
        ended = spark.read.parquet(f"{path}/ended")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    ended = ended if batch is None else ended.where(F.col("batch") <= batch)
    return rows.unionByName(ended.drop("batch")).groupBy("campaign_id", "stage_pos").agg(F.sum("seconds").alias("seconds"))


def stream_failures(events: DataFrame) -> DataFrame:
    return events.where("type = 'stage_exit' and ok = false").select("campaign_id", "event_id", F.lit("stage_failure").alias("kind"), "stage_pos", F.coalesce("error", F.lit("unknown")).alias("reason"))


def _by_bucket(rows: DataFrame, buckets: int):
    """``rows`` grouped by a bucket of campaigns, those without an id apart: state and Python calls are as many as buckets, not as keys."""
    keyed = rows.withColumns({"bucket": F.pmod(F.xxhash64("campaign_id"), F.lit(buckets)), "nameless": F.col("campaign_id").isNull()})
    return keyed.groupBy("bucket", "nameless")


def _columns(frames: Iterator[pd.DataFrame], nameless: bool, *names: str) -> list[list]:
    """The columns ``names`` of a bucket's rows as lists, with None for a missing campaign."""
    rows = pd.concat(list(frames))
    return [[None] * len(rows) if nameless and n == "campaign_id" else rows[n].tolist() for n in names]


def _alerts(found: list[tuple], kind: str) -> Iterator[pd.DataFrame]:
    if found:
        campaigns, stages = zip(*found)
        yield pd.DataFrame({"campaign_id": pd.array(campaigns, dtype="Int64"), "stage_pos": stages, "kind": kind})


def stream_thrashing(events: DataFrame, most: int = MAX_ENTERS, buckets: int = STATE_BUCKETS) -> DataFrame:
    """One alert per campaign and stage, when its enters pass ``most``. State holds a bucket's counts, up to one more than ``most``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        campaigns, stages, counts = state.get if state.exists else ([], [], [])
        n = dict(zip(zip(campaigns, stages), counts))
        found = []
        for at in zip(*_columns(frames, key[1], "campaign_id", "stage_pos")):
            before = n.get(at, 0)
            if before == most:
                found.append(at)
            n[at] = min(before, most) + 1
        state.update(([c for c, _ in n], [s for _, s in n], list(n.values())))
        yield from _alerts(found, "thrashing")

    entered = events.where("type = 'stage_enter' and stage_pos is not null").select("campaign_id", "stage_pos")
    return _by_bucket(entered, buckets).applyInPandasWithState(step, "campaign_id long, stage_pos int, kind string", "campaigns array<long>, stages array<int>, n array<int>", "append", GroupStateTimeout.NoTimeout)


def stream_stuck(events: DataFrame, seconds: int = 300, late: str = "1 second", buckets: int = STATE_BUCKETS) -> DataFrame:
    """One alert per entered stage that is neither left nor followed by another enter within ``seconds`` of event time.

    A stage that is still open at the end of the input gets its alert if the last event, less ``late``, is more than ``seconds`` away.
    Events later than ``late``, or just as late, are dropped. State holds the open stages of a bucket's campaigns; one goes with its exit or alert.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        campaigns, stages, times = state.get if state.exists else ([], [], [])
        opened = dict(zip(campaigns, zip(stages, times)))
        found = []
        if not state.hasTimedOut:
            for _, campaign, kind, pos, at in sorted(zip(*_columns(frames, key[1], "event_id", "campaign_id", "type", "stage_pos", "at")), key=lambda e: e[0]):
                stage, since = opened.get(campaign, (None, 0))
                if stage is not None and at - since > seconds * 1_000_000:
                    found.append((campaign, stage))
                    stage = None
                    del opened[campaign]
                if kind == "stage_enter":
                    opened[campaign] = (pos, at)
                elif kind == "stage_exit" and pos == stage:
                    del opened[campaign]
        watermark = state.getCurrentWatermarkMs()
        due = lambda since: since // 1000 + seconds * 1000
        for campaign, (stage, since) in list(opened.items()):
            if due(since) < watermark:
                found.append((campaign, stage))
                del opened[campaign]
        if opened:
            state.update((list(opened), [s for s, _ in opened.values()], [t for _, t in opened.values()]))
            state.setTimeoutTimestamp(max(min(due(t) for _, t in opened.values()), watermark + 1))
        elif state.exists:
            state.remove()
        yield from _alerts(found, "stuck")

    rows = events.where("stage_pos is not null").withWatermark("ts", late).select("campaign_id", "event_id", "type", "stage_pos", "ts", F.unix_micros("ts").alias("at"))
    return _by_bucket(rows, buckets).applyInPandasWithState(step, "campaign_id long, stage_pos int, kind string", "campaigns array<long>, stages array<int>, since array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def action_stats(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, outcome, agent_name, n) in tumbling windows; batch and stream alike."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    counts = rows.groupBy(F.window("ts", window), "outcome", "agent_name").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "outcome", "agent_name", "n")


def upsert_catalog(observations: DataFrame, path: str, buckets: int = 64):
    """A writer that folds each micro-batch of observations into the catalogue, a ``BucketStore`` at ``path`` by source_id.

    A batch rewrites the buckets of the sources it names; tried again, it gives the same snapshot.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        BucketStore(batch.sparkSession, path, buckets).merge(batch_id, batch, F.col("source_id"), remember_sources)

    return observations.writeStream.foreachBatch(fold)


def run_available(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, run to its end into Parquet files at ``path``; in update mode with the batch of each row."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/{n}"))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return stream.sparkSession.read.schema(stream.schema).parquet(path)
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(path)
