"""Stage durations, progress, alerts and dashboards from campaign events.

Events: campaign_id, event_id, type, stage_pos (or stage), ok, error, ts. ``event_id`` orders a campaign's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import elapsed_seconds, fixed, slugify
from .shared import cut

# Stages in order, and what telemetry may hold.
STAGES = ("init", "plan", "discover", "screen", "extract", "adversarial", "evaluate", "deliver", "finalize")
ALLOWED_KEYS = ("stage", "status", "duration_ms", "provider", "model")
DEFAULT_SECONDS = 60.0
STUCK_SECONDS = 300.0
STATUSES = ("completed", "failed", "killed", "running", "paused")


def stage_list(spark: SparkSession, weights: dict[int, float] | None = None) -> DataFrame:
    return spark.createDataFrame([(i, s, float((weights or {}).get(i, 1.0))) for i, s in enumerate(STAGES)], "stage_pos int, stage string, weight double")


def events_for(events: DataFrame, campaign_id, type: str | None = None) -> DataFrame:
    found = events.where(F.col("campaign_id") == campaign_id)
    return (found if type is None else found.where(F.col("type") == type)).orderBy("event_id")


def list_campaigns(campaigns: DataFrame, status: str | None = None) -> DataFrame:
    return (campaigns if status is None else campaigns.where(F.col("status") == status)).orderBy(F.desc("created_at"))


def parse_payload(payload: Column) -> Column:
    return F.from_json(payload, "stage string, status string, result struct<ok boolean, error string>")


def telemetry_sanitize(meta: Column) -> Column:
    """A map's allowed keys."""
    return F.map_filter(meta, lambda k, _: k.isin(*ALLOWED_KEYS))


def telemetry_sanitize_json(meta: Column) -> Column:
    """A JSON object's allowed keys whose values are strings, numbers or booleans, as a map of strings; else empty."""
    parsed = F.try_parse_json(meta)
    held = []
    for key in ALLOWED_KEYS:
        value = F.try_variant_get(parsed, f"$.{key}", "variant")
        scalar = F.regexp_like(F.schema_of_variant(value), F.lit("^(STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*)$"))
        held.append(F.when(scalar, F.struct(F.lit(key).alias("key"), F.try_variant_get(parsed, f"$.{key}", "string").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*held)))


def stage_durations(events: DataFrame) -> DataFrame:
    """(campaign_id, stage_pos, seconds): gaps after each enter of a stage to its next event, negative ones as 0."""
    by = Window.partitionBy("campaign_id", "stage_pos").orderBy("event_id")
    gaps = events.where("stage_pos is not null").select("campaign_id", "stage_pos", F.lag("type").over(by).alias("before"), elapsed_seconds(F.lag("ts").over(by), F.col("ts")).alias("gap"))
    return gaps.groupBy("campaign_id", "stage_pos").agg(F.coalesce(F.sum(F.when(F.col("before") == "stage_enter", F.col("gap"))), F.lit(0.0)).alias("seconds"))


def _exit_durations(events: DataFrame) -> DataFrame:
    by = Window.partitionBy("campaign_id", "stage_pos").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    entered = F.last(F.when(F.col("type") == "stage_enter", F.col("ts")), ignorenulls=True).over(by)
    exits = events.where("stage_pos is not null").withColumn("entered", entered).where("type = 'stage_exit' and entered is not null")
    return exits.select("campaign_id", "stage_pos", elapsed_seconds(F.col("entered"), F.col("ts"), floor=False).alias("seconds")).where("seconds >= 0")


def mean_stage_durations(events: DataFrame) -> DataFrame:
    """(campaign_id, stage_pos, seconds): mean over exits of the time since the latest enter before."""
    return _exit_durations(events).groupBy("campaign_id", "stage_pos").agg(F.avg("seconds").alias("seconds"))


def last_stage_durations(events: DataFrame) -> DataFrame:
    """(campaign_id, stage_pos, seconds): last exit less last enter, if not negative."""
    last = lambda t: F.max_by(F.when(F.col("type") == t, F.col("ts")), F.when(F.col("type") == t, F.col("event_id")))
    ends = events.where("stage_pos is not null").groupBy("campaign_id", "stage_pos").agg(last("stage_enter").alias("a"), last("stage_exit").alias("b"))
    return ends.select("campaign_id", "stage_pos", elapsed_seconds(F.col("a"), F.col("b"), floor=False).alias("seconds")).where("seconds >= 0")


def progress(campaigns: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """(campaign_id, percent, remaining): weight up to and with the current stage, and the names of later ones."""
    stages = stage_list(campaigns.sparkSession, weights)
    every = stages.agg(F.array_sort(F.collect_list(F.struct("stage_pos", "stage", "weight"))).alias("s"))
    rows = campaigns.select("campaign_id", F.coalesce("stage_pos", F.lit(0)).alias("at")).join(F.broadcast(every))
    weigh = lambda f: F.aggregate(F.filter("s", f), F.lit(0.0), lambda a, x: a + x["weight"])
    done, total = weigh(lambda x: x["stage_pos"] <= F.col("at")), weigh(lambda x: F.lit(True))
    remaining = F.transform(F.filter("s", lambda x: x["stage_pos"] > F.col("at")), lambda x: x["stage"])
    return rows.select("campaign_id", F.when(total == 0, 0).otherwise(F.floor(done / total * 100)).cast("int").alias("percent"), remaining.alias("remaining"))


def eta(campaigns: DataFrame, durations: DataFrame, default: float = DEFAULT_SECONDS) -> DataFrame:
    """(campaign_id, seconds, note): history or ``default`` for each remaining stage, cut to whole seconds."""
    left = F.when(F.col("at") + 1 <= len(STAGES) - 1, F.sequence(F.col("at") + 1, F.lit(len(STAGES) - 1)))
    rows = campaigns.select("campaign_id", F.coalesce("stage_pos", F.lit(0)).alias("at")).select("campaign_id", F.explode_outer(left).alias("stage_pos"))
    known = rows.join(durations.select("campaign_id", "stage_pos", F.col("seconds").alias("history")), ["campaign_id", "stage_pos"], "left")
    sums = known.groupBy("campaign_id").agg(F.count("stage_pos").alias("n"), F.count("history").alias("known"), F.sum(F.when(F.col("stage_pos").isNotNull(), F.coalesce("history", F.lit(default)))).alias("total"))
    n = F.concat(F.lit("Estimated "), F.col("n").cast("string"), F.lit(" remaining stages using "))
    how = F.when(F.col("known") > 0, F.concat(F.lit("history for "), F.col("known").cast("string"), F.lit(" stage(s)"))).otherwise("conservative heuristics")
    return sums.select("campaign_id", F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("seconds"), F.when(F.col("n") == 0, "No remaining stages").otherwise(F.concat(n, how)).alias("note"))


def stuck_alerts(events: DataFrame, as_of: Column, threshold: float = STUCK_SECONDS) -> DataFrame:
    """Campaigns whose latest entered stage is not the latest exited one, for over ``threshold`` seconds."""
    last = lambda what, t: F.max_by(F.when(F.col("type") == t, F.col(what)), F.when(F.col("type") == t, F.col("event_id")))
    ends = events.groupBy("campaign_id").agg(last("stage_pos", "stage_enter").alias("stage_pos"), last("stage_pos", "stage_exit").alias("left"), last("ts", "stage_enter").alias("since"))
    waits = ends.where("since is not null and not stage_pos <=> left").withColumn("elapsed_seconds", elapsed_seconds(F.col("since"), as_of, floor=False))
    return waits.where(F.col("elapsed_seconds") > threshold).select("campaign_id", F.lit("stuck").alias("kind"), "stage_pos", "elapsed_seconds")


def failure_alerts(events: DataFrame) -> DataFrame:
    """Exits whose result is not ok; one without a result is no failure."""
    failed = events.where("type = 'stage_exit' and ok = false")
    return failed.select("campaign_id", "event_id", F.lit("stage_failure").alias("kind"), "stage_pos", F.coalesce("error", F.lit("unknown")).alias("reason"))


def thrash_alerts(events: DataFrame, most: int = 3) -> DataFrame:
    counts = events.where("type = 'stage_enter' and stage_pos is not null").groupBy("campaign_id", "stage_pos").agg(F.count("*").alias("enter_count"))
    return counts.where(F.col("enter_count") > most).select("campaign_id", F.lit("thrashing").alias("kind"), "stage_pos", "enter_count")


def status_snapshot(campaigns: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """One row per campaign: stage, status, percent, eta_seconds and the number of alerts of each kind."""
    counted = lambda df, name: df.groupBy("campaign_id").agg(F.count("*").alias(name))
    found = campaigns.select("campaign_id", "stage_pos", "status").join(progress(campaigns), "campaign_id")
    found = found.join(eta(campaigns, last_stage_durations(events)).withColumnRenamed("seconds", "eta_seconds"), "campaign_id")
    for alerts, name in ((stuck_alerts(events, as_of), "stuck"), (failure_alerts(events), "failures"), (thrash_alerts(events), "thrashing")):
        found = found.join(counted(alerts, name), "campaign_id", "left")
    return found.fillna(0, ["stuck", "failures", "thrashing"])


def calibrate_weights(events: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """(stage_pos, weight) from all exits: mean duration over the mean of stages' means, at least 0.1; stages
    without exits keep theirs; sums to 1, four decimals."""
    means = _exit_durations(events).groupBy("stage_pos").agg(F.avg("seconds").alias("mean"))
    stages = stage_list(events.sparkSession, weights).join(means, "stage_pos", "left")
    all_ = Window.partitionBy(F.lit(0))
    base = F.avg("mean").over(all_)
    stages = stages.withColumn("w", F.when(F.col("mean").isNotNull() & (base > 0), F.greatest(F.lit(0.1), F.col("mean") / base)).otherwise(F.col("weight")))
    total = F.sum("w").over(all_)
    return stages.select("stage_pos", F.when(total == 0, F.col("w")).otherwise(F.round(F.col("w") / total, 4)).alias("weight"))


def _select(values: DataFrame, rank: int, held: int, bins: int) -> float:
    """The value of ``rank`` (from 0) in the column v: ranges are narrowed by histograms until ``held`` values or one are left."""
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    while low < high and n > held:
        width = (high - low) / bins
        part = values.where(F.col("v").between(low, high)).groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).alias("bin"))
        for r in sorted(part.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["bin"]):
            if rank < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            rank -= r["n"]
    if low == high:
        return low
    return values.where(F.col("v").between(low, high)).orderBy("v").limit(rank + 1).collect()[-1]["v"]


def exact_median(df: DataFrame, value: Column, held: int = 10_000, bins: int = 1_024) -> float | None:
    """The median of the finite values, the mean of the middle two of an even number; None without values.

    Selection by repeated histograms: each pass brings ``bins`` counts to the driver, the last one at most ``held`` values, so no
    task gathers the column.
    """
    values = cut(df.select(value.cast("double").alias("v")).where("v is not null"))
    n = values.count()
    if not n:
        return None
    middle = {_select(values, k, held, bins) for k in {(n - 1) // 2, n // 2}}
    return sum(middle) / len(middle)


def campaign_metrics(campaigns: DataFrame) -> DataFrame:
    """One row: total, count by status, mean and exact median duration; nulls for an empty table."""
    seconds = elapsed_seconds(F.col("created_at"), F.col("updated_at"))
    median = F.lit(exact_median(campaigns, seconds)).cast("double").alias("median_seconds")
    return campaigns.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.avg(seconds).alias("average_seconds")).select("*", median)


def stage_counts(campaigns: DataFrame) -> DataFrame:
    return campaigns.groupBy("stage_pos").agg(F.count("*").alias("campaigns"))


def newest_queries(campaigns: DataFrame, most: int = 5) -> DataFrame:
    return campaigns.orderBy(F.desc("created_at"), "campaign_id").limit(most).select("campaign_id", "query", "created_at")


def campaign_summaries(campaigns: DataFrame, events: DataFrame) -> DataFrame:
    """Each campaign with its duration and a map of stage durations."""
    stages = stage_durations(events).groupBy("campaign_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage_pos", "seconds")))).alias("stage_seconds"))
    return campaigns.withColumn("duration_seconds", elapsed_seconds(F.col("created_at"), F.col("updated_at"))).join(stages, "campaign_id", "left")


def campaign_sections(summaries: DataFrame) -> DataFrame:
    """(campaign_id, section): each campaign of ``campaign_summaries`` as Markdown, a row each, so that a report of any
    length is written by as many tasks as it takes, ordered by the writer."""
    line = lambda name, c: F.concat(F.lit(f"- **{name}**: "), c)
    named = F.transform(F.map_entries("stage_seconds"), lambda e: F.struct(_stage_name(e["key"]).alias("stage"), e["value"].alias("seconds")))
    stages = F.transform(F.array_sort(named), lambda s: F.concat(F.lit("  - "), s["stage"], F.lit(": "), fixed(s["seconds"], 1), F.lit("s")))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    lines = [
        F.concat(F.lit("### "), slugify(F.col("query")), F.lit(" ("), F.col("campaign_id").cast("string"), F.lit(")\n")),
        line("Query", F.col("query")),
        line("Status", F.col("status")),
        line("Stage", _stage_name(F.col("stage_pos"))),
        line("Created", iso("created_at")),
        line("Updated", iso("updated_at")),
        line("Duration", F.concat(fixed(F.col("duration_seconds"), 1), F.lit("s"))),
        F.when(F.size(stages) > 0, F.concat(F.lit("- **Stage durations**:\n"), F.array_join(stages, "\n"))),
    ]
    return summaries.select("campaign_id", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("section"))


def _stage_name(pos: Column) -> Column:
    return F.get(F.array(*map(F.lit, STAGES)), pos)


def _breakdowns(stages: DataFrame, newest: DataFrame) -> DataFrame:
    """One row: lines of ``stage_counts`` by name and of ``newest_queries``, newest first; both are a few rows."""
    named = F.struct(_stage_name(F.col("stage_pos")).alias("stage"), F.col("campaigns").cast("string").alias("n"))
    by_stage = stages.agg(F.transform(F.array_sort(F.collect_list(named)), lambda s: F.concat(F.lit("- "), s["stage"], F.lit(": "), s["n"])).alias("by_stage"))
    recent = newest.agg(F.array_sort(F.collect_list(F.struct(-F.unix_micros("created_at"), "campaign_id", F.concat(F.lit("- "), F.col("query")).alias("line")))).alias("recent"))
    return by_stage.join(F.broadcast(recent.select(F.transform("recent", lambda r: r["line"]).alias("recent"))))


def render_dashboard(metrics: DataFrame, generated_at: str, stages: DataFrame | None = None, newest: DataFrame | None = None) -> DataFrame:
    """One row: the report's aggregate part as Markdown, with the breakdowns where ``stages`` and ``newest`` are given.

    Campaigns follow as rows of ``campaign_sections``.
    """
    n = lambda name: F.concat(F.lit(f"- **{name.capitalize()}**: "), F.col(name).cast("string"))
    seconds = lambda c, name: F.concat(F.lit(f"- **{name} duration**: "), fixed(F.col(c), 1), F.lit("s"))
    lines = [F.lit("# Campaign Report\n\n_Generated at " + generated_at + "_\n\n## Aggregate Metrics\n"), F.concat(F.lit("- **Total campaigns**: "), F.col("total").cast("string")), *[n(s) for s in STATUSES]]
    lines += [F.when(F.col("average_seconds").isNotNull(), seconds("average_seconds", "Average")), F.when(F.col("median_seconds").isNotNull(), seconds("median_seconds", "Median"))]
    present = F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.lit(f"- {s}: "), F.col(s).cast("string"))) for s in sorted(STATUSES)]))
    part = lambda title, found: F.when(F.size(found) > 0, F.concat(F.lit(f"\n### {title}\n\n"), F.array_join(found, "\n")))
    if stages is not None and newest is not None:
        metrics = metrics.join(F.broadcast(_breakdowns(stages, newest)))
        lines += [part("Status Breakdown", present), part("Current Stage Breakdown", F.col("by_stage")), part("Recent Queries", F.col("recent"))]
    return metrics.select(F.concat_ws("\n", *lines).alias("report"))
