"""Stream state by buckets of campaigns, and rows that all tasks work out (F8, F10, F14)."""

import uuid

from pyspark.sql import functions as F

from litspark.operators.shared import shared_dir
from litspark.queries.streams import _lay_down
from litspark.streaming import streams


def _run(spark, stream, base):
    query = stream.writeStream.format("memory").queryName(f"q{uuid.uuid4().hex}").option("checkpointLocation", f"{base}/{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    return sorted(spark.table(query.name).collect(), key=repr), states


def test_state_is_held_by_bucket(spark):
    rows = [(k, None if k % 51 == 50 else k % 51, "stage_enter", 3, None, None, k) for k in range(51 * 5)]
    made = spark.createDataFrame(rows, "event_id long, campaign_id long, type string, stage_pos int, ok boolean, error string, at long")
    made = made.withColumns({"ts": F.timestamp_seconds(F.col("at") + 1000), "meta": F.create_map(F.lit("stage"), F.lit("x"))}).drop("at")
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    source = spark.readStream.schema(streams.EVENT).option("maxFilesPerTrigger", 1).parquet(_lay_down(made, f"{base}/in", "event_id", 3))
    found, states = _run(spark, streams.stream_thrashing(source, buckets=4), base)
    assert sorted(map(repr, found)) == sorted(repr(r) for r in spark.createDataFrame([(c, 3, "thrashing") for c in [*range(50), None]], "campaign_id long, stage_pos int, kind string").collect())
    assert states <= 5
    found, states = _run(spark, streams.stream_stuck(source, seconds=50, buckets=4), base)
    assert len(found) == 51 * 4 and len([r for r in found if r.campaign_id is None]) == 4
    assert states <= 5


def test_laid_down_rows_are_worked_out_by_all_tasks(spark):
    df = spark.range(0, 40, 1, 4).withColumn("task", F.spark_partition_id())
    path = _lay_down(df, f"{shared_dir(spark)}/{uuid.uuid4().hex}", "id")
    back = spark.read.parquet(path)
    assert sorted(r.task for r in back.select("task").distinct().collect()) == [0, 1, 2, 3]
    assert back.select(F.input_file_name()).distinct().count() == 2
