"""Observed metrics against aggregates."""

import json

from pyspark.sql import functions as F

from cairn.operators import metrics


def test_batch(spark, tmp_path):
    rows = [(i, float(i % 17) if i % 5 else None, ("idle", "ready", "failed")[i % 3]) for i in range(1000)] + [(1, float("nan"), None)]
    tiles = spark.createDataFrame(rows, "tile long, height double, phase string").repartition(4)
    found, seen = metrics.watched(tiles, metrics.tile_metrics("height", "phase"))
    found.filter("tile < 500").write.parquet(f"file://{tmp_path}/out")
    assert seen.get == tiles.agg(*metrics.tile_metrics("height", "phase")).first().asDict()
    assert seen.get["rows"] == 1001 and seen.get["high"] == 16.0 and seen.get["loading"] == 0


def test_stream(spark, tmp_path):
    tiles = spark.createDataFrame([(i, float(i)) for i in range(90)], "tile long, height double")
    for part in range(3):
        tiles.filter(F.col("tile") % 3 == part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    listener = metrics.MetricsListener()
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(tiles.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").observe("tiles", *metrics.tile_metrics("height"))
        query = source.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
        query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [m["rows"] for m in listener.seen["tiles"]] == [30, 30, 30] and max(m["high"] for m in listener.seen["tiles"]) == 89.0
    assert json.loads(listener.json("tiles"))["batch"] == 2 and listener.json("none") == "{}"
