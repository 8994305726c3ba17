from pyspark.sql import functions as F

from scenespark.plans import tiler
from scenespark.queries.tiling import objects
from scenespark.proxy import views
from scenespark.streaming import windows

SF = "/root/testdata/sf0.001"


def _keys(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("target"), F.col("event_type").alias("axis"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), "value").repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("ts timestamp, target long, axis string, t double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_windows(spark, tmp_path):
    got = _run(windows.keys_per_window(_keys(spark, tmp_path), late="365 days"), "win", "complete").agg(F.sum("keys")).first()[0]
    assert got == spark.read.parquet(f"{SF}/events.parquet").count()


def test_latest_keys(spark, tmp_path):
    out = _run(windows.latest_keys(_keys(spark, tmp_path), late="365 days"), "latest", "append").groupBy("target", "axis").agg(F.max("t").alias("t"))
    want = spark.read.parquet(str(tmp_path / "in")).groupBy("target", "axis").agg(F.max("t").alias("t"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_tiler(spark):
    (g,) = views(spark, SF, "sc_geodes")
    out = tiler.build(objects(g), ("class", "size", "brand"), tiler.Options(levels=3, max_triangles=5000))
    placed = out["members"].count() + out["instances"].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    assert placed == g.count()
    root = tiler.tileset(out["tiles"]).first()
    assert root.tiles == out["tiles"].count() and root.geometric_error > out["tiles"].agg(F.max("geometric_error")).first()[0]
