from pyspark.sql import functions as F

from panelforge.streaming import calendar as C


def test_daily_counts_equal_the_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id")
    late = spark.createDataFrame([(None, 1)], "ts timestamp, user_id long")
    end = events.select((F.max("ts") + F.expr("interval 40 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"))
    for i, part in enumerate((events, end.unionByName(late), end)):
        part.coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = C.daily_counts(stream).writeStream.outputMode("append").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["day"], r["n"]) for r in spark.table("daily").collect()}
    want = {(r["day"], r["n"]) for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_sessions_of_a_batch(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    got = sorted((r["user_id"], r["n"]) for r in C.sessions(df).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
