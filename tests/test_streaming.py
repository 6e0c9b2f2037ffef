from pyspark.sql import functions as F

from verdance.operators import zonal
from verdance.streaming import scenes


def test_statistics_of_arriving_scenes(spark, tmp_path):
    schema = "group_code string, group_label string, index string, date date, value float"
    rows = [("A", "a", "NDVI", f"2020-0{m}-05", float(v) / 100) for m in (1, 2) for v in range(60)]
    for m in (1, 2):
        part = spark.createDataFrame([r for r in rows if r[3] == f"2020-0{m}-05"], schema.replace("date date", "date string")).withColumn("date", F.col("date").cast("date"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        scenes.statistics_stream(stream, [*zonal.ZONE, "date"], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = scenes.envelopes_now(spark, f"{tmp_path}/out").collect()
    assert {(r.doy_bin_label, r.n_dates, r.support_pixels_total) for r in got} == {("001-030", 1, 60), ("031-060", 1, 60)}


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in scenes.windowed_counts(df, "t", "10 minutes", "1 hour", "k").collect()) == [1, 2]
