from pyspark.sql import functions as F

from millrace.operators import rules
from millrace.streaming import streams


def source(spark, tmp_path):
    payload = "struct<name:string,email:string,subject:string,message:string>"
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 2 else "b", ["website_url"] if i % 5 == 0 else [], f"Hello {i} friend", ("n", "e@x.org", "s", "m"), 5000, "M", "r") for i in range(30)]
    df = spark.createDataFrame(rows, f"id long, t string, ip string, honeypot_hits array<string>, normalized_text string, raw_payload {payload}, client_render_time int, user_agent string, referer string")
    df = df.withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams_equal_batch(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    streams.drain(streams.signatures(stream, "normalized_text", "created_at"), "sig", "complete", str(tmp_path / "c1"))
    assert [(r["pattern"], r["occurrence"]) for r in spark.table("sig").collect()] == [("hello <NUM> friend", 30)]
    streams.drain(streams.timeline(stream, "created_at", "10 minutes"), "tl", "complete", str(tmp_path / "c2"))
    assert sorted(r["total"] for r in spark.table("tl").collect()) == [10, 10, 10]
    scored = streams.scored(stream).select("id", "score")
    streams.drain(scored, "sc", "append", str(tmp_path / "c3"))
    assert {r["id"]: r["score"] for r in spark.table("sc").collect()} == {r["id"]: r["score"] for r in streams.scored(df).collect()}
    valid = streams.accepted(df)
    assert valid.where("not valid").count() == 0


def test_exact_rate_equals_window(spark, tmp_path):
    df, _ = source(spark, tmp_path)
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "one"))
    streams.drain(streams.exact_rate(stream, "ip", "created_at", "id"), "rate", "append", str(tmp_path / "c4"))
    want = {r["id"]: r["recent"] for r in rules.recent_count(df, "ip", "created_at").collect()}
    assert {r["id"]: r["recent"] for r in spark.table("rate").collect()} == want
