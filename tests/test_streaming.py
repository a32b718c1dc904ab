import shutil

from hearsay import functions as H
from hearsay import streaming

DATA = "/root/testdata/sf0.001"


def test_windowed_codes_match_the_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = streaming.windowed_codes(stream, "ts", "event_type", H.soundex, "1 day").writeStream.format("memory").queryName("codes").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("SELECT start, code, n_rows FROM codes").collect()}
    want = {(r.start, r.code, r["n_rows"]) for r in streaming.windowed_codes(batch, "ts", "event_type", H.soundex, "1 day").collect()}
    assert got == want and got


def test_arrow_encoders_and_first_rows(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = streaming.first_of_each_code(stream, "ts", "event_type", H.metaphone, "3650 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT code FROM firsts").count() == batch.select(H.metaphone("event_type").alias("c")).distinct().count()
