from pyspark.sql import functions as F

from tidemark.streaming import twins


def _stream(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_sessions_match_the_batch_form(spark, tmp_path):
    rows = [(1, t, 1.0) for t in (0, 60, 4000, 90_000, 400_000)] + [(None, 5, 1.0), (2, 900_000, 2.0)]
    df = spark.createDataFrame(rows, "user_id bigint, s bigint, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "value")
    batch = sorted((r.user_id, r.n) for r in twins.session_counts(df, "1 hour").collect())
    assert batch == [(1, 1), (1, 1), (1, 1), (1, 2), (2, 1)]
    live = _run(twins.session_counts(_stream(spark, tmp_path, df), "1 hour"), "live_sessions")
    got = {(r.user_id, r.start, r.n) for r in live.collect()}
    want = {(r.user_id, r.start, r.n) for r in twins.session_counts(df, "1 hour").collect()}
    assert got <= want and len(got) >= 3


def test_seen_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "item_id string, fetched_utc bigint")
    assert _run(twins.seen_once(_stream(spark, tmp_path, df)), "live_once").count() == 2
    assert twins.seen_once(df).count() == 2


def test_count_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "xy")] * 7 + [("b", None)] * 3 + [(None, "z")] * 9, "account_hash string, body string")
    rows = _run(twins.count_windows(_stream(spark, tmp_path, df), 3), "live_windows").collect()
    assert sorted((r.account_hash, r.window_no, r.n, r.n_chars) for r in rows) == [("a", 0, 3, 6), ("a", 1, 3, 6), ("b", 0, 3, 0)]


def test_index_upsert(spark, tmp_path):
    write, path = twins.upsert_index(str(tmp_path / "index")), str(tmp_path / "index")
    one = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 5, 10)], "account_hash string, n int, ingested_utc bigint")
    two = spark.createDataFrame([("a", 9, 20), (None, 1, 1)], "account_hash string, n int, ingested_utc bigint")
    write(one, 0)
    write(two, 1)
    write(two, 1)
    assert {(r.account_hash, r.n) for r in twins.read_index(spark, path).collect()} == {("a", 9), ("b", 5)}
