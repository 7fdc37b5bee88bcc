import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators.eager import heavy_keys, join_rollup


def test_equals_the_joined_rows(spark):
    rnd = random.Random(3)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = spark.createDataFrame([(key(), rnd.choice([None, 1, 2, 5])) for _ in range(300)], "k string, x int")
    right = spark.createDataFrame([(key(), rnd.choice([None, 2, 3])) for _ in range(200)] + [("only", 1)], "k string, x int")
    for how in ("inner", "left"):
        got = join_rollup(left, right, ["k"], {"a": F.col("x")}, {"b": F.col("x")}, how)
        want = left.select("k", F.col("x").alias("a")).filter("k is not null").join(right.select("k", F.col("x").alias("b")), "k", how).groupBy("k").agg(
            F.count("*").alias("n_rows"), F.sum("a").alias("a_sum"), F.avg("a").alias("a_avg"), F.min("a").alias("a_min"), F.sum("b").alias("b_sum"), F.avg("b").alias("b_avg"), F.max("b").alias("b_max")
        )
        cols = want.columns
        assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_heavy_keys(spark):
    rows = [("a", f"i{k}") for k in range(30)] + [("b", f"j{k}") for k in range(3)] + [(None, f"n{k}") for k in range(17)] + [("a", "i0")] * 50 + [("c", None)]
    items = spark.createDataFrame(rows, "account_hash string, item_id string")
    index = spark.createDataFrame([("a",), ("a",)], "account_hash string")
    got = {r.account_hash: (r.n_records, r.n_index) for r in heavy_keys(items, index, "account_hash", "item_id", 6).collect()}
    assert got == {"a": (30, 2), "b": (3, 0)}
    assert heavy_keys(items.limit(0), index, "account_hash", "item_id", 6).count() == 0
    assert Counter(k for k, _ in rows)["a"] == 80
