import random

from pyspark.sql import functions as F

from tidemark.operators import chunking, history as H

ITEMS = "item_id string, account_hash string, kind string, subreddit string, created_utc bigint, body string, score int, parent_id string, link_id string, permalink string, fetched_utc bigint, source string"


def item(i, **over):
    base = dict(item_id=f"t1_{i}", account_hash="a", kind="comment", subreddit="Moss ", created_utc=1000 + i, body="x", score=1, parent_id=None, link_id="t3_q", permalink=None, fetched_utc=5000, source="test")
    return tuple({**base, **over}.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert H.profile(H.normalised(H.first_fetched(none))).count() == 0
    assert H.gap_cohorts(none, "created_utc", 10).count() == 0
    ranked = H.ranked(none.withColumn("len", F.lit(0)), "account_hash", "created_utc", "item_id")
    assert chunking.greedy_pack(ranked, ["account_hash"], ["created_utc"], "len", 10, "item_id").count() == 0


def test_normalised(spark):
    df = spark.createDataFrame([item(1, subreddit=" r/Moss", body="[deleted]", score=None, parent_id=""), item(2, created_utc=None), item(3, body=None, subreddit=None)], ITEMS)
    got = {r.item_id: r for r in H.normalised(df).collect()}
    assert set(got) == {"t1_1", "t1_3"}
    assert (got["t1_1"].subreddit, got["t1_1"].body, got["t1_1"].score, got["t1_1"].parent_id, got["t1_1"].permalink) == ("moss", "", 0, None, "/comments/q/_/1/")
    assert (got["t1_3"].subreddit, got["t1_3"].body) == (None, "")


def test_first_fetched_takes_one_whole_row(spark):
    df = spark.createDataFrame([item(1, fetched_utc=9, score=5), item(1, fetched_utc=8, score=7), item(1, fetched_utc=8, score=None), item(1, fetched_utc=None)], ITEMS)
    (r,) = H.first_fetched(df).collect()
    assert (r.fetched_utc, r.score) == (8, 7)


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([item(i) for i in range(5)], ITEMS).withColumn("position", F.lit("mine")).withColumn("n", F.lit(1))
    out = H.ranked(df.drop("position"), "account_hash", "created_utc", "item_id")
    assert sorted(r.position for r in out.collect()) == [0, 1, 2, 3, 4]
    assert H.newest(df, ["account_hash"], 2).count() == 2


def test_ranked_equals_a_plain_rank(spark):
    rnd = random.Random(1)
    rows = [(f"i{k}", rnd.choice("aab"), rnd.randrange(0, 10**8)) for k in range(400)]
    df = spark.createDataFrame(rows, "item_id string, account_hash string, created_utc bigint")
    got = {r.item_id: (r.position, r.group_size) for r in H.ranked(df, "account_hash", "created_utc", "item_id").collect()}
    for a in "ab":
        order = sorted((t, i) for i, k, t in rows if k == a)
        assert all(got[i] == (p, len(order)) for p, (_, i) in enumerate(order))


def test_gap_cohorts_equal_a_plain_scan(spark):
    rnd = random.Random(2)
    times = [rnd.randrange(0, 10_000) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id int, at bigint")
    got = {r.id: r.cohort for r in H.gap_cohorts(df, "at", 90).collect()}
    cohort, before = 0, None
    for t, k in sorted((t, k) for k, t in enumerate(times)):
        cohort += before is not None and t - before > 90
        before = t
        assert got[k] == cohort


def test_greedy_pack(spark):
    lengths = [5, 3, 4, 50, 1, None, 9]
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(lengths)], "g string, i int, len int")
    got = [r.pack for r in chunking.greedy_pack(df.withColumn("id", F.col("i")), ["g"], ["i"], "len", 12, "id").orderBy("i").collect()]
    want, pack, cur = [], -1, 0
    for n in lengths:
        n = n or 0
        if pack >= 0 and cur + n + 2 <= 12:
            cur += n + 2
        else:
            pack, cur = pack + 1, n
        want.append(pack)
    assert got == want


def test_exclusion(spark):
    df = spark.createDataFrame([("Depression",), ("eatinghelp",), ("historians",), (None,)], "s string")
    flags = [r[0] for r in df.select(H.excluded(F.col("s"), ["depression"], ["eating"])).collect()]
    assert flags == [True, True, False, False]


def test_hash(spark):
    a, b, c = spark.createDataFrame([(" Bob",), ("bob ",), (None,)], "s string").select(H.entity_hash(F.col("s"), "k")).collect()
    assert a[0] == b[0] and len(a[0]) == 16 and c[0] is None


def test_long_pack_equals_the_plain_walk(spark):
    import numpy as np

    rnd = random.Random(7)
    for budget in (10, 60):
        lengths = np.array([rnd.choice([0, 1, 5, 9, 30, 90]) for _ in range(500)])
        want = chunking.pack_block(lengths, -1, 0, budget, 2)
        pack, cur = -1, budget + 1
        for b in range(0, 500, 37):
            part = lengths[b : b + 37]
            assert (chunking.pack_block(part, pack, cur, budget, 2) == want[b : b + 37]).all()
            pack, cur = chunking.through(chunking.block_table(part, budget, 2), pack, cur)
        assert pack == want[-1]
        rows = [("g", i, int(n), "x") for i, n in enumerate(lengths)] + [("h", 0, None, "y")]
        df = spark.createDataFrame(rows, "g string, position bigint, len int, pack_name string")
        got = {(r.g, r.position): r.pack for r in chunking.greedy_pack_long(df, ["g"], "len", budget, block=50).collect()}
        assert all(got["g", i] == want[i] for i in range(500)) and got["h", 0] == 0


def test_posts(spark):
    rows = [(" T ", " body\n"), ("T", " "), (None, "x"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, x string").select(H.post_body(F.col("t"), F.col("x"))).collect()]
    assert got == ["T\n\nbody", "T", "x", ""]


def test_bodies_stay_out_of_the_shuffle(spark):
    df = spark.createDataFrame([item(1)], ITEMS)
    plan = H.first_fetched(df, ["account_hash"])._jdf.queryExecution().sparkPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Aggregate" in line]
    assert len(shuffled) >= 1 and H.first_fetched(df, ["account_hash"]).columns == ["item_id", "account_hash"]


def test_probe_sample_equals_a_plain_look(spark):
    rnd = random.Random(3)
    rows = [(f"i{k}", rnd.choice("abcdefgh"), rnd.randrange(0, 1000)) for k in range(300)]
    df = spark.createDataFrame(rows, "item_id string, account_hash string, created_utc bigint")
    probes = [(0, 700), (1, 100), (2, 995), (3, 2000)]
    want = {}
    for p, t in probes:
        for pos, (_, _, a) in enumerate(sorted((c, i, a) for i, a, c in rows if c >= t)[:7], 1):
            want.setdefault(a, (p, pos))
    got = {r.account_hash: (r.probe, r.pos) for r in H.probe_sample(df, probes, 7, 100).collect()}
    assert got == want


def test_chunk_texts(spark):
    rows = [("g", 0, i, f"i{i}", "x" * n, n) for i, n in enumerate([90, 90, 90, 30, 200])] + [("g", 1, 0, "j", "y" * 500, 500), ("g", 1, 1, "k", "z", 1)]
    df = spark.createDataFrame(rows, "g string, w int, position int, item_id string, piece string, len int")
    kept = chunking.within_budget(df, ["g", "w"], "position", "len", 280)
    assert {r.item_id for r in kept.collect()} == {"i0", "i1", "i2", "j"}
    out = {r.w: r for r in chunking.texts(kept, ["g", "w"], "position", "piece", 100).collect()}
    assert out[0].text == "\n\n".join(["x" * 90] * 3) and out[0].item_ids == ["i0", "i1", "i2"] and out[0].n_chars == 274 and out[1].n_chars == 500
