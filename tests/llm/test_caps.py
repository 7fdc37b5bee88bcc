import random

from tidemark.llm import caps

SCHEMA = "item_id string, subreddit string, score int, fetched_utc bigint"


def brute(rows, parts):
    latest = {}
    for i, s, q, t in rows:
        if i is not None:
            key = (t if t is not None else -(1 << 62), q if q is not None else -(1 << 62), s or "")
            if i not in latest or key > latest[i][0]:
                latest[i] = (key, s, q)
    cap = len(latest) // parts
    groups = {}
    for i, (_, s, q) in latest.items():
        name = (s or "").strip().lower()
        name = name[2:].strip() if name.startswith("r/") else name
        if name:
            groups.setdefault(name, []).append((q is None, -(q or 0), i))
    return {i for g in groups.values() for *_, i in sorted(g)[cap:]}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    for n, names in ((400, ["Hot", "r/hot ", "hot", "cold", None, " "]), (15, ["a"]), (200, ["x"] * 9 + ["y"])):
        rows = [(f"t1_{rnd.randrange(n):05d}", rnd.choice(names), rnd.choice([None, 0, 1, 1, 1, 7]), rnd.choice([None, 5, 9])) for _ in range(n * 2)] + [(None, "a", 1, 1)]
        df = spark.createDataFrame(rows, SCHEMA)
        for rounds, step in ((2, 2), (1, 1), (0, 2)):
            caps_rows = caps.latest(df)
            cap = caps_rows.count() // 20
            got = [r.item_id for r in caps.over_cap(caps_rows.filter("who is not null"), cap, rounds=rounds, step=step).collect()]
            assert len(got) == len(set(got)) and set(got) == brute(rows, 20)
        kept = {r.item_id for r in caps.capped(df).collect()}
        assert not kept & brute(rows, 20)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "x", 1, 1, "who", 3)], SCHEMA + ", who string, cap int")
    assert [r.item_id for r in caps.found(df).collect()] == ["a"]
    assert caps.found(df.limit(0)).count() == 0
    assert caps.capped(df, share=None, most=1).count() == 1


def test_share_and_count_together(spark):
    df = spark.createDataFrame([(f"x{i:03d}", f"s{i % 50}", i, 1) for i in range(200)], SCHEMA)
    kept = caps.capped(df, share=0.5, most=1)
    assert kept.count() == 50
    assert caps.capped(df, share=0.01, most=3).count() == 100
