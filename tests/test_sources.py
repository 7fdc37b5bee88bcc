import json

import pytest

from tidemark.sources import paging, stores


def service(rows, page, bad=()):
    def fetch(_, p):
        if p["sort"] == "asc":
            if any(lo <= p.get("after", 0) < hi for lo, hi in bad):
                raise paging.BadPage
            return sorted((r for r in rows if r["created_utc"] >= p.get("after", 0)), key=lambda r: r["created_utc"])[: p["limit"]]
        return sorted((r for r in rows if r["created_utc"] <= p.get("before", 1 << 60)), key=lambda r: -r["created_utc"])[: p["limit"]]

    return fetch


def test_pages_both_ways():
    rows = [{"id": str(i), "created_utc": 1000 + 7 * i} for i in range(95)]
    for newest in (False, True):
        got = [r["id"] for r in paging.pages(service(rows, 10), "x", {"after": 0}, newest, page_size=10)]
        assert sorted(got, key=int) == [str(i) for i in range(95)] and len(set(got)) == 95


def test_bad_page_skips_a_day_and_busy_waits():
    rows = [{"id": str(i), "created_utc": 100_000 + i} for i in range(5)]
    assert len(list(paging.pages(service(rows, 10, [(0, 80_000)]), "x", {"after": 0}, page_size=10))) == 5
    waits, calls = [], []

    def fetch(_, p):
        calls.append(1)
        if len(calls) < 3:
            raise paging.Busy(200)
        return []

    assert paging.get(fetch, "x", {}, sleep=waits.append) == [] and waits == [60.0, 60.0]
    with pytest.raises(ConnectionError):
        paging.get(lambda *_: (_ for _ in ()).throw(TimeoutError()), "x", {}, tries=2, sleep=waits.append)


def test_rows_that_share_a_second_are_not_lost():
    rows = [{"id": f"{t}-{i}", "created_utc": t} for t, n in ((1, 3), (2, 25), (3, 9), (9, 1)) for i in range(n)]
    for newest in (False, True):
        got = [r["id"] for r in paging.pages(service(rows, 10), "x", {"after": 0}, newest, page_size=10)]
        assert sorted(got) == sorted(r["id"] for r in rows)


def test_endless_bad_pages_are_an_error():
    def fetch(_, p):
        raise paging.BadPage

    with pytest.raises(ConnectionError):
        list(paging.pages(fetch, "x", {"after": 0}, most_skips=5))
    with pytest.raises(ConnectionError):
        list(paging.pages(fetch, "x", {}))


def test_histories_of_both_sources():
    rows = {
        "comments": [{"id": f"c{i}", "created_utc": 100 + i, "subreddit": "Moss", "link_id": "t3_q", "body": "x"} for i in range(30)],
        "posts": [{"id": "p", "created_utc": 115, "title": " T ", "selftext": " text"}, {"id": "q", "created_utc": 99, "title": "T", "selftext": None}],
    }
    fetch = lambda path, p: service(rows[path], 10)(path, p)
    got = paging.history(fetch, "a", after=100, page_size=7)
    assert len(got) == 31 and [r["created_utc"] for r in got] == sorted(r["created_utc"] for r in got)
    assert got[0]["permalink"] == "/comments/q/_/c0/" and got[0]["subreddit"] == "moss" and [r["body"] for r in got if r["kind"] == "post"] == ["T\n\ntext"]
    assert [r["item_id"] for r in paging.history(fetch, "a", posts=False, most=3, page_size=7)] == ["t1_c27", "t1_c28", "t1_c29"]
    assert len(paging.recent(lambda a, n: (rows["comments"] * 2, rows["posts"]), "a", 5)) == 7 and paging.recent(lambda a, n: ([], []), "a") == []


def test_data_source(spark, tmp_path):
    for a in "ab":
        lines = [json.dumps({"id": f"{a}{i}", "account_hash": a, "kind": "comment", "created_utc": i, "body": "x"}) for i in range(250)]
        (tmp_path / f"{a}.jsonl").write_text("\n".join(lines))
    spark.dataSource.register(paging.HistoryPages)
    df = spark.read.format("history_pages").option("path", str(tmp_path)).option("page_size", "40").load()
    assert df.count() == 500 and df.select("item_id").distinct().count() == 500


def test_call_store_answers_each_key_once(spark, tmp_path):
    store = stores.CallStore(spark, str(tmp_path / "calls"))
    wanted = spark.createDataFrame([("k1", "t", "q1", 1), ("k1", "t", "q1", 1), ("k2", "t", "bad", 1), (None, "t", "q", 1)], "key string, task string, request string, created_utc bigint")
    score = lambda df: stores.scored(df, lambda q, attempt: q.upper() if attempt or q != "bad" else "", bool)
    got = {(r.key, r.response) for r in store.answer(wanted, score).collect()}
    assert got == {("k1", "Q1"), ("k2", "BAD"), (None, None)}
    assert store.missing(wanted).count() == 0
    store.put(score(wanted))
    assert store.read().count() == 2


def test_artifacts(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dep string, weight double")
    stores.save_edges(e, str(tmp_path), "e1", "h1")
    assert stores.load_edges(spark, str(tmp_path), "e1").count() == 1
    stores.save_edges(e, str(tmp_path), "e1", "h2")
    with pytest.raises(ValueError):
        stores.load_edges(spark, str(tmp_path), "e1")
    assert stores.load_edges(spark, str(tmp_path), "e1", "h2").count() == 1
    stores.save_sidecar(spark, str(tmp_path / "x.json"), {"n": 1})
    assert stores.load_sidecar(spark, str(tmp_path / "x.json")) == {"n": 1}
    named = spark.createDataFrame([("x", "a", "b", 1.0)], "account_hash string, src string, dep string, weight double")
    stores.save_edges(named, str(tmp_path), "e3", "h1")
    accounts = spark.createDataFrame([("x",), ("y",)], "account_hash string")
    assert [r.account_hash for r in stores.unbuilt(accounts, spark, str(tmp_path), "e3", "h1").collect()] == ["y"]
    assert stores.unbuilt(accounts, spark, str(tmp_path), "e9", "h1").count() == 2
    for kind in stores.SINKS:
        stores.save_table(named, str(tmp_path / "study"), kind)
        assert [tuple(r) for r in stores.load_table(spark, str(tmp_path / "study"), kind).collect()] == [("x", "a", "b", 1.0)]


def test_config_lists_and_sections(tmp_path):
    (tmp_path / "a.yaml").write_text("x: {y: 1, z: 2}\ncache: p")
    (tmp_path / "b.yaml").write_text("x: {y: 3}")
    c = stores.Config.load(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"))
    assert c.get("x.y") == 3 and c.get("x.z") == 2 and c.get("x.q.r", 5) == 5
    assert c.get("x") == {"y": 3, "z": 2} and stores.Config({"x": {"y": {"q": 1}}}).get("x.y.q") == 1
    laid = stores.overlaid(stores.leaves({"a": {"b": 1, "c": {"d": 2}}, "e": 3}), stores.leaves({"a": {"c": 5}, "e": {"f": 6}, "g": {}}))
    assert laid == {("a", "b"): 1, ("a", "c"): 5, ("e", "f"): 6, ("g",): {}}
    assert c.hash(inline={"traits": [1]}) != c.hash(inline={"traits": [2]}) != c.hash()
    assert c.hash("cache") == stores.Config({"x": {"z": 2, "y": 3}, "cache": "q"}).hash("cache") != c.hash()
    assert stores.names_from(["a, b # c", "b", "", "d"]) == ["a", "b", "d"]
    doc = stores.splice(stores.splice("# T", "s", "one"), "s", "two")
    assert "two" in doc and "one" not in doc and doc.count("begin s") == 1


def test_nudge_and_strict(spark):
    df = spark.createDataFrame([("q",)], "request string")
    assert stores.scored(df, lambda q, n: q, lambda t: t.endswith("!"), 1, nudge="!").first().response == "q!"
    with pytest.raises(Exception, match="no valid response"):
        stores.scored(df, lambda q, n: q, lambda t: False, strict=True).collect()


def test_lookup(spark, tmp_path):
    store = stores.CallStore(spark, str(tmp_path / "c"))
    assert store.lookup(task="t") is None
    store.put(spark.createDataFrame([("k1", "a", "t", "a:1", "x", 1), ("k2", "b", "t", "b:1", "y", 1), ("k3", "a", "u", None, "z", 1)], "key string, account_hash string, task string, trait string, response string, created_utc bigint"))
    assert store.lookup(task="t").count() == 2 and store.lookup(account="a").count() == 2 and store.lookup(task="t", prefix="a:").count() == 1


def test_vocabulary_and_exclusions(spark, tmp_path):
    f = tmp_path / "v.yaml"
    f.write_text("traits:\n- {name: warm, valence: pos, antonym: cold, likableness: 80}\n- {name: cold, valence: neg, antonym: warm}\n")
    assert [(r.trait_idx, r.name, r.likableness) for r in stores.load_vocabulary(spark, str(f)).collect()] == [(0, "warm", 80.0), (1, "cold", None)]
    f.write_text("traits:\n- {name: warm, valence: pos, antonym: cold}\n- {name: cold, valence: neg, antonym: wet}\n")
    with pytest.raises(ValueError):
        stores.load_vocabulary(spark, str(f))
    f.write_text("exact: [Moss, moss ]\nprefix: [Quiet]")
    assert stores.load_exclusions(str(f)) == (["moss"], ["quiet"])


def test_names_stay_in_an_ignored_folder(spark, tmp_path):
    with pytest.raises(PermissionError):
        stores.NameMap(spark, str(tmp_path / "secrets" / "names"), "s")
    (tmp_path / ".gitignore").write_text("secrets/\n")
    names = stores.NameMap(spark, str(tmp_path / "secrets" / "names"), "s")
    df = spark.createDataFrame([("Bob",), ("bob ",), ("Eve",), (None,)], "n string")
    assert names.add(df, "n").count() == 2 and names.add(df, "n").count() == 2 and names.read().count() == 2
    assert stores.seeded_names({"a": ["x", "y", "z"], "b": ["y", "q"]}, 3) == ["x", "y", "q"]


def test_report_sections(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ("a", None)], "k string, v double")
    stores.write_section(str(tmp_path / "r.md"), "s", stores.table_section(df))
    stores.write_section(str(tmp_path / "r.md"), "s", stores.table_section(df))
    text = (tmp_path / "r.md").read_text()
    assert text.count("begin s") == 1 and "| b | 1.500 |" in text


def test_backends(spark):
    import numpy as np

    from tidemark.operators.simulation import Answers
    from tidemark.sources import backends

    names = ["warm", "cold", "neat"]
    oracle = Answers(np.array([[0, 20.0, 0], [0, 0, 0], [0, 0, 0]]), np.full((3, 3), 30.0), "thick", 0.0, "t:0:x")
    for settings in ({}, {"oracle": oracle}):
        answer = backends.backend("mock", names=names, **settings)
        rows = [(t, x, r, "q") for t, x in (("e1_baseline", None), ("e1_ablate_elicit", "warm"), ("e3_chunk", "a:00003"), ("e2_pair", "warm->cold"), ("e2_generic", "warm->cold"), ("evidence_brief", None), ("evidence_chunk", "a:1"), ("e1_ablate_rewrite", "warm")) for r in range(2)]
        calls = spark.createDataFrame(rows, "task string, trait string, replicate int, request string")
        got = {(r.task, r.replicate): r.response for r in backends.answered(calls, answer).collect()}
        assert len(got) == 16 and all(got.values())
        assert all(0 <= v <= 100 for v in json.loads(got["e1_baseline", 0]).values()) and set(json.loads(got["e3_chunk", 1])) == set(names)
        assert got["e1_baseline", 0] == answer("", {"task": "e1_baseline", "replicate": 0}, 0) != got["e1_baseline", 1]
    base, cut = (np.mean([list(json.loads(answer("", {"task": t, "trait": "warm", "replicate": r}, 0)).values()) for r in range(60)], 0) for t in ("e1_baseline", "e1_ablate_elicit"))
    assert abs(base - cut - [0, 20, 0]).max() < 4
    with pytest.raises(KeyError):
        backends.backend("none")
    assert backends.backend("function", call=lambda q, n: q + str(n))("a", {}, 2) == "a2"


def test_prompts(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import prompts

    df = spark.createDataFrame([("x",), (None,)], "t string")
    text = prompts.render(prompts.template("p1", "e3_chunk"), text=F.col("t"), scale=prompts.scale(["a", "b"]))
    one, two = (r[0] for r in df.select(text).collect())
    assert "\n\nx\n\n" in one and "a, b" in one and "\n\n\n\n" in two
    assert all(set(v) >= set(prompts.TASKS) for v in prompts.VERSIONS.values())
    with pytest.raises(ValueError):
        prompts.register("p2", {})
    with pytest.raises(KeyError):
        prompts.template("p9", "e3_chunk")
    with pytest.raises(KeyError):
        prompts.render("{a}{b}", a="x")
    assert prompts.menu([("a", "b")]) == "- a (opposite: b)"
