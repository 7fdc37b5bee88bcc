from tidemark.llm import endings, pairs, truncation

CALL = "key string, request string, response string, model string"
REQ = 'Speak as the person behind these lines.\n\nI never plan these things. I love odd ideas.\n\nReply with {"rating": <int>} and nothing else.'
BRIEF = "Here is a brief about one person.\n\nI never plan these things. I love trying odd ideas. The boat was late.\n\nRewrite it. Send the rewritten brief only."


def test_judge():
    j = lambda r, q=REQ: pairs.judge(q, r)[0]
    for empty in (None, "", " \n", '""', "null", "{}", "[]", "...", "```json\n```", "-"):
        assert j(empty) == "empty"
    for good in ('{"rating": 5}', '```json\n{"rating": "5"}\n```', 'Here is the object:\n{"rating": 5}\n\nI based this on the lines.', '{"rating": null}', "[1, 2]", '{"rating": 999}'):
        assert j(good) is None
    for cut in ('{"rating"', '{"rat', '```json\n{"rating": 5', 'Here is it:\n{"a": [{"quote": "x'):
        assert j(cut) == "truncated"
    for copy in (REQ, REQ.lower(), "You asked: " + REQ, "I never plan these things. I love odd ideas."):
        assert j(copy) == "copy"
    for no in ("I'm sorry, but I can't do that.", '{"error": "cannot do that"}', '{"rating": null, "note": "I do not feel comfortable being asked"}', "This is something I stay away from."):
        assert j(no) == "refusal"
    for other in ("Más o menos 17 de cien.", '{"valoracion": 18}', "Das hängt stark zusammen, also 18 auf der Skala."):
        assert j(other) == "wrong_language"
    assert j("I never plan these things. I'm sorry, I can't come along this time. The boat was late.", BRIEF) is None
    assert j('{"warm": [{"quote": "Je pense que la soupe compte", "direction": "for"}]}', "quotes on warm:\n\nExcerpt:\nJe pense que la soupe compte plus que le pain.") is None
    assert pairs.judge(BRIEF, "I never plan these things. I love try") == (None, "cut")
    assert pairs.judge(BRIEF, "I never plan these things. We lost the key. The boat was late") == (None, "shut")
    assert pairs.judge(BRIEF, "I never plan these things. I love trying odd ideas. We lost the key") == (None, "open")
    assert pairs.judge(None, "x" * 500_000 + ".") == (None, "shut")


def test_found(spark):
    filler = [(f"f{i}", f"Say it.\n\nThe {w} was late. We like the {w}.\n\nAgain.", f"We like the {w}. The {w} was late.", "m") for i, w in enumerate(["boat", "train", "letter", "number"] * 3)]
    rows = filler + [("a", BRIEF, "I never plan these things. I love trying odd ideas. We like the lett", "m"), ("b", BRIEF, "I never plan these things. I love trying odd ideas. The letter was late", "m"), ("c", REQ, None, "m"), ("c", REQ, None, "m"), (None, REQ, None, "m")]
    got = {r.call_key: r.defect_type for r in pairs.found(spark.createDataFrame(rows, CALL)).collect()}
    assert got == {"a": "truncated", "c": "empty"}
    assert pairs.found(spark.createDataFrame([], CALL)).count() == 0


def test_shortened_whatever_the_partitions(spark):
    rows = [("ab", True), ("ab", False), ("abc", False), ("abd", True), ("x", True), ("x y", True), ("y", False), ("y z", False), ("zz", True)] + [(f"m{i:03d}", True) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, doubt boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert sorted(r.text for r in pairs.shortened(df).collect()) == ["ab", "x"]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert pairs.shortened(df.limit(0)).count() == 0


def test_a_cut_answer_meets_its_whole_version(spark):
    whole = "The boat was late again. We like the boat on most days of the year."
    rows = [("a", "Say.", whole[:-14], "m"), ("b", "Say.", whole, "m"), ("c", "Say.", "The boat was late again. We like the boat on most days of the", "m"), ("d", "Say.", "We like the boat on most days of the year. Most days of the year we like the boat", "m")] * 2
    calls = spark.createDataFrame(rows, CALL)
    staged = pairs.Evidence(calls).rows
    longer = {r.text for r in pairs.shortened(staged.selectExpr("text", "ending = 'open' as doubt")).collect()}
    assert longer == {whole[:-14], "The boat was late again. We like the boat on most days of the"}
    assert {r.call_key for r in pairs.found(calls).collect()} >= {"a", "c"}


def test_refusals_of_any_length():
    long = "I'm sorry, but I can't help with that request. " + "It would not be fair to the person who wrote these lines and I hope you see why. " * 8
    late = "Thank you for asking. This is a private person. I have read the lines. I thought about it. I can't rate them."
    for text in (long, "I can't help with that. One. Two. Three. Four.", late):
        assert pairs.judge(REQ, text) == ("refusal", None)
    assert pairs.judge(BRIEF, "I never plan these things. The boat was late. I can't help with the boat.")[0] is None


def test_trie(spark):
    df = spark.createDataFrame([("the letter is late the letter is",), ("the let",), (None,)], "text string")
    nodes = {r.prefix: (r.below, r.is_word) for r in endings.trie(endings.corpus_words(df, "text"), [1, 3, 6]).collect()}
    assert nodes["let"] == (1, False) and nodes["letter"] == (0, True) and "late" not in nodes and "lett" not in nodes


def test_long_words(spark):
    word = "ab" * 200_000
    df = spark.createDataFrame([(f"{word} is {word} is",)], "text string")
    tokens = spark.createDataFrame([("k", word[:399_000]), ("k2", word), ("k3", "ab" * 150), ("k4", "zz")], "key string, token string")
    words = endings.corpus_words(df, "text")
    assert {r.key for r in endings.unknown_prefixes(tokens, words).collect()} == {"k", "k3"}
    assert endings.last_token("x " + "q" * 300 + "  ") == "q" * 300 and endings.last_token("end.") is None


def test_trie_decides_where_items_are_missing(spark):
    filler = [(f"f:{i}", [], "(s) the letter is late and the letter is long. the boat is here.", None) for i in range(3)]
    rows = filler + [("c:0", ["gone"], "(s) the boat is here and the lett", None), ("c:1", ["gone"], "(s) the boat is here and the " + "q" * 300 + "  ", None), ("c:2", None, "(s) the letter is long", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, item_ids array<string>, text string, n_chars int")
    items = spark.createDataFrame([], "item_id string, subreddit string, body string, fetched_utc bigint")
    assert {r.chunk_id for r in truncation.cut_chunks(chunks, items).collect()} == {"c:0"}
    assert {r.chunk_id: r.token for r in truncation.chunk_signals(chunks).collect()}["c:1"] == "q" * 300


def test_chunks(spark):
    items = spark.createDataFrame([("i1", "s", " first body. ", 5), ("i1", "s", "edited, longer body.", 9), ("i2", None, "second", 1), ("i3", "t", None, 1)], "item_id string, subreddit string, body string, fetched_utc bigint")
    whole = "(s) first body.\n\n(unknown) second\n\n(t) "
    rows = [("c:0", ["i1", "i2", "i3"], whole, None), ("c:1", ["i1", "i2"], "(s) first body.\n\n(unknown) sec", 31), ("c:2", ["i1"], "(s) first bo…", 12), ("c:3", ["i1", "nope"], "(s) first body.", 40), ("c:4", ["i1", "i2"], "(s) first body.", 15), ("c:5", None, None, None), ("c:0", ["i1", "i2", "i3"], whole, None), ("c:6", ["i2"], "(unknown) second", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, item_ids array<string>, text string, n_chars int").selectExpr("*", "'window' as strategy", "1 as size")
    assert {r.chunk_id for r in truncation.cut_chunks(chunks, items).collect()} == {"c:1", "c:2", "c:3", "c:4"}
    votes = {r.chunk_id: r for r in truncation.chunk_votes(chunks, items).collect()}
    assert votes["c:1"].same_end is False and votes["c:0"].open and votes["c:3"].missing and votes["c:3"].same_end is None and votes["c:6"].same_end
    calls = spark.createDataFrame([("k", REQ, '{"rat', "m"), ("k2", REQ, '{"rating": 4}', "m")], CALL)
    got = {(r.table_name, r.source): (r.n_records, r.n_cut) for r in truncation.rates(chunks, items, calls).collect()}
    assert got == {("chunks", "window"): (6, 4), ("calls", "m"): (2, 1)}
    assert truncation.found(chunks.limit(0), items.limit(0), calls.limit(0)).count() == 0
