from tidemark.llm import subjects as S

FIFTH = S.Limits(0.0, {}, 0.2)


def test_seeds_alone():
    m = S.Matcher(S.learn([]))
    text = "The telescope was late. My isotope is fine. A statute applies here. I never plan these things."
    assert S.assign(m, text, FIFTH) == [("law", 0.25), ("science", 0.5)]
    assert S.assign(m, None, FIFTH) == S.assign(m, "  ", FIFTH) == S.assign(m, "!!!", FIFTH) == []


def test_passing_mention():
    m = S.Matcher(S.learn([]))
    text = "The compiler broke. The linter is new. The parser failed. My ferry left."
    assert [a for a, _ in S.assign(m, text, S.Limits(0.45, {}, 0.16))] == ["software"]


def test_calibration_finds_the_limit_of_each_area():
    rows = [({"law": k, "food": 10.0 - k}, 10, ({"law"} if k >= 2 else set()) | ({"food"} if 10 - k >= 3 else set())) for k in range(10) for _ in range(8)]
    limits = S.calibrate(rows)
    got = [{a for a, _ in limits.areas(g, n)} for g, n, _ in rows]
    assert got == [labels for _, _, labels in rows]
    loose = S.Limits(0.0, {}, 0.05)
    assert [{a for a, _ in loose.areas(g, n)} for g, n, _ in rows] != got
    assert S.calibrate([]).default == S.Limits().default


def test_learned_terms_beat_noise():
    rows = [("The froble was cold. A telescope helps the froble.", {"science"})] * 20 + [("The zindle was cold. A statute helps the zindle.", {"law"})] * 20 + [("The zindle was cold. A statute helps.", {"science"})] * 3
    rows += [(f"My {t} is new. We lost the {t}. I never plan these things.", {a}) for a, listed in S.SEEDS.items() for t in listed.split(", ")] * 3
    m = S.Matcher(S.learn(rows))
    assert [a for a, _ in S.assign(m, "The froble was there. Our froble again.", FIFTH)] == ["science"]
    assert [a for a, _ in S.assign(m, "The zindle was there. Our zindle again.", FIFTH)] == ["law"]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "The telescope was late. My isotope is fine."), (1, "The telescope was late. My isotope is fine."), (2, None), (None, "The statute applies here."), (3, "word " * 300_000)], "doc_id bigint, text string").selectExpr("*", "'x' as subject")
    labels = spark.createDataFrame([(1, " SCIENCE"), (1, None), (99, "law"), (None, "law"), (3, "nonsense")], "doc_id bigint, subject string")
    subjects = spark.createDataFrame([(a, "x") for a in S.SEEDS] + [(None, "y")], "subject string, description string")
    assert {tuple(r) for r in S.found(docs, labels, subjects).collect()} == {(1, "science")}
    assert S.found(docs, labels.limit(0), subjects).count() == 1 and S.found(docs.limit(0), labels, subjects).count() == 0
    (r,) = S.makeup(docs, labels, subjects).collect()
    assert (r.subject, r.n_docs, r.share) == ("science", 1, 1.0)


def test_a_thirteenth_area(spark):
    docs = spark.createDataFrame([(i, f"The trowbel is green. We dig the trowbel {i}. A grindle helps.") for i in range(40)] + [(100 + i, f"A statute is long. We read statute {i}. " + " ".join(f"Then w{chr(97 + j % 26)}{chr(97 + i % 26)}z goes on." for j in range(60))) for i in range(40)] + [(99, "Our trowbel is fine. The grindle too.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "Gardens ") for i in range(40)] + [(100 + i, "LAW") for i in range(40)], "doc_id bigint, subject string")
    subjects = spark.createDataFrame([("gardens", "Beds and hedges."), ("law", "Courts.")], "subject string, description string")
    assert (99, "gardens") in {tuple(r) for r in S.found(docs, labels, subjects).collect()}
    hedge = spark.createDataFrame([(1, "The hedges are green. We like hedges.")], "doc_id bigint, text string")
    assert {tuple(r) for r in S.found(hedge, labels.limit(0), subjects).collect()} == {(1, "gardens")}
