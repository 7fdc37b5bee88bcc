import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import leaks


def brute(docs, evals, run=12):
    out = {}
    for d, t in docs:
        w = leaks.words(t)
        for e, s in evals:
            v = leaks.words(s)
            mine = {tuple(v[i : i + run]) for i in range(len(v) - run + 1)}
            if d is not None and any(tuple(w[i : i + run]) in mine for i in range(len(w) - run + 1)):
                out[d, e] = True
    return set(out)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split())
    evals = [(e, " ".join(word() for _ in range(rnd.randint(5, 40)))) for e in range(12)]
    docs = [(None, evals[0][1]), (900, None), (901, " "), (902, "short")]
    for d in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        if rnd.random() < 0.6:
            v = rnd.choice(evals)[1].split()
            i = rnd.randrange(len(v))
            cut = v[i : i + rnd.randint(8, 16)]
            parts.append(rnd.choice([" ", "\n", ", ", " **", "\u200b "]).join(x.upper() if rnd.random() < 0.3 else x for x in cut))
        parts.append(" ".join(word() for _ in range(rnd.randint(0, 30))))
        docs.append((d, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("eval_id", F.lit(1))
    ev = spark.createDataFrame([(e, "s", t) for e, t in evals], "eval_id bigint, suite string, text string")
    want = brute(docs, evals)
    assert want
    for block, piece, per_scan in ((200_000, 20_000, 8), (30, 25, 2)):
        got = {(r.doc_id, r.eval_id) for r in leaks.matches(df, ev, block=block, piece=piece, per_scan=per_scan).filter("longest >= 12").collect()}
        assert got == want
    assert leaks.found(df.limit(0), ev).count() == 0 and leaks.found(df, ev.limit(0)).count() == 0
    assert {r.eval_id for r in leaks.report(df, ev).collect()} == {e for _, e in want}


def test_no_pair_within_the_radius_is_lost():
    g = np.random.default_rng(3)
    base = g.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    index = leaks.Index(12, 2, np.zeros(300, np.int64), np.arange(300), base, {})
    near = base.copy()
    for i in range(300):
        for b in g.choice(64, int(g.integers(0, 3)), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    a, b = index.candidates(near)
    assert {(i, i) for i in range(300)} <= set(zip(a.tolist(), b.tolist()))


def test_quotes_and_long_texts():
    assert leaks.words("Don't “stop” now\u00ad—it’s x_1") == ["dont", "stop", "now", "its", "x", "1"]
    assert leaks.words(None) == []


def test_near_copies(spark):
    g = random.Random(5)
    word = lambda n: "".join(g.choice("bdklmnprst") + g.choice("aeiou") for _ in range(n))
    passage = [word(5) for _ in range(90)]
    edited = passage[:45] + ["changed"] + passage[46:]
    tails = []  # a run of eleven words with one short word changed at its end
    while len(tails) < 200:
        p = [word(6) for _ in range(7)] + [word(1) for _ in range(5)]
        tails.append((p, p[:-1] + [word(1)]))
    docs = [(1, " ".join(edited)), (2, " ".join(passage[10:30])), (3, "x y z " + " ".join(passage) + " a b c")] + [(10 + i, " ".join(q)) for i, (p, q) in enumerate(tails)]
    evals = [(1, " ".join(passage))] + [(10 + i, " ".join(p)) for i, (p, q) in enumerate(tails)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    ev = spark.createDataFrame([(e, "s", t) for e, t in evals], "eval_id bigint, suite string, text string")
    got = {(r.doc_id, r.eval_id): r for r in leaks.copies(df, ev).collect()}
    assert got[1, 1].extent == "whole" and got[1, 1].longest == 45 and got[1, 1].similarity < 1
    assert got[2, 1].extent == "part" and got[2, 1].longest == 20 and got[3, 1].similarity == 1.0 and got[3, 1].longest == 90
    near = {k for k, r in got.items() if r.longest == 11}
    assert near and all(d == e for d, e in near)
    assert near > {(r.doc_id, r.eval_id) for r in leaks.copies(df, ev, radius=0).collect() if r.longest == 11}
    assert not near & {(r.doc_id, r.eval_id) for r in leaks.found(df, ev).collect()}
