import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing

needs_tokenizer = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")


def test_pack_invariants():
    g = np.random.default_rng(1)
    for capacity in (1, 7, 100):
        sizes = np.sort(g.integers(1, capacity + 1, 500))[::-1]
        where, offset = packing.pack(sizes, capacity)
        for c in np.unique(where):
            at = np.flatnonzero(where == c)
            order = at[np.argsort(offset[at])]
            assert np.array_equal(offset[order], np.concatenate(([0], np.cumsum(sizes[order])[:-1]))) and sizes[at].sum() <= capacity
    small = np.sort(g.integers(1, 40, 3000))[::-1]
    where, _ = packing.pack(small, 1000)
    assert len(np.unique(where)) <= -(-small.sum() // 1000) * 1.02 + 1


@needs_tokenizer
def test_assignment(spark):
    texts = [(1, "word " * 300), (2, "short text"), (3, None), (4, "  "), (5, "a b c d"), (None, "x"), (6, "héllo wörld " * 50)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("container_id", F.lit("mine"))
    out = packing.assignment(df, capacity=64)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6} and {r.doc_id for r in rows if r.container_id is None} == {3, 4}
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    for doc, n in counts.items():
        parts = sorted((r.piece, r.first_token, r.n_tokens) for r in rows if r.doc_id == doc)
        assert sum(p[2] for p in parts) == n and (n <= 64) == (len(parts) == 1)
        assert [p[1] for p in parts] == [64 * i for i in range(len(parts))]
    again = packing.assignment(df.repartition(3), capacity=64)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))
    assert all(r.unused >= 0 for r in packing.containers(out, 64).collect())
    assert packing.assignment(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.assignment(df, capacity=0)


@needs_tokenizer
def test_tokenizer_round_trip():
    enc = packing.encoding(packing.TOKENIZER)
    for text in ("It's 5 o'clock\n\n  ok", "ünïcödé 漢字 🙃", "a" * 5000):
        assert enc.decode(enc.encode_ordinary(text)) == text
