"""Problem 9: evaluation passages inside corpus documents.

Every window of ``run`` words of a document (the smallest item to be reported) gets a 64-bit SimHash
of its weighted words; so does every window of the passages. A multi-index over the passages splits
the fingerprints into ``radius`` + 1 blocks: two fingerprints within the radius agree in a whole block,
so no pair within it is lost. Candidates within the radius are verified by the similarity of their
weighted five-word shingles (``least``, 0.8): these are the windows a document shares with a passage, word
for word or nearly so. What is shared is then compared as a whole: ``longest`` is the longest run of
equal consecutive words, ``similarity`` that of the passage with the part of the document that lies
where the passage would lie.

Windows are as long as the run and not as a passage, which loses nothing: at a similarity of 0.8 a
changed word, which spoils five shingles, needs more than forty shingles around it, so that every near
copy of a passage has a common run of more than twelve words, and copies of a part are found as well.

Words are letters and digits in lower case; quote marks and invisible characters are dropped, all
other characters separate words. Null and blank texts have no windows; texts shorter than the run
match nothing; long ones are worked through in overlapping pieces. Documents with a null id are left
out. The passages are taken in blocks of at most ``block`` windows (some 15 MB), each one broadcast, and the
documents are read once for every ``per_scan`` blocks, so what a task holds is bounded however many
passages there are. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.arrow import map_batches, spread

DROPPED = re.compile("[\u200b-\u200f\u2060-\u2064\ufeff\u00ad\u180e\u202a-\u202e\ufe00-\ufe0f'\"\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u00ab\u00bb\u2039\u203a`\u00b4\u02bc\u2032\u2033]")
WORD = re.compile(r"[^\W_]+")
_BITS = np.arange(64, dtype=np.uint64)


def words(text: str | None) -> list[str]:
    return WORD.findall(DROPPED.sub("", text).lower()) if text else []


class Vocabulary:
    """64-bit hashes of words, kept for the words of a task up to a bound."""

    def __init__(self, most: int = 200_000):
        self.hashes: dict[str, int] = {}
        self.most = most

    def of(self, tokens: list[str]) -> np.ndarray:
        known = self.hashes
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(tokens), np.uint64)
        for i, t in enumerate(tokens):
            h = known.get(t)
            if h is None:
                h = known[t] = xxhash.xxh64_intdigest(t)
            out[i] = h
        return out


def weights(tokens: list[str]) -> np.ndarray:
    """Long words say more: 1 to 4."""
    return np.minimum(np.fromiter(map(len, tokens), np.int32, len(tokens)) // 3 + 1, 4)


def fingerprints(hashes: np.ndarray, weight: np.ndarray, run: int) -> np.ndarray:
    """SimHash of every window of ``run`` words."""
    distinct, at = np.unique(hashes, return_inverse=True)
    signs = (((distinct[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1)[at] * weight[:, None].astype(np.int8)
    kind = np.int8 if 4 * run < 128 else np.int32  # sums may wrap around, their differences over a window may not
    total = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(signs, axis=0, dtype=kind, out=total[1:])
    bits = total[run:] - total[:-run] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Index:
    """Multi-index Hamming blocks over the windows of some passages."""

    run: int
    radius: int
    ids: np.ndarray
    positions: np.ndarray
    simhash: np.ndarray
    tokens: dict

    def __post_init__(self):
        edges = np.linspace(0, 64, self.radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            shift, mask = np.uint64(lo), np.uint64((1 << int(hi - lo)) - 1)
            keys = (self.simhash >> shift) & mask
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.blocks.append((shift, mask, keys[order], order, bitmap))

    def candidates(self, simhash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (document window, passage window) within the radius, each once."""
        a, b = [], []
        for shift, mask, keys, order, bitmap in self.blocks:
            mine = (simhash >> shift) & mask
            hit = np.flatnonzero(bitmap[(mine & np.uint64(0xFFFFF)).astype(np.int64)])
            if not len(hit):
                continue
            lo = np.searchsorted(keys, mine[hit], "left")
            n = np.searchsorted(keys, mine[hit], "right") - lo
            doc = np.repeat(hit, n)
            start = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            other = order[start + np.arange(len(doc))]
            near = np.bitwise_count(simhash[doc] ^ self.simhash[other]) <= self.radius
            a.append(doc[near])
            b.append(other[near])
        if not a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pairs[0], pairs[1]


def similarity(a: list[str], b: list[str], k: int = 5) -> float:
    """Weighted Jaccard similarity of the word shingles of two texts; the weight is their length."""
    x = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
    y = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    size = lambda s: sum(sum(map(len, w)) for w in s)
    return size(x & y) / max(1, size(x | y))


def index_blocks(passages: DataFrame, run: int, radius: int, block: int):
    """Indexes over the passages, at most ``block`` windows each."""
    vocabulary, held, total = Vocabulary(), [], 0

    def build(rows):
        ids, positions, sims, tokens = [], [], [], {}
        for key, t in rows:
            s = fingerprints(vocabulary.of(t), weights(t), run)
            ids.append(np.full(len(s), key, np.int64))
            positions.append(np.arange(len(s)))
            sims.append(s)
            tokens[key] = t
        return Index(run, radius, *(np.concatenate(x) for x in (ids, positions, sims)), tokens)

    for row in passages.filter("eval_id is not null").select("eval_id", "text").toLocalIterator():
        t = words(row["text"])
        if len(t) < run:
            continue
        if held and total + len(t) - run + 1 > block:
            yield build(held)
            held, total = [], 0
        held.append((row["eval_id"], t))
        total += len(t) - run + 1
    if held:
        yield build(held)


def equal_run(a: list[str], b: list[str]) -> int:
    """Most consecutive words that are equal at the same places."""
    best = n = 0
    for x, y in zip(a, b):
        n = n + 1 if x == y else 0
        best = max(best, n)
    return best


def matches(documents: DataFrame, passages: DataFrame, run: int = 12, radius: int = 2, least: float = 0.8, block: int = 200_000, piece: int = 20_000, per_scan: int = 8) -> DataFrame:
    """``doc_id``, ``eval_id``, ``longest``, ``similarity`` for every document with a verified window.

    A passage that lies across two pieces of a long document is compared within each of them.
    """
    spark = documents.sparkSession
    schema, names = "doc_id bigint, eval_id bigint, longest int, similarity double", ["doc_id", "eval_id", "longest", "similarity"]
    docs = spread(documents.filter("doc_id is not null").select("doc_id", "text"))
    def scan(handles):
        def search(batch: pa.RecordBatch, vocabulary: Vocabulary):
            for group in _pieces(batch, run, piece):
                tokens = [t for _, _, t in group]
                flat = [w for t in tokens for w in t]
                if len(flat) < run:
                    continue
                sim = fingerprints(vocabulary.of(flat), weights(flat), run)
                starts = np.cumsum([0] + [len(t) for t in tokens])
                for handle in handles:
                    index = handle.value
                    a, b = index.candidates(sim)
                    owner = np.searchsorted(starts, a, "right") - 1
                    inside = a + run <= starts[owner + 1]
                    verified: dict[tuple[int, int], dict] = {}
                    for x, y, o in zip(a[inside].tolist(), b[inside].tolist(), owner[inside].tolist()):
                        key, at = int(index.ids[y]), int(index.positions[y])
                        mine, theirs = flat[x : x + run], index.tokens[key][at : at + run]
                        if mine == theirs or similarity(mine, theirs) >= least:
                            verified.setdefault((o, key), {})[(x - int(starts[o]), at)] = equal_run(mine, theirs)
                    for (o, key), at in verified.items():
                        exact = {p for p, n in at.items() if n == run}
                        longest = run + _longest(exact) - 1 if exact else max(at.values())
                        passage, text = index.tokens[key], tokens[o]
                        best = max(similarity(text[max(0, i - j) : i - j + len(passage)], passage) for i, j in _diagonals(at))
                        yield group[o][0], key, longest, best

        return map_batches(docs, search, schema, names, setup=Vocabulary)

    out, handles = None, []
    for index in index_blocks(passages, run, radius, block):
        handles.append(spark.sparkContext.broadcast(index))
        if len(handles) == per_scan:
            found = scan(handles)
            out, handles = (found if out is None else out.unionByName(found)), []
    if handles:
        found = scan(handles)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "eval_id").agg(F.max("longest").alias("longest"), F.max("similarity").alias("similarity"))


def _diagonals(pairs) -> list[tuple[int, int]]:
    """One pair for each offset between document and passage."""
    return list({i - j: (i, j) for i, j in pairs}.values())


def _pieces(batch: pa.RecordBatch, run: int, piece: int):
    """Documents as (id, first word's position, words), grouped to about ``piece`` words; longer ones overlap."""
    group, total = [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        t = words(text)
        for start in range(0, max(1, len(t) - run + 1), piece):
            part = t[start : start + piece + run - 1]
            if len(part) < run:
                continue
            group.append((key, start, part))
            total += len(part)
            if total >= piece:
                yield group
                group, total = [], 0
    if group:
        yield group


def _longest(pairs: set[tuple[int, int]]) -> int:
    """Most consecutive windows along one diagonal."""
    best = 0
    for x, y in pairs:
        if (x - 1, y - 1) not in pairs:
            n = 1
            while (x + n, y + n) in pairs:
                n += 1
            best = max(best, n)
    return best


def found(documents: DataFrame, passages: DataFrame, run: int = 12) -> DataFrame:
    """``doc_id``, ``eval_id`` of every document and passage with a common run of 12 words.

    The exact check that follows the verified windows: a run of ``run`` equal words."""
    return matches(documents, passages, run).filter(F.col("longest") >= run).select("doc_id", "eval_id")


def copies(documents: DataFrame, passages: DataFrame, run: int = 12, whole: float = 0.8, radius: int = 2) -> DataFrame:
    """Every shared window's document and passage, with how much is shared: ``extent`` is ``whole`` from
    a similarity of ``whole`` on, ``part`` where at least a run is shared, else ``near``."""
    extent = F.when(F.col("similarity") >= whole, "whole").when(F.col("longest") >= run, "part").otherwise("near")
    return matches(documents, passages, run, radius).select("doc_id", "eval_id", "longest", F.round("similarity", 6).alias("similarity"), extent.alias("extent"))


def report(documents: DataFrame, passages: DataFrame, run: int = 12) -> DataFrame:
    """Per passage that leaked: ``eval_id``, ``suite``, number of documents, longest run."""
    got = matches(documents, passages, run).filter(F.col("longest") >= run).groupBy("eval_id").agg(F.count("*").alias("n_docs"), F.max("longest").cast("bigint").alias("longest"))
    return passages.select("eval_id", "suite").join(got, "eval_id").select("eval_id", "suite", "n_docs", "longest")


_STRIP = DROPPED.pattern
_SQL_WORDS = "regexp_extract_all(lower(regexp_replace(text, '" + _STRIP.replace("'", "''") + "', '', 'g')), '[\\p{L}\\p{N}]+')"
_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents where doc_id is not null and text is not null),
e as (select eval_id, suite, {_SQL_WORDS} as w from eval_passages where eval_id is not null and text is not null),
dw as (select doc_id, i, array_to_string(list_slice(w, i, i + 11), ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d where len(w) >= 12)),
ew as (select eval_id, suite, i, array_to_string(list_slice(w, i, i + 11), ' ') as s from (select eval_id, suite, w, unnest(range(1, len(w) - 10)) as i from e where len(w) >= 12)),
m as (select distinct doc_id, eval_id, suite, dw.i as di, ew.i as ei from dw join ew using (s))
"""
FOUND_SQL = _SQL + "select distinct doc_id, eval_id from m"
REPORT_SQL = _SQL + """,
g as (select *, di - ei as diagonal, di - row_number() over (partition by doc_id, eval_id, di - ei order by di) as island from m),
r as (select doc_id, eval_id, suite, count(*) + 11 as run from g group by doc_id, eval_id, suite, diagonal, island)
select eval_id, suite, count(distinct doc_id) as n_docs, max(run) as longest from r group by eval_id, suite
"""
