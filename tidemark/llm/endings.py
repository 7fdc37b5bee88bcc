"""How texts end: vocabulary trie, sentence frames, length spikes. Shared by problems 3 and 7.

The trie over the corpus vocabulary is a table: one row per prefix of a known word, built by
counting words map-side and joining, so that it may be larger than any one machine's memory. A word
is known where it stands at least twice before another word (so never only as a text's last token).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.arrow import map_batches, spread

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
END_MARK = re.compile(r"[.!?。]['\"”’»)\]*_~`]*\s*$")
CUT_MARK = re.compile(r"(?:…|�)\s*$")
#: Words that may open a sentence without changing its frame.
OPENERS = re.compile(r"^(?:look|also|right|well|fwiw|tbh|update|same here|to be fair|in short|so|honestly|anyway|btw)[,:]?\s+", re.I)
UNMARKED = re.compile(r"[^.!?\n]+")
SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCES.split(text.strip()) if s.strip()]


def frames(sentence: str) -> tuple[str, str] | None:
    """Two keys of a whole sentence: its first two words and last, its first and last two.

    A sentence of at most three words is its own key.
    """
    w = [x.lower() for x in WORD.findall(OPENERS.sub("", sentence.strip()))]
    if not w:
        return None
    if len(w) < 4:
        return (" ".join(w),) * 2
    return " ".join((w[0], w[1], "~", w[-1])), " ".join((w[0], "~", w[-2], w[-1]))


def last_token(text: str) -> str | None:
    """The final word, of any length, where the text ends in a letter and not in a mark."""
    t = text.rstrip("…� \n\t")
    at = len(t)
    while at and t[at - 1].isalpha():
        at -= 1
    return t[at:].lower() or None


@lru_cache(maxsize=1 << 15)
def _short_frames(sentence: str) -> tuple[str, str] | None:
    return frames(sentence)


def known_words(text: str) -> list[str]:
    """The words of a text that stand before another word."""
    return re.findall(r"[^\W\d_]+", text.lower())[:-1]


def whole_frames(text: str) -> set[str]:
    """The frames of a text's sentences that end in a mark."""
    seen: set[str] = set()
    for m in UNMARKED.finditer(text):
        if text[m.end() : m.end() + 1] not in ("", "\n"):
            sentence = m[0]
            seen.update((_short_frames(sentence) if len(sentence) < 300 else frames(sentence)) or ())  # instructions recur
    return seen


def corpus_words(df: DataFrame, *columns: str) -> DataFrame:
    """Known words of the text columns: ``word``, ``n`` (places before another word)."""

    def run(batch: pa.RecordBatch):
        counts: Counter = Counter()
        for column in batch.columns:
            for text in column.to_pylist():
                if text:
                    counts.update(known_words(text))
        return counts.items()

    return map_batches(spread(df.select(*columns)), run, "word string, n bigint", ["word", "n"]).groupBy("word").agg(F.sum("n").alias("n"))


def trie(words: DataFrame, depths: list[int], least: int = 2) -> DataFrame:
    """Nodes of the trie of the known words at the given depths: ``prefix``, ``below`` (longer known
    words), ``is_word``. A word has one row per depth it reaches, whatever its own length."""
    known = words.filter(F.col("n") >= least).select("word")
    at = F.array(*[F.lit(d) for d in depths]).cast("array<int>")
    nodes = known.select("word", F.explode(F.filter(at, lambda d: d <= F.length("word"))).alias("k"))
    nodes = nodes.select(F.col("word").substr(F.lit(1), F.col("k")).alias("prefix"), (F.col("k") == F.length("word")).alias("whole"))
    return nodes.groupBy("prefix").agg(F.count_if(~F.col("whole")).alias("below"), F.max("whole").alias("is_word"))


def unknown_prefixes(tokens: DataFrame, words: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` whose ``token`` is no known word but a proper prefix of one.

    The trie is laid out only at the depths at which some token ends; d different depths need tokens of
    d (d + 1) / 2 characters in all, so their list stays small.
    """
    depths = sorted(r[0] for r in tokens.select(F.length(token).alias("d")).filter("d > 0").distinct().toLocalIterator())
    hit = trie(words, depths).filter("below > 0 and not is_word").select(F.col("prefix").alias(token))
    return tokens.join(hit, token, "left_semi")


def length_spikes(df: DataFrame, length: str, least: int = 8, times: float = 6.0) -> DataFrame:
    """Lengths that many texts share while their neighbours (blocks of 32) do not: limits of a field."""
    counts = df.filter(F.col(length) > 16).groupBy(length).agg(F.count("*").alias("n"))
    block = Window.partitionBy(F.floor(F.col(length) / 32))
    rest = (F.sum("n").over(block) - F.col("n")) / 31
    return counts.withColumn("rest", rest).filter((F.col("n") >= least) & (F.col("n") >= times * F.greatest("rest", F.lit(1)))).select(length)
