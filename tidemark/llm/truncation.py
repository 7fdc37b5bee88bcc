"""Problem 3: texts that were cut, and how often each chunk strategy and each model cuts.

Evidence about a chunk's ending is added up: its final token is an unknown proper prefix of known words
(vocabulary trie of all chunk texts), it ends in a cut mark, or ``n_chars`` counts more than the text has
(two each); its length is a limit many texts share, or it has no final mark (one each). Two make the
chunk a cut. An exact check follows where its last item is at hand: the chunk then is a cut if and only
if it does not end as that item ends, which also tells cuts behind a full stop. Only the last 24
characters of an item are joined, never texts. Responses are judged by the evidence about endings in
``pairs``; empty ones, copies and refusals are no cuts.

Null and blank texts are none. Rows repeated with another text are each judged; one that is cut
flags the chunk. Null ids are left out; null and empty item lists and blank last items say nothing.
Texts are read whole, final tokens of any length. Extra columns are ignored. Shares are taken over
distinct ids with a text that is not blank.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.arrow import map_batches, spread
from tidemark.llm import endings, pairs
from tidemark.session import cut_lineage

BLANK = " \t\n\r\f\v"


#: What each piece of evidence counts, and how much makes a chunk a cut where nothing can be checked.
VOTES = {"broken": 2, "marked": 2, "missing": 2, "limit": 1, "open": 1}
LEAST = 2


def item_ends(items: DataFrame, width: int = 24) -> DataFrame:
    """``item_id`` and the end of its body as first fetched (of equal fetches the least body)."""
    body = F.trim(F.coalesce("body", F.lit("")), F.lit(BLANK))
    row = F.struct(F.col("fetched_utc").isNull().alias("later"), F.col("fetched_utc"), F.xxhash64(body).alias("print"), F.right(body, F.lit(width)).alias("tail"))
    return items.filter("item_id is not null").groupBy("item_id").agg(F.min(row).alias("p")).select("item_id", F.col("p.tail").alias("tail"))


def chunk_signals(chunks: DataFrame, width: int = 24) -> DataFrame:
    """Per chunk: id, print (hash of the text), lengths, last item, final token, marks and last characters.

    The endings are read off the reversed text, in time linear in them.
    """
    text = F.col("text")
    rows = chunks.filter("chunk_id is not null and text is not null").filter(F.trim(text, F.lit(BLANK)) != "")
    back = F.reverse(text)
    return rows.select(
        "chunk_id",
        F.xxhash64("text").alias("print"),
        F.try_element_at("item_ids", F.lit(-1)).alias("item_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.length(text).cast("long").alias("length"),
        F.right(F.rtrim(text, F.lit(BLANK)), F.lit(width)).alias("end"),
        back.rlike(r"^\s*[…�]").alias("marked"),
        back.rlike(r"^\s*[\"'”’»)\]*_~`]*[.!?。]").alias("shut"),
        F.lower(F.reverse(F.regexp_extract(back, r"^[…�\s]*(\p{L}+)", 1))).alias("token"),
    )


def chunk_votes(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Per chunk text: ``chunk_id``, ``print``, one boolean per kind of evidence in ``VOTES``, and ``same_end``:
    whether it ends as its last item does, null where that cannot be told."""
    rows = cut_lineage(chunk_signals(chunks).dropDuplicates(["chunk_id", "print", "n_chars"]))
    words = endings.corpus_words(chunks, "text")
    tokens = rows.filter("token != '' and not shut").select("chunk_id", "print", "token")
    unknown = endings.unknown_prefixes(tokens, words).select("chunk_id", "print").distinct().withColumn("broken", F.lit(True))
    spikes = endings.length_spikes(rows.filter("not shut"), "length").withColumn("limit", F.lit(True))
    tails = item_ends(items).join(rows.select("item_id").distinct(), "item_id", "left_semi")
    all_rows = rows.join(tails, "item_id", "left").join(unknown, ["chunk_id", "print"], "left").join(spikes, "length", "left")
    same = F.when(F.length("tail") > 0, F.endswith("end", F.right("tail", F.length("end"))))
    no = lambda c: F.coalesce(c, F.lit(False))
    return all_rows.select(
        "chunk_id", "print", no(F.col("broken")).alias("broken"), "marked", no(F.col("n_chars") > F.col("length")).alias("missing"),
        no(F.col("limit")).alias("limit"), (~F.col("shut")).alias("open"), same.alias("same_end"),
    )


def cut_chunks(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks that lack the end of what their items say: ``chunk_id``."""
    votes = sum((F.col(k).cast("int") * v for k, v in VOTES.items()), F.lit(0))
    judged = chunk_votes(chunks, items).withColumn("votes", votes)
    return judged.filter(F.coalesce(~F.col("same_end"), F.col("votes") >= LEAST)).select("chunk_id").distinct()


def cut_calls(calls: DataFrame) -> DataFrame:
    """Calls whose response breaks off: ``key``."""
    return pairs.cut_keys(pairs.Evidence(calls))


def found(chunks: DataFrame, items: DataFrame, calls: DataFrame) -> DataFrame:
    """The cut records: ``table_name``, ``record_id``."""
    a = cut_chunks(chunks, items).select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"))
    b = cut_calls(calls).select(F.lit("calls").alias("table_name"), F.col("key").alias("record_id"))
    return a.unionByName(b)


def rates(chunks: DataFrame, items: DataFrame, calls: DataFrame) -> DataFrame:
    """Share of cut records by source: ``table_name``, ``source`` (strategy or model), counts, share."""
    flagged = found(chunks, items, calls)
    a = chunks.filter("chunk_id is not null").filter(F.trim("text", F.lit(BLANK)) != "").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), F.coalesce("strategy", F.lit("unknown")).alias("source"))
    b = calls.filter("key is not null").filter(F.trim("response", F.lit(BLANK)) != "").select(F.lit("calls").alias("table_name"), F.col("key").alias("record_id"), F.coalesce("model", F.lit("unknown")).alias("source"))
    rows = a.unionByName(b).groupBy("table_name", "record_id").agg(F.min("source").alias("source"))
    marked = rows.join(flagged.withColumn("cut", F.lit(1)), ["table_name", "record_id"], "left")
    return marked.groupBy("table_name", "source").agg(F.count("*").alias("n_records"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count("*"), 6).alias("share"))
