"""Problem 8: filling containers of one capacity with documents, splitting only oversize ones.

Sizes are token counts of a public tokenizer (its file is a parameter). A document above the capacity
is split into full pieces and a rest. The items are dealt by hash to shards of about ``shard_tokens``
tokens, so a task holds a bounded number of items however large the corpus is; within a shard they are
taken in descending size, each to the container of lowest cost, linear in its tokens plus quadratic in
the lengths of its items (attention), that still has room; a new container is opened where none has.

Null and blank texts and texts of no tokens fill nothing: they get one row with a null container.
Equal sizes are taken in order of doc_id and piece, so the result does not depend on partitioning.
Documents with a null id are left out. A capacity below 1 is an error. Other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.arrow import map_batches, spread
from tidemark.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern published with byte-level BPE vocabularies of this size.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n_tokens`` of each text; 0 for null and blank ones.

    ``path`` is the driver's; Spark hands the file to the executors.
    """
    documents.sparkSession.sparkContext.addFile(path)
    name = path.rstrip("/").rpartition("/")[2]

    def run(batch: pa.RecordBatch):
        from pyspark import SparkFiles

        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield key, len(encode(text)) if text and text.strip() else 0

    docs = spread(documents.filter("doc_id is not null").select("doc_id", "text"))
    return map_batches(docs, run, "doc_id bigint, n_tokens bigint", ["doc_id", "n_tokens"])


def cost(sizes, linear: float = 1.0, quadratic: float = 1 / 4096):
    """Estimated cost of items in one container: attention is within an item."""
    sizes = np.asarray(sizes, float)
    return linear * sizes + quadratic * sizes**2


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and offset of each of the sizes, which must descend and not exceed the capacity."""
    least = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(least + 16, capacity, np.int64)
    load = np.zeros(least + 16)
    used = least
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    costs = cost(sizes)
    for i, size in enumerate(sizes):
        fits = room[:used] >= size
        if fits.any():
            at = int(np.where(fits, load[:used], np.inf).argmin())
        else:
            if used == len(room):
                room = np.concatenate([room, np.full(used, capacity, np.int64)])
                load = np.concatenate([load, np.zeros(used)])
            at, used = used, used + 1
        where[i], offset[i] = at, capacity - room[at]
        room[at] -= size
        load[at] += costs[i]
    return where, offset


def assignment(documents: DataFrame, capacity: int = 4096, shard_tokens: int = 4_000_000, path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``piece``, ``first_token``, ``n_tokens``, ``container_id``, ``position`` in it."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counts = cut_lineage(token_counts(documents, path))
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, round(total / max(shard_tokens, capacity)))
    full = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    items = counts.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), full)).alias("piece"))
    items = items.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("bigint") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"),
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def run(pdf):
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        where, offset = pack(pdf["n_tokens"].to_numpy(), capacity)
        pdf["container_id"] = pdf["shard"] * 1_000_000_000 + where
        pdf["position"] = offset
        return pdf[["doc_id", "piece", "first_token", "n_tokens", "container_id", "position"]]

    packed = items.groupBy("shard").applyInPandas(run, "doc_id bigint, piece int, first_token bigint, n_tokens bigint, container_id bigint, position bigint")
    empty = counts.filter("n_tokens = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), "n_tokens", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("bigint").alias("position")
    )
    return packed.unionByName(empty)


def containers(assigned: DataFrame, capacity: int = 4096) -> DataFrame:
    """Per container: items, tokens, unused space and estimated cost."""
    size = F.col("n_tokens").cast("double")
    return (
        assigned.filter("container_id is not null")
        .groupBy("container_id")
        .agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum(size + size * size / 4096), 3).alias("cost"))
        .withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
    )
