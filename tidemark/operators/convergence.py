"""Agreement of estimates that share no failure mode: networks by account and pooled, weights, centralities.

Networks are long edges (account_hash, src, dep, weight). A correlation of fewer than three pairs or of a
constant is null and left out of means. Ranks are taken within an account's vocabulary, which is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import networks as N
from tidemark.operators.ratings import vocabulary, vocabulary_pairs
from tidemark.operators.statistics import average_ranks, pearson


def undirected(edges: DataFrame) -> DataFrame:
    """An account's network without directions: the mean of an edge and its reverse, once a pair."""
    return N.symmetrised(edges, "account_hash").select("account_hash", F.col("a").alias("src"), F.col("b").alias("dep"), "weight")


def by_account(one: DataFrame, other: DataFrame) -> DataFrame:
    """Per account the correlation of two estimates over the pairs that both have."""
    both = one.select("account_hash", "src", "dep", "weight").join(other.select("account_hash", "src", "dep", F.col("weight").alias("other")), ["account_hash", "src", "dep"])
    return both.groupBy("account_hash").agg(F.count("*").alias("n"), pearson("weight", "other").alias("r"))


def residual(edges: DataFrame) -> DataFrame:
    """P11 as edges: each account's weight minus the mean of the pair over accounts."""
    return N.deviations(edges).select("account_hash", "src", "dep", F.col("deviation").alias("weight"))


def pooled_over(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """The mean network over ``accounts``, those without a network counting as empty ones."""
    n = accounts.select("account_hash").distinct().agg(F.count("*").alias("n_accounts"))
    sums = edges.filter("src != dep").groupBy("src", "dep").agg(F.sum("weight").alias("s"))
    return sums.withColumn("__one", F.lit(1)).join(F.broadcast(n.withColumn("__one", F.lit(1))), "__one").select("src", "dep", (F.col("s") / F.col("n_accounts")).alias("weight"), "n_accounts")


def of_means(one: DataFrame, other: DataFrame, vocab: DataFrame) -> DataFrame:
    """The correlation of two mean networks (src, dep, weight) over all pairs of the vocabulary, absent edges 0."""
    cells = vocab.sparkSession.range(1).select(F.explode(vocabulary_pairs(vocab)).alias("p")).select("p.src", "p.dep")
    a, b = one.select("src", "dep", F.col("weight").alias("x")), other.select("src", "dep", F.col("weight").alias("y"))
    full = cells.join(a, ["src", "dep"], "left").join(b, ["src", "dep"], "left").na.fill(0.0, ["x", "y"])
    return full.agg(F.count("*").alias("n"), pearson("x", "y").alias("r"))


def both_ways(edges: DataFrame) -> DataFrame:
    """A mean network with every edge replaced by the mean of itself and its reverse."""
    half = F.col("weight") / 2
    rows = edges.select("src", "dep", half.alias("w")).unionByName(edges.select(F.col("dep").alias("src"), F.col("src").alias("dep"), half.alias("w")))
    return rows.groupBy("src", "dep").agg(F.sum("w").alias("weight"))


def summary(per: DataFrame, label: str) -> DataFrame:
    """Label, n, mean, lo and hi of the accounts' correlations."""
    return per.agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.min("r").alias("lo"), F.max("r").alias("hi")).select(F.lit(label).alias("label"), "n", "mean", "lo", "hi")


def rank_agreement(values: DataFrame, kind: str, value: str) -> DataFrame:
    """Per account the rank correlation of every two kinds of values of its names."""
    ranks = average_ranks(values, value, ["account_hash", kind], "r").select("account_hash", "name", F.col(kind).alias("one"), "r")
    both = ranks.join(ranks.select("account_hash", "name", F.col("one").alias("other"), F.col("r").alias("q")), ["account_hash", "name"]).filter("one < other")
    return both.groupBy("account_hash", "one", "other").agg(pearson("r", "q").alias("r"))


def between_accounts(values: DataFrame, value: str, vocab: DataFrame) -> DataFrame:
    """Per account the mean rank correlation of its values with those of every other account.

    No pair of accounts is formed. With ranks centred and scaled to norm 1, a correlation is a product of
    two vectors, so an account's sum over all others is its product with the sum over all, less its own 1.
    """
    vocabulary(vocab)  # checks the size of what is broadcast
    ranks = average_ranks(values, value, ["account_hash"], "r")
    shape = ranks.groupBy("account_hash").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.count("*").alias("k")).filter("k >= 3 and s > 1e-12")
    unit = ranks.join(shape, "account_hash").select("account_hash", "name", ((F.col("r") - F.col("m")) / (F.col("s") * F.sqrt("k"))).alias("u"))
    total = unit.groupBy("name").agg(F.sum("u").alias("t"), F.count("*").alias("n"))
    dots = unit.join(F.broadcast(total), "name").groupBy("account_hash").agg(F.sum(F.col("u") * F.col("t")).alias("dot"), F.max("n").alias("n"))
    return dots.select("account_hash", (F.col("n") - 1).alias("n"), F.when(F.col("n") > 1, (F.col("dot") - 1) / F.when(F.col("n") > 1, F.col("n") - 1)).alias("rho"))
