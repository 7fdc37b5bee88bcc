"""Problem 5: results per account by eager aggregation through joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.eager import heavy_keys, join_rollup
from tidemark.sources.tables import table


def p5_found(spark, d):
    """Accounts with at least 4 % of the distinct items."""
    return heavy_keys(table(spark, d, "items"), table(spark, d, "account_index"), "account_hash", "item_id", 4).select("account_hash")


def p5_items_by_calls(spark, d):
    """Per account, aggregates of items JOIN calls, whose rows are never formed."""
    score, tokens = F.col("score").cast("long"), F.length("response").cast("long")
    out = join_rollup(table(spark, d, "items"), table(spark, d, "calls"), ["account_hash"], {"score": score}, {"answer": tokens})
    picked = ["account_hash", "n_rows", "n_left", "n_right", "score_sum", "score_min", "score_max", "answer_sum", "answer_min", "answer_max"]
    return out.select(*picked, F.round("score_avg", 6).alias("score_avg"), F.round("answer_avg", 6).alias("answer_avg"))


def p5_history_by_index(spark, d):
    """Per account of the history, with or without a row in the index: left join, rolled up."""
    out = join_rollup(table(spark, d, "items"), table(spark, d, "account_index"), ["account_hash"], {"score": F.col("score").cast("long")}, {"chunks": F.col("n_chunks").cast("long")}, "left")
    return out.select("account_hash", "n_rows", "n_left", "n_right", "score_sum", "chunks_sum", "chunks_max")


QUERIES = {"p5_found": p5_found, "p5_items_by_calls": p5_items_by_calls, "p5_history_by_index": p5_history_by_index}

ORACLES = {
    "p5_found": """
select account_hash from (select distinct account_hash, item_id from items where item_id is not null and account_hash is not null)
group by account_hash having count(*) * 100 >= 4 * (select count(distinct item_id) from items)
""",
    "p5_items_by_calls": """
with a as (select account_hash, count(*) as n, sum(cast(score as bigint)) as s, count(score) as c, min(cast(score as bigint)) as lo, max(cast(score as bigint)) as hi
           from items where account_hash is not null group by 1),
b as (select account_hash, count(*) as n, sum(cast(length(response) as bigint)) as s, count(response) as c, min(cast(length(response) as bigint)) as lo, max(cast(length(response) as bigint)) as hi
      from calls where account_hash is not null group by 1)
select a.account_hash, a.n * b.n as n_rows, a.n as n_left, b.n as n_right,
       cast(a.s * b.n as bigint) as score_sum, a.lo as score_min, a.hi as score_max, cast(b.s * a.n as bigint) as answer_sum, b.lo as answer_min, b.hi as answer_max,
       round(a.s / nullif(a.c, 0), 6) as score_avg, round(b.s / nullif(b.c, 0), 6) as answer_avg
from a join b using (account_hash)
""",
    "p5_history_by_index": """
select i.account_hash, count(*) as n_rows, any_value(i.n) as n_left, cast(any_value(coalesce(x.n, 0)) as bigint) as n_right,
       cast(sum(cast(score as bigint)) as bigint) as score_sum, cast(sum(cast(n_chunks as bigint)) as bigint) as chunks_sum, max(cast(n_chunks as bigint)) as chunks_max
from (select *, count(*) over (partition by account_hash) as n from items where account_hash is not null) i
left join (select *, count(*) over (partition by account_hash) as n from account_index) x using (account_hash)
group by i.account_hash
""",
}
