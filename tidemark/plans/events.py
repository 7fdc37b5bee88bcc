"""Queries on the event table and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.history import ranked
from tidemark.operators.statistics import spread_ranks
from tidemark.sources.tables import table
from tidemark.streaming import twins


def session_window_counts(s, d):
    """Gap sessions per user, the batch form of the streaming operator."""
    out = twins.session_counts(table(s, d, "events"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n", F.round("total", 4).alias("total"))


def tumbling_window_counts(s, d):
    """Hourly counts by event type."""
    out = twins.tumbling_counts(table(s, d, "events"))
    return out.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def event_type_pivot(s, d):
    """Pivot and back: events per user and type."""
    rows = table(s, d, "events").filter("event_type is not null")
    types = [r[0] for r in rows.select("event_type").distinct().orderBy("event_type").limit(1001).toLocalIterator()]
    if len(types) > 1000:
        raise ValueError("at most 1,000 columns")
    wide = rows.groupBy("user_id").pivot("event_type", types).agg(F.count(F.lit(1)))
    return wide.unpivot("user_id", types, "event_type", "n").filter("n is not null")


def user_value_ranks(s, d):
    """Average ranks of users by value within a type."""
    rows = table(s, d, "events").groupBy("event_type", "user_id").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"))
    return spread_ranks(rows, "v", ["event_type"]).select("event_type", "user_id", "v", "rank")


def nation_flows(s, d):
    """Edges between nations from orders: mean revenue by supplier and customer nation, self edges gone."""
    l, o, c, p = (table(s, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    per_order = l.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.count("*").alias("n"))
    flows = per_order.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    flows = flows.join(c.select("c_custkey", F.col("c_nationkey").alias("dep")), F.col("o_custkey") == F.col("c_custkey"))
    flows = flows.join(p.select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
    return flows.filter("src != dep").groupBy("src", "dep").agg(F.round(F.sum("rev") / F.sum("n"), 2).alias("weight"), F.sum("n").alias("n"))


def lag_pairs(s, d):
    """Value of an event and of the user's previous one."""
    rows = table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    placed = ranked(rows.filter("user_id is not null"), "user_id", "us", "event_id", 86_400_000_000).select("user_id", "event_type", "position", "value")
    before = placed.select("user_id", (F.col("position") + 1).alias("position"), F.col("value").alias("before"))
    both = placed.join(before, ["user_id", "position"]).filter("before is not null")
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") * F.col("before")), 3).alias("moment"))


def event_days(s, d):
    """Dates parsed, formatted and truncated: events per day, weekday and first day of the month."""
    ts = F.col("ts").cast("timestamp")
    day = F.date_format(ts, "yyyy-MM-dd")
    rows = table(s, d, "events").select(day.alias("day"), F.date_format(F.trunc(F.to_date(day, "yyyy-MM-dd"), "month"), "dd.MM.yyyy").alias("month"), (F.weekday(ts) + 1).alias("weekday"))
    return rows.groupBy("day", "month", "weekday").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (session_window_counts, tumbling_window_counts, event_type_pivot, user_value_ranks, nation_flows, lag_pairs, event_days)}

ORACLES = {
    "session_window_counts": """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 2 hour then 1 else 0 end as s from events where user_id is not null),
c as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 7200000000 as end_us, count(*) as n, round(sum(value), 4) as total from c group by user_id, k""",
    "tumbling_window_counts": "select cast(epoch(date_trunc('hour', ts)) as bigint) as start_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_type_pivot": "select user_id, event_type, count(*) as n from events where event_type is not null group by 1, 2",
    "event_days": "select strftime(ts, '%Y-%m-%d') as day, strftime(date_trunc('month', ts), '%d.%m.%Y') as month, cast(isodow(ts) as int) as weekday, count(*) as n from events group by 1, 2, 3",
    "user_value_ranks": """with r as (select event_type, user_id, cast(sum(cast(round(value * 100) as bigint)) as bigint) as v from events group by 1, 2)
select event_type, user_id, v, rank() over (partition by event_type order by v) + (count(*) over (partition by event_type, v) - 1) / 2.0::double as rank from r""",
    "nation_flows": """select s_nationkey as src, c_nationkey as dep, round(sum(l_extendedprice * (1 - l_discount)) / count(*), 2) as weight, count(*) as n
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey group by 1, 2""",
    "lag_pairs": """select event_type, count(*) as n, round(avg(value * before), 3) as moment from (select *, lag(value) over (partition by user_id order by ts, event_id) as before from events where user_id is not null) where before is not null group by 1""",
}
