"""Cleaning, profiling and sampling of account histories; plain DataFrame plans throughout.

Nulls: a null key (account, item id) forms no group and is dropped by the operators that group by it;
null text counts as empty; a null time sorts last. Ties are always broken by item_id. Extra columns are
carried along where the operator returns its input's rows. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLANKS = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def entity_hash(name: Column, salt: str, length: int = 16) -> Column:
    """One-way hash of a name, blind to case and outer blanks; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.lower(strip(name))), 256), 1, length)


def forum_name(c: Column) -> Column:
    """Lower case without outer blanks and a leading ``r/``; empty becomes null."""
    low = strip(F.regexp_replace(F.lower(strip(c)), "^/?r/", ""))
    return F.when(low != "", low)


def normalised(items: DataFrame) -> DataFrame:
    """Typed and defaulted columns; rows without a time are dropped.

    A comment's missing permalink is built from its thread, a null score becomes 0, an empty parent
    null and a tombstone body an empty one. Titles of posts are joined by ``post_body`` before.
    """
    body = F.coalesce(strip(F.col("body")), F.lit(""))
    gone = body.isin("[deleted]", "[removed]")
    thread = F.split_part("link_id", F.lit("_"), F.lit(2))
    short = F.split_part("item_id", F.lit("_"), F.lit(2))
    return items.filter("created_utc is not null and item_id is not null").select(
        "item_id",
        "account_hash",
        F.lower("kind").alias("kind"),
        forum_name(F.col("subreddit")).alias("subreddit"),
        F.col("created_utc").cast("long").alias("created_utc"),
        F.when(gone, F.lit("")).otherwise(body).alias("body"),
        F.coalesce(F.col("score").try_cast("int"), F.lit(0)).alias("score"),
        F.when(F.length("parent_id") > 0, F.col("parent_id")).alias("parent_id"),
        F.coalesce("permalink", F.concat(F.lit("/comments/"), thread, F.lit("/_/"), short, F.lit("/"))).alias("permalink"),
    )


def post_body(title: Column, text: Column) -> Column:
    """Title, empty line and text of a post, without outer blanks; the title alone where there is no text.

    Null titles and texts count as empty.
    """
    head, rest = (F.coalesce(strip(c), F.lit("")) for c in (title, text))
    return F.when(rest != "", strip(F.concat(head, F.lit("\n\n"), rest))).otherwise(head)


def first_fetched(items: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per item_id: the first fetched; equal fetches by score, digest of the body and source.

    ``columns``: what to return beside the id; only these and the digest are shuffled, so bodies stay where
    they are unless they are asked for.
    """
    columns = [c for c in (columns if columns is not None else items.columns) if c != "item_id"]
    order = F.struct(F.col("fetched_utc").isNull(), "fetched_utc", F.col("score").isNull(), "score", F.md5(F.coalesce("body", F.lit(""))), F.coalesce("source", F.lit("")))
    rows = items.filter("item_id is not null").select("item_id", order.alias("__order"), F.struct(*columns).alias("__row"))
    picked = rows.groupBy("item_id").agg(F.min_by("__row", "__order").alias("r"))
    return picked.select("item_id", "r.*")


def deduped_union(sources: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of all sources, one row per key; an earlier source wins, then the least row."""
    tagged = [s.select(*columns).withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    row = F.struct("__rank", *columns)
    return out.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns], F.col("r.__rank").alias("source_rank"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def excluded(name: Column, exact: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Whether a name is on the exact list or begins with a prefix; both lists are short parameters."""
    low = F.lower(strip(name))
    hit = low.isin(*exact)
    for p in prefixes:
        hit = hit | low.startswith(p)
    return F.coalesce(hit, F.lit(False))


def exclusion_guard(items: DataFrame, flag: Column, limit: float) -> DataFrame:
    """Items of accounts below the excluded share, without the excluded ones.

    The shares are aggregated (map-side) and joined back, so no window holds an account's rows.
    """
    marked = items.filter("account_hash is not null").withColumn("__x", flag)
    kept = marked.groupBy("account_hash").agg(F.avg(F.col("__x").cast("double")).alias("share")).filter(F.col("share") < limit)
    return marked.filter("not __x").join(kept.select("account_hash"), "account_hash", "left_semi").select(*items.columns)


def newest(items: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("created_utc"), "item_id")
    return items.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).withColumnRenamed("__rn", "newest_rank")


def profile(items: DataFrame) -> DataFrame:
    """Per account: items by kind, forums, span in days."""
    return (
        items.filter("account_hash is not null")
        .groupBy("account_hash")
        .agg(
            F.count("*").alias("n_items"),
            F.count_if(F.col("kind") == "comment").alias("n_comments"),
            F.count_if(F.col("kind") == "post").alias("n_posts"),
            F.countDistinct("subreddit").alias("n_subreddits"),
            F.round((F.max("created_utc") - F.min("created_utc")) / 86400, 3).alias("span_days"),
        )
    )


def sample_frame(items: DataFrame, not_in: Sequence[str], least_items: int, least_forums: int) -> DataFrame:
    """Accounts outside a list with enough items and forums: counts, first and last time."""
    kept = items.filter(F.col("account_hash").isNotNull() & ~F.col("account_hash").isin(*not_in))
    return (
        kept.groupBy("account_hash")
        .agg(F.count("*").alias("n"), F.countDistinct("subreddit").alias("n_subs"), F.min("created_utc").alias("first_utc"), F.max("created_utc").alias("last_utc"))
        .filter((F.col("n") >= least_items) & (F.col("n_subs") >= least_forums))
    )


def gap_cohorts(rows: DataFrame, time: str, gap: int) -> DataFrame:
    """``rows`` with ``cohort``: runs of times in which no step is longer than ``gap``.

    There is one global order and no key, so a window over the rows would be one task. Times in one
    bucket of width ``gap`` never part, so only the buckets' first and last times are ordered; their
    number is the time range over the gap. Rows without a time are dropped.
    """
    timed = rows.filter(F.col(time).isNotNull()).withColumn("__b", F.floor(F.col(time) / gap))
    buckets = timed.groupBy("__b").agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    w = Window.orderBy("__b")
    split = F.coalesce((F.col("lo") - F.lag("hi").over(w) > gap).cast("int"), F.lit(0))
    numbered = buckets.withColumn("__s", split).withColumn("cohort", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return timed.join(numbered.select("__b", "cohort"), "__b").drop("__b")


def probe_sample(items: DataFrame, probes: Sequence[tuple[int, int]], per_probe: int, cap: int) -> DataFrame:
    """Accounts met first when looking at the next ``per_probe`` items after each probe time.

    ``probes``: (number, time), a short list of at most 1,000. An item is looked at once: it belongs to the
    last probe before it, of whose items only the first ``per_probe`` are kept (task by task, then over
    all). What a probe meets are then the kept items of its own and the later stretches.
    """
    if len(probes) > 1000:
        raise ValueError("at most 1,000 probes")
    times = sorted({t for _, t in probes})
    starts = F.array(*[F.lit(t) for t in times]).cast("array<bigint>")
    rows = items.filter("account_hash is not null and created_utc is not null").select("account_hash", "created_utc", "item_id")
    placed = rows.withColumn("stretch", F.size(F.filter(starts, lambda t: t <= F.col("created_utc")))).filter("stretch > 0")
    w = Window.partitionBy("stretch").orderBy("created_utc", "item_id")
    kept = placed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_probe).drop("rn")
    seen = F.explode(F.array(*[F.struct(F.lit(p).alias("probe"), F.lit(times.index(t) + 1).alias("least")) for p, t in probes])).alias("p")
    met = kept.select("*", seen).filter("stretch >= p.least").withColumn("probe", F.col("p.probe"))
    met = met.withColumn("pos", F.row_number().over(Window.partitionBy("probe").orderBy("created_utc", "item_id"))).filter(F.col("pos") <= per_probe)
    first = met.groupBy("account_hash").agg(F.min(F.struct("probe", "pos")).alias("at"))
    return first.select("account_hash", F.col("at.probe").alias("probe"), F.col("at.pos").alias("pos")).orderBy("probe", "pos").limit(cap)


def ranked(rows: DataFrame, key: str | Sequence[str], time: str, tie: str, width: int = 30 * 86400) -> DataFrame:
    """``rows`` with ``position`` (from 0) by time and tie within the key(s), and ``group_size``.

    The rank is taken within (key, time bucket) and shifted by the counts of the earlier buckets, so
    that a key with a third of all rows is ordered by many tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    timed = rows.filter(F.col(time).isNotNull()).withColumn("__b", F.floor(F.col(time) / width))
    for k in keys:
        timed = timed.filter(F.col(k).isNotNull())
    counts = timed.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b")
    shift = counts.withColumn("__before", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    shift = shift.withColumn("group_size", F.sum("__n").over(Window.partitionBy(*keys))).drop("__n")
    local = timed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(time, tie)))
    out = local.join(shift, [*keys, "__b"])
    return out.withColumn("position", F.col("__before") + F.col("__r") - 1).drop("__b", "__r", "__before")
