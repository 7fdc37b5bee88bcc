"""Problem 2: capping the records of each contributor, best ones first, without sorting a group.

Every contributor's quality is summed up in a mergeable histogram (one bin per score; counts add up
map-side). The running count over the bins, best first, gives the bin in which the cap falls: bins
above it are kept and bins below it removed by a plain filter. Only the rows of that one borderline
bin are ranked, by ``item_id``: they are narrowed by histograms over ever longer key prefixes, chosen
from the keys themselves, so that the final rank sees one small prefix group however many rows tie.

Null contributors are left out; a null score ranks below every score; ties go by item_id ascending,
which is unique after the latest fetch of each item was taken (latest ``fetched_utc``; of equal ones
the higher score, null last, then the later body text). Null item_ids are left out. A cap of 0
removes everything, an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage


def contributor(name: Column) -> Column:
    """Lower case, without outer blanks, without a leading ``r/``."""
    blank = " \t\n\r\f\v"
    low = F.lower(F.trim(name, F.lit(blank)))
    low = F.trim(F.regexp_replace(low, "^/?r/", ""), F.lit(blank))
    return F.when(low != "", low)


def latest(items: DataFrame) -> DataFrame:
    """One row per item_id: contributor and score of its latest fetch."""
    order = F.struct(F.coalesce("fetched_utc", F.lit(-(1 << 62))), F.coalesce(F.col("score").cast("long"), F.lit(-(1 << 62))), F.coalesce("subreddit", F.lit("")))
    kept = items.filter("item_id is not null").select("item_id", order.alias("o"), contributor(F.col("subreddit")).alias("who"), F.col("score").cast("long").alias("score"))
    return kept.groupBy("item_id").agg(F.max(F.struct("o", "who", "score")).alias("m")).select("item_id", "m.who", "m.score")


def shared_prefix(low: Column, high: Column) -> Column:
    """Length of the common beginning of two strings without NUL characters."""
    return F.length(F.regexp_extract(F.concat(low, F.lit("\0"), high), "(?s)^([^\\x00]*)[^\\x00]*\\x00\\1", 1))


def over_cap(rows: DataFrame, cap: int, binding: int | None = None, rounds: int = 2, step: int = 2) -> DataFrame:
    """The rows beyond the cap: ``item_id``. ``rows``: item_id, who, score.

    The rows of the borderline bin are narrowed in ``rounds`` by histograms over their keys' beginnings,
    ``step`` characters past what the keys of the bin have in common; any choice gives the same result.
    ``binding``: a proven bound on the contributors beyond the cap, where there is one; the cutoffs, a
    row for each of them, are then broadcast. Undecided rows are written once per round.
    """
    small = F.broadcast if binding is not None and binding <= 10_000 else (lambda df: df)
    quality = F.coalesce("score", F.lit(-(1 << 62)))
    rows = rows.select("item_id", "who", quality.alias("q"))
    bins = rows.groupBy("who", "q").agg(F.count("*").alias("n"))
    best = Window.partitionBy("who").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("n").over(best)).withColumn("above", F.col("upto") - F.col("n"))
    edge = bins.filter((F.col("upto") > cap) & (F.col("above") <= cap)).select("who", F.col("q").alias("edge"), (F.lit(cap) - F.col("above")).alias("room"))
    marked = rows.join(small(edge), "who").filter("q <= edge")
    out = marked.filter("q < edge").select("item_id")
    open_rows = cut_lineage(marked.filter("q = edge").select("who", "item_id", "room"))
    for _ in range(rounds):
        ends = open_rows.groupBy("who").agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
        width = ends.select("who", (shared_prefix(F.col("lo"), F.col("hi")) + step).alias("width"))
        headed = open_rows.join(small(width), "who").select("who", "item_id", "room", F.col("item_id").substr(F.lit(1), F.col("width")).alias("head"))
        counts = headed.groupBy("who", "head").agg(F.count("*").alias("n"), F.first("room").alias("room"))
        asc = Window.partitionBy("who").orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.sum("n").over(asc)).withColumn("above", F.col("upto") - F.col("n"))
        cut = counts.filter("upto > room and above <= room").select("who", F.col("head").alias("cut"), (F.col("room") - F.col("above")).alias("left"))
        placed = cut_lineage(headed.join(small(cut), "who").filter("head >= cut").select("who", "item_id", "left", (F.col("head") > F.col("cut")).alias("gone")))
        out = out.unionByName(placed.filter("gone").select("item_id"))
        open_rows = placed.filter("not gone").select("who", "item_id", F.col("left").alias("room"))
    rank = F.row_number().over(Window.partitionBy("who").orderBy("item_id"))
    return out.unionByName(open_rows.withColumn("rank", rank).filter("rank > room").select("item_id"))


def found(items: DataFrame, parts: int = 20) -> DataFrame:
    """Items removed by a cap of one ``parts``-th of all distinct item_ids per contributor.

    Fewer than ``parts`` + 1 contributors can be beyond such a cap (each then holds more than the
    cap's share of the items), unless the cap is 0 because there are fewer than ``parts`` items.
    """
    rows = cut_lineage(latest(items))
    cap = rows.count() // parts
    return over_cap(rows.filter("who is not null"), cap, 2 * parts if cap else None)


def capped(items: DataFrame, share: float | None = 0.05, most: int | None = None) -> DataFrame:
    """The items that stay, with contributor and score, under a share of all items, a count, or both."""
    if share is None and most is None:
        raise ValueError("give a share, a count, or both")
    rows = cut_lineage(latest(items))
    limits = ([int(rows.count() * share + 1e-9)] if share is not None else []) + ([most] if most is not None else [])
    named = rows.filter("who is not null")
    by_share = bool(share) and (most is None or limits[0] <= most) and limits[0] > 0  # only then few can be beyond the cap
    gone = over_cap(named, min(limits), int(2 / share) if by_share else None)
    return named.join(gone, "item_id", "left_anti").select("item_id", F.col("who").alias("contributor"), "score")


FOUND_SQL = """
with latest as (
  select item_id, score,
         nullif(trim(regexp_replace(lower(trim(subreddit, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))), '^/?r/', ''), chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)), '') as who
  from (select *, row_number() over (partition by item_id order by fetched_utc desc nulls last, score desc nulls last, subreddit desc nulls last) as rn
        from items where item_id is not null)
  where rn = 1),
ranked as (
  select item_id, row_number() over (partition by who order by score desc nulls last, item_id) as pos
  from latest where who is not null)
select item_id from ranked where pos > (select count(*) // 20 from latest)
"""
CAPPED_SQL = FOUND_SQL.replace("select item_id from ranked where pos >", "select r.item_id, l.who as contributor, cast(l.score as bigint) as score from ranked r join latest l using (item_id) where pos <=")
