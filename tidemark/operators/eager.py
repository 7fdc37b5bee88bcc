"""Eager aggregation through joins: per-key results whose work does not follow the heavy keys.

``a JOIN b USING (k)`` followed by a grouping by ``k`` (or by something ``k`` decides) is answered
without forming the join's rows. Both inputs are first pre-aggregated by the key into compact states
(a count, and per measure a sum, minimum, maximum and non-null count), which Spark combines on the
map side, so a key that holds a third of the rows costs each task one state. The states are joined,
one row a key, and the join's aggregates follow algebraically: its row count is the product of the
two counts, a sum over it is one side's sum times the other side's count, an average the quotient.

Rows with a null key take no part in an inner join and are left out; in a left join too, since their
group has no key. Null measures count as in SQL (ignored by sum, avg, min, max). Column names of the
two inputs may clash: only the named measures are read, and results carry the measure's alias.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def states(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """One row per key: ``n`` rows, and ``{alias}__sum/min/max/cnt`` for each measure."""
    picked = df.select(*[F.col(k) for k in keys], *[c.alias(a) for a, c in measures.items()])
    for k in keys:
        picked = picked.filter(F.col(k).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for a in measures:
        aggs += [F.sum(a).alias(f"{a}__sum"), F.min(a).alias(f"{a}__min"), F.max(a).alias(f"{a}__max"), F.count(a).alias(f"{a}__cnt")]
    return picked.groupBy(*keys).agg(*aggs)


def join_rollup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_measures: Mapping[str, Column],
    right_measures: Mapping[str, Column],
    how: str = "inner",
    rollup: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregates of ``left JOIN right USING (keys)`` by ``rollup`` (the keys, or some of them).

    Returns ``n_rows`` (of the join), ``n_left`` and ``n_right`` (rows of the inputs that joined) and,
    per measure, ``{alias}_sum``, ``_avg``, ``_min`` and ``_max`` over the join's rows. ``how``:
    ``inner`` or ``left``; in a left join a key without partner keeps its rows once.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    a, b = states(left, keys, left_measures), states(right, keys, right_measures)
    a = a.withColumnRenamed("n", "__na")
    b = b.withColumnRenamed("n", "__nb")
    joined = a.join(b, list(keys), how)
    times_b = F.greatest(F.coalesce("__nb", F.lit(0)), F.lit(1 if how == "left" else 0))
    sums = {}
    for m in left_measures:
        sums[m] = (F.col(f"{m}__sum") * times_b, F.col(f"{m}__cnt") * times_b)
    for m in right_measures:
        sums[m] = (F.col(f"{m}__sum") * F.col("__na"), F.coalesce(f"{m}__cnt", F.lit(0)) * F.col("__na"))
    picked = joined.select(
        *[F.col(k) for k in keys],
        (F.col("__na") * times_b).alias("__rows"),
        "__na",
        F.coalesce("__nb", F.lit(0)).alias("__nb"),
        *[s.alias(f"{m}__s") for m, (s, _) in sums.items()],
        *[c.alias(f"{m}__c") for m, (_, c) in sums.items()],
        *[F.col(f"{m}__{x}") for m in sums for x in ("min", "max")],
    )
    aggs = [F.sum("__rows").alias("n_rows"), F.sum("__na").alias("n_left"), F.sum("__nb").alias("n_right")]
    for m in sums:
        total, count = F.sum(f"{m}__s"), F.sum(f"{m}__c")
        aggs += [total.alias(f"{m}_sum"), (total / F.when(count != 0, count)).alias(f"{m}_avg"), F.min(f"{m}__min").alias(f"{m}_min"), F.max(f"{m}__max").alias(f"{m}_max")]
    return picked.groupBy(*(rollup or keys)).agg(*aggs)


def heavy_keys(items: DataFrame, index: DataFrame, key: str, record: str, percent: int) -> DataFrame:
    """Keys that hold at least ``percent`` % of the distinct records: key, counts and share.

    ``items`` are reduced to distinct (key, record) pairs first, a shuffle on the nearly unique
    record, so no key makes a task heavy; the per-key states are then joined with those of ``index``
    (``n_index``: its rows for the key). Records with a null key count in the total only; null
    records count nowhere. No items: no keys.
    """
    pairs = items.filter(F.col(record).isNotNull()).groupBy(record, key).agg(F.lit(1).alias("__one"))
    total = items.agg(F.countDistinct(record)).first()[0]
    rolled = join_rollup(pairs, index.select(key), [key], {"one": F.col("__one")}, {}, "left")
    out = rolled.select(key, F.col("n_left").alias("n_records"), F.col("n_right").alias("n_index"), F.round(F.col("n_left") / F.lit(max(total, 1)), 6).alias("share"))
    return out.filter(F.col("n_records") * 100 >= F.lit(percent * total))
