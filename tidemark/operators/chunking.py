"""Cutting ordered histories into chunks: windows by count, equal windows, samples, greedy packing.

Positions come from ``history.ranked``, which no heavy account overloads; what follows is arithmetic on
them. Greedy packing is sequential by nature: groups of at most ``FOLD`` rows, such as windows, are folded
in one expression over their lengths (never their texts), longer ones block by block, see
``greedy_pack_long``. A single piece longer than the budget is a chunk of its own. Null text has length 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.history import ranked


def count_windows(rows: DataFrame, size: int) -> DataFrame:
    """``window_no`` for every ``size`` positions."""
    return rows.withColumn("window_no", F.floor(F.col("position") / size))


def equal_windows(rows: DataFrame, target: int) -> DataFrame:
    """``window_no`` of ``target`` windows of near-equal count, bounds ``floor(k * (n / target))``."""
    step = F.col("group_size") / F.lit(float(target))
    guess = F.least(F.floor(F.col("position") / step).cast("int"), F.lit(target - 1))
    lower = lambda k: F.floor(k * step)
    fixed = F.when(F.col("position") < lower(guess), guess - 1).when((F.col("position") >= lower(guess + 1)) & (guess + 1 < target), guess + 1).otherwise(guess)
    return rows.withColumn("window_no", fixed.cast("int"))


def epoch_bins(time: Column, low: Column, high: Column, bins: Column) -> Column:
    """Bin of a time among equal spans from ``low`` to ``high``; the end belongs to the last."""
    span = (high - low).cast("double")
    return F.when(span <= 0, F.lit(0)).otherwise(F.least(F.floor((time - low) * bins / span), bins - 1)).cast("int")


def sampled_positions(rows: DataFrame, budget: int, group: list[str], length: str, order: str) -> DataFrame:
    """Evenly spaced rows of each group that fit a length budget at the group's mean length.

    ``keep = min(n, max(1, budget // (mean + 2)))`` rows at ``floor(m * ((n-1)/(keep-1)))``.
    """
    stats = rows.groupBy(*group).agg(F.count("*").alias("__n"), F.sum(F.coalesce(length, F.lit(0))).alias("__s"), F.min(order).alias("__o"))
    mean = F.greatest(F.lit(1), F.floor(F.col("__s") / F.col("__n")) + 2)
    keep = F.least(F.col("__n"), F.greatest(F.lit(1), F.floor(F.lit(budget) / mean)))
    wanted = stats.select(*group, "__o", "__n", keep.cast("int").alias("__keep")).withColumn("__m", F.explode(F.sequence(F.lit(0), F.col("__keep") - 1)))
    at = F.when(F.col("__keep") == 1, F.lit(0)).otherwise(F.floor(F.col("__m") * ((F.col("__n") - 1) / F.greatest(F.col("__keep") - 1, F.lit(1)))))
    wanted = wanted.select(*group, (F.col("__o") + at).alias(order)).distinct()
    return rows.join(wanted, [*group, order], "left_semi")


def greedy_pack(rows: DataFrame, group: list[str], order: list[str], length: str, budget: int, keep: str, gap: int = 2) -> DataFrame:
    """Numbers the packs of each group: rows are added while the joined length stays in the budget.

    One array of (order, id, length) per group is folded by a higher-order function: the state holds
    the pack number, the length so far and the numbered rows.
    """
    piece = F.struct(*order, keep, F.coalesce(F.col(length), F.lit(0)).cast("int").alias("__len"))
    grouped = rows.groupBy(*group).agg(F.sort_array(F.collect_list(piece)).alias("__p"))
    lens = F.transform("__p", lambda p: p["__len"])
    start = F.struct(F.lit(-1).alias("pack"), F.lit(0).alias("cur"), F.array().cast("array<int>").alias("out"))

    def step(state, size):
        fits = (state["pack"] >= 0) & (state["cur"] + size + gap <= budget)
        pack = F.when(fits, state["pack"]).otherwise(state["pack"] + 1)
        cur = F.when(fits, state["cur"] + size + gap).otherwise(size)
        return F.struct(pack.alias("pack"), cur.alias("cur"), F.concat(state["out"], F.array(pack)).alias("out"))

    packs = F.aggregate(lens, start, step, lambda s: s["out"])
    zipped = grouped.select(*group, F.explode(F.arrays_zip(F.col("__p").alias("p"), packs.alias("pack"))).alias("z"))
    return zipped.select(*group, F.col("z.p.*"), F.col("z.pack").alias("pack")).withColumnRenamed("__len", "piece_length")


#: Groups up to this many rows are folded in one expression.
FOLD = 256


def block_table(lengths: np.ndarray, budget: int, gap: int) -> tuple[list[int], list[int], list[int], int]:
    """What a block of pieces does to any state it may be entered with.

    Entered with an open pack of length ``cur``, the first piece that does not fit begins a new pack, and
    all after it is the same whatever came before. So the block is the list of pieces that can be the
    first (each with the least ``cur`` above which it is one, in falling order), with the packs begun and
    the length of the last one in each case, and its whole length for the case that everything fits.
    The list is no longer than the pieces that go into one budget.
    """
    step = lengths.astype(np.int64) + gap
    upto = np.concatenate(([0], np.cumsum(step)))
    m = len(lengths)
    after = np.maximum(np.searchsorted(upto, upto[:-1] + budget + gap, "right") - 1, np.arange(m) + 1)
    packs, last = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(m - 1, -1, -1):
        if after[i] >= m:
            packs[i], last[i] = 1, upto[m] - upto[i] - gap
        else:
            packs[i], last[i] = packs[after[i]] + 1, last[after[i]]
    need, first = [], []
    least = None
    for i in range(m):
        x = budget - int(upto[i] + step[i])
        if least is None or x < least:
            need.append(x)
            first.append(i)
            least = x
        if least < 0:
            break
    return need, [int(packs[i]) for i in first], [int(last[i]) for i in first], int(upto[m])


def through(table: tuple, pack: int, cur: int) -> tuple[int, int]:
    """The state after a block, from the state before it."""
    need, packs, last, whole = table
    for x, p, c in zip(need, packs, last):
        if cur > x:
            return pack + p, c
    return pack, cur + whole


def pack_block(lengths: np.ndarray, pack: int, cur: int, budget: int, gap: int) -> np.ndarray:
    """Pack of each piece of a block entered with (pack, cur)."""
    out = np.empty(len(lengths), np.int32)
    for i, n in enumerate(lengths.tolist()):
        if pack >= 0 and cur + n + gap <= budget:
            cur += n + gap
        else:
            pack, cur = pack + 1, n
        out[i] = pack
    return out


def greedy_pack_long(rows: DataFrame, group: list[str], length: str, budget: int, gap: int = 2, block: int = 4096) -> DataFrame:
    """``rows`` (with ``position`` from 0 in each group) with ``pack``, for groups of any length.

    Exact: every block of positions is reduced to its table, the tables of a group are walked in order
    to find the state each block is entered with, and the blocks are packed independently. A group with
    a third of all rows is worked on by all tasks; one task sees a table per block of it only.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = ", ".join(f"`{g}` {kinds[g]}" for g in group)
    marked = rows.withColumn("__block", F.floor(F.col("position") / block)).withColumn("__len", F.coalesce(F.col(length), F.lit(0)).cast("int"))

    def reduce(pdf):
        lengths = pdf.sort_values("position")["__len"].to_numpy()
        need, packs, last, whole = block_table(lengths, budget, gap)
        head = {g: [pdf[g].iloc[0]] for g in group}
        return pd.DataFrame({**head, "__block": [pdf["__block"].iloc[0]], "need": [need], "packs": [packs], "last": [last], "whole": [whole]})

    tables = marked.select(*group, "__block", "position", "__len").groupBy(*group, "__block").applyInPandas(reduce, f"{keys}, __block bigint, need array<bigint>, packs array<bigint>, last array<bigint>, whole bigint")

    def walk(pdf):
        pack, cur, states = -1, budget + 1, []
        pdf = pdf.sort_values("__block")
        for r in pdf.itertuples(index=False):
            states.append((pack, cur))
            pack, cur = through((r.need, r.packs, r.last, r.whole), pack, cur)
        return pd.DataFrame({**{g: pdf[g].to_numpy() for g in group}, "__block": pdf["__block"].to_numpy(), "__pack": [s[0] for s in states], "__cur": [s[1] for s in states]})

    entered = tables.groupBy(*group).applyInPandas(walk, f"{keys}, __block bigint, __pack int, __cur bigint")
    every = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", pack int"

    def assign(pdf):
        pdf = pdf.sort_values("position")
        out = pdf[list(kinds)].copy()
        out["pack"] = pack_block(pdf["__len"].to_numpy(), int(pdf["__pack"].iloc[0]), int(pdf["__cur"].iloc[0]), budget, gap)
        return out

    return marked.join(entered, [*group, "__block"]).groupBy(*group, "__block").applyInPandas(assign, every)


def greedy_pack_any(rows: DataFrame, group: list[str], keep: list[str], length: str, budget: int, gap: int = 2) -> DataFrame:
    """Packs of groups of any size: ``rows`` need ``position`` and ``group_size`` (``history.ranked``)."""
    short = greedy_pack(rows.filter(F.col("group_size") <= FOLD).withColumn("__keep", F.struct(*keep)), group, ["position"], length, budget, "__keep", gap)
    short = short.select(*group, "position", *[F.col(f"__keep.{k}").alias(k) for k in keep], F.col("piece_length"), "pack")
    long = greedy_pack_long(rows.filter(F.col("group_size") > FOLD).select(*group, "position", *keep, F.coalesce(F.col(length), F.lit(0)).cast("int").alias("piece_length")), group, "piece_length", budget, gap)
    return short.unionByName(long)


def numbered(chunks: DataFrame, key: str, order: str, width: int = 4096) -> DataFrame:
    """``chunk_id`` = ``key:00000`` over the chunks that are left, by the number ``order``, unique in a key."""
    placed = ranked(chunks.withColumn("__tie", F.lit(0)), key, order, "__tie", width)
    return placed.withColumn("chunk_id", F.format_string("%s:%05d", F.col(key), F.col("position"))).drop("__tie", "position", "group_size")


def within_budget(rows: DataFrame, group: list[str], order: str, length: str, budget: int, gap: int = 2) -> DataFrame:
    """The rows of each group before the first whose joined length would exceed the budget; the first
    row always stays. Groups are bounded (the sample of a window)."""
    w = Window.partitionBy(*group).orderBy(order)
    before = F.coalesce(F.sum(F.col(length) + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = (before > 0) & (before + F.col(length) > budget)
    return rows.withColumn("__over", F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__over = 0").drop("__over")


def texts(rows: DataFrame, group: list[str], order: str, piece: str, least: int) -> DataFrame:
    """``item_ids``, ``text`` (pieces in order, an empty line between) and ``n_chars`` of each group; shorter
    texts than ``least`` are dropped. Groups are bounded by the budget of a chunk."""
    parts = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, "item_id", piece))).alias("__p"))
    out = parts.select(*group, F.transform("__p", lambda p: p["item_id"]).alias("item_ids"), F.array_join(F.transform("__p", lambda p: p[piece]), "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text")).filter(F.col("n_chars") >= least)
