"""Ranks, correlations, standardisation, two-way components and the bootstrap, as plain aggregations.

Missing values are null, not NaN; a correlation of fewer than three pairs or of a constant is null.
Variances are population ones unless a name says sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def pearson(x: str, y: str) -> Column:
    """A20 as an aggregate with its guards; only rows with both values count."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 3) & (spread > 1e-12), F.covar_pop(a, b) / F.when(spread > 1e-12, spread))


def average_ranks(df: DataFrame, value: str, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


def spread_ranks(df: DataFrame, value: str, keys: Sequence[str], name: str = "rank", buckets: int = 1024) -> DataFrame:
    """W12 for groups of any size: ``average_ranks`` of a numeric column without a window over a group.

    Equal values are counted first; a group's different values are dealt to equal spans of its range, and
    ranks within a span are shifted by the counts of the spans below. Rows with a null value or key are
    dropped.
    """
    whole = df.filter(F.col(value).isNotNull())
    for k in keys:
        whole = whole.filter(F.col(k).isNotNull())
    counts = whole.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets), F.lit(buckets - 1))
    placed = counts.join(ends, list(keys)).withColumn("__b", F.when(F.col("__hi") > F.col("__lo"), place).otherwise(F.lit(0)))
    spans = placed.groupBy(*keys, "__b").agg(F.sum("__n").alias("__m"))
    up = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    below = spans.withColumn("__below", F.sum("__m").over(up) - F.col("__m")).drop("__m")
    within = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("__c", F.sum("__n").over(within)).join(below, [*keys, "__b"])
    ranks = local.select(*keys, value, (F.col("__below") + F.col("__c") - F.col("__n") + (F.col("__n") + 1) / 2).alias(name))
    return whole.join(ranks, [*keys, value])


def exact_quantile(df: DataFrame, value: str, p: float, bins: int = 4096, few: int = 50_000) -> float | None:
    """The quantile of a numeric column, interpolated between neighbours, without sorting it.

    Counts over equal spans narrow the range around the two ranks that matter until few different values
    are left there. Nulls and NaN are ignored; None for no values.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    ranks = (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))

    def at(rank: int) -> float:
        below, a, b = 0, lo, hi
        while a < b:
            inside = rows.filter((F.col("v") >= a) & (F.col("v") <= b))
            values = inside.groupBy("v").count().limit(few + 1)
            if values.count() <= few:
                for v, c in sorted((r[0], r[1]) for r in inside.groupBy("v").count().collect()):
                    below += c
                    if below > rank:
                        return v
            span = F.least(F.floor((F.col("v") - a) / (b - a) * bins), F.lit(bins - 1))
            for r in sorted(inside.groupBy(span.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
                if below + r["c"] > rank:
                    a, b = r["lo"], r["hi"]
                    break
                below += r["c"]
        return a

    low, high = at(ranks[0]), at(ranks[1])
    return low + (high - low) * (p * (n - 1) - ranks[0])


def variance_partition(edges: DataFrame, replicates: int = 3) -> DataFrame:
    """How much of the edge weights is shared, and how much is the account's own.

    ``edges``: account_hash, src, dep, weight, weight_sd, not necessarily every pair of every account. One
    row: components of replicate noise, account, pair and account by pair (the replicate noise of a mean
    taken off), the shares of what is the account's own and of what it adds to every pair alike, and
    the same with the median squared deviation from the pair's mean taken off as a proxy of noise. A null
    deviation counts as no replicate.
    """
    cells = edges.filter("weight is not null").select("account_hash", F.concat_ws("->", "src", "dep").alias("pair"), F.col("weight").alias("x"), (F.col("weight_sd") * F.col("weight_sd")).alias("var"))
    rows = cells.groupBy("account_hash").agg(F.avg("x").alias("rm"), F.count("*").alias("rn"))
    cols = cells.groupBy("pair").agg(F.avg("x").alias("cm"), F.count("*").alias("cn"))
    n, g, rep = cells.agg(F.count("*"), F.avg("x"), F.avg("var")).first()
    d = cells.join(rows, "account_hash").join(cols, "pair")
    off = exact_quantile(d.select(((F.col("x") - F.col("cm")) * (F.col("x") - F.col("cm"))).alias("q")), "q", 0.5) if n else None
    sq = lambda c: c * c
    g0, rep0 = F.lit(float(g or 0.0)), F.lit(float(rep or 0.0))
    a = rows.agg(F.sum(F.col("rn") * sq(F.col("rm") - g0)).alias("ssa"), F.count("*").alias("na"))
    p = cols.agg(F.sum(F.col("cn") * sq(F.col("cm") - g0)).alias("ssp"), F.count("*").alias("np"))
    e = d.agg(F.sum(sq(F.col("x") - F.col("rm") - F.col("cm") + g0)).alias("sse"))
    one = lambda t: t.withColumn("__one", F.lit(1))
    t = one(a).join(one(p), "__one").join(one(e), "__one").filter("na > 0")
    pos = lambda c: F.greatest(F.lit(0.0), c)
    few = lambda c: F.greatest(c, F.lit(1))
    na, np_ = F.col("na"), F.col("np")
    t = t.withColumns({"msa": F.col("ssa") / few(na - 1), "msp": F.col("ssp") / few(np_ - 1), "mse": F.col("sse") / few((na - 1) * (np_ - 1))})
    t = t.withColumns({"sigma2_rep": rep0, "sigma2_account": pos((F.col("msa") - F.col("mse")) / np_), "sigma2_pair": pos((F.col("msp") - F.col("mse")) / na), "sigma2_account_pair": pos(F.col("mse") - rep0 / max(replicates, 1)), "sigma2_rep_offtarget": F.lit(off)})
    t = t.withColumn("__adj", pos(F.col("sigma2_account_pair") - F.col("sigma2_rep_offtarget")))
    share = lambda top, whole: F.when(whole > 0, top / F.when(whole > 0, whole))
    s2a, s2p = F.col("sigma2_account"), F.col("sigma2_pair")
    whole, adj = s2a + s2p + F.col("sigma2_account_pair"), s2a + s2p + F.col("__adj")
    return t.select(
        F.col("na").alias("n_accounts"), F.col("np").alias("n_pairs"), "sigma2_rep", "sigma2_account", "sigma2_pair", "sigma2_account_pair", "sigma2_rep_offtarget",
        share(s2a + F.col("sigma2_account_pair"), whole).alias("icc_idiographic"), share(s2a, whole).alias("icc_account_only"), share(s2a + F.col("__adj"), adj).alias("icc_idiographic_adj"),
    )


def standardised(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Z-scores per group; missing values become the group's mean, a constant group 0."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    filled = F.coalesce(value, "__m")
    return df.join(stats, list(keys)).withColumn("z", (filled - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")


def two_way(df: DataFrame, row: str, col: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Variance components of a complete table, by sums alone: each cell is counted for its row, its
    column and the whole in one aggregation, and these once more per key.

    Returns n_rows, n_cols, the mean squares and sigma2_row, sigma2_col, sigma2_rest (clipped at 0), and
    the shares icc_rest and icc_row.
    """
    k = list(keys)
    cells = df.groupBy(*k, row, col).agg(F.avg(value).alias("x"))
    part = lambda tag, c: F.struct(F.lit(tag).alias("tag"), c.cast("string").alias("id"))
    parts = cells.select(*k, F.explode(F.array(part("r", F.col(row)), part("c", F.col(col)), part("a", F.lit(None)))).alias("p"), "x")
    sums = parts.groupBy(*k, "p").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    of = lambda tag, c: F.sum(F.when(F.col("p.tag") == tag, c))
    mean = F.col("s") * F.col("s") / F.col("n")
    t = sums.groupBy(*k).agg(
        of("a", F.col("n")).alias("n"), of("a", F.col("s")).alias("s"), of("a", F.col("q")).alias("q"), of("r", mean).alias("qr"), of("c", mean).alias("qc"), of("r", F.lit(1)).alias("r"), of("c", F.lit(1)).alias("c")
    )
    c0 = F.col("s") * F.col("s") / F.col("n")
    ssr, ssc = F.col("qr") - c0, F.col("qc") - c0
    sse = F.col("q") - c0 - ssr - ssc
    div = lambda a, b: a / F.when(b > 0, b)
    msr, msc, mse = div(ssr, F.col("r") - 1), div(ssc, F.col("c") - 1), div(sse, (F.col("r") - 1) * (F.col("c") - 1))
    out = t.select(*k, F.col("r").alias("n_rows"), F.col("c").alias("n_cols"), msr.alias("ms_row"), msc.alias("ms_col"), mse.alias("ms_rest"))
    pos = lambda x: F.greatest(F.lit(0.0), x)
    out = out.withColumns(
        {"sigma2_row": pos((F.col("ms_row") - F.col("ms_rest")) / F.col("n_cols")), "sigma2_col": pos((F.col("ms_col") - F.col("ms_rest")) / F.col("n_rows")), "sigma2_rest": pos(F.col("ms_rest"))}
    )
    total = F.col("sigma2_row") + F.col("sigma2_col") + F.col("sigma2_rest")
    return out.withColumns({"icc_rest": div(F.col("sigma2_rest"), total), "icc_row": div(F.col("sigma2_row"), total)})


def resamples(groups: DataFrame, key: str, n_boot: int, seed: str) -> DataFrame:
    """``n_boot`` resamples of the groups with replacement, by hash: boot, draw, key.

    The draw of (boot, slot) is a hash modulo the number of groups, the same on any engine.
    """
    numbered = groups.select(key).distinct().withColumn("pos", F.row_number().over(Window.orderBy(key)) - 1)
    n = numbered.count()
    spark = groups.sparkSession
    draws = spark.range(n_boot * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias("boot"), F.pmod(F.col("id"), F.lit(max(n, 1))).alias("draw"))
    text = F.concat_ws(":", F.lit(seed), "boot", "draw")
    pick = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % F.lit(max(n, 1))
    return draws.withColumn("pos", pick).join(numbered, "pos").select("boot", "draw", key)


def bootstrap_shares(edges: DataFrame, n_boot: int = 500, replicates: int = 3, seed: int = 0, buckets: int = 24) -> DataFrame:
    """2.5 and 97.5 percentiles of icc_idiographic, icc_account_only, sigma2_pair and sigma2_account_pair.

    ``edges``: account_hash, src, dep, weight, weight_sd, not necessarily every pair of every account. Whole
    accounts are drawn with replacement; a resample is one count per account, and each bucket of pairs adds
    up its sums under all resamples at once. Every task derives the counts from ``seed`` alone.
    """
    accounts = edges.select("account_hash").distinct().withColumn("pos", F.row_number().over(Window.orderBy("account_hash")) - 1)
    n_a, n_p = accounts.count(), edges.select("src", "dep").distinct().count()
    means = edges.groupBy("account_hash").agg(F.avg("weight").alias("own"))
    cells = edges.join(accounts.join(means, "account_hash"), "account_hash").select(
        F.pmod(F.xxhash64("src", "dep"), F.lit(buckets)).alias("bucket"), F.concat_ws("->", "src", "dep").alias("pair"), "pos", "own", "weight", (F.col("weight_sd") * F.col("weight_sd")).alias("var")
    )
    names = ["n", "s", "q", "r", "r2", "mr", "v", "nv", "cs", "cd"]

    def run(pdf):
        import numpy as np
        import pandas as pd

        draw = np.random.default_rng(seed)
        counts = np.stack([np.bincount(draw.integers(0, n_a, n_a), minlength=n_a) for _ in range(n_boot)])
        out = np.zeros((n_boot, len(names)))
        for _, g in pdf.groupby("pair", sort=True):
            g = g.sort_values("pos")
            m, own, var = g["weight"].to_numpy(float), g["own"].to_numpy(float), g["var"].to_numpy(float)
            ok = np.isfinite(var)
            sums = counts[:, g["pos"].to_numpy()] @ np.stack([np.ones(len(m)), m, m * m, own, own * own, m * own, np.where(ok, var, 0.0), ok.astype(float)], 1)
            col = np.divide(sums[:, 1], sums[:, 0], out=np.zeros(n_boot), where=sums[:, 0] > 0)
            out += np.column_stack([sums, col * sums[:, 1], col * (sums[:, 1] - sums[:, 3])])
        return pd.DataFrame(out, columns=names).assign(boot=np.arange(n_boot))[["boot", *names]]

    parts = cells.groupBy("bucket").applyInPandas(run, "boot int, " + ", ".join(f"{x} double" for x in names))
    t = parts.groupBy("boot").agg(*[F.sum(x).alias(x) for x in names]).withColumn("g", F.col("s") / F.col("n"))
    g = F.col("g")
    ss_a = F.col("r2") - 2 * g * F.col("r") + g * g * F.col("n")
    ss_p = F.col("cs") - 2 * g * F.col("s") + g * g * F.col("n")
    ss_e = F.col("q") - 2 * F.col("mr") + F.col("r2") - 2 * (F.col("cd") - g * (F.col("s") - F.col("r"))) + ss_p
    pos = lambda x: F.greatest(F.lit(0.0), x)
    ms = t.select(
        (ss_a / max(n_a - 1, 1)).alias("a"), (ss_p / max(n_p - 1, 1)).alias("p"), (ss_e / max((n_a - 1) * (n_p - 1), 1)).alias("e"),
        F.when(F.col("nv") > 0, F.col("v") / F.when(F.col("nv") > 0, F.col("nv"))).otherwise(0.0).alias("rep"),
    )
    s2 = ms.select(pos((F.col("a") - F.col("e")) / n_p).alias("sa"), pos((F.col("p") - F.col("e")) / n_a).alias("sigma2_pair"), pos(F.col("e") - F.col("rep") / max(replicates, 1)).alias("sigma2_account_pair"))
    total = F.col("sa") + F.col("sigma2_pair") + F.col("sigma2_account_pair")
    share = lambda x: F.when(total > 0, x / F.when(total > 0, total))
    fit = s2.select("sigma2_pair", "sigma2_account_pair", share(F.col("sa") + F.col("sigma2_account_pair")).alias("icc_idiographic"), share(F.col("sa")).alias("icc_account_only"))
    stats = ["icc_idiographic", "icc_account_only", "sigma2_pair", "sigma2_account_pair"]
    q = fit.agg(*[F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in stats])
    return q.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c)[0].alias("lo"), F.col(c)[1].alias("hi")) for c in stats])).alias("e")).select("e.*")
