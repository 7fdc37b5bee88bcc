"""Networks from chunk ratings, and their agreement with the networks from ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import convergence as V, covariation as C, networks as N, ratings as R, statistics as S
from tidemark.plans.networks import ACCOUNT_RANK, EDGES, MATRIX, SLA, _edges, _matrix, _node_weights, _pearson, _pooled, _r, _ranks, _ratings, _store, _vocab
from tidemark.session import cut_lineage


def chunk_rows(s, d, rows=None):
    """Long rows (account_hash, t, name, x) of mean ratings; a chunk without any rating keeps its row."""
    names = R.vocabulary(_vocab(s, d))
    t = F.split_part("trait", F.lit(":"), F.lit(2)).try_cast("bigint").alias("t")
    calls = _store(s, d).filter("task = 'e3_chunk' and account_hash is not null").select("account_hash", t, F.lit(names[0] if names else "").alias("name"), F.lit(None).cast("double").alias("x"))
    rated = (rows if rows is not None else _ratings(s, d)).filter("task = 'e3_chunk' and account_hash is not null").select("account_hash", t, F.col("rated").alias("name"), F.col("rating").alias("x"))
    return rated.unionByName(calls), names


def e3(s, d, method):
    """Each account's network from its chunk ratings."""
    rows, names = chunk_rows(s, d)
    return C.estimate(cut_lineage(C.tables(rows, "account_hash", names)), "account_hash", names, method)  # read twice: to count and to fit


def _edges_of(s, d, method):
    return e3(s, d, method).select("account_hash", "src", "dep", F.round("weight", 6).alias("weight"), "converged")


def e3_correlation_edges(s, d):
    """Standardised covariances of the chunk ratings, account by account."""
    return _edges_of(s, d, "cov").drop("converged")


def e3_undirected_edges(s, d):
    """Shrunk partial correlations of the chunk ratings."""
    return _edges_of(s, d, "pcor")


def e3_sparse_edges(s, d):
    """G11, G13."""
    return _edges_of(s, d, "glasso")


def e3_directed_edges(s, d):
    """Effects of a chunk's ratings on those of the next."""
    return _edges_of(s, d, "lag1")


def e3_contemporaneous_edges(s, d):
    """G12."""
    return _edges_of(s, d, "contemporaneous")


def e3_matrix(s, d):
    """The chunk by trait matrix, one array per chunk; empty cells null."""
    rows, names = chunk_rows(s, d)
    x = C.tables(rows, "account_hash", names)
    return x.select("account_hash", "t", F.aggregate("x", F.lit(0).cast("bigint"), lambda n, v: n + v.isNotNull().cast("int")).alias("n_seen"), F.round(F.aggregate("x", F.lit(0.0), lambda t, v: t + F.coalesce(v, F.lit(0.0))), 4).alias("total"))


def stacked_edges(s, d):
    """The edges of all estimators in one table."""
    none = lambda kind: F.lit(None).cast(kind)
    e1 = _edges(s, d).select(F.lit("e1").alias("estimator"), "account_hash", "src", "dep", "weight", "weight_sd", F.col("n_replicates").cast("bigint").alias("n_replicates"))
    e2 = R.pair_edges(_ratings(s, d).filter("account_hash is not null"), "e2_pair").select(F.lit("e2").alias("estimator"), "account_hash", "src", "dep", "weight", F.col("sd").alias("weight_sd"), F.col("n").alias("n_replicates"))
    e3_ = e3(s, d, "cov").select(F.lit("e3").alias("estimator"), "account_hash", "src", "dep", "weight", none("double").alias("weight_sd"), none("bigint").alias("n_replicates"))
    return e1.unionByName(e2).unionByName(e3_).select("estimator", "account_hash", F.concat_ws("->", "src", "dep").alias("trait_pair"), *_r("weight", "weight_sd"), "n_replicates")


def pooled_e3(s, d):
    """A8 over the chunk networks: accounts with too few chunks count as empty networks."""
    return V.pooled_over(e3(s, d, "cov"), chunk_rows(s, d)[0]).select("src", "dep", *_r("weight"), "n_accounts")


def e1_e3_by_account(s, d):
    """Per account, ablation against chunk correlations, both without directions."""
    return V.by_account(V.undirected(_edges(s, d)), e3(s, d, "cov")).select("account_hash", "n", *_r("r"))


def residual_convergence(s, d):
    """What an account adds to the mean, by ablation against by chunk correlations."""
    one, other = V.undirected(_edges(s, d)), e3(s, d, "cov").filter("src < dep")
    return V.summary(V.by_account(V.residual(one), V.residual(other)), "residuals").select("label", "n", *_r("mean", "lo", "hi"))


def prior_convergence(s, d):
    """The mean ablation network against the generic prior, over all pairs."""
    prior = R.pair_edges(_ratings(s, d).withColumn("account_hash", F.lit(None).cast("string")), "e2_generic")
    return V.of_means(_pooled(s, d), prior, _vocab(s, d)).select("n", *_r("r"))


def convergence_suite(s, d):
    """Every agreement of the study, with the shrunk and the lagged chunk networks; with fewer
    than 5 accounts there is nothing to pool."""
    vocab = _vocab(s, d)
    ratings = cut_lineage(_ratings(s, d))  # parsed once for all that follows
    edges = cut_lineage(N.enough(_edges(s, d, ratings), 5))
    mean = cut_lineage(N.pooled(edges).select("src", "dep", "weight"))
    rows, names = chunk_rows(s, d, ratings)
    x = cut_lineage(C.tables(rows, "account_hash", names))
    tied, led = (cut_lineage(C.estimate(x, "account_hash", names, method).drop("converged")) for method in ("pcor", "lag1"))
    one = V.undirected(edges)
    single = lambda df, label: df.select(F.lit(label).alias("label"), F.when(F.col("r").isNotNull(), 1).otherwise(0).cast("bigint").alias("n"), F.col("r").alias("mean"), F.col("r").alias("lo"), F.col("r").alias("hi"))
    prior = R.pair_edges(ratings.withColumn("account_hash", F.lit(None).cast("string")), "e2_generic")
    out = single(V.of_means(mean, prior, vocab), "mean network, generic prior")
    out = out.unionByName(single(V.of_means(V.both_ways(mean), V.pooled_over(tied, x), vocab), "mean network, chunk network"))
    out = out.unionByName(single(V.of_means(mean, N.pooled(led), vocab), "mean network, lagged network"))
    out = out.unionByName(V.summary(V.by_account(one, tied), "account by account, chunk network"))
    out = out.unionByName(V.summary(V.by_account(edges, led), "account by account, lagged network"))
    out = out.unionByName(V.summary(V.by_account(V.residual(one), V.residual(tied.filter("src < dep"))), "residuals"))
    weights = cut_lineage(_study_weights(s, d, edges))
    agreed = V.rank_agreement(weights, "weighting", "weight")
    out = out.unionByName(V.summary(agreed.filter("one = 'density' and other = 'self_relevance'"), "density, self-relevance"))
    out = out.unionByName(V.summary(agreed.filter("one = 'density' and other = 'salience'"), "density, salience"))
    matrix = cut_lineage(_matrix(s, d, mean))
    ranks = cut_lineage(_personal(s, d, weights, matrix))
    out = out.unionByName(V.summary(V.between_accounts(ranks, "value", vocab).select(F.col("rho").alias("r")), "between accounts, personalised"))
    out = out.unionByName(V.summary(_against_base(s, d, ranks, matrix), "personalised, base"))
    return out.select("label", "n", *_r("mean", "lo", "hi"))


def _study_weights(s, d, edges):
    """The node weights of the accounts that have an ablation network."""
    w = _node_weights(s, d).filter("weighting != 'combined'").join(edges.select("account_hash").distinct(), "account_hash", "left_semi")
    return w.withColumn("weight", F.round("weight", 9))


def weight_agreement(s, d):
    """Rank correlation of an account's node weightings."""
    return V.rank_agreement(_study_weights(s, d, _edges(s, d)), "weighting", "weight").select("account_hash", "one", "other", *_r("r"))


def _personal(s, d, weights, matrix=None):
    got = N.personalised(matrix if matrix is not None else cut_lineage(_matrix(s, d)), weights.filter("weighting = 'density'"), _vocab(s, d), "account_hash")
    return got.select("account_hash", "name", F.round("value", 7).alias("value"))


def between_account_spearman(s, d):
    """An account's mean rank correlation with all others, of personalised PageRanks."""
    ranks = cut_lineage(_personal(s, d, _study_weights(s, d, _edges(s, d))))
    return V.between_accounts(ranks, "value", _vocab(s, d)).select("account_hash", "n", *_r("rho"))


def _against_base(s, d, ranks, matrix=None):
    base = N.sla(matrix if matrix is not None else cut_lineage(_matrix(s, d)), "network").select("name", F.round("value", 7).alias("base"))
    both = ranks.join(F.broadcast(base), "name")
    r = S.average_ranks(S.average_ranks(both, "value", ["account_hash"], "rx"), "base", ["account_hash"], "ry")
    return r.groupBy("account_hash").agg(S.pearson("rx", "ry").alias("r"))


def personalised_against_base(s, d):
    """Rank correlation of an account's personalised PageRank with the unweighted centrality."""
    return _against_base(s, d, cut_lineage(_personal(s, d, _study_weights(s, d, _edges(s, d))))).select("account_hash", *_r("r"))


QUERIES = {
    f.__name__: f
    for f in (
        e3_correlation_edges, e3_undirected_edges, e3_sparse_edges, e3_directed_edges, e3_contemporaneous_edges, e3_matrix, stacked_edges, pooled_e3, e1_e3_by_account, residual_convergence,
        prior_convergence, convergence_suite, weight_agreement, between_account_spearman, personalised_against_base,
    )
}

CELLS = """,
e3c as (select distinct account_hash, try_cast(split_part(trait, ':', 2) as bigint) as t from store where task = 'e3_chunk' and account_hash is not null and try_cast(split_part(trait, ':', 2) as bigint) is not null),
e3x as (select account_hash, try_cast(split_part(trait, ':', 2) as bigint) as t, rated as name, avg(rating) as x from ratings where task = 'e3_chunk' and account_hash is not null group by 1, 2, 3),
e3g as (select c.account_hash, c.t, v.name, x from e3c c cross join trait_vocab v left join e3x on e3x.account_hash = c.account_hash and e3x.t = c.t and e3x.name = v.name
  where c.account_hash in (select account_hash from e3c group by 1 having count(*) >= 5)),
e3m as (select account_hash, name, coalesce(avg(x), 0) as m, sqrt(coalesce(stddev_pop(x), 0) * coalesce(stddev_pop(x), 0) * count(x) / count(*)) as sd from e3g group by 1, 2),
e3z as (select g.account_hash, t, g.name, case when x is null or sd < 1e-5 then 0 else (x - m) / sd end as z from e3g g join e3m m on m.account_hash = g.account_hash and m.name = g.name),
e3e as (select a.account_hash, a.name as src, b.name as dep, avg(a.z * b.z) as weight from e3z a join e3z b on a.account_hash = b.account_hash and a.t = b.t and a.name <> b.name group by 1, 2, 3)"""
_SYM = """,
sym as (select account_hash, least(src, dep) as src, greatest(src, dep) as dep, sum(weight) / 2 as weight from edges group by 1, 2, 3)"""
_WEIGHTS = ACCOUNT_RANK[: ACCOUNT_RANK.index("walk as (")].rstrip().rstrip(",")
_STUDY = """,
wt as (select account_hash, weighting, name, round(w / sum(w) over (partition by account_hash, weighting), 9) as weight from tele join idx using (i)
  where weighting <> 'combined' and account_hash in (select account_hash from edges))"""
_RANKED = "rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0"
_PERSONAL = ACCOUNT_RANK[: ACCOUNT_RANK.rindex("\nselect account_hash")] + """,
pp as (select account_hash, name, round(sum(w * v) / sum(w), 7) as value from tele join walk on seed = tele.i and step = {n} join idx on idx.i = walk.i where weighting = 'density' and account_hash in (select account_hash from edges) group by 1, 2)""".replace("{n}", "200")

ORACLES = {
    "stacked_edges": "with " + EDGES + CELLS + """ select 'e1' as estimator, account_hash, src || '->' || dep as trait_pair, round(weight, 6) as weight, round(weight_sd, 6) as weight_sd, n_replicates from edges union all
select 'e2', account_hash, split_part(trait, '->', 1) || '->' || split_part(trait, '->', 2), round(avg(rating), 6), round(stddev_pop(rating), 6), count(rating) from ratings
where task = 'e2_pair' and rated = 'rating' and account_hash is not null and split_part(trait, '->', 1) <> split_part(trait, '->', 2) and split_part(trait, '->', 2) <> '' group by 2, 3
union all select 'e3', account_hash, src || '->' || dep, round(weight, 6), null, null from e3e""",
    "e3_correlation_edges": "with " + MATRIX + CELLS + "select account_hash, src, dep, round(weight, 6) as weight from e3e",
    "e3_matrix": "with " + MATRIX + CELLS.split("e3g as")[0].rstrip().rstrip(",") + """
select c.account_hash, c.t, count(x) filter (name in (select name from trait_vocab)) as n_seen, round(coalesce(sum(x) filter (name in (select name from trait_vocab)), 0), 4) as total
from e3c c left join e3x on e3x.account_hash = c.account_hash and e3x.t = c.t group by 1, 2""",
    "pooled_e3": "with " + MATRIX + CELLS + "select src, dep, round(sum(weight) / (select count(distinct account_hash) from e3c), 6) as weight, (select count(distinct account_hash) from e3c) as n_accounts from e3e group by 1, 2",
    "e1_e3_by_account": "with " + EDGES + CELLS + _SYM + f"select s.account_hash, count(*) as n, round({_pearson('s.weight', 'e.weight')}, 6) as r from sym s join e3e e on e.account_hash = s.account_hash and e.src = s.src and e.dep = s.dep group by 1",
    "residual_convergence": "with " + EDGES + CELLS + _SYM + f""",
ra as (select account_hash, src, dep, weight - avg(weight) over (partition by src, dep) as x from sym),
rb as (select account_hash, src, dep, weight - avg(weight) over (partition by src, dep) as y from e3e where src < dep),
per as (select ra.account_hash, {_pearson('x', 'y')} as r from ra join rb on ra.account_hash = rb.account_hash and ra.src = rb.src and ra.dep = rb.dep group by 1)
select 'residuals' as label, count(r) as n, round(avg(r), 6) as mean, round(min(r), 6) as lo, round(max(r), 6) as hi from per""",
    "prior_convergence": "with " + EDGES + f""",
gp as (select split_part(trait, '->', 1) as src, split_part(trait, '->', 2) as dep, avg(rating) as w from ratings where task = 'e2_generic' and rated = 'rating' group by 1, 2),
pr as (select coalesce(p.weight, 0) as x, coalesce(g.w, 0) as y from trait_vocab a join trait_vocab b on a.name <> b.name left join pooled p on p.src = a.name and p.dep = b.name left join gp g on g.src = a.name and g.dep = b.name)
select count(*) as n, round({_pearson('x', 'y')}, 6) as r from pr""",
    "weight_agreement": _WEIGHTS + _STUDY + f""",
rk as (select account_hash, weighting, name, {_RANKED.format(by='account_hash, weighting', x='weight')} as r from wt)
select a.account_hash, a.weighting as one, b.weighting as other, round({_pearson('a.r', 'b.r')}, 6) as r from rk a join rk b on a.account_hash = b.account_hash and a.name = b.name and a.weighting < b.weighting group by 1, 2, 3""",
    "between_account_spearman": _PERSONAL + f""",
rk as (select account_hash, name, {_RANKED.format(by='account_hash', x='value')} as r from pp),
prs as (select a.account_hash, b.account_hash as other, {_pearson('a.r', 'b.r')} as rho from rk a join rk b on a.name = b.name and a.account_hash <> b.account_hash group by 1, 2)
select a.account_hash, count(rho) as n, round(avg(rho), 6) as rho from (select distinct account_hash from rk) a left join prs using (account_hash) group by 1""",
    "personalised_against_base": _PERSONAL + """,
sl as (select i, 1.0 / sqrt(k::double) as v, 0 as step from idx
  union all
  select i, u / sqrt(sum(u * u) over ()) as v, step + 1 from (select w0.i, 0.85 * coalesce(sum(c.w * w.v), 0) + 0.15 * any_value(w0.v) as u, any_value(w0.step) as step
    from sl w0 left join cell c on c.ri = w0.i left join sl w on w.i = c.ci where w0.step < 500 group by w0.i)),""" + f"""
bs as (select account_hash, name, value, round(v, 7) as base from pp join idx using (name) join sl using (i) where step = 500),
rk as (select account_hash, {_RANKED.format(by='account_hash', x='value')} as rx, {_RANKED.format(by='account_hash', x='base')} as ry from bs)
select account_hash, round({_pearson('rx', 'ry')}, 6) as r from rk group by 1""",
}
