"""Queries from calls to networks and their statistics, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import covariation as C, history as H, networks as N, ratings as R, statistics as S
from tidemark.session import cut_lineage
from tidemark.sources.tables import table


def _store(s, d):
    """One row a key; requests and usage, which no network needs, stay out of its shuffle."""
    return R.call_store(table(s, d, "calls").drop("request", "usage"))


def _ratings(s, d):
    return R.ratings(_store(s, d))


def _vocab(s, d):
    return table(s, d, "trait_vocab")


def _edges(s, d, rows=None):
    """E1 edges of every account that has a baseline."""
    return R.ablation_edges(rows if rows is not None else _ratings(s, d), _vocab(s, d))


def _pooled(s, d):
    return N.pooled(_edges(s, d)).select("src", "dep", "weight")


def _matrix(s, d, pooled=None):
    one = s.createDataFrame([("pooled",)], "network string")
    return N.matrices((pooled if pooled is not None else _pooled(s, d)).withColumn("network", F.lit("pooled")), _vocab(s, d), "network", listed=one)


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def call_store_dedupe(s, d):
    """The memoised store, one row a key."""
    return _store(s, d).groupBy("task", "model").agg(F.count("*").alias("n_keys"), F.count("response").alias("n_answered"), F.min("created_utc").alias("first_utc"))


KEY_FIELDS = ("account_hash", "prompt_version", "task", "trait", "replicate", "config_hash", "model")


def call_keys(s, d):
    """Canonical keys of the stored calls, over all seven fields that identify a call."""
    return _store(s, d).select("key", R.call_key({f: F.col(f) for f in KEY_FIELDS}).alias("call_key"))


def rating_rows(s, d):
    """ratings read from JSON, coerced and clipped."""
    return _ratings(s, d).filter("task != 'evidence_chunk'").select("key", "rated", "rating").distinct()


def replicate_ratings(s, d):
    """Means and deviations over replicates."""
    rows = _ratings(s, d).filter("task in ('e1_baseline', 'e1_ablate_elicit') and account_hash is not null")
    return R.replicate_stats(rows, "account_hash", "task", "trait", "rated").select("account_hash", "task", "trait", "rated", *_r("mean", "sd"), "n", "n_missing")


def ablation_edges(s, d):
    """A5: edges by leaving a trait out."""
    return _edges(s, d).select("account_hash", "src", "dep", *_r("weight", "weight_sd"), "n_replicates")


def pairwise_edges(s, d):
    """Edges asked for pair by pair, completed to all pairs of the vocabulary."""
    named = R.pair_edges(_ratings(s, d).filter("account_hash is not null"), "e2_pair")
    cells = R.grid(named.select("account_hash").distinct(), _vocab(s, d))
    return cells.join(named, ["account_hash", "src", "dep"], "left").select("account_hash", "src", "dep", F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"), F.coalesce("n", F.lit(0)).alias("n"))


def generic_prior(s, d):
    """The study-wide prior."""
    rows = _ratings(s, d).withColumn("account_hash", F.lit(None).cast("string"))
    return R.pair_edges(rows, "e2_generic").select("src", "dep", *_r("weight", "sd"), "n")


def pooled_network(s, d):
    """The mean network."""
    return N.pooled(_edges(s, d)).select("src", "dep", *_r("weight"), "n_accounts")


def edge_deviations(s, d):
    """What each account's network adds to the mean one."""
    return N.deviations(_edges(s, d)).select("account_hash", "src", "dep", *_r("deviation"))


def deviation_covariates(s, d):
    """Deviations with the evidence density of both ends."""
    dens = R.density(R.quotes(_store(s, d)), _vocab(s, d))
    return N.deviation_covariates(_edges(s, d), dens).select("account_hash", "src", "dep", *_r("abs_deviation", "density_source", "density_dep", "density_min"))


def symmetrised_network(s, d):
    """P10."""
    return N.symmetrised(_edges(s, d), "account_hash").select("account_hash", "a", "b", *_r("weight"))


def strengths(s, d):
    """G6, A15."""
    return N.strengths(_edges(s, d), "account_hash").select("account_hash", "name", *_r("out_strength", "in_strength", "out_strength_signed", "in_strength_signed"))


def matrix_pivot_unpivot(s, d):
    """Long to wide and back over every name of the vocabulary, self edges gone."""
    names = R.vocabulary(_vocab(s, d))
    wide = _pooled(s, d).groupBy("src").pivot("dep", names).agg(F.first("weight"))
    long = wide.unpivot("src", names, "dep", "weight").filter("weight is not null and src != dep")
    return long.select("src", "dep", *_r("weight"))


def pagerank(s, d):
    """G3, G4."""
    return N.pagerank(_matrix(s, d), "network").select("name", F.round("value", 8).alias("value"))


def personalised_pagerank(s, d):
    """G5 with one fixed teleport, likableness; by account: ``account_personalised_pagerank``."""
    like = {r["name"]: r["likableness"] for r in _vocab(s, d).select("name", "likableness").toLocalIterator()}
    m = _matrix(s, d).withColumn("t0", F.array(*[F.lit(float(like[n] or 0.0)) for n in R.vocabulary(_vocab(s, d))]))
    return N.pagerank(m, "network", teleport="t0").select("name", F.round("value", 8).alias("value"))


def _node_weights(s, d):
    """Every account of the store under each weighting; uniform where it has no rows."""
    st, vocab = _store(s, d), _vocab(s, d)
    kinds = {kind: R.node_weights(kind, st, vocab) for kind in ("density", "self_relevance", "salience")}
    known = None
    for kind, w in kinds.items():
        w = w.select("account_hash", "name", F.lit(kind).alias("weighting"), "weight")
        known = w if known is None else known.unionByName(w)
    names = F.array(*[F.lit(n) for n in R.vocabulary(vocab)])
    accounts = st.filter("account_hash is not null").select("account_hash").distinct()
    cells = accounts.select("account_hash", F.explode(names).alias("name"))
    wide = known.groupBy("account_hash", "name").agg(*[F.max(F.when(F.col("weighting") == kind, F.col("weight"))).alias(kind) for kind in kinds])
    filled = cells.join(wide, ["account_hash", "name"], "left").select("account_hash", "name", *[F.coalesce(kind, F.lit(1.0) / F.size(names)).alias(kind) for kind in kinds])
    both = filled.withColumn("combined", F.col("density") * F.col("self_relevance"))
    return both.unpivot(["account_hash", "name"], [*kinds, "combined"], "weighting", "weight")


def account_personalised_pagerank(s, d):
    """Every account's PageRank on the pooled network, by each of its node weightings."""
    got = N.personalised(_matrix(s, d), _node_weights(s, d), _vocab(s, d), "account_hash", "weighting")
    return got.select("account_hash", "weighting", "name", F.round("value", 8).alias("value"))


def sla_centrality(s, d):
    """G1."""
    return N.sla(_matrix(s, d), "network").select("name", F.round("value", 8).alias("value"))


def dense_centralities(s, d):
    """Eigenvector and betweenness."""
    return N.dense_centralities(_matrix(s, d), "network")


def _all_measures(s, d):
    """Every measure by expressions, and the matrix they come from; the pooled edges are written once."""
    pooled = cut_lineage(_pooled(s, d))
    m = cut_lineage(_matrix(s, d, pooled))
    st = N.strengths(pooled.withColumn("network", F.lit("pooled")), "network").unpivot(["network", "name"], ["out_strength", "in_strength", "out_strength_signed"], "measure", "value")
    return N.pagerank(m, "network").unionByName(N.sla(m, "network")).unionByName(st), m


def all_centralities(s, d):
    """Every measure, tidy; the personalised PageRank by the mean evidence density of the accounts."""
    rows, m = _all_measures(s, d)
    dens = R.density(R.quotes(_store(s, d)), _vocab(s, d)).groupBy("name").agg(F.avg("weight").alias("weight"))
    mean = N.personalised(m, dens.withColumn("network", F.lit("pooled")), _vocab(s, d), "network")
    return rows.unionByName(N.dense_centralities(m, "network")).unionByName(mean).select("name", "measure", F.round("value", 8).alias("value"))


def centrality_rank_corr(s, d):
    """Spearman correlation between measures."""
    rows = _all_measures(s, d)[0].withColumn("value", F.round("value", 7))
    ranks = S.average_ranks(rows, "value", ["measure"], "r").select("name", "measure", "r")
    both = ranks.join(ranks.select("name", F.col("measure").alias("other"), F.col("r").alias("q")), "name").filter("measure < other")
    return both.groupBy("measure", "other").agg(F.round(S.pearson("r", "q"), 6).alias("rho"))


def quote_rows(s, d):
    """C3."""
    return R.quotes(_store(s, d)).select("key", "name", "quote", "direction").distinct()


def quote_dedupe_rank(s, d):
    """O3."""
    return R.ranked_quotes(R.quotes(_store(s, d)).filter("account_hash is not null"), 2).select("account_hash", "name", "quote", "chunk", "direction", "rank")


def evidence_briefs(s, d):
    """C4: each account's brief, from the answers about its chunks."""
    return R.briefs(R.brief_quotes(_store(s, d), keep=3), _vocab(s, d)).select("account_hash", "n_quotes", F.md5("brief").alias("brief_md5"), F.length("brief").alias("n_chars"))


def evidence_density(s, d):
    """A10, A11."""
    return R.density(R.quotes(_store(s, d)), _vocab(s, d)).select("account_hash", "name", *_r("weight", digits=8))


def self_relevance_weights(s, d):
    """A12."""
    return R.self_relevance(_ratings(s, d), _vocab(s, d)).select("account_hash", "name", *_r("weight", digits=8))


def salience_weights(s, d):
    """Salience times density, normalised."""
    st = _store(s, d)
    sal = R.salience(R.ratings(st), st, _vocab(s, d))
    return R.combined(sal, R.density(R.quotes(st), _vocab(s, d))).select("account_hash", "name", *_r("weight", digits=8))


def chunk_matrix(s, d):
    """Mean rating per account, chunk and trait."""
    rows = _ratings(s, d).filter("task = 'e3_chunk' and account_hash is not null")
    return R.replicate_stats(rows, "account_hash", "trait", "rated").select("account_hash", F.col("trait").alias("chunk_id"), "rated", *_r("mean"), "n")


def standardise_matrix(s, d):
    """Z-scores of the chunk matrix by trait."""
    x = chunk_matrix(s, d).select("chunk_id", "rated", "mean")
    return S.standardised(x, "mean", ["rated"]).select("chunk_id", "rated", *_r("z"))


def chunk_matrix_by_model(s, d):
    """the chunk matrix of one model's answers, each model by itself."""
    st = _store(s, d).filter("task = 'e3_chunk' and account_hash is not null and model is not null")
    models = st.select("key", "model")
    rows = R.ratings(st).join(models, "key")
    return rows.groupBy("model", "rated").agg(F.count("rating").alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


def trait_correlations(s, d):
    """Correlation and sample covariance of traits over chunks, from sums of products."""
    names = R.vocabulary(_vocab(s, d))
    x = chunk_matrix(s, d).filter("mean is not null").select("account_hash", F.col("chunk_id").alias("t"), F.col("rated").alias("name"), F.col("mean").alias("x"))
    return C.pairwise(C.tables(x, "account_hash", names), names).select("rated", "other", "n", F.round("r", 5).alias("r"), F.round("cov", 6).alias("cov"))


def lag1_cross_moments(s, d):
    """Products of a trait with itself one chunk later, by account."""
    x = chunk_matrix(s, d).filter("mean is not null").withColumn("t", F.split_part("chunk_id", F.lit(":"), F.lit(2)).try_cast("bigint"))
    placed = H.ranked(x, ["account_hash", "rated"], "t", "chunk_id", 4096).select("account_hash", "rated", "position", "mean")
    before = placed.select("account_hash", "rated", (F.col("position") + 1).alias("position"), F.col("mean").alias("before"))
    lagged = placed.join(before, ["account_hash", "rated", "position"])
    return lagged.groupBy("rated").agg(F.count("*").alias("n"), F.round(F.avg(F.col("mean") * F.col("before")), 4).alias("moment"), F.round(S.pearson("before", "mean"), 6).alias("r"))


def anova_components(s, d):
    """Accounts by dependents for each left-out trait, and the off-target noise."""
    e = cut_lineage(_edges(s, d).select("account_hash", "src", "dep", "weight"))
    parts = S.two_way(e, "account_hash", "dep", "weight", ["src"])
    centred = e.join(e.groupBy("src", "dep").agg(F.avg("weight").alias("m")), ["src", "dep"]).withColumn("q", (F.col("weight") - F.col("m")) * (F.col("weight") - F.col("m")))
    noise = centred.groupBy("src").agg(F.percentile("q", 0.5).alias("off_target"))
    out = parts.join(noise, "src").withColumn("adjusted_rest", F.greatest(F.lit(0.0), F.col("sigma2_rest") - F.col("off_target")))
    cols = ["ms_row", "ms_col", "ms_rest", "sigma2_row", "sigma2_col", "sigma2_rest", "icc_rest", "icc_row", "off_target", "adjusted_rest"]
    return out.select("src", "n_rows", "n_cols", *_r(*cols, digits=4))


def variance_components(s, d):
    """The study's variance record over accounts and pairs, replicate noise taken off."""
    edges = cut_lineage(_edges(s, d).withColumn("weight_sd", F.coalesce("weight_sd", F.lit(0.0))))
    v = S.variance_partition(edges)
    return v.select("n_accounts", "n_pairs", *_r(*[c for c in v.columns if c not in ("n_accounts", "n_pairs")], digits=4))


def variance_record(s, d):
    """The variance record with its bootstrap intervals, flat, one row."""
    ci = bootstrap_icc(s, d).select("component", F.explode(F.array(F.struct(F.lit("lo").alias("end"), F.col("lo").alias("v")), F.struct(F.lit("hi").alias("end"), F.col("hi").alias("v")))).alias("e"))
    stats = ["icc_idiographic", "icc_account_only", "sigma2_pair", "sigma2_account_pair"]
    flat = ci.agg(*[F.max(F.when((F.col("component") == c) & (F.col("e.end") == end), F.col("e.v"))).alias(f"ci_{c}_{end}") for c in stats for end in ("lo", "hi")])
    return variance_components(s, d).withColumn("__one", F.lit(1)).join(flat.withColumn("__one", F.lit(1)), "__one").drop("__one")


def bootstrap_components(s, d):
    """A19 over a table of years and nations, 50 resamples; of accounts: ``bootstrap_icc``."""
    e = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cells = e.groupBy(F.year("o_orderdate").alias("y"), F.col("s_nationkey").alias("k")).agg(F.avg("l_quantity").alias("x"))
    draws = S.resamples(cells, "y", 50, "boot")
    rows = draws.join(cells, "y").select("boot", "draw", "k", "x")
    fit = S.two_way(rows, "draw", "k", "x", ["boot"])
    q = fit.agg(*[F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in ("sigma2_row", "sigma2_col", "sigma2_rest")])
    long = q.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c)[0].alias("lo"), F.col(c)[1].alias("hi")) for c in ("sigma2_row", "sigma2_col", "sigma2_rest")])).alias("e"))
    return long.select("e.component", F.round("e.lo", 4).alias("lo"), F.round("e.hi", 4).alias("hi"))


def bootstrap_icc(s, d):
    """500 resamples of the accounts of the edge table, intervals of both shares and both components."""
    edges = _edges(s, d).withColumn("weight_sd", F.coalesce("weight_sd", F.lit(0.0)))  # no replicate, no noise: as in the reference
    return S.bootstrap_shares(edges).select("component", *_r("lo", "hi", digits=4))


def mock_ratings(s, d):
    """Seeded ratings for every chunk and every trait."""
    chunks = table(s, d, "chunks").select("chunk_id").distinct()
    names = F.array(*[F.lit(n) for n in R.vocabulary(_vocab(s, d))])
    rows = chunks.select("chunk_id", F.explode(names).alias("name"))
    return rows.select("chunk_id", "name", R.mock_rating(F.concat_ws("|", "chunk_id", "name")).alias("rating"))


def vocabulary_checks(s, d):
    """The vocabulary's own rules: unique names, mutual antonyms, equal valences."""
    v = _vocab(s, d)
    mates = v.select(F.col("name").alias("antonym"), F.col("antonym").alias("back"))
    return v.join(mates, "antonym", "left").groupBy("domain").agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("n_names"), F.count_if(F.col("back") == F.col("name")).alias("n_mutual"), F.count_if(F.col("valence") == "pos").alias("n_pos")
    )


QUERIES = {
    f.__name__: f
    for f in (
        call_store_dedupe, call_keys, rating_rows, replicate_ratings, ablation_edges, pairwise_edges, generic_prior, pooled_network, edge_deviations,
        deviation_covariates, symmetrised_network, strengths, matrix_pivot_unpivot, pagerank, personalised_pagerank, account_personalised_pagerank, sla_centrality, dense_centralities, all_centralities,
        centrality_rank_corr, quote_rows, quote_dedupe_rank, evidence_briefs, evidence_density, self_relevance_weights, salience_weights, chunk_matrix, chunk_matrix_by_model, standardise_matrix, trait_correlations,
        lag1_cross_moments, anova_components, variance_components, variance_record, bootstrap_components, bootstrap_icc, mock_ratings, vocabulary_checks,
    )
}

STORE = """
store as (select * exclude (rn) from (select *, row_number() over (partition by key order by created_utc nulls first, coalesce(response, '')) as rn from calls where key is not null) where rn = 1),
obj as (select key, account_hash, task, trait, replicate, case when json_valid(j) then j else '{}' end as j from (select *, regexp_extract(response, '(?s)\\{.*\\}') as j from store where response is not null))"""
RATINGS = STORE + """,
vals as (select o.key as key, account_hash, task, trait, replicate, je.key as rated, try_cast(je.value->>'$' as double) as v from obj o, json_each(o.j) je),
ratings as (select key, account_hash, task, trait, replicate, rated, case when v is not null and not isnan(v) then greatest(0, least(100, v)) end as rating from vals)"""
EDGES = RATINGS + """,
base as (select account_hash, rated as dep, avg(rating) as full_mean from ratings where task = 'e1_baseline' group by 1, 2),
cut as (select account_hash, trait as src, rated as dep, avg(rating) as without_mean, stddev_pop(rating) as weight_sd, count(rating) as n_replicates from ratings where task = 'e1_ablate_elicit' group by 1, 2, 3),
heads as (select distinct account_hash, src from cut where account_hash in (select account_hash from base where account_hash is not null) and src in (select name from trait_vocab)),
edges as (select h.account_hash, h.src, v.name as dep, coalesce(full_mean - without_mean, 0.0) as weight, weight_sd, coalesce(n_replicates, 0) as n_replicates
  from heads h cross join trait_vocab v left join base b on b.account_hash = h.account_hash and b.dep = v.name left join cut c on c.account_hash = h.account_hash and c.src = h.src and c.dep = v.name where v.name <> h.src),
pooled as (select src, dep, avg(weight) as weight, count(weight) as n_accounts from edges group by 1, 2)"""
QUOTES = STORE + """,
lists as (select o.key as key, account_hash, trait as chunk, je.key as name, case when json_valid(je.value::varchar) then je.value::varchar else '[]' end as l from obj o, json_each(o.j) je where o.task = 'evidence_chunk'),
qs as (select l.key as key, account_hash, chunk, name, case when json_type(q.value) = 'OBJECT' then q.value->>'$.quote' end as quote0, case when json_type(q.value) = 'OBJECT' then lower(q.value->>'$.direction') end as dir0
  from lists l, json_each(case when json_type(l.l) = 'ARRAY' then l.l else '[]' end) q),
quotes as (select key, account_hash, chunk, name, substr(trim(quote0), 1, 240) as quote, case when dir0 in ('for', 'against') then dir0 else 'for' end as direction from qs where trim(quote0) <> '')"""


def _weights(cells: str, value: str) -> str:
    return f"select account_hash, name, round(({value} + 1) / sum({value} + 1) over (partition by account_hash), 8) as weight from {cells}"


DENSITY_CELLS = """,
dens as (select a.account_hash, v.name, coalesce(n, 0)::double as value from (select distinct account_hash from quotes where account_hash is not null) a cross join trait_vocab v
  left join (select account_hash, name, count(*) as n from quotes group by 1, 2) q on q.account_hash = a.account_hash and q.name = v.name),
density as (select account_hash, name, (value + 1) / sum(value + 1) over (partition by account_hash) as weight from dens)"""

_IDX = """,
idx as (select name, row_number() over (order by trait_idx) as i, count(*) over () as k, likableness from trait_vocab),
cell as (select a.i as ri, b.i as ci, abs(weight) as w from pooled p join idx a on a.name = src join idx b on b.name = dep),
colsum as (select i as ci, coalesce(sum(w), 0) as s, any_value(k) as k from idx left join cell on ci = i group by i),
p as (select r.i as ri, c.ci, case when c.s > 0 then coalesce(w, 0) / c.s else 1.0 / c.k end as p from idx r cross join colsum c left join cell x on x.ri = r.i and x.ci = c.ci)"""


def _rank(teleport: str) -> str:
    return "with recursive " + EDGES + _IDX + f""",
tele as (select i, {teleport} as t from idx),
walk as (select i, 1.0 / k::double as v, 0 as step from idx
  union all
  select i, u / sum(u) over () as v, step + 1 from (select p.ri as i, 0.85 * sum(p.p * w.v) + 0.15 * any_value(t.t) as u, any_value(w.step) as step from walk w join p on p.ci = w.i join tele t on t.i = p.ri where w.step < 250 group by p.ri))
select name, round(v, 8) as value from walk join idx using (i) where step = 250"""


ACCOUNT_RANK = "with recursive " + EDGES + QUOTES[len(STORE):] + DENSITY_CELLS + _IDX + """,
f as (select account_hash, rated as name, rating from (select *, row_number() over (partition by account_hash, rated order by replicate nulls first, key) as rn from ratings where task = 'e1_baseline') where rn = 1),
rs as (select account_hash, count(response) as n from store where task = 'e3_chunk' group by 1),
sm as (select account_hash, rated as name, sum(coalesce(abs(rating - 50), 0)) / any_value(n) as s from ratings join rs using (account_hash) where task = 'e3_chunk' group by 1, 2),
raw as (select a.account_hash, name, i, k, coalesce(density.weight, 1.0 / k::double) as density, coalesce(abs(rating - 50) / 50 * 100, 0)::double + 1 as sr, coalesce(s, 0)::double + 1 as sl
  from (select distinct account_hash from store where account_hash is not null) a cross join idx left join density using (account_hash, name) left join f using (account_hash, name) left join sm using (account_hash, name)),
tele as (select account_hash, 'density' as weighting, i, density as w from raw union all select account_hash, 'self_relevance', i, sr from raw union all select account_hash, 'salience', i, sl from raw union all select account_hash, 'combined', i, density * sr from raw),
walk as (select a.i as seed, b.i, 1.0 / b.k::double as v, 0 as step from idx a cross join idx b
  union all
  select seed, i, u / sum(u) over (partition by seed) as v, step + 1 from (select w.seed, p.ri as i, 0.85 * sum(p.p * w.v) + case when p.ri = w.seed then 0.15 else 0 end as u, any_value(w.step) as step from walk w join p on p.ci = w.i where w.step < 200 group by w.seed, p.ri))
select account_hash, weighting, name, round(sum(w * v) / sum(w), 8) as value from tele join walk on seed = tele.i and step = 200 join idx on idx.i = walk.i group by 1, 2, 3"""

SLA = "with recursive " + EDGES + _IDX + """,
walk as (select i, 1.0 / sqrt(k::double) as v, 0 as step from idx
  union all
  select i, u / sqrt(sum(u * u) over ()) as v, step + 1 from (select w0.i, 0.85 * coalesce(sum(c.w * w.v), 0) + 0.15 * any_value(w0.v) as u, any_value(w0.step) as step
    from walk w0 left join cell c on c.ri = w0.i left join walk w on w.i = c.ci where w0.step < 500 group by w0.i))
select name, round(v, 8) as value from walk join idx using (i) where step = 500"""

MATRIX = RATINGS + """,
x as (select account_hash, trait as chunk_id, rated, avg(rating) as mean, count(rating) as n from ratings where task = 'e3_chunk' and account_hash is not null group by 1, 2, 3)"""

_STR = """,
st as (select account_hash, name, sum(case when o = 1 then abs(weight) else 0 end) as out_strength, sum(case when o = 0 then abs(weight) else 0 end) as in_strength, sum(case when o = 1 then weight else 0 end) as out_strength_signed, sum(case when o = 0 then weight else 0 end) as in_strength_signed
  from (select account_hash, src as name, 1 as o, weight from edges union all select account_hash, dep, 0, weight from edges) group by 1, 2)"""


def _pearson(x, y):
    return f"case when count(*) filter ({x} is not null and {y} is not null) >= 3 and stddev_pop({x}) * stddev_pop({y}) > 1e-12 then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end"


def _ranks(x, by):
    return f"rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0"


_TWO_WAY = """
tw as (select {k}, count(*) as n, sum(x) as s, sum(x * x) as q, count(distinct rw) as r, count(distinct cl) as c from cells group by {k}),
tr as (select {k}, sum(s * s / n) as qr from (select {k}, rw, sum(x) as s, count(*) as n from cells group by {k}, rw) group by {k}),
tc as (select {k}, sum(s * s / n) as qc from (select {k}, cl, sum(x) as s, count(*) as n from cells group by {k}, cl) group by {k}),
ms as (select {k}, r, c, (qr - s * s / n) / nullif(r - 1, 0) as ms_row, (qc - s * s / n) / nullif(c - 1, 0) as ms_col, (q - qr - qc + s * s / n) / nullif((r - 1) * (c - 1), 0) as ms_rest from tw join tr using ({k}) join tc using ({k})),
sg as (select *, greatest(0, (ms_row - ms_rest) / c) as sigma2_row, greatest(0, (ms_col - ms_rest) / r) as sigma2_col, greatest(0, ms_rest) as sigma2_rest from ms)"""

ORACLES = {
    "call_store_dedupe": "with " + STORE + "select task, model, count(*) as n_keys, count(response) as n_answered, min(created_utc) as first_utc from store group by 1, 2",
    "call_keys": "with " + STORE + "select key, sha256('{' || " + " || ',' || ".join(
        f"'\"{f}\":' || coalesce({f}::varchar, 'null')" if f == "replicate" else f"'\"{f}\":' || coalesce('\"' || {f} || '\"', 'null')" for f in sorted(KEY_FIELDS)
    ) + " || '}') as call_key from store",
    "rating_rows": "with " + RATINGS + "select distinct key, rated, rating from ratings where task <> 'evidence_chunk'",
    "replicate_ratings": "with " + RATINGS + """select account_hash, task, trait, rated, round(avg(rating), 6) as mean, round(stddev_pop(rating), 6) as sd, count(rating) as n, count(*) - count(rating) as n_missing
from ratings where task in ('e1_baseline', 'e1_ablate_elicit') and account_hash is not null group by 1, 2, 3, 4""",
    "ablation_edges": "with " + EDGES + "select account_hash, src, dep, round(weight, 6) as weight, round(weight_sd, 6) as weight_sd, n_replicates from edges",
    "pairwise_edges": "with " + RATINGS + """,
e as (select account_hash, split_part(trait, '->', 1) as src, split_part(trait, '->', 2) as dep, avg(rating) as w, count(rating) as n from ratings where task = 'e2_pair' and rated = 'rating' and account_hash is not null and split_part(trait, '->', 1) <> split_part(trait, '->', 2) and split_part(trait, '->', 2) <> '' group by 1, 2, 3),
g as (select account_hash, a.name as src, b.name as dep from (select distinct account_hash from e) cross join trait_vocab a cross join trait_vocab b where a.name <> b.name)
select account_hash, src, dep, round(coalesce(w, 0), 6) as weight, coalesce(n, 0) as n from g left join e using (account_hash, src, dep)""",
    "generic_prior": "with " + RATINGS + """select split_part(trait, '->', 1) as src, split_part(trait, '->', 2) as dep, round(avg(rating), 6) as weight, round(stddev_pop(rating), 6) as sd, count(rating) as n
from ratings where task = 'e2_generic' and rated = 'rating' and split_part(trait, '->', 1) <> split_part(trait, '->', 2) and split_part(trait, '->', 2) <> '' group by 1, 2""",
    "pooled_network": "with " + EDGES + "select src, dep, round(weight, 6) as weight, n_accounts from pooled",
    "edge_deviations": "with " + EDGES + "select account_hash, src, dep, round(e.weight - p.weight, 6) as deviation from edges e join pooled p using (src, dep)",
    "deviation_covariates": "with " + EDGES + QUOTES[len(STORE):] + DENSITY_CELLS + """
select e.account_hash, e.src, e.dep, round(abs(e.weight - p.weight), 6) as abs_deviation, round(a.weight, 6) as density_source, round(b.weight, 6) as density_dep, round(least(a.weight, b.weight), 6) as density_min
from edges e join pooled p using (src, dep) left join density a on a.account_hash = e.account_hash and a.name = e.src left join density b on b.account_hash = e.account_hash and b.name = e.dep""",
    "symmetrised_network": "with " + EDGES + "select account_hash, least(src, dep) as a, greatest(src, dep) as b, round(sum(weight) / 2, 6) as weight from edges group by 1, 2, 3",
    "strengths": "with " + EDGES + _STR + "select account_hash, name, round(out_strength, 6) as out_strength, round(in_strength, 6) as in_strength, round(out_strength_signed, 6) as out_strength_signed, round(in_strength_signed, 6) as in_strength_signed from st",
    "matrix_pivot_unpivot": "with " + EDGES + "select src, dep, round(weight, 6) as weight from pooled where src <> dep",
    "pagerank": _rank("1.0 / k::double"),
    "personalised_pagerank": _rank("likableness / sum(likableness) over ()"),
    "account_personalised_pagerank": ACCOUNT_RANK,
    "sla_centrality": SLA,
    "quote_rows": "with " + QUOTES + "select distinct key, name, quote, direction from quotes",
    "quote_dedupe_rank": "with " + QUOTES + """,
n as (select *, substr(regexp_replace(lower(quote), '\\s+', ' ', 'g'), 1, 120) as norm from quotes where account_hash is not null),
o as (select * from (select *, row_number() over (partition by account_hash, name, norm order by length(quote) desc, chunk nulls first, key, quote, direction) as rn from n) where rn = 1),
l as (select * from (select *, row_number() over (partition by account_hash, name order by length(quote) desc, chunk nulls first, key, quote) as r from o) where r <= 4)
select account_hash, name, quote, chunk, direction, rank from (select *, row_number() over (partition by account_hash, name order by chunk nulls first, r) as rank from l) where rank <= 2""",
    "evidence_briefs": "with " + QUOTES + """,
n as (select *, substr(regexp_replace(lower(quote), '\\s+', ' ', 'g'), 1, 120) as norm from quotes where account_hash is not null),
o as (select * from (select *, row_number() over (partition by account_hash, name, norm order by length(quote) desc, chunk nulls first, key, quote, direction) as rn from n) where rn = 1),
l as (select * from (select *, row_number() over (partition by account_hash, name order by length(quote) desc, chunk nulls first, key, quote) as r from o) where r <= 6),
k as (select *, row_number() over (partition by account_hash, name order by chunk nulls first, r) as rank from l),
b as (select account_hash, name, count(*) as n, string_agg('- ' || direction || ': "' || quote || '"' || coalesce(' (' || chunk || ')', ''), chr(10) order by rank) as lines from k where rank <= 3 and name in (select name from trait_vocab) group by 1, 2),
w as (select a.account_hash, trait_idx, coalesce(n, 0) as n, '# ' || v.name || coalesce(chr(10) || lines, ': nothing found') as part from (select distinct account_hash from b) a cross join trait_vocab v left join b on b.account_hash = a.account_hash and b.name = v.name),
t as (select account_hash, cast(sum(n) as bigint) as n_quotes, string_agg(part, chr(10) || chr(10) order by trait_idx) as brief from w group by 1)
select account_hash, n_quotes, md5(brief) as brief_md5, cast(length(brief) as int) as n_chars from t""",
    "evidence_density": "with " + QUOTES + DENSITY_CELLS + "select account_hash, name, round(weight, 8) as weight from density",
    "self_relevance_weights": "with " + RATINGS + """,
f as (select account_hash, rated as name, rating from (select *, row_number() over (partition by account_hash, rated order by replicate nulls first, key) as rn from ratings where task = 'e1_baseline' and account_hash is not null) where rn = 1),
c as (select a.account_hash, v.name, coalesce(abs(rating - 50) / 50 * 100, 0)::double as value from (select distinct account_hash from f) a cross join trait_vocab v left join f on f.account_hash = a.account_hash and f.name = v.name)
""" + _weights("c", "value"),
    "salience_weights": "with " + RATINGS + QUOTES[len(STORE):] + DENSITY_CELLS + """,
rs as (select account_hash, count(response) as n from store where task = 'e3_chunk' group by 1),
sm as (select account_hash, rated as name, sum(coalesce(abs(rating - 50), 0)) as s from ratings where task = 'e3_chunk' and account_hash is not null group by 1, 2),
mm as (select account_hash, name, s / n as m from sm join rs using (account_hash)),
sc as (select a.account_hash, v.name, coalesce(m, 0)::double as value from (select distinct account_hash from mm) a cross join trait_vocab v left join mm on mm.account_hash = a.account_hash and mm.name = v.name),
sw as (select account_hash, name, (value + 1) / sum(value + 1) over (partition by account_hash) as weight from sc),
pr as (select sw.account_hash, sw.name, sw.weight * d.weight as p from sw join density d on d.account_hash = sw.account_hash and d.name = sw.name)
select account_hash, name, round(p / sum(p) over (partition by account_hash), 8) as weight from pr""",
    "chunk_matrix": "with " + MATRIX + "select account_hash, chunk_id, rated, round(mean, 6) as mean, n from x",
    "standardise_matrix": "with " + MATRIX + """, y as (select chunk_id, rated, round(mean, 6) as mean from x),
m as (select rated, avg(mean) as m, stddev_pop(mean) as s from y group by 1)
select chunk_id, y.rated, round((coalesce(mean, m) - m) / case when s > 0 then s else 1 end, 6) as z from y join m using (rated)""",
    "chunk_matrix_by_model": "with " + RATINGS + "select model, rated, count(rating) as n, round(avg(rating), 6) as mean from ratings join (select key, model from store) using (key) where task = 'e3_chunk' and account_hash is not null and model is not null group by 1, 2",
    "trait_correlations": "with " + MATRIX + f""", y as (select account_hash, chunk_id, rated, round(mean, 6) as x from x where mean is not null and rated in (select name from trait_vocab))
select a.rated, b.rated as other, count(*) as n, round({_pearson('a.x', 'b.x')}, 5) as r, round(covar_samp(a.x, b.x), 6) as cov from y a join y b on a.account_hash = b.account_hash and a.chunk_id = b.chunk_id and a.rated < b.rated group by 1, 2""",
    "lag1_cross_moments": "with " + MATRIX + f""", y as (select rated, round(mean, 6) as mean, lag(round(mean, 6)) over (partition by account_hash, rated order by chunk_id) as before from x where mean is not null)
select rated, count(*) as n, round(avg(mean * before), 4) as moment, round({_pearson('before', 'mean')}, 6) as r from y where before is not null group by 1""",
    "anova_components": "with " + EDGES + ", cells as (select src, account_hash as rw, dep as cl, avg(weight) as x from edges group by 1, 2, 3)," + _TWO_WAY.format(k="src") + """,
nz as (select src, quantile_cont(q, 0.5) as off_target from (select e.src, (e.weight - p.weight) * (e.weight - p.weight) as q from edges e join pooled p using (src, dep)) group by 1)
select src, r as n_rows, c as n_cols, round(ms_row, 4) as ms_row, round(ms_col, 4) as ms_col, round(ms_rest, 4) as ms_rest, round(sigma2_row, 4) as sigma2_row, round(sigma2_col, 4) as sigma2_col, round(sigma2_rest, 4) as sigma2_rest,
       round(sigma2_rest / nullif(sigma2_row + sigma2_col + sigma2_rest, 0), 4) as icc_rest, round(sigma2_row / nullif(sigma2_row + sigma2_col + sigma2_rest, 0), 4) as icc_row, round(off_target, 4) as off_target,
       round(greatest(0, sigma2_rest - off_target), 4) as adjusted_rest from sg join nz using (src)""",
    "bootstrap_components": """with c0 as (select year(o_orderdate) as y, s_nationkey as k, avg(l_quantity) as x from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey group by 1, 2),
ys as (select y, row_number() over (order by y) - 1 as pos, count(*) over () as n from (select distinct y from c0)),
dr as (select b as boot, w as draw, ('0x' || substr(sha256('boot:' || b || ':' || w), 1, 8))::bigint % (select max(n) from ys) as pos from range(50) t(b), range((select max(n) from ys)) u(w)),
cells as (select boot, draw as rw, k as cl, avg(x) as x from dr join ys using (pos) join c0 using (y) group by 1, 2, 3),""" + _TWO_WAY.format(k="boot") + """
select component, round(quantile_cont(v, 0.025), 4) as lo, round(quantile_cont(v, 0.975), 4) as hi from (select 'sigma2_row' as component, sigma2_row as v from sg union all select 'sigma2_col', sigma2_col from sg union all select 'sigma2_rest', sigma2_rest from sg) group by 1""",
    "variance_components": "with " + EDGES + """,
c as (select account_hash, src || '->' || dep as pair, weight as x, coalesce(weight_sd, 0) * coalesce(weight_sd, 0) as var from edges),
m as (select *, avg(x) over () as g, avg(x) over (partition by account_hash) as rm, avg(x) over (partition by pair) as cm from c),
t as (select count(distinct account_hash) as na, count(distinct pair) as np, sum((rm - g) * (rm - g)) as ssa, sum((cm - g) * (cm - g)) as ssp, sum((x - rm - cm + g) * (x - rm - cm + g)) as sse, avg(var) as rep, quantile_cont((x - cm) * (x - cm), 0.5) as off from m),
q as (select *, ssa / greatest(na - 1, 1) as msa, ssp / greatest(np - 1, 1) as msp, sse / greatest((na - 1) * (np - 1), 1) as mse from t where na > 0),
v as (select *, greatest(0, (msa - mse) / np) as sa, greatest(0, (msp - mse) / na) as sp, greatest(0, mse - rep / 3) as sap from q)
select na as n_accounts, np as n_pairs, round(rep, 4) as sigma2_rep, round(sa, 4) as sigma2_account, round(sp, 4) as sigma2_pair, round(sap, 4) as sigma2_account_pair, round(off, 4) as sigma2_rep_offtarget,
       round((sa + sap) / nullif(sa + sp + sap, 0), 4) as icc_idiographic, round(sa / nullif(sa + sp + sap, 0), 4) as icc_account_only, round((sa + greatest(0, sap - off)) / nullif(sa + sp + greatest(0, sap - off), 0), 4) as icc_idiographic_adj from v""",
    "centrality_rank_corr": "with recursive " + EDGES + _IDX + f""",
pw as (select i, 1.0 / k::double as v, 0 as step from idx
  union all
  select i, u / sum(u) over () as v, step + 1 from (select p.ri as i, 0.85 * sum(p.p * w.v) + 0.15 / any_value(x.k) as u, any_value(w.step) as step from pw w join p on p.ci = w.i join idx x on x.i = p.ri where w.step < 250 group by p.ri)),
sw as (select i, 1.0 / sqrt(k::double) as v, 0 as step from idx
  union all
  select i, u / sqrt(sum(u * u) over ()) as v, step + 1 from (select w0.i, 0.85 * coalesce(sum(c.w * w.v), 0) + 0.15 * any_value(w0.v) as u, any_value(w0.step) as step
    from sw w0 left join cell c on c.ri = w0.i left join sw w on w.i = c.ci where w0.step < 500 group by w0.i)),
ps as (select name, sum(o) as out_strength, sum(i) as in_strength, sum(so) as out_strength_signed from (select src as name, abs(weight) as o, 0.0 as i, weight as so from pooled union all select dep, 0.0, abs(weight), 0.0 from pooled) group by 1),
ms as (select name, 'pagerank' as measure, round(v, 7) as value from pw join idx using (i) where step = 250 union all select name, 'sla', round(v, 7) from sw join idx using (i) where step = 500
  union all select name, 'out_strength', round(out_strength, 7) from ps union all select name, 'in_strength', round(in_strength, 7) from ps union all select name, 'out_strength_signed', round(out_strength_signed, 7) from ps),
rk as (select name, measure, {_ranks('value', 'measure')} as r from ms)
select a.measure, b.measure as other, round({_pearson('a.r', 'b.r')}, 6) as rho from rk a join rk b on a.name = b.name and a.measure < b.measure group by 1, 2""",
    "mock_ratings": """select chunk_id, name, greatest(0, least(100, round_even(('0x' || substr(sha256(chunk_id || '|' || name), 1, 8))::bigint / 4294967295.0::double * 100, 0))) as rating
from (select distinct chunk_id from chunks) cross join trait_vocab""",
    "vocabulary_checks": """select v.domain, count(*) as n, count(distinct v.name) as n_names, count(*) filter (m.antonym = v.name) as n_mutual, count(*) filter (v.valence = 'pos') as n_pos
from trait_vocab v left join trait_vocab m on m.name = v.antonym group by 1""",
}
