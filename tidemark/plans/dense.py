"""Queries of dense numerics and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import covariation as C, simulation as M
from tidemark.sources.tables import table


def _vectors(s, d):
    return table(s, d, "embeddings").select("label", F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("x"))


DIMENSIONS = [str(i) for i in range(64)]


def _by_label(s, d, method):
    return C.estimate(_vectors(s, d), "label", DIMENSIONS, method)


def embedding_covariance(s, d):
    """Correlations of all dimensions of the embeddings by label."""
    return _by_label(s, d, "cov").select("label", "src", "dep", F.round("weight", 6).alias("weight"))


def shrunk_partial_correlations(s, d):
    """By label, over all dimensions of the embeddings."""
    return _by_label(s, d, "pcor")


def graphical_lasso(s, d):
    """G11."""
    return _by_label(s, d, "glasso")


def lag1_regressions(s, d):
    """G12."""
    return _by_label(s, d, "lag1")


def contemporaneous_network(s, d):
    """The network of what the lag-1 regressions leave."""
    return _by_label(s, d, "contemporaneous")


def embedding_moments(s, d):
    """Means and mean squares of the embeddings by label and dimension, added up map-side."""
    m = C.moments(table(s, d, "embeddings"), "label", "embedding", 64)
    return m.select("label", "n", "dim", F.round("mean", 4).alias("mean"), F.round("mean_square", 4).alias("mean_square"))


def generic_prior_seeded(s, d):
    """G16."""
    return M.generic_prior(table(s, d, "trait_vocab"), "prior-1").select("src", "dep", F.round("weight", 6).alias("weight"))


def ground_truth_graph(s, d):
    """G17."""
    return M.ground_truth(table(s, d, "trait_vocab"), "truth-1").select("src", "dep", F.round("weight", 6).alias("weight"))


def recovery_cells(s, d):
    """Every metric of 2 graphs by the least and the most evidence."""
    return M.recovery(table(s, d, "trait_vocab"), 2, ["thin", "thick"], [0.0], 1)


def recovery_summary(s, d):
    """90 cells, 5 graphs by 3 volumes by 2 noises by 3 replicates, over the whole vocabulary."""
    return M.summary(M.recovery(table(s, d, "trait_vocab"), 5, ["thin", "medium", "thick"], [0.0, 0.25], 3))


QUERIES = {
    f.__name__: f
    for f in (embedding_covariance, shrunk_partial_correlations, graphical_lasso, lag1_regressions, contemporaneous_network, embedding_moments, generic_prior_seeded, ground_truth_graph, recovery_cells, recovery_summary)
}

_U = "(('0x' || substr(sha256('{s}|{t}|' || {x}), 1, 8))::bigint / 4294967295.0::double)"


def _u(seed, tag, x="a.name || '|' || b.name"):
    return _U.format(s=seed, t=tag, x=x)


ORACLES = {
    "embedding_moments": """select label, count(*) as n, cast(dim as int) as dim, round(avg(x), 4) as mean, round(avg(x * x), 4) as mean_square
from (select label, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings where label is not null and len(embedding) = 64) group by label, dim""",
    "embedding_covariance": """with e as (select label, vec_id, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings where label is not null and len(embedding) = 64),
big as (select label from e group by 1 having count(distinct vec_id) >= 5),
z as (select label, vec_id, dim, (x - avg(x) over w) / stddev_pop(x) over w as z from e where label in (from big) window w as (partition by label, dim))
select a.label, a.dim::varchar as src, b.dim::varchar as dep, round(avg(a.z * b.z), 6) as weight from z a join z b on a.label = b.label and a.vec_id = b.vec_id and a.dim <> b.dim group by 1, 2, 3""",
    "generic_prior_seeded": f"""select a.name as src, b.name as dep, round(least(100.0, 2 + 8 * {_u('prior-1', 'base')} + case when a.antonym = b.name then 35 + 20 * {_u('prior-1', 'anti')} else 0.0 end
 + case when a.domain = b.domain and a.antonym <> b.name then 10 + 15 * {_u('prior-1', 'domain')} else 0.0 end), 6) as weight from trait_vocab a join trait_vocab b on a.trait_idx <> b.trait_idx""",
    "ground_truth_graph": f"""with o as (select name, {_u('truth-1', 'order', 'name')} as o from trait_vocab),
p as (select a.name as src, b.name as dep, a.o < b.o as fwd, {_u('truth-1', 'edge')} as e, {_u('truth-1', 'size')} as z, {_u('truth-1', 'sign')} as g from o a join o b on a.name <> b.name)
select src, dep, round((6 + 20 * z) * case when fwd then 1.0 else 0.5 end * case when g < 0.75 then 1.0 else -1.0 end, 6) as weight from p where case when fwd then e < 0.22 else e < 0.22 * 0.12 end""",
}
