"""Edge tables and matrices: pooling, deviations, symmetry, strengths, pivots, centralities.

Edges are long rows (account_hash, src, dep, weight); ``weight`` of an edge says how far ``dep`` depends
on ``src``. Self edges are dropped. Centralities run over one row per network holding the k x k matrix
as arrays (k is the vocabulary, at most 256, which is checked), inside one expression, until two steps
differ by less than a tolerance or the steps are used up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ratings import vocabulary
from tidemark.session import ship


def pooled(edges: DataFrame) -> DataFrame:
    """Mean weight per pair over accounts."""
    return edges.filter("src != dep").groupBy("src", "dep").agg(F.avg("weight").alias("weight"), F.count("weight").alias("n_accounts"))


def enough(edges: DataFrame, least: int) -> DataFrame:
    """the edges where they come from at least ``least`` accounts, else none."""
    n = edges.agg(F.countDistinct("account_hash").alias("__n")).filter(F.col("__n") >= least).withColumn("__one", F.lit(1))
    return edges.withColumn("__one", F.lit(1)).join(F.broadcast(n), "__one", "left_semi").drop("__one")


def deviations(edges: DataFrame) -> DataFrame:
    """Each account's weight minus the pooled one."""
    return edges.join(pooled(edges).select("src", "dep", F.col("weight").alias("mean")), ["src", "dep"]).select("account_hash", "src", "dep", (F.col("weight") - F.col("mean")).alias("deviation"))


def deviation_covariates(edges: DataFrame, density: DataFrame) -> DataFrame:
    """Size of the deviations with the densities of both ends; the least skips a missing one."""
    rows = deviations(edges)
    a = density.select("account_hash", F.col("name").alias("src"), F.col("weight").alias("density_source"))
    b = density.select("account_hash", F.col("name").alias("dep"), F.col("weight").alias("density_dep"))
    out = rows.join(a, ["account_hash", "src"], "left").join(b, ["account_hash", "dep"], "left")
    return out.withColumns({"abs_deviation": F.abs("deviation"), "density_min": F.least("density_source", "density_dep")})


def symmetrised(edges: DataFrame, *keys: str) -> DataFrame:
    """P10: mean of an edge and its reverse, a missing one counting 0; pairs in alphabetical order."""
    pair = [F.least("src", "dep").alias("a"), F.greatest("src", "dep").alias("b")]
    return edges.filter("src != dep").select(*keys, *pair, "weight").groupBy(*keys, "a", "b").agg((F.sum("weight") / 2).alias("weight"))


def strengths(edges: DataFrame, *keys: str) -> DataFrame:
    """Out and in strengths, absolute and signed."""
    both = F.explode(F.array(F.struct(F.col("src").alias("name"), F.lit(1).alias("out")), F.struct(F.col("dep").alias("name"), F.lit(0).alias("out"))))
    rows = edges.filter("src != dep").select(*keys, both.alias("e"), "weight").select(*keys, "e.*", "weight")
    out = F.col("out") == 1
    zero = F.lit(0.0)
    return rows.groupBy(*keys, "name").agg(
        F.sum(F.when(out, F.abs("weight")).otherwise(zero)).alias("out_strength"),
        F.sum(F.when(~out, F.abs("weight")).otherwise(zero)).alias("in_strength"),
        F.sum(F.when(out, F.col("weight")).otherwise(zero)).alias("out_strength_signed"),
        F.sum(F.when(~out, F.col("weight")).otherwise(zero)).alias("in_strength_signed"),
    )


def matrices(edges: DataFrame, vocab: DataFrame, *keys: str, listed: DataFrame | None = None) -> DataFrame:
    """One row per network: ``m`` (array of rows, absent edges 0) in vocabulary order, and ``names``.

    ``listed``: the networks to return; those without an edge get a matrix of zeros. Without it, only
    networks that have edges are returned.
    """
    listed_names = vocabulary(vocab)
    k = len(listed_names)
    names = F.array(*[F.lit(n) for n in listed_names])
    at = lambda c: F.array_position(names, F.col(c))
    cells = edges.filter((F.col("src") != F.col("dep")) & F.col("src").isin(*listed_names) & F.col("dep").isin(*listed_names))
    by = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((at("src") * k + at("dep")).alias("at"), "weight"))).alias("w"))
    if listed is not None:
        by = listed.select(*keys).distinct().join(by, list(keys), "left")
    row = lambda i: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.coalesce(F.try_element_at("w", (i * k + j).cast("bigint")), F.lit(0.0)))
    return by.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(k)), row).alias("m"), names.alias("names"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: _dot(row, v))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _iterate(start: Column, steps: int, step, close) -> Column:
    """``step`` applied until ``close(new, old)``, at most ``steps`` times."""
    begin = F.struct(start.alias("v"), F.lit(False).alias("done"))

    def move(state, _):
        return F.when(state["done"], state).otherwise(_let(step(state["v"]), lambda u: F.struct(u.alias("v"), close(u, state["v"]).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, move, lambda state: state["v"])


def _long(df: DataFrame, keys: tuple[str, ...], measure: str) -> DataFrame:
    return df.select(*keys, F.explode(F.arrays_zip("names", F.col("v"))).alias("z")).select(*keys, F.col("z.names").alias("name"), F.lit(measure).alias("measure"), F.col("z.v").alias("value"))


def stochastic(m: Column, k: Column) -> Column:
    """Absolute weights over their column sums; a column of zeros becomes uniform. ``k``: the size of ``m``."""
    absolute = F.transform(m, lambda row: F.transform(row, lambda x: F.abs(x)))
    nothing = F.transform(F.sequence(F.lit(1), k), lambda _: F.lit(0.0))
    summed = lambda a: F.aggregate(a, nothing, lambda s, row: F.zip_with(s, row, lambda x, y: x + y))
    bound = _let(absolute, lambda a: F.struct(a.alias("a"), summed(a).alias("s")))
    return _let(bound, lambda x: F.transform(x["a"], lambda row: F.zip_with(row, x["s"], lambda w, t: F.when(t > 0, w / t).otherwise(F.lit(1.0) / k))))


def pagerank(networks: DataFrame, *keys: str, steps: int = 500, tol: float = 1e-12, alpha: float = 0.85, teleport: str | None = None) -> DataFrame:
    """``r = alpha P r + (1 - alpha) t``, renormalised, until it moves by less than ``tol`` in all.

    ``teleport``: a column with weights in vocabulary order; uniform where absent or all 0.
    """
    k = F.size("names")
    uniform = F.transform("names", lambda _: F.lit(1.0) / k)
    if teleport:
        t = _let(_total(F.col(teleport)), lambda s: F.when(s > 0, F.transform(F.col(teleport), lambda x: x / s)).otherwise(uniform))
    else:
        t = uniform

    def walk(x):  # x binds the matrix and the teleport, which would else be made anew in every step
        def step(v):
            raw = F.zip_with(_times(x["p"], v), x["t"], lambda a, b: alpha * a + (1 - alpha) * b)
            return _let(raw, lambda u: _let(_total(u), lambda s: F.transform(u, lambda y: y / s)))

        close = lambda u, v: _total(F.zip_with(u, v, lambda y, z: F.abs(y - z))) < tol
        return _iterate(uniform, steps, step, close)

    done = networks.withColumn("v", _let(F.struct(stochastic(F.col("m"), k).alias("p"), t.alias("t")), walk))
    return _long(done, keys, "ppagerank" if teleport else "pagerank")


def walks_of(a: np.ndarray, alpha: float = 0.85) -> np.ndarray:
    """Where walks end that always restart at one node: column j of ``(1 - alpha) (I - alpha P)^-1``."""
    m, k = np.abs(a), len(a)
    sums = m.sum(0)
    p = np.where(sums > 0, m / np.where(sums > 0, sums, 1.0), 1.0 / k)
    return (1 - alpha) * np.linalg.inv(np.eye(k) - alpha * p)


def personalised(networks: DataFrame, weights: DataFrame, vocab: DataFrame, *keys: str, alpha: float = 0.85) -> DataFrame:
    """Personalised PageRank of one network for every group of ``weights`` (keys, name, weight).

    The walk is linear in its teleport, so it is solved once per name as the only target (one k x k inverse,
    whatever the number of groups) and a group's result is their mean under its own weights. Every group must
    list the whole vocabulary; weights that add up to 0 count as uniform.
    """
    vocabulary(vocab)  # checks the size of what is broadcast
    ship(networks.sparkSession)
    index = vocab.select("name", F.dense_rank().over(Window.orderBy("trait_idx")).alias("i"))

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            found = [(walks_of(np.array([np.asarray(x, float) for x in m]), alpha).tolist(), list(names)) for m, names in zip(pdf["m"], pdf["names"])]
            yield pd.DataFrame(found, columns=["b", "names"])

    basis = networks.select("m", "names").mapInPandas(solve, "b array<array<double>>, names array<string>")
    own = weights.join(F.broadcast(index), "name").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "weight"))), lambda z: z["weight"]).alias("w"))
    share = _let(_total(F.col("w")), lambda s: F.transform("w", lambda x: F.when(s > 0, x / s).otherwise(F.lit(1.0) / F.size("w"))))
    done = own.withColumn("t", share).withColumn("__one", F.lit(1)).join(F.broadcast(basis.withColumn("__one", F.lit(1))), "__one").withColumn("v", _times(F.col("b"), F.col("t")))
    return _long(done, keys, "ppagerank")


def sla(networks: DataFrame, *keys: str, steps: int = 500, tol: float = 1e-10, delta: float = 0.85) -> DataFrame:
    """G1: damped power iteration on absolute weights until it moves by less than ``tol``; a vector of norm
    0 becomes 0. Start and weights are not negative, so the largest entry never is and no sign is to be
    turned."""
    k = F.size("names")
    start = F.transform("names", lambda _: F.lit(1.0) / F.sqrt(k.cast("double")))

    def walk(a):
        def step(v):
            raw = F.zip_with(_times(a, v), v, lambda x, y: delta * x + (1 - delta) * y)
            return _let(raw, lambda u: _let(F.sqrt(_dot(u, u)), lambda n: F.transform(u, lambda x: F.when(n > 1e-300, x / n).otherwise(F.lit(0.0)))))

        def close(u, v):
            return _let(F.zip_with(u, v, lambda x, y: x - y), lambda d: F.sqrt(_dot(d, d))) < tol

        return _iterate(start, steps, step, close)

    absolute = F.transform("m", lambda row: F.transform(row, lambda x: F.abs(x)))
    return _long(networks.withColumn("v", _let(absolute, walk)), keys, "sla")


def sla_of(a: np.ndarray, steps: int = 500, tol: float = 1e-10, delta: float = 0.85) -> np.ndarray:
    """G1 of one matrix, for matrices that are made in Python."""
    m, v = np.abs(a), np.full(len(a), 1 / np.sqrt(len(a)))
    for _ in range(steps):
        u = delta * (m @ v) + (1 - delta) * v
        norm = np.linalg.norm(u)
        if norm < 1e-300:
            return np.zeros(len(a))
        u = u / norm
        if np.linalg.norm(u - v) < tol:
            return u
        v = u
    return v


def pagerank_of(a: np.ndarray, steps: int = 500, tol: float = 1e-12, alpha: float = 0.85) -> np.ndarray:
    """G4 of one matrix, uniform teleport."""
    m = np.abs(a)
    sums, k = m.sum(0), len(a)
    p = np.where(sums > 0, m / np.where(sums > 0, sums, 1.0), 1.0 / k)
    v = np.full(k, 1.0 / k)
    for _ in range(steps):
        u = alpha * (p @ v) + (1 - alpha) / k
        u = u / u.sum()
        if np.abs(u - v).sum() < tol:
            return u
        v = u
    return v


def measures_of(a: np.ndarray) -> dict[str, np.ndarray]:
    """G8 of one matrix: every measure that needs no weights of nodes."""
    m = np.abs(a)
    return {
        "sla": sla_of(a), "eigenvector": eigenvector_of(a), "pagerank": pagerank_of(a), "out_strength": m.sum(1), "in_strength": m.sum(0),
        "out_strength_signed": a.sum(1), "betweenness": betweenness_of(a),
    }


def eigenvector_of(a: np.ndarray) -> np.ndarray:
    """Dominant eigenvector by size, real part, largest entry positive."""
    values, vectors = np.linalg.eig(np.abs(a))
    v = np.real(vectors[:, int(np.argmax(np.abs(values)))])
    return v * (np.sign(v[int(np.argmax(np.abs(v)))]) or 1.0)


def betweenness_of(a: np.ndarray) -> np.ndarray:
    """Directed betweenness over distances 1 / weight (Brandes, with Dijkstra), normalised."""
    import heapq

    k = len(a)
    out = np.zeros(k)
    near = [[(j, 1.0 / abs(a[i, j])) for j in range(k) if j != i and a[i, j] != 0] for i in range(k)]
    for s in range(k):
        dist, paths, before, order, done = [np.inf] * k, [0.0] * k, [[] for _ in range(k)], [], [False] * k
        dist[s], paths[s], heap = 0.0, 1.0, [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            order.append(v)
            for w, length in near[v]:
                new = d + length
                if new < dist[w] - 1e-12:
                    dist[w], paths[w], before[w] = new, paths[v], [v]
                    heapq.heappush(heap, (new, w))
                elif abs(new - dist[w]) <= 1e-12 and not done[w]:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = [0.0] * k
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    return out / ((k - 1) * (k - 2)) if k > 2 else out


def dense_centralities(networks: DataFrame, *keys: str) -> DataFrame:
    """G2, G7 by NumPy, batch by batch of whole networks."""
    ship(networks.sparkSession)
    schema = ", ".join([*(f"`{x}` {networks.schema[x].dataType.simpleString()}" for x in keys), "name string, measure string, value double"])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = np.array([np.asarray(x, float) for x in r.m])
                for measure, v in (("eigenvector", eigenvector_of(m)), ("betweenness", betweenness_of(m))):
                    rows += [(*(getattr(r, x) for x in keys), name, measure, float(value)) for name, value in zip(r.names, v)]
            yield pd.DataFrame(rows, columns=[*keys, "name", "measure", "value"])

    return networks.mapInPandas(run, schema)
