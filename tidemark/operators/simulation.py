"""Seeded graphs, histories and answers, and the recovery of what was planted.

Every random number is a hash of its own coordinates, so results depend on neither partitioning nor
engine; no process-salted hash is used. Cells of the grid are independent rows, one task's work each.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import covariation, networks
from tidemark.operators.ratings import hash_unit, vocabulary
from tidemark.session import ship

#: Chunks per volume and the noise that goes with it.
VOLUMES = {"thin": (14, 3.0), "medium": (36, 1.6), "thick": (72, 1.0)}
#: Spread of an answer's noise, of a generic answer's, share of the prior in a pair's answer, scale of the latent state, radius of the transition.
BASE_NOISE, GENERIC_NOISE, CONTAMINATION, LATENT_SCALE, RADIUS = 4.0, 3.0, 0.7, 3.0, 0.7
#: Densities and ranges of the planted graph and the prior (also in ``generic_prior`` and ``ground_truth``).
FORWARD, FEEDBACK, POSITIVE = 0.22, 0.12, 0.75


def generic_prior(vocab: DataFrame, seed: str) -> DataFrame:
    """Prior weight per ordered pair: base 2 to 10, more for antonyms and within a domain, at most 100."""
    a = vocab.select(F.col("trait_idx").alias("i"), F.col("name").alias("src"), F.col("domain").alias("da"), F.col("antonym").alias("anti"))
    b = vocab.select(F.col("trait_idx").alias("j"), F.col("name").alias("dep"), F.col("domain").alias("db"))
    vocabulary(vocab)  # checks the size of what is broadcast
    pairs = a.join(F.broadcast(b), F.col("i") != F.col("j"))
    u = lambda tag: hash_unit(F.concat_ws("|", F.lit(seed), F.lit(tag), "src", "dep"))
    base = 2 + 8 * u("base")
    anti = F.when(F.col("anti") == F.col("dep"), 35 + 20 * u("anti")).otherwise(0.0)
    domain = F.when((F.col("da") == F.col("db")) & (F.col("anti") != F.col("dep")), 10 + 15 * u("domain")).otherwise(0.0)
    return pairs.select("src", "dep", F.least(F.lit(100.0), base + anti + domain).alias("weight"))


def ground_truth(vocab: DataFrame, seed: str) -> DataFrame:
    """A near-acyclic graph: forward edges at .22, backward ones rarer and half as strong."""
    vocabulary(vocab)  # checks the size of what is broadcast
    order = vocab.select("name", "trait_idx", hash_unit(F.concat_ws("|", F.lit(seed), F.lit("order"), "name")).alias("o"))
    a = order.select(F.col("name").alias("src"), F.col("o").alias("oa"))
    b = order.select(F.col("name").alias("dep"), F.col("o").alias("ob"))
    u = lambda tag: hash_unit(F.concat_ws("|", F.lit(seed), F.lit(tag), "src", "dep"))
    forward = F.col("oa") < F.col("ob")
    there = F.when(forward, u("edge") < 0.22).otherwise(u("edge") < 0.22 * 0.12)
    size = (6 + 20 * u("size")) * F.when(forward, 1.0).otherwise(0.5)
    sign = F.when(u("sign") < 0.75, 1.0).otherwise(-1.0)
    return a.join(F.broadcast(b), F.col("src") != F.col("dep")).filter(there).select("src", "dep", (size * sign).alias("weight"))


def _unit(*parts) -> float:
    """``ratings.hash_unit`` of the parts joined by bars."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967295.0


def _normals(tag: str, n: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(tag.encode()).digest()[:8], "big")
    return np.random.Generator(np.random.PCG64(seed)).standard_normal(n)


def truth_matrix(names: list[str], seed: str) -> np.ndarray:
    """G17 as a matrix: the very graph of ``ground_truth``."""
    order = [_unit(seed, "order", n) for n in names]
    d = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i != j:
                forward = order[i] < order[j]
                if _unit(seed, "edge", a, b) < (FORWARD if forward else FORWARD * FEEDBACK):
                    d[i, j] = (6 + 20 * _unit(seed, "size", a, b)) * (1.0 if forward else 0.5) * (1.0 if _unit(seed, "sign", a, b) < POSITIVE else -1.0)
    return d


def prior_matrix(vocab: list[tuple[str, str, str]], seed: str) -> np.ndarray:
    """G16 as a matrix: the very prior of ``generic_prior``. ``vocab``: name, domain, antonym."""
    g = np.zeros((len(vocab), len(vocab)))
    for i, (a, da, anti) in enumerate(vocab):
        for j, (b, db, _) in enumerate(vocab):
            if i != j:
                more = 35 + 20 * _unit(seed, "anti", a, b) if anti == b else 10 + 15 * _unit(seed, "domain", a, b) if da == db else 0.0
                g[i, j] = min(100.0, 2 + 8 * _unit(seed, "base", a, b) + more)
    return g


def transition(d: np.ndarray) -> np.ndarray:
    """The graph scaled to a spectral radius of .7; a graph without cycles is scaled by its largest weight."""
    size = float(np.abs(np.linalg.eigvals(d)).max()) if len(d) else 0.0
    if size < 1e-9:
        size = float(np.abs(d).max(initial=0.0)) or 1.0
    return RADIUS * d / size


def history(d: np.ndarray, n: int, noise: float, tag: str) -> np.ndarray:
    """N latent states of a lag-1 process driven by the graph's transition, from 0."""
    a, k = transition(d), len(d)
    shocks = _normals(tag, n * k).reshape(n, k) * BASE_NOISE * (1 + noise)
    z = np.zeros((n, k))
    for t in range(1, n):
        z[t] = z[t - 1] @ a + shocks[t]
    return z


class Answers:
    """What a scorer that knows the graph answers to each of the six kinds of call.

    Ratings are clipped to the scale and whole numbers; every noise is seeded by the call it belongs to.
    """

    def __init__(self, d: np.ndarray, prior: np.ndarray, volume: str, noise: float, tag: str):
        self.d, self.prior, self.tag, self.k = d, prior, tag, len(d)
        self.n, self.times = VOLUMES[volume]
        self.spread = BASE_NOISE * self.times * (1 + noise)
        self.levels = np.array([15 + 70 * _unit(tag.split(":")[1] if ":" in tag else tag, "level", i) for i in range(self.k)])
        self.z = history(d, self.n, noise, tag + ":z")

    def _whole(self, values) -> np.ndarray:
        return np.round(np.clip(values, 0, 100))

    def _noise(self, *call) -> np.ndarray:
        return self.spread * _normals(":".join(map(str, (self.tag, *call))), self.k)

    def baseline(self, replicate: int) -> np.ndarray:
        return self._whole(self.levels + self._noise("baseline", replicate))

    def ablated(self, i: int, replicate: int) -> np.ndarray:
        return self._whole(self.levels - self.d[i] + self._noise("ablated", i, replicate))

    def pairs(self, replicate: int) -> np.ndarray:
        """All pairs at once, ``[i, j]`` the answer to i -> j."""
        noise = self.spread * _normals(f"{self.tag}:pairs:{replicate}", self.k**2).reshape(self.k, self.k)
        return self._whole(CONTAMINATION * self.prior + (1 - CONTAMINATION) * np.abs(self.d) + noise)

    def generic(self, replicate: int) -> np.ndarray:
        noise = GENERIC_NOISE * _normals(f"generic:{replicate}", self.k**2).reshape(self.k, self.k)
        return self._whole(self.prior + noise)

    def chunk(self, t: int, replicate: int) -> np.ndarray:
        return self._whole(self.levels + LATENT_SCALE * self.z[t] + self._noise("chunk", t, replicate))

    def brief(self) -> list[tuple[int, str]]:
        """Per name the number of quotes that bear on it, and their direction."""
        salience = np.abs(self.levels - 50) / 50
        return [(int(round(s * 6 / self.times)) + int(_unit(self.tag, "quotes", i) < 0.5), "for" if level >= 50 else "against") for i, (s, level) in enumerate(zip(salience, self.levels))]


def _off(m: np.ndarray) -> np.ndarray:
    return m[~np.eye(len(m), dtype=bool)]


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's r; None for a constant."""
    return None if x.std() < 1e-12 or y.std() < 1e-12 else float(np.corrcoef(x, y)[0, 1])


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


MEASURES = ("sla", "eigenvector", "pagerank", "out_strength", "in_strength", "out_strength_signed", "betweenness")
METRICS = ("edge_r_e1", "edge_r_e1_minus_generic", "edge_r_e2", "edge_r_e3_undirected", "edge_r_e3_directed", *(f"cent_rho_e1_{m}" for m in MEASURES), "e1_e3_sla_rho", "e1_e3_edge_r")


def recovered(answers: Answers, replicates: int = 3) -> dict[str, float | None]:
    """The estimators run on the answers, and how well each finds the planted graph."""
    d, k = answers.d, answers.k
    base = np.mean([answers.baseline(r) for r in range(replicates)], 0)
    e1 = np.stack([base - np.mean([answers.ablated(i, r) for r in range(replicates)], 0) for i in range(k)])
    e2, generic = (np.mean([f(r) for r in range(replicates)], 0) for f in (answers.pairs, answers.generic))
    x = np.stack([np.mean([answers.chunk(t, r) for r in range(replicates)], 0) for t in range(answers.n)])
    for m in (e1, e2, generic):
        np.fill_diagonal(m, 0.0)
    tied, _ = covariation.fit(x, "pcor")
    out: dict[str, float | None] = {
        "edge_r_e1": correlation(_off(e1), _off(d)), "edge_r_e1_minus_generic": correlation(_off(e1 - generic), _off(d)),
        "edge_r_e2": correlation(_off(e2), _off(np.abs(d))), "edge_r_e3_undirected": correlation(_off(tied), _off(np.abs(d))),
    }
    mine, true = networks.measures_of(e1), networks.measures_of(d)
    for m in MEASURES:
        out[f"cent_rho_e1_{m}"] = correlation(ranks(np.round(mine[m], 12)), ranks(np.round(true[m], 12)))
    if answers.n >= covariation.LEAST["lag1"]:
        e3, _ = covariation.fit(x, "lag1")
        np.fill_diagonal(e3, 0.0)
        out |= {"edge_r_e3_directed": correlation(_off(e3), _off(d)), "e1_e3_edge_r": correlation(_off(e1), _off(e3)), "e1_e3_sla_rho": correlation(ranks(np.round(mine["sla"], 12)), ranks(np.round(networks.sla_of(e3), 12)))}
    return out


def recovery(vocab: DataFrame, dags: int, volumes: list[str], noises: list[float], replicates: int, answers: int = 3, seed: str = "r") -> DataFrame:
    """Per cell of the grid, all metrics of recovery over the whole vocabulary; null where an
    estimator has too few chunks. One cell is one row and one task's work."""
    spark = vocab.sparkSession
    ship(spark)
    names = vocabulary(vocab)
    facts = {r["name"]: (r["domain"], r["antonym"]) for r in vocab.filter(F.col("name").isin(*names)).select("name", "domain", "antonym").toLocalIterator()}
    listed = [(n, *facts[n]) for n in names]
    grid = [(d, v, float(x), r) for d in range(dags) for v in volumes for x in noises for r in range(replicates)]
    cells = spark.createDataFrame(grid, "dag int, volume string, noise double, replicate int").repartition(len(grid), "dag", "volume", "noise", "replicate")
    schema = "dag int, volume string, noise double, replicate int, n_chunks int, " + ", ".join(f"{m} double" for m in METRICS)

    def run(batches):
        import pandas as pd

        prior, graphs = prior_matrix(listed, f"{seed}-prior"), {}
        for pdf in batches:
            rows = []
            for c in pdf.itertuples(index=False):
                if c.dag not in graphs:
                    graphs[c.dag] = truth_matrix(names, f"{seed}-truth-{c.dag}")
                a = Answers(graphs[c.dag], prior, c.volume, c.noise, f"{seed}:{c.dag}:{c.volume}:{c.noise}:{c.replicate}")
                got = recovered(a, answers)
                rows.append((c.dag, c.volume, c.noise, c.replicate, a.n, *(got.get(m) for m in METRICS)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return cells.mapInPandas(run, schema)


def summary(cells: DataFrame) -> DataFrame:
    """Means of every metric by volume and noise, nulls skipped."""
    return cells.groupBy("volume", "noise").agg(*[F.round(F.avg(c), 6).alias(c) for c in METRICS], F.count("*").alias("n"))
