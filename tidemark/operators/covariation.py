"""Networks from covariation: shrunk partial correlations, graphical lasso, lag-1 regressions, per group.

A group is a table of rows t by k names (chunks by traits, vectors by dimensions; k at most ``WIDEST``).
Everything is fitted from second moments: of ``u = (x*x, x, seen, 1)`` per row for the undirected networks,
and of ``(x before, seen before, x, seen, 1)`` per pair of successive rows and fold for the lagged one.
Means, deviations, shrinkage, cross-validation errors and residuals are bilinear in them, so a group never
needs to be in one place. Groups of at most ``LONG`` rows add up their moments in one Arrow batch, longer
ones batch by batch on the map side and then entry by entry, with equal results.

Missing cells become the column mean (0 once standardised); constant columns stay 0; groups of fewer than
``least`` rows (5; 20 for lagged networks) give no edges. Null keys and null t are dropped, a cell given
twice counts with its mean. Formulas: Ledoit and Wolf (2004); Friedman, Hastie and Tibshirani (2008) solved by
ADMM (Boyd et al. 2011); cyclic coordinate descent for the lasso.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.history import ranked
from tidemark.session import ship

WIDEST = 512
#: Groups up to this many rows are taken into one batch.
LONG = 4096
#: Penalties of the graphical lasso and of the lasso path, most sweeps, least rows.
GLASSO_PENALTIES = np.geomspace(0.003, 0.6, 10)
PATH = np.geomspace(1.0, 1e-3, 12)
SWEEPS = 2000
LEAST = {"cov": 5, "pcor": 5, "glasso": 5, "lag1": 20, "contemporaneous": 20}


# -- moments ---------------------------------------------------------------


def row_moments(x: np.ndarray) -> np.ndarray:
    """``U'U`` of ``U = (x*x, x, seen, 1)``; missing cells are NaN."""
    seen = np.isfinite(x)
    filled = np.where(seen, x, 0.0)
    u = np.hstack([filled * filled, filled, seen, np.ones((len(x), 1))])
    return u.T @ u


def pair_moments(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``W'W`` of ``W = (x before, seen before, x, seen, 1)``."""
    a, b = np.isfinite(before), np.isfinite(after)
    w = np.hstack([np.where(a, before, 0.0), a, np.where(b, after, 0.0), b, np.ones((len(before), 1))])
    return w.T @ w


def fold_of(position: np.ndarray, n: int, folds: int) -> np.ndarray:
    """Contiguous folds of near-equal size; the first ones take what is left over."""
    base, rest = divmod(n, folds)
    return np.where(position < rest * (base + 1), position // (base + 1), rest + (position - rest * (base + 1)) // max(base, 1))


def n_folds(n_rows: int) -> int:
    return max(2, min(3, n_rows - 2))


class Columns:
    """Means and scales of the columns, from the row moments."""

    def __init__(self, u: np.ndarray):
        k = self.k = (len(u) - 1) // 3
        one = 3 * k
        self.n = float(u[one, one])
        seen, total, squares = u[2 * k : one, one], u[k : 2 * k, one], u[:k, one]
        self.mean = np.divide(total, seen, out=np.zeros(k), where=seen > 0)
        variance = (squares - 2 * self.mean * total + self.mean**2 * seen) / max(self.n, 1.0)
        fine = variance > 1e-12 * np.maximum(1.0, self.mean**2)
        self.scale = np.where(fine, 1 / np.sqrt(np.where(fine, variance, 1.0)), 0.0)


def standard_products(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``Z'Z``, ``(Z*Z)'(Z*Z)`` and the number of rows, Z being the standardised table."""
    c = Columns(u)
    k, m, w = c.k, c.mean, c.scale
    linear, square = np.zeros((len(u), k)), np.zeros((len(u), k))
    at = np.arange(k)
    linear[k + at, at], linear[2 * k + at, at] = w, -m * w
    square[at, at], square[k + at, at], square[2 * k + at, at] = w**2, -2 * m * w**2, m**2 * w**2
    return linear.T @ u @ linear, square.T @ u @ square, c.n


# -- undirected ------------------------------------------------------------


def ledoit_wolf(products: np.ndarray, squares: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """Shrunk covariance of centred rows and its shrinkage."""
    p = len(products)
    s = products / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, (squares / n - s**2).sum() / (p * n))
    shrink = 0.0 if beta <= 0 or delta == 0 else beta / delta
    return (1 - shrink) * s + shrink * mu * np.eye(p), shrink


def partial_correlation(cov: np.ndarray) -> np.ndarray:
    """``-P / sqrt(diag diag)`` of the pseudo-inverse, diagonal 0."""
    p = np.linalg.pinv(cov)
    d = np.sqrt(np.abs(np.diag(p)))
    scale = np.outer(d, d)
    out = np.where(scale > 0, -p / np.where(scale > 0, scale, 1), 0.0)
    np.fill_diagonal(out, 0.0)
    return out


def graphical_lasso(s: np.ndarray, penalty: float, steps: int = 3000, tol: float = 1e-6) -> tuple[np.ndarray, bool]:
    """Precision of an l1-penalised Gaussian likelihood, diagonal free, and whether it converged."""
    p = len(s)
    off = penalty * (1 - np.eye(p))
    z, u, rho = np.diag(1 / np.diag(s)), np.zeros((p, p)), 1.0
    for _ in range(steps):
        values, q = np.linalg.eigh(rho * (z - u) - s)
        theta = (q * ((values + np.sqrt(values**2 + 4 * rho)) / (2 * rho))) @ q.T
        before, a = z, theta + u
        z = np.sign(a) * np.maximum(np.abs(a) - off / rho, 0.0)
        u = a - z
        primal, dual = np.linalg.norm(theta - z), rho * np.linalg.norm(z - before)
        if max(primal, dual) < tol * p:
            return (z + z.T) / 2, True
        if primal > 10 * dual:
            rho, u = rho * 2, u / 2
        elif dual > 10 * primal:
            rho, u = rho / 2, u * 2
    return (z + z.T) / 2, False


def ebic_graphical_lasso(cov: np.ndarray, n: float, gamma: float = 0.0) -> tuple[np.ndarray, bool]:
    """Partial correlations at the penalty of least extended BIC; the densest fit where that one is
    (all but) empty, zeros where none can be fitted. With whether the chosen fit converged."""
    p = len(cov)
    s = cov + 1e-6 * np.eye(p)
    fits = []
    for penalty in GLASSO_PENALTIES:
        theta, sure = graphical_lasso(s, penalty)
        sign, logdet = np.linalg.slogdet(theta)
        if sign > 0 and np.isfinite(logdet):
            nonzero = int((np.abs(theta) > 1e-8).sum())
            edges = (nonzero - p) // 2
            score = -n * (logdet - np.trace(s @ theta)) + edges * np.log(n) + 4 * edges * gamma * np.log(p)
            fits.append((score, nonzero, theta, sure))
    if not fits:
        return np.zeros((p, p)), False
    chosen = min(fits, key=lambda f: f[0])
    if chosen[1] <= p + 2:
        chosen = max(fits, key=lambda f: f[1])
    d = np.sqrt(np.diag(chosen[2]))
    out = -chosen[2] / np.outer(d, d)
    np.fill_diagonal(out, 0.0)
    return out, chosen[3]


def undirected(u: np.ndarray, method: str) -> tuple[np.ndarray, bool]:
    products, squares, n = standard_products(u)
    if method == "cov":
        out = products / n
        np.fill_diagonal(out, 0.0)
        return out, True
    if method == "pcor":
        return partial_correlation(ledoit_wolf(products, squares, n)[0]), True
    return ebic_graphical_lasso(products / (n - 1), n)


# -- lagged ----------------------------------------------------------------


def lasso_columns(gram: np.ndarray, targets: np.ndarray, penalties: np.ndarray, sweeps: int = SWEEPS, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers of ``b' G b / 2 - b' t + penalty |b|`` for many targets (columns) over one Gram matrix, by
    coordinate descent; each column stops by itself. With the columns that converged."""
    b = np.zeros(targets.shape)
    diag, live = np.diag(gram), np.arange(targets.shape[1])
    use = np.flatnonzero(diag > 1e-12)
    for _ in range(sweeps):
        if not len(live):
            break
        t, penalty, own, most = targets[:, live], penalties[live], b[:, live], np.zeros(len(live))
        for j in use:
            r = t[j] - gram[j] @ own + diag[j] * own[j]
            new = np.sign(r) * np.maximum(np.abs(r) - penalty, 0.0) / diag[j]
            np.maximum(most, np.abs(new - own[j]), out=most)
            own[j] = new
        b[:, live] = own
        live = live[most >= tol]
    done = np.ones(targets.shape[1], bool)
    done[live] = False
    return b, done


class Lagged:
    """Centred sums of products of one set of successive rows, x before and y after."""

    def __init__(self, g: np.ndarray, k: int):
        self.n = float(g[-1, -1])
        self.sx, self.sy = g[:k, -1], g[k : 2 * k, -1]
        self.xx, self.xy, self.yy = g[:k, :k], g[:k, k : 2 * k], g[k : 2 * k, k : 2 * k]

    def around(self, mx, my):
        """``xx``, ``xy`` and ``yy`` about the given means."""
        n, sx, sy = self.n, self.sx, self.sy
        xx = self.xx - np.outer(mx, sx) - np.outer(sx, mx) + n * np.outer(mx, mx)
        xy = self.xy - np.outer(mx, sy) - np.outer(sx, my) + n * np.outer(mx, my)
        yy = self.yy - np.outer(my, sy) - np.outer(sy, my) + n * np.outer(my, my)
        return xx, xy, yy


def lag1(u: np.ndarray, folds: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """``[i, j]`` is the effect of column i one step earlier on column j, diagonal kept; with the
    covariance of the residuals, the number of pairs and whether every regression converged.

    One lasso per target, its penalty (12 down to a thousandth of the largest) of least mean error over
    contiguous folds.
    """
    c = Columns(u)
    k, m, w = c.k, c.mean, c.scale
    to = np.zeros((4 * k + 1, 2 * k + 1))
    at = np.arange(k)
    to[at, at], to[k + at, at] = w, -m * w
    to[2 * k + at, k + at], to[3 * k + at, k + at] = w, -m * w
    to[-1, -1] = 1.0
    parts = [to.T @ f @ to for f in folds]
    whole = Lagged(sum(parts), k)
    mx, my = whole.sx / whole.n, whole.sy / whole.n
    xx, xy, yy = whole.around(mx, my)
    top = np.abs(xy).max(0) / whole.n
    tiled = lambda a: np.tile(a, (1, len(PATH)))
    penalties = (PATH[:, None] * top).ravel()
    errors = np.zeros((len(PATH), k))
    for part in parts:
        held, rest = Lagged(part, k), Lagged(sum(parts) - part, k)
        if not held.n or not rest.n:
            continue
        tx, ty = rest.sx / rest.n, rest.sy / rest.n
        gram, target, _ = rest.around(tx, ty)
        b, _ = lasso_columns(gram / rest.n, tiled(target / rest.n), penalties, tol=1e-4)
        hx, hxy, hyy = held.around(tx, ty)
        missed = np.tile(np.diag(hyy), len(PATH)) - 2 * (tiled(hxy) * b).sum(0) + (b * (hx @ b)).sum(0)
        errors += missed.reshape(len(PATH), k) / held.n
    best = np.where(top > 0, PATH[errors.argmin(0)] * top, 1.0)
    b, done = lasso_columns(xx / whole.n, xy / whole.n, best, tol=1e-6)
    left = (yy - b.T @ xy - xy.T @ b + b.T @ xx @ b) / whole.n
    return b, left, whole.n, bool(done.all())


def lagged(u: np.ndarray, folds: Sequence[np.ndarray], method: str) -> tuple[np.ndarray, bool]:
    b, left, n, sure = lag1(u, folds)
    if method == "lag1":
        return b, sure
    d = np.sqrt(np.maximum(np.diag(left), 0.0))
    scale = np.divide(1.0, d, out=np.zeros(len(d)), where=d > 1e-9)
    corr = left * np.outer(scale, scale)
    corr[np.diag_indices(len(d))] = 1.0
    net, fitted = ebic_graphical_lasso(corr * n / (n - 1), n)
    return net, fitted and sure


LAGGED = ("lag1", "contemporaneous")


def fit(x: np.ndarray, method: str) -> tuple[np.ndarray, bool]:
    """The network of one table whose rows are in order."""
    u = row_moments(x)
    if method not in LAGGED:
        return undirected(u, method)
    n = len(x) - 1
    fold = fold_of(np.arange(n), n, n_folds(len(x)))
    return lagged(u, [pair_moments(x[:-1][fold == f], x[1:][fold == f]) for f in range(fold.max() + 1)], method)


# -- over groups -----------------------------------------------------------


def tables(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Long rows (key, t, name, x) as one array ``x`` per (key, t), in the order of ``names``."""
    cells = rows.filter(F.col(key).isNotNull() & F.col("t").isNotNull() & F.col("name").isin(*names)).groupBy(key, "t", "name").agg(F.avg("x").alias("x"))
    wide = cells.groupBy(key, "t").agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("m"))
    listed = F.array(*[F.lit(n) for n in names])
    return wide.select(key, "t", F.transform(listed, lambda n: F.try_element_at("m", n)).alias("x"))


def _array(column) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in r] for r in column], float)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial states (keys, s array) added up entry by entry, so that no key's states meet in one task first."""
    long = parts.select(*keys, F.posexplode("s").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda z: z["v"]).alias("s"))


def estimate(vectors: DataFrame, key: str, names: Sequence[str], method: str, least: int | None = None, long: int = LONG) -> DataFrame:
    """Edges (key, src, dep, weight, converged) of each group of rows (key, t, x array).

    ``method``: ``cov`` (correlations), ``pcor``, ``glasso``, ``lag1`` or ``contemporaneous``. ``t`` must be a number
    that orders the rows. Keys of more than ``long`` rows are few (at most the rows over ``long``); they are
    counted before they are broadcast.
    """
    if len(names) > WIDEST:
        raise ValueError(f"at most {WIDEST} names")
    ship(vectors.sparkSession)
    k, least = len(names), LEAST[method] if least is None else least
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, src string, dep string, weight double, converged boolean"
    listed, (i, j) = np.array(names, object), np.nonzero(~np.eye(k, dtype=bool))

    def edges(group, net, sure):
        import pandas as pd

        return pd.DataFrame({key: [group] * len(i), "src": listed[i], "dep": listed[j], "weight": net[i, j], "converged": sure})

    rows = vectors.filter(F.col(key).isNotNull() & F.col("t").isNotNull() & (F.size("x") == k)).select(key, "t", "x")
    counts = rows.groupBy(key).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= least)
    heavy = counts.filter(F.col("n_rows") > long).select(key)
    n_heavy = heavy.count()

    def whole(pdf):
        return edges(pdf[key].iloc[0], *fit(_array(pdf.sort_values("t")["x"]), method))

    light = rows.join(counts.filter(F.col("n_rows") <= long).select(key), key, "left_semi")
    if n_heavy:  # keep the heavy keys' rows out of the shuffle by key
        light = rows.join(F.broadcast(heavy) if n_heavy <= 1_000_000 else heavy, key, "left_anti").join(counts.select(key), key, "left_semi")
    # fits cost more than their bytes say: many small tasks, which are not merged, keep two of them off one core
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    apart = light.repartition(parts, key)
    out = apart.groupBy(key).applyInPandas(whole, schema)
    if not n_heavy:
        return out
    mine = rows.join(F.broadcast(heavy) if n_heavy <= 1_000_000 else heavy, key, "left_semi")

    def states(names_, make):
        def run(batches):
            import pandas as pd

            for pdf in batches:
                found = [(*(g if isinstance(g, tuple) else (g,)), make(p).ravel().tolist()) for g, p in pdf.groupby(names_, sort=False)]
                yield pd.DataFrame(found, columns=[*names_, "s"])

        return run

    u = _summed(mine.mapInPandas(states([key], lambda p: row_moments(_array(p["x"]))), f"`{key}` {kind}, s array<double>"), [key])
    if method not in LAGGED:

        def solve(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.concat([edges(g, *undirected(np.asarray(s).reshape(3 * k + 1, -1), method)) for g, s in zip(pdf[key], pdf["s"])])

        return out.unionByName(u.mapInPandas(solve, schema))
    placed = ranked(mine.withColumn("__tie", F.lit(0)), key, "t", "__tie", LONG).drop("__tie")
    before = placed.select(key, (F.col("position") + 1).alias("position"), F.col("x").alias("before"))
    n, f = F.col("group_size") - 1, F.lit(3)
    base, rest, at = F.floor(n / f), n % f, F.col("position") - 1
    fold = F.when(at < rest * (base + 1), F.floor(at / (base + 1))).otherwise(rest + F.floor((at - rest * (base + 1)) / base)).cast("int")
    pairs = placed.join(before, [key, "position"]).select(key, fold.alias("fold"), "before", "x")
    w = _summed(pairs.mapInPandas(states([key, "fold"], lambda p: pair_moments(_array(p["before"]), _array(p["x"]))), f"`{key}` {kind}, fold int, s array<double>"), [key, "fold"])
    both = w.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("fold", "s"))).alias("w")).join(u, key)

    def solve_lagged(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.concat([edges(g, *lagged(np.asarray(s).reshape(3 * k + 1, -1), [np.asarray(p["s"]).reshape(4 * k + 1, -1) for p in folds], method)) for g, s, folds in zip(pdf[key], pdf["s"], pdf["w"])])

    return out.unionByName(both.mapInPandas(solve_lagged, schema))


def pairwise(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rated, other (of the names, in alphabetical order), n, r, cov over all rows that have both.

    One state of sums of products a batch; the states are added up entry by entry.
    """
    k = len(names)
    if k > WIDEST:
        raise ValueError(f"at most {WIDEST} names")
    ship(vectors.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"g": [0], "s": [row_moments(_array(pdf["x"])).ravel().tolist()]})

    sums = _summed(vectors.select("x").mapInPandas(run, "g int, s array<double>"), ["g"])

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for s in pdf["s"]:
                u = np.asarray(s).reshape(3 * k + 1, -1)
                sq, x, seen = (slice(i * k, i * k + k) for i in range(3))
                n, sx, q, xy = u[seen, seen], u[x, seen], u[sq, seen], u[x, x]
                for i in range(k):
                    for j in range(k):
                        c = n[i, j]
                        if names[i] < names[j] and c > 0:
                            mx, my = sx[i, j] / c, sx[j, i] / c
                            both, vx, vy = xy[i, j] / c - mx * my, q[i, j] / c - mx * mx, q[j, i] / c - my * my
                            spread = np.sqrt(max(vx, 0.0)) * np.sqrt(max(vy, 0.0))
                            rows.append((names[i], names[j], int(c), both / spread if c >= 3 and spread > 1e-9 else None, both * c / (c - 1) if c > 1 else None))
            yield pd.DataFrame(rows, columns=["rated", "other", "n", "r", "cov"])

    return sums.mapInPandas(solve, "rated string, other string, n bigint, r double, cov double")


def moments(vectors: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """Per group and dimension the number of vectors, their mean and mean square; no vector of a
    group is gathered: each batch hands on one state per group, and dimensions are added up apart.
    Rows with a null key or an odd-sized vector are dropped."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for g, part in pdf.groupby(key, sort=False):
                x = np.stack(part[column].to_numpy()).astype(float)
                rows.append((g, len(x), x.sum(0).tolist(), (x * x).sum(0).tolist()))
            yield pd.DataFrame(rows, columns=[key, "n", "s", "q"])

    parts = vectors.filter(F.col(key).isNotNull() & (F.size(column) == width)).select(key, column).mapInPandas(run, f"`{key}` {kind}, n bigint, s array<double>, q array<double>")
    long = parts.select(key, "n", F.posexplode(F.arrays_zip("s", "q")).alias("dim", "z"))
    return long.groupBy(key, "dim").agg(F.sum("n").alias("n"), (F.sum("z.s") / F.sum("n")).alias("mean"), (F.sum("z.q") / F.sum("n")).alias("mean_square"))
