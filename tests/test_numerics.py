import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import covariation as C, networks as N, simulation as M, statistics as S


def rng(seed=0):
    return np.random.default_rng(seed)


def standardise(x):
    """Column z-scores with missing cells as the mean, the plain way."""
    mean = np.nanmean(x, axis=0)
    filled = np.where(np.isnan(x), mean, x)
    sd = filled.std(0)
    return (filled - filled.mean(0)) / np.where(sd > 0, sd, 1.0)


def holes(x, share=0.2, seed=20):
    return np.where(rng(seed).random(x.shape) < share, np.nan, x)


def test_moments_give_the_standardised_products():
    x = holes(50 + 20 * rng().normal(size=(60, 5)))
    x[:, 3] = 7.0
    z = standardise(x)
    products, squares, n = C.standard_products(C.row_moments(x))
    assert n == 60 and np.allclose(products, z.T @ z, atol=1e-8) and np.allclose(squares, (z**2).T @ (z**2), atol=1e-8)


def test_ledoit_wolf_and_partial_correlation():
    x = rng().normal(size=(400, 5))
    x[:, 1] = x[:, 0] + 0.3 * rng(1).normal(size=400)
    z = standardise(x)
    s, mu = z.T @ z / 400, np.trace(z.T @ z) / 400 / 5
    delta = ((s - mu * np.eye(5)) ** 2).sum()
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / 400**2  # the formula as published
    cov, shrink = C.ledoit_wolf(z.T @ z, (z**2).T @ (z**2), 400)
    assert np.isclose(shrink, min(beta, delta) / delta) and np.allclose(cov, (1 - shrink) * s + shrink * mu * np.eye(5))
    p, _ = C.fit(x, "pcor")
    assert p[0, 1] > 0.7 and abs(p[2, 3]) < 0.2 and np.allclose(np.diag(p), 0)


def test_lasso_satisfies_its_conditions():
    x = rng(2).normal(size=(80, 6))
    y = np.stack([x @ np.array([2.0, 0, 0, -1, 0, 0]), x @ np.array([0, 0, 1.0, 0, 0, 3])], 1) + 0.1 * rng(3).normal(size=(80, 2))
    gram, target = x.T @ x / 80, x.T @ y / 80
    b, done = C.lasso_columns(gram, target, np.array([0.1, 0.3]), tol=1e-12)
    slope = target - gram @ b
    assert done.all() and np.all(np.abs(slope) <= np.array([0.1, 0.3]) + 1e-6)
    assert np.allclose(slope[b != 0], (np.array([0.1, 0.3]) * np.sign(b))[b != 0], atol=1e-6)


def test_graphical_lasso_satisfies_its_conditions():
    s = np.corrcoef(rng(4).normal(size=(60, 6)) @ rng(5).normal(size=(6, 6)), rowvar=False)
    theta, sure = C.graphical_lasso(s, 0.1)
    gap = np.linalg.inv(theta) - s
    off = ~np.eye(6, dtype=bool)
    assert sure and np.all(np.abs(gap[off]) <= 0.1 + 1e-3)
    assert np.allclose(gap[off & (np.abs(theta) > 1e-6)], 0.1 * np.sign(theta)[off & (np.abs(theta) > 1e-6)], atol=1e-3)
    assert np.allclose(C.graphical_lasso(s, 1e-6)[0] @ s, np.eye(6), atol=2e-2)


def test_an_empty_choice_falls_back_to_the_densest_fit():
    x = rng(6).normal(size=(400, 6))
    net, _ = C.ebic_graphical_lasso(np.corrcoef(x, rowvar=False), 400, gamma=5.0)
    assert (np.abs(net) > 1e-8).sum() > 10


def test_lag1_finds_a_planted_effect():
    e, x = rng(5).normal(size=(300, 3)), np.zeros((300, 3))
    for t in range(1, 300):
        x[t] = [0.1 * x[t - 1, 0], 0.8 * x[t - 1, 0], 0] + e[t]
    b, sure = C.fit(x, "lag1")
    assert sure and b[0, 1] > 0.4 and abs(b[2, 1]) < 0.15 and abs(b[1, 0]) < 0.15


def test_lag1_from_moments_equals_plain_cross_validation():
    x = holes(rng(14).normal(size=(47, 6)).cumsum(0), 0.1)
    got, _ = C.fit(x, "lag1")
    z = standardise(x)
    before, after, n = z[:-1], z[1:], 46
    xc, yc = before - before.mean(0), after - after.mean(0)
    for j in range(6):
        penalties = C.PATH * np.abs(xc.T @ yc[:, j]).max() / n
        errors = np.zeros(12)
        for held in np.array_split(np.arange(n), 3):
            keep = np.setdiff1d(np.arange(n), held)
            a, mx, my = before[keep] - before[keep].mean(0), before[keep].mean(0), after[keep, j].mean()
            for i, penalty in enumerate(penalties):
                b = C.lasso_columns(a.T @ a / len(keep), (a.T @ (after[keep, j] - my) / len(keep))[:, None], np.array([penalty]), tol=1e-4)[0][:, 0]
                errors[i] += ((after[held, j] - my - (before[held] - mx) @ b) ** 2).mean()
        b = C.lasso_columns(xc.T @ xc / n, (xc.T @ yc[:, j] / n)[:, None], penalties[[errors.argmin()]], tol=1e-6)[0][:, 0]
        assert np.allclose(got[:, j], b, atol=1e-4)


def test_contemporaneous_network_is_that_of_the_residuals():
    e = rng(8).normal(size=(400, 3))
    e[:, 1] += e[:, 0]
    x = np.zeros((400, 3))
    for t in range(1, 400):
        x[t] = [0, 0, 0.6 * x[t - 1, 2]] + e[t]
    net, _ = C.fit(x, "contemporaneous")
    assert net[0, 1] > 0.4 and abs(net[0, 2]) < 0.15 and np.allclose(net, net.T, atol=1e-6)


def test_long_groups_equal_short_ones(spark):
    x = holes(rng(16).normal(size=(90, 4)).cumsum(0), 0.1)
    rows = [("a", 10 * t, [None if np.isnan(v) else float(v) for v in r]) for t, r in enumerate(x)] + [("b", t, [float(t % 3), float(t), 1.0, float(t * t % 7)]) for t in range(25)] + [("c", 0, [1.0] * 4), (None, 0, [1.0] * 4), ("d", 1, [1.0])]
    df = spark.createDataFrame(rows, "account string, t bigint, x array<double>").repartition(5)
    for method in C.LEAST:
        short = {(r.account, r.src, r.dep): r.weight for r in C.estimate(df, "account", list("wxyz"), method).collect()}
        long = {(r.account, r.src, r.dep): r.weight for r in C.estimate(df, "account", list("wxyz"), method, long=30).collect()}
        assert set(short) == set(long) and {a for a, *_ in short} == {"a", "b"} and len(short) == 24
        assert all(abs(short[k] - long[k]) < 1e-6 for k in short)


def test_pairwise_equals_numpy(spark):
    x = holes(rng(17).normal(size=(40, 3)))
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x], "x array<double>").repartition(4)
    for r in C.pairwise(df, ["b", "a", "c"]).collect():
        a, b = x[:, ["b", "a", "c"].index(r.rated)], x[:, ["b", "a", "c"].index(r.other)]
        ok = np.isfinite(a) & np.isfinite(b)
        assert r.n == ok.sum() and np.isclose(r.r, np.corrcoef(a[ok], b[ok])[0, 1]) and np.isclose(r.cov, np.cov(a[ok], b[ok])[0, 1])


def test_betweenness_and_eigenvector():
    path = np.zeros((3, 3))
    path[0, 1] = path[1, 2] = 1
    assert N.betweenness_of(path).tolist() == [0, 0.5, 0]
    a = np.abs(rng(6).normal(size=(6, 6)))
    v = N.eigenvector_of(a)
    assert np.allclose(a @ v / np.linalg.norm(a @ v), v / np.linalg.norm(v), atol=1e-6)


def _networks(spark, m):
    rows = [[float(x) for x in r] for r in m]
    return spark.createDataFrame([("n", rows, [str(i) for i in range(len(m))])], "network string, m array<array<double>>, names array<string>")


def test_power_iterations_match_numpy(spark):
    d = rng(7).normal(size=(8, 8)) * (rng(8).random((8, 8)) < 0.4)
    np.fill_diagonal(d, 0)
    df = _networks(spark, d)
    got = {r.name: r.value for r in N.pagerank(df, "network", steps=25).collect()}
    a = np.abs(d)
    p = np.where(a.sum(0) > 0, a / np.where(a.sum(0) > 0, a.sum(0), 1), 1 / 8)
    r = np.full(8, 1 / 8)
    for _ in range(25):
        r = 0.85 * p @ r + 0.15 / 8
        r /= r.sum()
    assert np.allclose([got[str(i)] for i in range(8)], r)
    assert abs(sum(got.values()) - 1) < 1e-8
    got = {r.name: r.value for r in N.sla(df, "network", steps=25).collect()}
    c = np.full(8, 1 / np.sqrt(8))
    for _ in range(25):
        c = 0.85 * a @ c + 0.15 * c
        c /= np.linalg.norm(c)
    assert np.allclose([got[str(i)] for i in range(8)], c)


def test_edgeless_network_follows_its_teleport(spark):
    df = _networks(spark, np.zeros((5, 5))).withColumn("t", F.array(*map(F.lit, (0.6, 0.1, 0.1, 0.1, 0.1))))
    got = {r.name: r.value for r in N.pagerank(df, "network", steps=10, teleport="t").collect()}
    assert max(got, key=got.get) == "0"


def test_every_account_walks_with_its_own_weights(spark):
    d = rng(11).normal(size=(6, 6)) * (rng(12).random((6, 6)) < 0.5)
    np.fill_diagonal(d, 0)
    own = {"a": rng(13).random(6), "b": np.eye(6)[2], "c": np.zeros(6)}
    vocab = spark.createDataFrame([(10 * i, str(i)) for i in range(6)], "trait_idx int, name string")
    weights = spark.createDataFrame([(a, str(i), float(x)) for a, w in own.items() for i, x in enumerate(w)], "account string, name string, weight double").repartition(5)
    got = {(r.account, r.name): r.value for r in N.personalised(_networks(spark, d), weights, vocab, "account").collect()}
    assert len(got) == 18
    a = np.abs(d)
    p = np.where(a.sum(0) > 0, a / np.where(a.sum(0) > 0, a.sum(0), 1), 1 / 6)
    for account, w in own.items():
        t = w / w.sum() if w.sum() > 0 else np.full(6, 1 / 6)
        r = np.full(6, 1 / 6)
        for _ in range(500):
            r = 0.85 * p @ r + 0.15 * t
        assert np.allclose([got[account, str(i)] for i in range(6)], r, atol=1e-12)


def _table(spark, sd_pair, sd_acct, sd_pattern, accounts=30, pairs=60):
    g = rng(9)
    p, a = g.normal(0, sd_pair, pairs), g.normal(0, sd_acct, accounts)
    x = 10 + p[None] + a[:, None] + g.normal(0, sd_pattern, (accounts, pairs))
    return spark.createDataFrame([(f"a{i}", f"p{j}", float(x[i, j])) for i in range(accounts) for j in range(pairs)], "account string, pair string, w double"), x


def test_two_way_components(spark):
    df, x = _table(spark, 5, 0.5, 0.5)
    r = S.two_way(df, "account", "pair", "w").first()
    n, m = x.shape
    rest = x - x.mean(1, keepdims=True) - x.mean(0, keepdims=True) + x.mean()
    assert np.isclose(r.ms_rest, (rest**2).sum() / ((n - 1) * (m - 1))) and r.icc_rest < 0.35 and r.sigma2_col > r.sigma2_rest
    df, _ = _table(spark, 1, 0.5, 4)
    assert S.two_way(df, "account", "pair", "w").first().icc_rest > 0.6


def test_bootstrap_shares_equal_a_plain_bootstrap(spark):
    n_a, n_p, n_boot = 12, 9, 40
    g = rng(15)
    x, sd = g.normal(size=(n_a, n_p)) + 2 * g.normal(size=n_p) + g.normal(size=(n_a, 1)), g.random((n_a, n_p)) * 0.3
    x[g.random(x.shape) < 0.3] = np.nan
    sd[0] = np.nan
    cells = [(f"a{i:02d}", f"s{j}", "t", float(x[i, j]), None if np.isnan(sd[i, j]) else float(sd[i, j])) for i in range(n_a) for j in range(n_p) if np.isfinite(x[i, j])]
    df = spark.createDataFrame(cells, "account_hash string, src string, dep string, weight double, weight_sd double")
    got = {r.component: (r.lo, r.hi) for r in S.bootstrap_shares(df, n_boot, 3, seed=4, buckets=3).collect()}
    draw, all_ = np.random.default_rng(4), []
    for _ in range(n_boot):
        i = draw.integers(0, n_a, n_a)
        m, v = x[i], np.where(np.isfinite(x), sd**2, np.nan)[i]
        ok = np.isfinite(m)
        n_col = ok.sum(0)
        row, grand = np.nanmean(m, 1, keepdims=True), np.nanmean(m)
        col = np.where(n_col > 0, np.nansum(m, 0) / np.maximum(n_col, 1), np.nan)[None]
        a = np.sum((row - grand) ** 2 * ok.sum(1, keepdims=True)) / (n_a - 1)
        p = np.nansum((col - grand) ** 2 * n_col) / (n_p - 1)
        e = np.nansum((m - row - col + grand)[ok] ** 2) / ((n_a - 1) * (n_p - 1))
        sa, sp, sap = max((a - e) / n_p, 0), max((p - e) / n_a, 0), max(e - np.nanmean(v) / 3, 0)
        all_.append([(sa + sap) / (sa + sp + sap), sa / (sa + sp + sap), sp, sap])
    want = np.percentile(all_, [2.5, 97.5], axis=0)
    for k, name in enumerate(["icc_idiographic", "icc_account_only", "sigma2_pair", "sigma2_account_pair"]):
        assert np.allclose(got[name], want[:, k])


def test_pearson_guards_and_ranks(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 5.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0), ("d", None, 2.0)], "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(S.pearson("x", "y").alias("r")).collect()}
    assert abs(got["a"] - np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1]) < 1e-9 and got["b"] is None and got["c"] is None and got["d"] is None
    ties = S.average_ranks(spark.createDataFrame([(1,), (1,), (3,)], "v int"), "v", []).orderBy("v").collect()
    assert [r.rank for r in ties] == [1.5, 1.5, 3.0]


def test_near_acyclic_graphs_are_iterated_to_the_end(spark):
    names = [f"n{i}" for i in range(12)]
    for seed in range(4):
        d = M.truth_matrix(names, f"s{seed}")
        a, c = np.abs(d), np.full(12, 1 / np.sqrt(12))
        for _ in range(500):
            c = 0.85 * a @ c + 0.15 * c
            c /= np.linalg.norm(c)
        df = _networks(spark, d)
        got = {r.name: r.value for r in N.sla(df, "network").collect()}
        assert np.allclose([got[str(i)] for i in range(12)], c, atol=1e-6) and np.allclose(N.sla_of(d), c, atol=1e-6)
        pr = [r.value for r in N.pagerank(df, "network").collect()]
        assert abs(sum(pr) - 1) < 1e-8 and min(pr) >= 0 and np.allclose(pr, N.pagerank_of(d))
    dense = np.abs(rng(30).normal(size=(15, 15)))
    np.fill_diagonal(dense, 0)
    ranks = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(ranks(N.sla_of(dense)), ranks(N.eigenvector_of(dense)))[0, 1] > 0.98


def test_moments_add_up(spark):
    x = rng(10).normal(size=(50, 4))
    df = spark.createDataFrame([("k" if i % 3 else "j", r.tolist()) for i, r in enumerate(x)] + [("k", None), ("k", [1.0])], "key string, v array<double>").repartition(5)
    got = {(r.key, r.dim): r for r in C.moments(df, "key", "v", 4).collect()}
    mine = x[[i for i in range(50) if i % 3]]
    assert all(got["k", j].n == len(mine) and np.isclose(got["k", j].mean, mine[:, j].mean()) and np.isclose(got["k", j].mean_square, (mine[:, j] ** 2).mean()) for j in range(4))


def test_tables_keep_rows_without_a_value(spark):
    rows = [("a", t, n, float(v)) for t in range(8) for n, v in (("x", t), ("y", t % 3), ("z", 1))] + [("b", 0, "x", 1.0), (None, 0, "x", 1.0), ("a", 1, "x", None), ("a", 9, "x", None), ("a", 2, "other", 5.0)]
    x = C.tables(spark.createDataFrame(rows, "account string, t bigint, name string, x double"), "account", ["x", "y", "z"])
    assert x.filter("account = 'a'").count() == 9 and x.filter("t = 9").first().x == [None, None, None]
    out = C.estimate(x, "account", ["x", "y", "z"], "pcor").collect()
    assert len(out) == 6 and {r.account for r in out} == {"a"}


def test_variance_partition_equals_the_plain_one(spark):
    for sd, check in (((5, 0.5, 0.5, 2), lambda r: r.icc_idiographic < 0.35 and r.sigma2_pair > r.sigma2_account_pair), ((1, 0.5, 4, 1.5), lambda r: r.icc_idiographic > 0.6), ((3, 0.5, 1, 8), lambda r: r.sigma2_rep > r.sigma2_pair and 0 <= r.icc_idiographic <= 1)):
        g = rng(31)
        pair, acct = g.normal(0, sd[0], 60), g.normal(0, sd[1], 30)
        reps = 10 + pair[None, :, None] + acct[:, None, None] + g.normal(0, sd[2], (30, 60, 1)) + g.normal(0, sd[3], (30, 60, 3))
        m, s = reps.mean(2), reps.std(2)
        m[g.random(m.shape) < 0.1] = np.nan
        rows = [(f"a{i}", f"s{j}", "t", float(m[i, j]), float(s[i, j])) for i in range(30) for j in range(60) if np.isfinite(m[i, j])]
        r = S.variance_partition(spark.createDataFrame(rows, "account_hash string, src string, dep string, weight double, weight_sd double")).first()
        ok, grand, row, col = np.isfinite(m), np.nanmean(m), np.nanmean(m, 1, keepdims=True), np.nanmean(m, 0, keepdims=True)
        a, p = ((row - grand) ** 2 * ok.sum(1, keepdims=True)).sum() / 29, ((col - grand) ** 2 * ok.sum(0, keepdims=True)).sum() / 59
        e, rep = ((m - row - col + grand)[ok] ** 2).sum() / (29 * 59), (s[ok] ** 2).mean()
        want = (rep, max((a - e) / 60, 0), max((p - e) / 30, 0), max(e - rep / 3, 0))
        assert np.allclose((r.sigma2_rep, r.sigma2_account, r.sigma2_pair, r.sigma2_account_pair), want) and np.isclose(r.sigma2_rep_offtarget, np.median((m - col)[ok] ** 2))
        assert check(r) and r.n_accounts == 30 and r.n_pairs == 60
    assert S.variance_partition(spark.createDataFrame([], "account_hash string, src string, dep string, weight double, weight_sd double")).count() == 0


def test_exact_quantile(spark):
    g = rng(32)
    for values in (g.exponential(size=501), np.repeat([0.0, 1.0], [300, 20]), np.array([3.0]), g.normal(size=200).round(1)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        for p in (0.0, 0.5, 0.975):
            assert np.isclose(S.exact_quantile(df, "v", p, bins=8, few=5), np.quantile(values, p))
    assert S.exact_quantile(df.limit(0), "v", 0.5) is None


def test_spread_ranks_equal_plain_ranks(spark):
    g = rng(33)
    rows = [(k, float(v), i) for k in "ab" for i, v in enumerate(g.normal(size=150).round(1))] + [("c", 1.0, 0), ("c", 1.0, 1), (None, 1.0, 0), ("a", None, 999)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    plain = {(r.k, r.i): r.rank for r in S.average_ranks(df.filter("k is not null and v is not null"), "v", ["k"]).collect()}
    assert {(r.k, r.i): r.rank for r in S.spread_ranks(df, "v", ["k"], buckets=7).collect()} == plain


def test_between_accounts_equals_all_pairs(spark):
    from tidemark.operators import convergence as V

    g = rng(34)
    v = g.normal(size=(6, 9)).round(1)
    df = spark.createDataFrame([(f"a{i}", f"n{j}", float(v[i, j])) for i in range(6) for j in range(9)] + [("flat", f"n{j}", 1.0) for j in range(9)], "account_hash string, name string, value double")
    vocab = spark.createDataFrame([(j, f"n{j}") for j in range(9)], "trait_idx int, name string")
    r = np.corrcoef([M.ranks(x) for x in v])
    got = {x.account_hash: x.rho for x in V.between_accounts(df, "value", vocab).collect()}
    assert len(got) == 6 and all(np.isclose(got[f"a{i}"], (r[i].sum() - 1) / 5) for i in range(6))


def test_empty_networks(spark):
    from tidemark.operators import convergence as V

    edges = spark.createDataFrame([], "account_hash string, src string, dep string, weight double")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "trait_idx int, name string")
    assert V.by_account(edges, edges).count() == 0 and V.residual(edges).count() == 0 and N.enough(edges, 1).count() == 0
    assert V.summary(V.by_account(edges, edges), "x").first().n == 0
    assert V.of_means(edges.select("src", "dep", "weight"), edges.select("src", "dep", "weight"), vocab).first().r is None
    assert V.between_accounts(spark.createDataFrame([], "account_hash string, name string, value double"), "value", vocab).count() == 0
    assert C.estimate(spark.createDataFrame([], "account_hash string, t bigint, x array<double>"), "account_hash", ["a", "b"], "lag1").count() == 0
    assert C.pairwise(spark.createDataFrame([], "x array<double>"), ["a", "b"]).count() == 0
    one = spark.createDataFrame([("x", "a", "b", 1.0), ("y", "a", "b", 3.0), ("y", "b", "a", None)], "account_hash string, src string, dep string, weight double").withColumn("n", F.lit("clash"))
    assert [r.n for r in V.by_account(one, one).orderBy("account_hash").collect()] == [1, 2] and N.enough(one, 2).count() == 3 and N.enough(one, 3).count() == 0


def test_python_graphs_are_those_of_the_plan(spark):
    rows = [(0, "warm", "A", "cold"), (1, "cold", "A", "warm"), (2, "neat", "C", "rough"), (3, "rough", "C", "neat"), (4, "calm", "N", "tense"), (5, "tense", "N", "calm")]
    vocab = spark.createDataFrame(rows, "trait_idx int, name string, domain string, antonym string")
    names = [r[1] for r in rows]
    d, g = M.truth_matrix(names, "s"), M.prior_matrix([r[1:] for r in rows], "s")
    assert {(r.src, r.dep): r.weight for r in M.ground_truth(vocab, "s").collect()} == {(names[i], names[j]): d[i, j] for i, j in zip(*np.nonzero(d))}
    assert all(np.isclose(r.weight, g[names.index(r.src), names.index(r.dep)]) for r in M.generic_prior(vocab, "s").collect())
    assert np.isclose(np.abs(np.linalg.eigvals(M.transition(M.truth_matrix([f"n{i}" for i in range(40)], "s")))).max(), 0.7)


def test_recovery_improves_with_evidence(spark):
    rows = [(i, f"n{i}", "ABCD"[i % 4], f"n{i ^ 1}") for i in range(40)]
    vocab = spark.createDataFrame(rows, "trait_idx int, name string, domain string, antonym string")
    got = {r.volume: r for r in M.summary(M.recovery(vocab, 1, ["thin", "medium", "thick"], [0.0], 2)).collect()}
    assert got["thick"].edge_r_e1 > got["medium"].edge_r_e1 > got["thin"].edge_r_e1 and got["thick"].edge_r_e3_directed > got["medium"].edge_r_e3_directed
    assert got["thin"].edge_r_e3_directed is None and got["thick"].edge_r_e1 > 0.8 and got["thick"].e1_e3_edge_r > 0.3
