"""Counting kernels against brute force, shapes of known series, panel kernels, state geometry, registries."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.functions import mathx, special
from geoloom.kernels import cohort, pair, series
from geoloom.operators import descriptors, grouped, joins, pairs, panel as P, policy, vectors
from geoloom.sources.readers import Fetched


def make_panel(spark, columns: dict, start="2020-01-01"):
    dates = pd.date_range(start, periods=len(next(iter(columns.values()))))
    rows = [(k, d.date(), None if v != v else float(v)) for k, values in columns.items() for d, v in zip(dates, values)]
    return spark.createDataFrame(rows, "indicator_id string, date date, value double")


@pytest.mark.parametrize("n,ties", [(1, 5), (2, 5), (37, 4), (64, 100), (200, 12), (201, 1000)])
def test_order_counts(n, ties):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, ties, n).astype(float), rng.integers(0, ties, n).astype(float)
    i, j = np.triu_indices(n, 1)
    sx, sy = np.sign(x[j] - x[i]), np.sign(y[j] - y[i])
    assert pair.order_counts(x, y) == (n, int((sx * sy).sum()), int(np.abs(sx).sum()), int(np.abs(sy).sum()))
    assert pair.inversions(y) == int((sy < 0).sum())


def test_near_counts():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=150), np.round(rng.normal(size=60), 1)])
    gap = np.abs(v[:, None] - v[None, :])
    assert series.near_pairs(v, 0.25) == int((gap <= 0.25).sum() - len(v)) // 2
    for m in (1, 2, 3):
        runs = np.column_stack([v[k : len(v) - m + k] for k in range(m + 1)])
        d = np.abs(runs[:, None, :] - runs[None, :, :])
        a, b = (d[:, :, :m].max(axis=2) <= 0.4).sum() - len(runs), (d.max(axis=2) <= 0.4).sum() - len(runs)
        assert series.near_templates(v, m, 0.4, block=500) == (a // 2, b // 2)


def test_lagged_correlations_and_knn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = np.concatenate([rng.normal(size=5), x[:-5]]) + 0.1 * rng.normal(size=400)
    found = {k: (c, n) for k, c, n in pair.lagged_correlations(x, y, 8)}
    for k in (-3, 0, 5):
        a, b = (x[: len(x) - k], y[k:]) if k >= 0 else (x[-k:], y[:k])
        assert found[k] == (pytest.approx(np.corrcoef(a, b)[0, 1]), len(a))
    assert max(found, key=lambda k: found[k][0]) == 5
    rho = 0.8
    z = rho * x + math.sqrt(1 - rho**2) * rng.normal(size=400)
    assert pair.knn_mi(x, z) == pytest.approx(-0.5 * math.log(1 - rho**2), abs=0.12) and pair.knn_mi(x, rng.normal(size=400)) < 0.08


def test_shapes():
    t = np.linspace(0, 10, 300)
    rng = np.random.default_rng(3)
    curve = series.shape(100 / (1 + np.exp(-1.5 * (t - 3))) + rng.normal(0, 0.2, 300))
    assert curve["rising_share"] > 0.7 and curve["derivative_shape"] >= 0.75 and curve["smooth_monotonicity"] > 0.7
    wave = series.shape(np.sin(2 * np.pi * np.arange(300) / 20))
    assert wave["crossing_regularity"] > 0.9 and wave["smooth_monotonicity"] < 0.95
    noise = series.shape(rng.normal(size=300))
    assert noise["drift_noise_score"] > 0.5 > series.shape(t + rng.normal(0, 0.01, 300))["drift_noise_score"]
    assert series.smoothed(np.arange(9.0), 1).tolist() == list(range(9)) and len(series.smoothed(t, 7)) == len(series.smoothed(t, 8)) == 300
    assert series.sign_changes(np.array([1.0, 0, 2, -1, -1, 3])) == (2, 4)


def test_dtw_reads_whole_series():
    rng = np.random.default_rng(4)
    x = rng.normal(size=350).cumsum()
    y = np.concatenate([np.repeat(x[0], 9), x[:-9]])
    z = lambda v: (v - v.mean()) / (v.std() + 1e-10)
    a, b = z(x), z(y)
    d = np.full((351, 351), np.inf)
    d[0, 0] = 0
    for i in range(350):
        for j in range(350):
            d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i + 1, j], d[i, j + 1])
    assert pair.dtw(x, y)["dtw_distance"] == pytest.approx(math.sqrt(d[-1, -1]))
    assert pair.dtw(x, y, band=3)["dtw_distance"] >= pair.dtw(x, y)["dtw_distance"]


def test_forced_stationarity(spark):
    rng = np.random.default_rng(5)
    walk = rng.normal(size=400).cumsum() + 50
    columns = {"walk": (walk, np.concatenate([[0.0], np.diff(walk)])), "same": (walk, walk), "noise": (rng.normal(size=400), rng.normal(size=400)), "short": (walk[:5], walk[:5])}
    rows = [(k, d.date(), float(a), float(b)) for k, (raw, clean) in columns.items() for d, a, b in zip(pd.date_range("2020-01-01", periods=len(raw)), raw, clean)]
    got = {r["indicator_id"]: r for r in policy.stationarity_forcing(spark.createDataFrame(rows, "indicator_id string, date date, raw double, cleaned double")).collect()}
    assert got["walk"]["forced"] and not any(got[k]["forced"] for k in ("same", "noise", "short"))
    assert got["noise"]["raw_p"] < 0.01 and got["short"]["raw_p"] == 1.0


def test_tails(spark):
    xs = [-3.0, -0.5, 0.0, 0.7, 2.5, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", mathx.normal_sf(F.col("x")).alias("p"), mathx.chi2_sf_even(F.abs("x") * 8, 20).alias("c")).collect()
    for r in got:
        assert r["p"] == pytest.approx(1 - special.normal_cdf(r["x"]), abs=2e-7) and r["c"] == pytest.approx(special.chi2_sf(abs(r["x"]) * 8, 20), abs=1e-6)


def test_climate_indices_are_not_winsorised(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(10, 2, 300)
    clipped = np.clip(v, *np.percentile(v, [5, 95]))
    rows = [(i, float(a), float(b)) for i in ("ENSO", "spx") for a, b in zip(v, clipped)] + [("nao", float(a), float(a)) for a in v]
    got = {r["indicator_id"]: r for r in policy.outlier_policy(spark.createDataFrame(rows, "indicator_id string, raw double, cleaned double")).collect()}
    assert got["ENSO"]["winsorised"] and not got["ENSO"]["compliant"] and got["spx"]["winsorised"] and got["spx"]["compliant"] and got["nao"]["compliant"] and not got["nao"]["winsorised"]


def test_panel_modes_and_states(spark):
    t = np.arange(200)
    rng = np.random.default_rng(7)
    wave = {k: np.sin(2 * np.pi * t / 25 + p) + 0.001 * rng.normal(size=200) for k, p in zip("ABC", (0, 1, 2))}
    found = {r["dimension"]: r["value"] for r in grouped.panel_modes(make_panel(spark, wave).withColumn("window_id", F.lit(1))).collect()}
    assert found["mode_1_frequency"] == pytest.approx(1 / 25, abs=2e-3) and found["reconstruction_error"] < 0.1
    assert grouped.panel_modes(make_panel(spark, wave).withColumn("window_id", F.lit(1)), delay=2).where("dimension = 'rank'").count() == 1
    level = {k: np.repeat([0.0, 5.0, 0.0, -5.0], 50) + rng.normal(0, 0.3, 200) for k in "AB"}
    states = grouped.panel_states(make_panel(spark, level).withColumn("window_id", F.lit(1))).orderBy("date").collect()
    lab = np.array([r["state"] for r in states])
    assert (lab[:50] == lab[100:150]).mean() > 0.95 and len({lab[10], lab[60], lab[160]}) == 3 and all(0 < r["probability"] <= 1 for r in states)
    stays = {r["state"]: r for r in vectors.dwell(grouped.panel_states(make_panel(spark, level).withColumn("window_id", F.lit(1))), ("window_id",)).collect()}
    assert sum(r["n"] for r in stays.values()) == 200 and sum(r["proportion"] for r in stays.values()) == pytest.approx(1)


def test_state_geometry(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) @ np.diag([3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    df = spark.createDataFrame([("a", i, [float(v) for v in row]) for i, row in enumerate(x)], "entity string, window_id int, vector array<double>")
    g = vectors.state_geometry(df, 2)
    assert np.allclose(g["covariance"], np.cov(x.T, bias=True)) and np.allclose(np.array(g["basis"]) @ np.array(g["basis"]).T, np.eye(2))
    assert np.allclose(np.array(g["precision"]) @ (np.cov(x.T, bias=True) + 1e-6 * np.eye(4)), np.eye(4), atol=1e-6)
    onto = np.array(g["basis"]).T @ np.array(g["basis"])
    rows = df.withColumn("importance", F.lit(0.5)).withColumn("dof", F.lit(2.0)).withColumn("expected_volatility", F.lit(1.0))
    for metric in ("natural", "diagonal", "euclidean"):
        got = vectors.physics(rows, g["basis"], g["precision"], np.diag(g["covariance"]).tolist(), metric).orderBy("window_id").collect()
        v = np.diff(x, axis=0)
        r = v - v @ onto
        want = {"natural": np.sqrt(np.einsum("ij,jk,ik->i", r, np.array(g["precision"]), r)), "diagonal": np.sqrt((r**2 / (np.diag(g["covariance"]) + 1e-10)).sum(axis=1)), "euclidean": np.linalg.norm(r, axis=1)}[metric]
        assert np.allclose([s["residual"] for s in got], want) and np.allclose([s["hidden_mass"] for s in got], want * 0.25)


def test_gravitation_finds_groups():
    s = np.full((9, 9), 0.05)
    for a in range(0, 9, 3):
        s[a : a + 3, a : a + 3] = 0.95
    np.fill_diagonal(s, 1)
    lab = cohort.gravitation(s)
    assert cohort.jaccard(lab, np.repeat([0, 1, 2], 3)) == 1.0 or lab.max() <= 2


def test_pairs_meet_once(spark):
    rows = [(k, d, float(i * 10 + d)) for i, k in enumerate("abcd") for d in range(4) if (i + d) % 3]
    df = spark.createDataFrame(rows, "indicator_id string, date int, value double")
    got = {(r["id_1"], r["id_2"], r["date"], r["x"], r["y"]) for r in joins.pairs_on_date(df).collect()}
    assert got == {(a, b, d, x, y) for a, d, x in rows for b, e, y in rows if d == e and a < b}
    both = {(r["id_1"], r["id_2"], r["date"]) for r in joins.pairs_on_date(df, ordered=True).collect()}
    assert both == {(a, b, d) for a, d, _ in rows for b, e, _ in rows if d == e and a != b}


def test_long_series_counts_are_not_quadratic(spark):
    rng = np.random.default_rng(9)
    df = make_panel(spark, {"a": rng.normal(size=20_000)})
    began = time.time()
    r = descriptors.mann_kendall(df).collect()[0]
    s = descriptors.recurrence_rate(df).collect()[0]
    assert r["n"] == 20_000 and abs(r["mk_z"]) < 4 and 0 < s["recurrence_rate"] < 1 and time.time() - began < 60


def test_bonferroni(spark):
    rows = [("a", "granger_p_1_to_2", 0.001), ("b", "granger_p_1_to_2", 0.02), ("c", "granger_f_1_to_2", 9.0)]
    got = {r["id"]: r["significant"] for r in pairs.bonferroni(spark.createDataFrame(rows, "id string, dimension string, value double")).collect()}
    assert got == {"a": True, "b": True} and not any(r["significant"] for r in pairs.bonferroni(spark.createDataFrame(rows, "id string, dimension string, value double"), alpha=0.001).collect())


def test_diagnostic_registry(spark, tmp_path):
    reg = vectors.DiagnosticRegistry(spark, str(tmp_path / "reg"))
    reg.store("routing", "pca_weight", 0.3, "w1")
    reg.store("routing", "pca_weight", 0.35, "w1")
    reg.decide("routing", "exclude dtw", "not robust", "w1")
    got = {(r["agent"], r["metric"], r["window_id"]): r["value"] for r in reg.metrics().collect()}
    assert got == {("routing", "pca_weight", "w1"): 0.35}
    reg.store("stability", "score", 0.9)
    assert reg.metrics().count() == 2 and [r["decision"] for r in reg.trail().collect()] == ["exclude dtw"]


def test_fetched_files_are_kept(tmp_path):
    calls = []
    keep = Fetched(str(tmp_path), hours=24)
    fetch = lambda: calls.append(1) or b"a,b\n1,2\n"
    assert keep.get("x/owid.csv", fetch) == keep.get("x/owid.csv", fetch) and len(calls) == 1
    Fetched(str(tmp_path), hours=0).get("x/owid.csv", fetch)
    assert len(calls) == 2


def test_exact_shares_without_a_single_task(spark):
    from geoloom.operators.dynamics import share_at_most

    rng = np.random.default_rng(10)
    v = np.round(rng.normal(size=700), 2)
    got = share_at_most(spark.createDataFrame([(float(x),) for x in v], "d double").repartition(5), "d", cuts=16).collect()
    assert all(r["share"] == pytest.approx((v <= r["d"]).mean()) for r in got) and len(got) == 700


def test_home_region_of_all_points(spark):
    from geoloom.operators import cohorts

    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 3)) * [1, 2, 3]
    df = spark.createDataFrame([([float(v) for v in row],) for row in x], "vector array<double>")
    got = cohorts.home_distances(df, 0.8, robust=False).toPandas()
    want = cohort.home_region(x, 0.8, robust=False)
    assert got["inside"].mean() == pytest.approx(0.8, abs=0.01)
    assert np.allclose(sorted(got["distance"]), sorted(want["distances"])) and got["percentile"].max() == 1.0
    assert cohorts.home_distances(df, 0.8).count() == 500


def test_components_in_one_task_and_in_rounds(spark):
    from geoloom.operators.graph import connected_components

    rng = np.random.default_rng(12)
    names = [f"n{i:03}" for i in range(120)]
    pairs_ = [(names[i], names[i + 1]) for i in range(40, 70)] + [(names[int(a)], names[int(b)]) for a, b in rng.integers(70, 120, (40, 2))] + [(names[5], names[5])]
    root = {n: n for n in names}
    for _ in names:
        for a, b in pairs_:
            root[a] = root[b] = min(root[a], root[b])
    nodes, edges = spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(pairs_, "a string, b string")
    for bound in (1000, 0):
        assert {r["node"]: r["component"] for r in connected_components(nodes, edges, edges_in_task=bound).collect()} == root


def test_year_by_month_of_large_and_negative_totals(spark, tmp_path):
    import duckdb
    from geoloom.catalog import ORACLES, QUERIES

    prices = [1.0, 99.9e6, 250e6, 7.2e12, -9.99e6, -9.9e6, -3e9, 0.0]
    tables = {"nation": pd.DataFrame({"n_nationkey": [0], "n_name": ["A"]}), "customer": pd.DataFrame({"c_custkey": [1], "c_nationkey": [0]})}
    tables["orders"] = pd.DataFrame({"o_custkey": 1, "o_totalprice": prices, "o_orderdate": pd.date_range("2020-09-15", periods=len(prices), freq="31D").astype("datetime64[us]")})
    con = duckdb.connect()
    for name, t in tables.items():
        t.to_parquet(tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    want = con.sql(f"SELECT date, value FROM ({ORACLES['source_year_by_month']}) ORDER BY date").fetchall()
    got = QUERIES["source_year_by_month"](spark, str(tmp_path)).orderBy("date").select("date", "value").collect()
    assert [tuple(r) for r in got] == want and len(want) == len(prices)


def test_members_equally_far_have_no_z(spark):
    from geoloom.operators import dynamics

    rng = np.random.default_rng(13)
    rows = []
    for w in range(200):  # a vector, the same reversed, and both negated: the centroid is zero
        v = rng.normal(size=7).astype("float32").astype(float)
        for member, x in zip("abcd", (v, v[::-1], -v, -v[::-1])):
            rows += [(w % 3, w, member, k + 1, float(y)) for k, y in enumerate(x)]
    df = spark.createDataFrame(rows, "cohort_id int, window_id int, indicator_id string, dimension int, value double")
    got = dynamics.hidden_mass(df.repartition(7)).toPandas()
    want = df.toPandas().assign(value=lambda t: t["value"] ** 2).groupby(["window_id", "indicator_id"])["value"].sum() ** 0.5
    assert len(got) == 800 and got["z"].isna().all() and not got["hidden_mass"].any()
    assert np.allclose(got.set_index(["window_id", "indicator_id"])["distance"].sort_index(), want.sort_index())
    empty = dynamics.hidden_mass(df.withColumn("value", F.lit(None).cast("double")))
    assert empty.where("distance IS NULL AND z IS NULL AND NOT hidden_mass").count() == 800
