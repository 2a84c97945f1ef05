"""Engine tests: SQL differential on the smallest tables, closed forms, datasets of known structure, invariances, sources, sinks, streams."""

import json
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.catalog import ORACLES, QUERIES
from geoloom.kernels import cohort, pair, series
from geoloom.functions import special
from geoloom.operators import aggregates, baselines, cohorts, descriptors, dynamics, graph, grouped, joins, pairs, panel as P, policy, rolling, windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def make_panel(spark, columns: dict, start="2020-01-01"):
    dates = pd.date_range(start, periods=len(next(iter(columns.values()))))
    rows = [(k, d.date(), None if v != v else float(v)) for k, values in columns.items() for d, v in zip(dates, values)]
    return spark.createDataFrame(rows, "indicator_id string, date date, value double")


def walks(n=300, k=4, seed=42):
    return {c: v for c, v in zip("ABCDEFGH", np.random.default_rng(seed).normal(size=(k, n)).cumsum(axis=1) + 100)}


# ---- differential


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    norm = lambda v: "None" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)
    mine = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


# ---- distributions and kernels against closed forms


def test_distributions():
    assert special.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert special.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.f_sf(2.7109, 5, 20) == pytest.approx(0.05, abs=1e-4)
    assert special.t_two_sided(2.086, 20) == pytest.approx(0.05, abs=1e-4)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.ks_two_sample(np.arange(100.0), np.arange(100.0) + 50)[0] == pytest.approx(0.5)


def test_series_kernels():
    t, rng = np.arange(512), np.random.default_rng(0)
    sine = np.sin(2 * np.pi * t / 32)
    assert series.spectrum_shape(sine + 0.01 * rng.normal(size=512))["dominant_period"] == pytest.approx(32, rel=0.02)
    noise = rng.normal(size=512)
    assert series.permutation_entropy(noise) > 0.97 and series.permutation_entropy(t.astype(float)) == 0
    assert series.template_entropy(noise) > 1.5 > series.template_entropy(sine)
    assert series.adf(noise)[0] < -5 < -2 < series.adf(noise.cumsum())[0] + 1.5
    assert series.dmd(np.vstack([np.cos(0.3 * t[:60]), np.sin(0.3 * t[:60])]))["reconstruction_error"] < 1e-6
    assert abs(series.pacf(noise.cumsum(), 3)[1]) > 0.9
    logistic = [0.4]
    for _ in range(599):
        logistic.append(4 * logistic[-1] * (1 - logistic[-1]))
    assert series.lyapunov(np.array(logistic), dim=2, delay=1)["lyapunov"] > 0.2 > series.lyapunov(np.sin(t / 5.0), dim=2, delay=8)["lyapunov"]
    broken = np.concatenate([np.arange(100.0), 100 - 2 * np.arange(100.0)])
    assert abs(series.breakpoint_scan(broken)["trend_breakpoint"] - 100) <= 2
    r = series.recurrence(sine[:128])
    assert r["determinism"] > 0.9 and r["recurrence_rate"] == pytest.approx(0.1, abs=0.01)
    two = np.concatenate([rng.normal(0, 0.3, 100), rng.normal(5, 0.3, 100)])
    found = series.gaussian_hmm(two, 2)
    assert (found["states"] == np.repeat([0, 1], 100)).mean() > 0.98
    assert series.calibrate(noise.cumsum(), lambda x: abs(series.acf(x, 1)[1]), "permutation", rng, 60)["passed"] == 1
    surrogate = series.phase_surrogate(noise, rng)
    assert np.allclose(np.abs(np.fft.rfft(surrogate))[1:-1], np.abs(np.fft.rfft(noise))[1:-1])
    assert series.signature(noise, 1).get("dominant_pure_noise") == 1 and series.signature(sine, 1).get("dominant_coupled_oscillator") == 1


def test_pair_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = np.concatenate([rng.normal(size=2), x[:-2]]) + 0.3 * rng.normal(size=400)
    g = pair.granger_both(x, y, difference=False)
    assert g["granger_p_1_to_2"] < 1e-6 < 0.01 < g["granger_p_2_to_1"] and g["granger_lag_1_to_2"] == 2
    assert pair.dtw(x[:80], x[:80])["dtw_distance"] == 0
    full, brute = pair.dtw(x[:30], y[:30]), None
    a, b = ((v[:30] - v[:30].mean()) / (v[:30].std() + 1e-10) for v in (x, y))
    brute = np.full((31, 31), np.inf)
    brute[0, 0] = 0
    for i in range(30):
        for j in range(30):
            brute[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(brute[i, j + 1], brute[i + 1, j], brute[i, j])
    assert full["dtw_distance"] == pytest.approx(math.sqrt(brute[30, 30]))
    walk = x.cumsum()
    assert pair.cointegration(walk, 2 * walk + rng.normal(size=400))["cointegrated"] == 1
    assert pair.cointegration(walk, 2 * walk + rng.normal(size=400))["coint_beta"] == pytest.approx(2, abs=0.1)
    assert pair.te_shuffled(x, np.roll(x, 1), rng)["te_p_value"] < 0.05
    assert pair.mi_permutation(x, rng.normal(size=400), rng)["mi_p_value"] > 0.01


def test_cohort_kernels():
    rng = np.random.default_rng(2)
    blocks = np.kron(np.eye(3), np.full((4, 4), 0.8)) + 0.05
    np.fill_diagonal(blocks, 1)
    found = cohort.ensemble(blocks)
    assert found["k"] == 3 and cohort.jaccard(found["labels"], np.repeat([0, 1, 2], 4)) == 1
    w, v = cohort.eigen(blocks)
    assert np.allclose((v * w) @ v.T, blocks) and cohort.dimensions(w)["dim_90"] >= 3
    x = np.concatenate([rng.normal(m, 0.2, (30, 2)) for m in ((0, 0), (5, 0), (0, 5))])
    assert cohort.best_clusters(x)["k"] == 3 and cohort.best_clusters(x, "ward")["k"] == 3
    tree = cohort.linkage(cohort.distances(np.array([[0.0], [1], [10], [11]])), "single")
    assert tree[:, 2].tolist() == [1, 1, 9]
    centre, _ = cohort.mcd(np.concatenate([rng.normal(size=(150, 2)), np.full((40, 2), 50.0)]))
    assert np.abs(centre).max() < 0.5
    home = cohort.home_region(rng.normal(size=(500, 3)))
    assert (home["distances"] <= home["radius"]).mean() == pytest.approx(0.8, abs=0.01)
    assert cohort.modularity(blocks, np.repeat([0, 1, 2], 4)) > 0.3


# ---- datasets of known structure


def test_clear_leader(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    data = {"A": a, **{c: np.concatenate([rng.normal(size=k), a[:-k]]) + 0.3 * rng.normal(size=400) for c, k in (("B", 3), ("C", 5), ("D", 7))}, "E": rng.normal(size=400)}
    best = {(r["id_1"], r["id_2"]): r for r in pairs.best_lag(pairs.cross_correlation(make_panel(spark, data))).collect()}
    assert [best["A", c]["peak_lag"] for c in "BCD"] == [3, 5, 7] and best["A", "B"]["leader"] == "A"
    assert not best["A", "E"]["significant"] or abs(best["A", "E"]["peak_corr"]) < 0.25


def test_three_clusters(spark):
    rng = np.random.default_rng(4)
    factors = rng.normal(size=(3, 500))
    data = {c: factors[g] + 0.4 * rng.normal(size=500) for c, g in zip("ABCDEFGH", (0, 0, 0, 1, 1, 1, 2, 2))}
    p = make_panel(spark, data)
    corr = pairs.correlation_pairs(p)
    nodes = P.indicators(p).select(F.col("indicator_id").alias("node"))
    found = {r["node"]: r["component"] for r in graph.discover_cohorts(corr, nodes, 0.6, 2).collect()}
    assert found == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "F": "D", "G": "G", "H": "G"}
    k = grouped.clusters(corr.withColumn("window_id", F.lit(1))).toPandas()
    assert k["k"].iloc[0] == 3
    q = graph.modularity(corr.where("corr > 0.3").select(F.col("id_1").alias("a"), F.col("id_2").alias("b"), F.col("corr").alias("w")), spark.createDataFrame(list(found.items()), "node string, cluster string")).first()["modularity"]
    assert q > 0.5


def test_two_regimes_and_anomalies(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 0.5, 500), rng.normal(3, 2, 500)])
    states = grouped.hidden_states(make_panel(spark, {"A": v})).orderBy("date").toPandas()["state"].to_numpy()
    assert (states[:480] == 0).mean() > 0.95 and (states[520:] > 0).mean() > 0.9
    spikes = rng.normal(size=1000)
    spikes[[100, 300, 500, 700, 900]] += 12
    dev = P.view(make_panel(spark, {"B": spikes}), "ANOMALY").orderBy("date").toPandas()["value"].to_numpy()
    assert set(np.argsort(-np.abs(np.nan_to_num(dev)))[:5]) == {100, 300, 500, 700, 900}


def test_periodic_and_trending(spark):
    t, rng = np.arange(600), np.random.default_rng(6)
    found = grouped.series_descriptors(make_panel(spark, {"P50": np.sin(2 * np.pi * t / 50) + 0.2 * rng.normal(size=600)}), ["spectrum"]).toPandas().set_index("dimension")["value"]
    assert found["dominant_period"] == pytest.approx(50, rel=0.05)
    h = {r["indicator_id"]: r["hurst"] for r in descriptors.hurst_rs(make_panel(spark, {"T": (rng.normal(size=600) + 0.5).cumsum().cumsum(), "N": rng.normal(size=600)})).collect()}
    assert h["T"] > 0.6 > h["N"]


# ---- invariances and edge cases


def test_normalisation_invariances(spark):
    data = walks()
    base = P.zscore(make_panel(spark, data)).orderBy("indicator_id", "date").toPandas()["value"]
    moved = P.zscore(make_panel(spark, {k: 3 * v + 7 for k, v in data.items()})).orderBy("indicator_id", "date").toPandas()["value"]
    twice = P.zscore(P.zscore(make_panel(spark, data))).orderBy("indicator_id", "date").toPandas()["value"]
    assert np.allclose(base, moved) and np.allclose(base, twice)
    dealt = P.zscore(make_panel(spark, data).repartition(7)).orderBy("indicator_id", "date").toPandas()["value"]
    assert np.allclose(base, dealt)
    flat = P.zscore(make_panel(spark, {"A": [1.0] * 5})).toPandas()["value"]
    assert flat.isna().all() and P.minmax(make_panel(spark, {"A": [1.0] * 5})).toPandas()["value"].isna().all()


def test_cleaning(spark):
    nan = float("nan")
    p = make_panel(spark, {"A": [1, nan, nan, nan, nan, nan, nan, 8], "B": [nan, 2, 3, 4, 5, 6, 7, 8]})
    got = P.clean_series(p).where("indicator_id = 'A'").orderBy("date").toPandas()["value"].tolist()
    assert got == [1, 1, 1, 1, 1, 1, 8]
    report = P.cleaning_report(p).where("indicator_id = 'A'").first()
    assert report["nulls_filled"] == 5 and report["rows_after"] == 7
    assert P.fill_both_ways(p).where("indicator_id = 'B'").orderBy("date").first()["value"] == 2
    wide = P.to_wide(p, ["A", "B"])
    assert P.to_long(wide).where("value IS NOT NULL").count() == 9
    e = spark.createDataFrame([(202001,), (202052,), (202101,)], "w int").select(P.epiweek_to_date(F.col("w")).alias("d"), "w").withColumn("back", P.date_to_epiweek(F.col("d"))).collect()
    assert [str(r["d"]) for r in e] == ["2019-12-29", "2020-12-20", "2021-01-03"] and all(r["w"] == r["back"] for r in e)


def test_joins_and_aggregates(spark):
    left = spark.createDataFrame([("x", "2020-01-10"), ("y", "2020-06-01")], "k string, d string").select("k", F.to_date("d").alias("date"))
    right = spark.createDataFrame([("2020-01-01", 1), ("2020-01-12", 2), ("2020-03-01", 3)], "d string, v int").select(F.to_date("d").alias("date"), "v")
    got = {r["k"]: r["match_v"] for r in joins.nearest_within(left, right, 30).collect()}
    assert got == {"x": 2, "y": None}
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, value double")
    assert aggregates.mode(df, ["k"], "value").where("k = 'a'").first()["mode"] == 1.0
    assert aggregates.summary(df, ["k"], rollup=True).count() == 3
    assert aggregates.top_per_group(df, ["k"], 1, F.desc("value")).count() == 2
    assert {r["change"] for r in aggregates.births_deaths(df.select("k").distinct(), spark.createDataFrame([("b",), ("c",)], "k string")).collect()} == {"birth", "death"}
    p = make_panel(spark, walks())
    assert joins.common_dates(p).count() == p.count()
    s = rolling.streaks(p.withColumn("up", F.col("value") > 100), "up")
    assert s.agg(F.sum("length")).first()[0] == p.count()
    assert windows.by_schedule(p, [("2020-01-01", "2020-01-31"), ("2020-01-15", "2020-02-15")]).count() == 4 * (31 + 32)
    assert rolling.percentile_of_last(p, "value", 10, ("indicator_id",)).where("share_below > 1").count() == 0


# ---- rules


def test_policy(spark):
    rows = [("SPY", 0.9, 0.8, 0.9, 0.8, 0.9), ("VIX", 0.1, 0.1, 0.2, 0.1, 0.2), ("GOLD", 0.5, 0.5, 0.5, 0.5, 0.5)]
    c = policy.contribution(spark.createDataFrame(rows, "indicator_id string, geometric_influence double, marginal_contribution double, stability double, noise_pressure double, confidence_effect double"))
    assert {r["indicator_id"]: r["hint"] for r in c.collect()} == {"SPY": "keep", "VIX": "exclude_candidate", "GOLD": "review"}
    assert {r["indicator_id"] for r in policy.apply_exclusion(c).where("active").collect()} == {"SPY", "GOLD"}
    assert policy.apply_exclusion(c, min_indicators=3).where("active").count() == 3 and policy.apply_exclusion(c, "warn").where("active").count() == 3
    w = spark.createDataFrame([("a", 3.0, 100, "latent_flow", 0.8, 0.8, 0.6, 0.2, 0.9), ("b", 3.0, 5, "latent_flow", 0.8, 0.8, 0.6, 0.2, 0.9), ("c", 3.0, 100, "pure_noise", 0.9, 0.8, 0.6, 0.2, 0.9), ("d", 1.0, 100, "coupled_oscillator", 0.8, 0.8, 0.6, 0.2, 0.55)],
                              "indicator_id string, window_years double, n_observations int, dominant_geometry string, geometry_pct double, quality_score double, avg_confidence double, avg_disagreement double, stability double")
    s = {r["indicator_id"]: r for r in policy.suitability(w).collect()}
    assert [s[k]["status"] for k in "abcd"] == ["eligible", "ineligible", "ineligible", "conditional"]
    assert "trend" in s["a"]["allowed_engines"] and s["d"]["reasons"] == ["low_stability"]
    r = policy.route(spark.createDataFrame([(1, 300, 0.7, 0.1, 0.1, True)], "window_id int, n_obs int, latent_flow double, oscillator double, reflexive double, null_passed boolean"), "climate").toPandas().set_index("engine")
    assert r.loc["pca", "runs"] and not r.loc["dtw", "runs"] and r.loc["hmm", "reason"] == "geometry" and r.loc["copula", "reason"] == "domain" and r.loc["hurst", "reason"] == "window_too_short"
    assert r["weight"].max() <= 0.25 + 1e-12
    flags = policy.safety_flag(spark.createDataFrame([("a", "x", "critical"), ("b", "x", "warning"), ("b", "y", "warning"), ("c", "x", "ok")], "indicator_id string, check string, severity string"))
    assert {x["indicator_id"]: x["flag"] for x in flags.collect()} == {"a": "unsafe", "b": "questionable", "c": "safe"} and policy.worst_flag(flags).first()["flag"] == "unsafe"


def test_dynamics(spark):
    d = [0.5, 0.6, 1.5, 2.0, 1.2, 0.4, 1.1, 0.3]
    s = spark.createDataFrame([("e", x.to_pydatetime(), v) for x, v in zip(pd.date_range("2020-01-01", periods=8), d)], "entity string, date timestamp, distance double")
    r = dynamics.excursion_summary(s, 1.0).first()
    assert (r["episodes"], r["longest"], r["crossings"], r["peak"]) == (2, 3, 4, 2.0)
    assert [x["state"] for x in dynamics.trajectory_state(s, 1.0).orderBy("date").collect()][2:5] == ["escalating", "escalating", "reverting"]
    t = spark.createDataFrame([("a", 1, "hurst", 0.5), ("a", 2, "hurst", 0.9), ("a", 1, "trend_slope", 1.0), ("a", 2, "trend_slope", 1.3)], "indicator_id string, window_id int, dimension string, value double")
    assert dynamics.vector_motion(t).first()["distance"] == pytest.approx(0.5)
    assert dynamics.assemble_vectors(t).where("window_id = 1").first()["n_components"] == 2
    assert dynamics.semantic_guard(spark.createDataFrame([("we predict it",), ("fine",)], "t string"), ["t"]).count() == 1
    trans = baselines.transition_matrix(baselines.threshold_states(make_panel(spark, {"A": [1, 1, 9, 9, 1]}), [5.0]))
    assert {(x["state"], x["next_state"]): x["p"] for x in trans.collect()} == {(0, 0): 0.5, (0, 1): 0.5, (1, 1): 0.5, (1, 0): 0.5}


def test_cohorts(spark):
    rng = np.random.default_rng(8)
    daily, monthly = pd.date_range("2020-01-01", periods=200), pd.date_range("2020-01-01", periods=7, freq="MS")
    rows = [(f"d{i}", x.date(), float(rng.normal())) for i in range(3) for x in daily] + [(f"m{i}", x.date(), float(rng.normal())) for i in range(3) for x in monthly]
    got = {r["indicator_id"]: r["cohort"] for r in cohorts.observation_cohorts(spark.createDataFrame(rows, "indicator_id string, date date, value double")).collect()}
    assert len({got[f"d{i}"] for i in range(3)}) == 1 == len({got[f"m{i}"] for i in range(3)}) and got["d0"] != got["m0"]
    p = make_panel(spark, walks(200, 2)).withColumn("state", (F.dayofyear("date") > 100).cast("int"))
    b = cohorts.behaviour(p)
    assert b.count() == 4 and cohorts.movements(b).count() == 2 and cohorts.state_centroids(b).count() == 2


def test_derived_plan(spark):
    from geoloom.plans.derived import derive, run_library
    from geoloom.registry import REGISTRY, execute

    p = make_panel(spark, walks(320, 4))
    out = derive(p, 252, 63, ["spectrum", "stationarity"], 0.0, ["granger"], None)
    s = out["series"].toPandas()
    assert set(s["window_id"]) == {0, 1} and {"trend_slope", "spectral_flatness", "adf_statistic"} <= set(s["dimension"])
    assert out["pairs"].where("dimension = 'granger_f_1_to_2'").count() == 12 and out["clusters"].count() == 8
    report = run_library(p)
    assert 0 <= report["correlation"]["mean_abs_corr"] <= 1 and 0 < report["pca"]["gfm"] <= 1 and len(report["hurst"]) == 4
    assert execute("distances", p).count() == 6 and "kernel_dtw" in REGISTRY


def test_first_component(spark):
    rng = np.random.default_rng(10)
    common = rng.normal(size=300)
    p = make_panel(spark, {c: common + 0.3 * rng.normal(size=300) for c in "ABCD"})
    before = pairs.correlation_summary(pairs.correlation_pairs(p)).first()["mean_abs_corr"]
    after = pairs.correlation_pairs(cohorts.remove_first_component(p)).toPandas()["corr"]
    assert before > 0.8 and after.max() < 0.1
    v = spark.createDataFrame([("x", "a", [1.0, 0.0]), ("x", "b", [1.0, 0.2]), ("y", "c", [0.0, 1.0])], "domain string, indicator_id string, vector array<double>")
    assert cohorts.coupling(v).first()["coupling"] < 0.2 and {r["domain"]: r["n"] for r in cohorts.cohesion(v).collect()} == {"x": 2, "y": 1}
    d = [5.0]
    for _ in range(400):
        d.append(0.8 * d[-1] + rng.normal() * 0.1)
    r = series.mean_reversion_ci(np.array(d), 0.0, rng)
    assert r["reverting"] == 1 and r["beta_low"] < -0.2 < r["beta_high"] + 0.05 and series.effect_ci(np.full(30, 1.0) + rng.normal(size=30) * 0.1, rng)["certain"] == 1


# ---- sources and sinks


def test_sources(spark, tmp_path):
    from geoloom.sources import readers as R

    (tmp_path / "wide.csv").write_text("date,A,B,C\n2020-01-01,1,,x\n2020-01-02,,5,y\n2020-01-03,3,6,z\n")
    got = R.csv_wide(spark, str(tmp_path / "wide.csv")).orderBy("indicator_id", "date").toPandas()
    assert got["value"].tolist() == [1, 1, 3, 5, 5, 6]
    (tmp_path / "long.csv").write_text("Date,Ticker,Close\n2020-01-01,X,1.5\nbad,X,2\n2020-01-02,X,n/a\n2020-01-03,Y,4\n")
    assert R.csv_any(spark, str(tmp_path / "long.csv")).count() == 2 
    (tmp_path / "two.csv").write_text("date,A,B\n2020-01-01,1,\n2020-01-02,,5\n2020-01-03,3,6\n")
    assert R.csv_any(spark, str(tmp_path / "two.csv")).count() == 4
    with pytest.raises(R.SourceError):
        R.csv_wide(spark, "x.txt")
    (tmp_path / "o.json").write_text(json.dumps({"observations": [{"date": "2020-01-01", "value": "1.0"}, {"date": "2020-01-02", "value": "."}]}))
    assert R.observations_json(spark, str(tmp_path / "o.json"), "S").collect()[0]["value"] == 1.0
    (tmp_path / "p.json").write_text(json.dumps([{"date": "2020-01-01T00:00:00Z", "adjClose": 2.0}]))
    assert R.prices_json(spark, str(tmp_path / "p.json"), "S").first()["value"] == 2.0
    (tmp_path / "q.csv").write_text("time,latitude,longitude,depth,mag\n2020-01-01T00:00:00Z,1,2,3,4\n2020-01-01T00:00:00Z,1,2,3,4\n")
    assert R.quakes_csv(spark, str(tmp_path / "q.csv")).count() == 1
    (tmp_path / "e.json").write_text(json.dumps({"epidata": [{"region": "nat", "epiweek": 202001, "wili": 1.5}, {"region": "nat", "epiweek": 202001, "wili": 9.0}]}))
    assert R.epiweek_json(spark, str(tmp_path / "e.json")).first()["value"] == 1.5
    (tmp_path / "y.txt").write_text("title\n2020 " + " ".join(["1.0"] * 11) + " -99.9\n")
    assert R.year_by_month(spark, str(tmp_path / "y.txt"), "ONI").count() == 11
    (tmp_path / "a.csv").write_text("Land\nYear,Jan\n2020," + ",".join(["0.5"] * 11) + ",***\n")
    assert R.anomalies_csv(spark, str(tmp_path / "a.csv"), "T").count() == 11
    (tmp_path / "s.txt").write_text("SEAS YR TOTAL ANOM\nDJF 2020 1.0 0.5\n")
    assert str(R.seasonal_text(spark, str(tmp_path / "s.txt"), "N").first()["date"]) == "2020-01-01"
    (tmp_path / "c.txt").write_text("# c\n2020 1 2020.04 413.4\n2020 2 2020.1 -99.9\n")
    assert R.decimal_dates(spark, str(tmp_path / "c.txt"), "CO2", (0, 1), 3).count() == 1
    (tmp_path / "f.json").write_text(json.dumps({"value": {"timeSeries": [{"values": [{"value": [{"value": "3", "dateTime": "2020-01-01T00:00"}, {"value": "-9", "dateTime": "2020-01-02T00:00"}]}]}]}}))
    assert R.streamflow_json(spark, str(tmp_path / "f.json"), "F").count() == 1
    (tmp_path / "i.yaml").write_text("indicators:\n  - {id: A, source: s, category: c, frequency: daily}\n")
    assert R.indicator_registry(spark, str(tmp_path / "i.yaml")).first()["frequency"] == "daily" and R.Config(str(tmp_path / "i.yaml")).get("x", "y", default=3) == 3
    out, log = R.ingest(spark, {"A": lambda: R.observations_json(spark, str(tmp_path / "o.json"), "A"), "B": lambda: 1 / 0})
    assert out.count() == 1 and {r["indicator_id"]: r["status"] for r in log.collect()} == {"A": "ok", "B": "failed"}


def test_sinks(spark, tmp_path):
    from geoloom.schema import PANEL, SchemaMismatch, require
    from geoloom.sources import writers as W

    p = make_panel(spark, {"A": [1, 2], "B": [3, 4]})
    path = str(tmp_path / "panel")
    W.replace_partitions(p, path, ["indicator_id"])
    W.replace_partitions(make_panel(spark, {"B": [9.0]}), path, ["indicator_id"])
    assert sorted(r["value"] for r in spark.read.parquet(path).collect()) == [1, 2, 9]
    up = W.upsert(p, make_panel(spark, {"A": [5.0]}), ["indicator_id", "date"])
    assert up.count() == 4 and up.where("value = 5").count() == 1
    run = W.RunManifest(spark, str(tmp_path / "run"), "r1")
    assert run.run({"one": lambda: None}) == ["one"]
    with pytest.raises(ZeroDivisionError):
        run.run({"two": lambda: 1 / 0})
    assert {r["status"] for r in run.steps().collect()} == {"ok", "failed"}
    run.lock("panel", p)
    run.check("panel", p.repartition(3))
    with pytest.raises(W.LockedError):
        run.check("panel", p.limit(3))
    text, digest = W.markdown_report("T", {"panel": p})
    assert len(digest) == 64 and "| A |" in text and "HURST" in W.text_report("R", {"hurst": {"A": 0.5}})
    assert require(p, PANEL).columns == ["indicator_id", "date", "value"]
    with pytest.raises(SchemaMismatch):
        require(p.drop("value"), PANEL)


# ---- streams


def test_stream_equals_batch(spark, tmp_path):
    from geoloom.streaming.trackers import sliding_stats, track

    rng = np.random.default_rng(9)
    ts = pd.date_range("2024-01-01", periods=90, freq="h")
    data = pd.DataFrame([(e, t.to_pydatetime(), float(abs(x))) for e in ("a", "b") for t, x in zip(ts, rng.normal(size=90))], columns=["entity", "ts", "distance"])
    src = str(tmp_path / "in")
    for k in range(3):  # files arrive in time order
        part = data[(data["ts"] >= ts[30 * k]) & (data["ts"] <= ts[30 * k + 29])]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("entity string, ts timestamp, distance double").option("maxFilesPerTrigger", 1).parquet(src)
    q = track(stream, 1.0).writeStream.format("memory").queryName("tracked").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    seen = spark.table("tracked").toPandas().sort_values("n")
    last = {r["entity"]: r for r in seen.to_dict("records")}
    batch = {r["entity"]: r for r in dynamics.excursion_summary(spark.createDataFrame(data).withColumnRenamed("ts", "date"), 1.0).collect()}
    for e in "ab":
        assert last[e]["n"] == 90 and last[e]["late"] == 0
        for f in ("crossings", "episodes", "longest"):
            assert last[e][f] == batch[e][f]
        for f in ("excursion_rate", "churn", "peak"):
            assert last[e][f] == pytest.approx(batch[e][f])
    w = sliding_stats(spark.readStream.schema("entity string, ts timestamp, distance double").parquet(src), "entity", "ts", "distance", "6 hours", "3 hours", "1 hour")
    q = w.writeStream.format("memory").queryName("slid").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM slid").first()[0] == 2 * 180
