"""Result tables, the two-group test and small helpers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelwright.operators import pairs, summary


def results(spark):
    rows = [(s, p, seed, float(10 * (p == "x") + seed + 3 * (s == "b"))) for s in "ab" for p in "xyz" for seed in range(5)]
    return spark.createDataFrame([r for r in rows if r[:3] != ("a", "x", 4)], "setting string, policy string, seed int, value double")


def test_differences_to_the_reference(spark):
    long = summary.melt(results(spark), ["setting", "policy", "seed"], ["value"])
    got = summary.difference_to_reference(long, "x").toPandas().set_index(["setting", "policy", "seed"])["diff"]
    assert got["a", "y", 0] == 10.0 and got["a", "x", 0] == 0.0 and np.isnan(got["a", "y", 4]) and len(got) == 29
    m = summary.mean_se(results(spark), ["setting", "policy"], "value").filter("setting = 'b' and policy = 'y'").first()
    assert m["mean"] == 5.0 and abs(m["se"] - np.std([0, 1, 2, 3, 4], ddof=1) / np.sqrt(5)) < 1e-12
    t = summary.mean_se_table(results(spark), ["setting", "policy"], "value").filter("setting = 'b' and policy = 'y'").first()
    assert t["text"] == "5.000 (0.707)"


def test_horizon_average_ignores_missing(spark):
    df = spark.createDataFrame([("m", 1, 2.0), ("m", 2, 4.0), ("k", 1, 5.0)], "method string, h int, v double")
    got = {r["method"]: r["average"] for r in summary.horizon_table(df, "method", "h", "v", [1, 2, 3]).collect()}
    assert got == {"m": 3.0, "k": 5.0}


def test_effect_names(spark):
    three = spark.createDataFrame([(0.1,), (0.5,), (0.3,), (0.1,)], "e double")
    assert {r["e"]: r["effect"] for r in summary.name_effects(three, "e").collect()} == {0.5: "Strong", 0.3: "Moderate", 0.1: "Weak"}
    two = spark.createDataFrame([(0.1,), (0.5,)], "e double")
    assert {r["effect"] for r in summary.name_effects(two, "e").collect()} == {"0.1", "0.5"}


def test_exceedance_equals_comparison(spark):
    v = [float(x % 17) for x in range(200)]
    stats = spark.createDataFrame([(i, float(i)) for i in (-1, 3, 3, 16, 20)], "i int, s double")
    got = summary.exceedance(stats, "s", spark.createDataFrame([(x,) for x in v], "v double"), "v").collect()
    for r in got:
        assert abs(r["pvalue"] - np.mean([r["s"] < x for x in v])) < 1e-12


def test_smallest_per_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.pmod(F.col("id") * 7919, F.lit(1009)).alias("e"), F.col("id").alias("subject"))
    got = summary.smallest(df, "k", ["e", "subject"], 4).orderBy("k", "rn").toPandas()
    want = df.toPandas().sort_values(["k", "e", "subject"]).groupby("k").head(4)
    assert got["subject"].tolist() == want["subject"].tolist()


def test_manova(spark):
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(size=(80, 3)), rng.normal(size=(60, 3)) + [0.4, 0, 0]
    pdf = pd.DataFrame(np.vstack([x0, x1]), columns=["s1", "s2", "s3"]).assign(after=[False] * 80 + [True] * 60, cluster=1)
    got = summary.manova(spark.createDataFrame(pdf), ["s1", "s2", "s3"], "after", "cluster").first()
    w = (x0 - x0.mean(0)).T @ (x0 - x0.mean(0)) + (x1 - x1.mean(0)).T @ (x1 - x1.mean(0))
    every = np.vstack([x0, x1])
    total = (every - every.mean(0)).T @ (every - every.mean(0))
    assert abs(got["wilks"] - np.linalg.det(w) / np.linalg.det(total)) < 1e-10
    assert abs(got["pillai"] + got["wilks"] - 1) < 1e-12 and got["df2"] == 136


def test_f_tail():
    # Recorded two-group results, and quantiles of the F table.
    assert abs(summary.f_tail(7.8213, 3, 86012) - 3.2e-5) < 1e-5
    assert abs(summary.f_tail(3.49, 3, 12) - 0.05) < 2e-4 and abs(summary.f_tail(4.96, 1, 10) - 0.05) < 2e-4


def test_series_correlation(spark):
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(7, 30))
    wide[2, 5] = np.nan
    rows = [(i, t, float(wide[i, t])) for i in range(7) for t in range(30) if not np.isnan(wide[i, t])]
    df = spark.createDataFrame(rows, "subject bigint, t int, s1 double")
    want = pd.DataFrame(wide.T).corr()
    for block in (2, 3, 100):
        got = {(r["i"], r["j"]): r["corr"] for r in pairs.series_correlation(df, "s1", block).collect()}
        assert len(got) == 21 and all(abs(v - want[i][j]) < 1e-10 for (i, j), v in got.items())


def test_quantiles_equal_numpy_with_ties_and_groups(spark):
    from panelwright.operators import ranking

    rng = np.random.default_rng(2)
    # A third of group 0 is one value.
    v0 = np.concatenate([rng.normal(size=400), np.full(200, 0.25)])
    v1 = rng.integers(0, 5, 31).astype(float)
    df = spark.createDataFrame([(0, float(x)) for x in v0] + [(1, float(x)) for x in v1] + [(1, None)], "g int, x double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0}
    for r in ranking.quantiles(df, ["g"], "x", probs).collect():
        for name, p in probs.items():
            assert abs(r[name] - np.quantile(v0 if r["g"] == 0 else v1, p)) < 1e-12
    whole = ranking.quantiles(df, [], "x", {"m": 0.5}).first()["m"]
    assert abs(whole - np.median(np.concatenate([v0, v1]))) < 1e-12
