"""Transitions, validation, scaling, ranking, files."""

import numpy as np
import pandas as pd
import pytest
from conftest import change_panel  # noqa: F401
from conftest import step_arrays
from pyspark.sql import functions as F

from panelwright.functions import features, grid, scalars
from panelwright.operators import ranking, scaling, transitions as tr
from panelwright.sources import files, tables


def test_transitions_do_not_depend_on_blocks(spark, change_panel):
    df = spark.createDataFrame(change_panel)
    want = step_arrays(change_panel)
    for block in (None, 1, 7, 4096):
        got = tr.transitions(df, ["s1"], block=block).toPandas().sort_values(["subject", "t"])
        assert np.array_equal(got["subject"], want[0]) and np.array_equal(got["t"], want[1])
        assert np.array_equal(got["y1"], want[4][:, 0]) and np.array_equal(got["r"], got["y1"])


def test_gap_is_not_bridged(spark, change_panel):
    df = spark.createDataFrame(change_panel[~((change_panel.subject == 3) & (change_panel.t == 10))])
    for block in (None, 10, 11):
        got = tr.transitions(df, ["s1"], block=block).filter("subject = 3").toPandas()
        assert {9, 10}.isdisjoint(set(got["t"])) and len(got) == 48


def test_validation_lists_every_breach(spark, change_panel):
    pdf = change_panel.copy()
    pdf.loc[(pdf.subject == 5) & (pdf.t == 7), "a"] = 2
    pdf.loc[(pdf.subject == 6) & (pdf.t == 8), "s1"] = np.nan
    pdf = pd.concat([pdf[~((pdf.subject == 3) & (pdf.t == 10))], pdf[(pdf.subject == 4) & (pdf.t == 20)]])
    got = {tuple(r) for r in tr.validation_report(spark.createDataFrame(pdf), 51, ["s1"]).collect()}
    assert got == {("duplicate", 4, 20, 2), ("gap", 3, 10, 1), ("bad_action", 5, 7, 1), ("bad_state", 6, 8, 1)}


def test_fill_dense(spark, change_panel):
    df = spark.createDataFrame(change_panel[change_panel.t != 3])
    got = tr.fill_dense(df, 51, {"s1": -1.0, "a": 0})
    assert got.count() == 612 and got.filter("t = 3 and s1 = -1.0").count() == 12


def test_zscore_by_group(spark, change_panel):
    df = spark.createDataFrame(change_panel).withColumn("g", F.col("subject") % 2)
    got = scaling.zscore_by(df, "g", ["s1"]).groupBy("g").agg(F.avg("s1_z").alias("m"), F.stddev_pop("s1_z").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-12 and abs(r["s"] - 1) < 1e-12 for r in got)
    one = scaling.zscore(df, ["s1"]).agg(F.avg("s1_z").alias("m"), F.stddev_pop("s1_z").alias("s")).first()
    assert abs(one["m"]) < 1e-12 and abs(one["s"] - 1) < 1e-12


def test_overflow_report_has_only_overflows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1e200), (3, -1e200), (4, 5.0)], "id int, x double")
    assert {r["id"] for r in scaling.overflow_report(df, "x", ["id"]).collect()} == {2, 3}


@pytest.mark.parametrize("n,folds", [(11, 3), (10, 5), (4, 6), (1, 2)])
def test_chunks_have_the_sizes_of_contiguous_splitting(spark, n, folds):
    # Far outlying and clumped keys: bucket edges must not matter.
    keys = [i * i * i for i in range(n - 1)] + [10**12]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = [r["fold"] for r in ranking.contiguous_chunks(df, "k", folds, buckets=4).orderBy("k").collect()]
    want = [i for i, part in enumerate(np.array_split(np.arange(n), folds)) for _ in part]
    assert got == want


def test_fold_axis_rule():
    assert ranking.fold_plan(10, 3, 5) == ("subject", 5)
    assert ranking.fold_plan(4, 10, 5) == ("time", 5)
    assert ranking.fold_plan(4, 9, 5) == ("row", 5)
    assert ranking.fold_plan(1, 5, 5) == ("row", 3)
    assert ranking.fold_plan(1, 4, 5) == ("none", 0)


def test_folds_by_time_and_row(spark, change_panel):
    df = tr.transitions(spark.createDataFrame(change_panel[change_panel.subject < 2]), ["s1"])
    by_time = ranking.assign_folds(df, 5).groupBy("fold").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("fold").collect()
    assert [(r["lo"], r["hi"]) for r in by_time] == [(0, 9), (10, 19), (20, 29), (30, 39), (40, 49)]
    few = ranking.assign_folds(df.filter("t < 6 and subject = 0"), 4).toPandas()
    assert sorted(few["fold"].tolist()) == [0, 0, 1, 1, 2, 2] or set(few["fold"]) <= {0, 1, 2, 3}


def test_grids(spark):
    g = grid.ScanGrid(82)
    assert g.kappas()[0] == 25 and g.kappas()[-1] == 80
    assert g.splits(25) == list(range(8, 17))
    rows = {(r["kappa"], r["u"]) for r in g.frame(spark).collect()}
    assert rows == {(k, u) for k in g.kappas() for u in g.splits(k)}
    assert grid.linear_grid(100, 100, 0.1, 3) == [10, 50, 90]
    assert grid.parameter_grid({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    one = spark.createDataFrame([(0.5,), (0.74,), (9.0,)], "x double").select(grid.nearest(F.col("x"), [0.0, 1.0, 2.0]).alias("v"))
    assert [r["v"] for r in one.collect()] == [0.0, 1.0, 2.0]


def test_polynomial_terms_are_all_monomials(spark):
    assert features.monomials(2, 2) == [(), (0,), (1,), (0, 0), (0, 1), (1, 1)]
    df = spark.createDataFrame([(2.0, 3.0)], "x double, y double")
    row = df.select(*features.polynomial_terms([F.col("x"), F.col("y")], 2)).first()
    assert list(row) == [1.0, 2.0, 3.0, 4.0, 6.0, 9.0]


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    r = df.select(scalars.running_sum(F.col("x")).alias("c"), scalars.positions(F.col("x"), lambda v: v > 1).alias("p"),
                  scalars.dot(F.col("x"), F.reverse("x")).alias("d")).first()
    assert r["c"] == [1.0, 3.0, 6.0] and r["p"] == [1, 2] and r["d"] == 10.0


def test_daily_panel_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "STUDY_PRTCPT_ID,Date,Day,STEP_COUNT,SLEEP_COUNT,MOOD,Notification_type,TeamName\n"
        "a,2020-04-02,1,20.5,19.0,7.0,steps,x_Surgery\na,2020-04-01,0,18.5,18.0,6.0,none,x_Surgery\n")
    got = files.daily_panel(spark, str(tmp_path / "d.csv")).orderBy("t").collect()
    assert [(r["subject"], r["t"], r["s1"], r["a"], r["specialty"]) for r in got] == [
        ("a", 0, 18.5, 0, "Surgery"), ("a", 1, 20.5, 1, "Surgery")]


def test_rerun_replaces_its_own_partition_only(spark, tmp_path):
    path = str(tmp_path / "res")
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "setting string, seed int, value double")
    assert files.pending(df, path, ["setting", "seed"]).count() == 2
    files.write_results(df, path, ["setting", "seed"])
    files.write_results(df.filter("setting = 'a'").withColumn("value", F.lit(9.0)), path, ["setting", "seed"])
    got = {(r["setting"], r["value"]) for r in files.read_results(spark, path).collect()}
    assert got == {("a", 9.0), ("b", 2.0)}
    more = df.union(spark.createDataFrame([("c", 3, 3.0)], df.schema))
    assert [r["setting"] for r in files.pending(more, path, ["setting", "seed"]).collect()] == ["c"]
    assert files.pending(more, path, ["setting", "seed"], refit=True).count() == 3


def test_checkpoint_dir_is_required_on_a_cluster(spark):
    from panelwright import session

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)


def test_horizon_follows_the_data(spark):
    """Every month of the table is in the panel; a date keeps a begun month out only if given."""
    sf = "/root/testdata/sf0.001"
    n = tables.horizon(spark, sf)
    panel = tables.supplier_month(spark, sf)
    assert panel.agg(F.max("t")).first()[0] == n - 1
    assert tables.supplier_month(spark, sf, until="2001-11-01").agg(F.max("t")).first()[0] < n - 1
