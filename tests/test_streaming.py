"""Streams give what a batch gives, and go on where they stopped."""

import os

import numpy as np
import pandas as pd
from conftest import step_arrays
from pyspark.sql import functions as F

from panelwright.operators.moments import moments_by
from panelwright.operators.transitions import transitions
from panelwright.streaming import panel as sp
from panelwright.streaming import runner


def test_running_sums_equal_the_batch(spark, change_panel, tmp_path):
    trans = transitions(spark.createDataFrame(change_panel), ["s1"])
    path = str(tmp_path / "in")
    for lo in (0, 25):
        trans.filter(F.col("t").between(lo, lo + 24)).write.mode("append").parquet(path)
    stream = runner.file_stream(spark, path, trans.schema, max_files=1)
    got = runner.run_to_table(sp.running_moments(stream, 1), "state", "update", ["subject"]).orderBy("subject").toPandas()
    want = moments_by(trans, ["subject"], 1).orderBy("subject").toPandas()
    for c in want.columns:
        assert (abs(got[c] - want[c]) < 1e-9).all()


def test_batch_loop_resumes_and_finds_the_change(spark, change_panel, tmp_path):
    df = spark.createDataFrame(change_panel).withColumn("subject", F.col("subject").cast("bigint")).withColumn(
        "t", F.col("t").cast("int")).withColumn("a", F.col("a").cast("int"))
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    df.filter("t < 26").write.mode("append").parquet(src)
    loop = sp.BatchArrival(spark, src, root, df.schema, draws=1000)
    loop.process()
    loop.process()
    assert loop.log().count() == 1 and loop.log().first()["tau"] == 0
    df.filter("t >= 26").write.mode("append").parquet(src)
    again = sp.BatchArrival(spark, src, root, df.schema, draws=1000)
    again.process()
    again.process()
    log = {r["batch_id"]: r for r in again.log().collect()}
    assert set(log) == {0, 1} and log[1]["n_times"] == 51 and 23 <= log[1]["tau"] <= 26
    assert again.history().count() == len(change_panel)


def test_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    runner.write_batch(out)(df, 0)
    runner.write_batch(out)(df, 0)
    assert spark.read.parquet(out).count() == 1


def test_duplicates_are_dropped_within_the_delay(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:00") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, s string").select("id", F.to_timestamp("s").alias("ts"))
    path = str(tmp_path / "in")
    df.union(df).write.parquet(path)
    got = runner.run_to_table(sp.deduplicated(runner.file_stream(spark, path, df.schema), "ts", "id", "10 days"), "dedup")
    assert got.count() == 9


def test_newest_row_per_key(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (2, 1, "c")], "k int, batch_id int, v string")
    assert {(r["k"], r["v"]) for r in runner.newest(df, ["k"]).collect()} == {(1, "b"), (2, "c")}


def steps_of(spark, change_panel):
    return spark.createDataFrame(change_panel).select(
        F.col("subject").cast("bigint"), F.col("t").cast("int"), "s1", F.col("a").cast("int"))


def test_steps_in_any_order_become_transitions(spark, change_panel, tmp_path):
    """Files cut at odd places, rows late, twice and never: the transitions and sums of the batch."""
    df = steps_of(spark, change_panel).filter("not (subject = 3 and t = 10)")
    place = F.floor((F.col("t") + F.pmod(F.xxhash64("subject", "t"), F.lit(23))) / 17)
    want = {(r.subject, r.t): r for r in transitions(df, ["s1"]).collect()}
    for name, make in (("rows", sp.streamed_transitions), ("sums", sp.streamed_moments)):
        path, root = str(tmp_path / f"in-{name}"), str(tmp_path / name)
        session = runner.stateful_session(spark)
        for b in range(5):
            part = df.filter(place == b)
            part.union(part.filter("subject = 1")).write.mode("append").parquet(path)
            stream = make(runner.file_stream(session, path, df.schema), 1, "40 days")
            runner.run_available(stream, f"{root}/checkpoint", runner.write_batch(f"{root}/out"), "append" if name == "rows" else "update")
        got = spark.read.parquet(f"{root}/out")
        if name == "rows":
            rows = got.collect()
            assert len(rows) == len(want) and {(r.subject, r.t) for r in rows} == set(want)
            assert all((r.s1, r.y1, r.a) == (want[r.subject, r.t].s1, want[r.subject, r.t].y1, want[r.subject, r.t].a) for r in rows)
        else:
            sums = runner.newest(got, ["subject"]).orderBy("subject").toPandas()
            plain = moments_by(transitions(df, ["s1"]), ["subject"], 1).orderBy("subject").toPandas()
            for c in plain.columns:
                assert (abs(sums[c] - plain[c]) < 1e-9).all()
    assert "rocksdb" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass").lower()


class Held:
    """State and timers of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: iter(list(self.timers))
    registerTimer = lambda self, at: self.timers.append(at)
    deleteTimer = lambda self, at: self.timers.remove(at)
    getCurrentWatermarkInMs = lambda self: 0

    def update(self, value):
        self.value = value


def test_a_key_of_the_step_buffer_holds_many_subjects(change_panel):
    """One call for the steps of all its subjects, some given twice or late; sums as those of each by itself."""
    wide = [Held(), *[Held() for _ in range(12)]]
    buffers = [sp.StepBuffer(1, 0, 1, True) for _ in wide]
    for b, h in zip(buffers, wide):
        b.init(h)
    df = change_panel[~((change_panel.subject == 3) & (change_panel.t == 10))]
    late = (df.subject + df.t) % 7 == 0
    for part in (df[(df.t < 30) & ~late], df[(df.t >= 30) | late], df[df.t > 45]):
        many = [x for x in buffers[0].handleInputRows((5,), iter([part, part]), wide[0])]
        alone = [x for i in range(12) for x in buffers[i + 1].handleInputRows((5,), iter([part[part.subject == i]]), wide[i + 1])]
        assert len(many) == bool(alone)
        if alone:
            want = pd.concat(alone).sort_values("subject").reset_index(drop=True)
            assert many[0].subject.tolist() == want.subject.tolist() and np.allclose(many[0], want, rtol=1e-12, atol=1e-12)
            last = many[0]
    assert len(last) == 12 and last.m_n.sum() == len(step_arrays(df)[0]) and len(wide[0].timers) == 1


def test_steps_of_many_subjects_share_keys(spark, tmp_path):
    """Keys of the buffer don't grow with the subjects; steps without a subject are one by themselves."""
    ids = [*range(3000), None]
    df = spark.createDataFrame([(i, t, float(t + (i or 0)), t % 2) for i in ids for t in range(3)], "subject long, t int, s1 double, a int")
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(path)
    stream = sp.streamed_moments(runner.file_stream(runner.stateful_session(spark), path, df.schema), 1, "40 days")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan
    runner.run_available(stream, f"{root}/checkpoint", runner.write_batch(f"{root}/out"), "update")
    got = {r.subject: (r.m_n, r.m_s0, r.k_y0y0) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {i: (2.0, 2.0 * (i or 0) + 1, (2.0 + (i or 0)) ** 2) for i in ids}
    assert df.select(sp.bucket()).distinct().count() <= sp.BUCKETS + 1


def test_steps_are_let_go_behind_the_watermark(spark, change_panel, tmp_path):
    """A step later than the delay meets nobody."""
    df = steps_of(spark, change_panel)
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    session = runner.stateful_session(spark)
    for where in ("t < 20 and not (subject = 0 and t = 5)", "t between 20 and 40", "t > 40 or (subject = 0 and t = 5)"):
        df.filter(where).write.mode("append").parquet(path)
        stream = sp.streamed_transitions(runner.file_stream(session, path, df.schema), 1, "10 days")
        runner.run_available(stream, f"{root}/checkpoint", runner.write_batch(f"{root}/rows"))
    got = {(r.subject, r.t) for r in spark.read.parquet(f"{root}/rows").collect()}
    assert got == {(i, t) for i in range(12) for t in range(50)} - {(0, 4), (0, 5)}


def cut_loop(spark, df, root, cuts, **kw):
    loop = None
    for b, (low, high) in enumerate(zip(cuts, cuts[1:])):
        df.filter(F.col("t").between(low, high - 1)).write.mode("append").parquet(f"{root}/src")
        loop = sp.BatchArrival(spark, f"{root}/src", f"{root}/out", df.schema, limits=8.0, **kw)
        loop.process()
        yield b, loop


def test_a_batch_does_not_read_earlier_rows(spark, change_panel, tmp_path):
    """Without the rows and transitions of earlier batches the loop goes on and finds the same."""
    df = steps_of(spark, change_panel)
    cuts = [0, 11, 24, 37, 51]
    labels = df.select("subject", (F.col("subject") % 2).cast("int").alias("cluster")).distinct()
    whole = [loop for _, loop in cut_loop(spark, df, str(tmp_path / "a"), cuts, assignment=labels)][-1]
    for b, loop in cut_loop(spark, df, str(tmp_path / "b"), cuts, assignment=labels):
        for name in ("history", "steps"):
            os.rename(f"{tmp_path}/b/out/{name}/batch_id={b}", f"{tmp_path}/b/{name}-{b}")
    key = lambda x: sorted(map(tuple, x.log().select("batch_id", "cluster", "offset", "tau", "kappa").collect()), key=str)
    assert key(whole) == key(loop) and {r[0] for r in key(loop)} == {0, 1, 2, 3}
    sums = whole._table("sums", spark.read.parquet(f"{tmp_path}/a/out/sums/batch_id=0").schema)
    want = transitions(df, ["s1"])
    assert sums.agg(F.sum("m_n")).first()[0] == want.count()
    assert max(r["tau"] for r in whole.log().collect()) >= 23


def test_clusters_go_on_from_their_own_change(spark, change_panel, steady_panel, tmp_path):
    df = steps_of(spark, change_panel).union(steps_of(spark, steady_panel))
    labels = df.select("subject", (F.col("subject") >= 100).cast("int").alias("cluster")).distinct()
    logs = {}
    for kind in ("cluster", "common"):
        for _, loop in cut_loop(spark, df, str(tmp_path / kind), [0, 46, 51], assignment=labels, offsets=kind):
            pass
        logs[kind] = {(r.batch_id, r.cluster): (r.offset, r.tau) for r in loop.log().collect()}
    first = logs["cluster"][0, 0][1]
    assert 20 <= first <= 26 and logs["cluster"][0, 1] == (0, 0)
    assert logs["cluster"][1, 0][0] == first and logs["cluster"][1, 1][0] == 0
    assert logs["common"][1, 0][0] == logs["common"][1, 1][0] == first


def test_labels_and_policies_anew_in_every_batch(spark, change_panel, steady_panel, tmp_path):
    df = steps_of(spark, change_panel).filter("t >= 25").withColumn("t", F.col("t") - 25).union(
        steps_of(spark, steady_panel).filter("t < 26"))
    seen = []

    def refit(rows, batch_id):
        seen.append((batch_id, rows.count()))
        return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"))

    for _, loop in cut_loop(spark, df, str(tmp_path / "k"), [0, 14, 26], k=2, refit=refit):
        pass
    assert [b for b, _ in seen] == [0, 1] and seen[1][1] > seen[0][1]
    labels = loop.labels(1).collect()
    groups = {c: {r.subject >= 100 for r in labels if r.cluster == c} for c in (0, 1)}
    assert len(labels) == 24 and groups[0] != groups[1] and all(len(g) == 1 for g in groups.values())
    assert spark.read.parquet(f"{tmp_path}/k/out/models/batch_id=1").count() == 2


def test_late_rows_are_put_aside(spark, tmp_path):
    schema = "id long, ts timestamp, v double"
    days = [[("a", 1), ("b", 5)], [("c", 3), ("d", 2), ("b", 5)], [("e", 9), ("d", 3)], [("f", 6), ("g", 8), ("e", 9)]]
    ids = {x: i for i, x in enumerate("abcdefg")}
    loop = None
    for batch in days:
        rows = [(ids[k], f"2024-01-{d:02d} 00:00:00", float(d)) for k, d in batch]
        spark.createDataFrame(rows, "id long, s string, v double").select(
            "id", F.to_timestamp("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        loop = loop or sp.LateRows(spark, str(tmp_path / "out"), spark.createDataFrame([], schema).schema, "ts", "id", "2 days", str(tmp_path / "in"))
        loop.process()
        loop.process()
    main = sorted((r.batch_id, r.id) for r in loop.table("main").collect())
    late = sorted((r.batch_id, r.id) for r in loop.table("late").collect())
    assert main == [(0, 0), (0, 1), (1, 2), (2, 3), (2, 4), (3, 6)] and late == [(1, 3), (3, 5)]
    counts = {r.batch_id: (r.main, r.late, r.repeated) for r in loop.counts().collect()}
    assert counts == {0: (2, 0, 0), 1: (1, 1, 1), 2: (2, 0, 0), 3: (1, 1, 1)}
