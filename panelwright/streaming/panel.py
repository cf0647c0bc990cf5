"""Panel analytics on arriving batches: ingest, running sums, re-detection, scoring, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from panelwright.functions.grid import ScanGrid
from panelwright.operators.moments import Moments, moments_by
from panelwright.operators.transitions import transitions
from panelwright.plans import changepoint as cp
from panelwright.plans import policy, segment
from panelwright.session import materialize
from panelwright.streaming.runner import file_stream, run_available

STATE_SCHEMA = "batch_id int, n_times int, cluster int, offset int, tau int, kappa int, stat double"


def running_moments(stream: DataFrame, p: int) -> DataFrame:
    """Sums of products per subject, kept as streaming state and updated by every batch."""
    return moments_by(stream, ["subject"], p)


def score(stream: DataFrame, models: DataFrame, states: list[str], fmap, labels: DataFrame | None = None) -> DataFrame:
    """Greedy action and value of arriving rows under their cluster's model."""
    rows = stream if labels is None else stream.join(labels, "subject")
    cluster = F.col("cluster") if labels is not None else F.lit(0)
    feats = fmap.terms([F.col(c) for c in states])
    flat = rows.select(cluster.cast("int").alias("cluster"), "subject", "t",
                       *[c.cast("double").alias(f"x{i}") for i, c in enumerate(feats)])
    return policy.greedy_from_table(flat, models).select("subject", "t", "cluster", "opt_action", "opt_value")


def reward_report(stream: DataFrame, time: str, value: str, cluster: str, length: str = "1 day",
                  delay: str = "2 days") -> DataFrame:
    """(start, cluster, reward, n): mean per window, overall (cluster NULL) and per cluster."""
    each = F.explode(F.array(F.col(cluster), F.lit(None).cast("string"))).alias("cluster")
    rows = stream.withWatermark(time, delay).select(time, value, each)
    return rows.groupBy(F.window(time, length), "cluster").agg(
        F.avg(value).alias("reward"), F.count(F.lit(1)).alias("n")
    ).select(F.col("window.start").alias("start"), "cluster", "reward", "n")


def deduplicated(stream: DataFrame, time: str, key: str, delay: str = "2 days") -> DataFrame:
    """Rows once each, as long as copies arrive within the delay; later rows are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sliding_counts(stream: DataFrame, time: str, key: str, length: str, slide: str, delay: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, length, slide), key).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(
        F.count(F.lit(1)).alias("n")).select(
            F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


class OnlineCusum(StatefulProcessor):
    """Running mean and cumulative deviation of every subject, one step at a time.

    State: number of steps, their sum, the cumulative deviation and the last t.
    A row at or before the last t seen is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cusum", "n bigint, s double, dev double, last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, s, dev, last = self.state.get() if self.state.exists() else (0, 0.0, 0.0, -1)
        batch = pd.concat(list(rows)).sort_values("t", kind="stable").drop_duplicates("t")
        batch = batch[batch["t"] > last]
        t, x = batch["t"].to_numpy(), batch["s1"].to_numpy(float)
        total, count = np.cumsum(np.append(s, x)), n + np.arange(len(x) + 1)
        step = x - total[:-1] / np.maximum(count[:-1], 1)
        if not n:
            step[:1] = 0.0
        path = np.cumsum(np.append(dev, step))
        self.state.update((int(count[-1]), float(total[-1]), float(path[-1]), int(t[-1]) if len(t) else last))
        yield pd.DataFrame({"subject": key[0], "t": t, "fwd": total[1:] / np.maximum(count[1:], 1), "dev": path[1:]})

    def close(self) -> None:
        pass


def online_cusum(stream: DataFrame) -> DataFrame:
    """(subject, t, fwd, dev) for arriving (subject, t, s1).

    A subject's rows of one micro-batch meet in one group; its length is the
    number of new steps, not its history. Needs the RocksDB state store.
    """
    return stream.groupBy("subject").transformWithStateInPandas(
        statefulProcessor=OnlineCusum(), outputStructType="subject bigint, t int, fwd double, dev double",
        outputMode="Append", timeMode="None")


class StepBuffer(StatefulProcessor):
    """Joins each subject's steps to transitions as they arrive, in whatever order, and sums them up.

    A key holds all subjects of a bucket (:func:`bucket`), so that a call works on arrays of many subjects.
    State: the steps that may still meet a neighbour, and the sums of products of each subject so far. A
    transition is made as soon as both of its steps are there. A step is let go once the watermark has
    passed the time of the step after it, by a timer if the bucket gets nothing more; the same
    step delivered again before that is dropped.
    """

    def __init__(self, p: int, origin: int, step: int, sums: bool):
        self.p, self.origin, self.step, self.sums = p, origin, step, sums
        self.layout = Moments(p)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("steps", "subject binary, t binary, x binary, known binary, sums binary")

    def _read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Subject, t and values of the steps held; the subjects with sums, in order, and their sums."""
        subject, t, x, known, sums = self.state.get() if self.state.exists() else (b"",) * 5
        return (np.frombuffer(subject, np.int64), np.frombuffer(t, np.int64), np.frombuffer(x).reshape(-1, self.p + 1),
                np.frombuffer(known, np.int64), np.frombuffer(sums).reshape(-1, len(self.layout.names)))

    def _keep(self, subject: np.ndarray, t: np.ndarray, x: np.ndarray, known: np.ndarray, sums: np.ndarray, watermark: int) -> None:
        held = self.origin + (t + 1) * self.step >= watermark
        self.state.update(tuple(v.tobytes() for v in (subject[held], t[held], x[held], known, sums)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if held.any():
            self.handle.registerTimer(int(self.origin + (t[held].max() + 1) * self.step + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*[f"s{i + 1}" for i in range(self.p)], "a"]
        watermark = timerValues.getCurrentWatermarkInMs()
        old_subject, old_t, old_x, known, sums = self._read()
        batch = pd.concat(list(rows))
        batch = batch[self.origin + batch["t"] * self.step >= watermark]
        subject = np.concatenate([old_subject, batch["subject"].fillna(0).to_numpy(np.int64)])
        t = np.concatenate([old_t, batch["t"].to_numpy(np.int64)])
        # Held steps come first among equal ones, and the first stays.
        order = np.lexsort((t, subject))
        order = order[np.append(True, (np.diff(subject[order]) != 0) | (np.diff(t[order]) != 0))[: len(order)]]
        new = (np.arange(len(t)) >= len(old_t))[order]
        subject, t, x = subject[order], t[order], np.concatenate([old_x, batch[names].to_numpy(float)])[order]
        at = np.flatnonzero((np.diff(subject) == 0) & (np.diff(t) == 1) & (new[1:] | new[:-1]))
        s, y, a = x[at, : self.p], x[at + 1, : self.p], x[at, self.p]
        if self.sums:
            changed, first = np.unique(subject[at], return_index=True)
            before, known = known, np.union1d(known, changed)
            total = np.zeros((len(known), len(self.layout.names)))
            total[np.searchsorted(known, before)] = sums
            if len(at):
                total[np.searchsorted(known, changed)] += np.add.reduceat(self.layout.products(s, y, a), first)
            sums = total
        self._keep(subject, t, x, known, sums, watermark)
        if not len(at):
            return
        # The bucket of null holds that subject only.
        name = (lambda ids: np.full(len(ids), None)) if key[0] is None or key[0] < 0 else (lambda ids: ids)
        if self.sums:
            found = pd.DataFrame(sums[np.searchsorted(known, changed)], columns=self.layout.names)
            found.insert(0, "subject", name(changed))
            yield found
        else:
            yield pd.DataFrame({"subject": name(subject[at]), "t": t[at], **{f"s{i + 1}": s[:, i] for i in range(self.p)}, "a": a.astype(int),
                                **{f"y{i + 1}": y[:, i] for i in range(self.p)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(*self._read(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


#: Keys of the step buffer: its calls and state rows, whatever the number of subjects.
BUCKETS = 512


def bucket():
    """The bucket of a step's subject; steps without a subject have one of their own."""
    return F.when(F.col("subject").isNull(), -1).otherwise(F.pmod(F.xxhash64("subject"), F.lit(BUCKETS)).cast("int")).alias("bucket")


def _steps(stream: DataFrame, p: int, origin: str, step: str, delay: str) -> tuple[DataFrame, int, int]:
    spark = stream.sparkSession
    row = spark.range(1).select(
        F.unix_millis(F.lit(origin).cast("timestamp")).alias("origin"),
        F.unix_millis(F.lit(origin).cast("timestamp") + F.expr(f"interval {step}")).alias("next")).first()
    length = row["next"] - row["origin"]
    at = F.timestamp_millis(F.lit(row["origin"]) + F.col("t").cast("long") * length)
    return stream.withColumn("at", at).withWatermark("at", delay), row["origin"], length


def streamed_transitions(stream: DataFrame, p: int, delay: str, origin: str = "2000-01-01", step: str = "1 day") -> DataFrame:
    """(subject, t, s*, a, y*): transitions of arriving steps (subject, t, s*, a), in any order within the delay.

    ``t`` counts steps of equal length from ``origin``, a day after 1970-01-01; ``delay`` is the time that a step may come late.
    Needs the RocksDB state store (:func:`runner.stateful_session`).
    """
    timed, start, length = _steps(stream, p, origin, step, delay)
    schema = "subject bigint, t int, " + "".join(f"s{i + 1} double, " for i in range(p)) + "a int" + "".join(
        f", y{i + 1} double" for i in range(p))
    return timed.withColumn("bucket", bucket()).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=StepBuffer(p, start, length, False), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def streamed_moments(stream: DataFrame, p: int, delay: str, origin: str = "2000-01-01", step: str = "1 day") -> DataFrame:
    """(subject, sums of products): as :func:`running_moments`, from steps instead of transitions."""
    timed, start, length = _steps(stream, p, origin, step, delay)
    schema = "subject bigint, " + ", ".join(f"{c} double" for c in Moments(p).names)
    return timed.withColumn("bucket", bucket()).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=StepBuffer(p, start, length, True), outputStructType=schema, outputMode="Update", timeMode="EventTime")


class BatchArrival:
    """The batch-arrival loop: sums, latest change points, labels and policies, resumable.

    ``source`` receives files of (subject, t, s1.., a), each subject's steps in order. ``process``
    handles whatever is new; calling it again without new files does nothing. Each
    batch's output is a folder of its own, so a replayed batch changes nothing.

    A batch reads its own rows, the last step of each subject before it (``halo``), and the
    sums per (cluster, t) of the batches before. The rows of earlier batches are kept in
    ``history`` and not read again. With ``k`` the subjects are clustered anew in every batch, on the
    transitions since the latest change; ``refit(rows, batch_id)`` gets the labelled rows after each
    cluster's change and returns a table of models for ``models``. Both read the batches since that change.

    ``offsets``: ``cluster`` tests each cluster from its own latest change on, ``common`` all of
    them from the latest change of any. New labels make the offset common.
    """

    def __init__(self, spark: SparkSession, source: str, root: str, schema, p: int = 1, limits=None,
                 draws: int = 2000, alpha: float = 0.01, assignment: DataFrame | None = None, offsets: str = "cluster",
                 k: int | None = None, refit: Callable[[DataFrame, int], DataFrame] | None = None):
        self.spark, self.source, self.root, self.schema = spark, source, root.rstrip("/"), schema
        self.p, self.limits, self.draws, self.alpha, self.assignment = p, limits, draws, alpha, assignment
        self.offsets, self.k, self.refit = "common" if k else offsets, k, refit

    def process(self) -> None:
        run_available(file_stream(self.spark, self.source, self.schema), f"{self.root}/checkpoint", self._handle)

    def history(self) -> DataFrame:
        """All rows so far, with the ``batch_id`` of their folder."""
        return self._table("history", self.schema)

    def log(self) -> DataFrame:
        """(batch_id, n_times, cluster, offset, tau, kappa, stat) of all batches."""
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.root}/log")

    def labels(self, batch_id: int) -> DataFrame | None:
        """(subject, cluster) in a batch; None if all subjects are one cluster."""
        if self.k is None:
            return self.assignment
        return self.spark.read.parquet(f"{self.root}/labels/batch_id={batch_id}")

    def _table(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields, StructField("batch_id", IntegerType())])).parquet(
            f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.root}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _logged(self, batch_id: int) -> tuple[dict[int, int], dict[int, int]]:
        """Latest change point of each cluster, and the number of steps after each batch, before this batch."""
        try:
            rows = self.log().filter(F.col("batch_id") < batch_id).groupBy("cluster").agg(F.max("tau").alias("tau")).collect()
            ends = self.log().filter(F.col("batch_id") < batch_id).groupBy("batch_id").agg(F.max("n_times").alias("n")).collect()
        except AnalysisException:
            return {}, {}
        return {r["cluster"]: r["tau"] or 0 for r in rows}, {r["batch_id"]: r["n"] for r in ends}

    def _since(self, offset: int, ends: dict[int, int], batch_id: int, schema) -> DataFrame:
        """Transitions from step ``offset`` on; only batches that reach beyond it are read."""
        wanted = [b for b, n in ends.items() if n - 2 >= offset] + [batch_id]
        return self._table("steps", schema).filter(F.col("batch_id").isin(wanted) & (F.col("t") >= offset)).drop("batch_id")

    def _handle(self, batch: DataFrame, batch_id: int) -> None:
        states = [f"s{i + 1}" for i in range(self.p)]
        batch = self._write(batch, "history", batch_id)
        if batch.isEmpty():
            return
        taus, ends = self._logged(batch_id)
        joined = batch
        if ends:
            joined = joined.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.root}/halo/batch_id={max(ends)}"))
        rest = [c for c in batch.columns if c not in ("subject", "t")]
        last = joined.groupBy("subject").agg(F.max("t").alias("t"), F.max_by(F.struct(*rest), "t").alias("r"))
        halo = self._write(last.select("subject", "t", "r.*").select(*batch.columns), "halo", batch_id)
        n_times = halo.agg(F.max("t")).first()[0] + 1
        steps = self._write(transitions(joined, states), "steps", batch_id)
        latest = max(taus.values(), default=0)
        if self.k:
            since = self._since(latest, ends, batch_id, steps.schema)
            found = segment.cluster_by_dynamics(segment.prepared(since, self.p), self.k, self.p)
            labels = self._write(found.scored.select("subject", "cluster"), "labels", batch_id)
            mom = cp.time_moments(cp.label(since, labels), self.p)
            taus = {c: latest for c in range(self.k)}
        else:
            own = self._write(cp.time_moments(cp.label(steps, self.assignment), self.p), "sums", batch_id)
            before = self._table("sums", own.schema).filter(F.col("batch_id") <= batch_id)
            mom = before.groupBy("cluster", "t").agg(*[F.sum(c).alias(c) for c in Moments(self.p).names])
        found = self._detect(mom, taus, latest, n_times)
        log = self._write(found, "log", batch_id)
        if self.refit:
            at = {r["cluster"]: r["tau"] for r in log.collect()}
            lowest = min(at.values(), default=0)
            rows = cp.label(self._since(lowest, ends, batch_id, steps.schema), self.labels(batch_id))
            start = F.create_map(*[F.lit(v) for pair in at.items() for v in pair]) if at else None
            rows = rows if start is None else rows.filter(F.col("t") >= F.coalesce(start[F.col("cluster")], F.lit(0)))
            self._write(self.refit(rows, batch_id), "models", batch_id)

    def _detect(self, mom: DataFrame, taus: dict[int, int], latest: int, n_times: int) -> DataFrame:
        """The log's rows of a batch: clusters with one offset are tested together."""
        groups: dict[int, list[int]] = {}
        for cluster, tau in taus.items():
            groups.setdefault(latest if self.offsets == "common" else tau, []).append(cluster)
        # A cluster without an earlier log starts at 0, or at the common offset.
        fresh = latest if self.offsets == "common" else 0
        groups.setdefault(fresh, [])
        found = None
        for offset, clusters in sorted(groups.items()):
            named = F.col("cluster").isin(clusters) if clusters else F.lit(False)
            if offset == fresh:
                others = [c for o, cs in groups.items() if o != fresh for c in cs]
                named = ~F.col("cluster").isin(others) if others else F.lit(True)
            part = mom.filter(named & (F.col("t") >= offset)).withColumn("t", (F.col("t") - offset).cast("int"))
            length = n_times - offset
            # The window grid follows the length of the part under test.
            grid = ScanGrid(length, kappa_min=max(int(0.1 * length), 5), kappa_max=int(0.9 * length),
                            step=max(length // 50, 1), eps=1.0 / length)
            limits = None
            if self.limits is not None:
                limits = self.spark.range(1).select(
                    F.explode(grid.kappa_column()).alias("kappa"), F.lit(float(self.limits)).alias("threshold"))
            one = cp.detect_transition_change(None, grid, self.p, limits=limits, draws=self.draws, alpha=self.alpha, mom=part)
            one = one.select(
                F.lit(n_times).alias("n_times"), F.col("cluster").cast("int").alias("cluster"), F.lit(offset).alias("offset"),
                # Found change points are counted from the offset and carried over.
                (F.col("tau") + offset).cast("int").alias("tau"), "kappa", "stat")
            found = one if found is None else found.unionByName(one)
        return found


class LateRows:
    """Rows in time in one table, late ones in another; repeated ones are counted.

    A row is late if its time lies more than ``delay`` before the latest time of the batches
    before its own, as with a watermark; where a watermark drops it, it goes to a table of its own. A row
    in time whose ``key`` came before, in this batch or within the delay, is a repeat. A batch
    reads the keys that are still within the delay, not all of history.
    """

    def __init__(self, spark: SparkSession, root: str, schema, time: str, key: str, delay: str, source: str, max_files: int | None = 1):
        self.spark, self.root, self.schema, self.time, self.key, self.delay = spark, root.rstrip("/"), schema, time, key, delay
        self.source, self.max_files = source, max_files

    def process(self) -> None:
        run_available(file_stream(self.spark, self.source, self.schema, self.max_files), f"{self.root}/checkpoint", self._handle)

    def table(self, name: str) -> DataFrame:
        """``main`` or ``late``, with the ``batch_id``."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("batch_id", IntegerType())])).parquet(
            f"{self.root}/{name}")

    def counts(self) -> DataFrame:
        """(batch_id, main, late, repeated, latest): rows of each kind and the latest time of each batch."""
        return self.spark.read.parquet(f"{self.root}/counts")

    def _handle(self, batch: DataFrame, batch_id: int) -> None:
        time = F.col(self.time)
        latest = None
        if batch_id:
            latest = self.counts().filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        rows = materialize(batch, "arrived")
        mark = None if latest is None else F.lit(latest) - F.expr(f"interval {self.delay}")
        in_time = rows if mark is None else rows.filter(time.isNull() | (time >= mark))
        late = rows.limit(0) if mark is None else rows.filter(time < mark)
        fresh = in_time.filter(F.col(self.key).isNull()).unionByName(in_time.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key]))
        if mark is not None:
            known = self.table("main").filter((F.col("batch_id") < batch_id) & (time >= mark)).select(self.key)
            fresh = fresh.join(known.distinct(), self.key, "left_anti").select(*rows.columns)
        out = {}
        for name, part in (("main", fresh), ("late", late)):
            path = f"{self.root}/{name}/batch_id={batch_id}"
            part.write.mode("overwrite").parquet(path)
            out[name] = self.spark.read.schema(part.schema).parquet(path).count()
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(self.time).alias("latest")).first()
        counted = self.spark.createDataFrame(
            [(out["main"], out["late"], facts["n"] - out["main"] - out["late"], facts["latest"])],
            StructType([StructField("main", LongType()), StructField("late", LongType()), StructField("repeated", LongType()),
                        StructField("latest", self.schema[self.time].dataType)]))
        counted.write.mode("overwrite").parquet(f"{self.root}/counts/batch_id={batch_id}")
