"""Exact top-k by inner product with vector-approximation files.

Vectors become integers, floor(scale * x). Each shard keeps its vectors twice: as an
approximation, one cell number per component on an even grid of the component's
range, and exactly. For a block of queries a task scans the approximations: the
cells' edges give an upper and a lower bound of every inner product. Exact
vectors are then read in order of falling upper bound, a batch at a time, until
the k-th best exact score is above every bound that is left, so the result is exact
whatever the grid. The best so far carries over from shard to shard in a task.

Queries are a stated set; all rows are candidates. Vectors are dealt into shards of
about ``SHARD`` rows by a hash of the id, queries into blocks of ``BLOCK``, and
each shard meets each block once: no pair of single rows is formed. Each
meeting yields k rows per query; a ranked window with a group limit before its
shuffle merges them.

Defined results: vectors that are null or empty, or hold null or non-finite
components, take no part; only vectors of equal length meet; equal scores go to
the smaller id; a query is no candidate of its own, and rows with equal ids are
never candidates of each other. Scores must fit in a long. An empty table has no
result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import materialize

SCALE = 256.0
BITS = 5
SHARD = 16384
BLOCK = 512
_STEP = 64


def finite(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


class Approximation:
    """Cells of integer vectors, and bounds of inner products from them."""

    def __init__(self, exact: np.ndarray, bits: int):
        low, high = exact.min(0), exact.max(0)
        self.low = low.astype(np.float64)
        self.step = np.maximum(1.0, np.ceil((high - low + 1).astype(np.float64) / (1 << bits)))
        self.cells = np.minimum((exact - self.low) // self.step, (1 << bits) - 1).astype(np.uint8)
        # A rounding error of the bounds is below this share of the largest sum of products.
        self.size = np.maximum(np.abs(self.low), np.abs(high.astype(np.float64)) + self.step)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds, queries x vectors."""
        q = queries.astype(np.float64)
        edge = self.cells * self.step + self.low
        at_low = q @ edge.T
        wide = self.step - 1  # whole numbers: the last of a cell
        up, down = np.maximum(q, 0) @ wide, np.minimum(q, 0) @ wide
        slack = (np.abs(q) @ self.size * 1e-12)[:, None]
        return at_low + up[:, None] + slack, at_low + down[:, None] - slack


def search(exact: np.ndarray, ids: np.ndarray, approximation: Approximation, queries: np.ndarray,
           query_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The k best (score, id) of each query above ``floor``, and how many exact vectors were read.

    ``floor`` holds for each query a score that k others are known to reach; it is raised.
    """
    upper, lower = approximation.bounds(queries)
    out, read = [], 0
    n = len(ids)
    for row, query in enumerate(queries):
        own = ids == query_ids[row]
        up = np.where(own, -np.inf, upper[row])
        sure = floor[row]
        if n > k:
            sure = max(sure, np.partition(np.where(own, -np.inf, lower[row]), n - k)[n - k])
        left = np.flatnonzero((up >= sure) & ~own)
        left = left[np.argsort(-up[left], kind="stable")]
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kth = sure
        for at in range(0, len(left), _STEP):
            if up[left[at]] < kth:
                break
            part = left[at : at + _STEP]
            read += len(part)
            scores = np.concatenate([scores, exact[part] @ query])
            found = np.concatenate([found, ids[part]])
            best = np.lexsort((found, -scores))[:k]
            scores, found = scores[best], found[best]
            if len(scores) == k:
                kth = max(kth, float(scores[-1]))
        if len(scores) == k:
            floor[row] = max(floor[row], float(scores[-1]))
        out.append(np.stack([scores, found]))
    return out, read


def _integers(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of 64-bit integers."""
    for batch in batches:
        vectors = batch.column("vector")
        values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        ends = np.cumsum(vectors.value_lengths().to_numpy())[:-1]
        packed = [x.tobytes() for x in np.split(values, ends)] if len(vectors) else []
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(packed, pa.binary())], names=["id", "vector"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``size`` vectors of one length and shard: (key, dim, ids, vectors)."""
    held: dict[tuple[int, int], list] = {}

    def block(key, rows):
        ids, vectors = zip(*rows)
        return pa.RecordBatch.from_pylist(
            [{"key": key[0], "dim": key[1], "ids": np.array(ids, np.int64).tobytes(), "vectors": b"".join(vectors)}],
            schema=pa.schema([("key", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    for batch in batches:
        for key, i, vector in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "vector"))):
            rows = held.setdefault((key, len(vector) // 8), [])
            rows.append((i, vector))
            if len(rows) >= size:
                yield block((key, len(vector) // 8), held.pop((key, len(vector) // 8)))
    for key, rows in held.items():
        yield block(key, rows)


def _searched(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """k rows (query_id, vec_id, score) for each query of each meeting of a shard and a block of queries."""
    floors: dict[bytes, np.ndarray] = {}
    last: tuple[bytes, Approximation, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if last is None or last[0] != row["ids"]:
                exact = np.frombuffer(row["vectors"], np.int64).reshape(-1, row["dim"])
                last = (row["ids"], Approximation(exact, bits), exact, np.frombuffer(row["ids"], np.int64))
            _, approximation, exact, ids = last
            queries = np.frombuffer(row["q_vectors"], np.int64).reshape(-1, row["dim"])
            query_ids = np.frombuffer(row["q_ids"], np.int64)
            if len(floors) > 4096:
                floors.clear()  # only a head start
            floor = floors.setdefault(row["q_ids"], np.full(len(queries), -np.inf))
            found, _ = search(exact, ids, approximation, queries, query_ids, k, floor)
            score, vec = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, [x.shape[1] for x in found])), pa.array(vec), pa.array(score)],
                names=["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding",
          scale: float = SCALE, bits: int = BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where ``queries`` holds."""
    whole = rows.filter(finite(F.col(vector)) & F.col(id).isNotNull())
    kinds = "id long, vector binary"
    columns = [F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")]
    integers = materialize(whole.select(*columns).mapInArrow(lambda b: _integers(b, scale), kinds), "integers")
    asked = whole.filter(queries).select(*columns).mapInArrow(lambda b: _integers(b, scale), kinds)
    shards = max(1, -(-integers.count() // shard))
    schema = "key int, dim int, ids binary, vectors binary"
    stored = (
        integers.withColumn("key", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        .repartition(shards, "key").mapInArrow(lambda b: _blocks(b, shard), schema))
    asked = (
        asked.withColumn("key", F.lit(0)).mapInArrow(lambda b: _blocks(b, block), schema)
        .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("key"), "dim",
                F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    met = stored.join(asked, ["key", "dim"]).select("dim", "ids", "vectors", "q_ids", "q_vectors")
    found = met.mapInArrow(lambda b: _searched(b, k, bits), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score"))
