"""Whitening of embeddings by the leading components of their covariance.

Vectors become whole numbers, x = floor(scale * c). The components are fitted on the fit
list, each distinct x once: its sums S are exact integers, and its covariance is summed
from rows centred by S/n before they are multiplied. ``contour`` finds the leading
components of that matrix, counted by inertia. Every row of the table is then projected.

How it is spread: one shuffle makes the fit list, of vectors packed in the fewest bytes that
hold them; equal vectors are merged before it, so copies cost nothing. Sums are formed
per task; a covariance travels as one row per pair of dimensions and task at most, summed by
a shuffle. The driver holds dim x dim numbers and S. Projecting is one pass without a shuffle.

Defined results: vectors that are null or empty, hold null or non-finite components or
components whose x leaves the range of a long take no part, nor do vectors of another length
than the most frequent one (of several, the longest). Repeated rows are returned each and
fitted once. Null ids are kept. Components of zero variance are left out: a table of one distinct
vector has no rows. A deviation beyond a long is null. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import contour
from panelwright.session import materialize

SCALE = 256.0
#: Rows that are centred and multiplied at once.
ROWS = 4096
_KINDS = [np.dtype(k) for k in ("<i1", "<i2", "<i4", "<i8")]
_LARGEST = 2**63 - 1


def usable(vector: Column, scale: float = SCALE) -> Column:
    """Whether all components are there, finite, and small enough for a long once scaled."""
    bound = F.lit(float(2**62) / scale)
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def whole(vectors: pa.Array, scale: float) -> np.ndarray:
    """(rows, dim) of floor(scale * c) of a list column without nulls."""
    values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return values.reshape(len(vectors), -1)


def pack(row: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it; equal vectors are packed alike."""
    low, high = row.min(), row.max()
    kind = next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([kind.itemsize]) + row.astype(kind).tobytes()


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim), np.int64)
    for i, p in enumerate(packed):
        out[i] = np.frombuffer(p, _KINDS[p[0].bit_length() - 1], dim, 1)
    return out


def _packed(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            rows = whole(batch.column("vector"), scale)
            yield pa.RecordBatch.from_arrays([pa.array([pack(r) for r in rows], pa.binary())], names=["packed"])


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """Vectors of the fit list, at most ``ROWS`` at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield unpack(batch.column("packed").slice(at, ROWS).to_pylist(), dim)


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(place, high, low): a task's sums, as high * 2^32 + low, so that neither part overflows."""
    total, n = [0] * dim, 0
    for rows in _parts(batches, dim):
        high, low = (rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0)
        total = [t + (int(a) << 32) + int(b) for t, a, b in zip(total, high, low)]
        n += len(rows)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array([t >> 32 for t in total] + [0]),
             pa.array([t & 0xFFFFFFFF for t in total] + [n])], names=["place", "high", "low"])


@dataclass
class Centre:
    """Number and exact sums of the fit list."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.floor = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """x - S/n in doubles; the whole part of S/n is taken off exactly."""
        return (rows - self.floor).astype(np.float64) - self.rest / self.n

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; null beyond a long."""
        near = rows - self.floor
        largest = max((int(abs(near).max(initial=0)) + 1) * self.n, 1)
        if largest * largest * rows.shape[1] <= _LARGEST:
            return (((self.n * near - self.rest) ** 2).sum(1)).tolist()
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in near]
        return [v if v <= _LARGEST else None for v in exact]


def _products(batches: Iterator[pa.RecordBatch], centre: Centre, transform: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(i, j, product): a task's sums of products of centred, and maybe projected, vectors, i <= j."""
    total = None
    for rows in _parts(batches, len(centre.floor)):
        z = centre.centred(rows)
        z = z if transform is None else z @ transform
        total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        i, j = np.triu_indices(len(total))
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["i", "j", "product"])


def covariance(fit: DataFrame, centre: Centre, transform: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the fit list, or of its projections, divisor n."""
    summed = (
        fit.mapInArrow(lambda b: _products(b, centre, transform), "i int, j int, product double")
        .groupBy("i", "j").agg(F.sum("product").alias("product")).toArrow())
    i, j, v = (summed[c].to_numpy() for c in ("i", "j", "product"))
    size = len(centre.floor) if transform is None else transform.shape[1]
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = v / centre.n
    return out


def _projected(batches: Iterator[pa.RecordBatch], scale: float, centre: Centre, transform: np.ndarray,
               explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    k = transform.shape[1]
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            rows = whole(part.column("vector"), scale)
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)),
                 pa.array([x for x in centre.deviation(rows) for _ in range(k)], pa.int64()),
                 pa.array((centre.centred(rows) @ transform).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(rows: DataFrame, k: int = 4, id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each row along the ``k`` leading components.

    ``identity_error`` is the largest absolute entry of the covariance of ``whitened`` over the fit list,
    less the identity: one value, measured by a pass of its own.
    """
    columns = [F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")]
    used = rows.select(*columns).filter(usable(F.col("vector"), scale))
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [id, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    lengths = used.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    longest = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    if longest is None:
        return rows.sparkSession.createDataFrame([], schema).toDF(*names)
    dim = longest["dim"]
    used = used.filter(F.size("vector") == dim)
    fit = materialize(used.select("vector").mapInArrow(lambda b: _packed(b, scale), "packed binary").distinct(), "fit")
    sums = (fit.mapInArrow(lambda b: _sums(b, dim), "place int, high long, low long")
            .groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    by_place = {r["place"]: (r["high"] << 32) + r["low"] for r in sums}
    centre = Centre(by_place[dim], [by_place[i] for i in range(dim)])
    v = covariance(fit, centre)
    values, vectors = contour.top_pairs(v, k)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema).toDF(*names)
    transform = vectors / np.sqrt(values)
    error = float(np.abs(covariance(fit, centre, transform) - np.eye(len(values))).max())
    explained = values / np.trace(v)
    return used.mapInArrow(lambda b: _projected(b, scale, centre, transform, explained, error), schema).toDF(*names)
