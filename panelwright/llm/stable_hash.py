"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length 1, so a cosine of at least c is a Euclidean distance
of at most sqrt(2 - 2c). A hash is floor((a.v + b) / width) with a Gaussian a;
``PER_TABLE`` of them make a bucket, and there are ``TABLES`` tables. Vectors
that share a bucket (and label) are compared exactly, in double precision.

At cosine 0.98 a pair shares a bucket of one table with probability 0.26, so the
chance to miss it in all 24 is 0.0007; closer pairs are missed less. Equal vectors
are one class before hashing, so a vector that a third of all rows repeat is hashed
once. A bucket of more than ``BLOCK`` classes is cut into blocks, and each pair
of blocks is a group of its own: no task holds a bucket, and no pair leaves a
task, only each vector's number of links and one link to its component. A pair that
shares several buckets counts in the first table only, which each task sees from the
vectors' buckets in all tables.

Defined results: a row whose vector is null, empty, zero or holds null or
non-finite components, or whose label is null, has no link and is its own
component. Vectors of different length don't link. Rows with equal ids are rows of
their own; the component is the smallest id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.components import components
from panelwright.llm.text import U64, mix
from panelwright.session import materialize

COSINE = 0.98
TABLES = 24
PER_TABLE = 16
WIDTH = 2.0
BLOCK = 1024


def usable(vector: Column) -> Column:
    """A vector of finite components that aren't all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; large components don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class StableHash:
    """Bucket numbers of unit vectors, from a fixed seed for each number of components."""

    def __init__(self, tables: int, per_table: int, width: float, seed: int = 11):
        self.tables, self.per_table, self.width, self.seed = tables, per_table, width, seed
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) of 64-bit bucket numbers."""
        dim = x.shape[1]
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            n = self.tables * self.per_table
            self.drawn[dim] = (rng.standard_normal((dim, n)), rng.uniform(0, self.width, n),
                               rng.integers(1, 1 << 63, n, dtype=U64) | U64(1))
        a, b, odd = self.drawn[dim]
        cell = np.floor((x @ a + b) / self.width).astype(np.int64).view(U64)
        with np.errstate(over="ignore"):
            summed = (cell * odd).reshape(len(x), self.tables, self.per_table).sum(2, dtype=U64)
        return mix(summed).view(np.int64)


def _by_length(vectors: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy()
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _hashed(batches: Iterator[pa.RecordBatch], hasher: StableHash) -> Iterator[pa.RecordBatch]:
    """(id, buckets) for each class."""
    for batch in batches:
        ids, vectors = batch.column("id"), batch.column("vector")
        for rows in _by_length(vectors):
            found = hasher.buckets(unit(matrix(vectors.take(pa.array(rows)))))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * hasher.tables
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))],
                names=["id", "buckets"])


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row number that each row is connected to."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _group_links(part: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, smallest id of the component) of a group's rows that have links."""
    table = part["place"][0].as_py()
    ids = part["id"].to_numpy()
    block = part["block"].to_numpy()
    labels = part["label"].to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = part["vector"].combine_chunks()
    lengths = vectors.value_lengths().to_numpy()
    none = np.zeros(0, np.int64)
    if (lengths != lengths[0]).any() or (labels != labels[0]).any():
        # Different vectors in one bucket by chance: the groups of equal ones apart.
        kind = np.unique(np.stack([lengths, labels.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
        parts = [_group_links(part.take(pa.array(np.flatnonzero(kind == k))), cosine) for k in np.unique(kind)]
        return tuple(np.concatenate(x) if x else none for x in zip(*parts))
    x = unit(matrix(vectors))[order]
    keys = matrix_of_keys(part["buckets"].combine_chunks())[order]
    ids, block, n = ids[order], block[order], part["n"].to_numpy()[order]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    low, high = part["low"][0].as_py(), part["high"][0].as_py()
    if low != high:
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(near)
    if table and len(i):
        # Met before, in an earlier table.
        for at in range(0, len(i), 1 << 18):
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            seen = np.zeros(len(a), bool)
            for t in range(table):
                seen |= keys[a, t] == keys[b, t]
            near[a[seen], b[seen]] = False
    has = near.any(1)
    return ids[has], (near @ n)[has], ids[_roots(near)][has]


def matrix_of_keys(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _verified(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Link counts and component links of groups that come one after the other."""
    kept: pa.Table | None = None

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([rows[c].to_numpy() for c in ("bucket", "low", "high", "place")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        found = [_group_links(rows.slice(a, b - a), cosine)
                 for a, b in zip(np.append(0, cuts), np.append(cuts, len(rows))) if b - a > 1]
        if found:
            ids, links, roots = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(links.astype(np.int64)), pa.array(roots)], names=["id", "links", "root"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if kept is not None:
            rows = pa.concat_tables([kept, rows])
        key = np.stack([rows[c].to_numpy() for c in ("bucket", "low", "high", "place")])
        open_from = len(rows) - 1
        same = (key == key[:, -1:]).all(0)
        if not same.all():
            open_from = int(np.flatnonzero(~same)[-1]) + 1
            yield from done(rows.slice(0, open_from))
            rows = rows.slice(open_from)
        kept = rows.combine_chunks()
    if kept is not None and len(kept):
        yield from done(kept)


def class_links(classes: DataFrame, cosine: float = COSINE, tables: int = TABLES, per_table: int = PER_TABLE,
                width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(id, links, root) rows to be added up per id: links of class representatives found in the tables.

    ``classes`` has id, label (long), vector and n, the rows of the class.
    """
    hasher = StableHash(tables, per_table, width)
    hashed = materialize(
        classes.select("id", "vector").mapInArrow(lambda b: _hashed(b, hasher), "id long, buckets array<long>"),
        "buckets")
    entries = hashed.join(classes.select("id", "label"), "id").select(
        "id", "label", F.posexplode("buckets").alias("place", "bucket"))
    entries = entries.select("id", "place", F.xxhash64("bucket", "label", "place").alias("bucket"))
    shared = entries.groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = (
        entries.join(shared, ["bucket", "place"])
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "bucket", "place", "block",
                F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    group = ["bucket", "low", "high", "place"]
    full = placed.join(classes, "id").join(hashed, "id")
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (
        full.repartition(n, *group).sortWithinPartitions(*group)
        .mapInArrow(lambda b: _verified(b, cosine), "id long, links long, root long"))


def near_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE, **tables) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = rows.select(
        F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("label", F.when(usable(F.col("vector")), F.col("label")))
    classes = materialize(
        rows.filter("label is not null and vec_id is not null").groupBy("label", "vector")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("id", F.xxhash64("label", "vector", "first")),
        "vector-classes")
    found = materialize(class_links(classes.select("id", "label", "vector", "n"), cosine, **tables), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    member = classes.join(counts, "id", "left").join(group, "id", "left").select(
        "label", "vector", "first", "n", "links", F.coalesce("component", "id").alias("component"))
    low = member.groupBy("component").agg(F.min("first").alias("component_id"))
    member = member.join(low, "component").select("label", "vector", "n", "links", "component_id")
    joined = rows.join(member, ["label", "vector"], "left")
    own = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(
            F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
