"""Sums over all pairs of rows with a Gaussian kernel of several states, without forming the pairs.

Space is cut into cells ``WIDTH`` kernel widths wide. Inside a cell the kernel is interpolated on a
tensor grid of ``NODES`` Chebyshev points per state, so all that a cell's rows contribute is one weight
per grid point. The kernel is a product over the states; the sums over all partner cells
are therefore convolutions along one axis after the other, with the same few small
matrices everywhere. The cost is linear in the rows.

Error bound: interpolating exp(-t^2) over ``WIDTH`` with ``NODES`` points errs by less than 1e-12, and
cells more than ``REACH`` apart, which are left out, meet at exp(-36) at most; both are relative to the
sum of the products of absolute weights.

How it is spread: cells are counted first, and the rows of a cell that holds many are dealt into parts of
about ``PART`` rows, so a cell with a third of all rows is summed by many tasks. Neighbouring cells
meet in blocks of ``BLOCK`` cells along each axis, which borrow the cells within reach; a task
holds a block and its rim, however many rows they stand for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from numpy.polynomial import chebyshev
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, NODES, REACH = 2.0, 20, 3
PART, BLOCK = 1 << 17, 4
#: A cell has NODES^states weights.
MAX_STATES = 4

_POINTS = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_BASIS = chebyshev.chebvander(_POINTS, NODES - 1).T * (2.0 / NODES)
_BASIS[0] /= 2


def _interpolation(u: np.ndarray) -> np.ndarray:
    """(rows, NODES): the grid's Lagrange polynomials at u in [-1, 1]."""
    return chebyshev.chebvander(u, NODES - 1) @ _BASIS


def _weights(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Grid weights of rows at ``u`` (rows, states) with row weights ``w`` (rows, names): (names, NODES, ...)."""
    total: np.ndarray | float = 0.0
    step = max(64, (1 << 22) // NODES ** max(1, u.shape[1] - 1))
    for at in range(0, len(u), step):
        part = u[at : at + step]
        rest = np.ones((len(part), 1))
        for k in range(1, u.shape[1]):
            rest = (rest[:, :, None] * _interpolation(part[:, k])[:, None, :]).reshape(len(part), -1)
        first = _interpolation(part[:, 0])
        total = total + np.stack([(first * w[at : at + step, i, None]).T @ rest for i in range(w.shape[1])])
    return np.asarray(total).reshape(w.shape[1], *[NODES] * u.shape[1])


def _between(distance: int) -> np.ndarray:
    """Kernel between the grid points of two cells ``distance`` apart, in kernel widths."""
    place = _POINTS * (WIDTH / 2)
    return np.exp(-((distance * WIDTH + place[:, None] - place[None, :]) ** 2))


def cell_weights(rows: DataFrame, states: Sequence[str], weights: dict[str, str], bandwidth: float, by: str) -> DataFrame:
    """(g, c0, c1, ..., v): the grid weights of each group's cells, as bytes; a large cell has several rows."""
    p, names = len(states), list(weights)
    if not 1 <= p <= MAX_STATES:
        raise ValueError(f"the kernel takes 1 to {MAX_STATES} states")
    size = WIDTH / math.sqrt(bandwidth)
    axes = [f"c{k}" for k in range(p)]
    whole = " and ".join(f"x{k} is not null and not isnan(x{k})" for k in range(p))
    flat = rows.select(
        F.col(by).cast("bigint").alias("g"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(states)],
        *[F.col(c).cast("double").alias(n) for n, c in weights.items()]).filter(whole)
    # Rows in one place are one row with their summed weights.
    flat = flat.groupBy("g", *[f"x{k}" for k in range(p)]).agg(*[F.sum(n).alias(n) for n in names])
    placed = flat.select("*", *[F.floor(F.col(f"x{k}") / F.lit(size)).alias(a) for k, a in enumerate(axes)])
    many = placed.groupBy("g", *axes).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).alias("parts")).filter("parts > 1")
    dealt = placed.join(many, ["g", *axes], "left").withColumn(
        "part", F.pmod(F.xxhash64(*[f"x{k}" for k in range(p)]), F.coalesce("parts", F.lit(1)))).drop("parts")

    def summed(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[[f"x{k}" for k in range(p)]].to_numpy(float)
        u = np.clip((x / size - np.array(key[1 : 1 + p], float) - 0.5) * 2, -1, 1)
        v = _weights(u, pdf[names].to_numpy(float))
        return pd.DataFrame([(*key[: 1 + p], v.tobytes())], columns=["g", *axes, "v"])

    return dealt.groupBy("g", *axes, "part").applyInPandas(
        summed, "g bigint, " + "".join(f"{a} bigint, " for a in axes) + "v binary")


def kernel_products(rows: DataFrame, states: Sequence[str], weights: dict[str, str], bandwidth: float, by: str) -> DataFrame:
    """(g, left, right, s): sum over ordered pairs (with i = j) of w_left w_right exp(-bw |x_i - x_j|^2)."""
    p, names = len(states), list(weights)
    axes = [f"c{k}" for k in range(p)]
    cells = cell_weights(rows, states, weights, bandwidth, by)
    # The blocks that a cell belongs to or lies within reach of: at most three along an axis.
    spread = cells
    for k, a in enumerate(axes):
        low, high = (F.floor((F.col(a) + d) / F.lit(BLOCK)) for d in (-REACH, REACH))
        spread = spread.withColumn(f"b{k}", F.explode(F.sequence(low, high)))
    blocks = [f"b{k}" for k in range(p)]

    def met(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        block = key[1:]
        held: dict[tuple[int, ...], np.ndarray] = {}
        for cell, v in zip(pdf[axes].itertuples(index=False, name=None), pdf["v"]):
            held[cell] = held.get(cell, 0.0) + np.frombuffer(v).reshape(len(names), *[NODES] * p)
        own = {c: t for c, t in held.items() if all(c[k] // BLOCK == block[k] for k in range(p))}
        if not own:
            return pd.DataFrame({"g": [], "i": [], "j": [], "s": []}).astype({"g": "int64", "i": "int32", "j": "int32"})
        fields = convolved(held, own)
        out = [(key[0], i, j, sum(float((own[c][i] * fields[c][j]).sum()) for c in own))
               for i, j in product(range(len(names)), repeat=2)]
        return pd.DataFrame(out, columns=["g", "i", "j", "s"])

    got = spread.groupBy("g", *blocks).applyInPandas(met, "g bigint, i int, j int, s double")
    name = F.array(*[F.lit(n) for n in names])
    return got.groupBy("g", "i", "j").agg(F.sum("s").alias("s")).select(
        "g", F.get(name, F.col("i")).alias("left"), F.get(name, F.col("j")).alias("right"), "s")


def convolved(held: dict[tuple[int, ...], np.ndarray], own: dict[tuple[int, ...], np.ndarray]) -> dict[tuple[int, ...], np.ndarray]:
    """The kernel's field on the grids of the ``own`` cells, from all ``held`` cells: one axis after the other."""
    p = len(next(iter(own)))
    between = {d: _between(d) for d in range(-REACH, REACH + 1)}
    fields = held
    for k in range(p):
        wanted = {c[: k + 1] for c in own}
        heads: dict[tuple[int, ...], list[int]] = {}
        for head in sorted(wanted):
            heads.setdefault(head[:k], []).append(head[k])
        following: dict[tuple[int, ...], np.ndarray] = {}
        for cell, tensor in fields.items():
            for at in heads.get(cell[:k], ()):
                d = at - cell[k]
                if abs(d) <= REACH:
                    key = (*cell[:k], at, *cell[k + 1 :])
                    moved = np.moveaxis(np.tensordot(between[d], tensor, axes=(1, k + 1)), 0, k + 1)
                    following[key] = following[key] + moved if key in following else moved
        fields = following
    return fields

