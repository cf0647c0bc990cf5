"""Sums of products: everything a transition regression needs, as one aggregate.

Rows are regressed on ``[1, A, S, A*S]`` with a binary action, so it is enough
to keep the products of ``[1, S, Y]`` over all rows (``m_*``) and over the rows
with action 1 (``k_*``). They are plain sums: mergeable over partitions, time
and subjects, and prefix differences give any time segment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Moments:
    """Names, expressions and matrix form of the sums for p state variables."""

    def __init__(self, p: int):
        self.p = p
        self.terms = ["n"]
        self.terms += [f"s{i}" for i in range(p)]
        self.terms += [f"y{i}" for i in range(p)]
        self.terms += [f"s{i}s{j}" for i in range(p) for j in range(i, p)]
        self.terms += [f"s{i}y{j}" for i in range(p) for j in range(p)]
        self.terms += [f"y{i}y{i}" for i in range(p)]
        self.index = {name: i for i, name in enumerate(self.terms)}
        self.half = len(self.terms)

    @property
    def names(self) -> list[str]:
        return [f"m_{t}" for t in self.terms] + [f"k_{t}" for t in self.terms]

    def _product(self, term: str, states, nexts) -> str:
        if term == "n":
            return "1.0D"
        names = [(states if kind == "s" else nexts)[i] for kind, i in _split(term)]
        return " * ".join(f"cast(`{c}` as double)" for c in names)

    def sums(self, states: Sequence[str], nexts: Sequence[str], action: str = "a") -> list[F.Column]:
        each = {t: self._product(t, states, nexts) for t in self.terms}
        out = [F.expr(f"sum({x})").alias(f"m_{t}") for t, x in each.items()]
        out += [F.expr(f"sum(case when `{action}` = 1 then {x} else 0.0D end)").alias(f"k_{t}") for t, x in each.items()]
        return out

    def products(self, s: np.ndarray, y: np.ndarray, a: np.ndarray) -> np.ndarray:
        """What each row of arrays adds to the sums: states (rows, p), next states (rows, p), actions."""
        held = {"s": s, "y": y}
        each = np.ones((len(s), self.half))
        for i, t in enumerate(self.terms[1:], 1):
            each[:, i] = np.prod([held[kind][:, j] for kind, j in _split(t)], axis=0)
        return np.hstack([each, np.where((a == 1)[:, None], each, 0.0)])

    # Matrix form, batched over leading axes.
    def design(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(XX, XY, YY) of the ``[1, A, S, A*S]`` design from moment vectors."""
        p, d = self.p, 2 + 2 * self.p
        every, one = m[..., : self.half], m[..., self.half:]
        base = [0] + [2 + i for i in range(p)]
        acted = [1] + [2 + p + i for i in range(p)]
        xx = np.zeros(m.shape[:-1] + (d, d))
        xy = np.zeros(m.shape[:-1] + (d, p))
        yy = np.zeros(m.shape[:-1] + (p,))

        def put(i, j, name):
            for rows, cols, src in ((base, base, every), (base, acted, one), (acted, base, one), (acted, acted, one)):
                v = src[..., self.index[name]]
                xx[..., rows[i], cols[j]] = v
                xx[..., cols[j], rows[i]] = v

        put(0, 0, "n")
        for i in range(p):
            put(0, i + 1, f"s{i}")
            put(i + 1, 0, f"s{i}")
            for j in range(i, p):
                put(i + 1, j + 1, f"s{i}s{j}")
                put(j + 1, i + 1, f"s{i}s{j}")
        for j in range(p):
            for rows, src in ((base, every), (acted, one)):
                xy[..., rows[0], j] = src[..., self.index[f"y{j}"]]
                for i in range(p):
                    xy[..., rows[i + 1], j] = src[..., self.index[f"s{i}y{j}"]]
            yy[..., j] = every[..., self.index[f"y{j}y{j}"]]
        return xx, xy, yy

    def sse_weights(self, coef: np.ndarray) -> np.ndarray:
        """Vector w with SSE = w . moments for given coefficients (d, p).

        SSE is linear in the moments, so scoring a subject is a dot product.
        """
        q = len(self.names)
        xx, xy, yy = self.design(np.eye(q))
        return yy.sum(-1) - 2.0 * np.einsum("qij,ij->q", xy, coef) + np.einsum("qil,ij,lj->q", xx, coef, coef)


def _split(term: str):
    i = 0
    while i < len(term):
        j = i + 1
        while j < len(term) and term[j].isdigit():
            j += 1
        yield term[i], int(term[i + 1: j])
        i = j


def moments_by(trans: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """One row of sums per key. Map-side partial sums, then one small shuffle."""
    states = [f"s{i + 1}" for i in range(p)]
    nexts = [f"y{i + 1}" for i in range(p)]
    return trans.groupBy(*keys).agg(*Moments(p).sums(states, nexts))


# --- small dense algebra on Grams (numpy, used inside tasks and on K-row tables)

RANK_TOL = 1e-11
PIVOT_TOL = 1e-9


def gram_solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares coefficients and rank for batched Grams.

    Solved on the unit-diagonal scale; where that Gram is singular the
    minimum-norm solution on the original scale is returned instead.
    """
    diag = np.sqrt(np.maximum(np.einsum("...ii->...i", xx), 0.0))
    scale = np.where(diag > 0, diag, 1.0)
    xs = xx / (scale[..., :, None] * scale[..., None, :])
    val, vec = np.linalg.eigh(xs)
    keep = val > RANK_TOL * np.maximum(val[..., -1:], 1e-300)
    inv = np.where(keep, 1.0 / np.where(keep, val, 1.0), 0.0)
    half = np.einsum("...ji,...jk->...ik", vec, xy / scale[..., :, None])
    coef = np.einsum("...ij,...jk->...ik", vec, inv[..., :, None] * half) / scale[..., :, None]
    return coef, keep.sum(-1)


def min_norm_solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """As :func:`gram_solve`, minimum-norm on the original scale where singular."""
    coef, rank = gram_solve(xx, xy)
    d = xx.shape[-1]
    if np.all(rank == d):
        return coef
    alt = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy
    return np.where((rank < d)[..., None, None], alt, coef)


def batch_sse(layout: Moments, m: np.ndarray) -> np.ndarray:
    """Residual sum of squares over all responses for a batch of moment vectors.

    The design is saturated in the action, so it is the sum of one regression
    on [1, S] per action. Each is eliminated column by column over the whole
    batch; a column without spread left is skipped, which leaves the residual
    of a singular segment right.
    """
    one = m[..., layout.half:]
    return _sse_one_action(layout, one) + _sse_one_action(layout, m[..., : layout.half] - one)


def _sse_one_action(layout: Moments, v: np.ndarray) -> np.ndarray:
    p, idx = layout.p, layout.index
    x: dict[tuple[int, int], np.ndarray] = {(0, 0): v[..., idx["n"]]}
    y = [v[..., idx[f"y{j}y{j}"]] for j in range(p)]
    xy = {(0, j): v[..., idx[f"y{j}"]] for j in range(p)}
    for i in range(p):
        x[0, i + 1] = v[..., idx[f"s{i}"]]
        for j in range(i, p):
            x[i + 1, j + 1] = v[..., idx[f"s{i}s{j}"]]
        for j in range(p):
            xy[i + 1, j] = v[..., idx[f"s{i}y{j}"]]
    start = [x[i, i] for i in range(p + 1)]
    for i in range(p + 1):
        alive = x[i, i] > PIVOT_TOL * start[i]
        inv = np.where(alive, 1.0 / np.where(alive, x[i, i], 1.0), 0.0)
        for j in range(p):
            y[j] = y[j] - xy[i, j] * xy[i, j] * inv
        for k in range(i + 1, p + 1):
            f = x[i, k] * inv
            for j in range(k, p + 1):
                x[k, j] = x[k, j] - f * x[i, j]
            for j in range(p):
                xy[k, j] = xy[k, j] - f * xy[i, j]
    return sum(np.maximum(r, 0.0) for r in y)


def fit_rows(sums: DataFrame, key: str, p: int) -> DataFrame:
    """(key, n, coef, sse) from rows of sums.

    ``coef`` is the (2+2p) x p matrix, one response after the other, in the
    order 1, A, S1..Sp, A*S1..A*Sp.
    """
    layout = Moments(p)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = pdf[layout.names].to_numpy(float)
            xx, xy, yy = layout.design(m)
            coef = min_norm_solve(xx, xy)
            fitted = np.einsum("...ij,...ij->...", xy, coef)
            yield pd.DataFrame({
                key: pdf[key], "n": m[:, 0], "coef": list(coef.transpose(0, 2, 1).reshape(len(m), -1)),
                "sse": np.maximum(yy.sum(-1) - fitted, 0.0)})

    kind = sums.schema[key].dataType.simpleString()
    return sums.mapInPandas(solve, f"{key} {kind}, n double, coef array<double>, sse double")


def fit_by(trans: DataFrame, key: str, p: int) -> DataFrame:
    """Least squares of the next state on [1, A, S, A*S] per key."""
    return fit_rows(moments_by(trans, [key], p), key, p)


# --- p = 1 closed forms as columns

def line_sse(n, s, y, ss, sy, yy) -> F.Column:
    """SSE of y on [1, s] from six sums; intercept only when s has no spread."""
    sxx = n * ss - s * s
    syy = n * yy - y * y
    sxy = n * sy - s * y
    flat = sxx <= F.lit(1e-9) * n * ss
    return (
        F.when(n <= 0, F.lit(0.0))
        .when(flat, syy / n)
        .otherwise(F.greatest((syy - sxy * sxy / sxx) / n, F.lit(0.0)))
    )


def action_sse(m: dict[str, F.Column]) -> F.Column:
    """SSE of the saturated design for p = 1: one line per action."""
    order = ("n", "s0", "y0", "s0s0", "s0y0", "y0y0")
    one = line_sse(*[m[f"k_{t}"] for t in order])
    zero = line_sse(*[m[f"m_{t}"] - m[f"k_{t}"] for t in order])
    return one + zero
