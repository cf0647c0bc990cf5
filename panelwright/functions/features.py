"""Feature maps as columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import functions as F


def interaction_terms(a: F.Column, states: Sequence[F.Column]) -> list[F.Column]:
    """[1, A, S1..Sp, A*S1..A*Sp]: state products are left out."""
    return [F.lit(1.0), a.cast("double"), *states, *[a * s for s in states]]


def interaction_row(a: F.Column, states: Sequence[F.Column]) -> F.Column:
    return F.array(*[c.cast("double") for c in interaction_terms(a, states)])


def monomials(p: int, degree: int) -> list[tuple[int, ...]]:
    """Index tuples of all monomials up to ``degree``, the constant first."""
    return [c for d in range(degree + 1) for c in combinations_with_replacement(range(p), d)]


def polynomial_terms(states: Sequence[F.Column], degree: int) -> list[F.Column]:
    out = []
    for combo in monomials(len(states), degree):
        term = F.lit(1.0)
        for i in combo:
            term = term * states[i] if combo else term
        out.append(term)
    return out


def fourier_weights(dim: int, p: int, bandwidth: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Seeded frequencies (p, dim) and phases (dim) of the RBF feature map."""
    rng = np.random.RandomState(seed)
    w = np.sqrt(2.0 * bandwidth) * rng.normal(size=(p, dim))
    return w, rng.uniform(0.0, 2.0 * np.pi, size=dim)


def fourier_terms(states: Sequence[F.Column], w: np.ndarray, b: np.ndarray) -> list[F.Column]:
    """[1, sqrt(2/D) cos(s.w_d + b_d)]: random Fourier features with a bias."""
    dim = len(b)
    out = [F.lit(1.0)]
    for d in range(dim):
        z = F.lit(float(b[d]))
        for i, s in enumerate(states):
            z = z + s * F.lit(float(w[i, d]))
        out.append(F.lit(float(np.sqrt(2.0 / dim))) * F.cos(z))
    return out


class FeatureMap:
    """A named state feature map: ``polynomial`` (degree) or ``rbf`` (dim, bandwidth).

    ``rbf`` with dim 0 is the linear map. ``custom`` takes a function from
    state columns to a list of columns.
    """

    def __init__(self, kind: str = "polynomial", degree: int = 1, dim: int = 5,
                 bandwidth: float = 1.0, seed: int = 1, custom=None):
        if kind == "rbf" and dim == 0:
            kind, degree = "polynomial", 1
        self.kind, self.degree, self.dim = kind, degree, dim
        self.bandwidth, self.seed, self.custom = bandwidth, seed, custom

    def terms(self, states: Sequence[F.Column]) -> list[F.Column]:
        if self.custom is not None:
            return self.custom(states)
        if self.kind == "polynomial":
            return polynomial_terms(states, self.degree)
        if self.kind == "rbf":
            w, b = fourier_weights(self.dim, len(states), self.bandwidth, self.seed)
            return fourier_terms(states, w, b)
        raise ValueError(f"unknown feature map {self.kind}")

    def size(self, p: int) -> int:
        return len(self.terms([F.lit(0.0)] * p))
