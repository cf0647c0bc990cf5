"""Eigenpairs of a symmetric matrix inside an interval, by contour integration (FEAST).

The resolvent, integrated along a circle around the interval, is the projector on the
eigenvectors inside. Quadrature replaces the integral by a few solves with complex
shifts, Rayleigh-Ritz extracts the eigenpairs from the projected block, and the two are
repeated until the residuals are at rounding level. The number of eigenvalues above a
shift is known beforehand from the signs of the pivots of a symmetric factorisation
(Sylvester's law of inertia); it chooses the interval, and verifies that none was missed.
"""

from __future__ import annotations

import numpy as np

NODES = 8
_BUNCH = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``, by the inertia of ``matrix - shift`` (Bunch-Kaufman pivoting)."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        largest = column[r - 1] if r else 0.0
        two = False
        if largest > 0 and abs(a[0, 0]) < _BUNCH * largest:
            beside = np.abs(a[r]).copy()
            beside[r] = 0
            if abs(a[0, 0]) * beside.max() >= _BUNCH * largest**2:
                pass
            elif abs(a[r, r]) >= _BUNCH * beside.max():
                order = [r, *(i for i in range(len(a)) if i != r)]
                a = a[np.ix_(order, order)]
            else:
                two = True
                order = [0, r, *(i for i in range(1, len(a)) if i != r)]
                a = a[np.ix_(order, order)]
        size = 2 if two else 1
        if two:
            above += 1  # such a block has one pivot of each sign
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        else:
            above += int(a[0, 0] > 0)
            a = a[1:, 1:] - (np.outer(a[1:, 0], a[0, 1:]) / a[0, 0] if a[0, 0] else 0.0)
        if size < len(a):
            a = (a + a.T) / 2
    return above


def project(matrix: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """The block's projection on the eigenvectors between ``low`` and ``high``, by Gauss-Legendre quadrature."""
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    out = np.zeros_like(block)
    one = np.eye(len(matrix))
    for x, w in zip(points, weights):
        turn = np.exp(1j * np.pi / 2 * (1 - x))  # the upper half; the lower one is its conjugate
        out += w / 2 * (radius * turn * np.linalg.solve((middle + radius * turn) * one - matrix, block)).real
    return out


def interval_pairs(matrix: np.ndarray, low: float, high: float, nodes: int = NODES, rounds: int = 20,
                   seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues inside (low, high), falling, and their unit eigenvectors as columns.

    Their number equals the inertia count of the interval; otherwise a larger block is tried,
    up to the whole space, where the extraction alone is exact.
    """
    d = len(matrix)
    wanted = count_above(matrix, low) - count_above(matrix, high)
    if wanted == 0:
        return np.zeros(0), np.zeros((d, 0))
    size = min(d, 2 * wanted + 8)
    scale = max(abs(low), abs(high), float(np.abs(matrix).max()))
    rng = np.random.default_rng(seed)
    while True:
        block = rng.standard_normal((d, size))
        best = None
        for _ in range(rounds):
            basis = np.linalg.qr(project(matrix, block, low, high, nodes) if size < d else block)[0]
            values, turns = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turns
            inside = (values > low) & (values < high)
            vectors = block[:, inside]
            error = np.linalg.norm(matrix @ vectors - vectors * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == wanted and (best is None or error < best[0]):
                improved = best is None or error < best[0] / 2
                best = (error, values[inside][::-1], vectors[:, ::-1])
                if not improved:
                    break
            elif best is not None:
                break
        if best is not None and best[0] <= 1e-12 * scale * d**0.5:
            return best[1], best[2]
        if size == d:
            raise ArithmeticError(f"{wanted} eigenvalues lie between {low} and {high}, not all were found")
        size = min(d, 2 * size)


def top_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semidefinite matrix, falling, and their unit eigenvectors.

    Eigenvalues at rounding level count as zero and are left out, so there may be fewer.
    """
    bound = float(np.abs(matrix).sum(1).max(initial=0.0))
    if not bound:
        return np.zeros(0), np.zeros((len(matrix), 0))
    high, least = bound * (1 + 1e-9), bound * len(matrix) * np.finfo(float).eps * 4
    k = min(k, count_above(matrix, least))
    if k == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    low, top = least, high
    for _ in range(200):  # a shift with k eigenvalues above it, or as few more as ties allow
        if count_above(matrix, low) == k or top - low <= 1e-9 * high:
            break
        middle = (low + top) / 2
        low, top = (middle, top) if count_above(matrix, middle) >= k else (low, middle)
    values, vectors = interval_pairs(matrix, low, high)
    return values[:k], vectors[:, :k]
