"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of ``A - sI``, read off the blocks of its LDL' factors (Sylvester's law), is
the number of eigenvalues above ``s``.  Bisection by such counts brackets the k-th largest
eigenvalue on its own, whatever the others do, so every k can be bracketed by another task.
A bracketed eigenvalue is refined by Rayleigh quotient iteration, and two more counts beside
the result certify its number.  Eigenvalues closer than ``CLUSTER`` are refined together.
"""

from __future__ import annotations

import numpy as np

#: Bracket width, and the gap under which neighbours are refined together, as shares of the norm.
WIDTH = 1e-6
CLUSTER = 1e-5
#: Share of the norm within which the counts must confirm a refined eigenvalue.
CERTAIN = 1e-11
#: Growth bound of Bunch and Kaufman's partial pivoting.
_ALPHA = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: the positive part of the inertia of ``matrix - shift I``.

    LDL' with 1 x 1 and 2 x 2 pivots (Bunch-Kaufman); the matrix is not changed.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        most = column[r - 1] if r else 0.0
        one = abs(a[0, 0]) >= _ALPHA * most
        if not one:
            beside = np.abs(a[r])
            beside[r] = 0
            other = beside.max()
            one = abs(a[0, 0]) * other >= _ALPHA * most * most
            if not one and abs(a[r, r]) >= _ALPHA * other:
                swap = np.arange(len(a))
                swap[[0, r]] = r, 0
                a, one = a[np.ix_(swap, swap)], True
        if one:
            pivot = a[0, 0]
            positive += pivot > 0
            below = a[1:, 0]
            a = a[1:, 1:] - (np.outer(below, below / pivot) if pivot else 0)
            continue
        swap = np.arange(len(a))
        swap[[1, r]] = r, 1
        a = a[np.ix_(swap, swap)]
        block, below = a[:2, :2], a[2:, :2]
        # A 2 x 2 pivot that partial pivoting chooses has one eigenvalue of each sign.
        positive += 1
        a = a[2:, 2:] - below @ np.linalg.solve(block, below.T)
        a = (a + a.T) / 2
    return int(positive)


def bracket(matrix: np.ndarray, k: int) -> tuple[float, float]:
    """(lo, hi] that holds the k-th largest eigenvalue (from 1), no wider than ``WIDTH`` of the norm."""
    radius = float(np.abs(matrix).sum(axis=1).max())
    lo, hi = -radius * (1 + 1e-9) - 1e-300, radius * (1 + 1e-9)
    while hi - lo > WIDTH * radius:
        middle = (lo + hi) / 2
        if count_above(matrix, middle) >= k:
            lo = middle
        else:
            hi = middle
    return lo, hi


def _inverse_step(matrix: np.ndarray, shift: float, basis: np.ndarray, norm: float) -> np.ndarray:
    """The basis after one inverse iteration; a singular shift is moved by a rounding."""
    identity = np.eye(len(matrix))
    for nudge in (0.0, 4e-16, 1e-15):
        try:
            out = np.linalg.solve(matrix - (shift + nudge * norm) * identity, basis)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out / np.abs(out).max()
    raise ArithmeticError("no shift near the eigenvalue gives a solvable system")


def _ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh quotients of the best orthonormal vectors in the span of ``basis``, falling, and these vectors."""
    small = basis.T @ matrix @ basis
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], basis @ turn[:, ::-1]


def refine(matrix: np.ndarray, first: int, brackets: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the components ``first ...`` in the brackets.

    Inverse iteration in the middle of the brackets until every Rayleigh quotient lies in
    them, then Rayleigh quotient iteration; vectors of one cluster stay orthogonal.  The
    largest entry of every vector is positive.
    """
    norm = float(np.abs(matrix).sum(axis=1).max())
    lo, hi = min(b[0] for b in brackets) - WIDTH * norm, max(b[1] for b in brackets) + WIDTH * norm
    rng = np.random.default_rng(first)
    basis = np.linalg.qr(rng.standard_normal((len(matrix), len(brackets))))[0]
    for step in range(1000):
        basis = np.linalg.qr(_inverse_step(matrix, (lo + hi) / 2, basis, norm))[0]
        values, basis = _ritz(matrix, basis)
        if step >= 2 and lo <= values[-1] and values[0] <= hi:
            break
    residual = np.inf
    for _ in range(20):
        before, residual = residual, float(np.abs(matrix @ basis - basis * values).max())
        if residual >= before / 2 and residual <= 1e-14 * norm:
            break
        columns = [_inverse_step(matrix, v, basis[:, [j]], norm) for j, v in enumerate(values.tolist())]
        values, basis = _ritz(matrix, np.linalg.qr(np.hstack(columns))[0])
    certify(matrix, first, values, norm)
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return values, basis * signs


def certify(matrix: np.ndarray, first: int, values: np.ndarray, norm: float) -> None:
    """Raises unless counts beside every value confirm that it is number ``first``, ``first + 1``, ..."""
    for k, value in enumerate(values.tolist(), first):
        if not count_above(matrix, value + CERTAIN * norm) < k <= count_above(matrix, value - CERTAIN * norm):
            raise ArithmeticError(f"the counts do not confirm component {k}")


def clusters(brackets: list[tuple[float, float]], norm: float) -> list[list[int]]:
    """Positions of brackets, falling, split where neighbours are further apart than ``CLUSTER``."""
    out: list[list[int]] = []
    for i, (_, hi) in enumerate(brackets):
        if out and brackets[i - 1][0] - hi <= CLUSTER * norm:
            out[-1].append(i)
        else:
            out.append([i])
    return out
