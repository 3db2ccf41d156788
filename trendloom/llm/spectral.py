"""Eigenvectors of a symmetric matrix by spectral divide and conquer on polar factors (QDWH)."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray, *, steps: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which is its matrix sign.

    Dynamically weighted Halley steps: by a QR factorisation while the weights
    are large, by a Cholesky factorisation after that.  The bound of the least
    singular value starts at the rounding level, so no estimate can be too high.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    least = EPS / n
    identity = np.eye(n)
    for _ in range(steps):
        square = least * least
        d = np.cbrt(4 * (1 - square) / (square * square)) if square < 1 else 0.0
        root = np.sqrt(1 + d)
        a_k = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        b_k = (a_k - 1) ** 2 / 4
        c_k = a_k + b_k - 1
        if c_k > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c_k) * x, identity]))
            new = (b_k / c_k) * x + (a_k - b_k / c_k) / np.sqrt(c_k) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(identity + c_k * (x.T @ x))
            half = np.linalg.solve(lower, x.T)
            new = (b_k / c_k) * x + (a_k - b_k / c_k) * np.linalg.solve(lower.T, half).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        least = min(least * (a_k + b_k * square) / (1 + c_k * square), 1.0)
        if abs(1 - least) < 10 * EPS and moved < np.cbrt(EPS) * np.sqrt(n) * 1e-3:
            break
    return x


def _split(a: np.ndarray, shift: float, draw: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """(orthogonal basis, k): its first k columns span the eigenvectors above the shift; None if the shift does not part them cleanly."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if not moved.any():
        return None
    sign = polar_factor(moved)
    if not np.isfinite(sign).all() or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-8 * n:
        return None
    above = (sign + np.eye(n)) / 2
    k = int(round(float(np.trace(above))))
    if k in (0, n):
        return None
    below = np.eye(n) - above
    basis, _ = np.linalg.qr(np.hstack([above @ draw.standard_normal((n, k)), below @ draw.standard_normal((n, n - k))]))
    for _ in range(2):  # one more application of the projectors removes what rounding left in the other space
        basis, _ = np.linalg.qr(np.hstack([above @ basis[:, :k], below @ basis[:, k:]]))
    return basis, k


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix.

    The polar factor of the matrix less a shift gives the projector on the
    eigenvectors above it; both invariant subspaces are split again until a block has one column or is
    a multiple of the identity up to rounding.  The sign of a vector makes its entry of largest size positive.
    """
    n = len(a)
    if n == 0:
        return np.zeros(0), np.zeros((0, 0))
    a = (a + a.T) / 2
    floor = 4 * EPS * np.linalg.norm(a)
    draw = np.random.default_rng(0)
    values, vectors = np.zeros(n), np.zeros((n, n))
    open_blocks = [(0, np.eye(n))]
    while open_blocks:
        at, basis = open_blocks.pop()
        m = basis.shape[1]
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        diagonal = np.diag(block)
        if m == 1 or np.linalg.norm(block - np.diag(np.full(m, diagonal.mean()))) <= floor:
            values[at : at + m], vectors[:, at : at + m] = diagonal, basis
            continue
        spread = np.linalg.norm(block - np.diag(np.full(m, diagonal.mean()))) / m
        found = None
        # The mean lies strictly between the least and the largest eigenvalue; where one eigenvalue hits the shift, steps beside it do.
        for shift in (float(np.median(diagonal)), *(float(diagonal.mean()) + spread * f for f in (0.0, 0.013, -0.017, 0.11, -0.13, 0.3, -0.3))):
            found = _split(block, shift, draw)
            if found is not None:
                break
        if found is None:  # eigenvalues that differ by rounding only
            values[at : at + m], vectors[:, at : at + m] = diagonal, basis
            continue
        turned, k = found
        open_blocks.append((at + k, basis @ turned[:, k:]))
        open_blocks.append((at, basis @ turned[:, :k]))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values, vectors * signs
