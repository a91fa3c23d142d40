"""Vector kernels over blocks: one matrix product scores many vectors against many queries, in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column as a matrix, and which of them have that width and no null; others are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
    fits = (sizes == width) & column.is_valid().to_numpy(zero_copy_only=False)
    if fits.all() and not column.values.null_count and len(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, width).astype(np.float64), fits
    out = np.zeros((len(column), width))
    for i in np.flatnonzero(fits):
        row = column[int(i)].as_py()
        if any(v is None for v in row):
            fits[i] = False
        else:
            out[i] = row
    return out, fits


def dot_block(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return x @ q.T


def cosine_block(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Both sides are brought to length one once, not once a pair; zero vectors score 0."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return unit(x) @ unit(q).T


def l2_block(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances. Differences are taken outright, a query at a time: products would cancel for near vectors."""
    out = np.empty((len(x), len(q)))
    for j, row in enumerate(q):
        d = x - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def score_block(x: np.ndarray, fits: np.ndarray, q: np.ndarray, distance: str) -> np.ndarray:
    """Scores, larger is nearer; rows that don't fit have no similarity (0, or minus infinity for distances)."""
    if distance == "Euclidean":
        out = 0.0 - l2_block(x, q)
    else:
        out = dot_block(x, q) if distance == "Dot" else cosine_block(x, q)
    out[~fits] = -np.inf if distance == "Euclidean" else 0.0
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each column's entries from its k-th largest on: ties at the end all stay."""
    if len(scores) <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    return np.nonzero(scores >= least)


#: Pairs that are scored at a time.
PAIR_BLOCK = 65_536


def score_pairs(x: np.ndarray, fits: np.ndarray, q: np.ndarray, row: np.ndarray, column: np.ndarray, distance: str) -> np.ndarray:
    """The scores of single pairs (a row of x, a row of q). Equal vectors score alike wherever they stand, while those of
    a matrix product may differ in the last bit."""
    if distance not in ("Euclidean", "Dot"):
        x, q = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, q))
    out = np.empty(len(row))
    for i in range(0, len(row), PAIR_BLOCK):
        a, b = x[row[i : i + PAIR_BLOCK]], q[column[i : i + PAIR_BLOCK]]
        if distance == "Euclidean":
            a, b = a - b, a - b
        out[i : i + PAIR_BLOCK] = np.einsum("ij,ij->i", a, b)
    if distance == "Euclidean":
        out = np.where(fits[row], 0.0 - np.sqrt(out), -np.inf)
    return out


def at_least(scores: np.ndarray, k: int, floor: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries from each column's floor on, and from its k-th largest on, less some slack."""
    kept = scores >= floor - slack
    full = np.flatnonzero(kept.sum(axis=0) > k)
    if len(full):
        least = np.partition(scores[:, full], len(scores) - k, axis=0)[len(scores) - k]
        kept[:, full] &= scores[:, full] >= least - slack[full]
    return np.nonzero(kept)
