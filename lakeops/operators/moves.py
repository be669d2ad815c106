"""Local moves of vertices to other communities, for blocks of edges in numpy arrays.

Vertices and communities are numbers in the order of their ids.  A block has whole neighbour lists:
vertices ``rows``, the ``sizes`` of their lists, and the lists' ends ``to`` and weights one after the other.  NaN
stands for a null weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Edges that are sorted at a time.
EDGES = 1 << 16
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def _hash(values: np.ndarray, seed: np.ndarray, wide: bool) -> np.ndarray:
    """Spark's xxhash64 of a long column (``wide``) or an int column."""
    if wide:
        x = (seed + P5 + np.uint64(8)) ^ (_turned(values.astype(np.int64).view(np.uint64) * P2, 31) * P1)
        return _mixed(_turned(x, 27) * P1 + P4)
    x = (seed + P5 + np.uint64(4)) ^ (values.astype(np.int32).view(np.uint32).astype(np.uint64) * P1)
    return _mixed(_turned(x, 23) * P2 + P3)


def halves(ids: np.ndarray, wide: bool, turn: int) -> np.ndarray:
    """``pmod(xxhash64(id, turn), 2)`` of Spark, where turn is an int."""
    first = _hash(ids, np.full(len(ids), 42, np.uint64), wide)
    return (_hash(np.full(len(ids), turn), first, False) & np.uint64(1)).astype(np.int8)


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Spark's ``round`` of doubles: half up on the shortest decimal text."""
    scaled = x * 10.0**digits
    near = np.rint(scaled)
    out = np.where(np.abs(x) < 2.0**23, near / 10.0**digits, x)  # beyond, doubles are farther apart than the last digit
    # Where the product's own rounding could decide, the text does.
    doubt = np.abs(np.abs(scaled - near) - 0.5) <= np.maximum(1e-6, np.abs(scaled) * 2.0**-50)
    for i in np.flatnonzero(doubt & (np.abs(x) < 2.0**23)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def parts(rows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(vertices, edges) of runs with about ``EDGES`` edges, or one vertex with more."""
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + EDGES, "right")) - 1)
        yield slice(lo, hi), slice(int(at[lo]), int(at[hi]))
        lo = hi


def added(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs without the nulls; null where a run has nothing else."""
    null = np.isnan(values)
    if not null.any():
        return np.add.reduceat(values, starts)
    sums = np.add.reduceat(np.where(null, 0.0, values), starts)
    return np.where(np.logical_and.reduceat(null, starts), np.nan, sums)


def totals(c: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sum of ``k`` by community; null where all are."""
    null = np.isnan(k)
    sums = np.bincount(c, weights=np.where(null, 0.0, k), minlength=len(c))
    return np.where(np.bincount(c, weights=~null, minlength=len(c)) > 0, sums, np.nan)


def inside(rows: np.ndarray, sizes: np.ndarray, to: np.ndarray, weights: np.ndarray, c: np.ndarray) -> float:
    """Weight of the block's edges inside of communities."""
    return sum(float(np.nansum(weights[edges][c[to[edges]] == np.repeat(c[rows[some]], sizes[some])])) for some, edges in parts(rows, sizes))


def between(rows: np.ndarray, sizes: np.ndarray, to: np.ndarray, weights: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(community, community, weight): the block's edges by the communities of their ends."""
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for some, edges in parts(rows, sizes):
        key = np.repeat(c[rows[some]].astype(np.int64) * len(c), sizes[some]) + c[to[edges]]
        for x, y in ((keys, key), (sums, weights[edges])):
            x.append(y)
        if sum(map(len, keys)) > 16 * EDGES or edges.stop == len(to):
            key, w = np.concatenate(keys), np.concatenate(sums)
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            keys, sums = [key[starts]], [added(w[order], starts) if len(key) else w]
    key, w = np.concatenate(keys), np.concatenate(sums)
    return key // len(c), key % len(c), w


def moves(
    rows: np.ndarray, sizes: np.ndarray, to: np.ndarray, weights: np.ndarray, may: np.ndarray,
    c: np.ndarray, k: np.ndarray, tot: np.ndarray, m2: float, resolution: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, community) of those of the block's vertices that ``may`` move and gain by it; equal gains go to the least community."""
    who, where = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    n = len(c)
    for some, edges in parts(rows, sizes):
        turn = may[some]
        own = rows[some][turn]
        if not len(own):
            continue
        # Edges of those that may move, without loops; each also has its own community, at no weight.
        walked = np.repeat(turn, sizes[some])
        spot = np.repeat(np.arange(len(own)), sizes[some][turn])
        ends, w = to[edges][walked], weights[edges][walked]
        loops = ends == own[spot]
        if loops.any():
            spot, ends, w = spot[~loops], ends[~loops], w[~loops]
        key = np.concatenate([spot * n + c[ends], np.arange(len(own)) * n + c[own]])
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        weight = added(np.concatenate([w, np.zeros(len(own))])[order], starts)
        spot, to_c = np.divmod(key[starts], n)
        mine = to_c == c[own][spot]
        k_of = k[own][spot]
        gain = rounded(weight - resolution * k_of * (tot[to_c] - np.where(mine, k_of, 0.0)) / m2)
        stay, first = gain[mine], np.searchsorted(spot, np.arange(len(own)))
        gain = np.where(np.isnan(gain), -np.inf, gain)
        most = np.maximum.reduceat(gain, first)
        least = np.minimum.reduceat(np.where(gain == most[spot], to_c, n), first)
        better = most > stay
        who.append(own[better])
        where.append(least[better].astype(np.int32))
    return np.concatenate(who), np.concatenate(where)
