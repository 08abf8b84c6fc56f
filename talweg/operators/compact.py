"""The overlay of `overlay.py` for shapes of few edges: the same steps by the same arithmetic, on columns of many shapes at once
within a task. Such shapes need no joins, checkpoints or shuffles of their edges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Edges that a shape may have here, and pairs of edges that are looked at together.
FEW, PAIRS = 1024, 1 << 21
PARTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def half_up(v: np.ndarray) -> np.ndarray:
    return np.trunc(v + np.copysign(0.5, v)).astype(np.int64)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted `keys` differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def spans(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with every number from its `first` up to its `stop`, that left out."""
    n = np.maximum(stop - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def placed(shape: np.ndarray, x: np.ndarray, west: np.ndarray) -> np.ndarray:
    """Numbers in order of shape and x, for x less than 2**32 from the shape's west."""
    return (shape << 32) + (x - west)


def turned(e: np.ndarray, a: np.ndarray, f: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Positive where end `k` of edges f[b] is left of edges e[a]."""
    return (e[a, 2] - e[a, 0]) * (f[b, 2 * k + 1] - e[a, 1]) - (e[a, 3] - e[a, 1]) * (f[b, 2 * k] - e[a, 0])


def cut(shape: np.ndarray, layer: np.ndarray, e: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (x0, y0, x1, y1) in pieces that meet at their ends only."""
    for _ in range(rounds):
        lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        # in order of their west ends an edge can meet those after it that begin before it ends
        order = np.lexsort((lo[:, 0], shape))
        shape, layer, e, lo, hi = shape[order], layer[order], e[order], lo[order], hi[order]
        new = starts_of(shape)
        number, west = np.cumsum(new) - 1, lo[np.flatnonzero(new), 0][np.cumsum(new) - 1]
        i, j = spans(np.arange(1, len(e) + 1), np.searchsorted(placed(number, lo[:, 0], west), placed(number, hi[:, 0], west), "right"))
        near = (lo[i, 1] <= hi[j, 1]) & (lo[j, 1] <= hi[i, 1])
        i, j = i[near], j[near]
        sa, sb = [turned(e, j, e, i, k) for k in (0, 1)], [turned(e, i, e, j, k) for k in (0, 1)]
        proper = (np.sign(sa[0]) * np.sign(sa[1]) < 0) & (np.sign(sb[0]) * np.sign(sb[1]) < 0)
        p, q = i[proper], j[proper]
        t = sa[0][proper].astype(float) / (sa[0][proper].astype(float) - sa[1][proper].astype(float))
        x, y = (half_up(e[p, c] + t * (e[p, c + 2] - e[p, c])) for c in (0, 1))
        spots = [(p, x, y), (q, x, y)]
        for s, of, other in ((sa, j, i), (sb, i, j)):
            for k in (0, 1):
                at = ~proper & (s[k] == 0)
                spots.append((of[at], e[other[at], 2 * k], e[other[at], 2 * k + 1]))
        m, x, y = (np.concatenate([s[c] for s in spots]) for c in range(3))
        dx, dy = e[m, 2] - e[m, 0], e[m, 3] - e[m, 1]
        t, whole = (x - e[m, 0]) * dx + (y - e[m, 1]) * dy, dx * dx + dy * dy
        end = ((x == e[m, 0]) & (y == e[m, 1])) | ((x == e[m, 2]) & (y == e[m, 3]))
        kept = (t > 0) & (t < whole) & ~end
        if not kept.any():
            return shape, layer, e
        own, n = np.arange(len(e)), len(e)
        m = np.concatenate([own, m[kept], own])
        t = np.concatenate([np.full(n, -1), t[kept], np.full(n, np.iinfo(np.int64).max)])
        x, y = np.concatenate([e[:, 0], x[kept], e[:, 2]]), np.concatenate([e[:, 1], y[kept], e[:, 3]])
        order = np.lexsort((y, x, t, m))
        m, x, y = m[order], x[order], y[order]
        piece = np.flatnonzero((m[1:] == m[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        shape, layer, e = shape[m[piece]], layer[m[piece]], np.stack([x[piece], y[piece], x[piece + 1], y[piece + 1]], 1)
    raise RuntimeError("overlay: rounded crossings keep making others; take a smaller unit")


def border(shape: np.ndarray, layer: np.ndarray, e: np.ndarray, inside: Callable, layers: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces on the border of the region whose winding numbers `inside` accepts, with the region on their left."""
    ahead = (e[:, 0] < e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] < e[:, 3]))
    e = np.where(ahead[:, None], e, e[:, [2, 3, 0, 1]])
    order = np.lexsort((e[:, 3], e[:, 2], e[:, 1], e[:, 0], shape))
    shape, layer, e, m = shape[order], layer[order], e[order], np.where(ahead, 1, -1)[order]
    first = np.flatnonzero(starts_of(shape, *e.T))
    turns = np.stack([np.add.reduceat(np.where(layer == k, m, 0), first) for k in range(layers)], 1)
    some = turns.any(axis=1)
    shape, e, turns = shape[first][some], e[first][some], turns[some]
    if not len(shape):
        return shape, e
    mx, my, upright = e[:, 0] + e[:, 2], e[:, 1] + e[:, 3], e[:, 0] == e[:, 2]
    new = starts_of(shape)
    number, west = np.cumsum(new) - 1, 2 * e[np.flatnonzero(new), 0][np.cumsum(new) - 1]  # pieces lie in order of their west ends
    order = np.lexsort((mx, shape))
    middles = placed(number, mx[order], west)
    # i beside its middle, j below it
    j, i = spans(np.searchsorted(middles, placed(number, 2 * e[:, 0], west), "left"), np.searchsorted(middles, placed(number, 2 * e[:, 2], west), "right"))
    i = order[i]
    w0, w1 = 2 * e[j, 0], 2 * e[j, 2]
    here = (w0 < w1) & np.where(upright[i], (w0 < mx[i]) & (mx[i] <= w1), (w0 <= mx[i]) & (mx[i] < w1))
    i, j = i[here], j[here]
    below = (e[j, 2] - e[j, 0]) * (my[i] - 2 * e[j, 1]) - (e[j, 3] - e[j, 1]) * (mx[i] - 2 * e[j, 0]) > 0
    w = np.stack([np.bincount(i[below], turns[j[below], k], len(e)).astype(np.int64) for k in range(layers)], 1)
    left, right = np.where(upright[:, None], w, w + turns), np.where(upright[:, None], w - turns, w)
    on_left, on_right = inside(*left.T), inside(*right.T)
    kept = on_left != on_right
    return shape[kept], np.where(on_left[:, None], e, e[:, [2, 3, 0, 1]])[kept]


def followed(shape: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each border piece the one that turns off first to the left at its end."""
    n = len(shape)
    s, x, y = np.concatenate([shape, shape]), np.concatenate([e[:, 0], e[:, 2]]), np.concatenate([e[:, 1], e[:, 3]])
    order = np.lexsort((y, x, s))
    spot = np.empty(2 * n, np.int64)
    spot[order] = np.cumsum(starts_of(s[order], x[order], y[order])) - 1
    out = np.argsort(spot[:n], kind="stable")
    count = np.bincount(spot[:n], minlength=spot.max() + 1)
    first = np.cumsum(count) - count
    many = count[spot[n:]]
    i = np.repeat(np.arange(n), many)
    to = out[np.repeat(first[spot[n:]], many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)]
    back = np.arctan2((e[i, 1] - e[i, 3]).astype(float), (e[i, 0] - e[i, 2]).astype(float))
    forth = np.arctan2((e[to, 3] - e[to, 1]).astype(float), (e[to, 2] - e[to, 0]).astype(float))
    bend = np.mod(back - forth, 2 * math.pi)
    order = np.lexsort((np.where(bend <= 0, 7.0, bend), i))
    best = order[starts_of(i[order])]
    if len(best) < n:
        raise RuntimeError("overlay: a border has an open end")
    return to[best]


def rings(shape: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shape, twice, size) of each ring, in order of shape and size, and the points of all: the smallest first, none amid straight lines."""
    jump = followed(shape, e)
    root, ahead, k = np.arange(len(e)), np.zeros(len(e), np.int64), 1
    while (lower := root[jump] < root).any():
        ahead, root, jump, k = np.where(lower, ahead[jump] + k, ahead), np.minimum(root, root[jump]), jump[jump], 2 * k
    order = np.lexsort((-ahead, root))
    x, y, root, shape = e[order, 0], e[order, 1], root[order], shape[order]

    def around(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = starts_of(r)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(r)) - 1
        before, after = np.arange(len(r)) - 1, np.arange(len(r)) + 1
        before[first], after[last] = last, first
        return first, before, after

    _, p, n = around(root)
    corner = (x - x[p]) * (y[n] - y) - (y - y[p]) * (x[n] - x) != 0
    x, y, root, shape = x[corner], y[corner], root[corner], shape[corner]
    first, _, n = around(root)
    which = np.cumsum(starts_of(root)) - 1
    size = np.bincount(which)
    small = np.lexsort((y, x, which))[first]  # the smallest point of each ring
    ox, oy = x[first][which], y[first][which]
    twice = np.add.reduceat((x - ox) * (y[n] - oy) - (x[n] - ox) * (y - oy), first)
    rank = np.lexsort((y[n[small]], x[n[small]], y[small], x[small], -np.abs(twice), shape[first]))
    rank = rank[size[rank] > 2]
    step = np.arange(size[rank].sum()) - np.repeat(np.cumsum(size[rank]) - size[rank], size[rank])
    at = np.repeat(first[rank], size[rank]) + (np.repeat((small - first)[rank], size[rank]) + step) % np.repeat(size[rank], size[rank])
    return shape[first][rank], twice[rank], size[rank], x[at], y[at]


def overlaid(batches: Iterator[pa.RecordBatch], inside: Callable, layers: int, unit: float) -> Iterator[pa.RecordBatch]:
    """Batches of (shape, edges: list of struct<layer, x0, y0, x1, y1>) to (shape, parts, area)."""
    for batch in batches:
        held = batch.column("edges")
        offsets, flat = held.offsets.to_numpy(), held.values
        layer, *ends = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("layer", "x0", "y0", "x1", "y1"))
        e = np.stack(ends, 1)
        cost = np.cumsum(np.diff(offsets).astype(np.int64) ** 2)
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PAIRS, "right")))
            a, z = offsets[lo], offsets[hi]
            shape = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
            span = np.flatnonzero(starts_of(shape)) if z > a else shape
            for c in (0, 1) if z > a else ():
                if (np.maximum.reduceat(e[a:z, c], span) - np.minimum.reduceat(e[a:z, c], span)).max() > 1 << 30:
                    raise OverflowError("overlay: a shape spans more than 2**30 units; take a larger unit")
            region = border(*cut(shape, layer[a:z], e[a:z]), inside, layers) if z > a else (shape, e[a:z])
            lo = hi
            if not len(region[0]):
                continue
            of, twice, size, x, y = rings(*region)
            if not len(of):
                continue
            first = np.flatnonzero(starts_of(of))
            points = pa.StructArray.from_arrays([pa.array(x * unit), pa.array(y * unit)], ["x", "y"])
            lines = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), points)
            parts = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), lines)
            area = np.add.reduceat(twice, first) * (unit * unit / 2)
            yield pa.RecordBatch.from_arrays([batch.column("shape").take(pa.array(of[first])), parts, pa.array(area)], ["shape", "parts", "area"])
