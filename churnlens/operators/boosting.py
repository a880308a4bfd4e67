"""Many boosted ensembles at once (V1 for trees): each is grown in one task, by the rules of Spark's booster.

``GBTClassifier`` runs a Spark job a level of each tree, so a grid of
thousands of trees is a hundred thousand jobs of a few milliseconds of work. Here
the training rows of a fold, cut into at most 64 bins a feature, travel once to
every task, and a task grows whole ensembles on them. The steps are
Spark's: thresholds from counts of values, gain by weighted variance, the first
tree on +1 / -1 and each later one on the negative gradient of the log loss,
features drawn for each node and rows for each tree by its random numbers. So an
ensemble is the one that ``GBTClassifier`` fits on the same rows in one
partition, up to the rounding of sums; only thresholds come from all rows where
Spark samples more than 10,000.
"""

from __future__ import annotations

import math
import struct

import numpy as np

BINS = 64
_MASK = (1 << 64) - 1
_EPS = 2.0 ** -52


# ---- Spark's random numbers ------------------------------------------------------

def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _state(seed: int) -> int:
    """The first state of Spark's ``XORShiftRandom``."""
    data = struct.pack(">q", (seed + (1 << 63)) % (1 << 64) - (1 << 63))
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(s: int) -> int:
    s ^= s << 21 & _MASK
    s ^= s >> 35
    return s ^ (s << 4 & _MASK)


_JUMPS: list = []       # for 1, 2, 4, ... steps: eight tables of 256 states, as a step is linear in the bits


def _jump(i: int) -> np.ndarray:
    while len(_JUMPS) <= i:
        if _JUMPS:
            bits = _moved(_moved(np.uint64(1) << np.arange(64, dtype=np.uint64), _JUMPS[-1]), _JUMPS[-1])
        else:
            bits = np.array([_step(1 << b) for b in range(64)], dtype=np.uint64)
        table = np.zeros((8, 256), dtype=np.uint64)
        for b in range(64):
            n = 1 << b % 8
            table[b // 8, n:2 * n] = table[b // 8, :n] ^ bits[b]
        _JUMPS.append(table)
    return _JUMPS[i]


def _moved(states: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for b in range(8):
        out ^= table[b][(states >> np.uint64(8 * b) & np.uint64(255)).astype(np.intp)]
    return out


def uniforms(seed: int, n: int) -> np.ndarray:
    """The first n doubles of Spark's generator for a seed."""
    s = np.array([_step(_state(seed))], dtype=np.uint64)
    i = 0
    while len(s) < 2 * n:
        s = np.concatenate([s, _moved(s, _jump(i))])
        i += 1
    high, low = s[0:2 * n:2] & np.uint64((1 << 26) - 1), s[1:2 * n:2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53


class _JavaRandom:
    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = self.s >> 16
        return x - (1 << 32) if x >> 31 else x

    def long(self) -> int:
        return (self._next() << 32) + self._next()


def _subset(seed: int, of: int, k: int) -> list[int]:
    """``k`` of ``of`` features, by the reservoir with which Spark draws them."""
    out, s = list(range(k)), _state(seed)
    for item in range(k, of):
        a = _step(s)
        s = _step(a)
        u = (((a & (1 << 26) - 1) << 27) + (s & (1 << 27) - 1)) * 2.0 ** -53
        at = int(u * (item + 1))
        if at < k:
            out[at] = item
    return out


# ---- bins ------------------------------------------------------------------------

def thresholds(x: np.ndarray, weight: np.ndarray | None = None, bins: int = BINS) -> np.ndarray:
    """Candidate thresholds of a column: between all values, or between those nearest to equal shares of the weight."""
    values, where = np.unique(x, return_inverse=True)
    count = np.bincount(where, weights=weight).astype(np.float64)
    mids = (values[:-1] + values[1:]) / 2
    most = min(bins, len(x)) - 1
    if len(mids) <= most:
        return mids
    stride = count.sum() / (most + 1)
    upto, target, out = np.cumsum(count).tolist(), stride, []
    for i in range(1, len(upto)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(mids[i - 1])
            target += stride
    return np.array(out)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Features x rows: the number of thresholds below a value."""
    return np.stack([np.searchsorted(c, x[:, j], side="left").astype(np.uint8) for j, c in enumerate(cuts)])


# ---- boosting ----------------------------------------------------------------------

def _impurity(count, total, square):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, (square - total * total / count) / count, 0.0)


def _grown(bins: np.ndarray, splits: np.ndarray, n: int, target: np.ndarray, weight: np.ndarray | None, drawn: np.ndarray | None, max_depth: int,
           per_node: int, seed: int) -> np.ndarray:
    """One regression tree on the first ``n`` rows; its prediction for every row."""
    k, rows = bins.shape
    rng = _JavaRandom(seed)
    w = weight if drawn is None else drawn if weight is None else weight * drawn
    stats = [None if w is None else w, target if w is None else w * target]
    stats.append(stats[1] * target)
    raw_of = drawn if weight is not None and drawn is not None else None
    value = [0.0]                                       # of each node
    node = np.zeros(rows, dtype=np.int64)
    level, impurity = [0], [None]                       # nodes to split, in the order in which they draw features
    every = np.arange(rows)
    for depth in range(max_depth):
        m = len(level)
        place = np.full(len(value), m, dtype=np.int64)
        place[level] = np.arange(m)
        at = place[node]
        base = at[:n] * BINS
        hist = np.empty((4 if weight is not None else 3, m, k, BINS))
        for j in range(k):
            idx = base + bins[j, :n]
            for s, of in enumerate([*stats, raw_of] if weight is not None else stats):
                hist[s, :, j] = np.bincount(idx, weights=of, minlength=(m + 1) * BINS)[:m * BINS].reshape(m, BINS)
        if per_node < k:
            picked = np.array([_subset(rng.long(), k, per_node) for _ in range(m)])
            hist = np.take_along_axis(hist, picked[None, :, :, None], axis=2)
        else:
            picked = np.tile(np.arange(k), (m, 1))
        upto = np.cumsum(hist, axis=3)
        left = upto[..., :-1]
        right = upto[..., -1:] - left
        few = (left[-1 if weight is not None else 0] < 1) | (right[-1 if weight is not None else 0] < 1)
        li, ri = _impurity(*left[:3]), _impurity(*right[:3])
        both = left[0] + right[0]
        if depth == 0:
            t = left[:3, 0, 0, 0] + right[:3, 0, 0, 0]
            value[0] = t[1] / t[0] if t[0] else 0.0
            impurity = [float(_impurity(*t))]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.array(impurity)[:, None, None] - left[0] / both * li - right[0] / both * ri
        gain[few | ~(gain >= 0) | (np.arange(BINS - 1) >= splits[picked][:, :, None])] = -np.inf
        flat = gain.reshape(m, -1)
        best = flat.argmax(axis=1)
        feature, cut, child, after = np.zeros(m + 1, dtype=np.int64), np.full(m + 1, 255, dtype=np.int64), np.zeros(m + 1, dtype=np.int64), []
        for a, b in enumerate(best.tolist()):
            if not flat[a, b] > 0:
                continue
            p, c = divmod(b, BINS - 1)
            feature[a], cut[a], child[a] = picked[a, p], c, len(value)
            for side, imp in ((left, li), (right, ri)):
                if abs(imp[a, p, c]) >= _EPS:
                    after.append((len(value), float(imp[a, p, c])))
                value.append(side[1, a, p, c] / side[0, a, p, c])
        parted = child[at]
        goes = parted > 0
        node = np.where(goes, parted + (bins[feature[at], every] > cut[at]), node)
        level, impurity = [x[0] for x in after[::-1]], [x[1] for x in after[::-1]]
        if not level:
            break
    return np.array(value)[node]


def staged_margins(bins: np.ndarray, splits: np.ndarray, y: np.ndarray, n: int, stages, max_depth: int, learning_rate: float, subsample: float = 1.0,
                   colsample: float = 1.0, pos_weight: float | None = None, seed: int = 17) -> np.ndarray:
    """Log-odds of the rows from the ``n``-th on after each of ``stages`` trees (ascending), grown on the first ``n``: stages x rows."""
    k = len(bins)
    sign = np.where(y[:n] == 1, 1.0, -1.0)
    weight = None if pos_weight is None else np.where(sign > 0, float(pos_weight), 1.0)
    per_node = max(1, math.ceil(colsample * k)) if colsample < 1 else k
    total, target, out = np.zeros(bins.shape[1]), sign, []
    for t in range(stages[-1]):
        drawn = (uniforms(seed + t + 1, n) < subsample).astype(np.float64) if subsample < 1 else None
        pred = _grown(bins, splits, n, target, weight, drawn, max_depth, per_node, seed + t)
        total += pred if t == 0 else learning_rate * pred
        target = 4.0 * sign / (1.0 + np.exp(2.0 * sign * total[:n]))
        if t + 1 in stages:
            out.append(2 * total[n:])
    return np.stack(out)
