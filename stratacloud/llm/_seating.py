"""Exact conditional draws for Pitman-Yor restaurants, and random numbers that hang on what they are for.

Every random number is a function of a key (a word, a pair of words) and of the number of the draw, so that results
depend neither on partitions nor on the order of rows.

Seating c customers at t tables has the weight a**t * S(c, t), where a is the weight of a new table and S the generalised
Stirling number of the discount (the sum over all seatings of the products of (1 - d)(2 - d)... of each table). Only
ratios S(c, t + 1) / S(c, t) are needed. They come from the recursion of the ratios up to SMALL customers, beyond from
the finite alternating sum over powers of the generating function ((1 - (1 - z)**d) / d)**t / t!, or, where tables are
too many for that sum, from its saddle point.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from stratacloud.llm._text import mix

SMALL = 512
#: Customers up to which cells are drawn side by side.
FEW = 24
_TERMS = 40
_GOLD = 0x9E3779B97F4A7C15
#: Weights that one step of a draw holds at once.
_CHUNK = 1 << 20


def uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """One number of (0, 1) per key and draw."""
    h = mix(mix(key + np.uint64((draw + 1) * _GOLD & (1 << 64) - 1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def salted(key: np.ndarray, *salt: int) -> np.ndarray:
    """Keys of another use: of another sweep, or of another variable."""
    for s in salt:
        key = mix(key ^ np.uint64((s + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
    return key


def gammas(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma variables of scale 1 (Marsaglia and Tsang; shapes below 1 by a power of a uniform)."""
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, draw = np.empty(len(shape)), np.arange(len(shape)), 1
    while len(left):
        k, dl = key[left], d[left]
        x = np.sqrt(-2 * np.log(uniform(k, draw))) * np.cos(2 * np.pi * uniform(k, draw + 1))
        v = np.maximum(1 + c[left] * x, 0) ** 3
        with np.errstate(divide="ignore", invalid="ignore"):
            good = np.log(uniform(k, draw + 2)) < x * x / 2 + dl - dl * v + dl * np.log(v)
        out[left[good]] = (dl * v)[good]
        left, draw = left[~good], draw + 3
    out[low] *= uniform(key[low], 0) ** (1 / shape[low])
    return out


def tilted_stables(mass: float, d: float, key: np.ndarray) -> np.ndarray:
    """Variables with the Laplace transform exp(-mass * ((1 + s)**d - 1)): Kanter's stable ones, tilted by rejection.

    A mass above 1 is a sum of parts of at most 1 each, so that a part is accepted with 1/e at least.
    """
    out = np.zeros(len(key))
    if mass <= 0:
        return out
    parts = math.ceil(mass)
    scale = (mass / parts) ** (1 / d)
    for p in range(parts):
        own, left, draw = salted(key, p), np.arange(len(key)), 0
        while len(left):
            k = own[left]
            u, e = np.pi * uniform(k, draw), -np.log(uniform(k, draw + 1))
            a = np.sin((1 - d) * u) * np.sin(d * u) ** (d / (1 - d)) / np.sin(u) ** (1 / (1 - d))
            s = scale * (a / e) ** ((1 - d) / d)
            good = uniform(k, draw + 2) < np.exp(-s)
            out[left[good]] += s[good]
            left, draw = left[~good], draw + 3
    return out


def stable_sum(mass: float, d: float, seed: int) -> float:
    """One tilted stable of any mass; beyond 100,000 by its normal limit (mean mass * d, variance mass * d * (1 - d))."""
    if mass > 1e5:
        z = uniform(np.array([seed], np.uint64), 0)[0], uniform(np.array([seed], np.uint64), 1)[0]
        normal = math.sqrt(-2 * math.log(z[0])) * math.cos(2 * math.pi * z[1])
        return mass * d + normal * math.sqrt(mass * d * (1 - d))
    parts = max(math.ceil(mass), 1)
    return float(tilted_stables(mass / parts, d, salted(np.arange(parts, dtype=np.uint64), seed)).sum())


@functools.cache
def _ratios(d: float) -> np.ndarray:
    """log S(c, t + 1) / S(c, t) for c <= SMALL at [c, t]; -inf from t = c on."""
    out = np.full((SMALL + 1, SMALL + 2), -np.inf)
    row = np.zeros(SMALL + 2)  # c = 1: S(1, 2) = 0
    t = np.arange(SMALL + 2)
    for c in range(1, SMALL):
        with np.errstate(divide="ignore"):
            before = np.concatenate(([0.0, 0.0], 1 / row[1:-1]))
            before[1] = 0.0
            row = np.where((t >= 1) & (t <= c), (1 + np.maximum(c - d * (t + 1), 0) * row) / (before + np.maximum(c - d * t, 1e-300)), 0.0)
            out[c + 1] = np.log(row)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of 50 and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


@functools.cache
def _reciprocal_gammas(d: float) -> tuple[float, ...]:
    """1 / Gamma(-d j) by the reflection formula, 0 where d j is whole."""
    return tuple(0.0 if abs(d * j - round(d * j)) < 1e-12 else -math.sin(math.pi * d * j) * math.gamma(d * j + 1) / math.pi for j in range(_TERMS + 1))


def _power_sum(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """[z**c] of (1 - (1 - z)**d)**t, over that of z**c in (1 - z)**d; t * c**-d of 1 at most."""
    total, factor = np.zeros(len(c)), np.ones(len(c))
    base = _log_gamma(c - d)
    for j, r in zip(range(1, _TERMS + 1), _reciprocal_gammas(d)[1:]):
        factor = factor * (t - j + 1) / -j
        if r:
            total += factor * r * np.exp(_log_gamma(np.maximum(c - d * j, 50.0)) - base)
    return total


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log [z**c] (1 - (1 - z)**d)**t by the saddle point, with y = 1 - z."""
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)
    for _ in range(60):  # t d y**(d-1) (1-y) / (1 - y**d) falls from infinity to t as y goes from 0 to 1
        mid = (low + high) / 2
        y = np.exp(mid)
        much = t * d * y ** (d - 1) * -np.expm1(mid) / -np.expm1(d * mid) > c
        low, high = np.where(much, mid, low), np.where(much, high, mid)
    x = (low + high) / 2
    y, z = np.exp(x), -np.expm1(x)
    phi, slope = -np.expm1(d * x), d * y ** (d - 1)
    f = z * slope / phi  # d log phi / d log z, times t it is c
    curve = t * f * (1 + z * (1 - d) / y - f)
    return t * np.log(phi) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(curve, 1e-300))


def log_ratio(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t + 1) / S(c, t) for 1 <= t < c."""
    out = np.empty(len(c))
    small = c <= SMALL
    out[small] = _ratios(d)[c[small], t[small]]
    rest = np.flatnonzero(~small)
    if len(rest):
        cc, tt = c[rest].astype(np.float64), t[rest].astype(np.float64)
        few = (tt + 1) * cc**-d <= 1
        at, ca, ta = rest[few], cc[few], tt[few]
        out[at] = np.log(_power_sum(ca, ta + 1, d) / _power_sum(ca, ta, d)) - np.log(d * (ta + 1))
        at, ca, ta = rest[~few], cc[~few], tt[~few]
        out[at] = _saddle(ca, ta + 1, d) - _saddle(ca, ta, d) - np.log(d * (ta + 1))
    return out


def _mode(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """About the likeliest number of tables: (a / d) (1 - y**d) where a y**(d-1) (1-y) = c."""
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-15)
    with np.errstate(over="ignore"):
        for _ in range(60):
            mid = (low + high) / 2
            much = a * np.exp((d - 1) * mid) * -np.expm1(mid) > c
            low, high = np.where(much, mid, low), np.where(much, high, mid)
    return np.clip(a / d * -np.expm1(d * (low + high) / 2), 1, c)


def _few(c: np.ndarray, a: np.ndarray, u: np.ndarray, d: float) -> np.ndarray:
    """``draw_tables`` of up to FEW customers; c falls. One step per number of tables, over the cells that have more customers."""
    ratio = np.exp(_ratios(d)[: FEW + 1, : FEW + 1])
    falling, weights = -c, [np.ones(len(c))]
    total = np.ones(len(c))
    # Beyond this number of tables the weights of all cells together are below 1e-12 of their first.
    rate = float(a.max(initial=0.0)) / d
    for t in range(1, min(FEW, int(6 + 9 * rate**0.5 + 2 * rate) + 1)):
        n = int(np.searchsorted(falling, -t))  # cells with c > t
        if not n:
            break
        w = weights[-1][:n] * a[:n] * ratio[c[:n], t]
        weights.append(w)
        total[:n] += w
    want, done, out = u * total, np.zeros(len(c)), np.ones(len(c), np.int64)
    for t, w in enumerate(weights[:-1]):
        done[: len(w)] += w
        n = len(weights[t + 1])
        out[:n] += done[:n] <= want[:n]
    return np.minimum(out, c)


def draw_tables(c: np.ndarray, a: np.ndarray, u: np.ndarray, d: float) -> np.ndarray:
    """Numbers of tables t of c customers each, drawn by u from the weights a**t S(c, t).

    Weights are summed to where a Poisson law, which bounds them, has 1e-12 left, or within ten standard deviations of
    the mode and more.
    """
    out = np.ones(len(c), np.int64)
    todo = np.flatnonzero((c > 1) & (a > 0))
    low = todo[c[todo] <= FEW]
    low = low[np.argsort(-c[low].astype(np.int8), kind="stable")]
    # Cells of alike rates go together, as the greatest says how far to go.
    rate = a[low] / d
    for lower, upper in ((0, 0.02), (0.02, 0.5), (0.5, np.inf)):
        at = low[(rate >= lower) & (rate < upper)]
        if len(at):
            out[at] = _few(c[at], a[at], u[at], d)
    todo = todo[c[todo] > FEW]
    if not len(todo):
        return out
    cc, aa = c[todo].astype(np.int64), a[todo]
    mode = _mode(cc.astype(np.float64), aa, d)
    small = aa / d < 4
    width = 10 * np.sqrt(mode) + 12
    first = np.where(small, 1, np.maximum(1, np.floor(mode - width))).astype(np.int64)
    last = np.minimum(cc, np.where(small, np.ceil(6 + 9 * np.sqrt(aa / d) + 2 * aa / d), np.ceil(mode + width))).astype(np.int64)
    ends = np.cumsum(last - first + 1)
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CHUNK, side="right")))
        n = (last - first + 1)[i:j]
        start = np.cumsum(n) - n
        cell = np.repeat(np.arange(i, j), n)
        t = np.arange(len(cell)) - np.repeat(start, n) + first[cell]
        steps = np.zeros(len(cell))
        inner = np.ones(len(cell), bool)
        inner[start] = False
        inner = np.flatnonzero(inner)
        steps[inner] = np.log(aa)[cell[inner]] + log_ratio(cc[cell[inner]], t[inner] - 1, d)
        # Sums run over each cell alone: the total before a cell is taken off at its first row.
        log_w = np.cumsum(steps)
        log_w -= np.repeat(log_w[start], n)
        w = np.exp(log_w - np.repeat(np.maximum.reduceat(log_w, start), n))
        up = np.cumsum(w)
        before = up[start] - w[start]
        total = up[start + n - 1] - before
        below = up - np.repeat(before, n) <= np.repeat(u[todo[i:j]] * total, n)
        out[todo[i:j]] = np.minimum(first[i:j] + np.add.reduceat(below.astype(np.int64), start), last[i:j])
        i = j
    return out
