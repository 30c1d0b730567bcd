"""Seatings of Pitman-Yor restaurants, sampled for many dishes side by side.

The customers of a dish leave together and are seated anew, given everyone else: that is one
Gibbs step of the dish. Seated one after another, each customer either joins a table, with a
weight of (customers - discount * tables) of the dish, or opens one, with a weight of
(strength + discount * all tables of the restaurant) * the parent's chance of the dish. The
weight of a seating is the product of these, and only its number of tables matters to others. So
c customers have t tables with a weight of

    S(c, t) * product over 0 < k < t of ((strength + discount * (others + k)) * parent)

where S(c, t) is the generalised Stirling number: S(c + 1, t) = S(c, t - 1) + (c - discount * t) S(c, t).

Up to TABLE customers the number of tables is drawn from these weights as they are. Beyond it
the dish's present number of tables is the state of a chain: some steps propose another number
from near the mode of the weights and take or leave it by the Metropolis-Hastings rule, which
leaves the weights as they are, whatever the proposals. There S is found without the recursion, so
a step costs the same for any number of customers.

All chance comes from a hash of the dish's key, so it depends on nothing but the dish.
"""

from __future__ import annotations

import functools

import numpy as np

from colloquy.llm.blocks import U64, mix

#: Customers up to which Stirling numbers are tabled; cells and dishes worked on at a time; steps of a larger dish's chain in a sweep.
TABLE = 1024
CELLS, DISHES = 1 << 20, 1 << 12
STEPS = 4
#: S is an alternating sum for tables up to this many times customers ** discount, where it loses some six digits, and a contour integral beyond.
SUMMED = 2.2


def uniform(key: np.ndarray, n: int) -> np.ndarray:
    """The `n`-th number of each key's own sequence, between 0 and 1."""
    x = mix(key + U64((0x9E3779B97F4A7C15 * (n + 1)) % 2**64))
    return (x >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series, from 7 on."""
    low = x < 7
    lift = np.where(low, x, 1.0)
    for k in range(1, 7):
        lift = lift * np.where(low, x + k, 1.0)
    y = np.where(low, x + 7, x)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(lift)


@functools.lru_cache(4)
def stirling_table(discount: float, most: int = TABLE) -> np.ndarray:
    """Logs of S(c, t) for c and t up to `most`, by the recursion."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    for c in range(1, most):
        table[c + 1, 1] = table[c, 1] + np.log(c - discount)
        table[c + 1, 2 : c + 1] = np.logaddexp(table[c, 1:c], table[c, 2 : c + 1] + np.log(c - discount * np.arange(2, c + 1)))
        table[c + 1, c + 1] = table[c, c]
    return table


def _summed(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) - lgamma(c) by the sum over k of (-1)^(k+1) C(t, k) gamma(c - kd) gamma(1 + kd) sin(pi k d) / pi, over t! d^t."""
    reach = float((t / c**discount).max()) ** (1 / (1 - discount))
    k = np.arange(1, int(40 + 4 * reach) + 1)
    a = k * discount
    tail = 1 / (12 * (c[:, None] - a)) - 1 / (12 * c[:, None])
    gammas = (c[:, None] - 0.5) * np.log1p(-a / c[:, None]) - a * np.log(c[:, None] - a) + a + tail
    with np.errstate(divide="ignore"):
        choose = np.cumsum(np.log(np.maximum(t[:, None] - k + 1, 0)) - np.log(k), axis=1)
    wave = np.sin(np.pi * (a % 2)) / np.pi
    wave[np.abs(wave) < 1e-12] = 0
    logs = choose + gammas + lgamma(1 + a)
    most = logs.max(axis=1)
    total = (np.exp(logs - most[:, None]) * (wave * np.where(k % 2, 1.0, -1.0))).sum(axis=1)
    return np.log(total) + most - lgamma(t + 1) - t * np.log(discount)


def _moments(v: np.ndarray, discount: float) -> tuple[np.ndarray, ...]:
    """At x = v / (1 + v): log of q = 1 - (1 - x)^d, and the first four derivatives of it by log x."""
    log_u = -np.log1p(v)
    q = -np.expm1(discount * log_u)
    g1 = discount * v * np.exp(discount * log_u) / q
    h = 1 + (1 - discount) * v - g1
    g2 = g1 * h
    h1 = (1 - discount) * v * (1 + v) - g2
    g3 = g2 * h + g1 * h1
    h2 = (1 - discount) * (1 + 2 * v) * v * (1 + v) - g3
    return np.log(q), g1, g2, g3, g3 * h + 2 * g2 * h1 + g1 * h2


def _solved(rises, n: int) -> np.ndarray:
    """v for which each of n functions that rise with it is zero."""
    low, high = np.full(n, -45.0), np.full(n, 60.0)
    for _ in range(64):
        at = (low + high) / 2
        over = rises(np.exp(at)) > 0
        low, high = np.where(over, low, at), np.where(over, at, high)
    return np.exp((low + high) / 2)


def _integrated(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) - lgamma(c), S being c! / (t! d^t) times the c-th coefficient of (1 - (1 - x)^d)^t: its integral around 0, through the saddle, to second order."""
    v = _solved(lambda v: _moments(v, discount)[1] - c / t, len(c))
    log_q, _, g2, g3, g4 = _moments(v, discount)
    second, third, fourth = t * g2, t * g3, t * g4
    bent = fourth / (8 * second**2) - 5 * third**2 / (24 * second**3)
    return np.log(c) - lgamma(t + 1) - t * np.log(discount) + t * log_q + c * np.log1p(1 / v) - 0.5 * np.log(2 * np.pi * second) + np.log1p(bent)


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) - lgamma(c) for many customers and 1 <= t < c tables."""
    out, few = np.empty(len(c)), t <= SUMMED * c**discount
    if few.any():
        out[few] = _summed(c[few], t[few], discount)
    if not few.all():
        out[~few] = _integrated(c[~few], t[~few], discount)
    return out


def _drawn(customers: np.ndarray, first: np.ndarray, parent: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables by the weights of each number from 1 to the customers, all at most TABLE and the last the most."""
    width = int(customers[-1])
    new = np.log((first[:, None] + discount * np.arange(1, width)) * parent[:, None])
    logs = stirling_table(discount)[customers, 1 : width + 1]
    logs[:, 1:] += np.cumsum(new, axis=1)
    sums = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return 1 + (sums[:, :-1] < uniform(key, 0)[:, None] * sums[:, -1:]).sum(axis=1)


def _chained(customers: np.ndarray, first: np.ndarray, parent: np.ndarray, discount: float, key: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The present number of tables after STEPS steps of a chain with the weights as its chances."""
    c, a = customers.astype(np.float64), first / discount

    def weight(t: np.ndarray) -> np.ndarray:
        return t * np.log(discount * parent) + lgamma(a + t) + log_stirling(c, t, discount)

    def tail(x: np.ndarray) -> np.ndarray:
        return x / (2 * np.sqrt(2 + x * x))

    def even(v: np.ndarray) -> np.ndarray:
        log_q, g1, *_ = _moments(v, discount)
        q = np.exp(log_q)
        return a * parent * q * g1 / (1 - parent * q) - c

    v = _solved(even, len(c))
    log_q, g1, g2, *_ = _moments(v, discount)
    q = np.exp(log_q)
    mode = np.clip(a * parent * q / (1 - parent * q), 1, c - 1)
    spread = np.clip(1 / np.sqrt(np.maximum(1 / mode - 1 / (a + mode) + g1 * g1 / (mode * g2), 1e-18)), 0.6, c)
    chance = lambda t: np.log(tail((t + 0.5 - mode) / spread) - tail((t - 0.5 - mode) / spread))
    now = np.clip(tables, 1, customers - 1).astype(np.float64)
    odds = weight(now) - chance(now)
    for n in range(STEPS):
        u = uniform(key, 2 * n)
        other = np.rint(mode + spread * (2 * u - 1) / np.sqrt(2 * u * (1 - u)))
        inside = (other >= 1) & (other < c)
        other = np.where(inside, other, now)
        its = weight(other) - chance(other)
        take = inside & (np.log(uniform(key, 2 * n + 1)) < its - odds)
        now, odds = np.where(take, other, now), np.where(take, its, odds)
    return now.astype(np.int64)


def seated(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, key: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Tables of each dish after a Gibbs step, given the tables of the `others` in its restaurant, the parent's chance of the dish, and its present tables.

    A table for every one of over TABLE customers has a chance that no double holds, and is left out.
    """
    tables = (customers > 0).astype(np.int64)  # who comes alone has a table of their own
    first = strength + discount * others
    live = np.flatnonzero(customers > 1)
    live = live[np.argsort(customers[live], kind="stable")]
    split, at = np.searchsorted(customers[live], TABLE, side="right"), 0
    while at < len(live):
        if at < split:  # as many dishes as have cells for the largest of them
            ends = (np.arange(at, split) - at + 1) * customers[live[at:split]]
            to = at + max(1, int(np.searchsorted(ends, CELLS, side="right")))
        else:
            to = min(at + DISHES, len(live))
        own = live[at:to]
        args = customers[own], first[own].astype(np.float64), parent[own], discount, mix(key[own])
        tables[own] = _drawn(*args) if at < split else _chained(*args, present[own])
        at = to
    return tables
