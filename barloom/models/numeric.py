"""Numerics shared by the fits: simplex search (S11) and recursions over time in vector form."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

BLOCK = 64


class Minimum(NamedTuple):
    at: np.ndarray
    value: float
    rounds: int
    converged: bool


def finite(f: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], float]:
    """f, infinite where it fails or gives no number, so that it may refuse a region."""

    def value(x: np.ndarray) -> float:
        try:
            v = float(f(x))
        except (ArithmeticError, ValueError):
            return math.inf
        return v if math.isfinite(v) else math.inf

    return value


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, *, step: float = 0.25, rounds: int = 2000, tolerance: float = 1e-8, restarts: int = 1) -> Minimum:
    """Nelder and Mead's search (1965) with the coefficients that Gao and Han (2012) give for a
    dimension, started again about its result. A run ends when the corners' values and places are
    both as close as rounding in f allows."""
    cost, n = finite(f), len(start)
    grow, inward, shrunk = (2.0, 0.5, 0.5) if n == 1 else (1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n)
    top, used, settled = (cost(np.asarray(start, float)), tuple(np.asarray(start, float))), 0, False
    for _ in range(restarts + 1):
        centre = np.array(top[1])
        corners = sorted([top, *((cost(x), tuple(x)) for x in centre + step * np.eye(n))])
        settled = False
        while used < rounds and not settled:
            used += 1
            *good, (worst, at) = corners
            middle = np.mean([x for _, x in good], 0)
            look = lambda k: (cost(x := middle + k * (middle - np.array(at))), tuple(x))  # noqa: E731,B023
            new = look(1.0)
            if new[0] < good[0][0]:
                new = min(new, look(grow))
            elif new[0] >= good[-1][0]:
                tried = look(inward if new[0] < worst else -inward)
                new = tried if tried[0] < min(new[0], worst) else None
            if new is None:
                first = np.array(good[0][1])
                corners = sorted([good[0], *((cost(y), tuple(y)) for y in (first + shrunk * (np.array(x) - first) for _, x in corners[1:]))])
            else:
                corners = sorted([*good, new])
            low, high = corners[0], corners[-1]
            width = max(max(abs(p - q) for p, q in zip(x, low[1], strict=True)) for _, x in corners)
            settled = high[0] - low[0] <= tolerance * (abs(low[0]) + tolerance) and width <= math.sqrt(tolerance)
        top = corners[0]
    return Minimum(np.array(top[1]), top[0], used, settled)


def descend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, *, rounds: int = 200, tolerance: float = 1e-7) -> Minimum:
    """Quasi-Newton search (BFGS) with step halving, for a cost with its gradient. It ends where the
    gradient is small against the cost, or where no step lowers the cost."""

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        try:
            v, g = f(x)
        except (ArithmeticError, ValueError):
            return math.inf, x
        return (float(v), g) if math.isfinite(v) and np.isfinite(g).all() else (math.inf, x)

    x = np.asarray(start, float)
    v, g = at(x)
    if not math.isfinite(v):
        return Minimum(x, v, 0, False)
    bend, scaled = np.eye(len(x)) / max(1.0, float(np.abs(g).max())), False
    for used in range(1, rounds + 1):
        if np.abs(g).max() <= tolerance * (1 + abs(v)):
            return Minimum(x, v, used - 1, True)
        way = -bend @ g
        if way @ g >= 0:
            bend = np.eye(len(x)) / max(1.0, float(np.abs(g).max()))
            way = -bend @ g
        way *= min(1.0, 2.0 / float(np.abs(way).max()))
        size = 1.0
        while True:
            y = x + size * way
            w, k = at(y)
            if w <= v + 1e-4 * size * (way @ g):
                break
            size /= 2
            if size < 1e-9:
                return Minimum(x, v, used, True)
        moved, turned = y - x, k - g
        if (along := float(moved @ turned)) > 1e-10 * float(np.linalg.norm(moved) * np.linalg.norm(turned)):
            if not scaled:
                bend, scaled = np.eye(len(x)) * along / float(turned @ turned), True
            left = np.eye(len(x)) - np.outer(moved, turned) / along
            bend = left @ bend @ left.T + np.outer(moved, moved) / along
        x, v, g = y, w, k
    return Minimum(x, v, rounds, False)


def slopes(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """Central differences of a cheap vector function: row i has the changes along x[i]."""
    return np.array([(f(x + d) - f(x - d)) / (2 * step) for d in step * np.eye(len(x))])


def first_order(u: np.ndarray, beta: float, start: float) -> np.ndarray:
    """y[t] = u[t] + beta * y[t - 1], y[-1] = start, along the last axis: blocks by one triangular
    product, then a short pass over the block ends."""
    n = u.shape[-1]
    m = -(-n // BLOCK)
    k = np.arange(BLOCK)
    lag = k[:, None] - k[None, :]
    weight = np.where(lag >= 0, beta ** np.maximum(lag, 0), 0.0)
    padded = np.zeros((*u.shape[:-1], m * BLOCK))
    padded[..., :n] = u
    part = padded.reshape(*u.shape[:-1], m, BLOCK) @ weight.T
    decay, carry = beta ** (k + 1.0), np.full(u.shape[:-1], start)
    for i in range(m):
        part[..., i, :] += carry[..., None] * decay
        carry = part[..., i, -1]
    return part.reshape(*u.shape[:-1], m * BLOCK)[..., :n]


def second_order(u: np.ndarray, a: float, b: float, before: tuple[float, float]) -> np.ndarray:
    """y[t] = u[t] - a * y[t - 1] - b * y[t - 2], before = (y[-1], y[-2]); blocks as in first_order."""
    n = len(u)
    m = -(-n // BLOCK)
    h = np.empty(BLOCK + 1)
    h[0], h[1] = 1.0, -a
    for k in range(2, BLOCK + 1):
        h[k] = -a * h[k - 1] - b * h[k - 2]
    k = np.arange(BLOCK)
    lag = k[:, None] - k[None, :]
    weight = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)
    part = np.pad(u, (0, m * BLOCK - n)).reshape(m, BLOCK) @ weight.T
    one, two = h[1:], -b * h[:-1]
    y1, y2 = before
    for i in range(m):
        part[i] += one * y1 + two * y2
        y1, y2 = part[i, -1], part[i, -2]
    return part.reshape(-1)[:n]


def chain(start: np.ndarray, transition: np.ndarray, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state probabilities and scales of a hidden Markov chain (T x K emissions).

    A parallel scan: products of step matrices inside blocks are taken for all blocks at once,
    normalised as they grow; then states are passed over the block ends and spread inside.
    """
    t, k = emission.shape
    m = -(-t // BLOCK)
    e = np.ones((m * BLOCK, k))
    e[:t] = emission
    steps = transition[None] * e[:, None, :]
    steps[0] = e[0][None, :]  # the first day has no transition: any start reaches its emissions
    steps = steps.reshape(m, BLOCK, k, k)
    product = np.empty_like(steps)
    run = steps[:, 0]
    product[:, 0] = run / np.maximum(run.sum((1, 2), keepdims=True), 1e-300)
    for i in range(1, BLOCK):
        run = product[:, i - 1] @ steps[:, i]
        product[:, i] = run / np.maximum(run.sum((1, 2), keepdims=True), 1e-300)
    state = np.empty((m, BLOCK, k))
    at = start
    for i in range(m):
        own = product[i]
        if i == 0:
            # Day 0 multiplies the start by its emissions state by state.
            own = own.copy()
            first = np.diag(e[0])
            rest = np.empty_like(own)
            rest[0] = first
            for j in range(1, BLOCK):
                rest[j] = rest[j - 1] @ steps[0, j]
                rest[j] /= max(rest[j].sum(), 1e-300)
            own = rest
        here = at @ own
        state[i] = here / np.maximum(here.sum(1, keepdims=True), 1e-300)
        at = state[i, -1]
    filtered = state.reshape(-1, k)[:t]
    predicted = np.vstack([start, filtered[:-1] @ transition])
    return filtered, np.maximum((predicted * emission).sum(1), 1e-300)


def generator(seed: int, *parts: object) -> np.random.Generator:
    """Random numbers that depend on what they are for, not on where they are drawn."""
    return np.random.default_rng(np.random.SeedSequence([seed, *(zlib.crc32(str(p).encode()) for p in parts)]))
