"""Small optimisers on the driver; what they minimise is evaluated by distributed aggregations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def lbfgs(fn: Callable, x: np.ndarray, max_iter: int = 1000, tol: float = 1e-8, memory: int = 11, low=None, high=None) -> tuple[np.ndarray, float, np.ndarray, int]:
    """Limited-memory quasi-Newton with projection onto bounds; fn gives value and gradient.

    Returns the point, value, gradient and number of iterations."""
    clip = lambda v: v if low is None and high is None else np.clip(v, -np.inf if low is None else low, np.inf if high is None else high)
    x = clip(np.asarray(x, float))
    value, grad = fn(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for it in range(1, max_iter + 1):
        free = np.ones(len(x), bool)
        if low is not None:
            free &= ~((x <= low) & (grad > 0))
        if high is not None:
            free &= ~((x >= high) & (grad < 0))
        g = np.where(free, grad, 0)
        if np.abs(g).max(initial=0) <= tol:
            return x, value, grad, it - 1
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - y @ q / (y @ s))
        step = np.where(free, -q, 0)
        if step @ g >= 0:
            step = -g
        rate = 1.0 if pairs else min(1.0, 1.0 / max(np.linalg.norm(g), 1e-300))
        for _ in range(50):
            new = clip(x + rate * step)
            new_value, new_grad = fn(new)
            if new_value <= value + 1e-4 * (grad @ (new - x)):
                break
            rate *= 0.5
        else:
            return x, value, grad, it
        s, y = new - x, new_grad - grad
        if s @ y > 1e-14 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        small = abs(value - new_value) <= 1e-15 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if small:
            return x, value, grad, it
    return x, value, grad, max_iter


def elastic_net(g: np.ndarray, b: np.ndarray, yy: float, n: int, lam: float, alpha: float, start=None, tol: float = 1e-4, gap_tol: float = 1e-4, max_iter: int = 10000):
    """Coordinate descent on g = X'X, b = X'y for 1/(2n) |y - X w|^2 + lam (alpha |w|_1 + (1 - alpha)/2 |w|^2).

    A sweep visits the coordinates that still move; every full sweep is followed by the duality gap."""
    p = len(b)
    w = np.zeros(p) if start is None else np.array(start, float)
    l1, l2 = n * lam * alpha, n * lam * (1 - alpha)
    left = b - g @ w
    active = range(p)
    gap = np.inf
    for it in range(1, max_iter + 1):
        biggest = 0.0
        for k in active:
            old = w[k]
            if g[k, k] + l2 == 0:
                w[k] = 0.0
                continue
            z = left[k] + g[k, k] * old
            w[k] = np.sign(z) * max(abs(z) - l1, 0.0) / (g[k, k] + l2)
            if w[k] != old:
                left -= g[:, k] * (w[k] - old)
                biggest = max(biggest, abs(w[k] - old))
        if biggest <= tol * max(np.abs(w).max(initial=0), 1e-300) * 1e-2 or biggest == 0:
            if len(active) == p:
                rr, ry = yy - 2 * w @ b + w @ g @ w, yy - w @ b
                dual = left - l2 * w
                top = np.abs(dual).max(initial=0)
                c = l1 / top if top > l1 else 1.0
                gap = (0.5 * rr * (1 + c * c) if top > l1 else rr) + l1 * np.abs(w).sum() - c * ry + 0.5 * l2 * (1 + c * c) * (w @ w)
                if gap <= gap_tol * yy or biggest == 0:
                    return w, it, gap
                tol *= 0.1
            active = range(p)
        else:
            active = np.flatnonzero(w).tolist() if len(active) == p and np.any(w) else range(p)
    return w, max_iter, gap
