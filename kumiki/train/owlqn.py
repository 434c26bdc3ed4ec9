"""Minimising a smooth loss with an L1 penalty: limited-memory quasi-Newton steps that stay in an orthant."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pairs of steps and gradient changes that shape the next step; step sizes tried; decrease asked of a step against the slope.
MEMORY, TRIES, DECREASE = 10, 25, 1e-4


def pseudo_gradient(w: np.ndarray, g: np.ndarray, l1: float) -> np.ndarray:
    """The gradient of loss + l1 |w|; where w is 0, the one-sided slope along which it falls, or 0 if it falls along none."""
    at_zero = np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))
    return np.where(w != 0, g + l1 * np.sign(w), at_zero)


def _direction(slope: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """The inverse curvature that the last steps showed, times the slope."""
    q, kept = slope.copy(), []
    for s, y in zip(reversed(steps), reversed(changes)):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, reversed(kept)):
        q += s * (a - (y @ q) / (s @ y))
    return q


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, l1: float, max_iter: int, tolerance: float = 1e-4) -> tuple[np.ndarray, int]:
    """(weights, evaluations of ``loss``), which gives a value and its gradient.

    A step is tried at full length, then at halves, until the penalised loss falls by a share of what the slope
    promises; weights that would change sign stop at 0.  Ends when no slope is above
    ``tolerance`` times the largest at the start, when no step helps, or after ``max_iter`` steps.
    """
    value, g = loss(w)
    passes, steps, changes = 1, [], []
    slope = pseudo_gradient(w, g, l1)
    enough = tolerance * max(1.0, float(np.abs(slope).max(initial=0.0)))
    for _ in range(max_iter):
        if np.abs(slope).max(initial=0.0) <= enough:
            break
        d = -_direction(slope, steps, changes)
        d[d * slope >= 0] = 0.0
        orthant = np.where(w != 0, np.sign(w), np.sign(-slope))
        size, now = (1.0 if steps else min(1.0, 1.0 / np.linalg.norm(d))), value + l1 * np.abs(w).sum()
        for _ in range(TRIES):
            new = w + size * d
            new[new * orthant < 0] = 0.0
            got, gradient = loss(new)
            passes += 1
            if got + l1 * np.abs(new).sum() <= now + DECREASE * (slope @ (new - w)):
                break
            size /= 2
        else:
            break
        s, y = new - w, gradient - g
        if s @ y > 1e-12:
            steps, changes = [*steps, s][-MEMORY:], [*changes, y][-MEMORY:]
        w, value, g = new, got, gradient
        slope = pseudo_gradient(w, g, l1)
    return w, passes
