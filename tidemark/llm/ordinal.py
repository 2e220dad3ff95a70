"""Cumulative-link ordinal regression on sparse hashed features.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector for all thresholds, which are kept in order by adding
positive steps.  The model is fitted on a bounded sample by full-batch Adam with an L2 penalty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, dims: int, l2: float = 2e-5, rate: float = 0.05, rounds: int = 250, least_rows: int = 4, l1: float = 0.0) -> CumulativeLink:
        """``rows``: each row's distinct feature indices, of value 1. Features in fewer than ``least_rows`` rows get no weight.
        ``l1`` draws weights to zero, by a proximal step, so that words that say nothing have none.

        With no rows, or rows of one grade, the thresholds alone say so."""
        if not len(rows):
            return cls(np.zeros(dims, np.float32), np.arange(1, n_grades, dtype=float))
        grades = np.asarray(grades)
        df = np.bincount(np.concatenate(rows), minlength=dims)
        used = np.flatnonzero(df >= least_rows)
        place = np.full(dims, -1)
        place[used] = np.arange(len(used))
        rows = [p[p >= 0] for p in (place[r] for r in rows)]
        idx, counts = np.concatenate(rows), np.array([len(r) for r in rows])
        row_of = np.repeat(np.arange(len(rows)), counts)
        cum = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
        theta = np.log(cum / (1 - cum))
        steps = np.log(np.diff(theta).clip(1e-2))
        params = np.concatenate([np.zeros(len(used)), theta[:1], steps])
        m, v = np.zeros_like(params), np.zeros_like(params)
        w_n, n = len(used), len(rows)
        lo, hi = grades, grades + 1
        for t in range(1, rounds + 1):
            w, first, steps = params[:w_n], params[w_n], np.exp(params[w_n + 1 :])
            bounds = np.concatenate([[-np.inf, first], first + np.cumsum(steps), [np.inf]])
            s = np.bincount(row_of, weights=w[idx], minlength=n)
            up, low = _sigmoid(bounds[hi] - s), _sigmoid(bounds[lo] - s)
            p = (up - low).clip(1e-9)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            g_s = (d_up - d_low) / n  # of minus the log-likelihood
            g_w = np.bincount(idx, weights=g_s[row_of], minlength=w_n) + l2 * w
            g_b = np.zeros(n_grades + 1)
            np.add.at(g_b, hi, -d_up / n)
            np.add.at(g_b, lo, d_low / n)
            g_b = g_b[1:n_grades]
            tail = np.cumsum(g_b[::-1])[::-1]
            g = np.concatenate([g_w, tail[:1], tail[1:] * steps])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            size = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            params = params - size * m / (1 - 0.9**t)
            if l1:
                params[:w_n] = np.sign(params[:w_n]) * np.maximum(np.abs(params[:w_n]) - l1 * size[:w_n], 0)
        weights = np.zeros(dims, np.float32)
        weights[used] = params[:w_n]
        return cls(weights, params[w_n] + np.concatenate([[0], np.cumsum(np.exp(params[w_n + 1 :]))]))

    def tails(self, features: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1; their sum is the expected grade."""
        return _sigmoid(float(self.weights[features].astype(np.float64).sum()) - self.thresholds)
