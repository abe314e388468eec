"""Nonlinear least squares with bounds: each trial point is one pass that sums J'WJ, J'Wr and the cost."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.matrix import sum_arrays
from lodestone.operators.params import Configured, Param


class StopFit(Exception):
    """Raised by a callback to end the fit."""


class NonlinearLeastSquares(Configured):
    """Minimises 1/2 |r(x)|^2_W + sigma/p |x|^p. Callbacks get (x, columns), columns a dict of numpy arrays.

    residuals returns one value a row; jacobian (rows, coefficients), or it is taken by finite
    differences; hessian the sum over rows of r_i times the second derivatives of r_i (used by the
    newton-type models). Steps are damped: the damping is the trust region's multiplier."""

    PARAMS = {
        "n_coef": Param(1, 1), "lower_bounds": Param(None), "upper_bounds": Param(None),
        "model": Param("hybrid", words=("gauss-newton", "quasi-newton", "hybrid", "tensor-newton")),
        "method": Param("more-sorensen", words=("more-sorensen", "powell-dogleg", "linear solver"), inert="every step is a damped Gauss-Newton step"),
        "glob_strategy": Param("tr", words=("tr", "trust-region", "reg", "regularization"), inert="steps are damped until they descend"), "reg_term": Param(0.0, 0), "reg_power": Param("quadratic", words=("quadratic", "cubic")),
        "check_derivatives": Param("no", words=("no", "yes")), "derivative_test_tol": Param(1e-4, 0, 10, open_low=True), "fd_step": Param(1e-7, 0, 10, open_low=True),
        "max_iter": Param(100, 1), "abs_gtol": Param(1e-5, 0), "gtol": Param(1e-8, 0), "abs_ftol": Param(1e-8, 0), "ftol": Param(1e-8, 0), "xtol": Param(2.0**-53, 0),
        "verbose": Param(0, 0, 5), "check_data": Param(False, kind=bool),
    }

    def fit(self, df: DataFrame, columns: list[str], x0, residuals: Callable, jacobian: Callable | None = None, hessian: Callable | None = None, weight: str | None = None) -> NonlinearLeastSquares:
        p, h = self.n_coef, self.fd_step
        low = np.full(p, -np.inf) if self.lower_bounds is None else np.asarray(self.lower_bounds, float)
        high = np.full(p, np.inf) if self.upper_bounds is None else np.asarray(self.upper_bounds, float)
        if len(low) != p or len(high) != p or (low > high).any():
            raise ValueError("bounds must be n_coef pairs with lower <= upper")
        data = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("__w"))
        second = hessian if hessian is not None and self.model in ("quasi-newton", "hybrid", "tensor-newton") else None
        self.n_eval = 0

        def differences(x, cols):
            r = residuals(x, cols)
            out = np.empty((len(r), p))
            for k in range(p):
                y = x.copy()
                step = h * max(1.0, abs(x[k]))
                y[k] += step if x[k] + step <= high[k] else -step
                out[:, k] = (residuals(y, cols) - r) / (y[k] - x[k])
            return out

        def at(x, check=False):
            def run(batches):
                total = np.zeros(p * p + p + 2)
                for b in batches:
                    if not len(b):
                        continue
                    cols = {c: b.column(i).to_numpy() for i, c in enumerate(columns)}
                    w = b.column(len(columns)).to_numpy()
                    r = np.asarray(residuals(x, cols), float)
                    j = np.asarray(jacobian(x, cols), float) if jacobian else differences(x, cols)
                    hess = (j * w[:, None]).T @ j
                    if second is not None:
                        hess = hess + np.asarray(second(x, cols, r * w), float)
                    bad = float(np.abs(j - differences(x, cols)).max() / max(1.0, np.abs(j).max())) if check and jacobian else 0.0
                    total[: p * p] += hess.ravel()
                    total[p * p : -2] += j.T @ (w * r)
                    total[-2] += (w * r * r).sum() / 2
                    total[-1] = max(total[-1], bad)
                return total

            v = sum_arrays(data, run, largest_last=1)
            self.n_eval += 1
            power = 2 if self.reg_power == "quadratic" else 3
            size, s = np.linalg.norm(x), self.reg_term
            value, g, hs = v[-2] + s / power * size**power, v[p * p : -2] + s * size ** (power - 2) * x, v[: p * p].reshape(p, p) + s * size ** (power - 2) * np.eye(p)
            return value, g, hs, v[-1]

        x = np.clip(np.asarray(x0, float), low, high)
        value, g, hs, bad = at(x, self.check_derivatives == "yes")
        if bad > self.derivative_test_tol:
            raise ArithmeticError(f"the Jacobian differs from finite differences by {bad:.2g}")
        free = lambda x, g: ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        first, damp = np.abs(np.where(free(x, g), g, 0)).max(initial=0), 1e-3
        for self.n_iter in range(1, self.max_iter + 1):
            f = free(x, g)
            size = np.abs(np.where(f, g, 0)).max(initial=0)
            if size <= max(self.abs_gtol * 1e-3, self.gtol * first) or value <= self.abs_ftol**2:
                break
            while True:
                a = hs[np.ix_(f, f)]
                step = np.zeros(p)
                step[f] = -np.linalg.lstsq(a + damp * np.diag(np.maximum(np.abs(np.diag(a)), 1e-12)), g[f], rcond=None)[0]
                new = np.clip(x + step, low, high)
                moved = np.linalg.norm(new - x)
                if moved <= self.xtol * max(1.0, np.linalg.norm(x)) or damp > 1e20:
                    break
                trial = at(new)
                if trial[0] < value:
                    break
                damp *= 4
            if moved <= self.xtol * max(1.0, np.linalg.norm(x)) or damp > 1e20:
                break
            gain, x, damp = value - trial[0], new, max(damp / 5, 1e-15)
            value, g, hs, _ = trial
            if gain <= self.ftol**2 * value:
                break
        else:
            warnings.warn("the fit stopped at max_iter", UserWarning, stacklevel=2)
        self.x, self.objective, self.gradient_norm, self.fitted = x, float(value), float(np.abs(np.where(free(x, g), g, 0)).max(initial=0)), True
        return self
