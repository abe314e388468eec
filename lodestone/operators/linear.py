"""Linear models: least squares, ridge, lasso, elastic net and logistic regression.

Least squares of every kind needs one pass for the means and one for the centred cross products; the
solver works on that p x p matrix. Logistic regression makes one pass for each step: Newton's while the
coefficients are at most NEWTON (each task then adds up their matrix), else one of L-BFGS, of which a
task adds up the gradient alone.
The penalty of ridge is lambda/2 |w|^2 beside 1/2 |r|^2, that of lasso and elastic net lambda beside
1/(2n) |r|^2; the intercept is never penalised and is the last coefficient.
"""

from __future__ import annotations

import time
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.matrix import dot, gram, literal, moments, pack, sum_arrays, to_numpy
from lodestone.operators.optim import elastic_net, lbfgs
from lodestone.operators.params import MIXED, Configured, Param

YES = Param(False, kind=bool)
#: Most coefficients of a logistic regression that Newton steps are taken for.
NEWTON = 256


class LinearModel(Configured):
    PARAMS = {
        "mod": Param("mse", words=("mse", "logistic")), "intercept": YES,
        "solver": Param("auto", words=("auto", "bfgs", "lbfgs", "lbfgsb", "cholesky", "chol", "qr", "svd", "cg", "sparse_cg", "coord")),
        "scaling": Param("auto", words=("auto", "none", "no", "centering", "scale", "scale only", "standardize", "standardise")),
        "max_iter": Param(10000, 1), "constraint": Param("ssc", words=("ssc", "symmetric", "symmetric side", "rsc", "reference category")),
        "reg_lambda": Param(0.0, 0), "reg_alpha": Param(0.0, 0, 1), "warm_start": YES, "tol": Param(1e-4, 0, 1), "dual_gap_tol": Param(1e-4, 0), "progress_factor": Param(None),
        "mixed_precision": MIXED, "check_data": YES,
    }

    def _solver(self) -> str:
        s = self.solver
        if self.mod == "logistic":
            if self.reg_alpha > 0 and self.reg_lambda > 0:
                raise ValueError("logistic regression has no L1 penalty")
            if s not in ("auto", "lbfgs", "lbfgsb", "bfgs"):
                raise ValueError("logistic regression is solved by lbfgs")
            return "lbfgs"
        l1 = self.reg_alpha > 0 and self.reg_lambda > 0
        if s == "auto":
            return "coord" if self.reg_alpha > 0 else "cholesky"
        if l1 and s != "coord":
            raise ValueError("an L1 penalty needs the coord solver")
        if s == "qr" and self.reg_lambda > 0:
            raise ValueError("qr takes no penalty")
        return s

    def fit(self, df: DataFrame, features, target: str, start=None) -> LinearModel:
        """features: column names, or the name of an array column."""
        began, solver = time.time(), self._solver()
        df = df.withColumn("__y", F.col(f"`{target}`").cast("double"))
        data = pack(df, features, keep=("__y",)).select("x", F.col("__y").alias("y"))
        if self.warm_start and start is None and getattr(self, "coef", None) is not None:
            start = self.coef
        self._features = features
        if self.mod == "logistic":
            self._fit_logistic(data, start)
        else:
            self._fit_squares(data, solver, start)
        self.time, self.fitted = time.time() - began, True
        return self

    def _fit_squares(self, data: DataFrame, solver: str, start):
        joined = data.select(F.concat("x", F.array("y")).alias("x"))
        n, mean = moments(joined)
        centred = gram(joined, mean)  # cross products about the means
        p = len(mean) - 1
        shift = mean if self.intercept else np.zeros(p + 1)
        c = centred if self.intercept else centred + n * np.outer(mean, mean)
        scale = np.ones(p)
        if self.scaling in ("scale", "scale only", "standardize", "standardise"):
            scale = np.sqrt(np.diag(centred)[:p] / n)
            scale[scale == 0] = 1.0
        g, b, yy = c[:p, :p] / np.outer(scale, scale), c[:p, p] / scale, c[p, p]
        lam, alpha = self.reg_lambda, self.reg_alpha
        self.n_iter, self.dual_gap = 1, None
        if solver == "coord":
            old = None if start is None else np.asarray(start, float)[:p] * scale
            w, self.n_iter, self.dual_gap = elastic_net(g, b, yy, n, lam, alpha, old, self.tol, self.dual_gap_tol, self.max_iter)
            if self.n_iter >= self.max_iter:
                warnings.warn("coordinate descent stopped at max_iter", UserWarning, stacklevel=3)
        else:
            a = g + lam * np.eye(p)
            if solver in ("cholesky", "chol"):
                try:
                    low = np.linalg.cholesky(a)
                    if (np.diag(low) ** 2 <= 1e-12 * np.diag(a)).any():
                        raise np.linalg.LinAlgError
                    w = np.linalg.solve(low.T, np.linalg.solve(low, b))
                except np.linalg.LinAlgError:
                    w = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b  # as the SVD does: least norm
            elif solver in ("cg", "sparse_cg"):
                w, r = np.zeros(p), b.copy()
                d, rr = r.copy(), r @ r
                for self.n_iter in range(1, self.max_iter + 1):
                    if rr <= (1e-12**2) * max(b @ b, 1e-300):
                        break
                    ad = a @ d
                    step = rr / (d @ ad)
                    w, r = w + step * d, r - step * ad
                    rr, old = r @ r, rr
                    d = r + rr / old * d
            elif solver in ("lbfgs", "lbfgsb", "bfgs"):
                size = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
                w, _, _, self.n_iter = lbfgs(lambda v: ((v * size) @ a @ (v * size) / 2 - b @ (v * size), (a @ (v * size) - b) * size), np.zeros(p), self.max_iter, 1e-10)
                w = w * size
            else:  # qr and svd
                w = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
        rss = yy - 2 * w @ b + w @ g @ w
        self.loss = rss / (2 * n) + lam * (alpha * np.abs(w).sum() + (1 - alpha) / 2 * (w @ w))
        self.nrm_gradient_loss = float(np.abs(g @ w - b + (0 if alpha else lam * w)).max(initial=0))
        w = w / scale
        self.coef = np.append(w, shift[p] - shift[:p] @ w) if self.intercept else w
        self.n_samples, self._p = n, p

    # logistic

    def _fit_logistic(self, data: DataFrame, start):
        top, low, whole = data.agg(F.max("y"), F.min("y"), F.min((F.col("y") == F.floor("y")).cast("int"))).first()
        if top is None or low < 0 or not whole:
            raise ValueError("classes must be 0 to K-1")
        k = self.n_class = int(top) + 1
        if k < 2:
            raise ValueError("logistic regression needs two classes")
        rsc = self.constraint in ("rsc", "reference category")
        blocks = 1 if k == 2 else k - 1 if rsc else k
        p = self._p = len(data.select("x").first().x)
        d, use = p + int(self.intercept), self.intercept
        newton = blocks * d <= NEWTON

        def run_for(w):
            def run(batches):
                h, g, value = np.zeros((blocks * d,) * 2 if newton else (0, 0)), np.zeros(blocks * d), 0.0
                for batch in batches:
                    if not len(batch):
                        continue
                    x, y = to_numpy(batch.column(0)), batch.column(1).to_numpy().astype(int)
                    if use:
                        x = np.hstack([x, np.ones((len(x), 1))])
                    z = _scores(x @ w.T, k)
                    m = z.max(1, keepdims=True)
                    e = np.exp(z - m)
                    prob = e / e.sum(1, keepdims=True)
                    value += (m[:, 0] + np.log(e.sum(1)) - z[np.arange(len(y)), y]).sum()
                    hit = y[:, None] == np.arange(k)
                    at = [1] if k == 2 else list(range(blocks))
                    r = (prob - hit)[:, at]
                    g += (r.T @ x).ravel()
                    q = prob[:, at]
                    for a in range(blocks if newton else 0):
                        for c in range(a, blocks):
                            u = q[:, a] * ((a == c) - q[:, c])
                            part = x.T @ (x * u[:, None])
                            h[a * d : (a + 1) * d, c * d : (c + 1) * d] += part
                            if a != c:
                                h[c * d : (c + 1) * d, a * d : (a + 1) * d] += part.T
                return np.concatenate([h.ravel(), g, [value]])

            flat = sum_arrays(data, run)
            size = blocks * d
            return flat[: -size - 1].reshape((size, size) if newton else (0, 0)), flat[-size - 1 : -1], flat[-1]

        lam = self.reg_lambda
        mask = np.tile(np.append(np.ones(p), np.zeros(d - p)), blocks)
        w = np.zeros((blocks, d)) if start is None else np.asarray(start, float).reshape(blocks, d)

        def at(v):
            h, g, value = run_for(v.reshape(blocks, d))
            return value + lam / 2 * (mask * v) @ v, g + lam * mask * v, h + lam * np.diag(mask) if newton else None

        v = w.ravel()
        if newton:
            value, g, h = at(v)
            for self.n_iter in range(1, self.max_iter + 1):
                if np.abs(g).max() <= self.tol:
                    break
                step, rate = -np.linalg.pinv(h, rcond=1e-10, hermitian=True) @ g, 1.0
                for _ in range(25):
                    new = at(v + rate * step)
                    if new[0] <= value + 1e-4 * rate * (g @ step) + 1e-12 * abs(value):
                        break
                    rate /= 2
                gain, v = value - new[0], v + rate * step
                value, g, h = new
                if gain <= 1e-12 * max(1.0, abs(value)):
                    break
        else:
            v, value, g, self.n_iter = lbfgs(lambda v: at(v)[:2], v, self.max_iter, self.tol)
        if self.n_iter >= self.max_iter and np.abs(g).max() > self.tol:
            warnings.warn("logistic regression stopped at max_iter", UserWarning, stacklevel=4)
        self.coef, self.loss, self.nrm_gradient_loss = v.reshape(blocks, d), float(value), float(np.abs(g).max())
        self.dual_gap = None

    # use

    def _x(self, features=None):
        f = features if features is not None else self._features
        return F.col(f"`{f}`").cast("array<double>") if isinstance(f, str) else F.array(*(F.col(f"`{c}`").cast("double") for c in f))

    def predict(self, df: DataFrame, features=None, name: str = "prediction") -> DataFrame:
        """Adds the fitted value, or the class."""
        self.need_fit()
        x = self._x(features)
        if self.mod == "mse":
            y = dot(x, literal(self.coef[: self._p]))
            return df.withColumn(name, y + float(self.coef[-1]) if self.intercept else y)
        x = F.concat(x, F.array(F.lit(1.0))) if self.intercept else x
        scores = [dot(x, literal(w)) for w in self.coef]
        if self.n_class == 2:
            return df.withColumn(name, (scores[0] > 0).cast("int"))
        z = F.array(*scores, *([F.lit(0.0)] if len(self.coef) < self.n_class else []))
        return df.withColumn(name, (F.array_position(z, F.array_max(z)) - 1).cast("int"))

    def evaluate(self, df: DataFrame, target: str, features=None) -> DataFrame:
        """One row: for least squares loss (with penalty), mse and r2; for logistic regression the accuracy."""
        y = F.col(f"`{target}`").cast("double")
        found = self.predict(df, features, "__f").select(y.alias("y"), F.col("__f").cast("double").alias("f"))
        if self.mod == "logistic":
            return found.agg(F.avg((F.col("y") == F.col("f")).cast("double")).alias("accuracy"))
        w = self.coef[: self._p]
        penalty = self.reg_lambda * (self.reg_alpha * np.abs(w).sum() + (1 - self.reg_alpha) / 2 * (w @ w))
        mse = F.avg(F.pow(F.col("y") - F.col("f"), F.lit(2.0)))
        return found.agg(mse.alias("mse"), F.var_pop("y").alias("v")).select((F.col("mse") / 2 + float(penalty)).alias("loss"), "mse", (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))

    def info(self, spark) -> DataFrame:
        self.need_fit()
        return spark.createDataFrame([(float(self.loss), float(self.nrm_gradient_loss), int(self.n_iter), float(self.time))], "loss double, nrm_gradient_loss double, n_iter int, time double")


def _scores(z: np.ndarray, k: int) -> np.ndarray:
    """A score for each class: two classes have one block (of class 1), reference coding leaves the last at 0."""
    zero = np.zeros((len(z), 1))
    return np.hstack([zero, z]) if k == 2 else np.hstack([z, zero]) if z.shape[1] < k else z
