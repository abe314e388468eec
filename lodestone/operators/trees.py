"""Decision trees and random forests for classification, grown level by level.

Every level is one pass: each partition drops its rows through the trees grown so far and counts
classes per (tree, node, feature, bin); the counts are summed in a distributed aggregation, and
one row per node, its best split, reaches the driver. Bins are cut halfway between the distinct
values of a feature (exact), or at its quantiles (histogram).

Forests grow all trees together. A row's weight in a tree is a Poisson draw from a hash of seed, tree
and row id: the bootstrap of an unordered, distributed table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.matrix import to_numpy
from lodestone.operators.params import Configured, Param

YES = Param(False, kind=bool)
#: Distinct values of a feature that exact splits are found among.
EXACT_VALUES = 65535


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Of the last axis: gini, entropy (base 2) or misclassification."""
    n = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(n, 1e-300)
    if criterion == "gini":
        return 1 - (p * p).sum(-1)
    if criterion in ("entropy", "cross-entropy"):
        return -np.where(p > 1e-5, p * np.log2(np.maximum(p, 1e-300)), 0).sum(-1)
    return 1 - p.max(-1)


def _hash(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for ids."""
    x = ids.astype(np.uint64)
    for s in salt:
        x = (x ^ np.uint64(s & (1 << 63) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)) / float(1 << 53)


class _Forest(Configured):
    CRITERIA = ("gini", "entropy", "cross-entropy", "misclass", "misclassification", "misclassification-error")

    def _trees(self) -> int:
        return 1

    def _features(self, p: int) -> int:
        return p

    def _weights(self, ids: np.ndarray, tree: int) -> np.ndarray:
        return np.ones(len(ids))

    def fit(self, df: DataFrame, label: str = "label"):
        """df: id, an array x and an integer class 0 to K-1."""
        data = df.select(F.col("id").cast("long"), F.col("x").cast("array<double>"), F.col(label).cast("int").alias("y"))
        first = data.agg(F.count("*"), F.max("y"), F.min("y"), F.max(F.size("x")), F.min(F.size("x"))).first()
        n, top, low, p, q = first
        if not n or low is None or low < 0 or p != q:
            raise ValueError("training needs rows of one length with classes 0 to K-1")
        self.n_samples, self.n_class, self.n_features = n, top + 1, p
        self._cuts = self._bins(data, p)
        self._seed = self.seed if self.seed >= 0 else 0
        trees = self._trees()
        # nodes of each tree: feature (-1: leaf), threshold, left child, one-vs-all flag, class counts
        self.nodes = [[[-1, 0.0, -1, 0, None]] for _ in range(trees)]
        frontier = {(t, 0) for t in range(trees)}
        for depth in range(self.max_depth + 1):
            if not frontier:
                break
            frontier = self._level(data, frontier, depth)
        self.depth = max(map(self._depth, range(trees)))
        self.fitted = True
        return self

    def _bins(self, data: DataFrame, p: int) -> list[np.ndarray]:
        """Cut points of each feature; a value belongs to the first bin whose cut is not below it."""
        long = data.select(F.posexplode("x").alias("f", "v"))
        if self.histogram:
            share = [i / self.maximum_bins for i in range(1, self.maximum_bins)]
            rows = long.groupBy("f").agg(F.percentile_approx("v", share, 10000).alias("c")).collect()
            return [np.unique(next(r.c for r in rows if r.f == f)) for f in range(p)]
        distinct = long.distinct()
        sizes = {r.f: r.n for r in distinct.groupBy("f").agg(F.count("*").alias("n")).collect()}
        if max(sizes.values()) > EXACT_VALUES:
            raise ValueError(f"a feature has {max(sizes.values())} distinct values: use histogram=True above {EXACT_VALUES}")
        # sorted in tasks; at most EXACT_VALUES a feature
        found = distinct.groupBy("f").agg(F.sort_array(F.collect_list("v")).alias("v")).toArrow()
        values = dict(zip(found.column("f").to_pylist(), found.column("v").combine_chunks(), strict=True))
        out = []
        self._categories = [None] * p
        for f in range(p):
            v = values[f].values.to_numpy()
            if getattr(self, "detect_categorical_data", False) and len(v) <= self.max_category and (np.abs(v - np.rint(v)) <= self.category_tolerance).all():
                self._categories[f] = v
            wide = np.diff(v) >= self.feat_thresh
            out.append(((v[:-1] + v[1:]) / 2)[wide])
        return out

    def _place(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row reaches."""
        nodes = self.nodes[tree]
        feature = np.array([m[0] for m in nodes])
        cut, left, exact = np.array([m[1] for m in nodes]), np.array([m[2] for m in nodes]), np.array([m[3] for m in nodes])
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            go = f >= 0
            if not go.any():
                return at
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            right = np.where(exact[at] == 1, v != cut[at], v > cut[at])
            at = np.where(go, left[at] + right, at)

    def _tried(self, tree: int, node: int, p: int) -> np.ndarray:
        """Features that are tried at a node, in a seeded order if not all."""
        m = self._features(p)
        return np.arange(p) if m >= p else np.sort(np.argsort(_hash(np.arange(p), self._seed + 1, tree, node), kind="stable")[:m])

    def _level(self, data: DataFrame, frontier: set, depth: int) -> set:
        p, k, cuts = self.n_features, self.n_class, self._cuts
        width = max((len(c) for c in cuts), default=0) + 1
        wanted = {t: sorted(node for u, node in frontier if u == t) for t in {t for t, _ in frontier}}
        tried = {(t, m): self._tried(t, m, p) for t, nodes in wanted.items() for m in nodes}
        place, weights, bound = self._place, self._weights, 1 << 20

        def run(batches):
            total: dict[tuple[int, int], float] = {}

            def out():
                key = np.array(list(total), np.int64).reshape(-1, 2)
                rows = pa.RecordBatch.from_pydict({"nf": key[:, 0].copy(), "cell": key[:, 1].copy(), "n": np.fromiter(total.values(), float, len(total))})
                total.clear()
                return rows

            for b in batches:
                if not len(b):
                    continue
                ids, x, y = b.column(0).to_numpy(), to_numpy(b.column(1)), b.column(2).to_numpy().astype(np.int64)
                binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
                for t, nodes in wanted.items():
                    w = weights(ids, t)
                    at = np.searchsorted(nodes, node := place(x, t))
                    at = np.minimum(at, len(nodes) - 1)
                    mine = (np.array(nodes)[at] == node) & (w > 0)
                    for j in np.unique(at[mine]).tolist():
                        rows = np.flatnonzero(mine & (at == j))
                        for f in tried[t, nodes[j]].tolist():
                            cell = binned[rows, f] * k + y[rows]
                            sums = np.bincount(cell, weights=w[rows])
                            nf = (t * (1 << 24) + nodes[j]) * p + f
                            for c in np.flatnonzero(sums).tolist():
                                total[nf, c] = total.get((nf, c), 0.0) + sums[c]
                    if len(total) > bound:
                        yield out()
            if total:
                yield out()

        # nf: a feature of a node of a tree; cell: a bin of it and a class
        counts = data.mapInArrow(run, "nf long, cell long, n double").groupBy("nf", "cell").agg(F.sum("n").alias("n"))
        choose = self._best
        schema = "tree long, node long, feature int, threshold double, exact int, gain double, counts array<double>, left array<double>"

        def best(batches):
            frames = [b for b in batches if len(b)]
            if not frames:
                return
            nf = np.concatenate([b.column(0).to_numpy() for b in frames])
            cell = np.concatenate([b.column(1).to_numpy() for b in frames])
            num = np.concatenate([b.column(2).to_numpy() for b in frames])
            order = np.argsort(nf, kind="stable")
            nf, cell, num = nf[order], cell[order], num[order]
            edge = np.flatnonzero(np.concatenate(([True], nf[1:] != nf[:-1])))
            rows = []
            for lo, hi in zip(edge, np.append(edge[1:], len(nf)), strict=True):
                table = np.zeros(width * k)
                table[cell[lo:hi]] = num[lo:hi]
                node, f = divmod(int(nf[lo]), p)
                rows.append((node >> 24, node & (1 << 24) - 1, f, *choose(table.reshape(width, k), f)))
            names = ("tree", "node", "feature", "threshold", "exact", "gain", "counts", "left")
            types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))

        # a group is one feature of one node: at most as many rows as bins times classes
        found = counts.repartition("nf").mapInArrow(best, schema)
        splits = found.groupBy("tree", "node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "threshold", "exact", "counts", "left")).alias("s")).collect()
        new = set()
        for r in sorted(splits, key=lambda r: (r.tree, r.node)):
            node = self.nodes[r.tree][r.node]
            counts_, left = np.array(r.s.counts), np.array(r.s.left)
            node[4] = counts_.tolist()
            total = self.nodes[r.tree][0][4]
            score = float(impurity(counts_, self.criterion))
            gain = -r.s.g
            if depth >= self.max_depth or gain <= 0 or counts_.sum() < 2 * self._least() or score <= self.min_split_score:
                continue
            if counts_.sum() / sum(total) * gain <= self.min_impurity_decrease:
                continue
            at = len(self.nodes[r.tree])
            node[:4] = [r.s.feature, r.s.threshold, at, r.s.exact]
            for side, c in enumerate((left, counts_ - left)):
                self.nodes[r.tree].append([-1, 0.0, -1, 0, c.tolist()])
                if depth + 1 <= self.max_depth and impurity(c, self.criterion) > self.min_split_score:
                    new.add((r.tree, at + side))
        return new

    def _least(self) -> int:
        return max(1, self.min_samples_split // 2)

    def _best(self, table: np.ndarray, f: int):
        """Threshold, one-vs-all flag, gain of impurity, class counts and those of the left child; rows of table are bins."""
        counts = table.sum(0)
        n, score = counts.sum(), impurity(counts, self.criterion)
        categories = getattr(self, "_categories", [None] * (f + 1))
        values = categories[f] if categories[f] is not None and self.category_split_strategy == "one-vs-all" else None
        left = table[: len(values)] if values is not None else np.cumsum(table, 0)[: len(self._cuts[f])]
        if not len(left):
            return 0.0, 0, -1.0, counts.tolist(), counts.tolist()
        a = left.sum(1)
        children = (a * impurity(left, self.criterion) + (n - a) * impurity(counts - left, self.criterion)) / n
        least = self._least()
        children = np.where((a >= least) & (n - a >= least), children, np.inf)
        i = int(np.argmin(np.round(children, 14)))
        gain = float(score - children[i])
        if not np.isfinite(gain) or gain <= 1e-14:
            return 0.0, 0, -1.0, counts.tolist(), counts.tolist()
        return float(values[i] if values is not None else self._cuts[f][i]), int(values is not None), gain, counts.tolist(), left[i].tolist()

    def _depth(self, tree: int) -> int:
        nodes, deep = self.nodes[tree], {0: 0}
        for i, m in enumerate(nodes):
            if m[0] >= 0:
                deep[m[2]] = deep[m[2] + 1] = deep[i] + 1
        return max(deep.values())

    @property
    def n_nodes(self) -> int:
        return sum(map(len, self.nodes))

    @property
    def n_leaves(self) -> int:
        return sum(m[0] < 0 for t in self.nodes for m in t)

    # use

    def _tables(self):
        probs = [np.array([np.array(m[4]) / max(sum(m[4]), 1e-300) for m in t]) for t in self.nodes]
        return probs, [p.argmax(1) for p in probs]

    def _mapped(self, df: DataFrame, columns: dict) -> DataFrame:
        """Adds columns that are computed from the rows' leaves."""
        from pyspark.sql import types as T

        self.need_fit()
        place, (probs, votes), at = self._place, self._tables(), df.columns.index("x")
        kind = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, (t, _) in columns.items())])

        def run(batches):
            for b in batches:
                if len(b):
                    x = to_numpy(b.column(at).cast(pa.list_(pa.float64())))
                    leaves = [place(x, t) for t in range(len(probs))]
                    out = [fn(leaves, probs, votes) for _, fn in columns.values()]
                    yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *columns])

        return df.mapInArrow(run, kind)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the class of the leaf; a forest votes (one vote a tree, the smaller class of a tie)."""
        from pyspark.sql import types as T

        k = self.n_class

        def fn(leaves, probs, votes):
            n = np.zeros((len(leaves[0]), k))
            for leaf, v in zip(leaves, votes, strict=True):
                n[np.arange(len(n)), v[leaf]] += 1
            return pa.array(n.argmax(1).astype(np.int32))

        return self._mapped(df, {name: (T.IntegerType(), fn)})

    def predict_proba(self, df: DataFrame, name: str = "proba", log: bool = False) -> DataFrame:
        """Adds the class probabilities, the mean over the trees."""
        from pyspark.sql import types as T

        def fn(leaves, probs, votes):
            p = np.mean([q[leaf] for leaf, q in zip(leaves, probs, strict=True)], axis=0)
            if log:
                with np.errstate(divide="ignore"):
                    p = np.log(p)
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            return pa.ListArray.from_arrays(ends, pa.array(p.ravel()))

        return self._mapped(df, {name: (T.ArrayType(T.DoubleType()), fn)})

    def predict_log_proba(self, df: DataFrame, name: str = "log_proba") -> DataFrame:
        return self.predict_proba(df, name, log=True)

    def score(self, df: DataFrame, label: str = "label") -> float:
        return self.predict(df, "__p").agg(F.avg((F.col("__p") == F.col(label)).cast("double"))).first()[0]

    def case_expression(self, tree: int = 0) -> F.Column:
        """The tree's class as nested CASE expressions over x, for plans without Python."""
        self.need_fit()
        nodes, votes = self.nodes[tree], self._tables()[1][tree]

        def build(i):
            f, cut, left, exact, _ = nodes[i]
            if f < 0:
                return F.lit(int(votes[i]))
            v = F.element_at(F.col("x").cast("array<double>"), f + 1)
            return F.when(v == cut if exact else v <= cut, build(left)).otherwise(build(left + 1))

        return build(0)


_COMMON = {
    "criterion": Param("gini", words=_Forest.CRITERIA), "seed": Param(-1, -1), "max_depth": Param(29, 0, 29), "min_samples_split": Param(2, 1), "max_features": Param(0, 0),
    "min_impurity_decrease": Param(0.0, 0), "min_split_score": Param(0.0, 0, 1), "histogram": YES, "maximum_bins": Param(256, 2, 65535),
    "category_split_strategy": Param("ordered", words=("ordered", "one-vs-all")), "check_data": YES,
}


class DecisionTree(_Forest):
    PARAMS = _COMMON | {
        "feat_thresh": Param(1e-5, 0), "detect_categorical_data": YES, "max_category": Param(50, 2), "category_tolerance": Param(1e-5, 0, 1), "predict_proba": Param(True, kind=bool),
    }

    def __init__(self, **options):
        super().__init__(**options)
        self._keep_proba = self.__dict__.pop("predict_proba")

    def get_params(self) -> dict:
        return {n: getattr(self, n) if n != "predict_proba" else self._keep_proba for n in self.PARAMS}

    def _features(self, p: int) -> int:
        return self.max_features or p


class RandomForest(_Forest):
    PARAMS = _COMMON | {
        "n_trees": Param(100, 1), "bootstrap": Param(True, kind=bool), "features_selection": Param("sqrt", words=("sqrt", "log2", "all", "proportion", "custom")),
        "proportion_features": Param(0.1, 0, 1, open_low=True), "samples_factor": Param(1.0, 0, 1, open_low=True), "feat_thresh": Param(1e-6, 0), "block_size": Param(256, 1), "max_tree_threads": Param(0, 0),
    }

    def _trees(self) -> int:
        return self.n_trees

    def _features(self, p: int) -> int:
        m = {
            "sqrt": math.ceil(p**0.5), "log2": math.ceil(math.log2(p)) if p > 1 else 1, "all": p,
            "proportion": math.ceil(self.proportion_features * p), "custom": self.max_features or p,
        }[self.features_selection]
        return max(1, min(m, p))

    def _weights(self, ids: np.ndarray, tree: int) -> np.ndarray:
        if not self.bootstrap:
            return np.ones(len(ids))
        u, out, term, total, k = _hash(ids, self._seed + 7, tree + 1), np.zeros(len(ids)), math.exp(-self.samples_factor), 0.0, 0
        while k < 30:
            total += term
            out += u >= total
            k += 1
            term *= self.samples_factor / k
        return out
