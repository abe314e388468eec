"""Near-duplicate vectors by cross-polytope hashing.

A hash turns the unit vector by three rounds of random signs and a fast Hadamard transform and
takes the axis (with sign) that lies nearest. `functions` hashes make a bucket of a table; a vector
enters its own bucket and, as multiprobe, in each function whose second axis is nearly as near as
the first (`CLOSE`) also the bucket with that one.

1. Each task merges its entries: a bucket keeps the least vector of the task, the others are tied
   to it. What is left is dealt out by bucket, where the least vector of all is the centre of the
   bucket's star. Only bucket and vector number travel (some 6 bytes an entry), and a bucket that
   holds a third of all vectors brings one entry a batch.
2. The connected components of the stars hold all candidate pairs. With so many functions that
   unlike vectors hardly ever meet, components are little more than groups of near copies.
3. The vectors of components are fetched, once for each distinct one (a bit map of fixed size leaves
   out the rest before anything is shuffled), and compared in blocked cells (cells.py) by cosine in
   double precision. Nothing is capped.

How many functions: the fewest with which a vector is expected to meet at most `CHANCE` others below
the threshold, by the cosines in a sample of at most SAMPLE vectors and the number of all. It
decides how long the operator takes, not what it finds. How many tables: so many that a pair of
exactly the threshold's cosine is missed with probability `miss`, nearer pairs with less; the
chance that one table finds it is measured on made pairs when the plan is drawn up.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing; vectors of different lengths never link; rows with the same id and vector are
copies of each other, rows of one id with different vectors are vectors of their own; a row without
an id links like any other, a class without any id has none, and such rows are kept where their
class has no id; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import cells
from lodestone.llm.common import bit_map, connected_components, map_arrow, marked, stage

#: A second axis is probed if it is at least so near, relative to the first.
CLOSE = 0.9
#: Vectors below the threshold that a vector may be expected to meet.
CHANCE = 0.5
#: Vectors whose cosines tell how alike unlike ones are.
SAMPLE = 1024
#: Most functions of a bucket.
FUNCTIONS = 12
_PIECE = 2048


class CrossPolytope:
    def __init__(self, dim: int, tables: int, functions: int, seed: int):
        self.dim, self.tables, self.functions = dim, tables, functions
        self.size = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (tables * functions, 3, self.size, 1))

    def rotate(self, x: np.ndarray, which: int) -> np.ndarray:
        y = np.zeros((self.size, len(x)), x.dtype)
        y[: self.dim] = x.T
        z = np.empty_like(y)
        for signs in self.signs[which]:
            y *= signs
            half = 1
            while half < self.size:
                a, b = y.reshape(-1, 2, half, len(x)), z.reshape(-1, 2, half, len(x))
                np.add(a[:, 0], a[:, 1], out=b[:, 0])
                np.subtract(a[:, 0], a[:, 1], out=b[:, 1])
                y, z = z, y
                half *= 2
            y *= y.dtype.type(self.size**-0.5)
        return y.T

    def axes(self, x: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest and second nearest axis of each vector, and the second's share of the first.

        Axis i is 2i, its opposite 2i + 1."""
        y = np.ascontiguousarray(self.rotate(x, which))
        value, row = np.abs(y), np.arange(len(x))
        first = value.argmax(1)
        most = value[row, first]
        value[row, first] = -1
        second = value.argmax(1)
        near = np.stack([first, second], 1)
        return near * 2 + (np.take_along_axis(y, near, 1) < 0), value[row, second] / most

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + functions) bucket numbers: the own one, then a probe for each function (or the own one again)."""
        out = np.empty((len(x), self.tables, 1 + self.functions), np.int64)
        for lo in range(0, len(x), _PIECE):
            out[lo : lo + _PIECE] = self._buckets(x[lo : lo + _PIECE])
        return out

    def _buckets(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.tables, 1 + self.functions), np.int64)
        base = np.uint64(2 * self.size)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(self.functions - 1, base | np.uint64(1))), dtype=np.uint64)
            for t in range(self.tables):
                own = np.zeros(len(x), np.uint64)
                moved = np.zeros((len(x), self.functions), np.uint64)
                for f in range(self.functions):
                    axes, close = self.axes(x, t * self.functions + f)
                    axes = axes.astype(np.uint64)
                    own += axes[:, 0] * power[f]
                    moved[:, f] = np.where(close >= CLOSE, (axes[:, 1] - axes[:, 0]) * power[f], np.uint64(0))
                code = np.concatenate([own[:, None], own[:, None] + moved], 1) * np.uint64(self.tables) + np.uint64(t)
                code = (code + np.uint64(self.dim * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                out[:, t] = (code ^ (code >> np.uint64(31))).view(np.int64)
        return out


@lru_cache(maxsize=64)
def meeting(dim: int, cosine: float, seed: int = 11, pairs: int = 1000, functions: int = 6) -> tuple[float, float]:
    """Of one function, for a pair of this cosine: the chance that the first axes agree, and the chance that they
    do not but one's second axis, close enough to be probed, is the other's first."""
    rng = np.random.default_rng([seed, dim])
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    h, same, turned = CrossPolytope(dim, 1, functions, seed), 0.0, 0.0
    for f in range(functions):
        (x, near_x), (y, near_y) = (h.axes(v.astype(np.float32), f) for v in (a, b))
        agree = x[:, 0] == y[:, 0]
        probed = (x[:, 1] == y[:, 0]) & (near_x >= CLOSE) | (y[:, 1] == x[:, 0]) & (near_y >= CLOSE)
        same, turned = same + agree.mean() / functions, turned + (probed & ~agree).mean() / functions
    return max(same, 0.5 / (2 * h.size)), turned


def found_by_a_table(dim: int, cosine: float, functions: int) -> float:
    same, turned = meeting(dim, cosine)
    return same**functions + functions * turned * same ** (functions - 1)


@dataclass(frozen=True)
class Plan:
    tables: int
    functions: int


def plan(dim: int, rows: int, threshold: float = 0.95, miss: float = 1e-4, cosines: np.ndarray | None = None) -> Plan:
    """Tables and functions for so many vectors, of which a sample has these cosines (default: all at right angles)."""
    grid = np.linspace(0, 0.9, 7)
    if cosines is None or not len(cosines):
        share = np.eye(len(grid))[0]
    else:
        below = np.clip(cosines[cosines < threshold], 0, None)
        share = np.bincount(np.minimum(np.ceil(below / (grid[1] - grid[0])).astype(int), len(grid) - 1), minlength=len(grid)) / len(cosines)
    for functions in range(2, FUNCTIONS + 1):
        tables = max(1, int(np.ceil(np.log(miss) / np.log1p(-min(found_by_a_table(dim, threshold, functions), 1 - 1e-9)))))
        met = sum(s * min(1.0, tables * found_by_a_table(dim, float(c), functions)) for s, c in zip(share, grid, strict=True) if s)
        if rows * met <= CHANCE:
            break
    return Plan(tables, functions)


def usable(column: str) -> F.Column:
    """Not null or empty, and all components finite, not all of them zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0)


def _vectors(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_pairs(vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows with a cosine of at least threshold, in double precision."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T
    i, j = np.nonzero(np.triu(near >= threshold - 1e-9, 1))
    sure = near[i, j]
    for k in np.flatnonzero(np.abs(sure - threshold) < 1e-9):  # as the plain formula rounds it
        a, b = vectors[i[k]], vectors[j[k]]
        sure[k] = (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b))
    return i[sure >= threshold], j[sure >= threshold]


def _plans(good: DataFrame, rows: int, threshold: float, miss: float) -> dict[int, Plan]:
    """A plan for each length of vectors in a sample of at most SAMPLE vectors (a fraction of the rows by a hash)."""
    share = min(1.0, 2 * SAMPLE / max(1, rows))
    sample = good.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vector").limit(SAMPLE).toArrow()
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in _vectors(sample.column("vector")) if sample.num_rows else ():
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim, found in by_dim.items():
        x = _units(found)
        out[dim] = plan(dim, rows, threshold, miss, (x @ x.T)[np.triu_indices(len(x), 1)])
    return out


def _entries(plans: dict[int, Plan], rows: int, threshold: float, miss: float, seed: int):
    """Gives the nodes and buckets of the distinct vectors of a batch (node, vector)."""
    hashers: dict[int, CrossPolytope] = {}

    def enter(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        vectors = _vectors(batch.column(1))
        nodes, at = np.unique(batch.column(0).to_numpy(), return_index=True)
        length = np.array([len(vectors[i]) for i in at])
        node, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for dim in np.unique(length).tolist():
            if dim not in hashers:
                how = plans.get(dim) or plan(dim, rows, threshold, miss)
                hashers[dim] = CrossPolytope(dim, how.tables, how.functions, seed)
            ks = np.flatnonzero(length == dim)
            for some in np.split(ks, range(_PIECE, len(ks), _PIECE)):
                found = hashers[dim].buckets(_units([vectors[at[k]] for k in some]).astype(np.float32)).reshape(len(some), -1)
                found.sort(axis=1)
                new = np.ones(found.shape, bool)
                new[:, 1:] = found[:, 1:] != found[:, :-1]
                bucket.append(found[new])
                node.append(np.repeat(nodes[some], new.sum(1)))
        return np.concatenate(node), np.concatenate(bucket)

    return enter


def near_duplicates(
    df: DataFrame, threshold: float = 0.95, miss: float = 1e-4, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", block: int = cells.BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    # float32 inputs travel as float32: the cast to double is exact
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("vector"))
    good = rows.where(usable("vector"))

    def key(batches):
        for b in batches:
            keys = [hashlib.blake2b((v + 0.0).astype(float).tobytes(), digest_size=16).digest() for v in _vectors(b.column(1))]
            yield {"vec_id": b.column(0), "key": keys, "node": np.frombuffer(b"".join(k[:8] for k in keys), np.int64), "vector": b.column(1)}

    keyed = map_arrow(good, key, f"vec_id long, key binary, node long, vector {kind}")
    members = keyed.select("vec_id", "key")
    sets = keyed.groupBy("key", "node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    sets = stage(sets.withColumn("rep", F.monotonically_increasing_id()), "vector-sets")
    n = sets.count()
    plans = _plans(good, n, threshold, miss)
    entries = int(n * max((p.tables * (1 + 0.5 * p.functions) for p in plans.values()), default=1))
    found = cells.stars(keyed.select("node", "vector"), _entries(plans, n, threshold, miss, seed), entries)
    parts = stage(connected_components(found, "vector-candidates", forest=True), "vector-candidate-parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).select("component", cells.blocks("size", block).alias("blocks"))
    wanted = stage(parts.join(sizes, "component").join(sets, "node").withColumn("mark", F.xxhash64("least", "node")), "vector-candidate-sets")
    held = bit_map(wanted, "mark")

    def ask(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(held, batch.column(2).to_numpy())))

    asked = keyed.select("key", "vector", F.xxhash64("vec_id", "node").alias("mark"))
    asked = asked.mapInArrow(ask, asked.schema).drop("mark")
    # repeated rows bring one vector; partitions by key serve the join and the grouping
    full = asked.join(wanted.select("key", "rep", "component", "blocks", "copies"), "key")
    full = full.groupBy("key").agg(*(F.first(c).alias(c) for c in ("rep", "component", "blocks", "copies", "vector")))
    placed = cells.with_cells(full, "rep", "blocks")

    def verify(cell: pa.Table):
        mine, vectors = cell.column("__mine").to_numpy(), _vectors(cell.column("vector"))
        ids, copies = cell.column("rep").to_numpy(), cell.column("copies").to_numpy()
        across = cell.column(1)[0].as_py() != cell.column(2)[0].as_py()
        found = []
        length = np.array([len(v) for v in vectors])
        for dim in np.unique(length):
            at = np.flatnonzero(length == dim)
            x = np.stack([vectors[k] for k in at]).astype(float)
            i, j = near_pairs(x / np.abs(x).max(1, keepdims=True), threshold)
            i, j = at[i], at[j]
            keep = mine[i] != mine[j] if across else np.ones(len(i), bool)
            found.append((i[keep], j[keep]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return cells.linked_rows(ids, copies, i, j) if len(i) else None

    linked = cells.compare(placed, ["component", "__i", "__j"], ["__mine", "rep", "copies", "vector"], verify, "vector-links")
    known = cells.classes(sets.select(F.col("rep").alias("set"), "key"), sets.select("key", "rep", "copies"), linked, "set")
    known = stage(known.select(F.col("set").alias("rep"), "n_links", F.col("component_id").alias("part")).join(sets.select("rep", "key", "least"), "rep"), "vector-classes")
    known = known.join(known.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("key", "n_links", "component_id")
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    found = members.join(known, "key").select("vec_id", "n_links", "component_id", kept)
    alone = rows.where(~usable("vector")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(alone)
