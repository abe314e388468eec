"""Distance joins in blocks: pairwise distances, k nearest neighbours, radius neighbours.

Both sides are dealt into parts by a hash of their ids; each pair of parts is a cell. Its task holds the rows of x,
those of y pass by, and blocks of both are compared as a matrix. A cell returns only what its operator keeps (all pairs, k best, or those within
the radius), so nothing grows beyond the result. An optional group column keeps pairs inside a group.
All pairs of one table are met once and listed in both orders: its parts meet in half as many cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import EPS, METRICS
from lodestone.operators.matrix import to_numpy

#: Rows of a block on either side.
BLOCK = 2048
#: Rows of x that are compared with a block at a time.
ROWS = 512
#: Rows of x whose distances stay in a cache while coordinates are added.
STRIP = 32
#: Blocks of x that a cell holds at most.
HELD = 4
#: Parts of x and of y, if they have as many blocks.
PARTS = 16, 4
#: Parts of a table that is joined with itself, if it has as many blocks, and blocks that such a part holds at most.
OWN_PARTS, OWN_HELD = 8, 8
#: Tasks that such a join has at most; cells beyond that share them.
MOST_TASKS = 10_000
#: Pairs are listed in squares of so many rows of either side, each row of a square followed by its mirror image in the same order. Equal
#: ids in a row and a short period let column files store the ids in little space, and values that come again at once (within the reach
#: of a fast compressor, which skips ahead where it finds nothing) cost little the second time. Of 20,000 pairs (a page) nearly half have
#: the value of another, else the first page of a group makes the writer give up its dictionary and store 8 bytes for each value.
TILE = 64


def check_metric(metric: str, p: float = 2.0) -> str:
    if metric != "minkowski" and metric not in METRICS:
        raise ValueError(f"metric must be minkowski or one of {', '.join(METRICS)}")
    if metric == "minkowski" and p <= 0:
        raise ValueError("the Minkowski power must be positive")
    return metric


def reach_of(metric: str, radius: float) -> float | None:
    """What two rows within the radius differ by at most in a coordinate; None if that has no bound."""
    if metric in ("cosine", "inner product"):
        return None
    return float(np.sqrt(radius)) if metric.startswith("sq") else radius


def block_distance(metric: str, a: np.ndarray, b: np.ndarray, p: float = 2.0) -> np.ndarray:
    """Distances of all rows of a and b; coordinate by coordinate where cancellation would hurt."""
    if metric == "minkowski" and p in (1, 2):
        metric = {1: "manhattan", 2: "euclidean"}[p]
    if metric == "inner product":
        return a @ b.T
    if metric == "cosine":
        na, nb = (np.sqrt((m * m).sum(1)) for m in (a, b))
        na, nb = np.where(na <= EPS, 1.0, na), np.where(nb <= EPS, 1.0, nb)
        return 1.0 - (a @ b.T) / (na[:, None] * nb[None, :])
    if metric.endswith("_gemm"):
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)
        return d if metric.startswith("sq") else np.sqrt(d)
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for lo in range(0, len(a), STRIP):
        _add_up(out[lo : lo + STRIP], a[lo : lo + STRIP], columns, metric, p)
    if metric == "minkowski":
        return np.cbrt(out) if p == 3 else out ** (1 / p)
    return np.sqrt(out) if metric in ("euclidean", "l2") else out


def _add_up(out: np.ndarray, a: np.ndarray, columns: np.ndarray, metric: str, p: float) -> None:
    """Adds each coordinate's part to out; whole powers are products."""
    d, power = np.empty_like(out), np.empty_like(out)
    for k in range(a.shape[1]):
        np.subtract(a[:, k, None], columns[k], out=d)
        if metric in ("manhattan", "l1", "cityblock", "minkowski"):
            np.abs(d, out=d)
        if metric == "minkowski" and p in (3, 4):
            np.multiply(d, d, out=power)
            d = np.multiply(power, d if p == 3 else power, out=d)
        elif metric == "minkowski":
            np.power(d, p, out=d)
        elif metric not in ("manhattan", "l1", "cityblock"):
            np.multiply(d, d, out=d)
        out += d


def _dealt(x: DataFrame, y: DataFrame, block: int) -> DataFrame:
    """Rows of both sides in the cells (g, cx, cy); side 0: x.

    A cell holds at most HELD blocks of x (fewer, while there are not PARTS parts of x), y passes by it. So y is cut only to
    have more cells, and a row is sent to as many cells as the other side has parts."""
    sizes = x.groupBy("g").agg(F.count("*").alias("nx")).join(y.groupBy("g").agg(F.count("*").alias("ny")), "g")
    blocks = lambda n, k=1: F.ceil(F.col(n) / (k * block)).cast("long")
    sizes = sizes.select("g", F.greatest(blocks("nx", HELD), F.least(blocks("nx"), F.lit(PARTS[0]))).alias("bx"), F.least(blocks("ny"), F.lit(PARTS[1])).alias("by"))

    def side(df, own, other, n, m, which):
        out = df.join(sizes, "g").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
        return out.select("g", "cx", "cy", F.lit(which).alias("side"), "id", "x")

    return side(x, "cx", "cy", "bx", "by", 0).unionByName(side(y, "cy", "cx", "by", "bx", 1))


#: Slabs that a coordinate is cut into at most.
SLABS = 1024


def _slabs(x: DataFrame, y: DataFrame, reach: float, block: int):
    """The cuts of the coordinate with the widest range, and which it is; None if slabs would meet nearly all others.

    Cuts are quantiles of x; rows farther apart than `reach` in one coordinate are so in all metrics of Minkowski."""
    finite = F.abs("v") < F.lit(float("inf"))
    long = x.unionByName(y).select(F.posexplode("x").alias("i", "v")).where(finite)
    wide = long.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy((F.col("lo") - F.col("hi")), "i").first()
    if wide is None or not wide.hi - wide.lo > 8 * reach:
        return None
    v = x.select(F.get("x", F.lit(wide.i)).alias("v")).where(finite)
    n = v.count()
    parts = min(SLABS, -(-n // block))
    if parts < 2:
        return None
    cuts = np.unique(v.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10 * SLABS)).first()[0])
    # differences are rounded where they are compared with the radius
    return wide.i, cuts, reach * (1 + 1e-9) + 1e-12 * max(abs(wide.lo), abs(wide.hi))


def _dealt_in_slabs(x: DataFrame, y: DataFrame, coordinate: int, cuts: np.ndarray, reach: float, block: int) -> DataFrame:
    """Rows of x in the cells (0, slab, part), rows of y in all cells of the slabs within reach; a slab of many rows has several parts."""

    def slab(df, first, last):
        def run(batches):
            for b in batches:
                if len(b):
                    v = to_numpy(b.column(1))[:, coordinate]
                    lo, hi = np.searchsorted(cuts, v - first, "right"), np.searchsorted(cuts, v + last, "right")
                    n = hi - lo + 1
                    at = np.repeat(np.arange(len(b)), n)
                    cx = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + lo[at]
                    yield pa.RecordBatch.from_arrays([pa.array(cx.astype(np.int64)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["cx", "id", "x"])

        return df.select("id", "x").mapInArrow(run, "cx long, id long, x array<double>")

    own = slab(x, 0.0, 0.0)
    sizes = own.groupBy("cx").agg(F.ceil(F.count("*") / (HELD * block)).cast("long").alias("parts"))
    own = own.join(sizes, "cx").withColumn("cy", F.pmod(F.xxhash64("id"), "parts"))
    met = slab(y, reach, reach).join(sizes, "cx").withColumn("cy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return own.select(F.lit(0).cast("long").alias("g"), "cx", "cy", F.lit(0).alias("side"), "id", "x").unionByName(met.select(F.lit(0).cast("long").alias("g"), "cx", "cy", F.lit(1).alias("side"), "id", "x"))


def _runs(batches, keys: int):
    """(key, batch) of neighbouring rows that agree in the first columns."""
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]], 1)
        cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(batch)]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield tuple(key[lo].tolist()), batch.slice(lo, hi - lo)


def block_join(x: DataFrame, y: DataFrame, fn: Callable, schema: str, block: int = BLOCK, reach: float | None = None) -> DataFrame:
    """fn(ids of x, rows of x, ids of y, rows of y) -> dict of columns, for blocks of each cell. x and y: (id, x) and perhaps g.

    With `reach` (and no g) fn need not see pairs that are farther apart than that in any coordinate."""
    slabs = reach is not None and "g" not in x.columns
    x, y = (df if "g" in df.columns else df.withColumn("g", F.lit(0)) for df in (x, y))
    x, y = (df.select(F.col("g").cast("long"), F.col("id").cast("long"), F.col("x").cast("array<double>")) for df in (x, y))

    def run(batches):
        cell, held, ids, rows = None, [], None, None
        for key, part in _runs(batches, 4):
            if key[:3] != cell:
                cell, held, ids = key[:3], [], None
            if key[3] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if ids is None:  # x comes before y
                whole = pa.Table.from_batches(held)
                ids, rows = whole.column("id").to_numpy(), to_numpy(whole.column("x"))
            at = part.schema.get_field_index("id")
            others, them = part.column(at).to_numpy(), to_numpy(part.column(at + 1))
            for by in range(0, len(others), block):
                for lo in range(0, len(ids), ROWS):
                    found = fn(ids[lo : lo + ROWS], rows[lo : lo + ROWS], others[by : by + block], them[by : by + block])
                    if isinstance(found, pa.RecordBatch):
                        yield found
                    elif found is not None and len(next(iter(found.values()))):
                        yield pa.RecordBatch.from_pydict(found)

    slabs = _slabs(x, y, reach, block) if slabs else None
    dealt = _dealt_in_slabs(x, y, *slabs, block) if slabs else _dealt(x, y, block)
    return dealt.repartition("g", "cx", "cy").sortWithinPartitions("g", "cx", "cy", "side", "id").mapInArrow(run, schema)


def rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded as SQL does, half away from zero; 0.0 for -0.0. What has no finite multiple stays."""
    if digits is None:
        return v
    scale = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        s = v * scale
        out = np.rint(s)
        rest = s - out
    half = np.abs(rest) == 0.5  # rint goes to the even number
    if half.any():
        out = np.where(half & (rest * s > 0), out + 2 * rest, out)
    out /= scale
    return np.where(np.isfinite(out), out, v) + 0.0


def _tiles(ia: np.ndarray, ib: np.ndarray, values: np.ndarray, mirrored: bool, same: bool = False) -> list[tuple]:
    """(ids of x, ids of y, values) of all pairs, tile by tile; mirrored: each row of a tile followed by its pairs (b, a).

    same: a is b, so that mirrored tiles above the diagonal and those on it are all pairs."""
    out = []

    def grid(a, b, v, mirrored, same=False):
        if not v.size:
            return
        h, w = min(TILE, len(a)), min(TILE, len(b))
        v = v.reshape(len(a) // h, h, len(b) // w, w).transpose(2, 0, 1, 3)
        j, i = np.divmod(np.arange(v.shape[0] * v.shape[1]), v.shape[1])
        v, a, b = v.reshape(-1, h, w), a.reshape(-1, h), b.reshape(-1, w)
        for keep, twice in ((i < j, True), (i == j, False)) if same else ((slice(None), mirrored),):
            k = v[keep]
            p, q = (np.broadcast_to(x, k.shape) for x in (a[i[keep], :, None], b[j[keep], None, :]))
            listed = (np.stack(x, 2) for x in ((p, q), (q, p), (k, k))) if twice else (p, q, k)
            out.append(tuple(x.ravel() for x in listed))

    m, n = (len(x) // TILE * TILE for x in (ia, ib))
    grid(ia[:m], ib[:n], values[:m, :n], mirrored, same)
    grid(ia[:m], ib[n:], values[:m, n:], mirrored or same)
    if not same:
        grid(ia[m:], ib[:n], values[m:, :n], mirrored)
    grid(ia[m:], ib[n:], values[m:, n:], mirrored)
    return out


def _listed(ia: np.ndarray, ib: np.ndarray, values: np.ndarray, name: str, mirrored: bool = False, same: bool = False) -> pa.RecordBatch:
    columns = zip(*_tiles(ia, ib, values, mirrored, same), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["id_x", "id_y", name])


def _dealt_once(x: DataFrame, block: int) -> DataFrame:
    """Rows in the cells (cx, cy), cx <= cy, of each two parts, a task for each cell; side 0: those of the part cx.

    A part has at most OWN_HELD blocks (fewer, while there are not OWN_PARTS parts), and a row is sent to as many cells as there are parts."""
    n = x.count()
    parts = max(1, -(-n // (OWN_HELD * block)), min(-(-n // block), OWN_PARTS))
    own, other = F.pmod(F.xxhash64("id"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    out = x.withColumn("own", own).withColumn("other", other)
    out = out.select(F.least("own", "other").cast("long").alias("cx"), F.greatest("own", "other").cast("long").alias("cy"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "x")
    tasks = min(parts * (parts + 1) // 2, MOST_TASKS)
    cell = (F.col("cy") * (F.col("cy") + 1) / 2).cast("long") + F.col("cx")
    return out.repartitionById(tasks, F.pmod(cell, F.lit(tasks)).cast("int")).sortWithinPartitions("cx", "cy", "side", "id")


def all_pairs(x: DataFrame, y: DataFrame | None, fn: Callable, name: str, block: int = BLOCK) -> DataFrame:
    """(id_x, id_y, name) of all pairs; fn(ids of a, rows of a, ids of b, rows of b) -> matrix of values.

    Without y, x against itself: fn is symmetric then, and each two parts of x meet once."""
    schema = f"id_x long, id_y long, {name} double"
    if y is not None or "g" in x.columns:
        return block_join(x, x if y is None else y, lambda ia, a, ib, b: _listed(ia, ib, fn(ia, a, ib, b), name), schema, block)

    def run(batches):
        cell, held, ids, rows = None, [], None, None

        def with_others(others, them):
            for by in range(0, len(others), block):
                ib, b = others[by : by + block], them[by : by + block]
                for lo in range(0, len(ids), ROWS):
                    ia = ids[lo : lo + ROWS]
                    yield _listed(ia, ib, fn(ia, rows[lo : lo + ROWS], ib, b), name, mirrored=True)

        def with_itself():
            ids, rows = whole()
            for lo in range(0, len(ids), ROWS):
                ia, a = ids[lo : lo + ROWS], rows[lo : lo + ROWS]
                yield _listed(ia, ia, fn(ia, a, ia, a), name, same=True)
                for by in range(lo + ROWS, len(ids), block):
                    ib = ids[by : by + block]
                    yield _listed(ia, ib, fn(ia, a, ib, rows[by : by + block]), name, mirrored=True)

        def whole():
            table = pa.Table.from_batches(held)
            held.clear()
            return table.column("id").to_numpy(), to_numpy(table.column("x"))

        for key, part in _runs(batches, 3):
            if key[:2] != cell:
                if held and cell[0] == cell[1]:
                    yield from with_itself()
                cell, held, ids = key[:2], [], None
            if key[2] == 0:
                held.append(part)
            elif held or ids is not None:
                if ids is None:
                    ids, rows = whole()
                yield from with_others(part.column(3).to_numpy(), to_numpy(part.column(4)))
        if held and cell[0] == cell[1]:
            yield from with_itself()

    # floats are sent as they are and widened in the task
    floats = dict(x.dtypes)["x"] == "array<float>"
    x = x.select(F.col("id").cast("long"), F.col("x") if floats else F.col("x").cast("array<double>"))
    return _dealt_once(x, block).mapInArrow(run, schema)


def pairwise_distances(x: DataFrame, y: DataFrame | None = None, metric: str = "euclidean", p: float = 2.0, digits: int | None = None) -> DataFrame:
    """(id_x, id_y, dist) of all pairs, rounded to so many digits; x and y hold id and an array x. Without y, x against itself."""
    check_metric(metric, p)
    own = y is None

    def fn(ia, a, ib, b):
        d = block_distance(metric, a, b, p)
        if own and metric == "cosine":
            d[ia[:, None] == ib[None, :]] = 0.0
        return rounded(d, digits)

    return all_pairs(x, y, fn, "dist")


def kernel_matrix(x: DataFrame, y: DataFrame | None = None, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 1.0, digits: int | None = None) -> DataFrame:
    """(id_x, id_y, value) of a kernel over all pairs, rounded to so many digits."""
    block_kernel(kernel, np.zeros((1, 1)), np.zeros((1, 1)), gamma, degree, coef0)
    return all_pairs(x, y, lambda ia, a, ib, b: rounded(block_kernel(kernel, a, b, gamma, degree, coef0), digits), "value")


def block_kernel(kernel: str, a: np.ndarray, b: np.ndarray, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kernel == "rbf":
        return np.exp(-gamma * block_distance("sqeuclidean", a, b))
    if kernel == "linear":
        return a @ b.T
    if kernel in ("poly", "polynomial"):
        return (gamma * (a @ b.T) + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * (a @ b.T) + coef0)
    raise ValueError("kernel must be rbf, linear, polynomial or sigmoid")


def within(metric: str, a: np.ndarray, b: np.ndarray, radius: float, p: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of a, rows j of b and distances of the pairs within the radius.

    Euclidean pairs that a product of matrices shows to be farther apart, by more than it can err, are left out first;
    the distances of the others are those of block_distance."""
    squared = metric == "sqeuclidean"
    if a.shape[1] > 2 and (squared or metric in ("euclidean", "l2") or (metric == "minkowski" and p == 2)):
        na, nb = (a * a).sum(1), (b * b).sum(1)
        # the product of rows (a, |a|^2, 1) and (-2b, 1, |b|^2) errs by less than its terms times their number and 2^-52
        slack = 4 * (a.shape[1] + 4) * 2.0**-52 * (na.max(initial=0) + nb.max(initial=0))
        one = lambda n: np.ones((len(n), 1))
        d = np.hstack([a, na[:, None], one(na)]) @ np.hstack([-2 * b, one(nb), nb[:, None]]).T
        bound = (radius if squared else radius * radius) * (1 + 1e-12) + slack
        far = d > bound  # not so where it is no number
        near = far.size - np.count_nonzero(far)
        if 8 * near < far.size:
            i, j = np.nonzero(~far)
            d = np.zeros(len(i))
            for k in range(a.shape[1]):
                e = a[i, k] - b[j, k]
                d += e * e
            d = d if squared else np.sqrt(d)
            kept = d <= radius
            return i[kept], j[kept], d[kept]
    d = block_distance(metric, a, b, p)
    i, j = np.nonzero(d <= radius)
    return i, j, d[i, j]


def knn(x: DataFrame, y: DataFrame, k: int = 5, metric: str = "euclidean", p: float = 2.0, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(id_x, rank from 1, id_y, dist) of the k nearest rows of y for each row of x; ties by id.

    The inner product is a similarity: its k largest are returned."""
    check_metric(metric, p)
    if k < 1:
        raise ValueError("k must be positive")
    sign = -1.0 if metric == "inner product" else 1.0

    def fn(ia, a, ib, b):
        d = sign * block_distance(metric, a, b, p)
        if exclude_self:
            d[ia[:, None] == ib[None, :]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]  # ids ascend, so equal ones stay in their order
        value = np.take_along_axis(d, near, 1)
        i, j = np.nonzero(value < np.inf)
        return {"id_x": ia[i], "id_y": ib[near[i, j]], "dist": sign * value[i, j]}

    found = block_join(x, y, fn, "id_x long, id_y long, dist double", block)
    best = Window.partitionBy("id_x").orderBy(F.col("dist") * F.lit(sign), "id_y")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id_x", "rank", "id_y", "dist")


def radius_join(x: DataFrame, y: DataFrame, radius: float, metric: str = "euclidean", p: float = 2.0, exclude_self: bool = False, sort: bool = False) -> DataFrame:
    """(id_x, id_y, dist) of the pairs within the radius; with sort also their rank by distance."""
    check_metric(metric, p)
    if radius < 0:
        raise ValueError("the radius must not be negative")
    if metric == "inner product":
        raise ValueError("the inner product has no radius")

    def fn(ia, a, ib, b):
        i, j, d = within(metric, a, b, radius, p)
        if exclude_self:
            apart = ia[i] != ib[j]
            i, j, d = i[apart], j[apart], d[apart]
        return {"id_x": ia[i], "id_y": ib[j], "dist": d}

    found = block_join(x, y, fn, "id_x long, id_y long, dist double", reach=reach_of(metric, radius))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id_x").orderBy("dist", "id_y"))) if sort else found
