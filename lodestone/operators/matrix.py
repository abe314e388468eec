"""Matrices on DataFrames: an id and either numeric columns or one array column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict(column, allow_null: bool = False) -> F.Column:
    """The column as a double; a null fails the query unless it is allowed. NaN passes on."""
    c = (F.col(f"`{column}`") if isinstance(column, str) else column).cast("double")
    return c if allow_null else F.coalesce(c, F.raise_error(F.lit("missing value: drop or fill nulls, or set allow_null")).cast("double"))


def pack(df: DataFrame, columns: list[str] | str, id_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, x) with the features as one array<double>; columns: names, or the name of an array column."""
    x = F.col(f"`{columns}`").cast("array<double>") if isinstance(columns, str) else F.array(*(strict(c) for c in columns))
    ids = [F.col(f"`{id_col}`").alias("id")] if id_col else []
    return df.select(*ids, *keep, x.alias("x"))


def to_numpy(column) -> np.ndarray:
    """An Arrow list column as a two-dimensional array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if n and len(flat) % n:
        raise ValueError("rows of different lengths")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def collect_matrix(df: DataFrame, limit: int, what: str, columns: tuple[str, ...] = ()) -> tuple:
    """x (and further columns) on the driver, ordered by id; only for kernels whose size is checked."""
    n = df.count()
    if n > limit:
        raise ValueError(f"{what} keeps all rows on the driver: {n} rows, at most {limit}")
    pdf = df.orderBy("id").toPandas()
    x = np.array(pdf["x"].tolist(), float).reshape(n, -1) if n else np.zeros((0, 0))
    return (x, *(pdf[c].to_numpy() for c in columns))


def moments(df: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and column means of a packed matrix."""
    long = df.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.count("*").alias("n")).orderBy("i").collect()
    if not long:
        raise ValueError("the matrix has no rows")
    return long[0].n, np.array([r.m for r in long])


#: Values of an array that are summed together.
CHUNK = 4096


def sum_arrays(df: DataFrame, fn, largest_last: int = 0) -> np.ndarray:
    """The sum over all partitions of the array that fn makes of a partition's batches (None: nothing).

    Arrays are cut into chunks that are summed by tasks; the driver gets one array. Of the last
    `largest_last` values the largest is taken instead."""

    def parts(batches):
        v = fn(batches)
        if v is not None:
            v = np.asarray(v, float)
            cuts = range(0, len(v), CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c // CHUNK for c in cuts], pa.int32()), pa.array([len(v)] * len(cuts), pa.int64()), pa.array([v[c : c + CHUNK] for c in cuts], pa.list_(pa.float64()))], ["c", "n", "v"]
            )

    def add(batches):
        total: dict[int, list] = {}
        for b in batches:
            ends, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
            for c, n, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends[:-1], ends[1:], strict=True):
                v = flat[lo:hi]
                if c not in total:
                    total[c] = [n, v.copy()]
                    continue
                keep = max(0, min(len(v), n - largest_last - c * CHUNK))
                total[c][1][:keep] += v[:keep]
                np.maximum(total[c][1][keep:], v[keep:], out=total[c][1][keep:])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v for _, v in total.values()], pa.list_(pa.float64()))], ["c", "n", "v"])

    schema = "c int, n long, v array<double>"
    rows = df.mapInArrow(parts, schema).repartition("c").mapInArrow(add, schema).toArrow().sort_by("c")
    if not rows.num_rows:
        raise ValueError("the table has no rows")
    return rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)


def gram(df: DataFrame, shift: np.ndarray | None = None, extra: tuple[str, ...] = ()) -> np.ndarray:
    """(X - shift)' (X - shift) of the packed matrix, with further numeric columns appended to it.

    Each partition multiplies its batches; the products (p x p values a partition) are summed in a
    distributed aggregation, and only the p x p result reaches the driver."""
    extra = tuple(extra)

    def run(batches):
        total = None
        for b in batches:
            if not len(b):
                continue
            x = to_numpy(b.column(0))
            if extra:
                x = np.hstack([x, np.stack([b.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(extra))], 1)])
            if shift is not None:
                x = x - shift
            g = x.T @ x
            total = g if total is None else total + g
        return None if total is None else total.ravel()

    flat = sum_arrays(df.select("x", *extra), run)
    p = round(len(flat) ** 0.5)
    return flat.reshape(p, p)


def literal(values) -> F.Column:
    """A constant array column."""
    return F.lit([float(v) for v in values]) if len(values) else F.array().cast("array<double>")


def dot(x: F.Column, y: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def product(x: F.Column, rows: np.ndarray) -> F.Column:
    """The products of array column x with each row of a constant matrix, as an array."""
    table = F.array(*(literal(r) for r in np.atleast_2d(rows)))
    return F.transform(table, lambda r: dot(x, r))
