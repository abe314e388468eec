"""Cubic splines of many series: natural, clamped, given end derivatives, or Hermite.

A series is solved in one grouped map (its sites are one vector); Hermite cells are pure window
expressions. Evaluation finds the cell of every point with a sort of sites and points together and
works on any number of points. Outside the sites the end cells are extrapolated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.staging import stage

CELLS = "series long, cell int, x0 double, x1 double, a double, b double, c double, d double"


def solve_cells(x: np.ndarray, y: np.ndarray, left: tuple[str, float], right: tuple[str, float]) -> np.ndarray:
    """Coefficients (a, b, c, d) of a t^3 + b t^2 + c t + d in each cell, t from its left site.

    left and right: ('second', value) or ('first', value)."""
    n = len(x)
    if n < 2:
        raise ValueError("a spline needs two sites")
    h = np.diff(x)
    if (h <= 0).any():
        raise ValueError("sites must increase")
    slope = np.diff(y) / h
    low, mid, up, rhs = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], up[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * np.diff(slope)
    if left[0] == "second":
        rhs[0] = left[1]
    else:
        mid[0], up[0], rhs[0] = 2 * h[0], h[0], 6 * (slope[0] - left[1])
    if right[0] == "second":
        rhs[-1] = right[1]
    else:
        mid[-1], low[-1], rhs[-1] = 2 * h[-1], h[-1], 6 * (right[1] - slope[-1])
    for i in range(1, n):  # elimination of a tridiagonal system
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    z = np.zeros(n)
    z[-1] = rhs[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        z[i] = (rhs[i] - up[i] * z[i + 1]) / mid[i]
    return np.stack([(z[1:] - z[:-1]) / (6 * h), z[:-1] / 2, slope - h * (2 * z[:-1] + z[1:]) / 6, y[:-1]], 1)


class CubicSpline:
    """kind: natural, clamped (zero end slopes), custom (left and right give the order and value), hermite (needs dy)."""

    def __init__(self, kind: str = "natural", left: tuple[int, float] = (2, 0.0), right: tuple[int, float] = (2, 0.0)):
        if kind not in ("natural", "clamped", "custom", "hermite"):
            raise ValueError("kind must be natural, clamped, custom or hermite")
        if any(o not in (1, 2) for o, _ in (left, right)):
            raise ValueError("end conditions are on first or second derivatives")
        ends = {"natural": ((2, 0.0), (2, 0.0)), "clamped": ((1, 0.0), (1, 0.0))}.get(kind, (left, right))
        self.kind, self.ends, self.fitted = kind, [("second" if o == 2 else "first", float(v)) for o, v in ends], False

    @staticmethod
    def uniform_sites(spark, n: int, start: float, end: float) -> DataFrame:
        """(i, x): n sites at equal distances."""
        if n < 2 or end <= start:
            raise ValueError("uniform sites need two points and start < end")
        return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * F.lit((end - start) / (n - 1))).alias("x"))

    def fit(self, df: DataFrame, series: str | None = None, x: str = "x", y: str = "y", dy: str | None = None) -> CubicSpline:
        s = F.col(series).cast("long") if series else F.lit(0).cast("long")
        data = df.select(s.alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *([F.col(dy).cast("double").alias("dy")] if dy else []))
        if self.kind == "hermite":
            if not dy:
                raise ValueError("hermite splines need derivatives")
            w = Window.partitionBy("series").orderBy("x")
            nxt = lambda c: F.lead(c).over(w)
            rows = data.select("series", (F.row_number().over(w) - 1).alias("cell"), "x", "y", "dy", nxt("x").alias("x1"), nxt("y").alias("y1"), nxt("dy").alias("dy1")).where("x1 IS NOT NULL")
            h = F.when(F.col("x1") > F.col("x"), F.col("x1") - F.col("x")).otherwise(F.raise_error(F.lit("sites must increase")).cast("double"))
            m = (F.col("y1") - F.col("y")) / h
            self.cells = rows.select(
                "series", "cell", F.col("x").alias("x0"), "x1", ((F.col("dy") + F.col("dy1") - 2 * m) / (h * h)).alias("a"),
                ((3 * m - 2 * F.col("dy") - F.col("dy1")) / h).alias("b"), F.col("dy").alias("c"), F.col("y").alias("d"),
            )
        else:
            left, right = self.ends

            def solve(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("x")
                sites = pdf["x"].to_numpy()
                k = solve_cells(sites, pdf["y"].to_numpy(), left, right)
                return pd.DataFrame({"series": int(pdf["series"].iloc[0]), "cell": np.arange(len(k), dtype=np.int32), "x0": sites[:-1], "x1": sites[1:], "a": k[:, 0], "b": k[:, 1], "c": k[:, 2], "d": k[:, 3]})

            self.cells = data.groupBy("series").applyInPandas(solve, CELLS)
        self.fitted = True
        return self

    def search_cells(self, points: DataFrame, series: str | None = None, x: str = "x") -> DataFrame:
        """The points with their cell and its coefficients; points outside fall into the end cells.

        Sites and points are range-partitioned together, so that a series of any length is searched
        by many tasks; a range whose points stand before its first site takes the last site of the
        ranges before (one row for each range and series is carried over)."""
        if not self.fitted:
            raise RuntimeError("the spline is not fitted")
        own = [c for c in points.columns if c != "__s"]
        s = F.col(series).cast("long") if series else F.lit(0).cast("long")
        cell = F.struct("cell", "x0", "x1", "a", "b", "c", "d")
        cells = self.cells.select(F.col("series").alias("__s"), F.col("x0").alias("__x"), cell.alias("__k"))
        sites = cells.select("__s", "__x", F.lit(0).alias("__o"), "__k", *(F.lit(None).cast(t).alias(c) for c, t in points.dtypes))
        rows = points.select(s.alias("__s"), F.col(x).cast("double").alias("__x"), F.lit(1).alias("__o"), F.lit(None).cast(dict(sites.dtypes)["__k"]).alias("__k"), *own)
        dealt = stage(sites.unionByName(rows).repartitionByRange("__s", "__x").withColumn("__p", F.spark_partition_id()), "spline-points")
        ends = dealt.where("__o = 0").groupBy("__s", "__p").agg(F.max_by("__k", "__x").alias("__k"))
        spans = dealt.select("__s", "__p").distinct().join(ends, ["__s", "__p"], "left")
        earlier = F.last("__k", ignorenulls=True).over(Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
        carried = spans.select("__s", "__p", earlier.alias("__before")).join(cells.groupBy("__s").agg(F.min_by("__k", "__x").alias("__first")), "__s", "left")
        inside = F.last("__k", ignorenulls=True).over(Window.partitionBy("__s", "__p").orderBy("__x", "__o").rowsBetween(Window.unboundedPreceding, 0))
        found = dealt.withColumn("__l", inside).where("__o = 1").join(carried, ["__s", "__p"])
        return found.withColumn("__c", F.coalesce("__l", "__before", "__first")).select(*own, "__x", "__c.*")

    def evaluate(self, points: DataFrame, series: str | None = None, x: str = "x", orders: tuple[int, ...] = (0,)) -> DataFrame:
        """Adds d0, d1, ...: the value and the wanted derivatives (up to 3)."""
        if any(o not in (0, 1, 2, 3) for o in orders):
            raise ValueError("orders are 0 to 3")
        found = self.search_cells(points, series, x)
        t, a, b, c, d = F.col("__x") - F.col("x0"), *map(F.col, "abcd")
        forms = {0: ((a * t + b) * t + c) * t + d, 1: (3 * a * t + 2 * b) * t + c, 2: 6 * a * t + 2 * b, 3: 6 * a}
        return found.select(*points.columns, *(forms[o].alias(f"d{o}") for o in orders))
