"""Descriptive statistics as aggregations.

Every function takes (df, columns) and an axis: 'col' gives one row with a value for each column,
'row' adds a value to each row, 'all' gives one value. group_by computes the statistic per group
(axis col and all). Nulls fail unless allow_null is set, NaN propagates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.matrix import strict
from lodestone.sources.staging import stage


def _axis(axis: str) -> str:
    if axis not in ("col", "row", "all"):
        raise ValueError("axis must be col, row or all")
    return axis


def _long(df: DataFrame, columns, group_by, allow_null) -> DataFrame:
    return df.select(*group_by, F.explode(F.array(*(strict(c, allow_null) for c in columns))).alias("value"))


def _grouped(df: DataFrame, group_by) -> object:
    return df.groupBy(*group_by) if group_by else df


def _apply(df, columns, axis, group_by, allow_null, agg, row, out="value"):
    """agg: Column -> aggregate. row: (array of columns, n) -> value of a row."""
    if not columns:
        raise ValueError("no columns")
    if _axis(axis) == "row":
        return df.withColumn(out, row([strict(c, allow_null) for c in columns]))
    if axis == "all":
        return _grouped(_long(df, columns, group_by, allow_null), group_by).agg(agg(F.col("value")).alias(out))
    return _grouped(df.select(*group_by, *(strict(c, allow_null).alias(c) for c in columns)), group_by).agg(*(agg(F.col(f"`{c}`")).alias(c) for c in columns))


def _sum(values):
    return reduce(lambda a, b: a + b, values)


def mean(df: DataFrame, columns: list[str], axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    return _apply(df, columns, axis, group_by, allow_null, F.avg, lambda v: _sum(v) / len(v))


def total(df: DataFrame, columns: list[str], axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    return _apply(df, columns, axis, group_by, allow_null, F.sum, _sum)


def geometric_mean(df: DataFrame, columns: list[str], axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """exp of the mean logarithm; 0 if a value is 0; a negative value anywhere is an error."""
    fail = F.raise_error(F.lit("geometric mean of a negative value")).cast("double")
    log = lambda x: F.when(x < 0, fail).when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))
    return _apply(df, columns, axis, group_by, allow_null, lambda c: F.exp(F.avg(log(c))), lambda v: F.exp(_sum(map(log, v)) / len(v)))


def harmonic_mean(df: DataFrame, columns: list[str], axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """n over the sum of reciprocals; 0 if that sum is 0 or a value is 0."""
    inverse = lambda x: F.when(x == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), x))
    finish = lambda n, s: F.when((s == 0) | (F.abs(s) == float("inf")), F.lit(0.0)).otherwise(F.try_divide(n, s))
    return _apply(df, columns, axis, group_by, allow_null, lambda c: finish(F.count(c).cast("double"), F.sum(inverse(c))), lambda v: finish(F.lit(float(len(v))), _sum(map(inverse, v))))


def _divisor(n, dof: int):
    """dof < 0: n; 0: n - 1; > 0: dof itself. No division below 1."""
    d = n if dof < 0 else n - 1 if dof == 0 else F.lit(float(dof))
    return F.greatest(d, F.lit(1.0))


def _row_power(v, k, centre=None):
    m = _sum(v) / len(v) if centre is None else centre
    return _sum([F.pow(x - m, F.lit(float(k))) for x in v])


def variance(df: DataFrame, columns: list[str], dof: int = 0, axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    return _apply(
        df, columns, axis, group_by, allow_null,
        lambda c: F.var_pop(c) * F.count(c) / _divisor(F.count(c).cast("double"), dof),
        lambda v: _row_power(v, 2) / _divisor(F.lit(float(len(v))), dof),
    )


def skewness(df: DataFrame, columns: list[str], axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """Population skewness; 0 for constant data."""

    def row(v):
        m2 = _row_power(v, 2)
        return F.when(m2 == 0, F.lit(0.0)).otherwise(F.lit(float(len(v)) ** 0.5) * F.try_divide(_row_power(v, 3), F.pow(m2, F.lit(1.5))))

    return _apply(df, columns, axis, group_by, allow_null, lambda c: F.coalesce(F.skewness(c), F.lit(0.0)), row)


def kurtosis(df: DataFrame, columns: list[str], axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """Population excess kurtosis; -3 for constant data."""

    def row(v):
        m2 = _row_power(v, 2)
        return F.when(m2 == 0, F.lit(-3.0)).otherwise(F.lit(float(len(v))) * F.try_divide(_row_power(v, 4), m2 * m2) - 3.0)

    return _apply(df, columns, axis, group_by, allow_null, lambda c: F.coalesce(F.kurtosis(c), F.lit(-3.0)), row)


def moment(df: DataFrame, columns: list[str], k: int, mean: list[float] | float | None = None, axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """k-th central moment with divisor n, about the given mean(s) or the data's own (a first pass)."""
    if k < 0:
        raise ValueError("k must not be negative")
    if _axis(axis) == "row":
        return df.withColumn("value", _row_power([strict(c, allow_null) for c in columns], k, None if mean is None else F.lit(float(mean))) / len(columns))
    if axis == "all":
        df, columns, mean = _long(df, columns, group_by, allow_null), ["value"], None if mean is None else [float(mean)]
    power = lambda c, m: F.avg(F.pow(strict(c, allow_null) - m, F.lit(float(k)))).alias(c)
    if mean is not None:
        return _grouped(df, group_by).agg(*(power(c, F.lit(float(m))) for c, m in zip(columns, mean, strict=True)))
    centres = _grouped(df, group_by).agg(*(F.avg(strict(c, allow_null)).alias(f"__m{i}") for i, c in enumerate(columns)))
    both = df.join(centres, list(group_by)) if group_by else df.crossJoin(F.broadcast(centres))  # a single row
    return _grouped(both, group_by).agg(*(power(c, F.col(f"__m{i}")) for i, c in enumerate(columns)))


METHODS = {
    "inverted_cdf": 1, "averaged_inverted_cdf": 2, "closest_observation": 3, "interpolated_inverted_cdf": 4, "hazen": 5,
    "weibull": 6, "linear": 7, "median_unbiased": 8, "normal_unbiased": 9,
}
#: Quantiles are first bracketed by a summary of this accuracy; a bracket spans SPAN of the rows on either side.
ACCURACY, SPAN = 50_000, 1e-4


def _places(n: F.Column, q: F.Column, kind: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """0-based lower and upper place among n sorted values, and the weight of the upper one."""
    lit = lambda x: F.lit(float(x))
    add = F.element_at(F.array(*map(lit, (0, 0.5, -0.5, 0, 0.5, 0, 1, 1 / 3, 0.375))), kind)
    span = n + F.element_at(F.array(*map(lit, (0, 0, 0, 0, 0, 1, -1, 1 / 3, 0.25))), kind)
    h = span * q + add - lit(1)
    clamp = lambda x: F.greatest(lit(0), F.least(n - lit(1), x.cast("double")))
    low = clamp(F.when(kind == 1, F.ceil(h)).when(kind == 2, F.ceil(h - lit(0.5))).when(kind == 3, F.rint(h).cast("long")).otherwise(F.floor(h)))
    high = clamp(F.when(kind == 1, F.ceil(h)).when(kind == 2, F.floor(h + lit(0.5))).when(kind == 3, F.rint(h).cast("long")).otherwise(F.ceil(h)))
    weight = F.when(low == high, lit(0)).when(kind == 2, lit(0.5)).otherwise(h - low)
    return low.cast("long"), high.cast("long"), weight


def quantile(df: DataFrame, columns: list[str], q: float | list[float], method: str | int | list = "linear", axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """Exact quantiles by any of the nine Hyndman-Fan definitions: (*group_by, column, q, value); several methods add a column method.

    A summary of the values brackets every wanted place; one pass counts what lies below and inside
    each bracket, and only the values inside (some SPAN of all) are ranked, merged where they are
    equal. Should a bracket miss its place, which the summary's bound rules out, the query fails.
    axis 'row' adds a column for each q."""
    kinds = [METHODS.get(m, m) if isinstance(m, str) else m for m in (method if isinstance(method, (list, tuple)) else [method])]
    if any(k not in range(1, 10) for k in kinds):
        raise ValueError(f"method must be 1 to 9 or one of {', '.join(METHODS)}")
    wanted = [float(x) for x in (q if isinstance(q, (list, tuple)) else [q])]
    if any(not 0 <= x <= 1 for x in wanted):
        raise ValueError("q must lie in [0, 1]")
    if _axis(axis) == "row":
        values = F.array_sort(F.array(*(strict(c, allow_null) for c in columns)))
        n = F.lit(float(len(columns)))
        for i, x in enumerate(wanted):
            low, high, w = _places(n, F.lit(x), F.lit(kinds[0]))
            a, b = (F.element_at(values, k.cast("int") + 1) for k in (low, high))
            df = df.withColumn(f"q{i}", a + w * (b - a))
        return df
    if axis == "all":
        df, columns = _long(df, columns, group_by, allow_null), ["value"]
    key = [*group_by, "column"]
    long = df.select(*group_by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), strict(c, allow_null).alias("x")) for c in columns))).alias("e"))
    long = long.select(*group_by, "e.*").where("x IS NOT NULL")
    qs = sorted(set(wanted))
    ends = [min(1.0, max(0.0, x + d)) for x in qs for d in (-SPAN, SPAN)]
    cuts = long.groupBy(*key).agg(F.percentile_approx("x", ends, ACCURACY).alias("cuts"), F.count("*").alias("size"), F.min("x").alias("least"), F.max("x").alias("most"))
    # the place of a quantile lies at most two ranks from q * size, whatever the method: the ends reach to the extremes of small groups
    few = F.col("size") * F.lit(SPAN) < 8
    low = [F.when(few | F.lit(x <= SPAN), F.col("least")).otherwise(F.element_at("cuts", 2 * i + 1)).alias(f"l{i}") for i, x in enumerate(qs)]
    high = [F.when(few | F.lit(x >= 1 - SPAN), F.col("most")).otherwise(F.element_at("cuts", 2 * i + 2)).alias(f"h{i}") for i, x in enumerate(qs)]
    cuts = stage(cuts.select(*key, "size", *low, *high), "brackets")  # one row for each group
    both = long.join(cuts, key)
    x = F.col("x")
    below = [F.count(F.when(x < F.col(f"l{i}"), 1)).alias(f"b{i}") for i in range(len(qs))]
    counts = both.groupBy(*key).agg(F.first("size").alias("size"), *below)
    held = F.array(*(F.when((x >= F.col(f"l{i}")) & (x <= F.col(f"h{i}")), F.lit(i)) for i in range(len(qs))))
    inside = both.select(*key, "x", F.explode(F.array_compact(held)).alias("at")).groupBy(*key, "at", "x").agg(F.count("*").alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("method"), F.lit(v).alias("q"), F.lit(qs.index(v)).alias("at"), F.col(f"b{qs.index(v)}").alias("below")) for k in kinds for v in wanted)))
    totals = counts.withColumn("size", F.col("size").cast("double")).withColumn("a", asked).select(*key, "size", "a.*")
    low, high, w = _places(F.col("size"), F.col("q"), F.col("method"))
    totals = totals.withColumns({"low": low, "high": high, "w": w})  # methods times q rows a group
    both = F.explode(F.array(*(F.struct("method", "q", (F.col(p) - F.col("below")).alias("place"), u.alias("w")) for p, u in (("low", F.lit(1.0) - F.col("w")), ("high", F.col("w"))))))
    hits = totals.select(*key, "at", both.alias("p")).groupBy(*key, "at").agg(F.collect_list("p").alias("ps"))  # a row for each bracket
    upto = F.sum("n").over(Window.partitionBy(*key, "at").orderBy("x"))
    ranked = inside.withColumn("upto", upto).join(hits, [*key, "at"])
    here = F.filter("ps", lambda p: (p["place"] >= F.col("upto") - F.col("n")) & (p["place"] < F.col("upto")))
    found = ranked.select(*key, "x", F.explode(here).alias("p")).select(*key, "x", "p.*")
    # both ends of every interpolation must have been found
    sure = F.when(F.abs(F.sum("w") - 1) < 1e-9, True).otherwise(F.raise_error(F.lit("a bracket missed its quantile")).cast("boolean"))
    value = F.when(sure, F.sum(F.when(F.col("w") == 0, F.lit(0.0)).otherwise(F.col("w") * F.col("x")))).alias("value")
    if isinstance(method, (list, tuple)):
        return found.groupBy("method", *key, "q").agg(value)
    return found.groupBy(*key, "q").agg(value)


def five_point_summary(df: DataFrame, columns: list[str], axis: str = "col", group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """Minimum, lower hinge, median, upper hinge and maximum; the hinges are of type 6."""
    return quantile(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0], "weibull", axis, group_by, allow_null)


def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


def covariance_matrix(df: DataFrame, columns: list[str], dof: int = 0, assume_centered: bool = False, group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """(*group_by, row, col, value) of the covariance matrix, in one pass."""
    data = df.select(*group_by, *(strict(c, allow_null).alias(c) for c in columns))
    n = F.count("*").cast("double")
    c = lambda x: F.col(f"`{x}`")
    body = (lambda a, b: F.sum(c(a) * c(b)) / _divisor(n, dof)) if assume_centered else (lambda a, b: F.covar_pop(c(a), c(b)) * n / _divisor(n, dof))
    wide = _grouped(data, group_by).agg(*(body(a, b).alias(f"__{i}") for i, (a, b) in enumerate(_pairs(columns))))
    return _matrix(wide, columns, group_by)


def _matrix(wide, columns, group_by):
    cells = []
    for i, (a, b) in enumerate(_pairs(columns)):
        for r, s in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(r).alias("row"), F.lit(s).alias("col"), F.col(f"__{i}").alias("value")))
    return wide.select(*group_by, F.explode(F.array(*cells)).alias("e")).select(*group_by, "e.*")


def correlation_matrix(df: DataFrame, columns: list[str], group_by: tuple = (), allow_null: bool = False) -> DataFrame:
    """(*group_by, row, col, value); the diagonal is 1, a constant column correlates 0 with all others."""
    data = df.select(*group_by, *(strict(c, allow_null).alias(c) for c in columns))
    c = lambda x: F.col(f"`{x}`")
    body = lambda a, b: F.lit(1.0) if a == b else F.coalesce(F.try_divide(F.covar_pop(c(a), c(b)), F.stddev_pop(c(a)) * F.stddev_pop(c(b))), F.lit(0.0))
    wide = _grouped(data, group_by).agg(F.count("*").alias("__n"), *(body(a, b).alias(f"__{i}") for i, (a, b) in enumerate(_pairs(columns))))
    return _matrix(wide, columns, group_by)


def standardize(
    df: DataFrame, columns: list[str], shift: list[float] | None = None, scale: list[float] | None = None, dof: int = 0, reverse: bool = False, axis: str = "col", allow_null: bool = False
) -> DataFrame:
    """(x - shift) / scale of the columns, or x * scale + shift with reverse; a zero scale counts as 1.

    Without shift and scale the means and standard deviations are used; an all-zero one is computed too."""
    values = [strict(c, allow_null) for c in columns]
    if _axis(axis) == "row":
        n = F.lit(float(len(values)))
        m = _sum(values) / n if not shift or not any(shift) else F.lit(float(shift[0]))
        s = F.sqrt(_row_power(values, 2, m) / _divisor(n, dof)) if not scale or not any(scale) else F.lit(float(scale[0]))
        s = F.when(s == 0, F.lit(1.0)).otherwise(s)
        return df.withColumns({c: x * s + m if reverse else (x - m) / s for c, x in zip(columns, values, strict=True)})
    own_shift = (shift is None and scale is None) or (shift is not None and not any(shift))
    own_scale = (shift is None and scale is None) or (scale is not None and not any(scale))
    if axis == "all":
        stats = _long(df, columns, (), allow_null).agg(F.avg("value").alias("__m"), F.var_pop("value").alias("__v"), F.count("*").alias("__n"))
        stats = stats.select(*(F.col("__m").alias(f"__m{i}") for i in range(len(columns))), *(F.col("__v").alias(f"__v{i}") for i in range(len(columns))), "__n")
    else:
        stats = df.agg(*(F.avg(v).alias(f"__m{i}") for i, v in enumerate(values)), *(F.var_pop(v).alias(f"__v{i}") for i, v in enumerate(values)), F.count("*").alias("__n"))
    both = df.crossJoin(F.broadcast(stats)) if own_shift or own_scale else df  # a single row
    out = {}
    for i, (c, x) in enumerate(zip(columns, values, strict=True)):
        m = F.col(f"__m{i}") if own_shift else F.lit(float(shift[i])) if shift else F.lit(0.0)
        n = F.col("__n").cast("double") if own_scale else None
        spread = F.col(f"__v{i}") + F.pow(F.col(f"__m{i}") - m, F.lit(2.0)) if own_scale else None  # about the shift that is used
        s = F.sqrt(spread * n / _divisor(n, dof)) if own_scale else F.lit(float(scale[i])) if scale else F.lit(1.0)
        s = F.when(s == 0, F.lit(1.0)).otherwise(s)
        out[c] = x * s + m if reverse else (x - m) / s
    return both.withColumns(out).select(df.columns)


def most_frequent(df: DataFrame, column: str, group_by: tuple = ()) -> DataFrame:
    """Classes with their counts, and whether a class is the most frequent (the smallest of a tie)."""
    counts = df.groupBy(*group_by, column).agg(F.count("*").alias("n"))
    top = _grouped(counts, group_by).agg(F.min(F.struct(-F.col("n"), column)).alias("top"))
    both = counts.join(top, list(group_by)) if group_by else counts.crossJoin(F.broadcast(top))  # a single row
    return both.select(*group_by, column, "n", (F.col(f"top.{column}") == F.col(column)).alias("is_mode"))
