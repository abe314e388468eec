"""Train and test splits, plain or stratified, without collecting rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.csvio import numbered


def split_sizes(n: int, test_size: float | int | None = None, train_size: float | int | None = None) -> tuple[int, int]:
    """Rows for training and for testing: shares are floored for training and ceiled for testing; default 0.75 and 0.25."""

    def rows(size, up):
        if isinstance(size, float):
            if not 0 < size < 1:
                raise ValueError("a share must lie between 0 and 1")
            return math.ceil(size * n) if up else math.floor(size * n)
        if not 0 < size < n:
            raise ValueError(f"a size must lie between 0 and {n}")
        return size

    if test_size is None and train_size is None:
        test_size = 0.25
    test = rows(test_size, True) if test_size is not None else n - rows(train_size, False)
    train = rows(train_size, False) if train_size is not None else n - test
    if train < 1 or test < 1 or train + test > n:
        raise ValueError(f"{train} training and {test} test rows of {n}")
    return train, test


def _allocate(counts: dict, size: int) -> dict:
    """Rows of each class: the floor of its share, the rest to the largest remainders (ties to the smaller class)."""
    n = sum(counts.values())
    exact = {c: k * size / n for c, k in counts.items()}
    out = {c: min(counts[c], math.floor(v)) for c, v in exact.items()}
    for c in sorted(counts, key=lambda c: (-(exact[c] - math.floor(exact[c])), c))[: size - sum(out.values())]:
        out[c] += 1
    return out


def train_test_split(
    df: DataFrame, id_col: str, test_size=None, train_size=None, seed: int = 0, shuffle: bool = True, stratify: str | None = None, fp_precision: int = 1000
) -> DataFrame:
    """The rows with a column `part`: train, test or null (in neither).

    The order is that of an md5 of seed and id (shuffle) or of the id; training rows come first.
    Stratified splits need two rows of each class and a row of each class on both sides; floating
    labels are scaled by fp_precision and truncated."""
    n = df.count()
    train, test = split_sizes(n, test_size, train_size)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))) if shuffle else F.col(id_col)
    if stratify is None:
        ranked = numbered(df.withColumn("__key", key), ["__key", id_col], "__at")
        part = F.when(F.col("__at") < train, "train").when(F.col("__at") < train + test, "test")
        return ranked.withColumn("part", part).drop("__key", "__at")
    if not shuffle:
        raise ValueError("a stratified split needs shuffle")
    label = F.col(stratify)
    if dict(df.dtypes)[stratify] in ("double", "float"):
        label = (label * fp_precision).cast("long")
    counts = {r[0]: r[1] for r in df.groupBy(label.alias("c")).agg(F.count("*")).collect()}  # a row for each class
    if min(counts.values()) < 2:
        raise ValueError("a class has fewer than two rows")
    if min(train, test) < len(counts):
        raise ValueError("fewer rows than classes on one side")
    first = _allocate(counts, train)
    second = _allocate({c: counts[c] - first[c] for c in counts}, test)
    table = df.sparkSession.createDataFrame([(c, first[c], second[c]) for c in counts], df.select(label.alias("__label")).schema.simpleString()[7:-1] + ", __train long, __test long")
    # numbered per class: ranges of (class, key), shifted to the class's first row
    ranked = numbered(df.withColumn("__label", label).withColumn("__key", key), ["__label", "__key", id_col], "__at")
    start = ranked.groupBy("__label").agg(F.min("__at").alias("__start"))
    both = ranked.join(F.broadcast(table.join(start, "__label")), "__label")  # a row for each class
    at = F.col("__at") - F.col("__start")
    part = F.when(at < F.col("__train"), "train").when(at < F.col("__train") + F.col("__test"), "test")
    return both.withColumn("part", part).select(*df.columns, "part")
