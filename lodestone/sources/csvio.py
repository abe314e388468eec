"""CSV reading with typed columns, header checks, ragged-row and missing-value rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"integer": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "string": T.StringType()}
#: Rules of the inference ladder, from the narrowest type.
_LADDER = (
    ("integer", r"^[+-]?\d+$"),
    ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"),
    ("boolean", r"^(?i:true|false)$"),
)


def _lines(spark: SparkSession, path: str, terminator: str | None) -> DataFrame:
    """(no, line): the lines of the files with their place in the order of the files.

    Lines are numbered per input partition; the sum of the sizes before (one row for each partition) is joined to them."""
    reader = spark.read.option("lineSep", terminator) if terminator else spark.read
    raw = reader.text(path).select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = raw.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return raw.join(F.broadcast(before), "p").select((F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("no"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_csv(
    spark: SparkSession,
    path: str,
    header: bool = False,
    datatype: str = "auto",
    delimiter: str = ",",
    whitespace: bool = False,
    quote: str = '"',
    escape: str = "\\",
    double_quote: bool = True,
    comment: str | None = "#",
    decimal: str = ".",
    thousands: str | None = None,
    scientific: str = "E",
    skip_initial_space: bool = False,
    skip_empty_lines: bool = True,
    skip_rows: list[int] | None = None,
    row_start: int = 0,
    skip_footer: bool = False,
    terminator: str | None = None,
    missing: str = "error",
) -> DataFrame:
    """A table with the columns named by the header, or c0, c1, ...

    datatype 'auto' finds each column's type: integer, then double, then boolean (the words true and
    false), else string. A forced type makes cells that do not parse an error, or with
    missing='warn' a null. Ragged rows are an error that names the line. A column `__row` (the
    line in the files, from 0) keeps the order."""
    if missing not in ("error", "warn"):
        raise ValueError("missing must be error or warn")
    if datatype != "auto" and datatype not in TYPES:
        raise ValueError(f"datatype must be auto or one of {', '.join(TYPES)}")
    lines = _lines(spark, path, terminator)
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    if skip_empty_lines:
        lines = lines.where(F.trim("line") != "")
    if skip_rows:
        lines = lines.where(~F.col("no").isin([int(x) for x in skip_rows]))
    if row_start:
        lines = lines.where(F.col("no") >= row_start)
    if skip_footer:
        last = lines.agg(F.max("no")).first()[0]
        lines = lines.where(F.col("no") < (last if last is not None else 0))
    if whitespace:
        cells = F.split(F.trim("line"), r"\s+")
    else:
        # cells as regular-expression matches: quoted (doubled or escaped quotes inside) or plain
        q, d, e = re.escape(quote), re.escape(delimiter), re.escape(escape)
        inner = f"(?:{q}{q}|{e}.|[^{q}{e}])*" if double_quote else f"(?:{e}.|[^{q}{e}])*"
        space = " *" if skip_initial_space else ""
        pattern = f"(?:^|{d}){space}({q}{inner}{q}|[^{d}]*)"
        strip = lambda c: F.when(
            (F.length(c) >= 2) & c.startswith(quote) & c.endswith(quote),
            F.regexp_replace(F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), f"{q}{q}" if double_quote else "(?!)", quote.replace("\\", "\\\\")), f"{e}(.)", "$1"),
        ).otherwise(c)
        cells = F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), strip)
    rows = lines.select("no", cells.alias("cells"))
    first = rows.orderBy("no").limit(1).collect()
    if not first:
        raise ValueError(f"{path} holds no rows")
    names = [c.strip() for c in first[0].cells] if header else [f"c{i}" for i in range(len(first[0].cells))]
    width = len(names)
    if header:
        rows = rows.where(F.col("no") != first[0].no)
    def number(c):
        c = F.trim(c)
        if thousands:
            c = F.regexp_replace(c, re.escape(thousands), "")
        if decimal != ".":
            c = F.regexp_replace(c, re.escape(decimal), ".")
        if scientific.upper() != "E":
            c = F.regexp_replace(c, f"(?i){re.escape(scientific)}", "E")
        return c

    at = [F.element_at("cells", i + 1) for i in range(width)]
    # one pass for the first ragged row and the types
    ragged = F.min(F.when(F.size("cells") != width, F.struct("no", F.size("cells").alias("n")))).alias("ragged")
    tests = [F.min(number(F.try_element_at("cells", F.lit(i + 1))).rlike(rule)).alias(f"{kind}{i}") for i in range(width) for kind, rule in _LADDER] if datatype == "auto" else []
    told = rows.agg(ragged, *tests).first()
    if told.ragged:
        raise ValueError(f"line {told.ragged.no + 1} has {told.ragged.n} cells, expected {width}")
    kinds = [next((kind for kind, _ in _LADDER if told[f"{kind}{i}"]), "string") if datatype == "auto" else datatype for i in range(width)]
    out = []
    for name, c, kind in zip(names, at, kinds, strict=True):
        if kind == "string":
            value = c
        elif kind == "boolean":
            word = F.lower(F.trim(c))
            value = F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))
        else:
            value = number(c).try_cast(TYPES[kind])
        if kind != "string" and missing == "error":
            value = F.coalesce(value, F.raise_error(F.concat(F.lit(f"column {name}: no {kind} in cell '"), c, F.lit("'"))).cast(TYPES[kind]))
        out.append(value.alias(name))
    return rows.select(F.col("no").alias("__row"), *out)


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive row numbers from 0 in the given order, without one task for all rows.

    Rows are range-partitioned; each range is numbered on its own and shifted by the sizes of those before."""
    from lodestone.sources.staging import stage

    dealt = stage(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__before"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + rank - 1).cast("long")).drop("__p", "__before")
