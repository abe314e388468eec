"""A table with positional rows, column labels and named, lazily evaluated selections."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.csvio import numbered, read_csv

ROW = "row_id"


class DataStore:
    """Wraps a DataFrame whose rows are numbered from 0 in the order of given columns.

    A selection is the cross product of a set of rows and a set of columns; both grow by union.
    Intervals are 0-based and inclusive. Everything but n_rows and collect stays lazy."""

    def __init__(self, df: DataFrame | None = None, order: list[str] | None = None):
        self.selections: dict[str, dict] = {}
        self.df = self._n = None
        if df is not None:
            self._set(df if ROW in df.columns else numbered(df, order or df.columns))

    def _set(self, df: DataFrame):
        self.df, self._n = df.select(ROW, *[c for c in df.columns if c != ROW]), None

    def _data(self) -> DataFrame:
        if self.df is None:
            raise RuntimeError("the store is empty")
        return self.df

    # loading

    def load_csv(self, spark, path: str, **options) -> DataStore:
        if self.df is not None:
            raise RuntimeError("CSV files load into an empty store only")
        table = read_csv(spark, path, **options)
        self._set(numbered(table, ["__row"]).drop("__row"))
        return self

    def load_columns(self, df: DataFrame, order: list[str]) -> DataStore:
        """Adds columns; the row count must match."""
        new = df if ROW in df.columns else numbered(df, order)
        if self.df is None:
            self._set(new)
        else:
            self.hconcat(DataStore(new))
        return self

    def hconcat(self, other: DataStore) -> DataStore:
        """Columns of both, row by row; the other store is emptied."""
        if self.n_rows() != other.n_rows():
            raise ValueError(f"{self.n_rows()} rows beside {other.n_rows()}")
        if clash := set(self.columns) & set(other.columns):
            raise ValueError(f"columns in both: {', '.join(sorted(clash))}")
        self._set(self._data().join(other._data(), ROW))
        other.df = None
        return self

    def append_rows(self, df: DataFrame, order: list[str]) -> DataStore:
        """Rows of equal names and types, after the present ones."""
        new = numbered(df.select(self.columns), order)
        if [f.dataType for f in new.drop(ROW).schema] != [f.dataType for f in self._data().drop(ROW).schema]:
            raise ValueError("the types of the columns differ")
        self._set(self._data().unionByName(new.withColumn(ROW, F.col(ROW) + F.lit(self.n_rows()))))
        return self

    # shape and labels

    @property
    def columns(self) -> list[str]:
        return [c for c in self._data().columns if c != ROW]

    def n_rows(self) -> int:
        if self._n is None:
            self._n = self._data().count()
        return self._n

    def n_cols(self) -> int:
        return len(self.columns)

    def label_column(self, index: int, label: str):
        self._set(self._data().withColumnRenamed(self.label(index), label))

    def label(self, index: int) -> str:
        if not 0 <= index < self.n_cols():
            raise ValueError(f"no column {index}")
        return self.columns[index]

    def index(self, label: str) -> int:
        if label not in self.columns:
            raise ValueError(f"no column named {label}")
        return self.columns.index(label)

    # selections

    def _selection(self, key: str) -> dict:
        if not key:
            raise ValueError("a selection needs a name")
        return self.selections.setdefault(key, {"cols": set(), "rows": [], "out_cols": set(), "out_rows": [], "full": None})

    def _interval(self, low: int, high: int, n: int):
        if not 0 <= low <= high < n:
            raise ValueError(f"interval [{low}, {high}] outside [0, {n - 1}]")

    def select_columns(self, key: str, low: int, high: int) -> DataStore:
        self._interval(low, high, self.n_cols())
        s = self._selection(key)
        s["cols"] |= set(range(low, high + 1))
        return self

    def select_rows(self, key: str, low: int, high: int) -> DataStore:
        self._interval(low, high, self.n_rows())
        self._selection(key)["rows"].append((low, high))
        return self

    def select_slice(self, key: str, row_low: int, row_high: int, col_low: int, col_high: int) -> DataStore:
        return self.select_rows(key, row_low, row_high).select_columns(key, col_low, col_high)

    def remove_columns(self, key: str, low: int, high: int) -> DataStore:
        self._interval(low, high, self.n_cols())
        self._selection(key)["out_cols"] |= set(range(low, high + 1))
        return self

    def remove_rows(self, key: str, low: int, high: int) -> DataStore:
        self._interval(low, high, self.n_rows())
        self._selection(key)["out_rows"].append((low, high))
        return self

    def select_non_missing(self, key: str, full_rows: bool = True) -> DataStore:
        """Only rows without null or NaN: in any column, or with full_rows off in the selected ones."""
        self._selection(key)["full"] = full_rows
        return self

    def extract(self, key: str) -> DataFrame:
        """row_id and the columns of a selection; an empty row or column part means all of them."""
        df = self._data()
        if key not in self.selections:
            if self.selections:
                raise ValueError(f"no selection named {key}")
            warnings.warn("no selection was defined: the whole store is extracted", UserWarning, stacklevel=2)
            return df
        s = self.selections[key]
        between = lambda spans: F.greatest(*(F.col(ROW).between(a, b).cast("int") for a, b in spans), F.lit(0)) == 1
        names = [c for i, c in enumerate(self.columns) if (not s["cols"] or i in s["cols"]) and i not in s["out_cols"]]
        if s["rows"]:
            df = df.where(between(s["rows"]))
        if s["out_rows"]:
            df = df.where(~between(s["out_rows"]))
        if s["full"] is not None:
            df = drop_missing(df, self.columns if s["full"] else names)
        return df.select(ROW, *names)

    def extract_matrix(self, key: str, limit: int = 1_000_000) -> np.ndarray:
        """A selection as a numpy array in row order, if it has at most `limit` rows."""
        df = self.extract(key)
        rows = df.orderBy(ROW).limit(limit + 1).drop(ROW).toPandas()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rows")
        return rows.to_numpy()

    def extract_column(self, column: int | str) -> DataFrame:
        return self._data().select(ROW, self.label(column) if isinstance(column, int) else self.label(self.index(column)))

    # elements

    def get_element(self, row: int, column: int):
        self._interval(row, row, self.n_rows())
        return self._data().where(F.col(ROW) == row).select(self.label(column)).first()[0]

    def set_element(self, row: int, column: int, value):
        self._interval(row, row, self.n_rows())
        name = self.label(column)
        kind = self._data().schema[name].dataType
        self._set(self._data().withColumn(name, F.when(F.col(ROW) == row, F.lit(value).cast(kind)).otherwise(F.col(f"`{name}`"))))


def _missing(df: DataFrame, column: str):
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[column] in ("double", "float") else c.isNull()


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in the columns (default: all)."""
    for c in columns or df.columns:
        df = df.where(~_missing(df, c))
    return df


def check_data(df: DataFrame, columns: list[str] | None = None) -> None:
    """Raises if any value is null or NaN."""
    columns = columns or df.columns
    bad = df.agg(*(F.max(_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(columns))).first()
    if found := [c for i, c in enumerate(columns) if bad[i]]:
        raise ValueError(f"missing values in {', '.join(found)}")


def transpose(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(column, id, value): the columns as rows, in long form."""
    return df.unpivot(id_col, columns, "column", "value").select("column", F.col(id_col).alias("id"), "value")
