"""Saving and loading fitted models: a folder with one row of metadata and one of content, as Parquet."""

from __future__ import annotations

import base64
import importlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FORMAT, OLDEST = 1, 1


def _plain(value):
    if isinstance(value, np.ndarray):
        if value.dtype == object:
            return {"__list": [_plain(v) for v in value.tolist()]}
        return {"__array": base64.b64encode(np.ascontiguousarray(value).tobytes()).decode(), "dtype": value.dtype.str, "shape": list(value.shape)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, dict):
        return {"__pairs": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if isinstance(value, tuple):
        return {"__tuple": [_plain(v) for v in value]}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise ValueError(f"a model cannot be saved with a {type(value).__name__}")


def _rich(value):
    if isinstance(value, list):
        return [_rich(v) for v in value]
    if isinstance(value, dict):
        if "__array" in value:
            return np.frombuffer(base64.b64decode(value["__array"]), value["dtype"]).reshape(value["shape"]).copy()
        if "__pairs" in value:
            return {_rich(k): _rich(v) for k, v in value["__pairs"]}
        if "__tuple" in value:
            return tuple(_rich(v) for v in value["__tuple"])
        return np.array(_rich(value["__list"]), object)
    return value


def save_model(model, spark: SparkSession, path: str) -> None:
    """Writes options, fitted values and versions. Tables of a model (its DataFrames) lie beside them."""
    model.need_fit()
    import lodestone

    kind = type(model)
    tables = {k: v for k, v in vars(model).items() if isinstance(v, DataFrame)}
    state = {k: _plain(v) for k, v in vars(model).items() if k not in tables}
    meta = {"format": FORMAT, "module": kind.__module__, "model": kind.__name__, "precision": "double", "library": lodestone.__version__, "tables": sorted(tables)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/table_{name}")


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: what a saved model is, without loading it."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
    return spark.createDataFrame([(meta["model"], meta["format"], meta["precision"], meta["library"])], "model string, format int, precision string, library string")


def load_model(spark: SparkSession, path: str):
    meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
    if not OLDEST <= meta["format"] <= FORMAT:
        raise ValueError(f"model format {meta['format']} is not readable: {OLDEST} to {FORMAT}")
    if meta["precision"] != "double" or not meta["module"].startswith("lodestone."):
        raise ValueError("not a model of this library")
    model = getattr(importlib.import_module(meta["module"]), meta["model"])()
    for k, v in json.loads(spark.read.parquet(f"{path}/state").first().state).items():
        object.__setattr__(model, k, _rich(v))
    for name in meta["tables"]:
        object.__setattr__(model, name, spark.read.parquet(f"{path}/table_{name}"))
    return model
