"""Typed, bounded options of the estimators."""

from __future__ import annotations

import functools
import warnings
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Param:
    """One option: its default, the lowest and highest value, or the allowed words.

    inert: why a value other than the default changes nothing here; setting one warns."""

    default: Any
    low: float | None = None
    high: float | None = None
    words: tuple[str, ...] = ()
    open_low: bool = False
    kind: type | tuple | None = None
    inert: str = ""

    def check(self, name: str, value: Any) -> Any:
        if self.inert and value != self.default:
            warnings.warn(f"{name} has no effect: {self.inert}", UserWarning, stacklevel=4)
        if self.words:
            if value is not None:
                value = str(value).lower()
            if value not in self.words:
                raise ValueError(f"{name} must be one of {', '.join(map(str, self.words))}")
            return value
        if self.kind and not isinstance(value, self.kind):
            raise ValueError(f"{name} must be {self.kind}")
        if self.low is not None and (value < self.low or (self.open_low and value == self.low)):
            raise ValueError(f"{name} must be {'above' if self.open_low else 'at least'} {self.low}")
        if self.high is not None and value > self.high:
            raise ValueError(f"{name} must be at most {self.high}")
        return value


MIXED = Param(False, kind=bool, inert="sums and products are in double precision")


def check_finite(df: DataFrame, columns: list[str]) -> None:
    """One pass over the columns, numbers or arrays of them: a null, NaN or infinite value is an error."""
    types = dict(df.dtypes)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    tests = [F.max((F.col(f"`{c}`").isNull() | F.exists(F.col(f"`{c}`"), bad) if types[c].startswith("array") else bad(F.col(f"`{c}`"))).cast("int")).alias(f"b{i}") for i, c in enumerate(columns)]
    told = df.agg(*tests).first() if tests else ()
    if wrong := [c for c, b in zip(columns, told, strict=True) if b]:
        raise ValueError(f"check_data: missing or non-finite values in {', '.join(wrong)}")


def _checked(fn):
    """The training method fn, which first looks at the columns that it is given if check_data is set."""

    @functools.wraps(fn)
    def run(self, df, *args, **options):
        if getattr(self, "check_data", False):
            named = [c for a in (*args, *options.values()) for c in (a if isinstance(a, (list, tuple)) else [a]) if isinstance(c, str) and c in df.columns]
            kinds = dict(df.dtypes)
            named += ["x"] if "x" in df.columns else []
            check_finite(df, [c for c in dict.fromkeys(named) if kinds[c] != "string"])
        return fn(self, df, *args, **options)

    return run


class Configured:
    """Keyword options checked against PARAMS; a change after fit marks the model as out of date."""

    PARAMS: dict[str, Param] = {}

    def __init_subclass__(cls, **options):
        super().__init_subclass__(**options)
        for name in ("fit", "fit_predict", "train", "add"):
            if name in cls.__dict__ and "check_data" in cls.PARAMS:
                setattr(cls, name, _checked(cls.__dict__[name]))

    def __init__(self, **options):
        unknown = options.keys() - self.PARAMS.keys()
        if unknown:
            raise ValueError(f"unknown option: {', '.join(sorted(unknown))}")
        self._set_by = {}
        self.fitted = False
        for name, p in self.PARAMS.items():
            value = options.get(name, p.default)
            object.__setattr__(self, name, value if name not in options else p.check(name, value))
            self._set_by[name] = "user" if name in options else "default"

    def set_params(self, **options):
        for name, value in options.items():
            if name not in self.PARAMS:
                raise ValueError(f"unknown option: {name}")
            setattr(self, name, self.PARAMS[name].check(name, value))
            self._set_by[name] = "user"
        self.fitted = False
        return self

    def get_params(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in self.PARAMS}

    def print_options(self) -> str:
        """One line for each option with its value and who set it."""
        text = "\n".join(f"{name} = {getattr(self, name)!r} ({self._set_by[name]})" for name in sorted(self.PARAMS))
        print(text)
        return text

    def need_fit(self):
        if not self.fitted:
            raise RuntimeError("the model is not fitted, or its options have changed since")
