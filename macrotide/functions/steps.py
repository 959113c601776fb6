"""Time-series steps, compiled to window columns over the rows of each series.

A step sees only the rows it is given (the observations, in strict mode). Results that
are missing are null, never NaN; a change against a zero base is infinite, as in pandas.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series_window() -> WindowSpec:
    return Window.partitionBy("series_code").orderBy("date")


def finite(v: Column) -> Column:
    return F.when(F.abs(v) < math.inf, v)


def relative_change(v: Column, base: Column) -> Column:
    at_zero = F.when(v != 0, F.signum(v) * F.lit(math.inf))
    return F.when(base == 0, at_zero).otherwise(v / F.when(base != 0, base) - 1)


def _positive(name: str, value, least: int = 1) -> None:
    if not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of {least} or more, not {value!r}")


@dataclass(frozen=True)
class Step:
    """One step of a chain; ``named`` lists the parameters that show in feature names."""

    label = ""
    native = True

    def column(self, v: Column, w: WindowSpec) -> Column:
        raise NotImplementedError

    def suffix(self) -> str:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return "_".join([self.label, *(f"{values[n]:g}" for n in ("window", "periods", "span", "halflife") if values.get(n) is not None)])


@dataclass(frozen=True)
class Level(Step):
    label = "level"

    def column(self, v, w):
        return v


@dataclass(frozen=True)
class Diff(Step):
    periods: int
    label = "diff"

    def __post_init__(self):
        _positive("periods", self.periods)

    def column(self, v, w):
        return v - F.lag(v, self.periods).over(w)


@dataclass(frozen=True)
class PctChange(Step):
    periods: int = 1
    label = "pctchange"

    def __post_init__(self):
        _positive("periods", self.periods)

    def column(self, v, w):
        return relative_change(v, F.lag(v, self.periods).over(w))


@dataclass(frozen=True)
class YoY(Step):
    periods: int = 252
    method: str = "pct_change"
    label = "yoy"

    def __post_init__(self):
        _positive("periods", self.periods)
        if self.method not in ("pct_change", "diff"):
            raise ValueError(f"method must be pct_change or diff, not {self.method!r}")

    def column(self, v, w):
        base = F.lag(v, self.periods).over(w)
        return relative_change(v, base) if self.method == "pct_change" else v - base


@dataclass(frozen=True)
class Returns(Step):
    method: str = "log"
    periods: int = 1
    label = "returns"

    def __post_init__(self):
        _positive("periods", self.periods)
        if self.method not in ("log", "simple"):
            raise ValueError(f"method must be log or simple, not {self.method!r}")

    def column(self, v, w):
        base = F.lag(v, self.periods).over(w)
        if self.method == "simple":
            return relative_change(v, base)
        ratio = v / F.when(base != 0, base)
        return F.when(ratio > 0, F.ln(ratio)).when(ratio == 0, F.lit(-math.inf)).when((base == 0) & (v > 0), F.lit(math.inf))


@dataclass(frozen=True)
class _Rolling(Step):
    window: int

    def __post_init__(self):
        _positive("window", self.window)

    def _full(self, v, w, value):
        over = w.rowsBetween(1 - self.window, 0)
        x = finite(v)
        return F.when(F.count(x).over(over) == self.window, value(x, over))


@dataclass(frozen=True)
class MovingAverage(_Rolling):
    label = "movingaverage"

    def column(self, v, w):
        return self._full(v, w, lambda x, over: F.avg(x).over(over))


@dataclass(frozen=True)
class RollingStd(_Rolling):
    label = "rollingstd"

    def column(self, v, w):
        return self._full(v, w, lambda x, over: F.stddev_samp(x).over(over))


@dataclass(frozen=True)
class ZScore(_Rolling):
    label = "zscore"

    def column(self, v, w):
        def value(x, over):
            deviation = F.stddev_samp(x).over(over)
            return (v - F.avg(x).over(over)) / F.when(deviation != 0, deviation)

        return self._full(v, w, value)


@dataclass(frozen=True)
class Ema(Step):
    """Exponential mean with weights (1 - alpha)**age over all rows so far; missing ones age the others and add nothing. It is a recurrence, which chains compile to a scan."""

    span: float | None = None
    halflife: float | None = None
    label = "ema"
    native = False

    def __post_init__(self):
        if not self.span and not self.halflife:
            raise ValueError("span or halflife is needed")

    def alpha(self) -> float:
        return 2 / (self.span + 1) if self.span else 1 - math.exp(-math.log(2) / self.halflife)
