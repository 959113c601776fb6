"""The chain language: registry, parser, feature names, and the compiler to DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import steps as S
from ..functions.steps import Step, series_window
from ..operators import scan

STRICT, IGNORE, WEIGHTED = "strict", "ignore", "weighted"


def _normal(name: str) -> str:
    return name.strip().lower().replace("-", "_")


class Registry:
    """Step classes by name."""

    def __init__(self):
        self._steps: dict[str, Callable[..., Step]] = {}

    def register(self, name: str, build: Callable[..., Step]) -> None:
        self._steps[_normal(name)] = build

    def get(self, name: str) -> Callable[..., Step]:
        try:
            return self._steps[_normal(name)]
        except KeyError:
            raise ValueError(f"unknown transform {name!r}; there are {', '.join(self.names())}") from None

    def names(self) -> list[str]:
        return sorted(self._steps)

    def create(self, name: str, **params) -> Step:
        return self.get(name)(**params)


REGISTRY = Registry()
for _names, _build in (
    (("level",), S.Level),
    (("diff", "difference"), S.Diff),
    (("pct_change", "pct"), S.PctChange),
    (("yoy",), S.YoY),
    (("returns",), S.Returns),
    (("ma", "moving_average", "sma"), S.MovingAverage),
    (("ema", "ewm"), S.Ema),
    (("std", "rolling_std"), S.RollingStd),
    (("z_score", "zscore"), S.ZScore),
):
    for _name in _names:
        REGISTRY.register(_name, _build)


def parse_step(item) -> Step:
    """A step is a name, or a dictionary of one name and its parameters (or null)."""
    if isinstance(item, str):
        return REGISTRY.create(item)
    if isinstance(item, dict) and len(item) == 1:
        ((name, params),) = item.items()
        if params is None or isinstance(params, dict):
            return REGISTRY.create(name, **(params or {}))
    raise ValueError(f"not a step: {item!r}")


def parse_chain(items: list) -> tuple[Step, ...]:
    if not isinstance(items, list) or not items:
        raise ValueError(f"a chain is a list of at least one step, not {items!r}")
    return tuple(parse_step(x) for x in items)


def parse_config(config: dict) -> dict[str, list[tuple[Step, ...]]]:
    """Chains by series id from a configuration with series.{name}.{id, transforms}, by itself or below ``regime_universe``."""
    config = config.get("regime_universe", config)
    return {s["id"]: [parse_chain(c) for c in s.get("transforms", [])] for s in config["series"].values()}


def frequencies(config: dict) -> dict[str, str]:
    config = config.get("regime_universe", config)
    return {s["id"]: s.get("frequency", "daily") for s in config["series"].values()}


def feature_name(series: str, chain: tuple[Step, ...]) -> str:
    return "_".join([series, *(s.suffix() for s in chain)])


def feature_names(chains: dict[str, list[tuple[Step, ...]]]) -> list[str]:
    """All names; two chains with one name are an error, since one would hide the other."""
    names = [feature_name(s, c) for s, cs in chains.items() for c in cs]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"chains share the names {', '.join(twice)}")
    return names


def _decayed(source: str, keep: float) -> scan.Scan:
    """Sum and weight of the values so far, each row's worth ``keep`` times what it was at the next one."""

    def lift(row):
        v = row[source].cast("double")
        return F.struct(F.lit(keep).alias("decay"), F.coalesce(v, F.lit(0.0)).alias("sum"), v.isNotNull().cast("double").alias("weight"))

    def combine(a, b):
        return F.struct((a["decay"] * b["decay"]).alias("decay"), (a["sum"] * b["decay"] + b["sum"]).alias("sum"), (a["weight"] * b["decay"] + b["weight"]).alias("weight"))

    def apply(state, e):
        return F.struct(*((F.coalesce(state[c], F.lit(0.0)) * e["decay"] + e[c]).alias(c) for c in ("sum", "weight")))

    return scan.Scan(lift, combine, apply, "struct<sum:double,weight:double>")


def _apply(df: DataFrame, source: str, target: str, step: Step, fill: bool) -> DataFrame:
    w = series_window()
    if step.native:
        df = df.withColumn(target, step.column(F.col(source), w))
    else:
        passed = scan.states(df, ["date"], _decayed(source, 1 - step.alpha()), ["series_code"])
        mean = F.col("_after.sum") / F.when(F.col("_after.weight") > 0, F.col("_after.weight"))
        df = passed.withColumn(target, F.when(~F.isnan(mean), mean)).drop("_before", "_after")
    if fill:
        df = df.withColumn(target, F.last(target, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df


def transform(df: DataFrame, chains: dict[str, list[tuple[Step, ...]]] | list[tuple[Step, ...]], mode: str = STRICT) -> DataFrame:
    """(series_code, date, feature, value) of chains over aligned rows (series_code, date, value, is_new_data).

    Strict: steps see the rows with new data only, missing results take the last one
    before, and the rows between repeat it. Ignore: steps see all rows. Weighted is the
    same as ignore. Chains share the columns of equal first steps. With a dictionary each
    series has its own chains; with a list all have the same.
    """
    if mode not in (STRICT, IGNORE, WEIGHTED):
        raise ValueError(f"unknown mode {mode!r}")
    strict = mode == STRICT
    if strict and "is_new_data" not in df.columns:
        raise ValueError("strict mode needs is_new_data")
    todo = chains.items() if isinstance(chains, dict) else [(None, chains)]
    rows = df.select("series_code", "date", "value", *(["is_new_data"] if strict else []))
    if isinstance(chains, dict):
        rows = rows.filter(F.col("series_code").isin(list(chains)))
    seen = rows.filter("is_new_data").drop("is_new_data") if strict else rows
    made: dict[tuple[Step, ...], str] = {(): "value"}
    for _, own in todo:
        for chain in own:
            for k in range(1, len(chain) + 1):
                if chain[:k] not in made:
                    made[chain[:k]] = f"_{len(made)}"
                    seen = _apply(seen, made[chain[: k - 1]], made[chain[:k]], chain[k - 1], strict)
    columns = list(dict.fromkeys(made[c] for _, own in todo for c in own))
    if strict:  # back to all rows once, at the end
        w = series_window().rowsBetween(Window.unboundedPreceding, 0)
        kept = seen.select("series_code", "date", *(F.col(c).alias(f"v{c}") for c in columns))
        wide = rows.select("series_code", "date").join(kept, ["series_code", "date"], "left")
        wide = wide.select("series_code", "date", *(F.last(f"v{c}", ignorenulls=True).over(w).alias(c) for c in columns))
    else:
        wide = seen.select("series_code", "date", *columns)
    parts = []
    for series, own in todo:
        for chain in own:
            name = F.lit(feature_name(series, chain)) if series else F.concat(F.col("series_code"), F.lit("_" + "_".join(s.suffix() for s in chain)))
            here = F.struct(name.alias("feature"), F.col(made[chain]).cast("double").alias("value"))
            parts.append(F.when(F.col("series_code") == series, here) if series else here)
    each = F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")
    return wide.select("series_code", "date", each).select("series_code", "date", "x.feature", "x.value")


def feature_matrix(features: DataFrame, names: list[str]) -> DataFrame:
    """Wide table (date, one column per feature)."""
    return features.groupBy("date").pivot("feature", names).agg(F.first("value"))
