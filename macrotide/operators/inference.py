"""Inference of hidden-Markov regimes along a sequence, as scans over blocks of rows.

A row is an operator on the regimes: probabilities before it times the transitions times the emission densities of
the row. Operators of blocks are products (for the best path: sums and maxima) of small matrices, so a sequence is dealt
over tasks (see ``scan``). A matrix has a row for the start of the sequence, in which the start probabilities stand in
for the transitions, and one for each regime; it is a flat array, scaled to a largest entry of 1, with the log of the scale beside it.

Rows with a null feature or a null date are left out. Entities are sequences of their own, a null entity is one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.handover import discard, written
from . import scan
from .scan import once
from .hmm import Params

_TINY = 1e-300


def _at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def log_densities(values: Sequence[Column], params: Params) -> Column:
    """The log density of a row's values under each regime, as an array."""
    _, _, means, covars = params.arrays()
    d, out = len(values), []
    for m, c in zip(means, covars, strict=True):
        low = np.linalg.cholesky(c)
        inverse = np.linalg.inv(low)
        z = [_sum([(values[j] - float(m[j])) * float(inverse[i, j]) for j in range(i + 1)]) for i in range(d)]
        constant = -0.5 * d * math.log(2 * math.pi) - float(np.log(np.diag(low)).sum())
        out.append(constant - 0.5 * _sum([x * x for x in z]))
    return F.array(*out)


def _rows_of(wide: DataFrame, columns: Sequence[str], key: str | None, *more: Column) -> DataFrame:
    entity = F.col(key).cast("string") if key else F.lit("")
    return wide.dropna("any", subset=["date", *columns]).select(entity.alias("entity"), "date", *more)


def observed(wide: DataFrame, columns: Sequence[str], params: Params, key: str | None = None) -> DataFrame:
    """(entity, date, logb): the rows that take part, with their log densities; without a key all are one sequence."""
    return _rows_of(wide, columns, key, log_densities([F.col(f"`{c}`") for c in columns], params).alias("logb"))


def _scaled(m: Column, log: Column) -> Column:
    top = F.greatest(F.array_max(m), F.lit(_TINY))
    return F.struct(F.transform(m, lambda x: x / top).alias("m"), (log + F.ln(top)).alias("log"))


class Forward:
    """Sums over paths: filtered probabilities and the likelihood."""

    state = "struct<m:array<double>,log:double>"

    def __init__(self, params: Params, logb=lambda row: row["logb"]):
        pi, a, *_ = params.arrays()
        self.k, self.logb = len(pi), logb
        self.rows = np.vstack([pi, a])  # the start, then each regime

    def lift(self, row: Column) -> Column:
        def of(logb):
            top = F.array_max(logb)
            b = F.transform(logb, lambda x: F.exp(x - top))
            return once(b, lambda e: _scaled(F.array(*(_at(e, j) * float(self.rows[i, j]) for i in range(self.k + 1) for j in range(self.k))), top))

        return once(self.logb(row), of)

    def _product(self, left, rows: range, b: Column) -> list[Column]:
        """Rows of left (functions of a regime) times the regimes' rows of b."""
        k = self.k
        return [_sum([left(r, i) * _at(b["m"], (i + 1) * k + j) for i in range(k)]) for r in rows for j in range(k)]

    def combine(self, a: Column, b: Column) -> Column:
        product = F.array(*self._product(lambda r, i: _at(a["m"], r * self.k + i), range(self.k + 1), b))
        return once(product, lambda m: _scaled(m, a["log"] + b["log"]))

    def apply(self, state: Column, element: Column) -> Column:
        first = F.slice(element["m"], 1, self.k)
        later = F.array(*self._product(lambda _, i: _at(state["m"], i), range(1), element))
        log = F.coalesce(state["log"], F.lit(0.0)) + element["log"]
        return once(F.when(state.isNull(), first).otherwise(later), lambda m: _scaled(m, log))

    def scan(self) -> scan.Scan:
        return scan.Scan(self.lift, self.combine, self.apply, self.state)


class Backward(Forward):
    """The same elements from the end: what the later rows say of each regime, up to a scale."""

    def combine(self, a: Column, b: Column) -> Column:
        return super().combine(b, a)  # b is the earlier one

    def apply(self, state: Column, element: Column) -> Column:
        k = self.k
        # what stands at the end of the sequence says nothing: ones
        later = [_sum([_at(element["m"], (i + 1) * k + j) * F.coalesce(_at(state["m"], j), F.lit(1.0)) for j in range(k)]) for i in range(k)]
        return once(F.array(*later), lambda m: _scaled(m, F.lit(0.0)))


def _shares(m: Column) -> Column:
    total = F.greatest(F.aggregate(m, F.lit(0.0), lambda a, x: a + x), F.lit(_TINY))
    return F.transform(m, lambda x: x / total)


def smooth(rows: DataFrame, params: Params) -> DataFrame:
    """(entity, date, filtered, smoothed) of ``observed`` rows; a written table.

    filtered: the regimes' probabilities given the rows so far; smoothed: given all rows. The elements of the blocks are made once
    and scanned both ways.
    """
    ahead, back = Forward(params).scan(), Backward(params).scan()
    cut = scan.blocks(rows, ["date"], ["entity"])
    found = scan.elements(cut, ahead)
    starts, ends = scan.borders(found, ahead), scan.borders(found, back, backwards=True)
    both = cut.join(starts, list(scan.AT)).join(ends.withColumnRenamed("border", "end"), list(scan.AT))
    both = scan.walked(both, F.col("_rows"), ahead.lift, F.col("border"), ahead, "ahead")
    both = scan.walked(both, F.reverse("_rows"), back.lift, F.col("end"), back, "back")
    met = F.zip_with("ahead", F.reverse("back"), lambda f, b: F.struct(f["item"].alias("row"), f["after"]["m"].alias("f"), b["before"]["m"].alias("b")))
    fields = lambda x: {"entity": x["row"]["entity"], "date": x["row"]["date"], "f": x["f"], "b": x["b"]}
    each = both.select(scan.spread(met, fields))
    post = F.when(F.col("b").isNull(), F.col("f")).otherwise(F.zip_with("f", "b", lambda f, b: f * b))
    result = written(each.select("entity", "date", _shares(F.col("f")).alias("filtered"), _shares(post).alias("smoothed")))
    discard(cut, found, starts, ends)
    return result


def filtered(rows: DataFrame, params: Params) -> DataFrame:
    """(entity, date, filtered) of ``observed`` rows: the regimes' probabilities given the rows so far. A written table."""
    passed = scan.states(rows, ["date"], Forward(params).scan(), ["entity"])
    return passed.select("entity", "date", _shares(F.col("_after.m")).alias("filtered"))


def forecast(rows: DataFrame, params: Params, steps: int) -> DataFrame:
    """(entity, date, forecast): the regimes' probabilities ``steps`` rows later, from the filtered ones."""
    ahead = np.linalg.matrix_power(params.arrays()[1], steps)
    k = len(ahead)
    later = F.array(*(_sum([_at(F.col("filtered"), i) * float(ahead[i, j]) for i in range(k)]) for j in range(k)))
    return filtered(rows, params).select("entity", "date", later.alias("forecast"))


def score(rows: DataFrame, params: Params) -> DataFrame:
    """(entity, n_rows, log_likelihood) of ``observed`` rows: each entity's block products, multiplied out."""
    cut = scan.blocks(rows, ["date"], ["entity"])
    whole = scan.folded(cut, Forward(params).scan())
    mass = F.aggregate(F.slice(F.col("element.m"), 1, len(params.startprob)), F.lit(0.0), lambda a, x: a + x)
    n = cut.groupBy("_key").agg(F.sum(F.size("_rows")).cast("long").alias("n_rows"))
    result = written(whole.join(n, "_key").select("_key.entity", "n_rows", (F.ln(F.greatest(mass, F.lit(_TINY))) + F.col("element.log")).alias("log_likelihood")))
    discard(cut)
    return result


class _Best(Forward):
    """Maxima over paths, in logs: the best path's log probability by last regime."""

    state = "array<double>"

    def __init__(self, params: Params):
        super().__init__(params)
        self.logs = np.log(np.maximum(self.rows, _TINY))

    def lift(self, row: Column) -> Column:
        return F.array(*(_at(row["logb"], j) + float(self.logs[i, j]) for i in range(self.k + 1) for j in range(self.k)))

    def combine(self, a: Column, b: Column) -> Column:
        k = self.k
        return F.array(*(F.greatest(*(_at(a, r * k + i) + _at(b, (i + 1) * k + j) for i in range(k))) if k > 1 else _at(a, r) + _at(b, 1) for r in range(k + 1) for j in range(k)))

    def apply(self, state: Column, element: Column) -> Column:
        k = self.k
        later = F.array(*(F.greatest(*(_at(state, i) + _at(element, (i + 1) * k + j) for i in range(k))) if k > 1 else _at(state, 0) + _at(element, 1) for j in range(k)))
        return F.when(state.isNull(), F.slice(element, 1, k)).otherwise(later)

    def origins(self, state: Column) -> Column:
        """For each regime, the one before it on the best path there, given the state before the row; the first one of equals."""
        each = (F.array(*(_at(state, i) + float(self.logs[i + 1, j]) for i in range(self.k))) for j in range(self.k))
        return F.array(*((F.array_position(x, F.array_max(x)) - 1).cast("int") for x in each))


def best_path(rows: DataFrame, params: Params) -> DataFrame:
    """(entity, date, state): the most probable path of ``observed`` rows. A written table.

    Three passes over the blocks: their elements; then, from the state at each border, the map from the regime at a block's
    end to the one at its start; then, from the regime at each end (a scan of the maps, from the last block back), the path within the block.
    """
    best = _Best(params)
    ahead = best.scan()
    cut = scan.blocks(rows, ["date"], ["entity"])
    found = scan.elements(cut, ahead)
    starts = scan.borders(found, ahead)
    steps = written(scan.walked(cut.join(starts, list(scan.AT)), F.col("_rows"), ahead.lift, F.col("border"), ahead, "steps").select(*scan.AT, "steps"))
    # the regimes before each row, by the regime at it; before the first row of a sequence there is none
    origins = F.transform("steps", lambda x: F.struct(x["item"]["entity"].alias("entity"), x["item"]["date"].alias("date"), best.origins(x["before"]).alias("from")))
    end = once(F.element_at("steps", -1)["after"], lambda after: (F.array_position(after, F.array_max(after)) - 1).cast("int"))
    placed = written(steps.select(*scan.AT, origins.alias("steps"), end.alias("best")))
    same = F.array(*(F.lit(i) for i in range(best.k)))
    through = F.aggregate("steps", same, lambda acc, step: _composed(acc, step["from"]))
    maps = written(placed.select(*scan.AT, F.struct(through.alias("to"), "best").alias("element")))
    # from the end: a null state is the end of the sequence, where the best regime stands
    back = scan.Scan(lambda x: x, lambda a, b: F.struct(_composed(b["to"], a["to"]).alias("to"), a["best"].alias("best")), lambda s, e: F.get(e["to"], F.coalesce(s, e["best"])), "int")
    ends = scan.borders(maps, back, backwards=True)
    # backwards through the block: the regime at each row, beginning with its last one
    above = scan.Scan(lambda x: x["from"], _composed_back, lambda s, e: F.get(e, s), "int")
    whole = placed.join(ends, list(scan.AT)).withColumn("last", F.coalesce("border", "best"))
    fields = lambda x: {"entity": x["item"]["entity"], "date": x["item"]["date"], "state": x["before"]}
    path = scan.walked(whole, F.reverse("steps"), above.lift, F.col("last"), above, "path")
    result = written(path.select(scan.spread("path", fields)))
    discard(cut, found, starts, steps, placed, maps, ends)
    return result


def _composed_back(later: Column, earlier: Column) -> Column:
    return _composed(earlier, later)


def _composed(outer: Column, inner: Column) -> Column:
    """The map that looks its argument up in ``inner``, and the result in ``outer``."""
    return F.transform(inner, lambda j: F.get(outer, j))


# fitting


def _expected(cut: DataFrame, d: int, params: Params) -> dict[str, float]:
    """What a round of Baum-Welch needs, from blocks of rows (entity, date, x): sums over all rows, in one aggregate.

    Per regime: its mass, the values less its mean weighted by it, and their products; per pair of regimes the expected moves; the mass
    at the sequences' starts; the log-likelihood, which is what each row adds to it.
    """
    k, means = len(params.startprob), params.arrays()[2]
    logb = lambda row: log_densities([_at(row["x"], j) for j in range(d)], params)
    ahead, back = Forward(params, logb).scan(), Backward(params, logb).scan()
    found = scan.elements(cut, ahead)
    starts, ends = scan.borders(found, ahead), scan.borders(found, back, backwards=True)
    both = cut.join(starts, list(scan.AT)).join(ends.withColumnRenamed("border", "end"), list(scan.AT))
    both = scan.walked(both, F.col("_rows"), ahead.lift, F.col("border"), ahead, "ahead")
    both = scan.walked(both, F.reverse("_rows"), back.lift, F.col("end"), back, "back")
    met = F.zip_with("ahead", F.reverse("back"), lambda f, b: F.struct(f["item"]["x"].alias("x"), f["before"].alias("before"), f["after"].alias("after"), ahead.lift(f["item"])["m"].alias("m"), b["before"]["m"].alias("beta")))
    rows = both.select(scan.spread(met, lambda r: {c: r[c] for c in ("x", "before", "after", "m", "beta")}))
    beta = [F.coalesce(_at(F.col("beta"), j), F.lit(1.0)) for j in range(k)]
    so_far = lambda state: F.col(f"{state}.log") + F.ln(F.greatest(F.aggregate(f"{state}.m", F.lit(0.0), lambda a, x: a + x), F.lit(_TINY)))
    moves = F.array(*(_at(F.col("before.m"), i) * _at(F.col("m"), (i + 1) * k + j) * beta[j] for i in range(k) for j in range(k)))
    rows = rows.select("x", _shares(F.array(*(_at(F.col("after.m"), j) * beta[j] for j in range(k)))).alias("p"), _shares(moves).alias("moves"), F.col("before").isNull().alias("first"), (so_far("after") - F.coalesce(so_far("before"), F.lit(0.0))).alias("gain"))
    p, c = [_at(F.col("p"), j) for j in range(k)], lambda j, i: _at(F.col("x"), i) - float(means[j][i])
    sums = {"log_likelihood": F.sum("gain")}
    for j in range(k):
        sums |= {f"n_{j}": F.sum(p[j]), f"first_{j}": F.sum(F.when(F.col("first"), p[j]))}
        sums |= {f"x_{j}_{i}": F.sum(p[j] * c(j, i)) for i in range(d)} | {f"xx_{j}_{i}_{h}": F.sum(p[j] * c(j, i) * c(j, h)) for i in range(d) for h in range(i + 1)}
        sums |= {f"a_{j}_{i}": F.sum(F.when(~F.col("first"), _at(F.col("moves"), j * k + i))) for i in range(k)}
    one = rows.agg(*(v.alias(name) for name, v in sums.items())).first().asDict()
    discard(found, starts, ends)
    return {name: 0.0 if v is None else v for name, v in one.items()}


def _improved(e: dict[str, float], d: int, params: Params, prior: float, diagonal: bool) -> Params:
    _, a, means, covars = params.arrays()
    k = len(means)
    first, moves = np.array([e[f"first_{j}"] for j in range(k)]), np.array([[e[f"a_{i}_{j}"] for j in range(k)] for i in range(k)])
    after = moves.sum(1, keepdims=True)
    a = np.where(after > 0, moves / np.maximum(after, _TINY), a)
    for j in range(k):
        n = max(e[f"n_{j}"], 1e-12)
        shift = np.array([e[f"x_{j}_{i}"] for i in range(d)]) / n
        spread = np.array([[e[f"xx_{j}_{max(i, h)}_{min(i, h)}"] for h in range(d)] for i in range(d)])
        covars[j] = (prior * np.eye(d) + spread) / n - np.outer(shift, shift)
        if diagonal:
            covars[j] = np.diag(np.diag(covars[j]))
        means[j] += shift
    return Params((first / first.sum()).tolist(), a.tolist(), means.tolist(), covars.tolist())


def fit(wide: DataFrame, columns: Sequence[str], start: Params, n_iter: int = 100, tol: float = 1e-2, prior: float = 1e-2, diagonal: bool = False, key: str | None = None) -> tuple[Params, list[float]]:
    """Baum-Welch over sequences of any length, and the log-likelihood before each round: until a round gains less than ``tol``.

    The rows are dealt into blocks once; each round scans them both ways and brings one row of sums to the driver.
    """
    cut = scan.blocks(_rows_of(wide, columns, key, F.array(*(F.col(f"`{c}`").cast("double") for c in columns)).alias("x")), ["date"], ["entity"])
    if cut.isEmpty():
        discard(cut)
        raise ValueError("no row without a missing feature")
    params, history = start, []
    for _ in range(n_iter):
        e = _expected(cut, len(columns), params)
        history.append(e["log_likelihood"])
        if len(history) > 1 and history[-1] - history[-2] < tol:
            break
        params = _improved(e, len(columns), params, prior, diagonal)
    discard(cut)
    return params, history
