"""Sanity of transition matrices, as array functions: one row holds a matrix, however many rows there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squarings after which powers of a matrix stand still.
_SQUARINGS = 40


def matrices(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, regimes, a): square matrices as arrays of rows, from (keys, regime, next, share); pairs that are missing count as 0.

    Regimes are those of either column, in order. A regime without a way out stays where it is.
    """
    named = rows.groupBy(*keys).agg(F.sort_array(F.array_union(F.collect_set("regime"), F.collect_set("next"))).alias("regimes"), F.collect_list(F.struct("regime", "next", "share")).alias("cells"))
    held = F.map_from_entries(F.transform("cells", lambda x: F.struct(F.struct(x["regime"].alias("regime"), x["next"].alias("next")).alias("k"), x["share"].cast("double").alias("v"))))
    cell = lambda i, j: F.coalesce(F.try_element_at(held, F.struct(i.alias("regime"), j.alias("next"))), F.lit(0.0))
    whole = F.transform("regimes", lambda i: F.transform("regimes", lambda j: cell(i, j)))
    stuck = F.transform(whole, lambda row, i: F.when(_total(row) > 0, row).otherwise(F.transform(row, lambda _, j: (i == j).cast("double"))))
    return named.select(*keys, "regimes", stuck.alias("a"))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def product(a: Column, b: Column) -> Column:
    """The matrix product of arrays of rows."""
    columns = F.sequence(F.lit(0), F.size(b) - 1)
    return F.transform(a, lambda row: F.transform(columns, lambda j: _total(F.zip_with(row, b, lambda x, other: x * F.get(other, j)))))


def power(a: Column, n: int) -> Column:
    """a to the n-th (n of 1 or more), by squaring."""
    if n == 1:
        return a
    half = F.transform(F.array(power(a, n // 2)), lambda h: product(h, h))
    return F.transform(half, lambda h: product(h, a))[0] if n % 2 else half[0]


def stationary(a: Column) -> Column:
    """The stationary shares: rows of a high power of the matrix that stays put half of the time (so that cycles settle), averaged."""
    lazy = F.transform(a, lambda row, i: F.transform(row, lambda x, j: x / 2 + F.when(i == j, 0.5).otherwise(0.0)))
    scaled = lambda m: F.transform(m, lambda row: F.transform(row, lambda x: x / _total(row)))
    limit = F.aggregate(F.sequence(F.lit(1), F.lit(_SQUARINGS)), lazy, lambda m, _: scaled(product(m, m)))
    k = F.size(a)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: _total(F.transform(limit, lambda row: F.get(row, j))) / k)


def _median(xs: Column) -> Column:
    s, n = F.sort_array(xs), F.size(xs)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def sanity(held: DataFrame, horizon: int = 20) -> DataFrame:
    """Figures of each matrix of ``matrices``: implied durations, stays, largest move, row entropy (bits), and how far ``horizon`` steps are from the stationary shares."""
    a = F.col("a")
    stays = F.transform(a, lambda row, i: F.least(F.greatest(F.get(row, i), F.lit(0.0)), F.lit(1 - 1e-12)))
    moves = F.flatten(F.transform(a, lambda row, i: F.transform(row, lambda x, j: F.when(i == j, 0.0).otherwise(x))))
    clipped = F.transform(a, lambda row: F.transform(row, lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))))
    entropy = F.transform(clipped, lambda row: -_total(F.transform(row, lambda p: p * F.log2(p))))
    made = held.withColumns({"stays": stays, "pi": stationary(a), "mixed": power(a, horizon)})
    durations = F.transform("stays", lambda x: 1 / (1 - x))
    far = F.transform("mixed", lambda row: _total(F.zip_with(row, F.col("pi"), lambda x, p: F.abs(x - p))) / 2)
    valid = F.forall("pi", lambda p: p >= -1e-9) & (F.abs(_total(F.col("pi")) - 1) < 1e-6)
    mean = lambda xs: _total(xs) / F.size(xs)
    return made.select(
        *(c for c in held.columns if c not in ("a", "regimes")), _median(durations).alias("median_duration"), F.array_max(durations).alias("max_duration"), mean(F.col("stays")).alias("mean_self"), F.array_max(moves).alias("max_offdiag"),
        mean(entropy).alias("row_entropy"), valid.alias("stationary_valid"), F.when(valid, mean(far)).alias(f"tv_{horizon}"),
    )
