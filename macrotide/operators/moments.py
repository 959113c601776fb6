"""Statistics from sums of products: separation of regimes, unit roots, and the start of emissions.

The rows are summed up once, in DataFrame functions; what is left is a few numbers per pair of features (or per feature),
from which small matrices are solved.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# separation of regimes


def centred(wide: DataFrame, names: list[str]) -> tuple[DataFrame, list[float]]:
    """The rows without a missing feature, each feature less its mean, and the means."""
    full = wide.dropna("any", subset=names)
    means = full.agg(*(F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names))).first()
    means = [0.0 if m is None else m for m in means]
    return full.withColumns({c: F.col(f"`{c}`") - m for c, m in zip(names, means, strict=True)}), means


def _pairs(names: list[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(names)), 2))


def _products(names: list[str]) -> list[Column]:
    out = []
    for i, j in _pairs(names):
        x, y = F.col(f"`{names[i]}`"), F.col(f"`{names[j]}`")
        out += [F.sum(x * y).alias(f"xy_{i}_{j}"), F.sum(x * x * y * y).alias(f"xxyy_{i}_{j}")]
    return out


def gram(wide: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n, xy, xxyy): sums of products, and of products of squares, of each two centred features, from one pass."""
    one = centred(wide, names)[0].agg(F.count("*").alias("n"), *_products(names))
    rows = (F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col("n"), F.col(f"xy_{i}_{j}").alias("xy"), F.col(f"xxyy_{i}_{j}").alias("xxyy")) for i, j in _pairs(names))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def shrunk_covariance(n: int, xy: np.ndarray, xxyy: np.ndarray) -> np.ndarray:
    """The covariance shrunk to a multiple of the identity, by Ledoit and Wolf (2004), from sums over n centred rows."""
    p, s = len(xy), xy / n
    mean = np.trace(s) / p
    spread = (xxyy / n - s**2).sum() / (p * n)
    distance = ((s**2).sum() - 2 * mean * np.trace(s) + p * mean**2) / p
    weight = min(spread, distance) / distance if distance else 0.0
    return (1 - weight) * s + weight * mean * np.eye(p)


def macro_coherence(wide: DataFrame, names: list[str], proba: DataFrame) -> DataFrame:
    """One row: least, median and mean Mahalanobis distance of the regimes' means, mean and median share of variance that regimes explain.

    wide: (date, a column per feature); proba: (date, proba), whose dates are those of complete rows. Two passes: the means, then one aggregate
    of products and of features weighted by probability.
    """
    spark = wide.sparkSession
    rows, _ = centred(wide.join(proba, "date"), names)
    first = rows.select(F.size("proba").alias("k")).first()
    k = first["k"] if first else 0
    weights = [F.sum(F.get("proba", F.lit(r))).alias(f"p_{r}") for r in range(k)]
    weighted = [F.sum(F.get("proba", F.lit(r)) * F.col(f"`{c}`")).alias(f"px_{r}_{i}") for r in range(k) for i, c in enumerate(names)]
    one = rows.agg(F.count("*").alias("n"), *_products(names), *weights, *weighted).first()
    d, n = len(names), one["n"]
    schema = "maha_min double, maha_median double, maha_mean double, r2_mean double, r2_median double"
    if n < 2:
        return spark.createDataFrame([(None,) * 5], schema)
    xy, xxyy = np.zeros((d, d)), np.zeros((d, d))
    for i, j in _pairs(names):
        xy[i, j] = xy[j, i] = one[f"xy_{i}_{j}"]
        xxyy[i, j] = xxyy[j, i] = one[f"xxyy_{i}_{j}"]
    mass = np.maximum([one[f"p_{r}"] for r in range(k)], 1e-12)
    means = np.array([[one[f"px_{r}_{i}"] for i in range(d)] for r in range(k)]) / mass[:, None]
    precision = np.linalg.inv(shrunk_covariance(n, xy, xxyy))
    apart = [math.sqrt(max(float(v @ precision @ v), 0.0)) for a in range(k) for v in means[a] - means[a + 1 :]] or [0.0]
    r2 = (mass / mass.sum()) @ means**2 / np.maximum(np.diag(xy) / (n - 1), 1e-12)
    return spark.createDataFrame([tuple(map(float, (min(apart), np.median(apart), np.mean(apart), r2.mean(), np.median(r2))))], schema)


# unit roots

#: MacKinnon (1994), one series with a constant: bounds of the statistic, and polynomials below and above -1.61.
_P_BOUNDS = (-18.83, 2.74)
_P_LOW, _P_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def p_value(statistic: float) -> float:
    """The probability of a statistic at most this large if there is a unit root."""
    if statistic > _P_BOUNDS[1]:
        return 1.0
    if statistic < _P_BOUNDS[0]:
        return 0.0
    z = sum(c * statistic**i for i, c in enumerate(_P_LOW if statistic <= -1.61 else _P_HIGH))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


class _Lagged:
    """The normal equations of a series' changes on its level, a constant and its earlier changes, for any number of lags.

    Sums over all rows of products at each distance are given. Sums over the rows that have all lags differ from
    them by terms at the two ends, which the first and last values give.
    """

    def __init__(self, n: int, level: list[float], change: list[float], cross: list[float], auto: list[float], head: np.ndarray, tail: np.ndarray):
        self.n, self.level, self.change, self.cross, self.auto = n, level, change, cross, auto
        self.head, self.tail = head, tail  # values from the first one on, and up to the last one

    def _x(self, t: int) -> float:
        return self.head[t] if t < len(self.head) else self.tail[t - self.n]

    def _d(self, t: int) -> float:
        return self._x(t) - self._x(t - 1)

    def equations(self, lags: int, start: int) -> tuple[np.ndarray, int]:
        """Sums of products of (change, level before, 1, changes 1 to ``lags`` rows before) over the rows from ``start`` + 1 on, and their number."""
        n, of = self.n, range(lags + 1)
        g = np.zeros((lags + 3, lags + 3))
        place = [0, *range(3, lags + 3)]  # of the change j rows before
        for j in of:
            # rows t from start + 1 to n - 1: changes t - j
            g[place[j], 2] = self.change[0] - sum(self._d(t) for t in range(1, start + 1 - j)) - sum(self._d(t) for t in range(n - j, n))
            g[1, place[j]] = self.cross[j] - sum(self._x(t - 1) * self._d(t - j) for t in range(j + 1, start + 1))
            for i in range(j + 1):
                r = j - i
                g[place[i], place[j]] = self.auto[r] - sum(self._d(t) * self._d(t - r) for t in range(1 + r, start + 1 - i)) - sum(self._d(t) * self._d(t - r) for t in range(max(n - i, 1 + r), n))
        x = [self._x(t - 1) for t in range(1, start + 1)]
        g[1, 1], g[1, 2], g[2, 2] = self.level[1] - sum(v * v for v in x), self.level[0] - sum(x), n - 1 - start
        return np.triu(g) + np.triu(g, 1).T + np.tril(g, -1) + np.tril(g, -1).T, n - 1 - start


def _fit(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse and rest of squares of the first variable on the others."""
    inverse = np.linalg.pinv(g[1:, 1:])
    b = inverse @ g[1:, 0]
    return b, inverse, max(float(g[0, 0] - b @ g[1:, 0]), 1e-300)


def _unit_root(row, fixed: int | None) -> tuple[float, float, int]:
    n, most = int(row.n), int(row.most)
    series = _Lagged(n, list(row.level), list(row.change), list(row.cross), list(row.auto), np.array(row.head), np.array(row.tail))
    best = fixed
    if best is None:
        whole, count = series.equations(most, most)
        fits = [count * math.log(_fit(whole[: k + 3, : k + 3])[2] / count) + 2 * (k + 2) for k in range(most + 1)]
        best = int(np.argmin(fits))
    g, count = series.equations(best, best)
    b, inverse, rest = _fit(g)
    statistic = float(b[0] / math.sqrt(max(rest / (count - best - 2) * inverse[0, 0], 1e-300)))
    return statistic, p_value(statistic), best


def most_lags(n):
    """The most lags to try for n values (a column or a number)."""
    return F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2) if isinstance(n, Column) else min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def unit_roots(features: DataFrame, least: int = 50, lags: int | None = None) -> DataFrame:
    """(feature, n, statistic, p_value, lags, stationary): the augmented Dickey-Fuller test with a constant of long features (date, feature, value).

    Features of fewer than ``least`` values are left out, and so are missing and infinite values. The number of lags is that of
    least AIC, unless given. All lagged columns come from one window over each feature and one aggregate: the sums at each
    distance, as many as lags, not one for each two of them. A series becomes one row of sums before any matrix is solved.
    """
    rows = features.filter(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    longest = rows.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    top = max(0, most_lags(longest) if lags is None else lags)
    whole, w = Window.partitionBy("feature"), Window.partitionBy("feature").orderBy("date")
    scale = F.stddev_pop("value").over(whole)
    placed = rows.select("feature", "date", F.count("*").over(whole).alias("n"), ((F.col("value") - F.avg("value").over(whole)) / F.when(scale > 0, scale).otherwise(1.0)).alias("x"), (F.row_number().over(w) - 1).alias("at")).filter(F.col("n") >= least)
    placed = placed.withColumn("before", F.lag("x").over(w)).withColumn("d", F.col("x") - F.col("before"))
    lagged = placed.withColumns({f"d{j}": F.lag("d", j).over(w) for j in range(1, top + 1)}).withColumn("d0", F.col("d"))
    some = F.col("d").isNotNull()
    sums = lagged.groupBy("feature", "n").agg(
        F.array(F.sum(F.when(some, F.col("before"))), F.sum(F.when(some, F.col("before") ** 2))).alias("level"),
        F.array(F.sum("d")).alias("change"),
        F.array(*(F.sum(F.col("before") * F.col(f"d{j}")) for j in range(top + 1))).alias("cross"),
        F.array(*(F.sum(F.col("d") * F.col(f"d{j}")) for j in range(top + 1))).alias("auto"),
        F.sort_array(F.collect_list(F.when(F.col("at") <= top + 1, F.struct("at", "x")))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("at") >= F.col("n") - top - 2, F.struct("at", "x")))).alias("tail"),
    )
    values = {c: F.transform(c, lambda x: x["x"]) for c in ("head", "tail")}
    small = sums.withColumns(values).withColumn("most", F.least(most_lags(F.col("n")), F.lit(top)))

    def solve(frames):
        for pdf in frames:
            found = [_unit_root(row, lags) for row in pdf.itertuples()]
            yield pd.DataFrame({"feature": pdf["feature"], "n": pdf["n"], "statistic": [x[0] for x in found], "p_value": [x[1] for x in found], "lags": [x[2] for x in found], "stationary": [x[1] < 0.05 for x in found]})

    return small.mapInPandas(solve, "feature string, n long, statistic double, p_value double, lags int, stationary boolean")


# the start of emissions


def emission_start(wide: DataFrame, names: list[str], k: int, seed: int = 42, diagonal: bool = False, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Means (k, d) and covariances (k, d, d) to start from: clusters by distributed k-means, and the covariance of each one's rows.

    Clusters are in order of their centres. Covariances have eigenvalues of ``floor`` or more; a cluster of one row has the floor alone.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(wide.dropna("any", subset=names).select(*names))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(rows)
    order = np.lexsort(np.array(model.clusterCenters()).T[::-1])
    d = len(names)
    products = [F.covar_samp(f"`{names[i]}`", f"`{names[j]}`").alias(f"c_{i}_{j}") for i, j in _pairs(names)]
    found = {r["_c"]: r for r in model.transform(rows).groupBy("_c").agg(F.count("*").alias("n"), *(F.avg(f"`{c}`").alias(f"m_{i}") for i, c in enumerate(names)), *products).collect()}  # k rows
    means, covars = np.zeros((len(order), d)), np.zeros((len(order), d, d))
    for at, cluster in enumerate(order.tolist()):
        row = found.get(cluster)
        means[at] = model.clusterCenters()[cluster] if row is None else [row[f"m_{i}"] for i in range(d)]
        c = np.zeros((d, d))
        if row is not None and row["n"] >= 2:
            for i, j in _pairs(names):
                c[i, j] = c[j, i] = row[f"c_{i}_{j}"]
        values, vectors = np.linalg.eigh(c)
        c = vectors @ np.diag(np.maximum(values, floor)) @ vectors.T
        covars[at] = np.diag(np.diag(c)) if diagonal else c
    return means, covars


def emissions(wide: DataFrame, names: list[str], k: int, seed: int = 42) -> DataFrame:
    """(k, a, b, mean, covariance): ``emission_start`` as rows, the mean of feature a."""
    means, covars = emission_start(wide, names, k, seed)
    rows = [(r, a, b, float(means[r, i]), float(covars[r, i, j])) for r in range(len(means)) for i, a in enumerate(names) for j, b in enumerate(names)]
    return wide.sparkSession.createDataFrame(rows, "k int, a string, b string, mean double, covariance double")
