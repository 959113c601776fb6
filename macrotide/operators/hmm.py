"""Gaussian hidden-Markov regimes: parameters, fits, and grids of models, one model per task.

Each model of a grid is fitted and evaluated in one task over its training rows; inference along long sequences is in ``inference``.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transition_init(k: int, p_stay: float) -> np.ndarray:
    """p_stay on the diagonal, the rest spread evenly."""
    if not 0 <= p_stay <= 1:
        raise ValueError("p_stay must be within 0 and 1")
    if k == 1:
        return np.ones((1, 1))
    a = np.full((k, k), (1 - p_stay) / (k - 1))
    np.fill_diagonal(a, p_stay)
    return a


@dataclass
class Params:
    """startprob (K), transmat (K, K), means (K, d), covars (K, d, d)."""

    startprob: list
    transmat: list
    means: list
    covars: list

    def arrays(self):
        return tuple(np.asarray(x, float) for x in (self.startprob, self.transmat, self.means, self.covars))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Params:
        return Params(**json.loads(text))


def log_emissions(x: np.ndarray, means: np.ndarray, covars: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covars, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, k] = -0.5 * (x.shape[1] * math.log(2 * math.pi) + (z**2).sum(0)) - np.log(np.diag(low)).sum()
    return out


def _log(x):
    return np.log(np.maximum(x, 1e-300))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _products(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """m[0], m[0] m[1], ... of small matrices, each scaled to a largest entry of 1, and the logs of the scales.

    By doubling: all products of 2, 4, 8, ... neighbours at once.
    """
    top = np.maximum(m.max((1, 2)), 1e-300)
    m, logs, step = m / top[:, None, None], np.log(top), 1
    while step < len(m):
        both = m[:-step] @ m[step:]
        top = np.maximum(both.max((1, 2)), 1e-300)
        m = np.concatenate([m[:step], both / top[:, None, None]])
        logs = np.concatenate([logs[:step], logs[:-step] + logs[step:] + np.log(top)])
        step *= 2
    return m, logs


def _scaled(logb):
    """Emissions over the largest of each row, and the logs of these."""
    top = logb.max(1)
    return np.exp(logb - top[:, None]), top


def forward(logb, start, trans):
    """Filtered log probabilities and the log-likelihood."""
    b, top = _scaled(logb)
    first = np.asarray(start, float) * b[0]
    reach, logs = np.tile(first, (len(b), 1)), np.zeros(len(b))
    if len(b) > 1:
        m, logs[1:] = _products(np.asarray(trans, float)[None] * b[1:, None, :])
        reach[1:] = first @ m
    mass = np.maximum(reach.sum(1), 1e-300)
    return _log(reach / mass[:, None]), float(np.log(mass[-1]) + logs[-1] + top.sum())


def smooth(logb, start, trans):
    """Filtered and smoothed log probabilities, expected transitions, and the log-likelihood."""
    filtered, total = forward(logb, start, trans)
    b, a = _scaled(logb)[0], np.asarray(trans, float)
    back = np.ones_like(b)
    if len(b) > 1:  # a product from the end is the transposed one from the start of the turned order
        m, _ = _products((a[None] * b[1:, None, :])[::-1].transpose(0, 2, 1))
        back[:-1] = (np.ones(len(a)) @ m)[::-1]
    back /= np.maximum(back.max(1, keepdims=True), 1e-300)
    f = np.exp(filtered)
    joint = f[:-1, :, None] * a[None] * (b[1:] * back[1:])[:, None, :]
    moves = (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0) if len(b) > 1 else np.zeros_like(a)
    post = f * back
    return filtered, _log(post / np.maximum(post.sum(1, keepdims=True), 1e-300)), moves, total


def viterbi(logb, start, trans):
    a = _log(trans)
    now, back = _log(start) + logb[0], []
    for t in range(1, len(logb)):
        step = now[:, None] + a
        back.append(step.argmax(0))
        now = logb[t] + step.max(0)
    path = [int(now.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def fit(x: np.ndarray, start: Params, n_iter: int = 1000, tol: float = 1e-2, prior: float = 1e-2, diag: bool = False) -> tuple[Params, list[float]]:
    """Baum-Welch from the given start; the log-likelihood of each round."""
    pi, a, means, covars = start.arrays()
    history: list[float] = []
    for _ in range(n_iter):
        logb = log_emissions(x, means, covars)
        _, post, moves, total = smooth(logb, pi, a)
        history.append(total)
        if len(history) > 1 and total - history[-2] < tol:
            break
        g = np.exp(post)
        n = np.maximum(g.sum(0), 1e-12)
        pi, a = g[0] / g[0].sum(), moves / np.maximum(moves.sum(1, keepdims=True), 1e-300)
        means = g.T @ x / n[:, None]
        covars = np.empty_like(covars)
        for k in range(len(n)):
            d = x - means[k]
            c = (prior * np.eye(x.shape[1]) + (g[:, k, None] * d).T @ d) / n[k]
            covars[k] = np.diag(np.diag(c)) if diag else c
    return Params(pi.tolist(), a.tolist(), means.tolist(), covars.tolist()), history


def emission_init(x: np.ndarray, k: int, seed: int = 42, diag: bool = False, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Cluster centres (k-means++) and covariances, their eigenvalues floored at 1e-6."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    for _ in range(rounds):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    covars = np.empty((k, x.shape[1], x.shape[1]))
    for j in range(k):
        own = x[near == j]
        c = np.cov(own.T, ddof=1).reshape(x.shape[1], -1) if len(own) >= 2 else 1e-6 * np.eye(x.shape[1])
        values, vectors = np.linalg.eigh(np.nan_to_num((c + c.T) / 2))
        c = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
        covars[j] = np.diag(np.diag(c)) if diag else c
    return centres, covars


def stationary(a: np.ndarray) -> np.ndarray:
    k = len(a)
    system = np.vstack([a.T - np.eye(k), np.ones(k)])
    return np.linalg.lstsq(system, np.append(np.zeros(k), 1), rcond=None)[0]


def transmat_sanity(a: np.ndarray, n_mix: int = 20) -> dict[str, float]:
    stay = np.minimum(np.diag(a), 1 - 1e-12)
    pi = stationary(a)
    off = a - np.diag(np.diag(a))
    mixed = np.linalg.matrix_power(a, n_mix)
    p = np.maximum(a, 1e-12)
    return {
        "median_duration": float(np.median(1 / (1 - stay))), "max_duration": float((1 / (1 - stay)).max()), "mean_self": float(np.diag(a).mean()), "max_offdiag": float(off.max()),
        "row_entropy": float(-(p * np.log2(p)).sum(1).mean()), "stationary_valid": bool(np.all(pi >= -1e-9) and abs(pi.sum() - 1) < 1e-6), "tv_distance": float(0.5 * np.abs(mixed - pi).sum(1).mean()),
    }


def ledoit_wolf_precision(x: np.ndarray) -> np.ndarray:
    """Inverse of the covariance shrunk to a multiple of the identity (Ledoit and Wolf 2004)."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    beta = ((x**2).T @ (x**2) / n - s**2).sum() / (p * n)
    delta = ((s**2).sum() - 2 * mu * np.trace(s) + p * mu**2) / p
    w = min(beta, delta) / delta if delta else 0.0
    return np.linalg.inv((1 - w) * s + w * mu * np.eye(p))


def macro_coherence(x: np.ndarray, proba: np.ndarray) -> dict[str, float]:
    n = np.maximum(proba.sum(0), 1e-12)
    means = proba.T @ x / n[:, None]
    precision = ledoit_wolf_precision(x)
    d = [float(np.sqrt(v @ precision @ v)) for i in range(len(n)) for v in [means[i] - means[j] for j in range(i)]] or [0.0]
    w = n / n.sum()
    r2 = (w[:, None] * (means - x.mean(0)) ** 2).sum(0) / np.maximum(x.var(0, ddof=1), 1e-12)
    return {"maha_min": min(d), "maha_median": float(np.median(d)), "maha_mean": float(np.mean(d)), "r2_mean": float(r2.mean()), "r2_median": float(np.median(r2))}


def _ordered(pdf: pd.DataFrame, columns: list[str]):
    pdf = pdf.sort_values("date").dropna(subset=columns)
    return pdf, pdf[columns].to_numpy(float)


def fit_rows(wide: DataFrame, features: list[str], k: int, kind: str = "full", p_stay: float = 0.95, n_iter: int = 1000) -> Params:
    """The parameters of one model fitted to the complete rows, in date order; the fit is one task, which holds the rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, x = _ordered(pdf, features)
        means, covars = emission_init(x, k, diag=kind == "diag")
        start = Params([1 / k] * k, transition_init(k, p_stay).tolist(), means.tolist(), covars.tolist())
        return pd.DataFrame({"params": [fit(x, start, n_iter, diag=kind == "diag")[0].to_json()]})

    found = wide.select("date", *features).dropna().groupBy(F.lit("").alias("model")).applyInPandas(run, "params string").first()
    if found is None:
        raise ValueError("no row without a missing feature")
    return Params.from_json(found["params"])


def model_grid(wide: DataFrame, features: list[str], splits: list[str], n_features=(2,), n_regimes=(2, 3), kinds=("full", "diag"), p_stay=(0.9, 0.95), n_iter: int = 1000) -> DataFrame:
    """One fitted and evaluated model per row: hyper-parameters, parameters (JSON) and metrics over all, training and later rows.

    Every model is a group of its own and gets the feature rows it trains on: the
    feature table is joined to the grid, so models spread over the cluster. ``rounds`` are those
    of the fit; ``converged`` is false if it was cut at ``n_iter``. Figures that begin with is_ are of training
    rows, with oos_ of later ones, the others of all; each slice starts anew from the start probabilities.
    """
    spark = wide.sparkSession
    grid = [(i, *g) for i, g in enumerate((n, s, k, c, p) for n in n_features for s in splits for k in n_regimes for c in kinds for p in p_stay)]
    models = spark.createDataFrame(grid, "model_id int, n_features int, split_date string, n_regimes int, covariance_type string, p_stay double")
    schema = (
        "model_id int, n_features int, split_date string, n_regimes int, covariance_type string, p_stay double, params string, log_likelihood double, "
        "min_share double, max_share double, n_transitions long, persistence double, entropy double, stationary_valid boolean, median_duration double, max_duration double, max_offdiag double, tv20 double, "
        "maha_min double, maha_median double, r2_mean double, oos_min_share double, oos_max_share double, oos_r2 double, is_min_share double, is_max_share double, is_r2 double, rounds int, converged boolean"
    )

    def shares(states, k):
        s = np.bincount(states, minlength=k) / max(len(states), 1)
        return float(s.min()), float(s.max())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        used, k = features[: int(head.n_features)], int(head.n_regimes)
        pdf, x = _ordered(pdf, used)
        inside = (pd.to_datetime(pdf["date"]) <= pd.Timestamp(head.split_date)).to_numpy()
        train = x[inside]
        m, s = train.mean(0), train.std(0)
        x = (x - m) / np.where(s == 0, 1, s)
        train, later = x[inside], x[~inside]
        diag = head.covariance_type == "diag"
        means, covars = emission_init(train, k, diag=diag)
        start = Params([1 / k] * k, transition_init(k, head.p_stay).tolist(), means.tolist(), covars.tolist())
        params, history = fit(train, start, n_iter, diag=diag)
        pi, a, means, covars = params.arrays()
        logb = log_emissions(x, means, covars)
        states = viterbi(logb, pi, a)
        post = np.exp(smooth(logb, pi, a)[1])
        low, high = shares(states, k)
        share = np.maximum(np.bincount(states, minlength=k) / len(states), 1e-12)
        changes = int((states[1:] != states[:-1]).sum())
        sane, whole = transmat_sanity(a), macro_coherence(x, post)
        def slice_figures(rows):
            if len(rows) < 3:
                return [None, None, None]
            logb = log_emissions(rows, means, covars)
            return [*shares(viterbi(logb, pi, a), k), macro_coherence(rows, np.exp(smooth(logb, pi, a)[1]))["r2_mean"]]

        row = [int(head.model_id), int(head.n_features), head.split_date, k, head.covariance_type, float(head.p_stay), params.to_json(), history[-1], low, high, changes, len(states) / (changes + 1), float(-(share * np.log2(share)).sum())]
        row += [sane[n] for n in ("stationary_valid", "median_duration", "max_duration", "max_offdiag", "tv_distance")] + [whole[n] for n in ("maha_min", "maha_median", "r2_mean")] + slice_figures(later) + slice_figures(train) + [len(history), len(history) < n_iter]
        return pd.DataFrame([row], columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    rows = wide.select("date", *features).dropna()
    spread = rows.crossJoin(F.broadcast(models)).repartition(min(len(grid), 10_000), "model_id")  # a stated number, so small groups aren't merged into one task
    return spread.groupBy("model_id").applyInPandas(run, schema)  # the grid: as many rows as models
