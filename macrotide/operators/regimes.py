"""Regime analytics over labels and probabilities keyed by date (or by entity and date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.handover import discard, written
from . import scan


def runs(labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, regime, start, end, length) of the runs of equal labels in date order; rows without a label form runs, too.

    Runs are numbered by a scan, so neither a single history nor a hot key is one task's work.
    """
    numbered = scan.islands(labels.select(*keys, "date", "regime"), ["date"], "regime", keys)
    return numbered.groupBy(*keys, "island", "regime").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("length")).drop("island")


def regime_shares(labels: DataFrame) -> DataFrame:
    """(regime, n, share)."""
    counts = labels.groupBy("regime").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("regime", "n", (F.col("n") / F.col("_total")).alias("share"))


def regime_stability(labels: DataFrame) -> DataFrame:
    """One row: run lengths' mean and deviation (ddof 0), transitions, least and largest share, entropy of shares (bits)."""
    lengths = runs(labels).agg(F.avg("length").alias("mean_run"), F.stddev_pop("length").alias("std_run"), (F.count("*") - 1).alias("n_transitions"))
    share = F.greatest(F.col("share"), F.lit(1e-12))
    shares = regime_shares(labels).agg(F.min("share").alias("min_share"), F.max("share").alias("max_share"), (-F.sum(share * F.log2(share))).alias("entropy"))
    return lengths.crossJoin(shares)


def regime_periods(labels: DataFrame, min_days: int = 30) -> DataFrame:
    return runs(labels).withColumn("days", F.datediff("end", "start")).filter(F.col("days") >= min_days).select("regime", "start", "end", "days")


def row_entropy(proba: Column, eps: float = 1e-12) -> Column:
    clipped = F.transform(proba, lambda p: F.greatest(p, F.lit(eps)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    return -F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x / total * F.log2(x / total))


def entropy_balance(proba: DataFrame) -> DataFrame:
    h = row_entropy(F.col("proba"))
    return proba.agg(F.avg(h).alias("mean_entropy"), F.stddev_pop(h).alias("std_entropy"))


def argmax_regime(proba: DataFrame) -> DataFrame:
    """(date, regime): the first of the most probable regimes."""
    return proba.select("date", (F.array_position("proba", F.array_max("proba")) - 1).cast("int").alias("regime"))


def low_confidence(proba: DataFrame, threshold: float = 0.7) -> DataFrame:
    return proba.withColumn("confidence", F.array_max("proba")).filter(F.col("confidence") < threshold).select("date", "confidence")


def weighted_means(features: DataFrame, proba: DataFrame) -> DataFrame:
    """(k, feature, mean, weight) of long features (date, feature, value) weighted by regime probability."""
    p = proba.select("date", F.posexplode("proba").alias("k", "p"))
    weight = F.sum("p")
    return features.filter(F.col("value").isNotNull()).join(p, "date").groupBy("k", "feature").agg((F.sum(F.col("p") * F.col("value")) / F.greatest(weight, F.lit(1e-12))).alias("mean"), weight.alias("weight"))


def anova_r2(features: DataFrame, proba: DataFrame) -> DataFrame:
    """(feature, r2): variance between the regimes' means over the total variance (ddof 1)."""
    means = weighted_means(features, proba)
    total = features.groupBy("feature").agg(F.avg("value").alias("mu"), F.var_samp("value").alias("var"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("feature"))
    parts = means.withColumn("w", share).join(total, "feature")
    between = F.sum(F.col("w") * F.pow(F.col("mean") - F.col("mu"), 2))
    return parts.groupBy("feature").agg((between / F.greatest(F.first("var"), F.lit(1e-12))).alias("r2"))


def r2_summary(r2: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, r2_mean, r2_median, n) of each group of features, and of all as the group ``all``."""
    named = r2.join(groups, "feature")
    both = named.unionByName(r2.withColumn("group", F.lit("all")))
    return both.groupBy("group").agg(F.avg("r2").alias("r2_mean"), F.median("r2").alias("r2_median"), F.count("r2").alias("n"))


def transition_matrix(labels: DataFrame, regimes: list, digits: int = 3) -> DataFrame:
    """Wide: a row per regime, a column to_<regime> for each next one, shares rounded."""
    shares = transition_counts(labels).groupBy("regime").pivot("next", regimes).agg(F.first("share"))
    return shares.select("regime", *(F.round(F.coalesce(F.col(f"`{x}`"), F.lit(0.0)), digits).alias(f"to_{x}") for x in regimes))


def time_series_view(labels: DataFrame, proba: DataFrame, names: DataFrame) -> DataFrame:
    """(date, regime, label, k, p): the label and the stacked probabilities of each day; names: (regime, label)."""
    named = labels.join(F.broadcast(names), "regime", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Regime "), F.col("regime").cast("string"))))
    return named.join(proba.select("date", F.posexplode("proba").alias("k", "p")), "date")


def prices_on(dates: DataFrame, px: DataFrame) -> DataFrame:
    """(date, px): the price of each date, null where there is none."""
    return dates.select("date").distinct().join(px, "date", "left")


def flat_metrics(nested: DataFrame, sep: str = ".") -> DataFrame:
    """A column for each field of nested structs, named by its path."""
    out = []

    def walk(kind, path):
        for field in kind.fields:
            here = [*path, field.name]
            if field.dataType.typeName() == "struct":
                walk(field.dataType, here)
            else:
                column = F.col(f"`{here[0]}`")
                for name in here[1:]:
                    column = column.getField(name)
                out.append(column.alias(sep.join(here)))

    walk(nested.schema, [])
    return nested.select(*out)


def transition_counts(labels: DataFrame) -> DataFrame:
    """(regime, next, n, share); steps from or to a missing label are left out."""
    steps = scan.previous(labels.select("date", F.col("regime").alias("next")), ["date"], "next", "regime").dropna("any", subset=["regime", "next"])
    n = steps.groupBy("regime", "next").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("regime")))


def regime_summary(labels: DataFrame, features: DataFrame) -> DataFrame:
    """(regime, feature, mean, observations, percentage, avg_duration), rounded to 2 digits."""
    duration = runs(labels).groupBy("regime").agg(F.avg("length").alias("d"))
    shares = regime_shares(labels)
    means = features.join(labels, "date").groupBy("regime", "feature").agg(F.avg("value").alias("mean"))
    r = lambda c: F.round(c, 2)
    return means.join(shares, "regime").join(duration, "regime", "left").select("regime", "feature", r("mean").alias("mean"), F.col("n").alias("observations"), r(100 * F.col("share")).alias("percentage"), r(F.coalesce("d", F.lit(0.0))).alias("avg_duration"))


def regime_distributions(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Box figures per (regime, feature)."""
    joined = features.filter(F.col("value").isNotNull()).join(labels, "date")
    quantile = lambda q, n: F.percentile("value", q).alias(n)
    return joined.groupBy("regime", "feature").agg(F.min("value").alias("low"), quantile(0.25, "q1"), quantile(0.5, "median"), quantile(0.75, "q3"), F.max("value").alias("high"))


def joined_returns(px: DataFrame, labels: DataFrame) -> DataFrame:
    """(date, regime, ret) over the days that have both a price and a regime."""
    both = px.join(labels, "date").filter(F.col("px").isNotNull() & F.col("regime").isNotNull())
    rows = scan.previous(both.select("date", "regime", "px"), ["date"], "px", "_px")
    return rows.select("date", "regime", (F.col("px") / F.when(F.col("_px") != 0, F.col("_px")) - 1).alias("ret")).filter(F.col("ret").isNotNull())


def _drawdown() -> scan.Scan:
    """An element is a stretch of returns: its growth, the highest and lowest wealth within it, and the lowest wealth over the peak before."""

    def lift(row):
        w = 1 + row["ret"]
        return F.struct(w.alias("growth"), w.alias("high"), w.alias("low"), F.lit(1.0).alias("fall"))

    def combine(a, b):
        grown = a["growth"]
        low = grown * b["low"]
        return F.struct((grown * b["growth"]).alias("growth"), F.greatest(a["high"], grown * b["high"]).alias("high"), F.least(a["low"], low).alias("low"), F.least(a["fall"], b["fall"], low / a["high"]).alias("fall"))

    return scan.Scan(lift, combine, lambda s, e: e, "struct<growth:double,high:double,low:double,fall:double>")


def _falls(returns: DataFrame) -> DataFrame:
    cut = scan.blocks(returns, ["date"], ["regime"])
    result = written(scan.folded(cut, _drawdown()).select("_key.regime", (F.col("element.fall") - 1).alias("max_drawdown")))
    discard(cut)
    return result


def drawdown_by_regime(px: DataFrame, labels: DataFrame) -> DataFrame:
    """(regime, max_drawdown) of the wealth along each regime's own days, starting after the first return."""
    return _falls(joined_returns(px, labels))


def equity_by_regime(px: DataFrame, labels: DataFrame, freq: int = 252, rf_annual: float = 0.0) -> DataFrame:
    """Return figures of regimes with two days or more."""
    rf = (1 + rf_annual) ** (1 / freq) - 1
    vol = F.stddev_samp("ret") * freq**0.5
    mean = F.avg("ret")
    returns = joined_returns(px, labels)
    figures = returns.groupBy("regime").agg(
        F.count("*").alias("n_days"),
        mean.alias("mean_daily_ret"),
        (F.pow(1 + mean, F.lit(freq)) - 1).alias("ann_return"),
        vol.alias("ann_vol"),
        ((mean - rf) * freq / F.when(vol != 0, vol)).alias("sharpe"),
        F.avg((F.col("ret") > 0).cast("double")).alias("up_day_frac"),
    )
    return figures.filter("n_days >= 2").join(_falls(returns), "regime").orderBy(F.desc("ann_return"))


def ticker_regime_fill(px: DataFrame, labels: DataFrame) -> DataFrame:
    """Prices with the regime of their date, carried forward; days before the first regime go."""
    joined = px.join(labels, "date", "left")
    return scan.carried(joined, ["date"], "regime").filter(F.col("regime").isNotNull())


def standard_scale(features: DataFrame, train_until: str | None = None) -> DataFrame:
    """(date, feature, value) scaled by mean and deviation (ddof 0) of the rows up to a date."""
    train = features if train_until is None else features.filter(F.col("date") <= F.lit(train_until).cast("date"))
    fit = train.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return features.join(F.broadcast(fit), "feature").select("date", "feature", ((F.col("value") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("value"))


def group_scores(means: DataFrame, groups: DataFrame) -> DataFrame:
    """(k, group, score): mean of the regime means over each group's features."""
    return means.join(groups, "feature").groupBy("k", "group").agg(F.avg("mean").alias("score"))


#: Weights of the group scores (growth, liquidity, inflation, stress, rates) in each label.
LABEL_WEIGHTS = [
    ("Early Expansion", 1.3, 1.1, -1.4, -1.0, -0.3),
    ("Recession", -1.4, -0.6, 0.3, 1.4, 0.0),
    ("Stagflation", -1.1, 0.0, 1.5, 0.6, 0.3),
    ("Policy-Contstrained Expansion", -0.4, -0.9, 1.2, 0.0, 1.3),
]
GROUPS = ("growth", "liquidity", "inflation", "stress", "rates")


def label_regimes(scores: DataFrame) -> DataFrame:
    """(k, label, score) from (k, group, score): best label by cross-regime z-scores; repeated labels are numbered."""
    wide = scores.groupBy("k").pivot("group", list(GROUPS)).agg(F.first("score")).na.fill(0.0, list(GROUPS))
    fit = wide.agg(*(f(g).alias(f"{name}_{g}") for g in GROUPS for name, f in (("m", F.avg), ("s", F.stddev_pop))))  # one row
    z = {g: F.when(F.col(f"s_{g}") < 1e-12, 0.0).otherwise((F.col(g) - F.col(f"m_{g}")) / F.when(F.col(f"s_{g}") != 0, F.col(f"s_{g}"))) for g in GROUPS}
    wide = wide.crossJoin(F.broadcast(fit)).select("k", *(c.alias(g) for g, c in z.items()))
    each = F.array(*(F.struct(F.lit(-i).alias("order"), sum((w * F.col(g) for w, g in zip(ws, GROUPS, strict=True)), F.lit(0.0)).alias("score"), F.lit(name).alias("label")) for i, (name, *ws) in enumerate(LABEL_WEIGHTS)))
    best = wide.select("k", F.explode(each).alias("x")).groupBy("k").agg(F.max(F.struct("x.score", "x.order", "x.label")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("x.label").orderBy("k"))
    many = F.count("*").over(Window.partitionBy("x.label"))
    return best.select("k", F.when(many > 1, F.concat("x.label", F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(F.col("x.label")).alias("label"), F.col("x.score").alias("score"))


def range_score(x: Column, lo: float, hi: float, slack: float) -> Column:
    """1 within [lo, hi], falling linearly to 0 over ``slack`` times the band's width on either side; null scores 0."""
    outside = F.greatest(F.lit(lo) - x, x - F.lit(hi), F.lit(0.0))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - outside / (slack * (hi - lo))))


def pct_ranks(rows: DataFrame, key: str, ranks: dict[str, tuple[str, bool]]) -> DataFrame:
    """rows with a column per rank: the average rank of a column (and whether it descends) over the count of its values; null stays null.

    key identifies a row. Counts of equal values are summed up along the order by a scan, all columns at once, so
    neither a column nor a common value is sorted in one task.
    """
    each = F.array(*(F.struct(F.lit(name).alias("rank"), (-F.col(c) if down else F.col(c)).cast("double").alias("value")) for name, (c, down) in ranks.items()))
    long = rows.select(key, F.explode(each).alias("x")).select(key, "x.rank", "x.value").filter(F.col("value").isNotNull())
    counts = long.groupBy("rank", "value").agg(F.count("*").alias("n"))
    placed = scan.states(counts, ["value"], scan.running_total("n"), ["rank"])
    totals = placed.groupBy("rank").agg(F.max("_after").alias("total"))  # a row per rank
    share = (F.coalesce("_before", F.lit(0)) + (F.col("n") + 1) / 2) / F.col("total")
    found = long.join(placed.join(F.broadcast(totals), "rank").select("rank", "value", share.alias("share")), ["rank", "value"])
    return rows.join(found.groupBy(key).pivot("rank", list(ranks)).agg(F.first("share")), key, "left")


def reject_reason(models: DataFrame) -> DataFrame:
    """models with reason: the first hard rule that a model breaks, or null; nulls break none."""
    q10 = models.agg(F.percentile("maha_min", 0.1).alias("_q10"))
    rules = [
        (~F.col("stationary_valid"), "stationary_invalid"),
        (F.col("min_share") < 0.03, "min_share"),
        (F.col("max_share") > 0.80, "max_share"),
        (F.col("max_duration") > 3000, "max_duration"),
        (F.col("maha_min") < F.col("_q10"), "maha_min"),
        (F.col("oos_min_share") < 0.02, "oos_min_share"),
        (F.col("oos_max_share") > 0.85, "oos_max_share"),
    ]
    reason = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    return models.crossJoin(F.broadcast(q10)).withColumn("reason", reason).drop("_q10")


def rejected(models: DataFrame) -> DataFrame:
    """(model_id, reason) of the models that break a hard rule, by reason and model."""
    return reject_reason(models).filter("reason IS NOT NULL").select("model_id", "reason").orderBy("reason", "model_id")


def select_model(models: DataFrame, top_n: int = 10) -> DataFrame:
    """The best models with their scores. A model grid is small: one row per model."""
    left = reject_reason(models).filter("reason IS NULL")
    ranks = {"r_maha": ("maha_median", False), "r_r2": ("r2_mean", False), "r_off": ("max_offdiag", True), "r_trans": ("n_transitions", True), "r_ent": ("entropy", False), "r_oos": ("oos_r2", False)}
    r = pct_ranks(left, "model_id", ranks)
    macro = 0.5 * F.col("r_maha") + 0.5 * F.col("r_r2")
    transition = 0.45 * range_score(F.col("median_duration"), 20, 200, 0.75) + 0.35 * range_score(F.col("tv20"), 0.05, 0.30, 1.0) + 0.20 * F.col("r_off")
    stability = 0.45 * F.col("r_trans") + 0.35 * range_score(F.col("persistence"), 20, 200, 1.0) + 0.20 * F.col("r_ent")
    final = 0.40 * macro + 0.30 * transition + 0.25 * stability + 0.05 * F.coalesce("r_oos", F.lit(0.0))
    return r.select("model_id", macro.alias("macro_score"), transition.alias("transition_score"), stability.alias("stability_score"), final.alias("final_score")).orderBy(F.desc("final_score"), "model_id").limit(top_n)
