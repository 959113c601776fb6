"""The engine's inputs as views over the driver tables, and the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import business_days, holiday_sql
from ..functions.steps import Diff, Level, MovingAverage, PctChange, Returns, RollingStd, YoY, ZScore
from ..operators import prepare
from ..sources.handover import discard, written
from .chains import feature_matrix, feature_name, transform

CENTRES = (-1.2, -0.4, 0.4, 1.2)
#: The chains of the feature queries.
CHAINS = {
    "ORD1": [(Level(),), (ZScore(63),)],
    "ORD2": [(MovingAverage(20), PctChange(5))],
    "ORD3": [(RollingStd(21),), (ZScore(63),)],
    "ORD4": [(Returns("log", 1),)],
    "ORD5": [(YoY(252),)],
    "LIWA": [(ZScore(26),)],
    "LIMO": [(Diff(1),)],
    "LIWN": [(Diff(1),)],
    "LIWR": [(PctChange(2),)],
    "LIMF": [(PctChange(1),)],
}
NAMES = [feature_name(s, c) for s, cs in CHAINS.items() for c in cs]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean(column: str):
    """Mean in whole hundredths, rounded down: sums of integers, so equal on every engine and in every order."""
    return F.expr(f"sum(CAST(round({column} * 100) AS BIGINT)) DIV count(*)").cast("double") / 100


def _mean_sql(column: str) -> str:
    return f"CAST(sum(CAST(round({column} * 100) AS BIGINT)) // count(*) AS DOUBLE) / 100"


def macro_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily, weekly (Saturday-dated) and monthly series."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    digit = F.substring("o_orderpriority", 1, 1)
    category = F.when(digit == "1", "stress").when(digit == "2", "growth").when(digit == "3", "inflation").when(digit == "4", "rates").otherwise("liquidity")
    daily = orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date")).agg(_mean("o_totalprice").alias("value"))
    daily = daily.select(F.concat(F.lit("ORD"), digit).alias("series_code"), "date", "value", F.concat(F.lit("Order value "), "o_orderpriority").alias("series_name"), category.alias("category"))
    # one scan of the lines: sums of whole hundredths by day first, then by week and by month
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    by_day = lines.groupBy("l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("day")).agg(cents("l_discount").alias("discount"), cents("l_quantity").alias("quantity"), F.count("*").alias("n"))

    def part(prefix, key, date, total, name, category):
        return F.struct(F.concat(F.lit(prefix), key).alias("series_code"), date.alias("date"), F.col(total).alias("total"), F.concat(F.lit(name), key).alias("series_name"), F.lit(category).alias("category"))

    week, month = F.date_add(F.to_date(F.date_trunc("week", "day")), 5), F.to_date(F.date_trunc("month", "day"))
    parts = F.array(part("LIW", F.col("l_returnflag"), week, "discount", "Weekly discount ", "rates"), part("LIM", F.col("l_linestatus"), month, "quantity", "Monthly quantity ", "growth"))
    longer = by_day.select("n", F.explode(parts).alias("x")).select("n", "x.*").groupBy("series_code", "date", "series_name", "category").agg((F.expr("sum(total) DIV sum(n)").cast("double") / 100).alias("value"))
    return daily.unionByName(longer)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return business_days(table(spark, sf_dir, "orders").agg(F.min(day).alias("first"), F.max(day).alias("last")))


_kept: dict[tuple[str, str, str], DataFrame] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A hand-over table, written once for the queries that follow, so their plans begin at a scan; ``release`` deletes it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = written(build())
    return _kept[key]


def release() -> None:
    """Deletes the tables that are kept."""
    while _kept:
        discard(_kept.popitem()[1])


def cleaned(spark, sf_dir):
    """The cleaned observations, the hand-over from loading to alignment."""
    return _once("cleaned", spark, sf_dir, lambda: prepare.clean(macro_raw(spark, sf_dir)))


def stale(spark, sf_dir):
    return prepare.annotate(cleaned(spark, sf_dir))


def aligned(spark, sf_dir):
    rows = _once("stale", spark, sf_dir, lambda: stale(spark, sf_dir))
    return prepare.align_calendar(rows, calendar(spark, sf_dir))


def processed(spark, sf_dir):
    """The processed table, the hand-over from preparation to features."""
    return _once("processed", spark, sf_dir, lambda: prepare.trim_common_start(_once("aligned", spark, sf_dir, lambda: aligned(spark, sf_dir))))


def features(spark, sf_dir):
    """The features, the hand-over to validation and regimes."""
    return _once("features", spark, sf_dir, lambda: transform(processed(spark, sf_dir), CHAINS).select("date", "feature", "value"))


def wide(spark, sf_dir):
    return feature_matrix(features(spark, sf_dir), NAMES)


def zscore_rows(spark, sf_dir):
    """(date, z): the strict 63-observation z-score of ORD1."""

    def build():
        rows = transform(processed(spark, sf_dir), {"ORD1": [(ZScore(63),)]})
        return rows.filter(F.col("value").isNotNull()).select("date", F.round("value", 9).alias("z"))

    return _once("zscore", spark, sf_dir, build)


def regimes(spark, sf_dir):
    z = F.col("z")
    return zscore_rows(spark, sf_dir).select("date", F.when(z < -0.67, 0).when(z < 0, 1).when(z < 0.67, 2).otherwise(3).alias("regime"))


def proba(spark, sf_dir):
    e = F.array(*(F.exp(-F.abs(F.col("z") - c)) for c in CENTRES))
    rows = zscore_rows(spark, sf_dir).withColumn("e", e).withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return rows.select("date", F.transform("e", lambda x: x / F.col("s")).alias("proba"))


def px(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(_mean("l_extendedprice").alias("px"))


def event_runs(spark, sf_dir):
    """(user_id, date, regime): the events as label sequences per user, in order of time and id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("date"), F.col("event_type").alias("regime"))


def models(spark, sf_dir):
    """A model per nation with metrics derived from its customers: each rejection reason and null later metrics occur."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n, a = F.count("*"), F.col("c_acctbal")
    k = F.col("n_nationkey")
    r = lambda x: F.round(x, 6)
    return c.groupBy(k).agg(n.alias("n"), r(F.avg(a)).alias("m"), r(F.min(a)).alias("lo"), r(F.max(a)).alias("hi")).select(
        F.concat(F.lit("m"), k.cast("string")).alias("model_id"), (k % 11 != 3).alias("stationary_valid"), (F.col("n") % 20 / 100 + 0.01).alias("min_share"), ((F.col("n") % 9 + 1) / 10).alias("max_share"), (F.col("hi") / 3.31).alias("max_duration"),
        (F.col("hi") / 40).alias("median_duration"), (F.col("n") % 7 / 10).alias("tv20"), (F.col("n") % 6 / 20).alias("max_offdiag"), (F.col("n") % 13).cast("long").alias("n_transitions"), (F.col("m") / 30).alias("persistence"),
        (F.col("n") % 17 / 10).alias("entropy"), (F.col("m") / 1000).alias("maha_min"), (F.col("m") / 500).alias("maha_median"), (F.col("n") % 10 / 10).alias("r2_mean"),
        F.when(k % 5 != 0, F.col("n") % 19 / 60).alias("oos_min_share"), F.when(k % 5 != 0, (F.col("n") % 8 + 1) / 9).alias("oos_max_share"), F.when(k % 5 != 0, F.col("n") % 12 / 12).alias("oos_r2"),
    )


_W = "(PARTITION BY series_code ORDER BY date)"
_U = "(PARTITION BY series_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

#: The views above as common table expressions, each after those it needs.
SQL: dict[str, str] = {
    "raw": f"""
      SELECT 'ORD' || substr(o_orderpriority, 1, 1) AS series_code, CAST(o_orderdate AS DATE) AS date, {_mean_sql("o_totalprice")} AS value, 'Order value ' || o_orderpriority AS series_name,
             CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'stress' WHEN '2' THEN 'growth' WHEN '3' THEN 'inflation' WHEN '4' THEN 'rates' ELSE 'liquidity' END AS category
      FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)
      UNION ALL
      SELECT 'LIW' || l_returnflag, CAST(date_trunc('week', l_shipdate) AS DATE) + 5, {_mean_sql("l_discount")}, 'Weekly discount ' || l_returnflag, 'rates'
      FROM lineitem GROUP BY l_returnflag, CAST(date_trunc('week', l_shipdate) AS DATE)
      UNION ALL
      SELECT 'LIM' || l_linestatus, CAST(date_trunc('month', l_shipdate) AS DATE), {_mean_sql("l_quantity")}, 'Monthly quantity ' || l_linestatus, 'growth'
      FROM lineitem GROUP BY l_linestatus, CAST(date_trunc('month', l_shipdate) AS DATE)""",
    "rolled": "SELECT *, CASE isodow(date) WHEN 6 THEN date + 2 WHEN 7 THEN date + 1 ELSE date END AS rd FROM raw",
    "clean": "SELECT series_code, rd AS date, value, series_name, category FROM (SELECT *, row_number() OVER (PARTITION BY series_code, rd ORDER BY date DESC, value DESC) AS k FROM rolled) WHERE k = 1",
    "stale": f"SELECT *, lag(value) OVER w IS NULL OR value IS NULL OR value <> lag(value) OVER w AS is_new_data, row_number() OVER w AS obs_number FROM clean WINDOW w AS {_W}",
    "freq": f"""
      SELECT series_code, CASE WHEN count(*) < 2 THEN 'unknown' WHEN floor(median(gap)) <= 1 THEN 'daily' WHEN floor(median(gap)) <= 7 THEN 'weekly' WHEN floor(median(gap)) <= 31 THEN 'monthly' ELSE 'irregular' END AS native_freq
      FROM (SELECT series_code, date - lag(date) OVER {_W} AS gap FROM clean) GROUP BY series_code""",
    "cal": f"""
      SELECT date FROM (SELECT CAST(unnest(generate_series(CAST((SELECT min(o_orderdate) FROM orders) AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date)
      WHERE isodow(date) < 6 AND NOT {holiday_sql('date')}""",
    "aligned": f"""
      SELECT series_code, date, last_value(value IGNORE NULLS) OVER w AS value, last_value(series_name IGNORE NULLS) OVER w AS series_name, last_value(category IGNORE NULLS) OVER w AS category,
             last_value(native_freq IGNORE NULLS) OVER w AS native_freq, last_value(obs_number IGNORE NULLS) OVER w AS obs_number, is_new_data,
             date - last_value(CASE WHEN is_new_data THEN date END IGNORE NULLS) OVER w AS days_since_update
      FROM (SELECT s.series_code, c.date FROM (SELECT DISTINCT series_code FROM stale) s, cal c) k
      LEFT JOIN (SELECT * FROM stale JOIN freq USING (series_code)) o USING (series_code, date) WINDOW w AS {_U}""",
    "proc": "SELECT * FROM aligned WHERE date >= (SELECT max(m) FROM (SELECT min(date) AS m FROM aligned WHERE value IS NOT NULL GROUP BY series_code))",
    "px": f"SELECT CAST(l_shipdate AS DATE) AS date, {_mean_sql('l_extendedprice')} AS px FROM lineitem GROUP BY CAST(l_shipdate AS DATE)",
    "models": """
      SELECT 'm' || k AS model_id, k % 11 <> 3 AS stationary_valid, n % 20 / 100 + 0.01 AS min_share, (n % 9 + 1) / 10 AS max_share, hi / 3.31 AS max_duration, hi / 40 AS median_duration, n % 7 / 10 AS tv20,
             n % 6 / 20 AS max_offdiag, n % 13 AS n_transitions, m / 30 AS persistence, n % 17 / 10 AS entropy, m / 1000 AS maha_min, m / 500 AS maha_median, n % 10 / 10 AS r2_mean,
             CASE WHEN k % 5 <> 0 THEN n % 19 / 60 END AS oos_min_share, CASE WHEN k % 5 <> 0 THEN (n % 8 + 1) / 9 END AS oos_max_share, CASE WHEN k % 5 <> 0 THEN n % 12 / 12 END AS oos_r2
      FROM (SELECT n_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 6) AS m, round(min(c_acctbal), 6) AS lo, round(max(c_acctbal), 6) AS hi
            FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey)""",
}


def step_sql(step) -> str:
    """A step over the column v in the window w of a series."""
    def relative(n):
        return f"CASE WHEN lag(v, {n}) OVER w = 0 THEN CASE WHEN v <> 0 THEN sign(v) * CAST('inf' AS DOUBLE) END ELSE v / lag(v, {n}) OVER w - 1 END"

    if isinstance(step, Level):
        return "v"
    if isinstance(step, Diff) or isinstance(step, YoY) and step.method == "diff":
        return f"v - lag(v, {step.periods}) OVER w"
    if isinstance(step, PctChange | YoY) or isinstance(step, Returns) and step.method == "simple":
        return relative(step.periods)
    if isinstance(step, Returns):
        return f"CASE WHEN v / nullif(lag(v, {step.periods}) OVER w, 0) > 0 THEN ln(v / nullif(lag(v, {step.periods}) OVER w, 0)) END"
    n = step.window
    over = f"OVER (PARTITION BY series_code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = {
        MovingAverage: f"avg(v) {over}",
        RollingStd: f"stddev_samp(v) {over}",
        ZScore: f"CASE WHEN stddev_samp(v) {over} > 1e-12 THEN (v - avg(v) {over}) / stddev_samp(v) {over} END",
    }[type(step)]
    return f"CASE WHEN count(v) {over} = {n} THEN {value} END"


def chain_sql(chain, where: str = "TRUE", strict: bool = True) -> str:
    """(series_code, date, value) of a chain over proc."""
    inner = f"SELECT series_code, date, value AS v FROM proc WHERE {where}" + (" AND is_new_data" if strict else "")
    for step in chain:
        inner = f"SELECT series_code, date, {step_sql(step)} AS v FROM ({inner}) WINDOW w AS {_W}"
        if strict:
            inner = f"SELECT series_code, date, last_value(v IGNORE NULLS) OVER {_U} AS v FROM ({inner})"
    if not strict:
        return f"SELECT series_code, date, v AS value FROM ({inner})"
    return f"SELECT series_code, date, last_value(v IGNORE NULLS) OVER {_U} AS value FROM (SELECT series_code, date FROM proc WHERE {where}) LEFT JOIN ({inner}) USING (series_code, date)"


SQL["feat"] = " UNION ALL ".join(f"SELECT date, '{feature_name(s, c)}' AS feature, value FROM ({chain_sql(c, f"series_code = '{s}'")})" for s, cs in CHAINS.items() for c in cs)
SQL["z63"] = f"SELECT date, round(value, 9) AS z FROM ({chain_sql(CHAINS['ORD1'][1], "series_code = 'ORD1'")}) WHERE value IS NOT NULL"
SQL["regimes"] = "SELECT date, CASE WHEN z < -0.67 THEN 0 WHEN z < 0 THEN 1 WHEN z < 0.67 THEN 2 ELSE 3 END AS regime FROM z63"
SQL["proba"] = "SELECT date, k, e / sum(e) OVER (PARTITION BY date) AS p FROM (SELECT date, k, exp(-abs(z - c)) AS e FROM z63, (VALUES " + ", ".join(f"({k}, {c})" for k, c in enumerate(CENTRES)) + ") v(k, c))"
_NEEDS = {"rolled": ["raw"], "clean": ["rolled"], "stale": ["clean"], "freq": ["clean"], "aligned": ["stale", "freq", "cal"], "proc": ["aligned"], "feat": ["proc"], "z63": ["proc"], "regimes": ["z63"], "proba": ["z63"]}


def with_views(body: str, *views: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """body after the views it names and all that these need."""
    order: list[str] = []

    def add(v):
        for n in _NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS MATERIALIZED ({SQL[v]})" for v in order] + [f"{k} AS ({s})" for k, s in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + f"\n{body}"
