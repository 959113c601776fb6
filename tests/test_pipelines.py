"""Sources, both pipelines from a configuration, reports and the streaming filter."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from macrotide.operators import report, selection, validate
from macrotide.operators import regimes as R
from macrotide.plans import pipelines
from macrotide.plans.chains import feature_names, parse_config, transform
from macrotide.sources import io

START, END = dt.date(2000, 1, 3), dt.date(2003, 12, 31)
#: Nine series: id, frequency, chains.
UNIVERSE = {
    "vix": ("VIXCLS", "daily", [["level", {"z_score": {"window": 63}}], [{"pct_change": {"periods": 1}}, {"std": {"window": 21}}]]),
    "two": ("DGS2", "daily", [["level", {"z_score": {"window": 100}}]]),
    "ten": ("DGS10", "daily", [[{"diff": {"periods": 21}}]]),
    "curve": ("T10Y3M", "daily", [["level"]]),
    "nfci": ("NFCI", "weekly", [["level", {"z_score": {"window": 50}}]]),
    "icsa": ("ICSA", "weekly", [[{"ma": {"window": 4}}, {"pct_change": {"periods": 13}}]]),
    "pce": ("PCEPILFE", "monthly", [[{"yoy": {"periods": 12}}]]),
    "cfnai": ("CFNAI", "monthly", [["level"]]),
    "ip": ("INDPRO", "monthly", [[{"diff": {"periods": 1}}]]),
}


@pytest.fixture(scope="module")
def universe(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("universe")
    step = {"daily": 1, "weekly": 7, "monthly": 30}
    days = (END - START).days
    for k, (series, often, _) in enumerate(UNIVERSE.values()):
        rows = [(series, START + dt.timedelta(days=n), str(round(10 + k + ((n * (k + 3)) % 17) / 7 + n / 500, 4)), series.lower(), "rates") for n in range(0, days, step[often])]
        spark.createDataFrame(rows, "series_code string, date date, value string, series_name string, category string").coalesce(1).write.parquet(f"{root}/raw/{often}/{series}")
    spark.createDataFrame([("OTHER", START, "1", "o", "x")], "series_code string, date date, value string, series_name string, category string").write.parquet(f"{root}/raw/other")
    paths = {k: f"{root}/{k}" for k in ("raw_path", "processed_path", "raw_features_path", "ready_features_path")}
    series = {name: {"id": i, "frequency": f, "transforms": c} for name, (i, f, c) in UNIVERSE.items()}
    return {"regime_universe": {"data_path": f"{root}/raw", **paths, "lookback": {"start": str(START), "end": str(END)}, "series": series}}


def test_pipelines_from_configuration(spark, universe, tmp_path):
    done = pipelines.run_data_pipeline(spark, universe)
    rows = done.table
    assert {r[0] for r in rows.select("series_code").distinct().collect()} == {v[0] for v in UNIVERSE.values()}
    assert rows.filter(F.weekday("date") > 4).isEmpty() and rows.filter("value IS NULL").isEmpty()
    per_series = rows.groupBy("series_code").count().select("count").distinct().collect()
    assert len(per_series) == 1  # all series on all days
    checks = {(r.section, r.check): r for r in done.report.collect()}
    assert checks["completeness", "series_count"].value == 9 and checks["temporal", "duplicate_keys"].passed and checks["coverage", "missing"].passed
    assert spark.read.parquet(universe["regime_universe"]["raw_path"]).filter("series_code = 'OTHER'").count() == 1
    text = report.report_text(done.report)
    assert text.startswith("status: PASS") and "staleness:" in text and "series_count 9" in text

    out = pipelines.run_feature_pipeline(spark, universe, f"{tmp_path}/metadata.json")
    names = feature_names(parse_config(universe))
    assert out.table.columns == ["date", *names] and len(names) == 10
    ready = spark.read.parquet(universe["regime_universe"]["ready_features_path"])
    assert ready.columns[1:] == [n for n in selection.RANKED if n in names][:8] and 0 < ready.count() < out.table.count()
    want = {(r.date, r.feature): r.value for r in transform(rows, parse_config(universe)).collect()}
    got = out.table.select("date", "DGS10_diff_21").collect()
    assert all(r.DGS10_diff_21 == want[r.date, "DGS10_diff_21"] for r in got)
    meta = json.loads(open(f"{tmp_path}/metadata.json").read())
    assert all(m["frequency"] in ("daily", "weekly", "monthly") for m in meta.values()) and len(meta) == len(ready.columns) - 1
    counts = report.report_counts(out.report).first()
    assert counts.passed + counts.warnings + counts.errors == out.report.count() > 30
    assert {r.check for r in out.report.collect()} >= {"missing", "burn_in", "zscore", "outliers", "daily_changes", "weekly_changes", "jumps", "calendar", "duplicate_dates"}


def test_pipelines_refuse_bad_configurations(spark, universe, tmp_path):
    inner = dict(universe["regime_universe"])
    with pytest.raises(FileNotFoundError):
        io.load_raw(spark, f"{tmp_path}/none")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        io.load_raw(spark, f"{tmp_path}/empty")
    with pytest.raises(ValueError, match="NONE"):
        pipelines.run_data_pipeline(spark, inner | {"raw_path": f"{tmp_path}/raw", "series": {"x": {"id": "NONE"}}})
    some = {k: v for k, v in inner["series"].items() if k != "vix"}
    pipelines.run_data_pipeline(spark, inner | {"processed_path": f"{tmp_path}/processed"})
    with pytest.raises(KeyError, match="VIXCLS"):
        pipelines.run_feature_pipeline(spark, inner | {"processed_path": f"{tmp_path}/processed", "series": some})


def test_data_report_finds_faults(spark):
    rows = [("A", dt.date(2024, 1, 2), 1.0), ("A", dt.date(2024, 1, 2), 2.0), ("A", dt.date(2024, 1, 6), None), (None, dt.date(2024, 1, 3), float("inf")), ("B", dt.date(2030, 1, 2), 3.0)]
    df = spark.createDataFrame([(*r, "n", "c", True, -1) for r in rows], "series_code string, date date, value double, series_name string, category string, is_new_data boolean, days_since_update int")
    days = pipelines.calendar_between(spark, "2024-01-02", "2024-01-05")
    expected = spark.createDataFrame([("A",), ("C",)], "series_code string")
    got = {r.check: r for r in report.data_report(df, expected, days, F.lit("2025-01-01").cast("date")).filter("section <> 'coverage' AND section <> 'calendar'").collect()}
    wrong = {k: r.value for k, r in got.items() if not r.passed}
    assert wrong == {"null_series_code": 1, "null_value": 1, "future_dates": 1, "duplicate_keys": 1, "infinite": 1, "negative_days": 5}
    assert report.report_counts(report.data_report(df, expected, days)).first().status == "FAIL"
    short = report.data_report(df.drop("category"), expected, days).collect()
    assert [(r.check, r.passed, r.value) for r in short] == [("required_columns", False, 1.0)]
    empty = report.data_report(df.limit(0), expected, days)
    assert {r.section for r in empty.collect()} >= {"schema", "values", "calendar"} and report.report_text(empty)


def test_order_and_burn_in(spark, tmp_path):
    keys = [("A", dt.date(2024, 1, d)) for d in range(1, 20)] + [("B", dt.date(2024, 1, d)) for d in range(1, 20)]
    good = spark.createDataFrame(keys, "series_code string, date date").coalesce(1)
    assert report.order_violations(good).first().violations == 0
    bad = spark.createDataFrame([keys[5], *keys[:5], *keys[6:]], "series_code string, date date").coalesce(1)
    assert report.order_violations(bad).first().violations == 1
    wide = spark.createDataFrame([(dt.date(2000, 1, 3), None, 1.0), (dt.date(2012, 1, 3), 1.0, 1.0)], "date date, a double, b double")
    one = report.burn_in(wide, ["a", "b"]).first()
    assert one.failed and one.complete_from == dt.date(2012, 1, 3) and not report.burn_in(wide, ["b"]).first().failed and report.burn_in(wide.limit(1), ["a"]).first().failed


def test_selection_and_views(spark):
    groups = selection.static_groups(spark.createDataFrame([("DGS2_level_zscore_252",), ("OTHER_level",), (None,)], "feature string")).collect()
    assert [tuple(r) for r in groups] == [("DGS2_level_zscore_252", "rates")] and sum(map(len, selection.GROUPS.values())) == 14
    assert len(selection.RANKED) == len(set(selection.RANKED)) == 25 and selection.top_features(40) == selection.RANKED and len(selection.top_features()) == 5
    labels = spark.createDataFrame([(dt.date(2024, 1, d), r) for d, r in enumerate([0, 0, 1, 0, 1, 1], 1)], "date date, regime int")
    matrix = {r.regime: (r.to_0, r.to_1) for r in R.transition_matrix(labels, [0, 1]).collect()}
    assert matrix == {0: (0.333, 0.667), 1: (0.5, 0.5)}
    nested = spark.sql("SELECT 'm' AS id, named_struct('x', 1, 'y', named_struct('z', 2)) AS a")
    assert R.flat_metrics(nested).columns == ["id", "a.x", "a.y.z"] and tuple(R.flat_metrics(nested).first()) == ("m", 1, 2)
    corr = spark.createDataFrame([(float(i), float(-i), float(i % 3)) for i in range(20)], "a double, b double, c double")
    strong = validate.correlations(corr, ["a", "b", "c"], 0.7).collect()
    assert [(r.a, r.b, round(r["corr"], 6)) for r in strong] == [("a", "b", -1.0)]


def test_sources(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather

    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    rows.write.parquet(f"{tmp_path}/t.parquet")
    rows.write.option("header", True).csv(f"{tmp_path}/t.csv")
    rows.write.json(f"{tmp_path}/t.json")
    pyarrow.feather.write_feather(pa.table({"k": [1, 2], "s": ["a", None]}), f"{tmp_path}/t.feather", compression="uncompressed")
    want = {("1", "a"), ("2", None)}
    for kind in ("parquet", "csv", "json", "feather"):
        assert {(str(r.k), r.s) for r in io.load_table(spark, f"{tmp_path}/t.{kind}").collect()} == want
    for kind, error in (("pkl", "run code"), ("txt", "no reader")):
        with pytest.raises(ValueError, match=error):
            io.load_table(spark, f"{tmp_path}/t.{kind}")
    with pytest.warns(UserWarning):
        assert io.load_configs(str(tmp_path)) == {k: {} for k in ("macro_data", "equity_data", "regimes", "models")}
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "equities_universe.yaml").write_text("a: 1")
    with pytest.warns(UserWarning):
        assert io.load_configs(str(tmp_path))["equity_data"] == {"a": 1}
    px = io.price_series(spark.sql("SELECT '2024-01-02' AS date, 3 AS Close"))
    assert tuple(px.first()) == (dt.date(2024, 1, 2), 3.0)
    with pytest.raises(ValueError, match="none of the columns"):
        io.price_series(rows, "k")
    with pytest.raises(ValueError, match="not fitted"):
        io.save_model(None, f"{tmp_path}/m.json")


def test_detector(spark, tmp_path):
    import numpy as np

    from macrotide.operators.detector import HmmDetector

    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 60)
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(i), float(rng.normal(4 * s)), float(rng.normal(-s))) for i, s in enumerate(truth)]
    wide = spark.createDataFrame([*rows, (dt.date(2010, 1, 1), None, 1.0)], "date date, a double, b double")
    model = HmmDetector(["a", "b"], 2)
    assert not model.is_fitted and "n_regimes=2" in repr(model)
    for use in (lambda: model.predict(wide), lambda: model.score(wide), model.means, lambda: model.save(f"{tmp_path}/none.json")):
        with pytest.raises(ValueError, match="not fitted"):
            use()
    path = [r.regime for r in model.fit_predict(wide).orderBy("date").collect()]
    low = int(model.means()[0, 0] > model.means()[1, 0])
    assert len(path) == 240 and np.mean((np.array(path) != low) == truth) > 0.95
    model.save(f"{tmp_path}/deep/model.json")
    again = HmmDetector.load(f"{tmp_path}/deep/model.json", ["a", "b"])
    assert again.score(wide) == pytest.approx(model.score(wide)) and np.allclose(again.transition_matrix().sum(1), 1) and again.covariances().shape == (2, 2, 2)
    sums = again.smooth_proba(wide).unionByName(again.filter_proba(wide)).unionByName(again.forecast(wide, 3))
    assert sums.count() == 720 and sums.filter(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).isEmpty()
    with pytest.raises(ValueError):
        HmmDetector(["a"], 2, "tied")


def test_figures_are_observed_while_writing(spark, tmp_path):
    rows = [(f"S{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(i), float(i), "n", "c", i % 2 == 0, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "series_code string, date date, value double, series_name string, category string, is_new_data boolean, days_since_update int").repartition(4)
    seen = io.save(df, f"{tmp_path}/t", order=("series_code", "date"), observed=report.row_figures(df))
    assert (seen["n"], seen["mean"], seen["median"], seen["new"], seen["stalest"]) == (60, 29.5, 29.5, 30, 4)
    table = spark.read.parquet(f"{tmp_path}/t")
    days, expected = pipelines.calendar_between(spark, "2024-01-01", "2024-02-29"), spark.createDataFrame([("S0",)], "series_code string")
    today = F.lit("2025-01-01").cast("date")
    whole, short = (sorted(map(tuple, report.data_report(table, expected, days, today, x).collect()), key=str) for x in (None, seen))
    assert [r for r in whole if r[1] != "future_dates"] == [r for r in short if r[1] != "future_dates"] and ("staleness", "most_days:S1", "info", True, 4.0) in short


def test_unreadable_files_are_named_and_left_out(spark, tmp_path):
    rows = [(i, f"text {i * 7919 % 1000}" * 20) for i in range(40_000)]
    for name in ("good", "short", "broken"):
        spark.createDataFrame(rows, "k long, s string").coalesce(1).write.option("compression", "none").option("parquet.block.size", "262144").option("parquet.page.size", "65536").parquet(f"{tmp_path}/raw/{name}")
    files = {name: next((tmp_path / "raw" / name).glob("*.parquet")) for name in ("good", "short", "broken")}
    for f in (tmp_path / "raw").glob("*/.*.crc"):
        f.unlink()
    content = files["short"].read_bytes()
    files["short"].write_bytes(content[: len(content) // 2])  # no footer
    content = bytearray(files["broken"].read_bytes())
    half = len(content) // 2
    content[half : half + 200_000] = bytes(200_000)  # a whole footer, but pages that can't be read
    files["broken"].write_bytes(bytes(content))
    (tmp_path / "raw" / "note.txt").write_text("no table")
    found = {r.path.split("/")[-2]: r for r in io.raw_manifest(spark, f"{tmp_path}/raw").collect()}
    assert {k: r.readable for k, r in found.items()} == {"good": True, "short": False, "broken": False}
    assert (found["good"].rows, found["good"].rows_read, found["short"].rows, found["broken"].rows) == (40_000, 40_000, None, 40_000)
    with pytest.warns(UserWarning, match="broken.*short"):
        table = io.load_raw(spark, f"{tmp_path}/raw")
    assert table.count() == 40_000 and sorted(table.columns) == ["k", "s"]
    io.save(table, f"{tmp_path}/sorted", order=("k",))
    keys = [r.k for r in spark.read.parquet(f"{tmp_path}/sorted").select("k", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()]
    assert keys == sorted(keys)


def test_entry_survives_a_broken_subpackage(monkeypatch):
    import builtins
    import sys

    import __spark_entry__

    real = builtins.__import__

    def broken(name, *args, **kwargs):
        if name.startswith("macrotide.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("macrotide.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", broken)
    found = __spark_entry__.queries()
    assert "tx_zscore" in found and not any(k.startswith("op") or k == "pipeline" for k in found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_online_filter_equals_the_filter_of_whole_sequences(spark, tmp_path):
    from macrotide.operators import hmm, inference
    from macrotide.streaming.online_filter import online_filter

    params = hmm.Params([0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[-1.0], [1.0]], [[[1.0]], [[2.0]]])
    base = dt.datetime(2024, 1, 1)
    rows = [(e, base + dt.timedelta(days=k), ((k * 7 + len(e)) % 5) - 2.0) for e in ("a", "bb") for k in range(12)]
    schema = "entity string, date timestamp, x double"
    for part, some in enumerate((rows[:6] + rows[12:19], rows[6:12] + rows[19:], rows[3:4])):  # the last one is late and dropped
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        query = (
            online_filter(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["x"], params)
            .writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").outputMode("append").start(f"{tmp_path}/out")
        )
        query.awaitTermination(120)
    got = {(r.entity, r.date.date()): r.filtered for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    wide = spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date"))
    whole = inference.filtered(inference.observed(wide, ["x"], params, "entity"), params)
    want = {(r.entity, r.date): r.filtered for r in whole.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
