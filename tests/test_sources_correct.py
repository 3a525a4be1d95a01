"""Readers on hand-made files, stage reuse, and repair of flagged values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.operators import benchmarks, correct
from wattloom.session import materialize
from wattloom.sources import raw_files, tables


def test_weather_with_three_header_rows(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "name,Lyon,Lyon\nphysical_quantity,temperature,nebulosity\nsource,observed,observed\n"
        "2024-01-01 00:00:00,1.5,\n2024-01-01 01:00:00,2.5,4\n"
    )
    rows = {(r.station, r.quantity, r.source, r.ts.hour, r.value) for r in tables.read_wide_weather(spark, str(tmp_path / "w.csv")).collect()}
    assert rows == {("Lyon", "temperature", "observed", 0, 1.5), ("Lyon", "nebulosity", "observed", 0, None), ("Lyon", "temperature", "observed", 1, 2.5), ("Lyon", "nebulosity", "observed", 1, 4.0)}


def test_load_file_with_footer_and_accents(spark, tmp_path):
    folder = tmp_path / "site=Bretagne" / "year=2015"
    folder.mkdir(parents=True)
    lines = ["Date\tHeures\tConsommation", "2015/07/01\t00:00\t100", "2015/07/01\t00:15\t1", "2015/07/01\t01:00\tND", "Données publiées\t\t", "fin"]
    (folder / "load.xls").write_bytes("\n".join(lines).encode("ISO-8859-1"))
    rows = sorted((r.site, r.year, r.ts, r.value) for r in raw_files.read_load_files(spark, str(tmp_path)).collect())
    assert rows == [("Bretagne", 2015, dt.datetime(2015, 6, 30, 23), 100.0), ("Bretagne", 2015, dt.datetime(2015, 7, 1), None)]


def test_runs_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, value in [("a", 1), ("b", 2), ("a", 3)]:
        tables.write_run(spark.createDataFrame([(value,)], "v int"), path, run)
    assert tables.read_run(spark, path, "a").first().v == 3
    assert tables.read_run(spark, path, "b").first().v == 2


def test_materialize_reuses_a_finished_write(spark, tmp_path):
    path = str(tmp_path / "stage")
    first = materialize(spark.range(3), path)
    assert materialize(spark.range(5), path).count() == first.count() == 3


def load(spark, n=400):
    """A clean site, and one that follows it but has 20 wrong points."""
    import random

    rng = random.Random(3)
    rows, flags = [], []
    for i in range(n):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
        good, other = rng.uniform(10, 20), rng.uniform(5, 6)
        rows += [("good", t, good), ("other", t, other)]
        wrong = i % 20 == 7
        rows.append(("bad", t, 0.0 if wrong else 2 * good + other))
        if wrong:
            flags.append(("bad", t, i, "zero"))
        rows.append(("noise", t, rng.uniform(0, 1)))
    flags.append(("noise", dt.datetime(2024, 1, 1), 0, "zero"))
    return (
        spark.createDataFrame(rows, "site string, ts timestamp, value double"),
        spark.createDataFrame(flags, "site string, ts timestamp, idx long, error_type string"),
    )


@pytest.mark.parametrize("kind", ["ridge", "random_forest"])
def test_correct_repairs_and_gates(spark, kind):
    df, flags = load(spark)
    repaired, dropped = correct.correct(df, flags, kind, train_limit=0.7, test_limit=0.5)
    assert {r.site for r in repaired.select("site").distinct().collect()} == {"good", "other", "bad"}
    assert [r.site for r in dropped.collect()] == ["noise"]
    wide = repaired.groupBy("ts").pivot("site", ["bad", "good", "other"]).agg(F.first("value"))
    joined = wide.join(flags.filter("site = 'bad'"), "ts")
    off = joined.agg(F.max(F.abs(F.col("bad") - 2 * F.col("good") - F.col("other")))).first()[0]
    assert off < (2.0 if kind == "ridge" else 6.0)


def test_train_test_parts_are_stable_and_whole(spark):
    df, flags = load(spark)
    rows = correct.train_test(correct.known_rows(df, flags))
    counts = {(r.site, r.part): r["count"] for r in rows.groupBy("site", "part").count().collect()}
    assert counts["bad", "unknown"] == 20 and counts["bad", "train"] + counts["bad", "test"] == 380
    assert 15 < counts["bad", "test"] < 65
    assert rows.exceptAll(correct.train_test(correct.known_rows(df, flags))).count() == 0


def test_gam_formula_makes_constant_inputs_linear():
    terms = benchmarks.gam_formula({("x", "", ""): "s", ("c", "", ""): "s"}, {(("x", "", ""), ("d", "binary", "")): "by"}, {("c", "", "")})
    assert [t.factors[0].nodes for t in terms] == [8, "p1", 8]
    assert terms[2].factors[1].nodes == "p1"


def test_columns_are_found_by_name(spark, tmp_path):
    header = "Nature\tFioul\tHeures\tConsommation\tDate"
    rows = ["x\t7\t00:00\t100\t2015/07/01", "x\t7\t00:15\t1\t2015/07/01", "Fin du fichier\t\t\t\t"]
    (tmp_path / "load_Bretagne_2015.xls").write_text("\n".join([header, *rows]))
    got = raw_files.read_load_files(spark, str(tmp_path), r"load_(.+)_(\d{4})\.xls").collect()
    assert [(r.site, r.year, r.value) for r in got] == [("Bretagne", 2015, 100.0)]
    weather = tmp_path / "w.csv"
    weather.write_text("numer_sta;pres;ff;date;t;n\n07005;101000;3.5;20150701000000;283.15;mq\n")
    found = {r.quantity: r.value for r in raw_files.read_weather_files(spark, str(weather)).collect()}
    assert found["temperature"] == pytest.approx(10.0) and found["nebulosity"] is None and found["wind_speed"] == 3.5


def test_a_missing_column_is_an_error(spark, tmp_path):
    weather = tmp_path / "w.csv"
    weather.write_text("numer_sta;ff;date;n\n07005;3.5;20150701000000;mq\n")
    with pytest.raises(ValueError, match="has no columns"):
        raw_files.read_weather_files(spark, str(weather))
