"""Calendar facts and name rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.functions import calendar, text
from wattloom.functions.numbers import round_significant

# Published dates of Easter Monday.
EASTER_MONDAYS = ["2010-04-05", "2011-04-25", "2012-04-09", "2013-04-01", "2014-04-21", "2015-04-06", "2016-03-28", "2017-04-17", "2018-04-02", "2019-04-22"]


def test_easter_and_movable_holidays(spark):
    rows = spark.createDataFrame([(d,) for d in EASTER_MONDAYS], "d string").select(F.to_date("d").alias("d"))
    assert rows.filter(calendar.easter_monday(F.year("d")) != F.col("d")).count() == 0
    for shift in (0, 38, 49):
        assert rows.filter(calendar.holidays(F.date_add("d", shift)) == 0).count() == 0
    assert rows.filter(calendar.holidays(F.date_add("d", 1)) == 1).count() == 0


def test_leap_day_and_day_366(spark):
    days = spark.createDataFrame([("2024-02-29",), ("2024-12-31",)], "d string").select(F.col("d").cast("timestamp").alias("ts"))
    assert [r[0] for r in days.select(calendar.year_day(F.col("ts"))).collect()] == [60, 366]


def test_intervals_closed(spark):
    summer = calendar.fixed_intervals(spark, calendar.SUMMER_BREAKS)
    days = spark.createDataFrame([("2013-07-12 23:00:00",), ("2013-07-13 00:00:00",), ("2013-08-25 23:00:00",), ("2013-08-26 00:00:00",)], "d string").select(F.col("d").cast("timestamp").alias("ts"))
    got = calendar.in_intervals(days, "ts", summer, "s").orderBy("ts").collect()
    assert [r.s for r in got] == [0, 1, 1, 0]
    for spans in (calendar.SUMMER_BREAKS, calendar.CHRISTMAS_BREAKS):
        checks = calendar.check_intervals(days, "ts", calendar.fixed_intervals(spark, spans)).collect()
        assert {r["check"]: r.violations for r in checks} == {"date_outside": 0, "interval_bounds": 0}


def test_dates_beyond_the_intervals_are_not_taken_for_working_days(spark):
    summer = calendar.fixed_intervals(spark, calendar.SUMMER_BREAKS)
    days = spark.createDataFrame([("1990-07-20 00:00:00",), ("2013-07-20 00:00:00",), ("2090-01-01 00:00:00",), (None,)], "d string").select(F.col("d").cast("timestamp").alias("ts"))
    got = {str(r.ts)[:4]: r.s for r in calendar.in_intervals(days, "ts", summer, "s", strict=False).collect()}
    assert got == {"1990": None, "2013": 1, "2090": None, "None": None}
    with pytest.raises(Exception, match="no interval is known around 1990-07-20"):
        calendar.in_intervals(days.limit(1), "ts", summer, "s").collect()
    known = days.filter("ts IS NULL OR year(ts) = 2013")
    assert {r.s for r in calendar.in_intervals(known, "ts", summer, "s").collect()} == {None, 1}


def test_sun_times_in_paris(spark):
    """Published times, to two minutes: 21 June 2015 03:47 / 19:58, 21 December 2015 07:41 / 15:56 UTC."""
    days = spark.createDataFrame([("2015-06-21",), ("2015-12-21",)], "d string").select(F.to_date("d").alias("d"))
    rows = calendar.sun_times(days, "d").orderBy("d").collect()
    want = [(3 * 60 + 47, 19 * 60 + 58), (7 * 60 + 41, 15 * 60 + 56)]
    for row, (rise, down) in zip(rows, want):
        assert abs(row.sunrise - rise) < 2 and abs(row.sunset - down) < 2


@pytest.mark.parametrize("raw,want", [
    ("ST-GIRONS", "Saint-Girons"), ("BORDEAUX-MERIGNAC", "Bordeaux"), ("LYON-ST EXUPERY", "Lyon-Satolas"),
    ("le luc", "Le Luc"), ("DUMONT D'URVILLE", "Trappes"), ("tarbes-ossun", "Tarbes-Ossuns"), ("CLERMONT-FD", "Clermont-Ferrand"),
])
def test_station_names(spark, raw, want):
    assert spark.range(1).select(text.station_name(F.lit(raw))).first()[0] == want


def test_other_names(spark):
    row = spark.range(1).select(
        text.strip_accents(F.lit("Auvergne-Rhône-Alpes Comté Œuvre")), text.site_name(F.lit("a b.c")),
        text.region_name(F.lit("PROVENCE-ALPES-COTE  D'AZUR")), text.grid_region_name(F.lit("USE Nord")),
        text.input_name(F.lit("target"), F.lit("lag"), F.lit("-24"), F.lit("Grand-Est")),
        text.input_name(F.lit("hour"), F.lit(""), F.lit(""), F.lit("")),
    ).first()
    assert list(row) == ["Auvergne-Rhone-Alpes Comte OEuvre", "A-B_C", "Provence-Alpes-Cote d'Azur", "NORD", "target_lag_m24_Grand_Est", "hour"]


def test_round_significant(spark):
    values = [0.01234, 123.4, 0.0, -98.7, 1e-20]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(round_significant(F.col("x"))).collect()]
    import math
    want = [round(v, 1 - math.floor(math.log10(max(1e-12, abs(v))))) for v in values]
    assert got == pytest.approx(want)


def test_fixed_offset_has_no_summer_time(spark):
    from wattloom.sources.raw_files import fixed_offset_to_utc

    row = spark.range(1).select(fixed_offset_to_utc(F.lit("2015/07/01"), F.lit("12:00"))).first()
    assert row[0] == dt.datetime(2015, 7, 1, 11, 0)
