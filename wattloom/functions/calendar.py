"""Calendar variables as column expressions: no join, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public holidays with a fixed date, as (month, day).
FIXED_HOLIDAYS = [(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)]

# Days from Easter Monday to the movable holidays.
MOVABLE_OFFSETS = [0, 38, 49]

# School summer breaks and Christmas breaks (first day, last day).
SUMMER_BREAKS = [
    ("2012-07-14", "2012-08-26"),
    ("2013-07-13", "2013-08-25"),
    ("2014-07-19", "2014-08-31"),
    ("2015-07-18", "2015-08-30"),
    ("2016-07-16", "2016-08-28"),
    ("2017-07-15", "2017-08-27"),
    ("2018-07-14", "2018-08-26"),
    ("2019-07-13", "2019-08-25"),
]
CHRISTMAS_BREAKS = [
    ("2012-12-22", "2013-01-06"),
    ("2013-12-21", "2014-01-05"),
    ("2014-12-20", "2015-01-04"),
    ("2015-12-19", "2016-01-03"),
    ("2016-12-17", "2017-01-01"),
    ("2017-12-23", "2018-01-07"),
    ("2018-12-22", "2019-01-06"),
    ("2019-12-21", "2020-01-05"),
]

# Paris, and the zenith angle of sunrise and sunset in degrees.
PARIS = (48.0 + 50.0 / 60.0, 2.0 + 20.0 / 60.0)
SUN_ZENITH = 90.833


def year_day(ts: Column) -> Column:
    return F.dayofyear(ts)


def week_day(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def weekend(ts: Column) -> Column:
    return (week_day(ts) > 4).cast("int")


def week_hour(ts: Column) -> Column:
    return F.hour(ts) + 24 * week_day(ts)


def epoch_hours(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(3.6e9)


def easter_monday(year: Column) -> Column:
    """Gregorian computus (Meeus), any year."""
    def div(a, b):
        return F.floor(a / b)

    golden = year % 19
    century, in_century = div(year, 100), year % 100
    correction = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * div(in_century, 4) - correction - in_century % 4) % 7
    shift = div(golden + 11 * correction + 22 * weekday, 451)
    month = div(correction + weekday - 7 * shift + 114, 31)
    day = (correction + weekday - 7 * shift + 114) % 31 + 1
    return F.date_add(F.make_date(year, month.cast("int"), day.cast("int")), 1)


def holidays(ts: Column) -> Column:
    date = F.to_date(ts)
    fixed = (F.month(date) * 100 + F.dayofmonth(date)).isin([m * 100 + d for m, d in FIXED_HOLIDAYS])
    movable = F.datediff(date, easter_monday(F.year(date))).isin(MOVABLE_OFFSETS)
    return (fixed | movable).cast("int")


def in_intervals(df: DataFrame, ts: str, intervals: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """1 where the date lies in one of the closed intervals (``start``, ``end``), else 0.

    The intervals are unrolled into their days, so the test is an equality join
    on the date and not a range join. Nothing is known of dates that are not strictly between
    the first and the last day of all intervals: they stop the job, or get null without
    ``strict``. Null times get null.
    """
    span = intervals.agg(F.struct(F.min("start").alias("lo"), F.max("end").alias("hi")).alias("s")).scalar()
    days = intervals.select(F.explode(F.sequence("start", "end")).alias("_day")).distinct()
    marked = df.withColumn("_day", F.to_date(ts)).join(days.withColumn("_hit", F.lit(1)), "_day", "left")
    outside = F.coalesce((F.col("_day") <= span["lo"]) | (F.col("_day") >= span["hi"]), F.lit(True))
    unknown = F.raise_error(F.concat(F.lit(f"{name}: no interval is known around "), F.col("_day").cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    value = F.when(F.col("_day").isNull(), F.lit(None).cast("int")).when(outside, unknown).otherwise(F.coalesce("_hit", F.lit(0)))
    return marked.withColumn(name, value).drop("_hit", "_day")


def fixed_intervals(spark, intervals: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(intervals, "start string, end string").select(
        F.to_date("start").alias("start"), F.to_date("end").alias("end")
    )


def check_intervals(df: DataFrame, ts: str, intervals: DataFrame) -> DataFrame:
    """Counts of dates outside the covered span and of badly bounded intervals."""
    span = intervals.agg(F.struct(F.min("start").alias("lo"), F.max("end").alias("hi")).alias("s")).scalar()
    date = F.to_date(ts)
    outside = df.agg(
        F.count_if((date <= span["lo"]) | (date >= span["hi"])).alias("violations")
    ).select(F.lit("date_outside").alias("check"), "violations")
    bounds = intervals.agg(F.count_if((F.weekday("start") != 5) | (F.weekday("end") != 6)).alias("violations"))
    return outside.unionByName(bounds.select(F.lit("interval_bounds").alias("check"), "violations"))


def _sun_pass(days: DataFrame, century: Column, rising: bool, latitude: float, longitude: float, name: str) -> DataFrame:
    """One evaluation of the NOAA equations; staged so that each term is computed once."""
    t, rad = F.col("_t"), F.radians
    phi = rad(F.lit(latitude))
    stages = [
        {"_t": century},
        {
            "_long": rad(F.pmod(280.46646 + t * (36000.76983 + 0.0003032 * t), F.lit(360.0))),
            "_anom": rad(357.52911 + t * (35999.05029 - 0.0001537 * t)),
            "_ecc": 0.016708634 - t * (0.000042037 + 0.0000001267 * t),
            "_node": rad(125.04 - 1934.136 * t),
            "_tilt0": 23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0,
        },
        {
            "_centre": F.sin("_anom") * (1.914602 - t * (0.004817 + 0.000014 * t))
            + F.sin(2 * F.col("_anom")) * (0.019993 - 0.000101 * t)
            + F.sin(3 * F.col("_anom")) * 0.000289,
            "_tilt": rad(F.col("_tilt0") + 0.00256 * F.cos("_node")),
        },
        {
            "_apparent": F.col("_long") + rad(F.col("_centre") - 0.00569 - 0.00478 * F.sin("_node")),
            "_y": F.pow(F.tan(F.col("_tilt") / 2), 2.0),
        },
        {
            "_decl": F.asin(F.sin("_tilt") * F.sin("_apparent")),
            "_equation": 4 * F.degrees(
                F.col("_y") * F.sin(2 * F.col("_long"))
                - 2 * F.col("_ecc") * F.sin("_anom")
                + 4 * F.col("_ecc") * F.col("_y") * F.sin("_anom") * F.cos(2 * F.col("_long"))
                - 0.5 * F.col("_y") * F.col("_y") * F.sin(4 * F.col("_long"))
                - 1.25 * F.col("_ecc") * F.col("_ecc") * F.sin(2 * F.col("_anom"))
            ),
        },
        {
            "_angle": F.degrees(F.acos(
                F.cos(rad(F.lit(SUN_ZENITH))) / (F.cos(phi) * F.cos("_decl")) - F.tan(phi) * F.tan("_decl")
            ))
        },
        {name: 720 - 4 * (longitude + (F.col("_angle") if rising else -F.col("_angle"))) - F.col("_equation")},
    ]
    kept = days.columns
    for stage in stages:
        days = days.withColumns(stage)
    return days.select(*kept, name)


def sun_times(days: DataFrame, date: str, latitude: float = PARIS[0], longitude: float = PARIS[1]) -> DataFrame:
    """Add ``sunrise`` and ``sunset`` in minutes after midnight UTC (two passes each)."""
    noon = (F.datediff(F.col(date), F.lit("2000-01-01").cast("date")) - 0.5) / 36525.0
    for name, rising in (("sunrise", True), ("sunset", False)):
        days = _sun_pass(days, noon, rising, latitude, longitude, "_first")
        days = _sun_pass(days, noon + F.col("_first") / 1440.0 / 36525.0, rising, latitude, longitude, name)
        days = days.drop("_first")
    return days


def daylight(df: DataFrame, ts: str, latitude: float = PARIS[0], longitude: float = PARIS[1]) -> DataFrame:
    """Add ``daylight``: 1 strictly between sunrise and sunset, solved once per date."""
    dated = df.withColumn("_date", F.to_date(ts))
    days = sun_times(dated.select("_date").distinct(), "_date", latitude, longitude)
    midnight = F.unix_micros(F.col("_date").cast("timestamp"))
    minute = (F.unix_micros(F.col(ts).cast("timestamp")) - midnight) / F.lit(6e7)
    lit_up = (minute > F.col("sunrise")) & (minute < F.col("sunset"))
    return dated.join(days, "_date").withColumn("daylight", lit_up.cast("int")).drop("_date", "sunrise", "sunset")


def calendar_variables(df: DataFrame, ts: str, summer: DataFrame, christmas: DataFrame) -> DataFrame:
    """All ten calendar variables of a column of timestamps."""
    at = F.col(ts)
    out = df.withColumns({
        "year_day": year_day(at), "week_day": week_day(at), "weekend": weekend(at),
        "week_hour": week_hour(at), "hour": F.hour(at), "timestamp": epoch_hours(at),
        "holidays": holidays(at),
    })
    out = in_intervals(out, ts, summer, "summer_break")
    out = in_intervals(out, ts, christmas, "xmas")
    return daylight(out, ts)
