"""G: calendar functions, on order dates and event times."""

from pyspark.sql import functions as F

from ...functions import calendar
from .. import bindings as b
from ..registry import query
from ..sql_parts import final, with_parts
from .common import tidy


def events(spark, sf):
    return b.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))


def orders(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))


def simple(name, column, expression, sql):
    @query(name, f"SELECT event_id, {sql} AS {column} FROM events")
    def run(spark, sf):
        return tidy(events(spark, sf).select("event_id", expression(F.col("ts")).alias(column)))


simple("g1_year_day", "year_day", calendar.year_day, "CAST(dayofyear(ts) AS BIGINT)")
simple("g2_week_day", "week_day", calendar.week_day, "CAST(isodow(ts) - 1 AS BIGINT)")
simple("g3_weekend", "weekend", calendar.weekend, "CAST(isodow(ts) > 5 AS BIGINT)")
simple("g4_week_hour", "week_hour", calendar.week_hour, "CAST(hour(ts) + 24 * (isodow(ts) - 1) AS BIGINT)")
simple("g5_hour", "hour", F.hour, "CAST(hour(ts) AS BIGINT)")
simple("g6_timestamp", "hours", calendar.epoch_hours, "round(epoch_us(ts) / 3.6e9, 6)")

EASTER = {
    "years": "SELECT DISTINCT year(o_orderdate) AS y FROM orders",
    # the anonymous Gregorian computus, in the form with a century table
    "paschal": "SELECT y, (19 * (y % 19) + y // 100 - y // 400 - (8 * (y // 100) + 13) // 25 + 15) % 30 AS h FROM years",
    "moon": "SELECT y, h - (h // 28) * (1 - (h // 28) * (29 // (h + 1)) * ((21 - y % 19) // 11)) AS i FROM paschal",
    "sunday": "SELECT y, i - (y + y // 4 + i + 2 - y // 100 + y // 400) % 7 AS l FROM moon",
    "easter": "SELECT make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) + 1 AS monday FROM sunday",
    "off_days": """SELECT monday AS d FROM easter UNION SELECT monday + 38 FROM easter UNION SELECT monday + 49 FROM easter
        UNION SELECT make_date(y, m, d) FROM years, (VALUES (1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)) AS f(m, d)""",
}


@query("g7_holidays", with_parts("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) IN (SELECT d FROM off_days) AS BIGINT) AS holidays FROM orders", **EASTER))
def g7(spark, sf):
    return tidy(orders(spark, sf).select("o_orderkey", calendar.holidays(F.col("ts")).alias("holidays")))


def breaks(spark, first: str, last: str, next_year: int):
    """Break intervals of the years of the orders: same days every year."""
    return spark.range(1994, 2003).select(
        F.expr(f"make_date(id, {first})").alias("start"), F.expr(f"make_date(id + {next_year}, {last})").alias("end")
    )


@query("g8_summer_break", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%m%d') BETWEEN '0714' AND '0826' AS BIGINT) AS summer_break FROM orders")
def g8(spark, sf):
    marked = calendar.in_intervals(orders(spark, sf), "ts", breaks(spark, "7, 14", "8, 26", 0), "summer_break")
    return tidy(marked.select("o_orderkey", "summer_break"))


@query("g9_christmas_break", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%m%d') >= '1222' OR strftime(o_orderdate, '%m%d') <= '0105' AS BIGINT) AS xmas FROM orders")
def g9(spark, sf):
    marked = calendar.in_intervals(orders(spark, sf), "ts", breaks(spark, "12, 22", "1, 5", 1), "xmas")
    return tidy(marked.select("o_orderkey", "xmas"))


def sun_pass(source: str, century: str, sign: str, name: str) -> str:
    """One evaluation of the NOAA equations over ``source`` (d, ...)."""
    return f"""SELECT d, 720 - 4 * (2 + 20.0 / 60 {sign} degrees(acos(cos(radians(90.833)) / (cos(radians(48 + 50.0 / 60)) * cos(decl))
          - tan(radians(48 + 50.0 / 60)) * tan(decl)))) - 4 * degrees(y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l)
          - 0.5 * y * y * sin(4 * l) - 1.25 * e * e * sin(2 * m)) AS {name} FROM (
      SELECT *, asin(sin(tilt) * sin(l + radians(centre - 0.00569 - 0.00478 * sin(node)))) AS decl, tan(tilt / 2) ** 2 AS y FROM (
      SELECT *, sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 AS centre,
        radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(node)) AS tilt FROM (
      SELECT *, radians((280.46646 + t * (36000.76983 + 0.0003032 * t)) % 360) AS l, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m,
        0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, radians(125.04 - 1934.136 * t) AS node FROM (
      SELECT *, CAST({century} AS DOUBLE) AS t FROM {source}))))"""


NOON = "((d - DATE '2000-01-01') - 0.5) / 36525"
SUN = {
    "sun_days": "SELECT DISTINCT CAST(ts AS DATE) AS d FROM events",
    "rise_one": sun_pass("sun_days", NOON, "+", "r"),
    "rise_two": sun_pass("rise_one", f"{NOON} + r / 1440 / 36525", "+", "sunrise"),
    "set_one": sun_pass("sun_days", NOON, "-", "r"),
    "set_two": sun_pass("set_one", f"{NOON} + r / 1440 / 36525", "-", "sunset"),
}


@query("g10_daylight", with_parts("""SELECT event_id, CAST(m > sunrise AND m < sunset AS BIGINT) AS daylight FROM (
    SELECT event_id, CAST(ts AS DATE) AS d, epoch_us(ts - date_trunc('day', ts)) / 6e7 AS m FROM events) JOIN rise_two USING (d) JOIN set_two USING (d)""", **SUN))
def g10(spark, sf):
    return tidy(calendar.daylight(events(spark, sf), "ts").select("event_id", "daylight"))


@query("g11_range_validation", """SELECT 'date_outside' AS check, count(*) FILTER (CAST(o_orderdate AS DATE) <= DATE '1994-07-14' OR CAST(o_orderdate AS DATE) >= DATE '2002-08-26') AS violations FROM orders
    UNION ALL SELECT 'interval_bounds', count(*) FILTER (isodow(make_date(y, 7, 14)) <> 6 OR isodow(make_date(y, 8, 26)) <> 7) FROM range(1994, 2003) AS t(y)""")
def g11(spark, sf):
    return calendar.check_intervals(orders(spark, sf), "ts", breaks(spark, "7, 14", "8, 26", 0))
