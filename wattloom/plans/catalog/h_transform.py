"""H: transformations of series."""

from pyspark.sql import functions as F

from ...functions import calendar
from ...operators import transform
from ...operators.chunks import smoothing
from .. import bindings as b
from ..registry import query
from ..sql_parts import final, rounded, with_parts
from .common import tidy

KEY = ["site"]
W = "WINDOW w AS (PARTITION BY site ORDER BY ts RANGE BETWEEN {0} AND {1})"
BACK = W.format("INTERVAL {0} HOUR PRECEDING", "CURRENT ROW")


def over(expression: str, hours: int = 24, source: str = "clean_h") -> str:
    return f"(SELECT site, ts, {expression} AS value FROM {source} {BACK.format(hours)})"


LAGGED = "first_value(value) OVER w"


@query("h1_identity", final("site ts! value~", "clean_h"))
def h1(spark, sf):
    return tidy(transform.transform_input(b.clean_h(spark, sf), KEY, "ts", "value", ""))


@query("h2_binary", final("site ts! category# value#", """(SELECT c.site, c.ts, k.category, CAST(isodow(c.ts) - 1 = k.category AS INT) AS value
    FROM load_h c JOIN (SELECT DISTINCT site, isodow(ts) - 1 AS category FROM load_h) k USING (site))"""))
def h2(spark, sf):
    week = b.load_h(spark, sf).select("site", "ts", calendar.week_day(F.col("ts")).alias("value"))
    return tidy(transform.transform_input(week, KEY, "ts", "value", "binary"))


@query("h3_lag", final("site ts! value~", over(LAGGED)))
def h3(spark, sf):
    return tidy(transform.transform_input(b.clean_h(spark, sf), KEY, "ts", "value", "lag", 24))


@query("h4_lead", final("site ts! value~", "(SELECT site, ts, lead(value, 24) OVER (PARTITION BY site ORDER BY ts) AS value FROM clean_h)"))
def h4(spark, sf):
    return tidy(transform.transform_input(b.clean_h(spark, sf), KEY, "ts", "value", "lag", -24))


SMOOTH = """WITH RECURSIVE base AS (SELECT * FROM ({source})),
    smooth AS (SELECT site, ts, i, value AS s FROM base WHERE i = 1
      UNION ALL SELECT n.site, n.ts, n.i, (1 - {alpha}::DOUBLE) * s.s + {alpha}::DOUBLE * n.value FROM smooth s JOIN base n ON n.site = s.site AND n.i = s.i + 1)
    SELECT site, CAST(ts AS VARCHAR) AS ts, {value} AS value FROM smooth"""


@query("h5_smoothing", SMOOTH.format(alpha=0.05, value=rounded("s"), source=with_parts(
    "SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS i FROM clean_h")))
def h5(spark, sf):
    return tidy(smoothing(b.clean_h(spark, sf), KEY, "ts", "value", 0.05, 3600).select("site", "ts", F.col("smoothed").alias("value")))


@query("h6_difference", final("site ts! value~", over(f"value - {LAGGED}")))
def h6(spark, sf):
    return tidy(transform.transform_input(b.clean_h(spark, sf), KEY, "ts", "value", "difference", 24))


@query("h7_minimum", final("site ts! value~", "(SELECT site, ts, min(value) OVER w AS value FROM hourly WINDOW w AS (PARTITION BY site ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"))
def h7(spark, sf):
    return tidy(transform.transform_input(b.hourly(spark, sf), KEY, "ts", "value", "minimum", 24))


@query("h8_maximum", final("site ts! value~", "(SELECT site, ts, max(value) OVER w AS value FROM hourly WINDOW w AS (PARTITION BY site ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"))
def h8(spark, sf):
    return tidy(transform.transform_input(b.hourly(spark, sf), KEY, "ts", "value", "maximum", 24))


@query("h9_assemble", final("name_input transformation parameter location ts! value~", """(
    SELECT 'target' AS name_input, 'lag' AS transformation, '24' AS parameter, site AS location, ts, value FROM lagged
    UNION ALL SELECT 'temperature', '', '', station, ts, value FROM weather_filled WHERE quantity = 'temperature'
    UNION ALL SELECT 'temperature', 'maximum', '24', station, ts, max(value) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) FROM weather_filled WHERE quantity = 'temperature'
    UNION ALL SELECT 'hour', '', '', '', ts, hour(ts) FROM (SELECT DISTINCT ts FROM clean_h)
    UNION ALL SELECT 'week_day', 'binary', '', CAST(k AS VARCHAR), ts, CAST(isodow(ts) - 1 = k AS INT) FROM (SELECT DISTINCT ts FROM clean_h), (SELECT DISTINCT isodow(ts) - 1 AS k FROM clean_h))""",
    lagged=f"SELECT site, ts, {LAGGED} AS value FROM clean_h {BACK.format(24)}"))
def h9(spark, sf):
    """Calendar, weather and target inputs in one long table; a repeated request counts once."""
    wanted = [
        ("target", "lag", 24), ("temperature", "", None), ("temperature", "maximum", 24),
        ("hour", "", None), ("week_day", "binary", None), ("target", "lag", 24),
    ]
    return tidy(transform.unfold(b.input_sources(spark, sf), wanted))
