"""The whole preparation of load and weather, from raw series to prepared tables."""

from pyspark.sql import functions as F

from ...operators import prepare
from .. import bindings as b
from ..registry import query
from ..sql_parts import backfilled, final, full_grid, interpolated, with_parts
from .common import tidy

CHAIN = {
    "odd_weather": """SELECT station, quantity, ts, CASE WHEN station = 'ST_1' AND quantity = 'nebulosity' THEN 3
        WHEN station = 'ST_5' AND quantity = 'wind_speed' AND ts < TIMESTAMP '2024-01-04' THEN NULL ELSE value END AS value FROM weather""",
    "odd_places": full_grid("odd_weather", "station, quantity", "HOUR", " + INTERVAL 2 HOUR"),
    "odd_grid": "SELECT g.station, g.quantity, g.ts, w.value FROM odd_places g LEFT JOIN odd_weather w USING (station, quantity, ts)",
    "odd_lines": interpolated("odd_grid", "station, quantity"),
    "series_facts": """SELECT station, quantity, min(CASE WHEN value IS NOT NULL THEN ts END) > (SELECT min(ts) FROM odd_lines) + INTERVAL 24 HOUR AS is_late,
        count(DISTINCT value) AS n FROM odd_lines GROUP BY 1, 2""",
    "series_left": "SELECT station, quantity FROM series_facts WHERE NOT is_late AND n > 1",
    "stations_left": "SELECT station FROM series_left GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT quantity) FROM series_left)",
    "odd_filled": backfilled("(SELECT * FROM odd_lines SEMI JOIN series_left USING (station, quantity) SEMI JOIN stations_left USING (station))", "station, quantity"),
}


def odd_weather(spark, sf):
    """The weather with one constant series, and one that starts three days late."""
    constant = (F.col("station") == "ST_1") & (F.col("quantity") == "nebulosity")
    late = (F.col("station") == "ST_5") & (F.col("quantity") == "wind_speed") & (F.col("ts") < F.lit("2024-01-04").cast("timestamp"))
    return b.weather(spark, sf).withColumn("value", F.when(constant, 3.0).when(~late, F.col("value")))


@query("preprocess_weather", final("station quantity source ts! value~8", "(SELECT *, 'observed' AS source FROM odd_filled)", **CHAIN))
def preprocess_weather(spark, sf):
    return tidy(prepare.prepare_weather(odd_weather(spark, sf))[0], 8)


@query("preprocess_weather_dropped", with_parts("""SELECT station FROM series_facts WHERE is_late
    UNION SELECT station FROM series_left WHERE station NOT IN (SELECT station FROM stations_left)""", **CHAIN))
def preprocess_weather_dropped(spark, sf):
    return prepare.prepare_weather(odd_weather(spark, sf))[1]


@query("preprocess_load")
def preprocess_load(spark, sf):
    """Shipped quantities: gridded, back-filled, flagged, repaired by ridge, gated at the usual limits."""
    return tidy(prepare.prepare_load(b.load_s(spark, sf), "ridge", 86400, 7)[0])


@query("preprocess_load_dropped")
def preprocess_load_dropped(spark, sf):
    return prepare.prepare_load(b.load_s(spark, sf), "ridge", 86400, 7)[1]
