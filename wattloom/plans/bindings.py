"""The roles of the engine (load, weather, places) derived from the given tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import geography, grid, transform
from ..operators.evaluate import weekly_naive
from ..operators.split import split_periods
from ..session import stage
from .formulas import WANTED


def prepared(build):
    """A load or weather table: raw rows are read and summed once, then the small
    result is written and serves every later step."""
    @wraps(build)
    def read(spark, sf):
        return stage(spark, sf, build.__name__, lambda: build(spark, sf))

    return read


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)"))


@prepared
def load_h(spark, sf) -> DataFrame:
    """Hourly load: one site per event type, sum of the values."""
    return table(spark, sf, "events").groupBy(
        F.col("event_type").alias("site"), F.date_trunc("hour", "ts").alias("ts")
    ).agg(money("value").cast("double").alias("value"))


def hourly(spark, sf) -> DataFrame:
    return grid.reindex(load_h(spark, sf), ["site"], "ts", 3600)


def clean_h(spark, sf) -> DataFrame:
    """Hourly load on the full grid, gaps back-filled, empty tail dropped."""
    return grid.backfill(hourly(spark, sf), ["site"], "ts", "value", 3600).filter("value IS NOT NULL")


@prepared
def load_q(spark, sf) -> DataFrame:
    """Quarter-hourly load."""
    quarter = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 900) * 900)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("site"), quarter.alias("ts")).agg(
        money("value").cast("double").alias("value")
    )


@prepared
def load_d(spark, sf) -> DataFrame:
    """Daily load: one site per nation, sum of the order totals."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.groupBy(F.col("n_name").alias("site"), F.date_trunc("day", "o_orderdate").alias("ts")).agg(
        money("o_totalprice").cast("double").alias("value")
    )


def daily(spark, sf) -> DataFrame:
    return grid.reindex(load_d(spark, sf), ["site"], "ts", 86400)


@prepared
def load_s(spark, sf) -> DataFrame:
    """Daily shipped quantity: the total, each line status and each return flag as a site."""
    return table(spark, sf, "lineitem").select(
        F.explode(F.array(F.lit("ALL"), F.concat(F.lit("S_"), "l_linestatus"), F.concat(F.lit("R_"), "l_returnflag"))).alias("site"),
        F.date_trunc("day", "l_shipdate").alias("ts"), "l_quantity",
    ).groupBy("site", "ts").agg(money("l_quantity").cast("double").alias("value"))


def shipped(spark, sf) -> DataFrame:
    return grid.reindex(load_s(spark, sf), ["site"], "ts", 86400)


@prepared
def weather(spark, sf) -> DataFrame:
    """Hourly weather of 8 stations, three quantities, long form."""
    wide = table(spark, sf, "events").groupBy(
        F.concat(F.lit("ST_"), (F.col("user_id") % 8).cast("string")).alias("station"),
        F.date_trunc("hour", "ts").alias("ts"),
    ).agg(
        (money("value").cast("double") / F.count(F.lit(1))).alias("temperature"),
        (F.count(F.lit(1)) % 9).cast("double").alias("nebulosity"),
        F.max("value").alias("wind_speed"),
    )
    return grid.wide_to_long(wide, ["station", "ts"], ["temperature", "nebulosity", "wind_speed"], "quantity", "value")


def weather_grid(spark, sf) -> DataFrame:
    return grid.reindex(weather(spark, sf), ["station", "quantity"], "ts", 3600)


def weather_filled(spark, sf) -> DataFrame:
    """Weather on the full grid, interpolated, the leading gap back-filled."""
    keys = ["station", "quantity"]
    return grid.interpolate(weather_grid(spark, sf), keys, "ts", "value", 3600, fill_start=True)


def coords(df: DataFrame, key: str, name: str) -> DataFrame:
    """Coordinates in degrees derived from an integer key."""
    return df.select(
        F.col(name).alias("name"),
        (42 + (F.col(key) * 37 % 80).cast("double") / 10).alias("latitude"),
        (-4 + (F.col(key) * 53 % 110).cast("double") / 10).alias("longitude"),
    )


def nation_coords(spark, sf) -> DataFrame:
    return coords(table(spark, sf, "nation"), "n_nationkey", "n_name")


def supplier_coords(spark, sf) -> DataFrame:
    return coords(table(spark, sf, "supplier"), "s_suppkey", "s_name")


def customer_coords(spark, sf) -> DataFrame:
    return coords(table(spark, sf, "customer"), "c_custkey", "c_name")


def station_coords(spark, sf) -> DataFrame:
    keys = table(spark, sf, "events").select((F.col("user_id") % 8).alias("k")).distinct()
    return coords(keys.withColumn("station", F.concat(F.lit("ST_"), F.col("k").cast("string"))), "k", "station")


def type_coords(spark, sf) -> DataFrame:
    """Coordinates of the event types, from the length of their names."""
    kinds = table(spark, sf, "events").select("event_type").distinct()
    return coords(kinds.withColumn("k", F.length("event_type") * 3), "k", "event_type")


def site_region(spark, sf) -> DataFrame:
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("site"), F.col("r_name").alias("region")
    )


def station_weights(spark, sf) -> DataFrame:
    """Weight of each station in each region and in the whole, from the supplier balances."""
    supplier, nation, region = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    rows = (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("ST_"), (F.col("s_suppkey") % 8).cast("string")).alias("station"),
            F.explode(F.array(F.lit("FRAN"), F.col("r_name"))).alias("zone"),
            F.abs(F.col("s_acctbal").cast("decimal(18,2)")).alias("w"),
        )
    )
    return rows.groupBy("station", "zone").agg(F.sum("w").cast("double").alias("weight"))


def split_h(spark, sf) -> DataFrame:
    """Hourly load split in 20 days of training and 10 days of validation."""
    return split_periods(clean_h(spark, sf), "ts", "2024-01-01", "20 days", "10 days")


def naive(spark, sf) -> DataFrame:
    """Weekly naive prediction on both splits."""
    return weekly_naive(split_h(spark, sf)).select("site", "split", "ts", "target", "prediction")


CALENDAR = {
    "hour": F.hour, "week_day": calendar.week_day, "week_hour": calendar.week_hour, "year_day": calendar.year_day,
    "weekend": calendar.weekend, "timestamp": calendar.epoch_hours, "holidays": calendar.holidays,
}


def calendar_h(clean: DataFrame) -> DataFrame:
    """(name, location, ts, value) of the calendar variables; they have one empty location."""
    times = calendar.daylight(clean.select("ts").distinct(), "ts")
    values = {name: function(F.col("ts")).cast("double") for name, function in CALENDAR.items()}
    wide = times.select("ts", *[c.alias(n) for n, c in values.items()], F.col("daylight").cast("double"))
    long = grid.wide_to_long(wide, ["ts"], [*CALENDAR, "daylight"], "name", "value")
    return long.select("name", F.lit("").alias("location"), "ts", "value")


def input_sources(spark, sf) -> dict[str, DataFrame]:
    """Every input name with its series as (location, ts, value)."""
    clean = stage(spark, sf, "clean_h", lambda: clean_h(spark, sf))
    filled = stage(spark, sf, "weather_filled", lambda: weather_filled(spark, sf))
    days = stage(spark, sf, "calendar_h", lambda: calendar_h(clean))
    names = [*CALENDAR, "daylight"]
    sources = {name: days.filter(F.col("name") == name).select("location", "ts", "value") for name in names}
    sources["target"] = clean.select(F.col("site").alias("location"), "ts", "value")
    for quantity in ("temperature", "nebulosity", "wind_speed"):
        sources[quantity] = filled.filter(F.col("quantity") == quantity).select(
            F.col("station").alias("location"), "ts", "value"
        )
    return sources


def filled_d(spark, sf) -> DataFrame:
    """Daily load on the full grid, gaps back-filled."""
    return grid.backfill(daily(spark, sf), ["site"], "ts", "value", 86400)


def inputs_h(spark, sf, wanted=None) -> DataFrame:
    """Long inputs on the hourly grid with their split, written once per session."""
    def build():
        every = transform.unfold(input_sources(spark, sf), WANTED)
        return split_periods(every, "ts", "2024-01-01", "20 days", "10 days")

    rows = stage(spark, sf, "inputs_h", build)
    return rows if wanted is None else rows.filter(F.col("name_input").isin([w[0] for w in wanted]))


def sites_h(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("site")).distinct()


def assignment_h(spark, sf, k: int = 2) -> DataFrame:
    """Each site owns its own target and the k nearest stations for the temperature."""
    def build():
        near = geography.rank_by_distance(type_coords(spark, sf), station_coords(spark, sf), k)
        stations = near.select(
            F.col("name_a").alias("site"), F.lit("temperature").alias("name_input"), F.col("name_b").alias("location")
        )
        own = sites_h(spark, sf).select("site", F.lit("target").alias("name_input"), F.col("site").alias("location"))
        return stations.unionByName(own)

    return stage(spark, sf, f"assignment_h_{k}", build)
