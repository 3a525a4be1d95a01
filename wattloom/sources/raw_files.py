"""Readers of the raw text files: load, weather, stations, mappings, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import grid_region_name, region_name, site_name, station_name, strip_accents

# Layout of the load files.
LOAD_FORMAT = {"sep": "\t", "encoding": "ISO-8859-1", "nullValue": "ND"}
LOAD_COLUMNS = {"date": "Date", "time": "Heures", "value": "Consommation"}
LOAD_TIME = "yyyy/MM/dd HH:mm"

# Layout of the weather files.
WEATHER_FORMAT = {"sep": ";", "nullValue": "mq"}
WEATHER_COLUMNS = {"date": "ts", "numer_sta": "station", "t": "temperature", "n": "nebulosity", "ff": "wind_speed"}
WEATHER_TIME = "yyyyMMddHHmmss"
ZERO_CELSIUS = 273.15

# Layout of the station and weight files.
STATION_COLUMNS = {"ID": "station_id", "Nom": "name", "Latitude": "latitude", "Longitude": "longitude"}
WEIGHT_NAME = "Nom station"
NATIONAL_ZONE = "FRAN"


def fixed_offset_to_utc(date: Column, time: Column, hours: int = 1, fmt: str = LOAD_TIME) -> Column:
    """Local date and time at a fixed offset from UTC, all year; null if unreadable."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(fmt)) - F.expr(f"INTERVAL {hours} HOURS")


def packed_utc(column: Column) -> Column:
    return F.try_to_timestamp(column, F.lit(WEATHER_TIME))


def read_named(spark: SparkSession, path: str, columns: list[str], **options) -> DataFrame:
    """Text columns of the CSV files below ``path``, found by the names in their header.

    Further columns may stand anywhere. A missing column is an error, and so is a file
    whose header differs from that of the others.
    """
    raw = spark.read.options(header=True, enforceSchema=False, **options).csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}; it has {raw.columns}")
    return raw


def read_load_files(spark: SparkSession, path: str, file_name: str | None = None) -> DataFrame:
    """(site, year, ts, value) of all load files below ``path``.

    Files lie in ``site=.../year=...`` folders or, with ``file_name``, a pattern of two
    groups, carry site and year in their names. Footer lines have no readable time and are
    dropped; so are the rows between full hours.
    """
    raw = read_named(spark, path, list(LOAD_COLUMNS.values()), **LOAD_FORMAT)
    if file_name is not None:
        name = F.regexp_extract(F.col("_metadata.file_name"), "^(.*)$", 1)
        raw = raw.withColumns({"site": F.regexp_extract(name, file_name, 1), "year": F.regexp_extract(name, file_name, 2)})
    raw = raw.withColumns({"site": F.col("site").cast("string"), "year": F.col("year").cast("int")})
    local = F.try_to_timestamp(F.concat_ws(" ", LOAD_COLUMNS["date"], LOAD_COLUMNS["time"]), F.lit(LOAD_TIME))
    return every_full_hour(
        raw.filter(local.isNotNull()).select(
            strip_accents(F.col("site")).alias("site"), "year",
            fixed_offset_to_utc(F.col(LOAD_COLUMNS["date"]), F.col(LOAD_COLUMNS["time"])).alias("ts"),
            F.col(LOAD_COLUMNS["value"]).try_cast("double").alias("value"),
        )
    )


def every_full_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Every fourth of the 15-minute rows, by time, so that it is position-free."""
    return df.filter((F.minute(ts) == 0) & (F.second(ts) == 0))


def read_weather_files(spark: SparkSession, path: str) -> DataFrame:
    """(station, quantity, ts, value), temperatures in Celsius; gzip is read as is."""
    raw = read_named(spark, path, list(WEATHER_COLUMNS), **WEATHER_FORMAT)
    named = raw.select(*[F.col(old).alias(new) for old, new in WEATHER_COLUMNS.items()])
    typed = named.select(
        "station", packed_utc(F.col("ts")).alias("ts"),
        (F.col("temperature").try_cast("double") - ZERO_CELSIUS).alias("temperature"),
        F.col("nebulosity").try_cast("double").alias("nebulosity"),
        F.col("wind_speed").try_cast("double").alias("wind_speed"),
    )
    return typed.unpivot(["station", "ts"], ["temperature", "nebulosity", "wind_speed"], "quantity", "value")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    raw = read_named(spark, path, list(STATION_COLUMNS), sep=";")
    renamed = raw.select(*[F.col(old).alias(new) for old, new in STATION_COLUMNS.items()]).withColumns(
        {c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})
    return renamed.withColumn("name", station_name(F.col("name")))


def read_site_regions(spark: SparkSession, path: str, kind: str = "administrative") -> DataFrame:
    """(site, region) from a two-column CSV; ``kind`` is ``administrative`` or ``grid``."""
    clean = region_name if kind == "administrative" else grid_region_name
    raw = spark.read.schema("site string, region string").options(header=True).csv(path)
    return raw.select(site_name(F.col("site")).alias("site"), clean(F.col("region")).alias("region"))


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    """(site, region) from a Parquet table with the columns ``site`` and ``district``; names stay as they are."""
    return spark.read.schema("site string, district string").parquet(path).select("site", F.col("district").alias("region"))


def read_station_weights(spark: SparkSession, path: str, zones: list[str]) -> DataFrame:
    """(station, zone, weight) from one column per zone, decimal comma, null as 0."""
    raw = read_named(spark, path, [WEIGHT_NAME, *zones], sep=";")
    long = raw.select(WEIGHT_NAME, *[F.col(f"`{zone}`") for zone in zones]).unpivot([WEIGHT_NAME], zones, "zone", "text")
    weight = F.coalesce(F.replace("text", F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    return long.select(station_name(F.col(WEIGHT_NAME)).alias("station"), "zone", weight.alias("weight"))
