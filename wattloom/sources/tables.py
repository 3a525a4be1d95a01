"""Prepared tables: coordinates, load, weather, predictions, scores, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Coordinates in degrees of the national and the regional sites.
NATIONAL_COORDINATES = [("France", 46.0, 2.0)]
REGIONAL_COORDINATES = [
    ("Auvergne-Rhône-Alpes", 45.5, 4.6),
    ("Bourgogne-Franche-Comté", 47.1, 4.8),
    ("Bretagne", 48.1, -2.8),
    ("Centre-Val-de-Loire", 47.5, 1.8),
    ("Grand-Est", 48.7, 5.8),
    ("Hauts-de-France", 49.9, 2.9),
    ("Ile-de-France", 48.8, 2.5),
    ("Normandie", 49.0, 0.3),
    ("Nouvelle-Aquitaine", 45.2, 0.0),
    ("Occitanie", 43.6, 2.3),
    ("PACA", 43.8, 6.4),
    ("Pays-de-la-Loire", 47.5, -0.7),
]
COORDINATES = "name string, latitude double, longitude double"


def coordinates(spark: SparkSession, level: str = "regions") -> DataFrame:
    return spark.createDataFrame(NATIONAL_COORDINATES if level == "national" else REGIONAL_COORDINATES, COORDINATES)


def read_wide_load(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """Wide CSV, first column the UTC time, one column per site, to (site, ts, value)."""
    wide = spark.read.options(header=True).csv(path)
    sites = [c for c in wide.columns if c != ts]
    long = wide.unpivot([ts], sites, "site", "value")
    return long.select("site", F.col(ts).cast("timestamp").alias("ts"), F.col("value").try_cast("double").alias("value"))


def read_wide_weather(spark: SparkSession, path: str) -> DataFrame:
    """CSV with three header rows (station, quantity, source) to the long table."""
    header = [row.value.split(",") for row in spark.read.text(path).take(3)]
    names = ["ts", *[f"c{i}" for i in range(1, len(header[0]))]]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    rows = rows.withColumn("ts", F.col("ts").try_cast("timestamp")).filter("ts IS NOT NULL")
    keys = F.create_map(*[
        part for i in range(1, len(header[0]))
        for part in (F.lit(f"c{i}"), F.array(*[F.lit(level[i]) for level in header]))
    ])
    long = rows.unpivot(["ts"], names[1:], "_c", "_v").withColumn("_k", keys[F.col("_c")])
    return long.select(
        F.col("_k")[0].alias("station"), F.col("_k")[1].alias("quantity"), F.col("_k")[2].alias("source"),
        "ts", F.col("_v").try_cast("double").alias("value"),
    )


def write_prepared(df: DataFrame, path: str, ts: str = "ts") -> None:
    df.withColumn("year", F.year(ts)).hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year")


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run to a table partitioned by run; writing a run again replaces it."""
    df.withColumn("run_id", F.lit(run_id)).hint("rebalance").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def write_blocks(df: DataFrame, path: str, run_id: str) -> None:
    """Design or statistic blocks in coordinate form, partitioned by run."""
    write_run(df, path, run_id)


def read_blocks(spark: SparkSession, path: str, run_id: str, blocks: list[str] | None = None) -> DataFrame:
    df = read_run(spark, path, run_id)
    return df if blocks is None else df.filter(F.col("block").isin(blocks))
