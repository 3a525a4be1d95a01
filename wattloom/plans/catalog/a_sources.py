"""A: sources and sinks. Files are written by Spark from the given tables, then read."""

from pyspark.sql import functions as F

from ...operators import evaluate, grid
from ...session import fresh_path, materialize
from ...sources import raw_files, tables
from .. import bindings as b
from ..registry import query
from ..sql_parts import NAIVE_PARTS, final, with_parts
from .common import tidy

# Two lines of text under each load file.
FOOTER = ["Données publiées sous réserve", "Fin du fichier"]


def write_load_files(spark, sf, path):
    """15-minute load in local time, one folder per site and year, with footer lines."""
    quarter = grid.reindex(b.load_q(spark, sf), ["site"], "ts", 900)
    local = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    rows = quarter.select(
        F.lit("RTE").alias("Nature"), F.lit("x").alias("Statut"),
        F.date_format(local, "yyyy/MM/dd").alias("Date"), F.date_format(local, "HH:mm").alias("Heures"),
        F.lit("7").alias("Fioul"), F.col("value").cast("string").alias("Consommation"), "site", F.year(local).alias("year"),
    )
    footer = rows.select("site", "year").distinct().select(
        F.explode(F.array(*[F.lit(line) for line in FOOTER])).alias("Nature"), F.lit("").alias("Statut"),
        F.lit("").alias("Date"), F.lit("").alias("Heures"), F.lit("").alias("Fioul"), F.lit("").alias("Consommation"), "site", "year",
    )
    rows.unionByName(footer).write.partitionBy("site", "year").options(
        header=True, **raw_files.LOAD_FORMAT
    ).csv(path)


@query("a1_read_load_files", final("site year# ts! value~", """(SELECT g.site, year(g.ts + INTERVAL 1 HOUR) AS year, g.ts, q.value
    FROM grid_q g LEFT JOIN load_q q USING (site, ts) WHERE minute(g.ts) = 0)""",
    grid_q="""SELECT s.site, g.ts FROM (SELECT DISTINCT site FROM load_q) s,
        (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM load_q) g"""))
def a1(spark, sf):
    path = fresh_path(spark, "load-files")
    write_load_files(spark, sf, path)
    return tidy(raw_files.read_load_files(spark, path))


@query("a2_read_weather_files", final("station quantity ts! value~", "weather_grid"))
def a2(spark, sf):
    path = fresh_path(spark, "weather-files")
    wide = b.weather_grid(spark, sf).groupBy("station", "ts").pivot(
        "quantity", ["temperature", "nebulosity", "wind_speed"]
    ).agg(F.first("value"))
    wide.select(
        F.col("station").alias("numer_sta"), F.date_format("ts", "yyyyMMddHHmmss").alias("date"), F.lit(101325).alias("pres"),
        F.col("wind_speed").alias("ff"), (F.col("temperature") + raw_files.ZERO_CELSIUS).alias("t"), F.lit("mq").alias("dd"),
        F.col("nebulosity").alias("n"), F.year("ts").alias("year"), F.month("ts").alias("month"),
    ).write.partitionBy("year", "month").options(
        header=True, compression="gzip", **raw_files.WEATHER_FORMAT
    ).csv(path)
    return tidy(raw_files.read_weather_files(spark, path))


@query("a3_read_stations", final("station_id name latitude~ longitude~", """(SELECT CAST(s_suppkey AS VARCHAR) AS station_id,
    'Saint-' || upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) || '-Lyon-Satolas' AS name,
    42 + CAST(s_suppkey * 37 % 80 AS DOUBLE) / 10 AS latitude, -4 + CAST(s_suppkey * 53 % 110 AS DOUBLE) / 10 AS longitude FROM supplier)"""))
def a3(spark, sf):
    path = fresh_path(spark, "stations")
    supplier = b.table(spark, sf, "supplier")
    coords = b.coords(supplier.withColumn("name", F.concat(F.lit("ST "), F.upper("s_name"), F.lit(" LYON-ST-EXUPERY"))), "s_suppkey", "name")
    keyed = coords.join(supplier.select("s_suppkey", F.concat(F.lit("ST "), F.upper("s_name"), F.lit(" LYON-ST-EXUPERY")).alias("name")), "name")
    keyed.select(
        F.col("name").alias("Nom"), F.lit(100).alias("Altitude"), F.col("longitude").alias("Longitude"),
        F.col("latitude").alias("Latitude"), F.col("s_suppkey").alias("ID"),
    ).write.options(header=True, sep=";").csv(path)
    return tidy(raw_files.read_stations(spark, path))


@query("a4_read_prepared", final("site ts! value~", "hourly"))
def a4(spark, sf):
    path = fresh_path(spark, "wide-load")
    hourly = b.hourly(spark, sf)
    sites = sorted(r.site for r in b.load_h(spark, sf).select("site").distinct().collect())
    grid.long_to_wide(hourly, "ts", "site", "value", sites).write.options(header=True).csv(path)
    return tidy(tables.read_wide_load(spark, path))


REGIONS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for i, (n, lat, lon) in enumerate(tables.REGIONAL_COORDINATES)
) + ") AS t(k, name, latitude, longitude)"


@query("a5_coordinates", final("site name latitude~ longitude~", "(SELECT s_name AS site, r.name, latitude, longitude FROM supplier JOIN regional r ON r.k = s_suppkey % 12)", regional=REGIONS_SQL))
def a5(spark, sf):
    """Each supplier placed in one of the 12 fixed regions; the dimension has 12 rows."""
    names = [name for name, _, _ in tables.REGIONAL_COORDINATES]
    named = b.table(spark, sf, "supplier").select(
        F.col("s_name").alias("site"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % len(names) + 1).cast("int")).alias("name"),
    )
    return tidy(named.join(F.broadcast(tables.coordinates(spark)), "name").select("site", "name", "latitude", "longitude"))


@query("a6_site_regions", with_parts("""SELECT replace(upper(s_name), ' ', '-') AS site,
    upper(substr(r_name, 1, 1)) || lower(split_part(substr(r_name, 2), ' ', 1)) ||
    CASE WHEN strpos(r_name, ' ') > 0 THEN ' ' || upper(substr(split_part(r_name, ' ', 2), 1, 1)) || lower(substr(split_part(r_name, ' ', 2), 2)) ELSE '' END
    || ' d''Aval' AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""))
def a6(spark, sf):
    path = fresh_path(spark, "site-regions")
    supplier, nation, region = (b.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("s_name").alias("site"), F.concat("r_name", F.lit("  D'AVAL")).alias("region")).write.options(header=True).csv(path)
    return tidy(raw_files.read_site_regions(spark, path))


@query("a6_districts", with_parts("""SELECT n_name AS region, count(DISTINCT o_custkey) AS sites, round(sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE, 2) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""))
def a6_districts(spark, sf):
    """Load of the customers summed by district, the mapping read from Parquet."""
    path = fresh_path(spark, "districts")
    customer, nation = b.table(spark, sf, "customer"), b.table(spark, sf, "nation")
    customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("site"), F.col("n_name").alias("district")).write.parquet(path)
    load = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("site")).agg(b.money("o_totalprice").alias("value"))
    joined = load.join(raw_files.read_districts(spark, path), "site")
    return tidy(joined.groupBy("region").agg(F.count(F.lit(1)).alias("sites"), F.sum("value").cast("double").alias("value")), 2)


@query("a7_station_weights", with_parts(f"""SELECT 'St_' || substr(s.station, 4) AS station, z.zone,
    round(coalesce(w.weight, 0), 6) AS weight
    FROM (SELECT DISTINCT station FROM station_weights) s CROSS JOIN (SELECT DISTINCT zone FROM station_weights) z
    LEFT JOIN station_weights w ON w.station = s.station AND w.zone = z.zone"""))
def a7(spark, sf):
    path = fresh_path(spark, "weights")
    zones = ["FRAN", *sorted(r.r_name for r in b.table(spark, sf, "region").select("r_name").collect())]
    wide = b.station_weights(spark, sf).groupBy(F.col("station").alias(raw_files.WEIGHT_NAME)).pivot("zone", zones).agg(F.first("weight"))
    decimal_comma = [F.replace(F.format_string("%.2f", F.col(f"`{z}`")), F.lit("."), F.lit(",")).alias(z) for z in zones]
    known = [F.when(F.col(f"`{z}`").isNotNull(), c).alias(z) for z, c in zip(zones, decimal_comma)]
    wide.select(raw_files.WEIGHT_NAME, *known).write.options(header=True, sep=";").csv(path)
    return tidy(raw_files.read_station_weights(spark, path, zones))


@query("a8_write_prepared", final("site ts! value~", "daily"))
def a8(spark, sf):
    path = fresh_path(spark, "prepared")
    tables.write_prepared(b.daily(spark, sf), path)
    return tidy(tables.read_prepared(spark, path))


@query("a9_predictions", final("site split ts! target~ prediction~ run_id", "(SELECT *, 'naive' AS run_id FROM naive)", **NAIVE_PARTS))
def a9(spark, sf):
    path = fresh_path(spark, "predictions")
    tables.write_run(b.naive(spark, sf), path, "naive")
    return tidy(tables.read_run(spark, path, "naive"))


@query("a10_performances", final("site split mse~ mae~ score~ mape~ nmse~ run_id", "(SELECT *, 'naive' AS run_id FROM naive_scores)", **NAIVE_PARTS))
def a10(spark, sf):
    path = fresh_path(spark, "performances")
    tables.write_run(evaluate.performances(b.naive(spark, sf), ["site", "split"]), path, "naive")
    return tidy(tables.read_run(spark, path, "naive"))


@query("a12_stage_reuse", final("site ts! value~", "clean_h"))
def a12(spark, sf):
    """The second call finds the finished table and does not compute the stage again."""
    path = fresh_path(spark, "stage")
    materialize(b.clean_h(spark, sf), path)
    return tidy(materialize(b.clean_h(spark, sf), path))
