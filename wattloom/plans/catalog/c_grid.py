"""C: grids, alignment, gap filling and set operations."""

from pyspark.sql import functions as F

from ...operators import grid
from .. import bindings as b
from ..registry import query
from ..sql_parts import final, full_grid, interpolated, with_parts
from .common import tidy


@query("c1_stack", final("site ts! value~", "(SELECT * FROM load_h UNION ALL SELECT * FROM load_d)"))
def c1(spark, sf):
    return tidy(b.load_h(spark, sf).unionByName(b.load_d(spark, sf)))


@query("c2_align_wide", final("ts! click~ error~ purchase~ signup~ view~", """(SELECT ts, max(CASE WHEN site = 'click' THEN value END) AS click,
    max(CASE WHEN site = 'error' THEN value END) AS error, max(CASE WHEN site = 'purchase' THEN value END) AS purchase,
    max(CASE WHEN site = 'signup' THEN value END) AS signup, max(CASE WHEN site = 'view' THEN value END) AS view FROM load_h GROUP BY ts)"""))
def c2(spark, sf):
    load = b.load_h(spark, sf)
    sites = sorted(r.site for r in load.select("site").distinct().collect())
    return tidy(grid.long_to_wide(load, "ts", "site", "value", sites))


@query("c3_backfill", final("site ts! value~", "filled_h"))
def c3(spark, sf):
    return tidy(grid.backfill(b.hourly(spark, sf), ["site"], "ts", "value", 3600))


@query("c4_full_grid", final("site ts! value~", "daily"))
def c4(spark, sf):
    return tidy(b.daily(spark, sf))


@query("c5_padded_grid", final("station quantity ts! value~", "(SELECT g.station, g.quantity, g.ts, w.value FROM padded g LEFT JOIN weather w USING (station, quantity, ts))",
    padded=full_grid("weather", "station, quantity", "HOUR", " + INTERVAL 2 HOUR")))
def c5(spark, sf):
    return tidy(grid.reindex(b.weather(spark, sf), ["station", "quantity"], "ts", 3600, pad_steps=2))


@query("c6_interpolate", final("site ts! value~8", "line", line=interpolated("daily", "site")))
def c6(spark, sf):
    return tidy(grid.interpolate(b.daily(spark, sf), ["site"], "ts", "value", 86400), digits=8)


REGULAR = """SELECT site, count(*) FILTER (i > 1 AND s1 <> {step}) AS bad_steps, count(*) FILTER (i > {n} AND sn <> {step} * {n}) AS bad_spans FROM (
    SELECT site, row_number() OVER w AS i, epoch(ts) - epoch(lag(ts, 1) OVER w) AS s1, epoch(ts) - epoch(lag(ts, {n}) OVER w) AS sn
    FROM {source} WINDOW w AS (PARTITION BY site ORDER BY ts)) GROUP BY site"""


@query("c7_regularity", with_parts(REGULAR.format(step=3600, n=24, source="load_h") + " UNION ALL " + REGULAR.format(step=3600, n=24, source="(SELECT site || '_grid' AS site, ts FROM clean_h)")))
def c7(spark, sf):
    """The raw series with its gaps, and the same series after gridding."""
    raw = grid.irregular_steps(b.load_h(spark, sf), ["site"], "ts", 3600, 24)
    clean = b.clean_h(spark, sf).withColumn("site", F.concat("site", F.lit("_grid")))
    return raw.unionByName(grid.irregular_steps(clean, ["site"], "ts", 3600, 24))


@query("c8_deduplicate", final("station ts! event_id value~", f"""(SELECT station, ts, event_id, value FROM (
    SELECT 'ST_' || CAST(user_id % 8 AS VARCHAR) AS station, date_trunc('hour', ts) AS ts, event_id, value,
    row_number() OVER (PARTITION BY user_id % 8, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events) WHERE rn = 1)"""))
def c8(spark, sf):
    rows = b.table(spark, sf, "events").select(
        F.concat(F.lit("ST_"), (F.col("user_id") % 8).cast("string")).alias("station"),
        F.date_trunc("hour", "ts").alias("ts"), "event_id", "value",
    )
    return tidy(grid.first_per_key(rows, ["station", "ts"], ["event_id"]))


@query("c9_pivot_quantities", final("station ts! temperature~ nebulosity~ wind_speed~", "weather_wide"))
def c9(spark, sf):
    wide = b.weather(spark, sf).groupBy("station", "ts").pivot("quantity", ["temperature", "nebulosity", "wind_speed"]).agg(F.first("value"))
    return tidy(wide)


@query("c10_drop_empty", final("site ts! value~", "(SELECT * FROM holed WHERE site <> 'view')",
    holed="SELECT site, ts, CASE WHEN site <> 'view' THEN value END AS value FROM hourly"))
def c10(spark, sf):
    holed = b.hourly(spark, sf).withColumn("value", F.when(F.col("site") != "view", F.col("value")))
    return tidy(grid.drop_empty_series(holed, ["site"], "value"))


@query("c11_late_series", with_parts("""SELECT site, CAST(count(value) AS BIGINT) AS known FROM late GROUP BY site
    HAVING min(CASE WHEN value IS NOT NULL THEN ts END) > (SELECT min(ts) FROM late) + INTERVAL 24 HOUR""",
    late="SELECT site, ts, CASE WHEN site = 'click' AND ts < TIMESTAMP '2024-01-04' THEN NULL ELSE value END AS value FROM hourly"))
def c11(spark, sf):
    """One series loses its first three days; it is the one reported."""
    cut = (F.col("site") == "click") & (F.col("ts") < F.lit("2024-01-04").cast("timestamp"))
    late = b.hourly(spark, sf).withColumn("value", F.when(~cut, F.col("value")))
    names = grid.late_series(late, ["site"], "ts", "value", 24 * 3600)
    return late.join(names, "site", "left_semi").groupBy("site").agg(F.count("value").alias("known"))


@query("c12_constant_series", final("station quantity ts! value~", """(SELECT * FROM flat SEMI JOIN
    (SELECT station, quantity FROM flat GROUP BY 1, 2 HAVING count(DISTINCT value) > 1) USING (station, quantity))""",
    flat="SELECT station, quantity, ts, CASE WHEN station = 'ST_1' AND quantity = 'nebulosity' THEN 3 ELSE value END AS value FROM weather"))
def c12(spark, sf):
    constant = (F.col("station") == "ST_1") & (F.col("quantity") == "nebulosity")
    flat = b.weather(spark, sf).withColumn("value", F.when(constant, F.lit(3.0)).otherwise(F.col("value")))
    return tidy(grid.without(flat, grid.constant_series(flat, ["station", "quantity"], "value")))


LACKING = "SELECT station, quantity, ts, value FROM weather WHERE NOT (station IN ('ST_2', 'ST_5') AND quantity = 'wind_speed')"


@query("c13_incomplete_stations", with_parts("""SELECT station, count(*) AS rows, 'kept' AS fate FROM lacking WHERE station NOT IN ('ST_2', 'ST_5') GROUP BY 1
    UNION ALL SELECT station, count(*), 'trash' FROM lacking WHERE station IN ('ST_2', 'ST_5') GROUP BY 1""", lacking=LACKING))
def c13(spark, sf):
    lacking = b.weather(spark, sf).filter("NOT (station IN ('ST_2', 'ST_5') AND quantity = 'wind_speed')")
    trash = grid.incomplete_stations(lacking, "station", "quantity")
    kept = grid.without(lacking, trash).withColumn("fate", F.lit("kept"))
    dropped = grid.within(lacking, trash).withColumn("fate", F.lit("trash"))
    return kept.unionByName(dropped).groupBy("station", "fate").agg(F.count(F.lit(1)).alias("rows"))


@query("c14_tag_source", final("station quantity source ts! value~", "(SELECT *, 'observed' AS source FROM weather)"))
def c14(spark, sf):
    return tidy(grid.with_source(b.weather(spark, sf)))


@query("c15_common_dates", final("ts!", "(SELECT ts FROM load_d INTERSECT SELECT ts FROM load_s)"))
def c15(spark, sf):
    return tidy(grid.common_values(b.load_d(spark, sf), b.load_s(spark, sf), "ts"))


@query("c16_common_names", "SELECT c_name AS name FROM customer INTERSECT SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey")
def c16(spark, sf):
    customer = b.table(spark, sf, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    orders = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return grid.common_values(customer, customer.join(orders, "c_custkey", "left_semi"), "name")


@query("c17_alignment", with_parts("""SELECT CAST(ts AS VARCHAR) AS ts, 'left' AS side FROM (SELECT ts FROM load_d EXCEPT SELECT ts FROM load_s)
    UNION ALL SELECT CAST(ts AS VARCHAR), 'right' FROM (SELECT ts FROM load_s EXCEPT SELECT ts FROM load_d)"""))
def c17(spark, sf):
    return tidy(grid.alignment_differences(b.load_d(spark, sf), b.load_s(spark, sf), "ts"))


@query("c18_good_sites", "SELECT s_name AS site FROM supplier EXCEPT SELECT s_name FROM supplier WHERE s_acctbal < 0")
def c18(spark, sf):
    supplier = b.table(spark, sf, "supplier").withColumnRenamed("s_name", "site")
    return grid.without(supplier.select("site"), supplier.filter("s_acctbal < 0").select("site"))


@query("c19_sort", final("site ts! value~", "(SELECT * FROM load_h ORDER BY site, ts)"))
def c19(spark, sf):
    return tidy(b.load_h(spark, sf)).orderBy("site", "ts")
