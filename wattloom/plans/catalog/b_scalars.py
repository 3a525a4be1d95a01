"""B: projections, scalar functions and filters."""

from pyspark.sql import functions as F

from ...functions import text
from ...functions.numbers import round_significant
from ...operators import evaluate, geography, grid
from ...sources.raw_files import ZERO_CELSIUS, every_full_hour, fixed_offset_to_utc, packed_utc
from .. import bindings as b
from ..registry import query
from ..sql_parts import final, rounded, with_parts
from .common import tidy


@query("b1_rename", final("ts! station temperature~", "(SELECT ts, CAST(user_id AS VARCHAR) AS station, value AS temperature FROM events)"))
def b1(spark, sf):
    return tidy(b.table(spark, sf, "events").select(
        "ts", F.col("user_id").cast("string").alias("station"), F.col("value").alias("temperature")
    ))


@query("b2_fixed_offset", with_parts("""SELECT event_id, CAST(date_trunc('minute', ts) - INTERVAL 1 HOUR AS VARCHAR) AS ts_utc FROM events"""))
def b2(spark, sf):
    events = b.table(spark, sf, "events")
    local = events.select("event_id", F.date_format("ts", "yyyy/MM/dd").alias("d"), F.date_format("ts", "HH:mm").alias("t"))
    return tidy(local.select("event_id", fixed_offset_to_utc(F.col("d"), F.col("t")).alias("ts_utc")))


@query("b3_packed_time", with_parts("SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS ts_utc FROM events"))
def b3(spark, sf):
    packed = b.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("p"))
    return tidy(packed.select("event_id", packed_utc(F.col("p")).alias("ts_utc")))


@query("b4_celsius", with_parts(f"SELECT event_id, {rounded('value - 273.15')} AS celsius FROM events"))
def b4(spark, sf):
    return tidy(b.table(spark, sf, "events").select("event_id", (F.col("value") - ZERO_CELSIUS).alias("celsius")))


@query("b5_full_hours", final("site ts! value~", "(SELECT * FROM load_q WHERE minute(ts) = 0)"))
def b5(spark, sf):
    return tidy(every_full_hour(b.load_q(spark, sf)))


@query("b6_strip_accents", "SELECT c_custkey, 'Hotel cote ' || c_name || ' NoEl' AS plain FROM customer")
def b6(spark, sf):
    accented = F.concat(F.lit("Hôtel côté "), "c_name", F.lit(" NoËl"))
    return b.table(spark, sf, "customer").select("c_custkey", text.strip_accents(accented).alias("plain"))


@query("b7_site_name", "SELECT p_partkey, replace(replace(upper(p_name || ' n.' || p_brand), ' ', '-'), '.', '_') AS site FROM part")
def b7(spark, sf):
    raw = F.concat("p_name", F.lit(" n."), "p_brand")
    return b.table(spark, sf, "part").select("p_partkey", text.site_name(raw).alias("site"))


TITLE = "list_aggregate(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


@query("b8_station_name", with_parts(f"""SELECT p_partkey, replace(replace({TITLE.format("'st ' || p_name")}, ' ', '-'), 'St-', 'Saint-')
    || '-d''Azur-Caen' AS station FROM part"""))
def b8(spark, sf):
    raw = F.concat(F.lit("st "), "p_name", F.lit(" D'AZUR CAEN-CARPIQUET"))
    named = text.station_name(raw)
    return b.table(spark, sf, "part").select("p_partkey", F.replace(named, F.lit("D'Azur"), F.lit("d'Azur")).alias("station"))


@query("b9_input_name", with_parts("""SELECT p_partkey, trim(regexp_replace(p_name || '_' || CASE WHEN p_size % 2 = 0 THEN 'lag' ELSE '' END || '_' ||
    CASE WHEN p_size % 2 = 0 THEN replace(CAST(24 - p_size AS VARCHAR), '-', 'm') ELSE '' END || '_' || replace(p_type || '-X', '-', '_'), '_+', '_', 'g'), '_') AS input_name FROM part"""))
def b9(spark, sf):
    even = F.col("p_size") % 2 == 0
    return b.table(spark, sf, "part").select("p_partkey", text.input_name(
        F.col("p_name"), F.when(even, "lag").otherwise(""),
        F.when(even, (24 - F.col("p_size")).cast("string")).otherwise(""), F.concat("p_type", F.lit("-X")),
    ).alias("input_name"))


@query("b10_region_name", with_parts(f"""SELECT p_partkey, {TITLE.format("p_name")} || '-de-Loire de Paris' AS admin_region,
    upper(p_name) || ' NORD' AS grid_region FROM part"""))
def b10(spark, sf):
    return b.table(spark, sf, "part").select(
        "p_partkey",
        text.region_name(F.concat("p_name", F.lit("-DE-LOIRE  DE PARIS"))).alias("admin_region"),
        text.grid_region_name(F.concat(F.lit("USE "), "p_name", F.lit(" nord"))).alias("grid_region"),
    )


@query("b11_round_significant", with_parts("""SELECT l_orderkey, l_linenumber, round_even(x * 10.0::DOUBLE ** d, 0) / 10.0::DOUBLE ** d AS short FROM (
    SELECT *, 1 - floor(log10(greatest(1e-12, abs(x)))) AS d FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 7 AS x FROM lineitem))"""))
def b11(spark, sf):
    x = F.col("l_extendedprice") / 7
    return b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", round_significant(x).alias("short"))


@query("b12_trash_list", final("site ts! value~", "(SELECT * FROM load_d WHERE site NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0))"))
def b12(spark, sf):
    trash = b.table(spark, sf, "nation").filter("n_regionkey = 0").select(F.col("n_name").alias("site"))
    return tidy(grid.without(b.load_d(spark, sf), trash))


@query("b13_weather_source", final("station quantity ts! value~", "(SELECT * FROM weather WHERE quantity <> 'nebulosity')"))
def b13(spark, sf):
    """Two sources stacked; the observed one is chosen."""
    rows = b.weather(spark, sf)
    both = grid.with_source(rows.filter("quantity <> 'nebulosity'"), "observed").unionByName(grid.with_source(rows, "forecast"))
    return tidy(both.filter("source = 'observed'").drop("source"))


@query("b14_bounding_box", final("name latitude~ longitude~", """(SELECT c.* FROM customer_coords c,
    (SELECT min(latitude) s, max(latitude) n, min(longitude) w, max(longitude) e FROM nation_coords WHERE name < 'NATION_15') box
    WHERE c.latitude BETWEEN s - 0.25 AND n + 0.25 AND c.longitude BETWEEN w - 0.25 AND e + 0.25)"""))
def b14(spark, sf):
    sites = b.nation_coords(spark, sf).filter("name < 'NATION_15'")
    return tidy(geography.inside_bounding_box(b.customer_coords(spark, sf), sites, 0.25, 0.25))


BOX = "SELECT * FROM customer_coords WHERE latitude BETWEEN 48.7 AND 49.0 AND longitude BETWEEN 2.1 AND 2.6"


@query("b15_rectangle", final("name latitude~ longitude~", f"({BOX})"))
def b15(spark, sf):
    return tidy(geography.in_box(b.customer_coords(spark, sf)))


@query("b16_first_in_rectangle", final("name latitude~ longitude~", f"({BOX} ORDER BY name LIMIT 4)"))
def b16(spark, sf):
    return tidy(geography.in_box(b.customer_coords(spark, sf)).orderBy("name").limit(4))


@query("b17_sites_of_region", "SELECT c_name AS site FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def b17(spark, sf):
    customer, nation, region = (b.table(spark, sf, t) for t in ("customer", "nation", "region"))
    located = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    by_nation = located.select(F.col("c_name").alias("site"), F.col("n_name").alias("region"))
    by_region = located.select(F.col("c_name").alias("site"), F.col("r_name").alias("region"))
    return geography.sites_of_zone(by_nation.select("site"), [by_nation, by_region], "ASIA")


@query("b18_listed_sites", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def b18(spark, sf):
    listed = b.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return grid.within(b.table(spark, sf, "customer").select("c_custkey", "c_name"), listed)


@query("b19_good_days", with_parts("""SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS ts FROM orders
    WHERE NOT (month(o_orderdate) = 5 AND day(o_orderdate) IN (1, 8)) AND NOT (month(o_orderdate) = 12 AND day(o_orderdate) >= 20)"""))
def b19(spark, sf):
    """Indicators by date: two fixed holidays, and a break from 20 December."""
    at = F.to_date("o_orderdate")
    marked = b.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ts"),
        ((F.month(at) == 5) & F.dayofmonth(at).isin(1, 8)).cast("int").alias("holidays"),
        ((F.month(at) == 12) & (F.dayofmonth(at) >= 20)).cast("int").alias("xmas"),
    )
    return tidy(evaluate.good_days(marked).select("o_orderkey", "ts"))
