"""F: geography and aggregation."""

from pyspark.sql import functions as F

from ...functions.geo import haversine_term
from ...operators import geography
from .. import bindings as b
from ..registry import query
from ..sql_parts import final, with_parts
from .common import tidy


def term(a: str, c: str) -> str:
    return f"""(1 - cos(radians({a}.latitude) - radians({c}.latitude))) / 2 + (1 - cos(radians({a}.longitude) - radians({c}.longitude))) / 2
        * cos(radians({a}.latitude)) * cos(radians({c}.latitude))"""


def ranked(a: str, c: str) -> dict[str, str]:
    return {
        "pairs": f"SELECT a.name AS name_a, c.name AS name_b, round({term('a', 'c')}, 12) AS distance FROM {a} a CROSS JOIN {c} c",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY name_a ORDER BY distance, name_b) AS rank FROM pairs",
    }


RANKED = "name_a name_b distance~12 rank#"


@query("f1_haversine", with_parts(f"""SELECT c_custkey, round({term('c', 'n')}, 9) AS distance FROM
    (SELECT c_custkey, c_nationkey, name, latitude, longitude FROM customer JOIN customer_coords ON c_name = name) c
    JOIN (SELECT n_nationkey, name, latitude, longitude FROM nation JOIN nation_coords ON n_name = name) n ON c_nationkey = n_nationkey"""))
def f1(spark, sf):
    """Distance term between each customer and its nation."""
    customer, nation = b.table(spark, sf, "customer"), b.table(spark, sf, "nation")
    places = b.coords(customer, "c_custkey", "c_name").join(customer.select(F.col("c_name").alias("name"), "c_custkey", "c_nationkey"), "name")
    centres = b.coords(nation, "n_nationkey", "n_nationkey").select(
        F.col("name").alias("c_nationkey"), F.col("latitude").alias("lat_n"), F.col("longitude").alias("lon_n")
    )
    distance = haversine_term(F.col("latitude"), F.col("longitude"), F.col("lat_n"), F.col("lon_n"))
    return tidy(places.join(centres, "c_nationkey").select("c_custkey", distance.alias("distance")), 9)


@query("f2_rank_all", final(RANKED, "ranked", **ranked("nation_coords", "supplier_coords")))
def f2(spark, sf):
    return tidy(geography.rank_by_distance(b.nation_coords(spark, sf), b.supplier_coords(spark, sf)), 12)


@query("f3_nearest_sites", final(RANKED, "(SELECT * FROM ranked WHERE rank <= 5)", **ranked("supplier_coords", "supplier_coords")))
def f3(spark, sf):
    sites = b.supplier_coords(spark, sf)
    return tidy(geography.rank_by_distance(sites, sites, k=5), 12)


@query("f4_nearest_stations", with_parts("""SELECT name_b AS name, round(any_value(c.latitude), 6) AS latitude, round(any_value(c.longitude), 6) AS longitude, count(*) AS n_sites
    FROM ranked JOIN supplier_coords c ON c.name = name_b WHERE rank <= 3 GROUP BY 1""", **ranked("customer_coords", "supplier_coords")))
def f4(spark, sf):
    """Stations used by some site, with the number of sites that use them."""
    stations = b.supplier_coords(spark, sf)
    assignment = geography.rank_by_distance(b.customer_coords(spark, sf), stations, k=3)
    used = geography.used_places(stations, assignment)
    users = assignment.groupBy(F.col("name_b").alias("name")).agg(F.count(F.lit(1)).alias("n_sites"))
    return tidy(used.join(users, "name"))


@query("f5_sum_by_zone", with_parts("""SELECT region, CAST(ts AS VARCHAR) AS ts, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value FROM load_d JOIN site_region USING (site) GROUP BY 1, 2
    UNION ALL SELECT 'sum', CAST(ts AS VARCHAR), CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) FROM load_d GROUP BY 2"""))
def f5(spark, sf):
    load = b.load_d(spark, sf)
    zones = geography.sum_by_zone(load, b.site_region(spark, sf))
    return tidy(zones.unionByName(geography.sum_by_zone(load, None)))


@query("f6_mean_coordinates", with_parts("SELECT region, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM nation_coords JOIN site_region ON name = site GROUP BY 1"))
def f6(spark, sf):
    return tidy(geography.mean_coordinates(b.nation_coords(spark, sf), b.site_region(spark, sf)))


@query("f7_mean_weather", with_parts("SELECT quantity, CAST(ts AS VARCHAR) AS ts, round(avg(value), 8) AS value FROM weather GROUP BY 1, 2"))
def f7(spark, sf):
    return tidy(geography.mean_weather(b.weather(spark, sf)), 8)


NORMALISED = {"norm": "SELECT station, zone, weight / sum(weight) OVER (PARTITION BY zone) AS weight FROM station_weights SEMI JOIN weather USING (station)"}


def weights(spark, sf):
    return geography.normalised_weights(b.station_weights(spark, sf), b.weather(spark, sf))


@query("f8_normalise_weights", final("station zone weight~8", "norm", **NORMALISED))
def f8(spark, sf):
    return tidy(weights(spark, sf), 8)


WEIGHTED = """SELECT zone, quantity, CAST(ts AS VARCHAR) AS ts, round(sum(weight * value), 6) AS value
    FROM weather_filled JOIN norm USING (station) WHERE zone {0} 'FRAN' GROUP BY 1, 2, 3"""


@query("f9_national_weather", with_parts(WEIGHTED.format("="), **NORMALISED))
def f9(spark, sf):
    return tidy(geography.weighted_weather(b.weather_filled(spark, sf), weights(spark, sf).filter("zone = 'FRAN'")))


@query("f10_regional_weather", with_parts(WEIGHTED.format("<>"), **NORMALISED))
def f10(spark, sf):
    return tidy(geography.weighted_weather(b.weather_filled(spark, sf), weights(spark, sf).filter("zone <> 'FRAN'")))


@query("f11_weighted_coordinates", with_parts("SELECT zone, round(sum(weight * latitude), 6) AS latitude, round(sum(weight * longitude), 6) AS longitude FROM station_coords JOIN norm ON name = station GROUP BY 1", **NORMALISED))
def f11(spark, sf):
    return tidy(geography.weighted_coordinates(b.station_coords(spark, sf), weights(spark, sf)))
