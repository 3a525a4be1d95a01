"""Distances, nearest neighbours, zones and aggregation over places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_term, unit_vector

# Cells are cubes of edge 2**(1 - level) around the unit sphere; at level 0 the
# neighbourhood of any cell is the whole globe, at the last one a cell is ~400 m.
LEVELS = 16
DISTANCE_DIGITS = 12

# The rectangle around Paris in degrees.
PARIS_BOX = {"latitude": (48.7, 49.0), "longitude": (2.1, 2.6)}


def in_box(coords: DataFrame, box: dict[str, tuple[float, float]] = PARIS_BOX) -> DataFrame:
    return coords.filter(
        F.col("latitude").between(*box["latitude"]) & F.col("longitude").between(*box["longitude"])
    )


def inside_bounding_box(
    coords: DataFrame, around: DataFrame, extra_latitude: float, extra_longitude: float
) -> DataFrame:
    """Places inside the bounding box of ``around``, widened on each side."""
    box = around.agg(
        F.struct(
            F.min("latitude").alias("south"), F.max("latitude").alias("north"),
            F.min("longitude").alias("west"), F.max("longitude").alias("east"),
        ).alias("b")
    ).scalar()
    return coords.filter(
        F.col("latitude").between(box["south"] - extra_latitude, box["north"] + extra_latitude)
        & F.col("longitude").between(box["west"] - extra_longitude, box["east"] + extra_longitude)
    )


def _cell(level: Column, axis: Column) -> Column:
    return F.floor((axis + 1) * F.pow(F.lit(2.0), level - 1))


def _places(coords: DataFrame, prefix: str) -> DataFrame:
    """Distinct coordinates with a position on the unit sphere."""
    x, y, z = unit_vector(F.col("latitude"), F.col("longitude"))
    return coords.select("latitude", "longitude").distinct().select(
        F.col("latitude").alias(f"lat_{prefix}"), F.col("longitude").alias(f"lon_{prefix}"),
        x.alias("_x"), y.alias("_y"), z.alias("_z"),
    )


def _neighbour_cells(df: DataFrame, level: Column) -> DataFrame:
    """One row per cell of the 3 x 3 x 3 block around the point at ``level``."""
    shifts = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    out = df.withColumn("_level", level)
    for axis in ("_x", "_y", "_z"):
        centre = _cell(F.col("_level"), F.col(axis))
        out = out.withColumn(f"_c{axis}", F.explode(F.transform(shifts, centre.__add__)))
    return out


def rank_by_distance(
    a: DataFrame, b: DataFrame, k: int | None = None, name_a: str = "name", name_b: str = "name"
) -> DataFrame:
    """The ``k`` places of ``b`` closest to each of ``a`` (all of them if k is None).

    Result: ``name_a, name_b, distance, rank``; ties go by name, the distance is
    the haversine term rounded to 12 digits.

    No pair is formed that the answer cannot need. The work runs on distinct
    coordinates, each standing for its k first names. Counts of places per cell,
    for all cell sizes at once, give each point of ``a`` the finest cell whose
    neighbourhood holds k places; the k-th neighbour is then closer than twice
    the diagonal of that cell, and the neighbourhood two levels up contains that
    ball. Candidates meet there by an equality join on the cell. With k = None
    the answer itself is every pair, and level 0 yields it.
    """
    names_a = a.select(F.col(name_a).alias("name_a"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"))
    names_b = b.select(F.col(name_b).alias("name_b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"))
    points_a, points_b = _places(a, "a"), _places(b, "b")
    cells = ["_level", "_c_x", "_c_y", "_c_z"]

    if k is None:
        located = points_a.withColumn("_start", F.lit(0))
        levels = [0]
    else:
        first = Window.partitionBy("lat_b", "lon_b").orderBy("name_b")
        names_b = names_b.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")
        levels = list(range(LEVELS))
        counted = _cells_of(points_b, levels).groupBy(*cells).agg(F.count(F.lit(1)).alias("_count"))
        around = _neighbour_cells(points_a, F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
        enough = (
            around.join(counted, cells)
            .groupBy("lat_a", "lon_a", "_level")
            .agg(F.sum("_count").alias("_near"))
            .filter(F.col("_near") >= k)
            .groupBy("lat_a", "lon_a")
            .agg(F.max("_level").alias("_fine"))
        )
        located = points_a.join(enough, ["lat_a", "lon_a"], "left").withColumn(
            "_start", F.greatest(F.coalesce("_fine", F.lit(0)) - 2, F.lit(0))
        )
    asked = _neighbour_cells(located, F.col("_start")).select("lat_a", "lon_a", *cells).distinct()
    offered = _cells_of(points_b, levels).select("lat_b", "lon_b", *cells)
    distance = haversine_term(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    pairs = asked.join(offered, cells).select(
        "lat_a", "lon_a", "lat_b", "lon_b", F.round(distance, DISTANCE_DIGITS).alias("distance")
    )
    if k is not None:
        pairs = _closest(pairs, ["lat_a", "lon_a"], "distance", k)
    named = pairs.join(names_b, ["lat_b", "lon_b"])
    order = Window.partitionBy("lat_a", "lon_a").orderBy("distance", "name_b")
    ranked = named.withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.join(names_a, ["lat_a", "lon_a"]).select("name_a", "name_b", "distance", "rank")


def _closest(pairs: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    """Coordinates at the k smallest distances; equal distances all stay for the tie by name."""
    w = Window.partitionBy(*key).orderBy(order)
    return pairs.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k).drop("_r")


def _cells_of(points: DataFrame, levels: list[int]) -> DataFrame:
    out = points.withColumn("_level", F.explode(F.array(*[F.lit(level) for level in levels])))
    for axis in ("_x", "_y", "_z"):
        out = out.withColumn(f"_c{axis}", _cell(F.col("_level"), F.col(axis)))
    return out


def used_places(coords: DataFrame, assignment: DataFrame, name: str = "name", location: str = "name_b") -> DataFrame:
    """Places that appear in an assignment."""
    used = assignment.select(F.col(location).alias(name)).distinct()
    return coords.join(used, name, "left_semi")


def sum_by_zone(load: DataFrame, mapping: DataFrame | None, zone: str = "region") -> DataFrame:
    """Sum of the load per zone and time; without a mapping, one zone named ``sum``."""
    joined = load.withColumn(zone, F.lit("sum")) if mapping is None else load.join(mapping, "site")
    return joined.groupBy(zone, "ts").agg(F.sum("value").alias("value"))


def mean_coordinates(coords: DataFrame, mapping: DataFrame, zone: str = "region") -> DataFrame:
    joined = coords.join(mapping.withColumnRenamed("site", "name"), "name")
    return joined.groupBy(zone).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def mean_weather(weather: DataFrame) -> DataFrame:
    return weather.groupBy("quantity", "ts").agg(F.avg("value").alias("value"))


def normalised_weights(weights: DataFrame, present: DataFrame) -> DataFrame:
    """Weights of the stations present, scaled to sum to 1 in each zone."""
    kept = weights.join(present.select("station").distinct(), "station", "left_semi")
    totals = kept.groupBy("zone").agg(F.sum("weight").alias("_total"))
    return kept.join(totals, "zone").select("station", "zone", (F.col("weight") / F.col("_total")).alias("weight"))


def weighted_weather(weather: DataFrame, weights: DataFrame) -> DataFrame:
    weighted = weather.join(weights, "station")
    return weighted.groupBy("zone", "quantity", "ts").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def weighted_coordinates(coords: DataFrame, weights: DataFrame) -> DataFrame:
    joined = coords.join(weights.withColumnRenamed("station", "name"), "name")
    return joined.groupBy("zone").agg(
        F.sum(F.col("weight") * F.col("latitude")).alias("latitude"),
        F.sum(F.col("weight") * F.col("longitude")).alias("longitude"),
    )


def sites_of_zone(sites: DataFrame, mappings: list[DataFrame], zone: str) -> DataFrame:
    """Sites of a named zone, taken from the first mapping that knows the zone."""
    for mapping in mappings:
        members = mapping.filter(F.col("region") == zone)
        if not members.isEmpty():
            return sites.join(members.select("site").distinct(), "site", "left_semi")
    raise ValueError(f"no mapping has a zone named {zone!r}")
