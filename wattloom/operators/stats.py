"""Sufficient statistics of a design: the only step whose work grows with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(design: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Upper half of X'X per ``keys``: (block1, idx1, block2, idx2, value).

    Each row pairs its own few non-zero features; the products are summed on the
    map side before the shuffle, which then carries at most one row per pair of
    features and task. There is no join on time.
    """
    keys = ["sig"] if keys is None else keys
    left = design.select(*keys, "features", F.explode("features").alias("_a"))
    pairs = left.select(
        *keys, "_a",
        F.explode(F.filter("features", lambda f: F.struct(f["block"], f["idx"]) >= F.struct(F.col("_a")["block"], F.col("_a")["idx"]))).alias("_b"),
    )
    return pairs.groupBy(
        *keys,
        F.col("_a")["block"].alias("block1"), F.col("_a")["idx"].alias("idx1"),
        F.col("_b")["block"].alias("block2"), F.col("_b")["idx"].alias("idx2"),
    ).agg(F.sum(F.col("_a")["value"] * F.col("_b")["value"]).alias("value"))


def gram_of_parts(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Upper half of X'X between units that some design has both: (unit1, unit2, block1, idx1, block2, idx2, value).

    ``rows`` (unit, split, ts, features) and ``units`` (sig, unit) are those of ``features.parts``.
    Shared features meet each other once, and those of a location once each, however many
    designs use it. Rows meet on unit and time, so no key holds more than one row.
    """
    pairs = units.alias("a").join(units.alias("b"), "sig").filter("a.unit <= b.unit").select(
        F.col("a.unit").alias("unit1"), F.col("b.unit").alias("unit2")).distinct()
    left = rows.select(F.col("unit").alias("unit1"), "split", "ts", F.col("features").alias("_left")).join(pairs, "unit1")
    right = rows.select(F.col("unit").alias("unit2"), "split", "ts", F.col("features").alias("_right"))
    met = left.join(right, ["unit2", "split", "ts"]).select("unit1", "unit2", "_right", F.explode("_left").alias("_l"))
    low, high = F.struct("_l.block", "_l.idx"), F.struct("_r.block", "_r.idx")
    both = met.select("unit1", "unit2", "_l", F.explode("_right").alias("_r")).filter((F.col("unit1") != F.col("unit2")) | (low <= high))
    first, second = F.least(low, high), F.greatest(low, high)
    return both.groupBy(
        "unit1", "unit2", first["block"].alias("block1"), first["idx"].alias("idx1"), second["block"].alias("block2"), second["idx"].alias("idx2"),
    ).agg(F.sum(F.col("_l.value") * F.col("_r.value")).alias("value"))


def of_designs(gram_rows: DataFrame, units: DataFrame) -> DataFrame:
    """Upper half of X'X of each design, put together from ``gram_of_parts``; its size is that of the formula."""
    mine = units.withColumnRenamed("unit", "unit1").join(units.withColumnRenamed("unit", "unit2"), "sig")
    return gram_rows.join(mine, ["unit1", "unit2"]).select("sig", "block1", "idx1", "block2", "idx2", "value")


def symmetric(half: DataFrame) -> DataFrame:
    """Both halves of X'X."""
    off = half.filter("NOT (block1 = block2 AND idx1 = idx2)")
    rest = [c for c in off.columns if c not in ("block1", "idx1", "block2", "idx2")]
    swapped = off.select(
        *rest, F.col("block2").alias("block1"), F.col("idx2").alias("idx1"),
        F.col("block1").alias("block2"), F.col("idx1").alias("idx2"),
    )
    return half.unionByName(swapped)


def cross(design: DataFrame, target: DataFrame, by_site: DataFrame, value: str = "y") -> DataFrame:
    """X'Y per site: (sig, site, block, idx, value)."""
    signed = target.select("site", "ts", "split", F.col(value).alias("_y")).join(by_site, "site")
    rows = design.join(signed, ["sig", "split", "ts"])
    return rows.select("sig", "site", "_y", F.inline("features")).groupBy("sig", "site", "block", "idx").agg(
        F.sum(F.col("value") * F.col("_y")).alias("value")
    )


def norms(target: DataFrame, value: str = "y") -> DataFrame:
    """Rows and squared norm of the target per site."""
    return target.groupBy("site").agg(
        F.count(value).alias("n"), F.sum(F.col(value) * F.col(value)).alias("yty")
    )


def target_products(target: DataFrame, value: str = "y") -> DataFrame:
    """Y'Y between the sites of one group: (site1, site2, value).

    The products are formed per time inside the row of that time's group, whose
    length is the number of sites of the group.
    """
    keyed = target if "group" in target.columns else target.withColumn("group", F.lit("all"))
    rows = keyed.groupBy("group", "ts").agg(F.collect_list(F.struct("site", F.col(value).alias("y"))).alias("_ys"))
    left = rows.select("_ys", F.explode("_ys").alias("_a"))
    pairs = left.select("_a", F.explode(F.filter("_ys", lambda o: o["site"] >= F.col("_a")["site"])).alias("_b"))
    return pairs.groupBy(F.col("_a")["site"].alias("site1"), F.col("_b")["site"].alias("site2")).agg(
        F.sum(F.col("_a")["y"] * F.col("_b")["y"]).alias("value")
    )


def scaled(statistics: DataFrame, n: int | None = None) -> DataFrame:
    """Statistics divided by the number of rows (column ``n`` unless given)."""
    return statistics.withColumn("value", F.col("value") / (F.lit(n) if n is not None else F.col("n")))


def with_owner(statistics: DataFrame, table: DataFrame) -> DataFrame:
    """Mark each statistic as of a shared or an owned block."""
    part = F.when(F.col("shared"), "shared").otherwise("owned")
    return statistics.join(table.select("block", part.alias("part")), "block")


def sum_over_groups(statistics: DataFrame, groups: DataFrame) -> DataFrame:
    """X'Y summed over the sites of each group (site, group)."""
    return statistics.join(groups, "site").groupBy("group", "block", "idx").agg(F.sum("value").alias("value"))


def scales(coo: DataFrame, sizes: DataFrame, rows: int | None = None, alphas: DataFrame | None = None) -> DataFrame:
    """Standard deviation over all cells of each term, zeros included.

    Ridge and smoothing terms count sqrt(alpha) I as further rows. The scale only
    conditions a solver; the optimum does not change with it.
    """
    sums = coo.groupBy("term").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    joined = sums.join(sizes.groupBy("term").agg(F.sum("size").alias("p")), "term")
    joined = joined.withColumn("alpha", F.lit(0.0)) if alphas is None else joined.join(alphas, "term", "left")
    alpha = F.coalesce("alpha", F.lit(0.0))
    total_rows = F.lit(rows) + F.when(alpha > 0, F.col("p")).otherwise(0)
    cells = total_rows * F.col("p")
    total, squares = F.col("s") + F.sqrt(alpha) * F.col("p"), F.col("ss") + alpha * F.col("p")
    spread = F.sqrt(squares / cells - F.pow(total / cells, 2.0))
    return joined.select("term", F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))
