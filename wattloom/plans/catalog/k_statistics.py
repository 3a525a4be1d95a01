"""K: sufficient statistics of the default design and of its target."""

from pyspark.sql import functions as F

from ...operators import evaluate, features, stats
from ...operators.features import Term
from ...session import stage
from .. import bindings as b
from .. import formulas as f
from ..registry import query
from ..sql_parts import final, with_parts
from .common import tidy
from .j_features import DESIGN, default_blocks, default_design, default_parts
from .n_evaluation import NORM

DIGITS = 5
#: Hours since 1970 are this large; sums with the time trend are compared as shares of it.
TREND = 5e5


def trend_sql(block: str) -> str:
    return f"CASE WHEN left({block}, 3) = 't03' THEN {TREND} ELSE 1 END"


TRAIN = {
    **DESIGN,
    "x_rows": "SELECT * FROM nonzero WHERE split = 'training'",
    "xtx_half": f"""SELECT a.site, a.block AS block1, a.idx AS idx1, b.block AS block2, b.idx AS idx2, sum(a.value * b.value) / any_value({trend_sql('a.block')}) / any_value({trend_sql('b.block')}) AS value
        FROM x_rows a JOIN x_rows b ON a.site = b.site AND a.ts = b.ts AND (a.block < b.block OR (a.block = b.block AND a.idx <= b.idx)) GROUP BY ALL""",
    **NORM,
    "y_rows": "SELECT site, ts, normalised AS y FROM norm WHERE split = 'training'",
    "xty_rows": f"SELECT x.site, x.block, x.idx, sum(x.value * t.y) / any_value({trend_sql('x.block')}) AS value FROM x_rows x JOIN y_rows t USING (site, ts) GROUP BY ALL",
}


def training(spark, sf):
    rows, by_site = default_design(spark, sf)
    return rows.filter("split = 'training'"), by_site


def target(spark, sf):
    """Target normalised on its training mean, written once per session."""
    return stage(spark, sf, "target_h", lambda: evaluate.normalise(b.split_h(spark, sf)).select(
        "site", "ts", "split", F.col("normalised").alias("y")
    ))


def default_gram(spark, sf):
    """X'X of each design of the default formula, shared products formed once."""
    rows, units = default_parts(spark, sf)
    blocks = stage(spark, sf, "gram_h", lambda: stats.gram_of_parts(rows.filter("split = 'training'"), units))
    return stats.of_designs(blocks, units)


def gram_by_site(spark, sf):
    _, by_site = default_design(spark, sf)
    return relative(default_gram(spark, sf).join(by_site, "sig").drop("sig"), "block1", "block2")


def relative(sums, *blocks):
    """Sums with the time trend as shares of its size."""
    for block in blocks:
        sums = sums.withColumn("value", F.col("value") / F.when(F.col(block).startswith("t03@"), TREND).otherwise(1.0))
    return sums


def kind(block: str) -> str:
    return f"(left({block}, 3) IN ('t04', 't05'))"


SHAPE = f"site block1 idx1# block2 idx2# value~{DIGITS}"


@query("k1_gram_univariate", final(SHAPE, f"(SELECT * FROM xtx_half WHERE NOT {kind('block1')} AND NOT {kind('block2')})", **TRAIN))
def k1(spark, sf):
    return tidy(gram_by_site(spark, sf).filter(f"NOT {kind('block1')} AND NOT {kind('block2')}"), DIGITS)


@query("k2_gram_interactions", final(SHAPE, f"(SELECT * FROM xtx_half WHERE {kind('block1')} OR {kind('block2')})", **TRAIN))
def k2(spark, sf):
    return tidy(gram_by_site(spark, sf).filter(f"{kind('block1')} OR {kind('block2')}"), DIGITS)


@query("k3_symmetric", final(SHAPE, """(SELECT * FROM xtx_half UNION ALL SELECT site, block2, idx2, block1, idx1, value FROM xtx_half
    WHERE block1 <> block2 OR idx1 <> idx2)""", **TRAIN))
def k3(spark, sf):
    return tidy(stats.symmetric(gram_by_site(spark, sf)), DIGITS)


def cross(spark, sf):
    rows, by_site = training(spark, sf)
    return relative(stats.cross(rows, target(spark, sf), by_site), "block")


@query("k4_cross_products", with_parts(f"""SELECT site, block, idx::BIGINT AS idx, CASE WHEN round(value, {DIGITS}) = 0 THEN 0 ELSE round(value, {DIGITS}) END AS value FROM xty_rows
    UNION ALL SELECT a.site, 'y@' || b.site, 0, round(sum(a.y * b.y), {DIGITS}) FROM y_rows a JOIN y_rows b ON a.ts = b.ts AND a.site <= b.site GROUP BY a.site, b.site""", **TRAIN))
def k4(spark, sf):
    """X'Y, and Y'Y as rows of a block named after the other site."""
    products = stats.target_products(target(spark, sf).filter("split = 'training'")).select(
        F.col("site1").alias("site"), F.concat(F.lit("y@"), "site2").alias("block"), F.lit(0).alias("idx"), "value"
    )
    return tidy(cross(spark, sf).drop("sig").unionByName(products), DIGITS)


@query("k5_scaled", with_parts("""SELECT site, block, CAST(idx AS BIGINT) AS idx, CASE WHEN round(value / n, 7) = 0 THEN 0 ELSE round(value / n, 7) END AS value, CASE WHEN shared THEN 'shared' ELSE 'owned' END AS part
    FROM xty_rows JOIN (SELECT site, count(*) AS n FROM y_rows GROUP BY 1) USING (site) JOIN block_table USING (block)""", **TRAIN))
def k5(spark, sf):
    counted = cross(spark, sf).join(stats.norms(target(spark, sf).filter("split = 'training'")), "site")
    parted = stats.with_owner(stats.scaled(counted), default_blocks(spark, sf)[0])
    return tidy(parted.select("site", "block", "idx", "value", "part"), 7)


@query("k6_group_sums", with_parts(f"""SELECT left(site, 1) <= 'e' AS early, block, idx, sum(value) AS value FROM xty_rows GROUP BY ALL""".replace(
    "left(site, 1) <= 'e' AS early", "CASE WHEN left(site, 1) <= 'e' THEN 'early' ELSE 'late' END AS \"group\"").replace(
    "block, idx, sum(value) AS value", f"block, CAST(idx AS BIGINT) AS idx, CASE WHEN round(sum(value), {DIGITS}) = 0 THEN 0 ELSE round(sum(value), {DIGITS}) END AS value"), **TRAIN))
def k6(spark, sf):
    """Sums of X'Y over two groups of sites."""
    return tidy(stats.sum_over_groups(cross(spark, sf), groups(spark, sf)), DIGITS)


def groups(spark, sf):
    early = F.when(F.substring("site", 1, 1) <= "e", "early").otherwise("late")
    return b.sites_h(spark, sf).withColumn("group", early)


@query("k7_scale", with_parts("""SELECT term, sqrt(ss / cells - (s / cells) ** 2) AS scale FROM (
    SELECT 0 AS term, sum(value) + sqrt(1e-2) * 40 AS s, sum(value * value) + 1e-2 * 40 AS ss, (480 + 40) * 40::DOUBLE AS cells FROM h1 WHERE split = 'training' AND abs(value) > 1e-12
    UNION ALL SELECT 1, sum(value), sum(value * value), 480 * 8 FROM h2 WHERE split = 'training' AND abs(value) > 1e-12)""".replace(
    "SELECT term, sqrt(ss / cells - (s / cells) ** 2) AS scale", "SELECT CAST(term AS BIGINT) AS term, round(sqrt(ss / cells - (s / cells) ** 2), 6) AS scale"), **TRAIN))
def k7(spark, sf):
    """Scale of a smoothed term over its 8 stations, and of a cyclic term."""
    formula = [Term((f.TEMPERATURE,), "smoothing", 1e-2), Term((f.HOUR,))]
    inputs = b.inputs_h(spark, sf, [("temperature", "", None), ("hour", "", None)])
    rows = features.design(inputs, formula, b.sites_h(spark, sf)).filter("split = 'training'")
    term = F.substring("block", 2, 2).cast("int")
    table, _ = features.blocks(inputs, formula)
    alphas = spark.createDataFrame([(i, float(t.alpha)) for i, t in enumerate(formula)], "term int, alpha double")
    coo = features.coordinates(rows).withColumn("term", term)
    return tidy(stats.scales(coo, table, rows=20 * 24, alphas=alphas))
