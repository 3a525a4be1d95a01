"""J: spline features, interactions and masks."""

from pyspark.sql import functions as F

from ...operators import features
from ...operators.features import Factor, Term
from ...session import stage
from .. import bindings as b
from .. import formulas as f
from ..registry import query
from ..sql_parts import final, with_parts
from .common import tidy

DIGITS = 8

IN = {
    "times": "SELECT DISTINCT ts, split FROM split_h",
    "temp": "SELECT w.station AS location, w.ts, w.value, t.split FROM weather_filled w JOIN times t USING (ts) WHERE quantity = 'temperature'",
    "temp_range": "SELECT location, min(value) AS lo, max(value) AS hi FROM temp WHERE split = 'training' GROUP BY 1",
    "hours": "SELECT '' AS location, ts, hour(ts) AS value, split FROM times",
}


def hats(source: str, ranges: str, intervals: int) -> str:
    """The hat rule stated function by function on node triplets."""
    return f"""SELECT location, ts, split, i AS idx, CASE i WHEN 0 THEN greatest(f3, 0) WHEN 1 THEN greatest(least(f2, f3), least(0, f2))
        ELSE greatest(least(f2, f3), 0) END AS value FROM (
        SELECT s.location, s.ts, s.split, i, (s.value - (lo + (i - 1) / {intervals}::DOUBLE * (hi - lo))) / ((hi - lo) / {intervals}) AS f2,
          ((lo + (i + 1) / {intervals}::DOUBLE * (hi - lo)) - s.value) / ((hi - lo) / {intervals}) AS f3
        FROM {source} s JOIN {ranges} r USING (location), (SELECT unnest(generate_series(0, {intervals})) AS i))"""


def cyclic_hats(source: str, period: int, intervals: int) -> str:
    return f"""SELECT location, ts, split, i AS idx, greatest(least((z - a) / (c - a), (z - e) / (c - e)), 0) AS value FROM (
        SELECT s.location, s.ts, s.split, i, a, CASE WHEN c <= a THEN c + {period} ELSE c END AS c, CASE WHEN e <= a THEN e + {period} ELSE e END AS e,
          CASE WHEN s.value <= a THEN s.value + {period} ELSE s.value END AS z
        FROM {source} s, (SELECT i, i / {intervals}::DOUBLE * {period} AS a, ((i + 1) % {intervals}) / {intervals}::DOUBLE * {period} AS c,
          ((i + 2) % {intervals}) / {intervals}::DOUBLE * {period} AS e FROM (SELECT unnest(generate_series(0, {intervals} - 1)) AS i)))"""


def design(spark, sf, formula, combine="product", assignment=None):
    wanted = [w for w in f.WANTED if any(fac.name == w[0] for term in formula for fac in term.factors)]
    inputs = b.inputs_h(spark, sf, wanted)
    return features.design(inputs, formula, b.sites_h(spark, sf), assignment, combine)


def nonzero(spark, sf, formula, combine="product"):
    return features.coordinates(design(spark, sf, formula, combine)).select("split", "ts", "block", "idx", "value")


@query("j1_nodes", with_parts("""SELECT location, i AS position, round(lo + (i - 1) / 4::DOUBLE * (hi - lo), 6) AS node FROM temp_range, (SELECT unnest(generate_series(0, 6)) AS i)
    UNION ALL SELECT 'hour', i, round(i / 8::DOUBLE * 24, 6) FROM (SELECT unnest(generate_series(0, 7)) AS i)""", **IN))
def j1(spark, sf):
    formula = [Term((f.TEMPERATURE,)), Term((f.HOUR,))]
    inputs = b.inputs_h(spark, sf, [("temperature", "", None), ("hour", "", None)])
    table = features.nodes(inputs, features.factor_table(spark, formula))
    named = table.withColumn("location", F.when(F.col("location") == "", "hour").otherwise(F.col("location")))
    return tidy(named.select("location", F.posexplode("nodes").alias("position", "node")))


@query("j2_triplets", with_parts("""SELECT location, i AS idx, round(lo + (i - 1) / 4::DOUBLE * (hi - lo), 6) AS "left", round(lo + i / 4::DOUBLE * (hi - lo), 6) AS centre,
    round(lo + (i + 1) / 4::DOUBLE * (hi - lo), 6) AS "right" FROM temp_range, (SELECT unnest(generate_series(0, 4)) AS i)
    UNION ALL SELECT 'hour', i, i * 3.0, ((i + 1) % 8) * 3.0, ((i + 2) % 8) * 3.0 FROM (SELECT unnest(generate_series(0, 7)) AS i)""", **IN))
def j2(spark, sf):
    formula = [Term((f.TEMPERATURE,)), Term((f.HOUR,))]
    inputs = b.inputs_h(spark, sf, [("temperature", "", None), ("hour", "", None)])
    table = features.triplets(features.nodes(inputs, features.factor_table(spark, formula)))
    named = table.withColumn("location", F.when(F.col("location") == "", "hour").otherwise(F.col("location")))
    return tidy(named.drop("factor"))


def coo(name: str, source: str, block: str = "'t00@' || location") -> str:
    return f"(SELECT split, ts, {block} AS block, idx, value FROM {source} WHERE abs(value) > 1e-12)"


SHAPE = f"split ts! block idx# value~{DIGITS}"


@query("j3_hat_basis", final(SHAPE, coo("j3", "hat"), hat=hats("temp", "temp_range", 16), **IN))
def j3(spark, sf):
    return tidy(nonzero(spark, sf, [Term((Factor("temperature", 16),))]), DIGITS)


@query("j4_cyclic_basis", final(SHAPE, coo("j4", "hat"), hat=cyclic_hats("hours", 24, 8), **IN))
def j4(spark, sf):
    return tidy(nonzero(spark, sf, [Term((f.HOUR,))]), DIGITS)


@query("j5_power", final(SHAPE, coo("j5", "(SELECT *, 0 AS idx FROM temp)"), **IN))
def j5(spark, sf):
    return tidy(nonzero(spark, sf, [Term((Factor("temperature", "p1"),))]), DIGITS)


PAIR = {"ta": hats("temp", "temp_range", 4), "ho": cyclic_hats("hours", 24, 8), **IN}


def pair(combine: str, index: str = "a.idx * 8 + h.idx") -> str:
    return f"""(SELECT a.split, a.ts, 't00@' || a.location || '|' AS block, {index} AS idx, {combine} AS value
        FROM ta a JOIN ho h USING (ts) WHERE abs({combine}) > 1e-12)"""


@query("j6_interaction_product", final(SHAPE, pair("a.value * h.value"), **PAIR))
def j6(spark, sf):
    return tidy(nonzero(spark, sf, [Term((f.TEMPERATURE, f.HOUR))]), DIGITS)


@query("j7_interaction_minimum", final(SHAPE, pair("least(a.value, h.value)"), **PAIR))
def j7(spark, sf):
    return tidy(nonzero(spark, sf, [Term((f.TEMPERATURE, f.HOUR))], "minimum"), DIGITS)


@query("j8_mirrored", final(SHAPE, pair("a.value * h.value", "h.idx * 5 + a.idx"), **PAIR))
def j8(spark, sf):
    rows = nonzero(spark, sf, [Term((f.TEMPERATURE, f.HOUR))])
    return tidy(features.mirrored(rows, 5, 8), DIGITS)


# blocks of the default formula, stated term by term
ASSIGNED = {
    "station_pairs": f"""SELECT a.name AS site, s.name AS location, round((1 - cos(radians(a.latitude) - radians(s.latitude))) / 2
        + (1 - cos(radians(a.longitude) - radians(s.longitude))) / 2 * cos(radians(a.latitude)) * cos(radians(s.latitude)), 12) AS d
        FROM type_coords a CROSS JOIN station_coords s""",
    "near": "SELECT site, location FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, location) AS r FROM station_pairs) WHERE r <= 2",
    "kinds": "SELECT DISTINCT event_type AS site FROM events",
    "mask": """SELECT 't00@' || site AS block, site FROM kinds UNION ALL SELECT 't01@' || location, site FROM near
        UNION ALL SELECT 't05@' || site || '|', site FROM kinds""",
    "block_table": """SELECT DISTINCT block, CASE left(block, 3) WHEN 't00' THEN 0 WHEN 't01' THEN 1 ELSE 5 END AS term, 5 AS size1,
          CASE left(block, 3) WHEN 't05' THEN 8 ELSE 1 END AS size2, CASE left(block, 3) WHEN 't05' THEN 40 ELSE 5 END AS size, false AS shared FROM mask
        UNION ALL SELECT * FROM (VALUES ('t02@', 2, 8, 1, 8, true), ('t03@', 3, 1, 1, 1, true), ('t04@|', 4, 1, 8, 8, true))""",
}


def default_blocks(spark, sf):
    return features.blocks(b.inputs_h(spark, sf, f.WANTED), f.DEFAULT, b.assignment_h(spark, sf))


def used_blocks(spark, sf):
    """Blocks without a site are dropped with the inner join on the mask."""
    table, mask = default_blocks(spark, sf)
    return table.filter("shared").unionByName(table.join(mask.select("block").distinct(), "block", "left_semi").filter("NOT shared")), mask


@query("j9_block_sizes", final("block size1# size2# size#", "block_table", **ASSIGNED))
def j9(spark, sf):
    table, _ = used_blocks(spark, sf)
    return tidy(table.select("block", "size1", "size2", "size"))


@query("j10_mask", final("block site", "(SELECT * FROM mask WHERE left(block, 3) <> 't05')", **ASSIGNED))
def j10(spark, sf):
    return default_blocks(spark, sf)[1].filter("block NOT LIKE 't05%'")


@query("j11_interaction_mask", with_parts("SELECT 't00@' || n.location || '|' || k.site AS block, n.site FROM near n JOIN kinds k USING (site)", **ASSIGNED))
def j11(spark, sf):
    """Interaction of two owned inputs: the sites they have in common."""
    formula = [Term((f.TEMPERATURE, f.LAG))]
    return features.blocks(b.inputs_h(spark, sf, f.WANTED), formula, b.assignment_h(spark, sf))[1]


@query("j12_shared_sites", with_parts("SELECT DISTINCT a.block AS block1, b.block AS block2 FROM mask a JOIN mask b USING (site) WHERE a.block <= b.block", **ASSIGNED))
def j12(spark, sf):
    return features.blocks_sharing_a_site(default_blocks(spark, sf)[1])


@query("j13_ownership", with_parts("""SELECT block, CASE WHEN shared THEN 5 ELSE n END AS n_sites, CASE WHEN shared OR n = 5 THEN 'all' ELSE 'some' END AS owner
    FROM block_table LEFT JOIN (SELECT block, count(*) AS n FROM mask GROUP BY 1) USING (block)""", **ASSIGNED))
def j13(spark, sf):
    table, mask = used_blocks(spark, sf)
    return features.ownership(table, mask, b.sites_h(spark, sf))


DESIGN = {
    "lagged": """SELECT site AS location, ts, split, value FROM (SELECT site, ts, first_value(value) OVER (PARTITION BY site ORDER BY ts
        RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS value FROM clean_h) JOIN times USING (ts)""",
    "lag_range": "SELECT location, min(value) AS lo, max(value) AS hi FROM lagged WHERE split = 'training' GROUP BY 1",
    "h0": hats("lagged", "lag_range", 4), "h1": hats("temp", "temp_range", 4), "h2": cyclic_hats("hours", 24, 8),
    "design": """SELECT location AS site, ts, split, 't00@' || location AS block, idx, value FROM h0
        UNION ALL SELECT n.site, h.ts, h.split, 't01@' || h.location, h.idx, h.value FROM h1 h JOIN near n USING (location)
        UNION ALL SELECT k.site, h.ts, h.split, 't02@', h.idx, h.value FROM h2 h CROSS JOIN kinds k
        UNION ALL SELECT k.site, t.ts, t.split, 't03@', 0, epoch(t.ts) / 3600 FROM times t CROSS JOIN kinds k
        UNION ALL SELECT k.site, h.ts, h.split, 't04@|', h.idx, h.value * CAST(isodow(h.ts) > 5 AS INT) FROM h2 h CROSS JOIN kinds k
        UNION ALL SELECT a.location, a.ts, a.split, 't05@' || a.location || '|', a.idx * 8 + h.idx, a.value * h.value FROM h0 a JOIN h2 h USING (ts)""",
    "nonzero": "SELECT * FROM design WHERE abs(value) > 1e-12",
    **IN, **ASSIGNED,
}


def default_design(spark, sf):
    """(design, (site, sig)) of the default formula, written once per session."""
    assignment = b.assignment_h(spark, sf)
    sites = b.sites_h(spark, sf)
    rows = stage(spark, sf, "design_h", lambda: features.design(b.inputs_h(spark, sf), f.DEFAULT, sites, assignment))
    return rows, features.signatures(sites, assignment)[0]


def default_parts(spark, sf):
    """The default design in units, written once per session."""
    rows, units = features.parts(b.inputs_h(spark, sf), f.DEFAULT, b.sites_h(spark, sf), b.assignment_h(spark, sf))
    return stage(spark, sf, "parts_h", lambda: rows), units


@query("j14_design", final(f"site split ts! block idx# value~{DIGITS}", "nonzero", **DESIGN))
def j14(spark, sf):
    rows, by_site = default_design(spark, sf)
    full = features.coordinates(rows).join(by_site, "sig")
    return tidy(full.select("site", "split", "ts", "block", "idx", "value"), DIGITS)
