"""M: benchmark models on the hourly inputs."""

from pyspark.sql import functions as F

from ...operators import benchmarks, features, fit, smoothness, stepwise
from ...operators.features import Term
from ...session import materialize
from .. import bindings as b
from .. import formulas as f
from ..registry import query
from ..sql_parts import final, with_parts
from .common import tidy
from .j_features import ASSIGNED, IN
from .l_models import HOURLY, normalised, shared_statistics

INPUTS = {
    **IN,
    "lag_rows": """SELECT 'target' AS name_input, 'lag' AS transformation, '24' AS parameter, site AS location, ts, first_value(value) OVER (
        PARTITION BY site ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS value FROM clean_h""",
    "input_rows": """SELECT i.*, t.split FROM (SELECT * FROM lag_rows UNION ALL SELECT 'temperature', '', '', location, ts, value FROM temp
        UNION ALL SELECT 'hour', '', '', '', ts, hour(ts) FROM times UNION ALL SELECT 'weekend', '', '', '', ts, CAST(isodow(ts) > 5 AS INT) FROM times
        UNION ALL SELECT 'timestamp', '', '', '', ts, epoch(ts) / 3600 FROM times UNION ALL SELECT 'year_day', '', '', '', ts, dayofyear(ts) FROM times
        UNION ALL SELECT 'week_day', 'binary', '', CAST(k AS VARCHAR), ts, CAST(isodow(ts) - 1 = k AS INT) FROM times, (SELECT DISTINCT isodow(ts) - 1 AS k FROM times)) i JOIN times t USING (ts)""",
}
KEYS = "name_input transformation parameter location"
COMMA = KEYS.replace(" ", ", ")


@query("m1_standardise", final(f"{KEYS} split ts! value~", f"""(SELECT {COMMA}, split, ts, (value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS value FROM input_rows JOIN
    (SELECT {COMMA}, avg(value) AS m, stddev_samp(value) AS sd FROM input_rows WHERE split = 'training' GROUP BY ALL) USING ({COMMA}))""", **INPUTS))
def m1(spark, sf):
    return tidy(benchmarks.standardise(b.inputs_h(spark, sf), features.KEY + ["location"]))


def vectors(spark, sf):
    scaled = benchmarks.standardise(b.inputs_h(spark, sf), features.KEY + ["location"])
    target = normalised(spark, sf).withColumnRenamed("normalised", "value")
    return benchmarks.site_vectors(scaled, target, b.assignment_h(spark, sf))


@query("m2_random_forest")
def m2(spark, sf):
    return tidy(benchmarks.tree_benchmark(vectors(spark, sf), "random_forest"))


@query("m3_regression_tree")
def m3(spark, sf):
    return tidy(benchmarks.tree_benchmark(vectors(spark, sf), "regression_tree"))


@query("m4_boosted_trees")
def m4(spark, sf):
    return tidy(benchmarks.tree_benchmark(vectors(spark, sf), "boosted_trees"))


def hinged(spark, sf):
    rows = b.inputs_h(spark, sf)
    return benchmarks.hinges(rows, benchmarks.knots(rows, 3))


@query("m5_hinges", final(f"{KEYS} split ts! value~8", f"""(SELECT name_input, transformation, parameter || ':' || side || ':' || k AS parameter, location, split, ts,
    greatest(0, CASE side WHEN 'up' THEN value - t ELSE t - value END) AS value FROM input_rows JOIN
    (SELECT {COMMA}, unnest([0, 1, 2]) AS k, unnest(quantile_cont(value, [0.25, 0.5, 0.75])) AS t FROM input_rows WHERE split = 'training' GROUP BY {COMMA}) USING ({COMMA}), (SELECT unnest(['up', 'down']) AS side))""", **INPUTS))
def m5(spark, sf):
    return tidy(hinged(spark, sf), 8)


@query("m5_mars")
def m5_fit(spark, sf):
    """Pairs of hinges of all inputs, chosen forward and pruned backward."""
    return tidy(stepwise.mars(vectors(spark, sf))[0])


@query("m6_gam")
def m6(spark, sf):
    """Smooth, linear, by-indicator and tensor terms, each as smooth as its site's data ask for."""
    univariate = {
        ("target", "lag", "24"): "s", ("temperature", "", ""): "s", ("year_day", "", ""): "s",
        ("timestamp", "", ""): "", ("week_day", "binary", ""): "", ("weekend", "", ""): "",
    }
    bivariate = {
        (("target", "lag", "24"), ("week_day", "binary", "")): "by",
        (("year_day", "", ""), ("hour", "", "")): "te",
    }
    formula = benchmarks.gam_formula(univariate, bivariate)
    assignment, sites = b.assignment_h(spark, sf), b.sites_h(spark, sf)
    rows = materialize(features.design(b.inputs_h(spark, sf), formula, sites, assignment))
    by_site, _ = features.signatures(sites, assignment)
    parts = features.parts(b.inputs_h(spark, sf), formula, sites, assignment)
    found = materialize(smoothness.chosen_fit(*fit.statistics(rows, normalised(spark, sf), by_site, parts=(materialize(parts[0]), parts[1])), formula))
    coef = found.filter("kind = 'coefficient'").select("site", "block", "idx", "value")
    return tidy(fit.predict(rows, coef, by_site))


STRENGTHS = [10.0 ** (k / 2) for k in range(-10, 1)]


@query("m6_strength", with_parts("""SELECT site, kind, block, 0::BIGINT AS idx, round(value, 6) AS value FROM (
    SELECT site, 'strength' AS kind, 't00' AS block, arg_min(t, score) AS value FROM scored GROUP BY 1
    UNION ALL SELECT site, 'score', '', min(score) FROM scored GROUP BY 1
    UNION ALL SELECT site, 'freedom', '', arg_min(edf, score) FROM scored GROUP BY 1
    UNION ALL SELECT h.site, 'coefficient', 't00@', c / (d + t) FROM hour_c h JOIN (SELECT site, arg_min(t, score) AS t FROM scored GROUP BY 1) USING (site) WHERE h.idx = 0)""",
    **HOURLY, hour_y="SELECT site, sum(y * y) / count(*) AS yy FROM hour_rows WHERE split = 'training' GROUP BY 1",
    scored=f"""SELECT site, t, edf, (any_value(yy) - 2 * sum(c * c / (d + t)) + sum(c * c * d / (d + t) ** 2)) / (1 - sum(d / (d + t)) / any_value(n)) ** 2 AS score, sum(d / (d + t)) AS edf
        FROM hour_c JOIN hour_y USING (site), (SELECT unnest({STRENGTHS}) AS t) GROUP BY site, t""".replace("site, t, edf, (", "site, t, (")))
def m6_strength(spark, sf):
    """Strength, score and freedom of a ridge on the hours, and the first coefficient."""
    formula = [Term((f.EACH_HOUR,), "ridge", 1e-3)]
    found = smoothness.chosen_fit(*shared_statistics(spark, sf, formula), formula, STRENGTHS)
    return tidy(found.filter("kind <> 'coefficient' OR idx = 0"))


@query("m7_site_inputs", with_parts(f"""SELECT site, {COMMA} FROM (SELECT DISTINCT {COMMA} FROM input_rows WHERE name_input NOT IN ('target', 'temperature')) CROSS JOIN kinds
    UNION ALL SELECT location AS site, {COMMA} FROM (SELECT DISTINCT {COMMA} FROM input_rows WHERE name_input = 'target')
    UNION ALL SELECT site, {COMMA} FROM (SELECT DISTINCT {COMMA} FROM input_rows WHERE name_input = 'temperature') JOIN near USING (location)""", **INPUTS, **ASSIGNED))
def m7(spark, sf):
    return benchmarks.site_inputs(b.inputs_h(spark, sf), b.sites_h(spark, sf), b.assignment_h(spark, sf))


@query("m8_distinct_counts", with_parts(f"SELECT {COMMA}, count(DISTINCT value) AS n_distinct FROM input_rows GROUP BY ALL", **INPUTS))
def m8(spark, sf):
    return benchmarks.distinct_counts(b.inputs_h(spark, sf))
