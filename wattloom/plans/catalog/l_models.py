"""L: penalised additive models. Where the design is the 24 indicators of the hour,
X'X is diagonal and SQL can state the optimum; the other fits have no SQL."""

from pyspark.sql import functions as F

from ...operators import coupled, features, fit
from ...operators.features import Factor, Term
from ...session import fresh_path, materialize, stage
from .. import bindings as b
from .. import formulas as f
from ..registry import query
from ..sql_parts import NAIVE_PARTS, final, rounded, with_parts
from .common import tidy
from .j_features import DESIGN, default_design, default_parts
from .k_statistics import NORM, groups, target


def normalised(spark, sf):
    return target(spark, sf).withColumnRenamed("y", "normalised")


def design_of(spark, sf, formula, assignment=None):
    return features.design(b.inputs_h(spark, sf), formula, b.sites_h(spark, sf), assignment)


def shared_statistics(spark, sf, formula):
    """Statistics of calendar terms, one design for all sites."""
    by_site, _ = features.signatures(b.sites_h(spark, sf), None)
    return fit.statistics(design_of(spark, sf, formula), normalised(spark, sf), by_site)


def default_statistics(spark, sf):
    """X'X and X'Y of the default design, written once per session; sites with gaps have statistics of their own."""
    rows, by_site = default_design(spark, sf)
    made = []

    def both():
        if not made:
            made.append(fit.statistics(rows, normalised(spark, sf), by_site, parts=default_parts(spark, sf)))
        return made[0]

    return stage(spark, sf, "xtx_h", lambda: both()[0]), stage(spark, sf, "xty_h", lambda: both()[1])


def fitted(spark, sf, formula):
    return fit.coefficients(*shared_statistics(spark, sf, formula), formula)


# sums per site and hour on the training rows: c = X'Y / n, d = diagonal of X'X / n
HOURLY = {
    **NORM,
    "hour_rows": "SELECT site, ts, split, normalised AS y, (hour(ts) + 23) % 24 AS idx FROM norm",
    "hour_n": "SELECT site, count(*) AS n FROM hour_rows WHERE split = 'training' GROUP BY 1",
    "hour_c": """SELECT site, idx, any_value(n) AS n, sum(y) / any_value(n) AS c, count(*)::DOUBLE / any_value(n) AS d
        FROM hour_rows JOIN hour_n USING (site) WHERE split = 'training' GROUP BY 1, 2""",
}


def closed(expression: str, source: str = "hour_c") -> str:
    return with_parts(f"SELECT site, 't00@' AS block, CAST(idx AS BIGINT) AS idx, {rounded(expression, 6)} AS value FROM {source}", **HOURLY)


SOFT = "sign(c) * greatest(abs(c) - {0}, 0)"


@query("l1_ridge", closed("c / (d + 1e-3)"))
def l1(spark, sf):
    return tidy(fitted(spark, sf, [Term((f.EACH_HOUR,), "ridge", 1e-3)]))


@query("l2_smoothing")
def l2(spark, sf):
    """The default formula: smoothed terms and interactions, ridge on the rest."""
    return tidy(fit.coefficients(*default_statistics(spark, sf), f.DEFAULT))


PAIRED = (Factor("timestamp", 4), f.HOUR)


@query("l3_factor_smoothing")
def l3(spark, sf):
    return tidy(fitted(spark, sf, [Term(PAIRED, "factor_smoothing", 1e-3)]))


@query("l4_block_smoothing")
def l4(spark, sf):
    formula = [Term((f.EACH_HOUR,), "block_smoothing", (1e-2, 1.1))]
    return tidy(coupled.row_coupled(*shared_statistics(spark, sf, formula), formula))


@query("l5_lasso", closed(SOFT.format("5e-4") + " / d"))
def l5(spark, sf):
    return tidy(fitted(spark, sf, [Term((f.EACH_HOUR,), "lasso", 5e-4)]))


@query("l6_elastic_net", closed(SOFT.format("(0.5 * 1e-3)") + " / (d + 0.5 * 1e-3)"))
def l6(spark, sf):
    return tidy(fitted(spark, sf, [Term((f.EACH_HOUR,), "elastic_net", (0.5, 1e-3))]))


@query("l7_row_group_lasso", closed("c / d * greatest(0, 1 - 1e-3 / rn)", "(SELECT *, sqrt(sum(c * c) OVER (PARTITION BY idx)) AS rn FROM hour_c)"))
def l7(spark, sf):
    formula = [Term((f.EACH_HOUR,), "row_group_lasso", 1e-3)]
    return tidy(coupled.row_coupled(*shared_statistics(spark, sf, formula), formula))


NORMED = "(SELECT *, sqrt(sum(c * c) OVER (PARTITION BY site)) AS cn FROM hour_c)"


@query("l8_column_group_lasso", closed("c / d * greatest(0, 1 - 2e-3 / cn)", NORMED))
def l8(spark, sf):
    return tidy(fitted(spark, sf, [Term((f.EACH_HOUR,), "column_group_lasso", 2e-3)]))


@query("l9_clipped_deviation", closed("c / d * greatest(0, 1 - CASE WHEN 2e-3 * (cn - 2e-3) / d < 5e-4 * (cn - 2e-3) / d + 1 THEN 2e-3 ELSE 5e-4 END / cn)", NORMED))
def l9(spark, sf):
    return tidy(fitted(spark, sf, [Term((f.EACH_HOUR,), "clipped_deviation", (2e-3, 5e-4, 1.0))]))


@query("l10_total_variation")
def l10(spark, sf):
    return tidy(fitted(spark, sf, [Term((f.EACH_HOUR,), "total_variation", 1e-3)]))


@query("l11_trend_filtering")
def l11(spark, sf):
    return tidy(fitted(spark, sf, [Term((f.EACH_HOUR,), "trend_filtering", 1e-3)]))


def squared(name: str, rounds: int = 16) -> dict[str, str]:
    """CTEs that square the matrix ``name``_0 (i, j, v) again and again, so that its first eigenvector
    remains: ``name``_v is the projection on it."""
    parts = {
        f"{name}_{k + 1}": f"""SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM (
            SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} a JOIN {name}_{k} b ON a.j = b.i GROUP BY 1, 2)"""
        for k in range(rounds)}
    return parts | {f"{name}_v": f"SELECT i, j, v FROM {name}_{rounds}"}


# the two first directions among the sites of the whitened right sides, and all sites' c projected on them
LOW_RANK = {
    **HOURLY,
    "first_0": "SELECT a.site AS i, b.site AS j, sum(a.c * b.c / (a.d + 1e-4)) AS v FROM hour_c a JOIN hour_c b USING (idx) GROUP BY 1, 2",
    **squared("first"),
    "second_0": """SELECT g.i, g.j, any_value(g.v) - sum(h.v * p.v) AS v FROM first_0 g JOIN first_0 h ON g.i = h.i JOIN first_v p ON h.j = p.i AND g.j = p.j
        GROUP BY 1, 2""",
    **squared("second"),
    "two_v": "SELECT i, j, a.v + b.v AS v FROM first_v a JOIN second_v b USING (i, j)",
    "rank_c": "SELECT p.j AS site, h.idx, any_value(h.d) AS d, sum(h.c * p.v) AS c FROM hour_c h JOIN two_v p ON h.site = p.i GROUP BY 1, 2",
}


@query("l12_low_rank_sites", with_parts(
    f"SELECT site, 't00@' AS block, CAST(idx AS BIGINT) AS idx, {rounded('c / (d + 1e-4)', 6)} AS value FROM rank_c", **LOW_RANK))
def l12(spark, sf):
    formula = [Term((f.EACH_HOUR,), "ridge", 1e-4)]
    return tidy(coupled.low_rank_across_sites(*shared_statistics(spark, sf, formula), formula, rank=2))


@query("l13_low_rank_interaction")
def l13(spark, sf):
    formula = [Term((f.EACH_HOUR,), "ridge", 1e-4), Term(PAIRED, "low_rank_interaction", 0.0, 1)]
    return tidy(fitted(spark, sf, formula))


@query("l14_sesquivariate")
def l14(spark, sf):
    formula = [Term((f.HOUR,), "ridge", 1e-4), Term((f.HOUR, Factor("timestamp", 4)), "sesquivariate")]
    return tidy(fitted(spark, sf, formula))


JOINT = """(SELECT h.site, h.idx, h.c, h.d, g.m, g.total, 2 * g.total / (2 * h.d + 1e-3) AS s FROM hour_c h JOIN team USING (site)
    JOIN (SELECT grp, idx, sum(c) AS total, count(*) AS m FROM hour_c JOIN team USING (site) GROUP BY 1, 2) g ON g.grp = team.grp AND g.idx = h.idx)"""


@query("l15_sum_consistent", with_parts(f"SELECT site, 't00@' AS block, CAST(idx AS BIGINT) AS idx, {rounded('(c + (total - d * s) / m) / (d + 1e-3)')} AS value FROM {JOINT}",
    team="SELECT DISTINCT event_type AS site, CASE WHEN left(event_type, 1) <= 'e' THEN 'early' ELSE 'late' END AS grp FROM events", **HOURLY))
def l15(spark, sf):
    formula = [Term((f.EACH_HOUR,), "ridge", 1e-3)]
    xtx, xty = shared_statistics(spark, sf, formula)
    return tidy(fit.sum_consistent(xtx, xty, groups(spark, sf), formula))


@query("l16_fit_term", with_parts("SELECT site, split, round(0.5 * avg((target - prediction) ** 2), 6) AS fit FROM naive GROUP BY 1, 2", **NAIVE_PARTS))
def l16(spark, sf):
    return tidy(fit.fit_term(b.naive(spark, sf), keys=["site", "split"]))


def hourly_means(spark, sf):
    """Coefficients to evaluate: the mean of the normalised target by hour."""
    rows = normalised(spark, sf).filter("split = 'training'")
    return rows.groupBy("site", ((F.hour("ts") + 23) % 24).alias("idx")).agg(F.avg("normalised").alias("value"))


PENALTIES = [
    ("ridge", 0.5), ("smoothing", 0.5), ("block_smoothing", (0.5, 1.1)), ("lasso", 0.5), ("elastic_net", (0.3, 0.5)),
    ("row_group_lasso", 0.5), ("column_group_lasso", 0.5), ("clipped_deviation", (0.5, 0.1, 0.2)),
    ("total_variation", 0.5), ("trend_filtering", 0.5),
]
PENALTY_SQL = {
    **HOURLY,
    "mean_b": "SELECT site, idx, avg(y) AS v FROM hour_rows WHERE split = 'training' GROUP BY 1, 2",
    "diff_b": "SELECT site, idx, v, v - lag(v, 1) OVER w AS d1, v - 2 * lag(v, 1) OVER w + lag(v, 2) OVER w AS d2 FROM mean_b WINDOW w AS (PARTITION BY site ORDER BY idx)",
    "pen": """SELECT 0 AS i, 'ridge' AS kind, 0.25 * sum(v * v) AS penalty FROM mean_b UNION ALL SELECT 1, 'smoothing', 0.25 * sum(d2 * d2) FROM diff_b
        UNION ALL SELECT 2, 'block_smoothing', 0.25 * sum(r ** 1.1) FROM (SELECT sqrt(sum(d2 * d2)) AS r FROM diff_b WHERE d2 IS NOT NULL GROUP BY idx)
        UNION ALL SELECT 3, 'lasso', 0.5 * sum(abs(v)) FROM mean_b UNION ALL SELECT 4, 'elastic_net', 0.5 * sum(0.3 * abs(v) + 0.35 * v * v) FROM mean_b
        UNION ALL SELECT 5, 'row_group_lasso', 0.5 * sum(r) FROM (SELECT sqrt(sum(v * v)) AS r FROM mean_b GROUP BY idx)
        UNION ALL SELECT 6, 'column_group_lasso', 0.5 * sum(r) FROM (SELECT sqrt(sum(v * v)) AS r FROM mean_b GROUP BY site)
        UNION ALL SELECT 7, 'clipped_deviation', sum(least(0.5 * r, 0.1 * r + 0.2)) FROM (SELECT sqrt(sum(v * v)) AS r FROM mean_b GROUP BY site)
        UNION ALL SELECT 8, 'total_variation', 0.5 * sum(abs(d1)) FROM diff_b UNION ALL SELECT 9, 'trend_filtering', 0.5 * sum(abs(d2)) FROM diff_b""",
}


@query("l17_penalties", with_parts("SELECT 't0' || i || '@' AS block, kind, round(penalty, 6) AS penalty FROM pen", **PENALTY_SQL))
def l17(spark, sf):
    """Every penalty of the same coefficients, one block per penalty."""
    formula = [Term((f.EACH_HOUR,), kind, alpha) for kind, alpha in PENALTIES]
    blocks = F.explode(F.array(*[F.lit(f"{features.term_name(i)}@") for i in range(len(formula))]))
    coef = hourly_means(spark, sf).withColumn("block", blocks)
    return tidy(fit.penalties(coef, formula))


@query("l18_mean_baseline", with_parts("SELECT split, round(sum(e), 4) AS fit FROM (SELECT site, split, 0.5 * avg((value - mean_train) ** 2) AS e FROM norm GROUP BY 1, 2) GROUP BY 1", **NORM))
def l18(spark, sf):
    return tidy(fit.mean_baseline(b.split_h(spark, sf)), 4)


@query("l19_predict", final("site split ts! prediction~", "(SELECT site, split, ts, sum(value * ((idx * 3 % 7) - 3) / 10) AS prediction FROM nonzero WHERE left(block, 3) <> 't03' GROUP BY 1, 2, 3)", **DESIGN))
def l19(spark, sf):
    """Prediction from given coefficients, without the trend term."""
    rows, by_site = default_design(spark, sf)
    listed = features.coordinates(rows).select("sig", "block", "idx").distinct().join(by_site, "sig")
    coef = listed.select("site", "block", "idx", (((F.col("idx") * 3 % 7) - 3) / 10).alias("value"))
    return tidy(fit.predict(rows, coef, by_site, without_terms=[3]))


# models built on the fits: stored statistics, separated and independent fits

@query("a11_blocks", final("site split ts! block idx# value~8", "(SELECT * FROM nonzero WHERE block LIKE 't02@%' OR block LIKE 't05@%')", **DESIGN))
def a11(spark, sf):
    """The design in coordinate form, written under a run and read back by block."""
    from ...sources import tables

    path = fresh_path(spark, "blocks")
    rows, by_site = default_design(spark, sf)
    tables.write_blocks(features.coordinates(rows), path, "run")
    stored = tables.read_blocks(spark, path, "run").drop("run_id").filter("block LIKE 't02@%' OR block LIKE 't05@%'")
    return tidy(stored.join(by_site, "sig").drop("sig"), 8)


SEPARATED = """SELECT site, split, CAST(ts AS VARCHAR) AS ts, {0} AS prediction FROM (
    SELECT r.*, sum(CASE WHEN split = 'training' THEN y END) OVER w / n AS c, count(CASE WHEN split = 'training' THEN 1 END) OVER w / n::DOUBLE AS d FROM (
      SELECT *, count(CASE WHEN split = 'training' THEN 1 END) OVER (PARTITION BY site, bucket) AS n FROM (
        SELECT *, least(greatest(floor((dayofyear(ts) - 1) / 19.0 * 3), 0), 2) AS bucket FROM hour_rows)) r WINDOW w AS (PARTITION BY site, bucket, idx))"""


def observed(spark, sf, predictions):
    """Predictions at the times the site has a target."""
    return predictions.join(normalised(spark, sf).select("site", "ts"), ["site", "ts"], "left_semi")


@query("i3_separated_models", with_parts(SEPARATED.format(rounded("c / (d + 1e-3)")), **HOURLY))
def i3(spark, sf):
    """One model per third of the training days; each row predicted once."""
    from ...operators import separated

    formula = [Term((f.EACH_HOUR,), "ridge", 1e-3)]
    by_site, _ = features.signatures(b.sites_h(spark, sf), None)
    place = b.inputs_h(spark, sf).filter("name_input = 'year_day'")
    hat = separated.fit_and_predict(design_of(spark, sf, formula), normalised(spark, sf), by_site, place, 3, formula)
    return tidy(observed(spark, sf, hat))


INDEPENDENT = with_parts(f"""SELECT r.site, r.split, CAST(ts AS VARCHAR) AS ts, {rounded('c / (d + 3e-3) * mean_train + mean_train')} AS prediction
    FROM hour_rows r JOIN hour_c USING (site, idx) JOIN (SELECT DISTINCT site, mean_train FROM norm) USING (site)""", **HOURLY)


@query("i4_independent_sites", INDEPENDENT)
def i4(spark, sf):
    """All sites fitted in one job, each on its own; predictions in the unit of the load."""
    formula = [Term((f.EACH_HOUR,), "ridge", 3e-3)]
    rows = design_of(spark, sf, formula)
    by_site, _ = features.signatures(b.sites_h(spark, sf), None)
    coef = materialize(fit.coefficients(*fit.statistics(rows, normalised(spark, sf), by_site), formula))
    from ...operators import evaluate

    hat = fit.predict(rows, coef, by_site).withColumnRenamed("prediction", "_hat")
    means = evaluate.training_means(b.split_h(spark, sf))
    restored = evaluate.denormalise(hat.join(means, "site"), "_hat").select("site", "split", "ts", "prediction")
    return tidy(observed(spark, sf, restored))
