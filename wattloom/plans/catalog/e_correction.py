"""E: correction of flagged values, on the daily shipped quantity."""

from pyspark.sql import functions as F

from ...operators import correct, detect
from ...operators.split import split_periods
from ...session import stage
from .. import bindings as b
from ..registry import query
from ..sql_parts import NAIVE_PARTS, final, with_parts
from .common import tidy
from .d_detection import window_parts

FLAGS = window_parts("shipped", 7)


def flags(spark, sf):
    return stage(spark, sf, "flags_s", lambda: detect.detect_errors(b.shipped(spark, sf), step=86400, period=7))


@query("e1_covariates", final("site ts! value~", "(SELECT * FROM shipped WHERE site NOT IN (SELECT site FROM flagged WHERE error_type IS NOT NULL))", **FLAGS))
def e1(spark, sf):
    return tidy(correct.covariates(b.shipped(spark, sf), flags(spark, sf)))


@query("e2_known_rows", with_parts("""SELECT site, CAST(count(*) FILTER (error_type IS NULL) AS BIGINT) AS n_known, CAST(count(error_type) AS BIGINT) AS n_unknown
    FROM flagged GROUP BY 1 HAVING count(error_type) > 0 AND count(*) > count(error_type)""", **FLAGS))
def e2(spark, sf):
    rows = correct.repairable(correct.known_rows(b.shipped(spark, sf), flags(spark, sf)))
    return tidy(correct.known_counts(rows))


@query("e3_train_test", with_parts("""SELECT site, part, count(*) AS rows FROM (SELECT site, CASE WHEN error_type IS NOT NULL THEN 'unknown'
    WHEN CAST('0x' || substr(md5(site || '|' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 9 THEN 'test' ELSE 'train' END AS part
    FROM flagged WHERE site IN (SELECT site FROM flagged WHERE error_type IS NOT NULL)) GROUP BY 1, 2""", **FLAGS))
def e3(spark, sf):
    rows = correct.train_test(correct.known_rows(b.shipped(spark, sf), flags(spark, sf)))
    return tidy(rows.groupBy("site", "part").agg(F.count(F.lit(1)).alias("rows")))


@query("e4_z_score", final("site ts! value~ split z~", """(SELECT s.*, (value - m) / sd AS z FROM split_s s JOIN
    (SELECT site, avg(value) AS m, stddev_samp(value) AS sd FROM split_s WHERE split = 'training' GROUP BY 1) USING (site))""",
    split_s="""SELECT *, CASE WHEN ts < TIMESTAMP '1998-02-01' THEN 'training' ELSE 'validation' END AS split FROM shipped
        WHERE ts >= TIMESTAMP '1995-02-01' AND ts < TIMESTAMP '1999-02-01'"""))
def e4(spark, sf):
    split = split_periods(b.shipped(spark, sf), "ts", "1995-02-01", "3 years", "1 year")
    return tidy(correct.z_scores(split, ["site"], "value", "split = 'training'").drop("mean", "std"))


def imputed(spark, sf, kind, trees=100):
    rows = correct.known_rows(b.shipped(spark, sf), flags(spark, sf))
    return correct.impute(rows, correct.covariates(b.shipped(spark, sf), flags(spark, sf)), kind, trees)


@query("e5_random_forest")
def e5(spark, sf):
    return tidy(imputed(spark, sf, "random_forest").filter("part = 'unknown'"))


@query("e6_boosted_trees")
def e6(spark, sf):
    return tidy(imputed(spark, sf, "boosted_trees").filter("part = 'unknown'"))


@query("e7_ridge")
def e7(spark, sf):
    return tidy(imputed(spark, sf, "ridge").filter("part = 'unknown'"))


R2 = "SELECT site, split, 1 - avg((target - prediction) ** 2) / var_samp(target) AS r2 FROM naive GROUP BY 1, 2"


def r2(spark, sf):
    return correct.r_squared(b.naive(spark, sf), ["site", "split"], "target")


@query("e8_r_squared", with_parts(f"SELECT site, split, round(r2, 6) AS r2 FROM ({R2})", **NAIVE_PARTS))
def e8(spark, sf):
    return tidy(r2(spark, sf))


@query("e9_quality_gate", with_parts("""SELECT site, CAST(a > -1.1 AND b > -1.0 AS BIGINT) AS kept,
    CASE WHEN a > -1.1 AND b > -1.0 THEN '' WHEN a <= -1.1 THEN 'low r2 on training rows' ELSE 'low r2 on test rows' END AS reason
    FROM (SELECT site, max(r2) FILTER (split = 'training') AS a, max(r2) FILTER (split = 'validation') AS b FROM r2_rows GROUP BY 1)""", r2_rows=R2, **NAIVE_PARTS))
def e9(spark, sf):
    """The gate at limits that part the naive forecasts of these series."""
    part = F.when(F.col("split") == "training", "train").otherwise("test")
    return tidy(correct.quality_gate(r2(spark, sf).withColumn("part", part), -1.1, -1.0))


@query("e10_overwrite", final("site ts! value~", """(SELECT s.site, s.ts, CASE WHEN f.error_type IS NOT NULL THEN coalesce(m.prediction, s.value) ELSE s.value END AS value
    FROM shipped s LEFT JOIN flagged f ON f.site = s.site AND f.ts = s.ts LEFT JOIN
    (SELECT site, ts, avg(value) OVER (PARTITION BY site, isodow(ts)) AS prediction FROM shipped) m ON m.site = s.site AND m.ts = s.ts)""", **FLAGS))
def e10(spark, sf):
    """Flagged points take the mean of their site and day of the week."""
    load = b.shipped(spark, sf)
    means = load.groupBy("site", F.weekday("ts").alias("d")).agg(F.avg("value").alias("prediction"))
    predictions = load.withColumn("d", F.weekday("ts")).join(means, ["site", "d"]).select("site", "ts", "prediction")
    return tidy(correct.overwrite(load, flags(spark, sf), predictions))
