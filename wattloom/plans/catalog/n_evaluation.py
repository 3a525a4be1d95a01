"""N: normalisation and evaluation; also I1 and I2, the splits they rest on."""

from pyspark.sql import functions as F

from ...functions import calendar
from ...operators import evaluate
from ...operators.split import bucket_by_training_range, split_periods
from .. import bindings as b
from ..registry import query
from ..sql_parts import NAIVE_PARTS, final, scores, with_parts
from .common import tidy


@query("i1_split", final("site ts! value~ split", """(SELECT *, CASE WHEN ts < TIMESTAMP '1998-01-05' THEN 'training' ELSE 'validation' END AS split
    FROM load_d WHERE ts >= TIMESTAMP '1995-01-05' AND ts < TIMESTAMP '1999-01-05')"""))
def i1(spark, sf):
    return tidy(split_periods(b.load_d(spark, sf), "ts", "1995-01-05", "3 years", "1 year"))


@query("i2_bucket", final("site ts! split value~ bucket#", """(SELECT s.*, least(greatest(floor((value - lo) / (hi - lo) * 4), 0), 3) AS bucket
    FROM split_h s, (SELECT min(value) AS lo, max(value) AS hi FROM split_h WHERE split = 'training'))"""))
def i2(spark, sf):
    return tidy(bucket_by_training_range(b.split_h(spark, sf), "value", 4))


NORM = {"norm": "SELECT s.*, m.mean_train, (value - mean_train) / mean_train AS normalised FROM split_h s JOIN (SELECT site, avg(value) AS mean_train FROM split_h WHERE split = 'training' GROUP BY 1) m USING (site)"}


@query("n1_normalise", final("site ts! split value~ mean_train~ normalised~", "norm", **NORM))
def n1(spark, sf):
    return tidy(evaluate.normalise(b.split_h(spark, sf)))


@query("n2_denormalise", final("site ts! prediction~", "(SELECT site, ts, value AS prediction FROM norm)", **NORM))
def n2(spark, sf):
    restored = evaluate.denormalise(evaluate.normalise(b.split_h(spark, sf)), "normalised")
    return tidy(restored.select("site", "ts", "prediction"))


def metric(name: str, column: str):
    @query(name, with_parts(f"SELECT site, split, {column} FROM naive_scores", **NAIVE_PARTS))
    def run(spark, sf):
        return evaluate.performances(b.naive(spark, sf), ["site", "split"]).select("site", "split", column)


for _name, _column in [("n3_mse", "mse"), ("n4_mae", "mae"), ("n5_score", "score"), ("n6_mape", "mape"), ("n7_nmse", "nmse")]:
    metric(_name, _column)


@query("n8_rmnmse", with_parts("SELECT split, round(100 * sqrt(avg(nmse)), 8) AS rmnmse FROM naive_scores GROUP BY split", **NAIVE_PARTS))
def n8(spark, sf):
    return evaluate.overall_error(evaluate.performances(b.naive(spark, sf), ["site", "split"]), keys=["split"])


@query("n9_null_check", with_parts("SELECT count(*) FILTER (target IS NULL) AS null_targets, count(*) FILTER (prediction IS NULL) AS null_predictions FROM (SELECT value AS target, lag(value, 7) OVER (PARTITION BY site ORDER BY ts) AS prediction FROM daily)"))
def n9(spark, sf):
    """A daily series with gaps against its value a week earlier."""
    daily = b.daily(spark, sf)
    earlier = daily.select("site", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts"), F.col("value").alias("prediction"))
    return evaluate.null_counts(daily.withColumnRenamed("value", "target").join(earlier, ["site", "ts"], "left"))


@query("n10_aggregated", with_parts(scores("(SELECT split, ts, sum(target) AS target, sum(prediction) AS prediction FROM naive GROUP BY 1, 2)", "split"), **NAIVE_PARTS))
def n10(spark, sf):
    return evaluate.performances(evaluate.aggregated(b.naive(spark, sf), extra=["split"]), ["split"])


@query("n11_good_days", with_parts(scores("(SELECT * FROM naive WHERE NOT (split = 'validation' AND ts >= TIMESTAMP '2024-01-29') AND strftime(ts, '%m%d') <> '0101' AND ts >= TIMESTAMP '2024-01-10')", "site, split"), **NAIVE_PARTS))
def n11(spark, sf):
    """Holidays by rule; the break covers the days up to 9 January and from 29 January."""
    spans = spark.createDataFrame([("2023-12-23", "2024-01-09"), ("2024-01-29", "2024-02-04")], "s string, e string").select(
        F.to_date("s").alias("start"), F.to_date("e").alias("end")
    )
    marked = calendar.in_intervals(b.naive(spark, sf), "ts", spans, "xmas").withColumn("holidays", calendar.holidays(F.col("ts")))
    return evaluate.performances(evaluate.good_days(marked), ["site", "split"])


@query("n12_weekly_naive", with_parts(scores("naive", "site, split"), **NAIVE_PARTS))
def n12(spark, sf):
    """Grid, back-fill, split, weekly naive prediction and all metrics."""
    return evaluate.performances(b.naive(spark, sf), ["site", "split"])


DAILY_SCORES = {
    "weekly": "SELECT site, value AS target, lag(value, 7) OVER (PARTITION BY site ORDER BY ts) AS prediction FROM filled_d",
    "weekly_scores": scores("(SELECT * FROM weekly WHERE target IS NOT NULL AND prediction IS NOT NULL)", "site"),
}


def daily_scores(spark, sf):
    return evaluate.performances(evaluate.weekly_naive(b.filled_d(spark, sf), ["site"], period_rows=7, step=86400))


@query("n13_summary", with_parts("""SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS max, round(min(v), 6) AS min FROM (
    SELECT 'score' AS metric, score AS v FROM weekly_scores UNION ALL SELECT 'mape', mape FROM weekly_scores UNION ALL SELECT 'nmse', nmse FROM weekly_scores) GROUP BY 1""", **DAILY_SCORES))
def n13(spark, sf):
    return tidy(evaluate.summary(daily_scores(spark, sf)))


@query("n14_quantiles", with_parts("SELECT " + ", ".join(f"round(quantile_cont(mape, {p}), 6) AS q{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM weekly_scores", **DAILY_SCORES))
def n14(spark, sf):
    return tidy(evaluate.quantiles(daily_scores(spark, sf)))
