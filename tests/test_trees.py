"""Trees of all groups against plain ones, whatever part of the work is local."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wattloom.operators import trees


def plain_tree(x, y, train, depth):
    """Recursive exact tree on the training rows, predictions of all rows."""
    def go(rows, left):
        t = rows[train[rows]]
        out[rows] = y[t].mean()
        best = (1e-9, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[t, f])
            for cut in values[:-1]:
                a, b = y[t][x[t, f] <= cut], y[t][x[t, f] > cut]
                gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - y[t].sum() ** 2 / len(t)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
        if left != 0 and best[1] is not None:
            goes = x[rows, best[1]] <= best[2]
            for part in (rows[goes], rows[~goes]):
                go(part, left - 1)

    out = np.empty(len(y))
    # the bins of the engine are cut once, at the middles of all training values
    for f in range(x.shape[1]):
        values = np.unique(x[train, f])
        x[:, f] = np.searchsorted((values[1:] + values[:-1]) / 2, x[:, f], side="left")
    go(np.arange(len(y)), depth)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for site, n in (("a", 90), ("b", 30), ("c", 1)):
        x = np.column_stack([rng.integers(0, 12, n), rng.random(n).round(2), rng.integers(0, 2, n)]).astype(float)
        y = rng.integers(-50, 50, n).astype(float) + 20 * x[:, 2]
        rows += [(site, i, "training" if i % 4 else "validation", float(y[i]), x[i].tolist()) for i in range(n)]
    rows.append(("c", 1, "training", 5.0, [1.0, 1.0, 1.0]))
    rows.append(("d", 0, "validation", 5.0, [1.0, 1.0, 1.0]))
    rows.append(("b", 99, "training", None, [1.0, 1.0, 1.0]))
    schema = "site string, ts int, split string, target double, x array<double>"
    return rows, spark.createDataFrame(rows, schema).select("site", "ts", "split", "target", array_to_vector("x").alias("features"))


def expected(rows, predict):
    out = {}
    for site in "abc":
        mine = [r for r in rows if r[0] == site]
        x = np.array([r[4] for r in mine])
        y = np.array([np.nan if r[3] is None else r[3] for r in mine])
        train = np.array([r[2] == "training" and r[3] is not None for r in mine])
        out |= {(r[0], r[1]): p for r, p in zip(mine, predict(x, y, train), strict=True)}
    return out


def got(df):
    return {(r.site, r.ts): r.prediction for r in df.collect()}


@pytest.mark.parametrize(("depth", "local_rows"), [(None, 20), (None, 1000), (2, 0), (2, 1000)])
def test_tree_is_the_plain_one(data, depth, local_rows):
    rows, df = data
    found = got(trees.forest(df, 1, depth, local_rows=local_rows))
    assert found == pytest.approx(expected(rows, lambda x, y, t: plain_tree(x, y, t, -1 if depth is None else depth)))


@pytest.mark.parametrize("local_rows", [20, 1000])
def test_boosting_is_the_plain_one(data, local_rows):
    rows, df = data

    def plain(x, y, train):
        total = np.full(len(y), y[train].mean())
        for _ in range(3):
            total += 0.3 * plain_tree(x.copy(), y - total, train, 2)
        return total

    found = got(trees.boosted(df, 3, 2, 0.3, local_rows=local_rows))
    assert found == pytest.approx(expected(rows, plain))


def test_forest_is_the_mean_of_its_trees_and_does_not_depend_on_the_bound(data):
    rows, df = data
    one, other = (got(trees.forest(df, 5, 3, local_rows=n)) for n in (20, 1000))
    assert one == pytest.approx(other)
    assert {k[0] for k in one} == {"a", "b", "c"} and len(one) == 123
    rmse = {p: np.sqrt(np.mean([(r[3] - one[r[0], r[1]]) ** 2 for r in rows if r[0] == "a" and r[2] == p])) for p in ("training", "validation")}
    assert rmse["training"] < np.std([r[3] for r in rows if r[0] == "a"])


def test_bootstrap_counts_are_poisson(spark):
    state = spark.range(2000).select(F.struct("id").alias("_row"), F.lit(1.0).alias("_w"))
    counts = trees.bootstrap(state, 20, 3).groupBy("_w").count().toPandas().set_index("_w")["count"] / 40000
    assert counts[0.0] == pytest.approx(np.exp(-1), abs=0.01) and counts[2.0] == pytest.approx(np.exp(-1) / 2, abs=0.01)


def test_bins_of_many_rows_and_empty_table(spark):
    df = spark.range(5000).select(F.lit("a").alias("site"), F.lit("training").alias("split"), "id", F.col("id").cast("double").alias("target"),
                                  array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    out = trees.forest(df, 1, None, bins=16)
    assert out.select("prediction").distinct().count() == 16
    assert out.agg(F.max(F.abs(F.col("prediction") - F.col("target")))).first()[0] < 5000 / 16
    assert trees.forest(df.limit(0), 1, None).count() == 0 and trees.boosted(df.limit(0), 2).count() == 0
