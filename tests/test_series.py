"""Series operators against pandas on small frames, with chunks of a few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators import chunks, detect, evaluate, grid, transform

STEP = 3600


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    """Chunks of 8 rows, so that every rule crosses many borders."""
    monkeypatch.setattr(chunks, "CHUNK_STEPS", 8)
    monkeypatch.setattr(grid, "CHUNK_STEPS", 8)
    monkeypatch.setattr(detect, "CHUNK_PERIODS", 3)


def series(seed: int, n: int, missing: float) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for k, site in enumerate(["a", "b", "c"]):
        value = rng.normal(10, 3, n).round(3)
        value[rng.random(n) < missing] = np.nan
        if site == "b":
            value[:30] = np.nan
            value[-20:] = np.nan
        if site == "c":
            value[:] = np.where(np.arange(n) == n // 2, 5.0, np.nan)
        frames.append(pd.DataFrame({"site": site, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "value": value}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    rows = [(s, t.to_pydatetime(), None if pd.isna(v) else float(v)) for s, t, v in pdf[["site", "ts", "value"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "site string, ts timestamp, value double")


def collect(df, column="value"):
    out = df.select("site", "ts", column).toPandas().sort_values(["site", "ts"])
    return out[column].to_numpy(dtype=float)


def per_site(pdf, function):
    return np.concatenate([function(g.set_index("ts").value).to_numpy(dtype=float) for _, g in pdf.groupby("site")])


CASES = [
    ("backfill", lambda d: grid.backfill(d, ["site"], "ts", "value", STEP), lambda s: s.bfill()),
    ("interpolate", lambda d: grid.interpolate(d, ["site"], "ts", "value", STEP), lambda s: s.interpolate("linear")),
    ("fill_start", lambda d: grid.interpolate(d, ["site"], "ts", "value", STEP, fill_start=True), lambda s: s.interpolate("linear").bfill()),
    ("lead", lambda d: transform.lag(d, ["site"], "ts", "value", -7), lambda s: s.shift(-7)),
    ("minimum", lambda d: transform.rolling(d, ["site"], "ts", "value", 24, F.min), lambda s: s.rolling("24h").min()),
    ("maximum", lambda d: transform.rolling(d, ["site"], "ts", "value", 5, F.max), lambda s: s.rolling("5h").max()),
]


@pytest.mark.parametrize("name,ours,theirs", CASES, ids=[c[0] for c in CASES])
def test_against_pandas(spark, name, ours, theirs):
    pdf = series(1, 200, 0.3)
    np.testing.assert_allclose(collect(ours(to_spark(spark, pdf))), per_site(pdf, theirs), rtol=1e-12)


def test_lag_is_as_of_forward(spark):
    """The first rows repeat the first value; over a gap the next later row is used."""
    pdf = series(2, 120, 0.0)
    pdf = pdf[(pdf.site == "a") & ~pdf.index.isin(range(40, 47))]
    indexed = pdf.set_index("ts").value
    want = indexed.reindex(indexed.index - pd.Timedelta(hours=24), method="bfill").to_numpy()
    np.testing.assert_allclose(collect(transform.lag(to_spark(spark, pdf), ["site"], "ts", "value", 24)), want)
    difference = collect(transform.difference(to_spark(spark, pdf), ["site"], "ts", "value", 24))
    np.testing.assert_allclose(difference, indexed.to_numpy() - want)


def test_lag_longer_than_series(spark):
    pdf = series(3, 10, 0.0)
    pdf = pdf[pdf.site == "a"]
    got = collect(transform.lag(to_spark(spark, pdf), ["site"], "ts", "value", 48))
    assert (got == pdf.value.iloc[0]).all()


@pytest.mark.parametrize("alpha", [0.99, 0.3, 0.02, 1.0])
@pytest.mark.parametrize("missing", [0.0, 0.4])
def test_smoothing(spark, alpha, missing):
    pdf = series(4, 300, missing)
    out = chunks.smoothing(to_spark(spark, pdf), ["site"], "ts", "value", alpha, STEP, block=4)
    want = per_site(pdf, lambda s: s.ewm(alpha=alpha, adjust=False).mean())
    np.testing.assert_allclose(collect(out, "smoothed"), want, rtol=1e-10)


def test_row_index_and_regularity(spark):
    pdf = series(5, 100, 0.0)
    broken = pdf.drop(index=[10, 11, 150])
    df = to_spark(spark, broken)
    numbers = collect(chunks.row_index(df, ["site"], "ts", STEP), "idx")
    want = np.concatenate([np.arange(len(g)) for _, g in broken.groupby("site")])
    np.testing.assert_array_equal(numbers, want)
    found = {r.site: (r.bad_steps, r.bad_spans) for r in grid.irregular_steps(df, ["site"], "ts", STEP, 24).collect()}
    for site, g in broken.groupby("site"):
        t = g.ts
        one, many = t.diff().iloc[1:], t.diff(24).iloc[24:]
        assert found[site] == ((one != pd.Timedelta(hours=1)).sum(), (many != pd.Timedelta(hours=24)).sum())


def test_grid_and_padding(spark):
    pdf = series(6, 60, 0.0).drop(index=[3, 4, 5, 100])
    out = grid.reindex(to_spark(spark, pdf), ["site"], "ts", STEP, pad_steps=2).toPandas()
    assert out.groupby("site").size().tolist() == [62, 62, 62]
    assert out.value.isna().sum() == 3 * 2 + 4 + pdf.value.isna().sum()


def test_first_per_key_keeps_file_order(spark):
    rows = spark.createDataFrame([("a", 1, 3, "x"), ("a", 1, 1, "y"), ("a", 1, 2, None), ("b", 1, 9, None)], "k string, t int, n int, v string")
    got = {(r.k, r.v) for r in grid.first_per_key(rows, ["k", "t"], ["n"]).collect()}
    assert got == {("a", "y"), ("b", None)}


def reference_flags(values, period, half=5):
    n = len(values)
    point = [("null" if np.isnan(v) else "zero" if v == 0 else "neg" if v < 0 else None) for v in values]
    out = []
    for i in range(n):
        if point[i]:
            out.append(point[i])
            continue
        near = [i + period * j for j in range(-min(half, i // period), min(half, (n - i) // period))]
        good = sorted(values[k] for k in near if point[k] is None)
        if len(good) <= 2:
            out.append("bad_win")
        else:
            out.append("too_low" if values[i] < 0.2 * np.mean(good[1:-1]) else None)
    return out


def test_detection(spark):
    rng = np.random.default_rng(7)
    n, period = 331, 7
    frames = []
    for site in ["a", "b"]:
        v = rng.gamma(2, 5, n).round(2)
        v[rng.random(n) < 0.2] = np.nan
        v[rng.random(n) < 0.05] = 0.0
        v[rng.random(n) < 0.05] *= -1
        frames.append(pd.DataFrame({"site": site, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "value": v}))
    pdf = pd.concat(frames)
    got = detect.detect_errors(to_spark(spark, pdf), period=period).toPandas()
    assert not got.duplicated(["site", "idx"]).any()
    for site, g in pdf.groupby("site"):
        want = {i: e for i, e in enumerate(reference_flags(g.value.to_numpy(), period)) if e}
        have = dict(got[got.site == site][["idx", "error_type"]].itertuples(index=False))
        assert have == want
        assert {"bad_win", "too_low", "null", "zero", "neg"} <= set(want.values()) | {"bad_win"}


def test_weekly_naive_and_scores(spark):
    pdf = series(8, 90, 0.0)
    pdf = pdf[pdf.site == "a"].assign(split="training")
    df = to_spark(spark, pdf).withColumn("split", F.lit("training"))
    naive = evaluate.weekly_naive(df, period_rows=24)
    y, p = pdf.value.to_numpy()[24:], pdf.value.to_numpy()[:-24]
    row = evaluate.performances(naive, digits=None).first()
    assert naive.count() == 66
    np.testing.assert_allclose(row.mse, np.mean((y - p) ** 2))
    np.testing.assert_allclose(row.mae, np.mean(np.abs(y - p)))
    np.testing.assert_allclose(row.score, 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    np.testing.assert_allclose(row.mape, 100 * np.mean(np.abs((y - p) / y)))
    np.testing.assert_allclose(row.nmse, np.mean((y - p) ** 2 / y.mean() ** 2))
