"""The preparation chains and the grouped ridge on small tables."""

import datetime as dt

import numpy as np
import pytest

from wattloom.operators import correct, grid, prepare

START = dt.datetime(2024, 1, 1)


def hours(n):
    return [START + dt.timedelta(hours=i) for i in range(n)]


@pytest.fixture(scope="module")
def raw_load(spark):
    """Two sound sites; ``bad`` is their sum with zeros and a gap; ``noise`` is random with a zero."""
    rng = np.random.default_rng(3)
    rows = []
    for i, ts in enumerate(hours(1200)):
        a, b = 50 + 20 * np.sin(i / 7) + rng.normal(), 40 + 10 * np.cos(i / 31) + rng.normal()
        rows += [("a", ts, a), ("b", ts, b), ("noise", ts, 0.0 if i == 600 else 50 + float(rng.normal()))]
        if i % 97 != 5:
            rows.append(("bad", ts, 0.0 if i % 89 == 3 else a + b))
    return spark.createDataFrame([(s, t, float(v)) for s, t, v in rows], "site string, ts timestamp, value double")


def test_load_is_filled_repaired_and_gated(spark, raw_load):
    repaired, dropped = prepare.prepare_load(raw_load, "ridge", train_limit=0.5, test_limit=0.3)
    assert [(r.site, r.reason) for r in dropped.collect()] == [("noise", "low r2 on training rows")]
    wide = repaired.toPandas().pivot(index="ts", columns="site", values="value")
    assert wide.shape == (1200, 3) and not wide.isna().any().any()
    zeros = [i for i in range(1200) if i % 89 == 3 and i % 97 != 5]
    found = wide["bad"].iloc[zeros]
    assert found.min() > 30 and (found - (wide["a"] + wide["b"]).iloc[zeros]).abs().median() < 6


def test_no_sound_site_drops_all_with_a_reason(spark, raw_load):
    repaired, dropped = prepare.prepare_load(raw_load.filter("site IN ('bad', 'noise')"), "ridge")
    assert repaired.count() == 0
    assert sorted((r.site, r.reason) for r in dropped.collect()) == [("bad", "not predicted"), ("noise", "not predicted")]


def test_ridge_of_all_sites_equals_numpy(spark, raw_load):
    flags = raw_load.filter("value = 0").selectExpr("site", "ts", "0L AS idx", "'zero' AS error_type")
    got = correct.impute(correct.known_rows(raw_load, flags), correct.covariates(raw_load, flags), "ridge").toPandas()
    x = raw_load.filter("site IN ('a', 'b')").toPandas().pivot(index="ts", columns="site", values="value")
    assert set(got.site) == {"bad", "noise"}
    for _, part in got.groupby("site"):
        part = part.set_index("ts").sort_index()
        train, own = (part.part == "train").to_numpy(), x.loc[part.index]
        z = ((own - own[train].mean()) / own[train].std()).to_numpy()
        mean, std = part.value[train].mean(), part.value[train].std()
        y = ((part.value - mean) / std).to_numpy()[train]
        b = np.linalg.solve(z[train].T @ z[train] + train.sum() * correct.RIDGE * np.eye(2), z[train].T @ y)
        assert np.allclose(part.prediction, z @ b * std + mean)


def test_weather_loses_late_flat_empty_and_lacking(spark):
    rows = []
    for i, ts in enumerate(hours(60)):
        for station in ("full", "late", "flat", "empty", "short"):
            for quantity in ("t", "w"):
                value = float(i * i)
                if quantity == "w" and (station == "empty" or station == "late" and i < 30 or station == "full" and i in (0, 7, 8)):
                    value = None
                if station == "flat" and quantity == "w":
                    value = 4.0
                if not (station == "short" and quantity == "w"):
                    rows.append((station, quantity, ts, value))
    raw = spark.createDataFrame(rows, "station string, quantity string, ts timestamp, value double")
    weather, trash = prepare.prepare_weather(raw)
    assert sorted(r.station for r in trash.collect()) == ["empty", "flat", "late", "short"]
    got = weather.toPandas().sort_values(["quantity", "ts"])
    assert set(got.station) == {"full"} and set(got.source) == {"observed"} and len(got) == 2 * 62
    w = got[got.quantity == "w"].value.tolist()
    assert w[0] == w[1] == 1.0 and w[7:9] == pytest.approx([36 + 15, 36 + 30]) and w[60:] == [59.0**2] * 2
    again = prepare.prepare_weather(grid.first_per_key(raw.union(raw), ["station", "quantity", "ts"], ["value"]))[0]
    assert again.exceptAll(weather).count() == 0
