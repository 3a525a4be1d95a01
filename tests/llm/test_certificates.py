"""Certified cutoffs against a plain version, and the rate of false certificates."""

import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import quality_rules

NAMES = ["symbol_share", "word_length"]


def labelled(spark, rows):
    """(scores, labels, all rows with the part they are in) of (id, stratum, good, two scores)."""
    every = spark.createDataFrame(rows, "doc_id long, stratum string, good boolean, symbol_share double, word_length double").repartition(4)
    scores = every.drop("good").withColumn("base_failed", F.lit(False))
    labels = every.select("doc_id", F.col("good").cast("int").alias("quality"))
    plans = F.pmod(F.xxhash64("doc_id"), F.lit(quality_rules.PLAN_ONE_IN)) == 0
    return scores, labels, every.withColumn("plans", plans).toPandas()


def plain_cutoffs(rows, limit, error):
    """{(stratum, rule): cutoff}, step by step."""
    found, strata = {}, rows.stratum.unique()
    for stratum in strata:
        part = rows[rows.stratum == stratum]
        plan, proof = part[part.plans], part[~part.plans & part.good]
        steps = []
        for place, rule in enumerate(NAMES):
            grid = set()
            for v in plan[rule]:
                if v > 0:
                    unit = 10.0 ** (math.floor(math.log10(v)) - 1)
                    grid.add(round((math.ceil(v / unit) - 1) * unit, 9))
            best = cost = 0
            for cut in sorted(grid, reverse=True):
                over = plan[rule] > cut
                good, bad = int((over & plan.good).sum()), int((over & ~plan.good).sum())
                if bad - quality_rules.PRICE * good > best:
                    best, cost = bad - quality_rules.PRICE * good, max(cost, good / bad)
                    steps.append((cost, place, -cut, rule))
        out = np.zeros(len(proof), bool)
        for _, _, cut, rule in sorted(steps):
            out |= (proof[rule] > -cut).to_numpy()
            k, n = int(out.sum()), len(proof)
            if k >= n * limit or brute.binomial_tail(k, n, limit) > error / len(strata):
                break
            found[stratum, rule] = -cut
    return found


def test_cutoffs_by_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(9000):
        good = bool(rng.random() < 0.8)
        symbol = 0.0 if rng.random() < (0.97 if good else 0.3) else float(rng.choice([0.013, 0.027, 0.11, 0.36])) * (0.3 if good else 1.0)
        length = float(rng.normal(5.0 if good else 7.5, 0.5))
        rows.append((i, ["one", "two", "two", None][i % 4], good, symbol, length))
    scores, labels, every = labelled(spark, rows)
    every["stratum"] = every.stratum.where(every.stratum.notna(), None).astype(object).map(lambda s: s if isinstance(s, str) else "none")
    got = quality_rules.certified_cutoffs(scores, labels, 0.02, 0.05, NAMES).collect()
    want = plain_cutoffs(every, 0.02, 0.05)
    assert {s for s, _ in want} == {"one", "two", "none"}
    assert {(r.stratum or "none", r.rule): r.cutoff for r in got} == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}


def test_false_certificates_are_rare(spark):
    """200 strata in which every cutoff rejects more good documents than allowed: at a level of 0.05
    each, about one in twenty may be certified by chance."""
    rng = np.random.default_rng(9)
    n, strata = 500, 200
    rows = []
    for s in range(strata):
        over = rng.random(n)
        rows += [(s * n + j, f"s{s}", bool(j % 4), float(over[j] < 0.021) if j % 4 else 1.0, 0.0) for j in range(n)]
    scores, labels, _ = labelled(spark, rows)
    got = quality_rules.certified_cutoffs(scores, labels, 0.02, 0.05 * strata, NAMES)
    assert got.select("stratum").distinct().count() <= 0.1 * strata


def test_given_documents_get_cutoffs_and_keep_good_ones(spark):
    docs = spark.createDataFrame(
        [(i, ("ab #$% |<> " if i % 5 == 0 else "plain words that say nothing new ") + " ".join(f"w{i}x{j}" for j in range(12)), "en") for i in range(4000)],
        "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    got = quality_rules.judged(docs, labels)
    assert {r.doc_id for r in got.where("NOT kept").collect()} == {i for i in range(4000) if i % 5 == 0}
    assert {r.doc_id for r in quality_rules.judged(docs, labels.limit(0)).where("NOT kept").collect()} == set()
