"""Quality rules whose cutoffs are chosen under a guaranteed rate of false rejections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, let, materialize, pick, removed_length, with_row, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Scores that may reject; a document is rejected where one exceeds its rule's cutoff.
RULES = ("symbol_share", "repeated_line_share", "repeated_word_share", "mark_share", "word_length")
#: One labelled document in so many plans the order of the cutoffs, the others certify them.
PLAN_ONE_IN = 4
#: Bad documents that must go for one good document lost: a cutoff gains k_bad - PRICE * k_good.
PRICE = 20
#: Strata with at most this many rows are joined by broadcast, others by their key.
SMALL_TABLE = 10_000


def repeated_words(words: Column) -> Column:
    """Number of words inside a window of five words that occurs twice or more.

    Windows are first compared by hash: where all hashes differ, all windows do. Only
    other documents sort their windows, by the words themselves, next to their equals.
    """
    return F.coalesce(F.when(F.size(words) > WINDOW, let(words, _repeated)), F.lit(0)).cast("long")


def _repeated(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.alias("at"))))
    return F.when(differ, F.lit(0)).otherwise(let(windows, _covered))


def _covered(windows: Column) -> Column:
    twins = F.filter(windows, lambda x, j: (
        (F.get(windows, j - 1)["w"] == x["w"]) & (j > 0)) | (F.coalesce(F.get(windows, j + 1)["w"] == x["w"], F.lit(False))))
    starts = F.sort_array(F.transform(twins, lambda x: x["at"]))
    return let(starts, lambda s: F.aggregate(
        F.transform(s, lambda at, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), at - F.get(s, j - 1)))),
        F.lit(0), lambda total, x: total + x))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
             keep: bool = False) -> DataFrame:
    """One row per document with counts and the score of each rule, with ``keep`` also the whole
    row. A null text has no words."""
    rows = (with_row if keep else pick)(docs, doc_id=key, text=text, stratum=stratum)
    kept = ["row"] if keep else []
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(SPACE_WORD))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    word_counts = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    counted = rows.select(
        *kept, "doc_id", "stratum",
        word_counts.alias("w"), line_counts.alias("l"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        removed_length(F.col("text"), SYMBOLS).alias("n_symbols"),
        removed_length(F.col("text"), "!?").alias("n_marks"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    plain = counted.select(
        *kept, "doc_id", "stratum",
        count(F.col("w.n_words")).alias("n_words"), count(F.col("word_chars")).alias("word_chars"),
        count(F.col("n_symbols")).alias("n_symbols"), count(F.col("l.n_dup_lines")).alias("n_dup_lines"),
        count(F.col("w.n_repeat_words")).alias("n_repeat_words"),
        count(F.col("l.n_lines")).alias("n_lines"), count(F.col("n_marks")).alias("n_marks"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return plain.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("repeated_line_share"),
        share("n_repeat_words", "n_words").alias("repeated_word_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("word_chars", "n_words").alias("word_length"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial(n, rate), exact up to rounding; 1 where k reaches n * rate.

    The last term is built in logarithms, the sum runs down from it, so large n neither
    underflow nor lose digits. Beyond n * rate no cutoff is ever certified.
    """
    odds = (1 - rate) / rate
    log_top = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0), lambda s, i: s + F.ln((n - i + 1) / i))
    log_top = log_top + k * F.lit(math.log(rate)) + (n - k) * F.lit(math.log1p(-rate))
    down = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: let(a["term"] * i / (n - i + 1) * odds, lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum"))),
    )["sum"]
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(log_top) * down)


def certified_cutoffs(scores: DataFrame, labels: DataFrame, false_rejections: float, error: float,
                      rules: Sequence[str] | dict[str, list[float]] = RULES, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, n_good, k_good, k_bad, p_value) of the chosen cutoffs.

    With probability ``1 - error`` the rules together reject at most ``false_rejections`` of
    the good documents of every stratum. Labelled documents that pass the base rule are split
    by a hash of their id. One part plans: cutoffs (two significant digits below the scores, or
    the given ones) are put in one order per stratum, those that reject few good documents for
    many bad ones first. The other part certifies: after each step the union of all
    rejections so far is tested by the exact binomial tail, and the first step that fails ends
    the stratum. The order does not depend on the certifying labels, so the steps of a stratum
    need no division of the level (fixed sequence); strata do, each has ``error / strata``. So
    with no good document rejected a stratum needs
    ``log(error / strata) / log(1 - false_rejections)`` good documents that certify: 436 of
    them at 0.01, 0.05 and four strata.

    ``n_good``, ``k_good`` and ``k_bad`` count all labelled documents for the cutoff alone;
    ``p_value`` is that of the last step passed, for all rules of the stratum. A rule without a
    gain (``PRICE``), or a stratum with too few labels, gets no cutoff and rejects nothing. Of
    cutoffs with equal gain the largest is taken. A document labelled several times counts
    once, as good if any label says so. Documents of a null stratum form a stratum.
    """
    names = list(rules)
    known = (
        pick(labels, doc_id=key, label=label).where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id").agg((F.max("label") > 0).alias("good"))
    )
    held = materialize(scores.where(~F.col("base_failed")).join(known, "doc_id").select(
        "stratum", "good", F.array(*[F.col(r).cast("double") for r in names]).alias("scores"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(PLAN_ONE_IN)) == 0).alias("plans")))
    level = error / max(1, held.select("stratum").distinct().count())
    path = materialize(planned(held.where("plans"), rules))
    steps = path.groupBy("stratum").agg(F.collect_list(F.struct("step", "place", "cutoff")).alias("steps"))
    hit = F.filter("steps", lambda e: F.get(F.col("scores"), e["place"]) > e["cutoff"])
    proof = held.where("NOT plans").alias("h").join(steps.alias("s"), F.expr("h.stratum <=> s.stratum")).select(
        "h.stratum", "good", F.array_min(F.transform(hit, lambda e: e["step"])).alias("step"))
    counts = proof.groupBy("stratum", "step").agg(F.count_if("good").alias("good"))
    totals = counts.groupBy("stratum").agg(F.sum("good").alias("n"))
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = path.select("stratum", "step", "rule", "place", "cutoff", F.lit(0).cast("long").alias("good")).unionByName(
        counts.where("step IS NOT NULL"), allowMissingColumns=True)
    tests = every.groupBy("stratum", "step").agg(
        F.sum("good").alias("good"), *[F.max(c).alias(c) for c in ("rule", "place", "cutoff")])
    tests = tests.withColumn("k", F.sum("good").over(so_far)).alias("t").join(
        totals.alias("n"), F.expr("t.stratum <=> n.stratum")).select("t.*", "n.n")
    tests = tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), false_rejections))
    passed = tests.withColumn("worst", F.max("p").over(so_far)).where(F.col("worst") <= level)
    chosen = passed.groupBy("stratum", "rule", "place").agg(F.min("cutoff").alias("cutoff"), F.max("step").alias("step"))
    last = passed.groupBy("stratum").agg(F.max_by("p", "step").alias("p_value"))
    cuts = materialize(chosen.alias("c").join(last.alias("l"), F.expr("c.stratum <=> l.stratum")).select("c.*", "l.p_value"))
    over = F.get(F.col("h.scores"), F.col("c.place")) > F.col("c.cutoff")
    return held.alias("h").join(cuts.alias("c"), F.expr("h.stratum <=> c.stratum")).groupBy("c.stratum", "rule", "cutoff").agg(
        F.count_if("good").alias("n_good"), F.count_if(F.col("good") & over).alias("k_good"),
        F.count_if(~F.col("good") & over).alias("k_bad"), F.max("p_value").alias("p_value"))


def planned(held: DataFrame, rules: Sequence[str] | dict[str, list[float]]) -> DataFrame:
    """(stratum, step, rule, place, cutoff): the cutoffs of a stratum in the order to try them.

    Of each rule only cutoffs that gain more than all looser ones enter. They are ordered by
    the good documents they reject for a bad one, never a stricter before a looser of the same
    rule. Scores meet as counts by cutoff, so a stratum has a few hundred rows a rule at most.
    """
    names = list(rules)
    given = rules if isinstance(rules, dict) else {}
    below = F.array(*[_below(F.get(F.col("scores"), i), given.get(r)) for i, r in enumerate(names)])
    counts = held.select("stratum", "good", F.posexplode(below).alias("place", "cutoff")).where("cutoff IS NOT NULL").groupBy(
        "stratum", "place", "cutoff").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    stricter = Window.partitionBy("stratum", "place").orderBy(F.desc("cutoff"))
    upto, looser = (stricter.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    gained = counts.withColumns({"k_good": F.sum("good").over(upto), "k_bad": F.sum("bad").over(upto)}).withColumn(
        "gain", F.col("k_bad") - PRICE * F.col("k_good"))
    records = gained.withColumn("best", F.coalesce(F.max("gain").over(looser), F.lit(0))).where("gain > best AND gain > 0")
    priced = records.withColumn("cost", F.max(F.col("k_good") / F.col("k_bad")).over(upto))
    order = Window.partitionBy("stratum").orderBy("cost", "place", F.desc("cutoff"))
    rule = F.get(F.array(*[F.lit(r) for r in names]), F.col("place"))
    return priced.select("stratum", F.row_number().over(order).alias("step"), rule.alias("rule"), "place", "cutoff")


def _below(score: Column, cutoffs: list[float] | None) -> Column:
    """Largest cutoff below the score, null if there is none."""
    if cutoffs is not None:
        return F.array_max(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: c < score))
    step = F.pow(F.lit(10.0), F.floor(F.log10(score)) - 1)
    return F.when(score > 0, F.round((F.ceil(score / step) - 1) * step, 9))


def wide_cutoffs(chosen: DataFrame, rules: Sequence[str]) -> DataFrame:
    """One row per stratum with a column ``cut_<rule>`` each; broadcast while there are few strata."""
    wide = chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in rules])
    return F.broadcast(wide) if wide.count() <= SMALL_TABLE else wide


def _failed(rules: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in rules]))


def judged(docs: DataFrame, labels: DataFrame, false_rejections: float = 0.01, error: float = 0.05,
           rules: Sequence[str] | dict[str, list[float]] = RULES, key: str = "doc_id", text: str = "text", stratum: str = "lang",
           keep: bool = False) -> DataFrame:
    """``measured`` with ``kept`` and the rules that rejected (``failed_rules``).

    Null texts and texts under ten words fail the base rule. Documents of a null stratum
    form a stratum of their own. Repeated rows are judged alike. With no labels only the
    base rule rejects.
    """
    scores = materialize(measured(docs, key, text, stratum, keep))
    wide = wide_cutoffs(certified_cutoffs(scores, labels, false_rejections, error, rules), rules)
    joined = scores.alias("s").join(wide.alias("c"), F.expr("s.stratum <=> c.stratum"), "left").select("s.*", *[f"c.cut_{r}" for r in rules])
    failed = _failed(rules)
    return joined.select(
        *scores.columns, failed.alias("failed_rules"),
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
    )
