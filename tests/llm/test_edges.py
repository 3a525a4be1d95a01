"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import importlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import (
    decontaminate,
    licenses,
    packing,
    quality_rules,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "kept AS it is here"), (2, None), (3, ""), (4, "kept as it is here")], "item_id bigint, text string")


def operators(labels, items, tokenizer):
    return {
        "quality": lambda d: quality_rules.judged(d, labels),
        "toxicity": lambda d: toxicity.scored(d, toxicity.fit(d, labels)),
        "shards": lambda d: sharding.shard_documents(d, {0: 1.0, 1: 2.0}, {0: 1.0, 1: 2.0, 2: 1.0}),
        "licenses": lambda d: licenses.license_scan(d)[0],
        "repeats": suffix_dedup.without_repeats,
        "tokens": lambda d: token_counts.prefix_counts(d, tokenizer, 10),
        "overlap": lambda d: decontaminate.contaminated(d, items),
        "classes": simhash.near_duplicates,
        "secrets": secrets.scanned,
    }


NAMES = ["quality", "toxicity", "shards", "licenses", "repeats", "tokens", "overlap", "classes", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(odd, none_left, labels, items, tokenizer, name):
    op = operators(labels, items, tokenizer)[name]
    got = op(odd).toPandas()
    key = lambda s: sorted(s, key=str)
    ids = [None if v is None or v != v else int(v) for v in got.doc_id]
    assert key(ids) == key([r.doc_id for r in odd.select("doc_id").collect()])
    assert op(none_left).toPandas().empty


def test_empty_benchmark_and_labels(odd, labels, items):
    assert not decontaminate.contaminated(odd, items.where("1 = 0")).toPandas().contaminated.any()
    got = quality_rules.judged(odd, labels.where("1 = 0")).toPandas()
    assert (got.kept == ~got.base_failed).all()
    assert toxicity.scored(odd, toxicity.fit(odd, labels.where("1 = 0"))).toPandas().score.between(0, 1).all()


def test_overlap_of_odd_rows(odd, items):
    got = decontaminate.contaminated(odd, items).where("doc_id IN (1, 2)").toPandas()
    assert got.n_hit.tolist() == [5, 5, 5] and got.n_items.tolist() == [2, 2, 2]


def test_classes_of_odd_rows(odd):
    got = simhash.near_duplicates(odd).toPandas()
    zero = got[got.fingerprint == "0" * 16]
    assert sorted(zero.doc_id) == [3, 4, 5] and set(zero.component_id) == {3}
    assert set(got[got.doc_id.isin([1, 2])].component_id) == {1}


def test_one_of_each_keeps_columns(odd):
    got = simhash.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["1", "3", "None", "6", "7", "8"])


def test_many_close_fingerprints(spark, monkeypatch):
    """Large buckets are searched and divided without losing a link."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(40):
            s ^= 1 << int(rng.integers(0, 64))
            prints.add(s)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(prints)]
    frame = spark.createDataFrame(signed, "fp bigint")
    want = brute.classes(sorted((p, p % (1 << 64)) for (p,) in signed))
    for pair, search in ((64, 20_000), (1, 20_000), (1, 2)):
        monkeypatch.setattr(simhash, "PAIR_BUCKET", pair)
        monkeypatch.setattr(simhash, "SEARCH_BUCKET", search)
        roots = dict(simhash.components(simhash.links(frame)).collect())
        assert [roots.get(p, p) for (p,) in sorted(signed)] == want


def test_repeats_of_odd_rows(spark, odd):
    got = suffix_dedup.without_repeats(odd, keep=True).toPandas().set_index("doc_id")
    assert got.loc[6].n_removed > 100_000 and got.loc[6].n_spans == 1
    assert len(got.loc[6].kept) == got.loc[6].n_bytes - got.loc[6].n_removed
    twice = spark.createDataFrame([(1, "ab" * 200), (1, "ab" * 200), (2, "ab" * 70 + "c")], "doc_id bigint, text string")
    got = suffix_dedup.without_repeats(twice).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [398, 398, 140]


@pytest.mark.parametrize("hot", [0, 20_000])
def test_repeats_by_either_way(spark, hot, monkeypatch):
    rng = np.random.default_rng(5)
    base = "".join(chr(97 + c) for c in rng.integers(0, 3, 3000))
    texts = [base[int(a):int(a) + int(n)] + str(i) for i, (a, n) in enumerate(zip(rng.integers(0, 2500, 40), rng.integers(50, 500, 40), strict=True))]
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 700)
    plain = suffix_dedup.later_strings
    monkeypatch.setattr(suffix_dedup, "later_strings", lambda a, b: plain(a, b, 2000, hot))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.without_repeats(texts)


def test_suffix_order_on_disk():
    from wattloom.llm import induced_sort

    rng = np.random.default_rng(0)
    for trial in range(60):
        text = np.r_[rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 150))), 0]
        if trial % 3 == 0:
            text = np.r_[np.tile(text[:-1], 3), 0]
        places, common = induced_sort.suffix_order(text, memory=256 if trial % 2 else 1 << 26)
        words = text.tolist()
        want = sorted(range(len(words)), key=lambda i: words[i:])
        assert places.tolist() == want
        for a, b, k in zip(want, want[1:], common[1:].tolist(), strict=False):
            same = 0
            while max(a, b) + same < len(words) and words[a + same] == words[b + same]:
                same += 1
            assert k == min(same, induced_sort.CAP)


def test_prefix_counts_match_the_library(tokenizer):
    counts = token_counts.counter(tokenizer)
    library = counts.model.library
    rng = np.random.default_rng(1)
    bits = ["a", "the", " ", "  ", "\n", "<|endoftext|>", "'s", "'ll", "é", "12", "$$", "\r\n", "'", "re", " x", "日本", "=="]
    for _ in range(150):
        text = "".join(rng.choice(bits, int(rng.integers(0, 12))))
        found, total = counts.differences(text)
        want = [len(library.encode(text[:i + 1], add_special_tokens=False).ids) for i in range(len(text))]
        assert np.cumsum(np.frombuffer(found, np.int8)).tolist() == want and total == (want[-1] if want else 0)
        for budget in (0, 1, 3):
            fits = [i + 1 for i, c in enumerate(want) if c <= budget]
            assert token_counts.within(found, budget) == (fits[-1] if fits else 0)


def test_answers_without_encoding(odd, tokenizer):
    stored = token_counts.prefix_counts(odd, tokenizer, 10, keep=True)
    got = token_counts.answered(stored, [5, 10**9], [0, 3]).where("doc_id = 1").collect()[0]
    whole = stored.where("doc_id = 1").collect()[0]
    assert got.chars_within[1] == len("The same text of ten words or more, to be kept as it is here.")
    assert got.tokens_at[0] == 0 and got.chars_within[0] < got.chars_within[1] and whole.n_chars_within >= got.chars_within[0]


def test_binomial_tail(spark):
    rows = spark.createDataFrame([(0, 500), (1, 500), (3, 2000), (0, 1), (60, 5000)], "k bigint, n bigint")
    for r in rows.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        want = 1.0 if r.k >= r.n * 0.01 else brute.binomial_tail(r.k, r.n, 0.01)
        assert r.p == pytest.approx(want, rel=1e-9)


def test_certified_cutoffs(spark):
    """A rule that separates is cut between good and bad; one that hits good documents is not used."""
    n = 8000
    rows = [(i, "en", i % 2 == 0, 0.5 if i % 2 else 0.0, float(i % 3)) for i in range(n)]
    scores = spark.createDataFrame(rows, "doc_id int, stratum string, good boolean, symbol_share double, word_length double").withColumn("base_failed", F.lit(False))
    labels, scores = scores.select("doc_id", F.col("good").cast("int").alias("quality")), scores.drop("good")
    got = quality_rules.certified_cutoffs(scores, labels, 0.02, 0.05, {"symbol_share": [0.0, 0.1, 0.9], "word_length": [0.5]}).collect()
    assert [(r.rule, r.cutoff, r.k_good, r.k_bad) for r in got] == [("symbol_share", 0.1, 0, n // 2)]


def test_shards_follow_weights_and_move_little(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    shares = docs.withColumn("s", sharding.rendezvous(F.col("doc_id"), {0: 1.0, 1: 3.0})).groupBy("s").count().collect()
    assert {r.s: round(r["count"] / 20_000, 1) for r in shares} == {0: 0.2, 1: 0.8} or abs(dict((r.s, r["count"]) for r in shares)[1] / 20_000 - 0.75) < 0.02
    moved = sharding.moved(docs, {0: 1.0, 1: 1.0}, {0: 1.0, 1: 1.0, 2: 1.0})
    assert moved.where("new_shard != 2").count() == 0
    assert abs(moved.count() / 20_000 - 1 / 3) < 0.03


def test_random_windows_and_allow_list(spark):
    text = "key q8Zr2LmX0vTb7KpW4nYc1HdS id 123e4567-e89b-12d3-a456-426614174000 plainwordswithoutanydigitatall 00000000000000000000a"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = secrets.scanned(docs).collect()[0].spans
    assert [(text[s.start:s.end], secrets.KINDS[s.kind]) for s in spans] == [("q8Zr2LmX0vTb7KpW4nYc1HdS", "entropy_base64")]


def test_window_costs_by_brute_force(spark):
    rng = np.random.default_rng(2)
    values = ["".join(rng.choice(list("0123456789abcdefXYZ"), int(rng.integers(20, 60)))) for _ in range(60)]
    limit = secrets.most_cost(3.4)
    docs = spark.createDataFrame([(v,) for v in values], "v string")
    got = docs.select("v", secrets.random_span(F.col("v"), F.lit(limit)).alias("s")).collect()
    for r in got:
        hits = [i for i in range(len(r.v) - 19) if sum(secrets.COSTS[r.v[i:i + 20].count(c)] for c in set(r.v[i:i + 20])) <= limit]
        assert (r.s.first, r.s.last) == ((hits[0], hits[-1] + 20) if hits else (None, None))


def test_masked_texts(odd):
    got = {r.doc_id: r for r in secrets.without_secrets(odd, length="rid").where("doc_id IN (3, 7)").collect()}
    assert got[3].text is None and got[3].rid is None
    assert got[7].text == "Ünïcode ñandú 日本語 👍 text; [secret] and more words to reach ten of them." and got[7].rid == len(got[7].text)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zig b c zag d"), (2, "zig " + "b " * 30 + "zag")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "zag zig")], "item_id bigint, text string")
    rows = decontaminate.counted(docs)
    phrases = decontaminate.phrases_of(items)
    index, places = decontaminate.postings(rows, phrases)
    got = decontaminate.proximity_matches(index, places, phrases, 5).join(rows, "rid").select("doc_id", "first_pos", "last_pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, 3)]


def test_packing_gains_from_exchanges():
    sizes = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    bins = packing.improve([[0, 4], [1, 5], [2, 6], [3, 7]], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(8)) and len(bins) == 3
    assert all(sum(sizes[b]) <= 10 for b in bins)


def test_pack_odd_rows(odd, none_left, tokenizer):
    got = packing.pack_documents(odd, tokenizer).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert len(got[got.doc_id == 2]) == 2 and got[got.doc_id.isin([3, 4])].length.tolist() == [1, 1]
    assert packing.pack_documents(none_left, tokenizer).toPandas().empty


def test_pipeline_stages(spark, sf):
    """Each stage against what it says it does, on the stage's own input."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = docs.toPandas()
    for name, stage in pipeline.STAGES:
        out = importlib.import_module("wattloom.session").materialize(stage(spark, docs, sf))
        after = out.toPandas()
        if name == "quality_rules":
            want = [d for d, t in zip(before.doc_id, before.text, strict=True) if (c := brute.quality_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
            assert set(after.doc_id) <= set(want)
        elif name == "simhash_near_duplicates":
            assert sorted(after.doc_id) == brute.one_of_each(before.doc_id, before.text)
        elif name == "benchmark_decontamination":
            found = brute.overlap(before.text, items)
            assert sorted(after.doc_id) == sorted(d for d, f in zip(before.doc_id, found, strict=True) if not f[1])
        elif name == "secret_scans":
            assert sorted(after.doc_id) == sorted(before.doc_id)
            assert not any(brute.base_spans(t) for t in after.text)
        else:
            assert after.length.sum() > 0 and set(after.doc_id) == set(before.doc_id)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        docs, before = out, after


def test_keys_of_letters_alone_and_names_without_digits(spark):
    key, names = "qWzRtYpLkMnBvCxZsDfGhJkL", "getUserNameFromTheDatabase some/long/path/of/plain_words ParseHTMLDocumentIntoTreeOfNodes plainwordswithoutanydigit"
    docs = spark.createDataFrame([(1, f"{names} {key}"), (2, names), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.scanned(docs).collect()}
    assert got == {1: [(len(names) + 1, len(names) + 1 + len(key))], 2: [], 3: []}


def test_equal_rows_are_packed_in_many_groups(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_GROUP", 300)
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same words again").otherwise(F.concat(F.lit("words of number "), "id")).alias("text"))
    got = packing.pack_documents(docs, tokenizer).toPandas()
    assert len(got) == 3000
    # a sequence's number tells its group, of which there are ten
    of_group = (got["sequence_id"] % 10).value_counts()
    assert len(of_group) == 10 and of_group.max() < 400
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum()[:-1]] and rows["length"].sum() <= 2048
