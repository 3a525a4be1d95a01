"""Each registered query over whole small tables against a plain version."""

import hashlib
import zlib

import brute
import numpy as np
import pytest

from wattloom.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").toPandas()


def rows(spark, sf, name):
    return Q.QUERIES[name](spark, sf).toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def test_quality(spark, sf, docs):
    got = rows(spark, sf, "op1_quality_rules")
    want = [brute.quality_counts(t) for t in docs.text]
    assert list(got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False, name=None)) == want
    failed = [w[0] < 10 or 100 * w[4] > 20 * w[0] for w in want]
    assert got.base_failed.tolist() == failed
    assert not (got.kept & got.base_failed).any()


def test_shards(spark, sf, docs):
    got = rows(spark, sf, "op3_rendezvous_shards")
    assert got.text_crc32.tolist() == [brute.crc(t) for t in docs.text]
    assert got["size"].tolist() == [len((t or "").encode()) + 1 for t in docs.text]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 16)).all()


def test_token_counts(spark, sf, docs, tokenizer):
    from tokenizers import Tokenizer

    got = rows(spark, sf, "op6_token_counts")
    model = Tokenizer.from_file(tokenizer)
    want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in docs.text]
    assert got.n_tokens.tolist() == want
    assert got.over_limit.tolist() == [n > 1024 for n in want]


def test_overlap(spark, sf, docs):
    got = rows(spark, sf, "op7_benchmark_overlap")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.overlap(docs.text, items)
    assert list(zip(got.n_words, got.n_hit, got.n_items, got.items_sha256, strict=True)) == [
        (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for n, h, i in want]


def test_classes(spark, sf, docs):
    got = rows(spark, sf, "op8_simhash_classes")
    prints = [(d, brute.fingerprint(t)) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    assert got.fingerprint.tolist() == [f"{p:016x}" for _, p in prints]
    assert got.component_id.tolist() == brute.classes(prints)


def test_secrets(spark, sf, docs):
    got = rows(spark, sf, "op9_secret_spans")
    names = ["assign", "access", "hex"]
    want = [",".join(f"{names[k]}:{s}:{e}" for k, s, e in brute.base_spans(t)) for t in docs.text]
    assert got.base_sha256.tolist() == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    for listed, base in zip(got.spans, want, strict=True):
        assert set(filter(None, base.split(","))) <= set(listed.split(","))


def test_repeats(spark, sf, docs):
    got = rows(spark, sf, "op5_suffix_dedup")
    assert list(zip(got.n_removed, got.n_spans, got.kept_sha256, strict=True)) == brute.without_repeats(docs.text)


def test_packing(spark, sf, docs, tokenizer):
    from tokenizers import Tokenizer

    got = rows(spark, sf, "op10_packed_sequences").sort_values(["doc_id", "piece"])
    model = Tokenizer.from_file(tokenizer)
    for (doc, part), text in zip(got.groupby("doc_id"), docs.text, strict=True):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        assert part.start.tolist() == np.cumsum([0, *part.length])[:-1].tolist() and part.length.sum() == len(ids), doc
        assert (part.length[1:] == 2048).all()
        for p in part.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == np.cumsum([0, *part.length])[:-1].tolist() and part.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = rows(spark, sf, "op2_toxicity")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert got.held_out.tolist() == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]
    held = labels[labels.held_out]
    toxic, clean = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.9
    assert (clean < 0.5).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_licenses(spark, sf, docs):
    got = rows(spark, sf, "op4_license_scan")
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for r, text in zip(got.itertuples(), docs.text, strict=True):
        words = brute.ASCII_WORD.findall((text or "").translate(brute.LOWER))
        places = sorted((i, k) for k, p in phrases.items() for i in range(len(words)) if words[i:i + len(p)] == p)
        assert (r.n_words, r.n_base) == (len(words), len(places))
        if places:
            assert (r.first_word, r.last_word) == (places[0][0], places[-1][0])
        assert r.base_labels == ",".join(sorted({k for _, k in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_lines(spark, sf, docs):
    """Every line that contains a template to the threshold, and no other."""
    from wattloom.llm import licenses as L

    _, lines = L.license_scan(spark.read.parquet(f"{sf}/documents.parquet"))
    got = lines.groupBy("template").count().toPandas().set_index("template")["count"].to_dict()
    want = {}
    for number, (_, template) in enumerate(L.TEMPLATES):
        words = set(L.tokens(template))
        for text in docs.text:
            for line in (text or "").split("\n"):
                if len(words & set(L.tokens(line))) >= L.CONTAINMENT * len(words):
                    want[number] = want.get(number, 0) + 1
    assert got == want
