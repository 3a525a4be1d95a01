"""Operators beyond what the small tables show: long texts, edited copies, wrapped statements."""

import textwrap
from pathlib import Path

import brute
import numpy as np
import pandas as pd

from wattloom.llm import common, decontaminate, licenses, resemblance, simhash, suffix_dedup


def test_one_of_each_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = docs.select("doc_id", "text").orderBy("doc_id").toPandas()
    sets = brute.shingle_sets(table.text)
    assert any(sets[a] != sets[b] for a, b in brute.similar_pairs(sets))
    got = sorted(r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect())
    assert got == brute.one_of_each(table.doc_id, table.text)


def test_one_bucket_of_many_near_copies(spark):
    """Copies with one other word each, chains of copies of copies, and strangers, in parts of a bucket."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.permutation(300)]
    texts = [" ".join([*words[:k], f"x{i}", *words[k + 1:]]) for i, k in enumerate(rng.integers(0, 300, 400))]
    step = list(words)
    for i in range(60):
        step[i * 5 % 300] = f"y{i}"
        texts.append(" ".join(step))
    texts += [" ".join(rng.choice(words, 250)) for _ in range(40)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "rid bigint, doc_id bigint, text string")
    want = brute.one_of_each(range(len(texts)), texts)
    for bucket in (30, 2_000):
        got = resemblance.similar_classes(rows, bucket=bucket).where("rid = first_rid").collect()
        assert sorted(r.rid for r in got) == want


def test_wide_fingerprints_are_majorities():
    """Each bit is that of over half of the shingles; sets of similarity 0.8 differ by their angle's share of the bits."""
    rng = np.random.default_rng(6)
    for n in (1, 4, 255, 256, 700):
        found = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        each = np.array([resemblance.wide_print(found[i:i + 1], 192) for i in range(n)], np.int64)
        assert (resemblance.wide_print(found, 192) == (2 * each.sum(axis=0) > n)).all()
    width, blocks, distance = resemblance.blocks_for(200_000)
    bits, apart, met = -(-width * blocks // 64) * 64, [], []
    for _ in range(300):
        found = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        differ = resemblance.wide_print(found, bits) != resemblance.wide_print(found[:320], bits)
        apart.append(differ[:resemblance.BITS].sum())
        met.append(~differ[:width * blocks].reshape(blocks, width).any(axis=1))
    angle = np.arccos(1.6 / 1.8) / np.pi
    assert max(apart) <= distance and abs(np.mean(apart) / resemblance.BITS - angle) < 0.01
    assert np.mean(met) > 0.95 * (1 - angle) ** width and np.any(met, axis=1).all()


def test_near_copies_come_through_their_fingerprints(spark, monkeypatch):
    """Pairs just at the similarity, from short texts to long ones, are found, and by fingerprints only."""
    rng = np.random.default_rng(7)
    texts = []
    for i, n in enumerate(np.r_[[4] * 60, rng.integers(5, 400, 300)].tolist()):
        words = [f"w{i}x{k}" for k in range(n + 4 + n // 4)]
        texts += [" ".join(words), " ".join(words[:n + 4])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute.one_of_each(range(len(texts)), texts)
    assert len(want) == len(texts) // 2
    kept = lambda: sorted(r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect())
    assert kept() == want
    plan = resemblance.blocks_for
    monkeypatch.setattr(resemblance, "blocks_for", lambda n, share: (*plan(n, share)[:2], -1))
    assert kept() == list(range(len(texts)))


def test_pairs_met_before_or_in_one_class_are_not_looked_at_again():
    """Close pairs below the similarity are in a group of one block, the first they agree in; pairs of one class in none."""
    rng = np.random.default_rng(10)
    width, blocks, distance = resemblance.blocks_for(40_000)
    reach = min(blocks, resemblance.BITS // width)
    prints = []
    for _ in range(40):
        both, own = rng.integers(0, 1 << 64, 330, dtype=np.uint64), rng.integers(0, 1 << 64, (2, 70), dtype=np.uint64)
        prints += [resemblance.wide_print(np.r_[both, mine], resemblance.BITS) for mine in own]
    table = pd.DataFrame(np.array([np.packbits(p, bitorder="little").view("<i8") for p in prints]), columns=resemblance.PRINT)
    cut = np.array(prints)[:, :reach * width].reshape(-1, reach, width) @ (1 << np.arange(width))
    found = []
    for at in range(reach):
        bucket = table.assign(key=cut[:, at], at=at, node=range(80), root=[0.0, 0.0] + [None] * 78)
        for _, b in bucket.groupby("key"):
            groups = resemblance.close_members(b, distance, width)
            found += [(at, *g) for g in groups.groupby("key")["node"].apply(sorted)]
    first = [np.flatnonzero(cut[i] == cut[i + 1])[0] for i in range(2, 80, 2)]
    assert sorted(found) == sorted((at, i, i + 1) for at, i in zip(first, range(2, 80, 2), strict=True))


def test_near_duplicates_write_no_copy_of_the_documents(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 400)) for _ in range(500)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(7, texts[3]), (8, texts[3]), (None, texts[4]), (None, texts[4])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    bytes_of = lambda *folders: sum(f.stat().st_size for d in folders for f in Path(d).glob("*.parquet"))
    written = []
    with common.noting(written):
        kept = simhash.one_of_each(spark.read.parquet(f"{tmp_path}/docs")).collect()
    want = [(i // 2, t) for i, t in enumerate(texts) if i != 4] + [(None, texts[4])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
    assert 0 < bytes_of(*written) < 0.5 * bytes_of(f"{tmp_path}/docs")


def test_repeats_of_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = "".join(chr(97 + c) for c in rng.integers(0, 3, 2500))
    texts = [base, "x" * 99, base[300:1900] + "y" + base[:1200], "z" + base[1:2400]]
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = suffix_dedup.without_repeats(docs).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.without_repeats(texts)


def test_repeats_beyond_sixteen_mebibytes(spark):
    letters = np.random.default_rng(9).integers(97, 123, (1 << 24) + 2000, np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, letters + letters[:2000])], "doc_id bigint, text string")
    got = suffix_dedup.without_repeats(docs).collect()[0]
    assert (got.n_removed, got.n_spans) == (2000, 1)


def test_wrapped_license_statements(spark):
    """Each statement wrapped, alone on its lines with comment marks; its words far apart are none."""
    rows = [(i, label, "first words of a file\n * " + "\n * ".join(textwrap.wrap(t, width)) + "\n * and more")
            for width in (40, 72, 79) for i, (label, t) in enumerate(licenses.TEMPLATES)]
    apart = "\n".join(w + " filler" * 40 for w in licenses.TEMPLATES[1][1].split())
    docs = spark.createDataFrame([*rows, (99, "", apart)], "doc_id int, want string, text string")
    got, _ = licenses.license_scan(docs)
    found = got.select("doc_id", "labels", "score").collect()
    for r in found:
        if r.doc_id == 99:
            assert (r.labels, r.score) == ("", 0.0)
        else:
            assert licenses.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == 1.0
    assert len(found) == len(rows) + 1


def test_proximity_needs_all_words(spark):
    texts = ["five one x two four three one", "one two three five four x y z", "zig zag one two three four one five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one two three four five one")], "item_id bigint, text string")
    rows = decontaminate.counted(docs)
    phrases = decontaminate.phrases_of(items)
    index, places = decontaminate.postings(rows, phrases)
    got = decontaminate.proximity_matches(index, places, phrases, 7).join(rows, "rid").select("doc_id", "first_pos", "last_pos").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 6), (2, 2, 7)]
