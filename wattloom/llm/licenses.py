"""License statements by an exact set-similarity join of text lines with templates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, pick

#: Label -> phrase whose places are counted.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Fixed values: (label, statement) of well-known licenses.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Share of a template's words that a line, or a run of words across line ends, must have.
CONTAINMENT = 0.8


def _table() -> bytes:
    """Lower-case letters, digits, line ends and all bytes of other letters stay; the rest are spaces."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz\n":
        out[c] = c
    for c in range(26):
        out[65 + c] = 97 + c
    return bytes(out)


_TABLE = _table()


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split()


def least_overlap(size: int, containment: float) -> int:
    """Words a line must share with a template of ``size`` words."""
    return max(1, math.ceil(containment * size - 1e-9))


def run_length(words: int, containment: float) -> int:
    """Words of a run that may hold a statement of ``words`` words, its line ends anywhere."""
    return math.ceil(words / containment - 1e-9)


def most_in_run(places: list[int], words: list[bytes], width: int) -> int:
    """Most distinct words at ``places`` inside one run of ``width`` words."""
    inside, left, most = {}, 0, 0
    for right in places:
        inside[words[right]] = inside.get(words[right], 0) + 1
        while right - places[left] >= width:
            word = words[places[left]]
            inside[word] -= 1
            if not inside[word]:
                del inside[word]
            left += 1
        most = max(most, len(inside))
    return most


def digested(docs: DataFrame, vocabulary: set[str], fewest: int, statements: list[tuple[str, frozenset[bytes], int, int]],
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, written once: n_words, places of the base phrases, which template
    words it has, its lines with at least ``fewest`` of them, as sets of template words, and
    ``runs``, the statements (label, words, need, width) found in a run of words across line ends.

    Words outside the templates can't raise an overlap with one, so lines need no others.
    A statement is looked for only where the whole text has the words it needs.
    """
    rows = pick(docs, doc_id=key, text=text).select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    phrases = {label: tuple(p.encode().split()) for label, p in PHRASES.items()}
    known = {w.encode() for w in vocabulary}
    block = pa.list_(pa.struct([("line", pa.int32()), ("tokens", pa.list_(pa.string()))]))
    types = [pa.int64(), pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())])), pa.list_(pa.string()), block,
             pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))]
    names = ["doc_id", "n_words", "places", "seen", "blocks", "runs"]

    def one(data: bytes | None) -> tuple:
        text = (data or b"").translate(_TABLE)
        words = text.split()
        seen = known.intersection(words)
        places = []
        if b"license" in seen:
            for i, w in enumerate(words):
                if w == b"license":
                    for label, phrase in phrases.items():
                        start = i + 1 - len(phrase)
                        if start >= 0 and tuple(words[start:i + 1]) == phrase:
                            places.append({"at": start, "label": label})
        blocks = []
        if len(seen) >= fewest:
            for number, line in enumerate(text.split(b"\n")):
                shared = seen.intersection(line.split())
                if len(shared) >= fewest:
                    blocks.append({"line": number, "tokens": [w.decode() for w in shared]})
        runs = []
        for label, of_statement, need, width in statements:
            if len(seen & of_statement) >= need:
                most = most_in_run([i for i, w in enumerate(words) if w in of_statement], words, width)
                if most >= need:
                    runs.append({"label": label, "score": most / len(of_statement)})
        return len(words), places, [w.decode() for w in seen], blocks, runs

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), t) for c, t in zip(found, types, strict=True))], names)

    schema = (f"doc_id {kind}, n_words bigint, places array<struct<at:bigint,label:string>>, seen array<string>, "
              "blocks array<struct<line:int,tokens:array<string>>>, runs array<struct<label:string,score:double>>")
    return numbered(rows.mapInArrow(batches, schema))


def template_table(spark: SparkSession, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(template, label, tokens, need): a few rows, fixed by the given templates."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = sorted({w.decode() for w in tokens(text)})
        rows.append((number, label, words, least_overlap(len(words), containment)))
    return spark.createDataFrame(rows, "template int, label string, tokens array<string>, need int")


def matched_blocks(digest: DataFrame, templates: DataFrame) -> DataFrame:
    """(rid, line, template, label, score): every line whose words contain a template's to the threshold.

    Words are put in one order for lines and templates, rarest in the corpus first, by
    counts over all documents. Two sets that share ``need`` words share one among the first
    size - need + 1 of each (prefix), both have ``need`` words (length), and from the place
    where they first meet both have ``need`` words left (position). What passes is compared
    in full. Ranks, like the templates, number no more than the templates' words.
    """
    words = templates.select(F.explode("tokens").alias("token")).distinct()
    counts = digest.select(F.explode("seen").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranks = words.join(counts, "token", "left").select(
        "token", F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "token")).alias("rank"))

    def ordered(rows: DataFrame, *keys: str) -> DataFrame:
        listed = rows.select(*keys, F.explode("tokens").alias("token")).join(F.broadcast(ranks), "token")
        return listed.groupBy(*keys).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))

    of_templates = ordered(templates, "template", "label", "need")
    index = of_templates.select(
        "*", F.posexplode(F.slice("ranks", 1, F.size("ranks") - F.col("need") + 1)).alias("t_pos", "rank"))
    lines = digest.select("rid", F.explode("blocks").alias("b")).select("rid", "b.line", "b.tokens")
    probes = ordered(lines, "rid", "line").select("rid", "line", F.col("ranks").alias("l_ranks"), F.posexplode("ranks").alias("l_pos", "rank"))
    left = lambda ranks, pos: F.size(ranks) - F.col(pos)
    met = probes.join(F.broadcast(index), "rank").where(
        (F.size("l_ranks") >= F.col("need")) & (F.col("l_pos") <= F.size("l_ranks") - F.col("need"))
        & (F.least(left("l_ranks", "l_pos"), left("ranks", "t_pos")) >= F.col("need")))
    shared = F.size(F.array_intersect("l_ranks", "ranks"))
    return met.dropDuplicates(["rid", "line", "template"]).where(shared >= F.col("need")).select(
        "rid", "line", "template", "label", (shared / F.size("ranks")).alias("score"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT,
                 key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per document, and one per matching line: (rid, line, template, label, score).

    The first has rid, doc_id, n_words, n_base, first_word, last_word, base_labels, labels
    and score, the largest containment of a matching line or run of words, or 0. A run is no
    longer than a template by its missing share, and may go across line ends, so wrapped
    statements are found. Null and empty texts have no words; repeated rows are scanned each.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates, containment)
    vocabulary = {w.decode() for _, text_ in templates for w in tokens(text_)} | {"license"}
    fewest = min(least_overlap(len(set(tokens(t))), containment) for _, t in templates)
    worded = [(label, tokens(t)) for label, t in templates]
    statements = [(label, frozenset(w), least_overlap(len(set(w)), containment), run_length(len(w), containment)) for label, w in worded]
    digest = digested(docs, vocabulary, fewest, statements, key, text)
    lines = matched_blocks(digest, table)
    of_docs = lines.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
    at, base = F.transform("places", lambda p: p["at"]), F.array_distinct(F.transform("places", lambda p: p["label"]))
    label_list = lambda x: F.array_join(F.sort_array(x), ",")
    rows = digest.join(of_docs, "rid", "left").select(
        "rid", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        label_list(base).alias("base_labels"),
        label_list(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>")),
                                            F.transform("runs", lambda r: r["label"])))).alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce(F.array_max(F.transform("runs", lambda r: r["score"])), F.lit(0.0))).alias("score"))
    return rows, lines
