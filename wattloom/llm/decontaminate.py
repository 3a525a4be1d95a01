"""Benchmark decontamination with a positional inverted index of the training tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD, ascii_lower, by_place, let, materialize, named, numbered, parted, pick, words_of

PHRASE = 10
#: The words of a text before its letters A to Z are lowered.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Lists of this many of a phrase's rarest terms are intersected before words are compared.
RAREST = 2



def lower_words(text: Column) -> Column:
    return words_of(ascii_lower(F.coalesce(text, F.lit(""))), ASCII_WORD)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, text, n_words), written once. A null text has no words."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")
    return numbered(pick(docs, doc_id=key, text=text).withColumn("n_words", n))


def phrases_of(items: DataFrame, key: str = "item_id", text: str = "text", length: int = PHRASE) -> DataFrame:
    """(item_id, pid, phrase, n): every distinct window of ``length`` words of each item, words
    joined by spaces; a shorter item is one window, one without words is none. Equal
    phrases share the number pid."""
    listed = pick(items, item_id=key, text=text).select("item_id", lower_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i, length), " "))
    cut = listed.select("item_id", F.explode(F.array_distinct(windows)).alias("phrase")).distinct()
    cut = materialize(cut.withColumn("n", F.size(F.split("phrase", " "))))
    return materialize(cut.join(numbered(cut.select("phrase").distinct(), "pid"), "phrase").select("item_id", "pid", "phrase", "n"))


def postings(rows: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index: (term, rid, pos) for every place of every term that some phrase has, written once.

    Other terms can take part in no match. ``term`` is the word's number in the index;
    the second table returned is (word, term, places).
    """
    terms = materialize(
        phrases.select(F.explode(F.split("phrase", " ")).alias("word")).distinct()
        .withColumn("term", F.monotonically_increasing_id()))
    placed = rows.select("rid", F.posexplode(lower_words(F.col("text"))).alias("pos", "word"))
    index = materialize(placed.join(terms, "word").select("term", "rid", "pos"))
    places = materialize(terms.join(index.groupBy("term").agg(F.count("*").alias("places")), "term", "left")
                         .select("word", "term", F.coalesce("places", F.lit(0)).alias("places")))
    return index, places


def pivots(phrases: DataFrame, places: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(pid, term, offset, needed): the rarest terms of each phrase with their first offset in
    it, and how many of them there are."""
    spread = phrases.select("pid", "phrase").distinct().select("pid", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
    first = spread.groupBy("pid", "word").agg(F.min("offset").alias("offset"))
    by_rarity = Window.partitionBy("pid").orderBy("places", "word")
    ranked = first.join(places, "word").withColumn("rank", F.row_number().over(by_rarity)).where(F.col("rank") <= rarest)
    needed = F.max("rank").over(Window.partitionBy("pid"))
    return materialize(ranked.select("pid", "term", "offset", needed.alias("needed")))


def phrase_matches(rows: DataFrame, index: DataFrame, places: DataFrame, phrases: DataFrame) -> DataFrame:
    """(rid, start, n, pid): all exact matches.

    The lists of a phrase's rarest terms are shifted by their offsets; a start that all of
    them agree on is a candidate. Candidates then meet their document's words, which
    settles the other terms.
    """
    shifted = index.join(pivots(phrases, places), "term").select(
        "rid", (F.col("pos") - F.col("offset")).alias("start"), "pid", "needed")
    agreed = shifted.where("start >= 0").groupBy("rid", "start", "pid", "needed").agg(F.count("*").alias("found")).where("found = needed")
    candidates = agreed.join(phrases.select("pid", "n", "phrase").distinct(), "pid")
    starts = materialize(candidates.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "pid", "phrase")).alias("starts")))
    stands = let(lower_words(F.col("text")), lambda w: F.filter(
        "starts", lambda c: F.array_join(F.slice(w, c["start"] + 1, c["n"]), " ") == c["phrase"]))
    met = parted(rows.select("rid", "text"), starts, "rid")[0].join(starts, "rid").select("rid", F.inline(stands))
    return met.select("rid", "start", "n", "pid")


def proximity_matches(index: DataFrame, places: DataFrame, phrases: DataFrame, slop: int, rarest: int = 3) -> DataFrame:
    """(rid, pid, first_pos, last_pos): stretches of at most ``slop`` words, in any order, with
    all of the phrase's words in them, repeated ones as often; one row per leftmost place.

    Documents with the phrase's ``rarest`` rarest terms in one stretch are candidates; the
    index of all its terms there settles the rest. Frames hold ``slop`` places at most, so
    no list of a common term is gathered.
    """
    def framed(found: DataFrame) -> DataFrame:
        ahead = Window.partitionBy("rid", "pid").orderBy("pos").rangeBetween(Window.currentRow, slop - 1)
        return found.withColumn("seen", F.sort_array(F.collect_list(F.struct("pos", "term")).over(ahead)))

    near = framed(index.join(pivots(phrases, places, rarest), "term").select("rid", "pid", "pos", "term", "needed"))
    candidates = near.where(F.size(F.array_distinct(F.transform("seen", lambda s: s["term"]))) == F.col("needed")).select("rid", "pid").distinct()
    spread = phrases.select("pid", "phrase").distinct().select("pid", F.explode(F.split("phrase", " ")).alias("word"))
    words = spread.groupBy("pid", "word").agg(F.count("*").cast("int").alias("times")).join(places.select("word", "term"), "word", "left")
    whole = words.groupBy("pid").agg(F.collect_list(F.struct("term", "times")).alias("wanted"), F.count("*").alias("kinds"))
    whole = whole.where(F.size("wanted") == F.col("kinds")).select("pid", "wanted")
    met = framed(index.join(words.select("pid", "term"), "term").join(candidates, ["rid", "pid"]).select("rid", "pid", "pos", "term")).join(whole, "pid")
    last = F.transform("wanted", lambda w: F.get(
        F.transform(F.filter("seen", lambda s: s["term"] == w["term"]), lambda s: s["pos"]), w["times"] - 1))
    ends = met.select("rid", "pid", F.col("pos").alias("first_pos"), last.alias("ends")).where(F.forall("ends", lambda e: e.isNotNull()))
    return ends.select("rid", "pid", "first_pos", F.array_max("ends").alias("last_pos")).distinct()


def covered(spans: Column) -> Column:
    """Number of words in the union of (start, n) spans."""
    return F.aggregate(
        F.sort_array(spans), F.struct(F.lit(0).alias("to"), F.lit(0).alias("words")),
        lambda a, s: let(s["start"] + s["n"], lambda end: F.struct(
            F.greatest(a["to"], end).alias("to"),
            (a["words"] + F.greatest(F.lit(0), end - F.greatest(a["to"], s["start"]))).alias("words"))),
    )["words"]


def found_phrases(rows: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text",
                  length: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """All matches in ``rows`` of ``counted``, written once, and the items' phrases."""
    phrases = phrases_of(items, item_key, item_text, length)
    index, places = postings(rows, phrases)
    return materialize(phrase_matches(rows, index, places, phrases)), phrases


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", length: int = PHRASE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    Null and empty texts have no words and no hits. Repeated rows are reported each.
    Items that are equal all count. An empty benchmark contaminates nothing.
    """
    rows = counted(docs, key, text)
    found, phrases = found_phrases(rows, items, item_key, item_text, length)
    hits = found.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    of_items = (
        found.select("rid", "pid").distinct().join(phrases.select("pid", "item_id"), "pid")
        .groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    return (
        rows.select("rid", "doc_id", "n_words")
        .join(hits, "rid", "left").join(of_items, "rid", "left")
        .select(
            "doc_id", "n_words",
            F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.col("spans").isNotNull().alias("contaminated"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text", length: int = PHRASE) -> DataFrame:
    """The rows of ``docs`` without any match, unchanged, repeated rows and other columns too.

    Null and empty texts have no words, so these rows stay; an empty benchmark leaves all rows.
    """
    placed, at = by_place(docs, text=text)
    rows = numbered(placed)
    found, _ = found_phrases(rows.select("rid", F.col(at["text"]).alias("text")), items, item_key, item_text, length)
    dirty = materialize(found.select("rid").distinct())
    maybe, clean = parted(rows, dirty, "rid")
    return named(maybe.join(dirty, "rid", "left_anti").unionByName(clean), docs.columns)
