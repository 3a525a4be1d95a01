"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import checks
from .decontaminate import contaminated
from .html_text import extracted
from .licenses import license_scan
from .packing import pack_documents
from .quality_rules import judged
from .reverse_search import ranked
from .secrets import listed, scanned
from .sharding import shard_documents
from .simhash import near_duplicates
from .spelling import variants
from .suffix_dedup import without_repeats
from .token_counts import prefix_counts
from .toxicity import fit, scored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return configure(spark)


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(prepared(spark), sf)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary files lie; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base rules and certified cutoffs over all documents."""
    rows = judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@query()
def op3_rendezvous_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen shards of equal weight; ``grown_shard`` with a seventeenth. Keys decide, so
    copies of a text under other keys may lie elsewhere."""
    weights = {shard: 1.0 for shard in range(17)}
    rows = shard_documents(table(spark, sf, "documents"), {k: weights[k] for k in range(16)}, weights)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op8_simhash_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(table(spark, sf, "documents"))


@query(checks.secret_sql())
def op9_secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Base and entropy spans of every text."""
    found = scanned(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query(checks.OVERLAP_SQL)
def op7_benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document inside ten-word windows of the benchmark."""
    rows = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items",
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op10_packed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf, "documents"), tokenizer_path())


@query()
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document by a model of labelled rows outside the held-out fifth."""
    docs = table(spark, sf, "documents")
    return scored(docs, fit(docs, table(spark, sf, "labels")))


@query(checks.license_sql())
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Base phrases and template matches of every document."""
    rows, _ = license_scan(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query()
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts, and how much of each text 1024 tokens hold."""
    rows = prefix_counts(table(spark, sf, "documents"), tokenizer_path(), 1024)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "n_chars_within")


@query()
def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of every text without repeated strings of 100 bytes."""
    return without_repeats(table(spark, sf, "documents"))


@query()
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Near words, form and root of every word of the corpus."""
    return variants(table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query()
def op12_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, sf, "pages"))


@query(checks.SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
