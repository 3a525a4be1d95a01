"""Documents to training sequences: quality, near duplicates, benchmark overlap, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and
read again as the next one's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import drop_tables, noting
from wattloom.llm.decontaminate import clean_documents
from wattloom.llm.packing import pack_documents
from wattloom.llm.quality_rules import judged
from wattloom.llm.queries import prepared, table, tokenizer_path
from wattloom.llm.secrets import without_secrets
from wattloom.llm.simhash import one_of_each
from wattloom.session import materialize


#: Tables that the stage before wrote on its way, by application; no other query's tables are among them.
_TABLES: dict[str, list[str]] = {}


def stage(fn):
    """A stage begins when the one before has been written, so that one's own tables can go.

    What ``docs`` itself still reads stays. So hold no unwritten result of a stage while the next begins.
    """

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables = _TABLES.setdefault(spark.sparkContext.applicationId, [])
        drop_tables(spark, tables, keep=docs)
        with noting(tables):
            return fn(prepared(spark), docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs.

    Null and empty texts have no words and go; repeated rows are judged each.
    """
    return judged(docs, table(spark, sf_dir, "labels"), keep=True).where(F.col("kept")).select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates (five-word shingles, similarity 0.8).

    Null, empty and word-free texts are one class; of rows of equal id and text one stays.
    """
    return one_of_each(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark; null and empty texts and repeated rows stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; null and empty texts and repeated rows as they are."""
    return without_secrets(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of at most 2048 tokens.

    Null and empty texts are the separator alone; repeated rows are packed each.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: XXH64 fingerprints and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(prepared(spark), sf_dir, "documents")
    for _, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir))
    return docs
