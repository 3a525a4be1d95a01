"""What several operators share: picking columns, words, arrays bound once, row ids."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Where the tables written just now are noted down; the last entry counts.
_NOTES: list[list[str]] = []


def materialize(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """``session.materialize``; inside ``noting`` the path is noted down."""
    if path is None:
        path = session.fresh_path(df.sparkSession, "llm")
        if _NOTES:
            _NOTES[-1].append(path)
    return session.materialize(df, path, by)


@contextmanager
def noting(paths: list[str]):
    """Tables written inside the block are added to ``paths``; those of others are not."""
    _NOTES.append(paths)
    try:
        yield
    finally:
        _NOTES.pop()


def drop_tables(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Deletes the noted tables, but for those that ``keep`` reads, and takes them off the list."""
    read = {f.rsplit("/", 1)[0].split(":")[-1] for f in keep.inputFiles()} if keep is not None and paths else set()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(paths):
        if not any(place.endswith(path.split(":")[-1].lstrip("/")) for place in read):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            paths.remove(path)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``df`` with only the named columns, ``new=old``, found by exact name.

    The first column of a name counts if there are several; letter case matters, so
    a column ``Text`` beside ``text`` is no ambiguity.
    """
    names = df.columns
    missing = [old for old in wanted.values() if old not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in {names}")
    by_place = df.toDF(*[f"_{i}" for i in range(len(names))])
    return by_place.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in wanted.items()])


def by_place(df: DataFrame, **wanted: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to their places, ``_0`` and on, and the place of each wanted one.

    ``named`` gives the rows back. Names may repeat or differ in letter case only.
    """
    names = df.columns
    missing = [old for old in wanted.values() if old not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in {names}")
    return df.toDF(*[f"_{i}" for i in range(len(names))]), {new: f"_{names.index(old)}" for new, old in wanted.items()}


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``by_place`` under their names again; others are left out."""
    return df.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def with_row(df: DataFrame, **wanted: str) -> DataFrame:
    """``pick`` with the whole original row as the struct ``row``; ``row.*`` gives it back."""
    placed, at = by_place(df, **wanted)
    row = F.struct(*[F.col(f"_{i}").alias(n) for i, n in enumerate(df.columns)]).alias("row")
    return placed.select(row, *[F.col(place).alias(new) for new, place in at.items()])


#: Bits of the map of keys in ``parted``: 131,072 rows of 64 bits at most, whatever the size of the tables.
MAP_BITS = 1 << 23


def parted(rows: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``name`` may be one of ``keys`` and rows whose ``name`` is surely none.

    The keys' hashes fill a map of bounded size that is broadcast and looked into, so only the
    first part needs a join, and the others are not shuffled. With very many keys the map is
    full and all rows are in the first part.
    """
    place = F.pmod(F.xxhash64(name), F.lit(MAP_BITS))
    cell, bit = F.shiftright(place, 6).alias("_cell"), F.pmod(place, F.lit(64)).cast("int")
    held = keys.select(cell, bit.alias("_bit")).distinct()
    cells = held.groupBy("_cell").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    looked = rows.withColumns({"_cell": cell, "_bit": bit}).join(F.broadcast(cells), "_cell", "left")
    hit = F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), F.col("_bit")) == 1
    return looked.where(hit).select(rows.columns), looked.where(~hit).select(rows.columns)


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """``df`` with a unique row number, written once so that every later read sees the same."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, pattern: str = SPACE_WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def removed_length(text: Column, characters: str) -> Column:
    """Number of code points of ``text`` that are one of ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))
