"""Connected components of an edge table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize



def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round lets every node hand its larger neighbours, then its smaller ones, to its
    smallest neighbour. The smallest neighbour comes from an aggregate with partial sums,
    so a node with very many neighbours is no task of its own. Each round is a written
    table; rounds end when one changes nothing, after about log² of the longest path.
    """
    edges = materialize(_ordered(edges))
    print_of = _fingerprint(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        now = _fingerprint(edges)
        if now == print_of:
            break
        print_of = now
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    larger = edges.join(least, "a")  # a < b, so b is the larger neighbour of a
    return larger.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a < b: b's smaller neighbours and b itself go to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    smaller = edges.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.union(least.select(F.col("m").alias("a"), "b")).distinct()
