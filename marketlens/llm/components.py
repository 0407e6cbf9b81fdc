"""Connected components of links, by stars: few rounds, each of aggregations and joins."""

from marketlens.llm.runtime import stored
from pyspark.sql import functions as F


def components(links):
    """(node, label) of every node of `links` (a, b); the label is the smallest node it reaches.

    Each round points all larger neighbours of a node to its smallest one, then all smaller ones.
    A node with very many neighbours is aggregated partially before the shuffle, and the join
    that follows can be split. Every round is a stored table, so a lost executor costs a round.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "links",
    )
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        if _are_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )


def _are_stars(edges):
    """Whether every node points to one node at most, and none that is pointed to does."""
    sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("is_end"))
    sides = sides.unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("is_end"))
    )
    nodes = sides.groupBy("node").agg(F.sum("out").alias("out"), F.max("is_end").alias("is_end"))
    return nodes.filter("out > 1 OR out + is_end > 1").isEmpty()


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("other"))
    return larger.join(least, "a").select(F.col("other").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges):
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    own = least.select("a", F.col("m").alias("b"))
    others = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).filter("a <> b").distinct()
