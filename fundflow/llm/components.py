"""Connected components of a graph of links, by alternating large and small stars.

Every node is told of the smallest node it can reach in a number of rounds
that grows with the logarithm of the longest path.  Minima are aggregated
before they are shuffled and joined back by plain equi-joins, which adaptive
execution splits at a node with very many links; each round's links are
written to the shared folder, so lineage stays short and no executor's loss
undoes more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fundflow.session import scratch_path


def _stored(links: DataFrame) -> tuple[DataFrame, tuple]:
    spark = links.sparkSession
    path = scratch_path(spark, "links")
    links.write.parquet(path)
    links = spark.read.parquet(path)
    mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return links, (mark["n"], mark["h"])


def large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return (both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct())


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    passed = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a smaller node in its component; ``links`` are (a, b) longs."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, mark = _stored(links)
    while mark[0]:
        links, new = _stored(small_star(large_star(links)))
        if new == mark:
            break
        mark = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
