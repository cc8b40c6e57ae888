"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_tables, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` may repeat; the result does not."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node with an edge.

    ``edges`` has long columns ``u`` and ``v``; loops and repeats are ignored.
    Each round is written to the shared folder, and only a count and a checksum
    come to the driver. Neighbourhoods are never gathered: minima are
    pre-aggregated and joined back, so that a hub is split like any skewed join.
    """
    now = write_table(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = _signature(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        last, now = now, write_table(_small_star(_large_star(now)), "edges")
        drop_tables(last)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
