"""Connected components by alternating star contraction, on edges of ids of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id of ``edges`` (src, dst) that has another one: the least id of its component, itself included.

    Each round links every id's larger neighbours, then its smaller ones, to the least neighbour known (large-star
    and small-star), which needs O(log^2 n) rounds. The edges are checkpointed each round and get fewer. Nothing is
    dropped after ``rounds`` rounds: edges that haven't settled by then raise an error.
    """
    e = checkpoint(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpoint(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    member = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return member.unionByName(member.select(F.col("root").alias("id"), "root").distinct())
