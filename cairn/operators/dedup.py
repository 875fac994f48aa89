"""Exact and near duplicates, and the first-seen gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.dialect import SPARK
from cairn.functions.text import SHINGLE, shingle_list
from cairn.session import checkpoint, ship

THRESHOLD = 0.9


def duplicate_clusters(records: DataFrame) -> DataFrame:
    """Files of (path, content_hash, size_bytes, is_dir) that share a hash: bytes to win, and the path to keep.

    The keeper is the shortest path, the first in byte order of equals. Folders and rows without a hash take no part.
    One row a hash, whatever the number of its paths: ``members`` gives those, a row each.
    """
    live = records.where("content_hash IS NOT NULL AND NOT is_dir")
    grouped = live.groupBy("content_hash").agg(
        F.count("*").alias("n"), F.min("size_bytes").alias("size"), F.min_by("path", F.struct(F.length("path"), "path")).alias("keeper")
    )
    return grouped.where("n >= 2").select("content_hash", "n", ((F.col("n") - 1) * F.col("size")).alias("wasted_bytes"), "keeper")


def members(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """content_hash, path, keeps of every file of a cluster; a hash that many files have is split by the join's skew handling."""
    live = records.where("content_hash IS NOT NULL AND NOT is_dir").select("content_hash", "path")
    return live.join(clusters.select("content_hash", "keeper"), "content_hash").select("content_hash", "path", (F.col("path") == F.col("keeper")).alias("keeps"))


def recoverable(clusters: DataFrame) -> DataFrame:
    """One row: clusters, and the bytes that keeping one file of each would win."""
    return clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))


def top_clusters(clusters: DataFrame, k: int = 100) -> DataFrame:
    """The k clusters with most to win: a report."""
    return clusters.orderBy(F.desc("wasted_bytes"), F.desc("n"), "content_hash").limit(k)


def exact_twins(records: DataFrame) -> DataFrame:
    """content_hash, n, path: every path whose hash another path has too, a row each."""
    shared = records.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
    return records.select("content_hash", "path").join(shared, "content_hash").select("content_hash", "n", "path")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """path, content_hash, shingles: distinct runs of four words of (path, content_hash, body)."""
    return docs.select("path", "content_hash", F.array_distinct(F.expr(shingle_list(SPARK))).alias("shingles"))


def jaccard(a: str, b: str) -> F.Column:
    """Of two sets in columns; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def rounded(x: F.Column) -> F.Column:
    return F.floor(x * 1000 + 0.5) / 1000


def _similar(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, content_hash, path) of every distinct content with words, and (a, b, sim) of every two nodes with similarity >= threshold.

    A node is a set of shingles; contents of equal sets share it. Grams travel in packed lists (``cairn.llm.ngram_join``),
    contents as two hashes, and bodies not at all.
    """
    from cairn.llm.ngram_join import similar_nodes  # that subpackage may be absent where no one asks for near copies

    ship(docs.sparkSession)
    keys = docs.where("content_hash IS NOT NULL AND body IS NOT NULL").select("content_hash", "path", F.xxhash64("content_hash").alias("doc_id"), F.lower("body").alias("text"))
    nodes, pairs = similar_nodes(keys.select("doc_id", "text"), threshold, SHINGLE, spaced=True)
    every = keys.select("content_hash", "path", "doc_id", F.xxhash64("text").alias("version")).groupBy("content_hash", "doc_id").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"), F.min("version").alias("version"))
    named = every.join(nodes.distinct(), ["doc_id", "version"]).select("node", "content_hash", "path")
    return named, pairs.where(F.col("jaccard") >= threshold).select("a", "b", F.col("jaccard").alias("sim"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path_a < path_b, similarity: pairs of other content with Jaccard similarity of their shingles >= threshold; exact.

    Each distinct content is compared once and stands under one path, the keeper of ``duplicate_clusters``; whose content
    else it is, ``members`` says. Copies aren't expanded into pairs. Shingles are 64-bit hashes, as in the n-gram join that
    finds the pairs of different sets; contents of one set (other white space or case) are pairs of similarity 1. At
    threshold 0 all pairs qualify and are crossed.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    if threshold == 0:
        every = docs.groupBy("content_hash").agg(F.first("body").alias("body"), F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))
        sets = every.select(F.col("content_hash").alias("h"), "path", F.array_distinct(F.expr(shingle_list(SPARK))).alias("s"))
        x, y = (sets.select(*(F.col(c).alias(c + side) for c in sets.columns)) for side in "ab")
        pairs = x.crossJoin(y).where("ha < hb").select(F.col("patha").alias("pa"), F.col("pathb").alias("pb"), jaccard("sa", "sb").alias("sim"))
    else:
        named, found = _similar(docs, threshold)
        named = checkpoint(named)
        x, y = (named.select(F.col("node").alias(side), F.col("content_hash").alias("h" + side), F.col("path").alias("p" + side)) for side in "ab")
        others = found.join(x, "a").join(y, "b").select("pa", "pb", "sim")
        same = x.join(y.withColumnRenamed("b", "a"), "a").where("ha < hb").select("pa", "pb", F.lit(1.0).alias("sim"))
        pairs = others.unionByName(same)
    return pairs.select(F.least("pa", "pb").alias("path_a"), F.greatest("pa", "pb").alias("path_b"), rounded(F.col("sim")).alias("similarity"))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: how many rows ``near_duplicates`` has. Nothing is named; a node of several contents counts for all of them."""
    if threshold == 0:
        return near_duplicates(docs, threshold).agg(F.count("*").alias("near_pairs"))
    named, found = _similar(docs, threshold)
    several = checkpoint(named.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"))
    x, y = (several.select(F.col("node").alias(side), F.col("m").alias("m" + side)) for side in "ab")
    others = found.select("a", "b").join(x, "a", "left").join(y, "b", "left").select((F.coalesce("ma", F.lit(1)) * F.coalesce("mb", F.lit(1))).alias("n"))
    same = several.select(F.expr("m * (m - 1) DIV 2").alias("n"))
    return others.unionByName(same).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("near_pairs"))


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of frames of one row each, side by side in one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def summary(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: all, distinct contents, groups of exact twins, near pairs."""
    n = docs.groupBy("content_hash").agg(F.count("*").alias("n"))
    counts = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_count"), F.count_if(F.col("n") > 1).alias("twin_groups"))
    return one_row(counts, near_pairs(docs, threshold))


def gate(rows: DataFrame, order: str = "seq") -> DataFrame:
    """dedup_status in order of arrival: duplicate (an earlier equal hash), collision (an earlier equal target), unique."""
    by = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(order))
    return rows.withColumn("dedup_status", F.when(by("content_hash") > 1, "duplicate").when(by("output_path") > 1, "collision").otherwise("unique"))
