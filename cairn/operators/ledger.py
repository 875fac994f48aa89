"""Index records, their canonical form and digest; drift, snapshots, coverage; keyed checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, MapType, StructType

from cairn.functions.dialect import settle

SCHEMA = "metadata-index/v1"
VOLATILE = ("absolute_path", "generated_at", "report_path", "run_started_at", "runtime_timestamp")


def index_records(subjects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Subjects with their carrier, joined on path; what is skipped outright has no record."""
    return index_rows(subjects.join(decisions.select("path", "carrier"), "path"))


def index_rows(decided: DataFrame) -> DataFrame:
    """As ``index_records``, of subjects that have their decision in the same row: no join."""
    return settle(decided, "carrier <> 'hard_skip'").select(F.lit(SCHEMA).alias("schema"), *decided.columns)


def canonical(x: F.Column, kind: DataType) -> F.Column:
    """A value in the one form that it has in an index."""
    if isinstance(kind, DoubleType | FloatType):
        lost = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        return F.when(lost, F.raise_error("no number for an index").cast(kind)).otherwise(F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(x)))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(canonical(x[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    return x


def canonical_lines(records: DataFrame, metadata: Sequence[str]) -> DataFrame:
    """path, line: each record as JSON with sorted keys and its nulls; run-dependent keys are refused.

    Keys of maps are sorted too; a negative zero is zero, and a number that is none or has no end stops the run.
    """
    if bad := sorted(set(metadata) & set(VOLATILE)):
        raise ValueError(f"not persistent: {', '.join(bad)}")
    inner = F.struct(*(canonical(F.col(c), records.schema[c].dataType).alias(c) for c in sorted(metadata))).alias("metadata")
    body = F.struct("artifact_type", "carrier", "content_hash", inner, "path", "schema")
    return records.select("path", F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


def digest(lines: DataFrame, levels: int = 3) -> DataFrame:
    """One row: records, and a digest that doesn't depend on partitions: a tree over the paths by their hash.

    A leaf is the digest of the lines, in path order, whose paths' hashes begin alike (``levels`` bytes); a node that of
    its 256 children at most. Sixteen million leaves hold some thousand lines each at ten thousand million lines.
    """
    joined = lambda key, x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, x))), lambda s: s[x]), "\n"), 256)
    each = lines.select("path", F.sha2("line", 256).alias("h"), F.substring(F.sha2("path", 256), 1, 2 * levels).alias("b")).groupBy("b").agg(F.count("*").alias("n"), joined("path", "h").alias("d"))
    for k in range(levels - 1, 0, -1):
        each = each.select("b", "n", "d", F.substring("b", 1, 2 * k).alias("up")).groupBy("up").agg(F.sum("n").alias("n"), joined("b", "d").alias("d")).withColumnRenamed("up", "b")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), joined("b", "d").alias("digest"))


def parity(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """path, in_index, decided: paths for which an index and the decisions don't agree on the carrier, either way.

    Paths that are skipped outright aren't in an index. An empty result is agreement.
    """
    a = records.select("path", F.col("carrier").alias("in_index"))
    b = settle(decisions.select("path", "carrier"), "carrier <> 'hard_skip'").select("path", F.col("carrier").alias("decided"))
    return a.join(b, "path", "full").where("NOT (in_index <=> decided)")


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (path, hash) against what is there: missing or stale."""
    e, a = expected.select("path", F.col("hash").alias("expected_hash")), actual.select("path", F.col("hash").alias("actual_hash"))
    both = e.join(a, "path", "left")
    return both.where("actual_hash IS NULL OR actual_hash <> expected_hash").select("path", F.expr("CASE WHEN actual_hash IS NULL THEN 'missing' ELSE 'stale' END").alias("kind"), "expected_hash", "actual_hash")


def snapshot_diff(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Paths added, removed or changed in any of these columns; nulls are equal to nulls."""
    x = before.select("path", F.struct(*columns).alias("was"), F.lit(True).alias("in_a"))
    y = after.select("path", F.struct(*columns).alias("now"), F.lit(True).alias("in_b"))
    full = x.join(y, "path", "full")
    return full.where("in_a IS NULL OR in_b IS NULL OR NOT (was <=> now)").select("path", F.expr("CASE WHEN in_a IS NULL THEN 'added' WHEN in_b IS NULL THEN 'removed' ELSE 'changed' END").alias("change"))


def coverage_mismatch(subjects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Paths without a decision, and decisions without a path."""
    a, b = subjects.select("path"), decisions.select("path")
    return a.join(b, "path", "left_anti").select("path", F.lit("missing").alias("problem")).unionByName(b.join(a, "path", "left_anti").select("path", F.lit("extra").alias("problem")))


def repeated(rows: DataFrame, key: str = "path") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def intents(plans: DataFrame) -> DataFrame:
    """File changes that an apply would make: only inline plans that change bytes, with the state they expect."""
    return settle(plans, "carrier = 'inline_managed' AND would_change").select("path", F.col("actual_hash").isNotNull().alias("expected_exists"), F.col("actual_hash").alias("expected_state"), F.col("expected_hash").alias("new_hash"))


def manifest_gate(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows of a manifest that lack a required cell, with the cells they lack."""
    empty = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in required]
    return rows.withColumn("lacks", F.array_compact(F.array(*empty))).where(F.size("lacks") > 0)
