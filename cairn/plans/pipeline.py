"""The whole run over a relation of artifacts: classify, describe, decide, plan, verify; one row for each artifact."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.dialect import Cols, add, settle
from cairn.operators import classify, dedup, discovery, ledger, meta, policy, reconcile, skills
from cairn.session import checkpoint
from cairn.sinks import files, reports
from cairn.sources import archives, control, tree

#: Folders that have a row in the ledger and aren't entered.
CLOSED = ".git,node_modules"


def steps(inline_allow: tuple[str, ...] = (), omit: tuple[str, ...] = ()) -> list[Cols]:
    return [*meta.META_STEPS, classify.semantic, policy.placement(), policy.omit(omit), policy.disposition(omit), policy.carrier(inline_allow), *meta.HEADER_STEPS, meta.checks, meta.issues, meta.injection]


REPORT = ("path", "disposition", "artifact_type", "confidence", "semantic_class", "id", "content_hash", "token_estimate", "carrier", "target_path", "strategy", "expected_hash", "would_change", "fate")


def report(artifacts: DataFrame, inline_allow: tuple[str, ...] = (), omit: tuple[str, ...] = ()) -> DataFrame:
    """One row for each artifact; fate says whether it gets a header, and if not why."""
    return add(artifacts, *steps(inline_allow, omit), fate)


def fate(d) -> dict[str, str]:
    return {"fate": f"CASE WHEN disposition <> 'eligible' THEN disposition WHEN strategy = 'skip-binary' THEN 'binary' WHEN NOT injectable THEN 'non_injectable' WHEN {d.size('issues')} > 0 THEN 'issues' ELSE 'clean' END"}


def inventory(spark: SparkSession, root: str, out: str, sidecars: bool = False) -> DataFrame:
    """Records of a real tree, with its manifests under ``out`` (outside the tree); sidecars lie in the tree, if asked for."""
    rows = meta.inventory_records(tree.artifacts(tree.read_tree(spark, root)))
    folders = rows.withColumn("is_dir", F.col("inventory_type") == "folder")
    files.write_manifests(rows, dedup.duplicate_clusters(folders), out)
    if sidecars:
        reports.write_sidecars(rows, root).write.mode("overwrite").json(f"{out}/sidecars")
    return rows


def index_lines(artifacts: DataFrame, inline_allow: tuple[str, ...] = ()) -> DataFrame:
    df = add(artifacts, *meta.META_STEPS, policy.carrier(inline_allow))
    names = ("id", "title", "namespace", "sharing_scope", "token_cost_estimate")
    return ledger.canonical_lines(ledger.index_rows(df.select("path", "artifact_type", "content_hash", *names, "carrier")), names)


def entries(spark: SparkSession, root: str) -> DataFrame:
    return tree.read_tree(spark, root, prune="", closed=CLOSED)


def discover(spark: SparkSession, root: str, omit: tuple[str, ...] = (), omit_file: str | None = None) -> DataFrame:
    """The ledger of a tree, by the patterns given and those of an omit file; one that can't be read stops the run."""
    return discovery.tree_ledger(entries(spark, root), (*omit, *(control.read_omit(os.path.join(root, omit_file)) if omit_file else ())))


def _eligible(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """Body and size of the eligible files; what isn't text in spite of its extension has no body and is left out."""
    read = entries(spark, root).where("kind = 'file'").withColumn("text", F.expr("try_validate_utf8(CAST(content AS STRING))")).where("text IS NOT NULL")
    return read.join(found.where("disposition = 'eligible'").select("path"), "path", "left_semi").select("path", F.col("text").alias("body"), "size_bytes", F.lit(False).alias("is_dir"))


def drift(spark: SparkSession, root: str, inline_allow: tuple[str, ...] = (), omit: tuple[str, ...] = (), look_into_archives: bool = False) -> tuple[DataFrame, dict[str, object]]:
    """path, kind, message of all that an apply would find undone or can't do, in order of path and kind; and the index's state.

    Blocking entries of the ledger, headers to be changed, the index if it isn't as it would be written, and archives,
    which are looked into and never unpacked: a bag, as one path may be in it for several reasons.
    """
    found = discover(spark, root, omit)
    some = _eligible(spark, root, found)
    blocked = discovery.blocking(found).select("path", F.lit("unsupported").alias("kind"), F.concat(F.lit("discovery "), "disposition", F.lit(": "), "reason").alias("message"))
    plans = settle(add(some, *meta.META_STEPS, policy.carrier(inline_allow), *meta.HEADER_STEPS, meta.injection), "carrier = 'inline_managed' AND strategy = 'yaml-frontmatter' AND would_change")
    inline = plans.select("path", F.lit("stale").alias("kind"), F.lit("the header isn't what it should be").alias("message"))
    index = files.write_index(index_lines(some, inline_allow), root, dry_run=True)
    state = [(files.INDEX, "missing" if index["missing"] else "stale", "the index isn't what it should be")] if index["changed"] else []
    out = blocked.unionByName(inline).unionByName(spark.createDataFrame(state, "path string, kind string, message string"))
    if look_into_archives:
        zips = archives.expand(entries(spark, root).where("kind = 'file' AND lower(path) LIKE '%.zip'").select("path", "content"))
        held = zips.groupBy("archive").agg(F.count("member").alias("n"))
        out = out.unionByName(held.select(F.col("archive").alias("path"), F.lit("unsupported").alias("kind"), F.concat(F.lit("archive of "), F.col("n").cast("string"), F.lit(" members, looked into and not unpacked")).alias("message")))
    return out.orderBy(F.concat("path", F.lit(":"), "kind")), index


def _control_files(spark: SparkSession, root: str) -> DataFrame:
    """Text of all files, hidden ones too: control files lie where discovery doesn't enter."""
    read = entries(spark, root).where("kind = 'file'").withColumn("body", F.expr("try_validate_utf8(CAST(content AS STRING))"))
    return read.where("body IS NOT NULL").select("path", "body", "size_bytes", F.lit(False).alias("is_dir"))


def _snapshot(spark: SparkSession, root: str) -> DataFrame:
    return tree.read_tree(spark, root).select("path", "kind", "mode", "size_bytes", F.sha2("content", 256).alias("hash"))


def check(spark: SparkSession, root: str, inline_allow: tuple[str, ...] = (), omit: tuple[str, ...] = (), shown: int = 20, look_into_archives: bool = False) -> dict[str, object]:
    """What an apply would change or couldn't do; the tree is compared with what it was before, as a check must not change it."""
    columns = ("kind", "mode", "size_bytes", "hash")
    before = checkpoint(_snapshot(spark, root))
    rows, index = drift(spark, root, inline_allow, omit, look_into_archives)
    n = rows.count()
    found = [r.asDict() for r in rows.limit(shown).collect()]
    changed = ledger.snapshot_diff(before, _snapshot(spark, root), columns)
    touched = [r["path"] for r in changed.orderBy("path").limit(shown).collect()]
    if touched:
        raise RuntimeError(f"the check changed the tree: {', '.join(touched)}")
    return {"passed": n == 0, "changed": n > 0, "drift": n, "shown": found, "sha256": index["sha256"]}


def _intents(rows: DataFrame, text: str) -> Iterator[files.Intent]:
    for r in rows.orderBy("path").toLocalIterator():
        yield files.Intent(r["path"], r[text].encode(), r["actual_hash"])


def apply(spark: SparkSession, root: str, inline_allow: tuple[str, ...] = (), omit: tuple[str, ...] = ()) -> dict[str, object]:
    """Puts headers into the allowed files as one transaction, looks at them on disk, then writes the index.

    Nothing is written while the tree holds an entry that blocks. Files that aren't UTF-8 are left alone.
    """
    files.recover(root)
    found = discover(spark, root, omit)
    bad = [r["path"] for r in discovery.blocking(found).orderBy("path").limit(10).collect()]
    if bad:
        raise RuntimeError(f"entries that block a run: {', '.join(bad)}")
    df = add(_eligible(spark, root, found), *meta.META_STEPS, policy.carrier(inline_allow), *meta.HEADER_STEPS, meta.injection)
    rows = settle(df, "carrier = 'inline_managed' AND strategy = 'yaml-frontmatter' AND would_change").select("path", "injected", "actual_hash", "strategy", "content_hash")
    planned = [(r["path"], r["strategy"], r["content_hash"]) for r in rows.select("path", "strategy", "content_hash").toLocalIterator()]

    def validate() -> None:
        wrong = meta.verify_on_disk(spark.createDataFrame(planned, "path string, strategy string, content_hash string"), entries(spark, root)).where("size(issues) > 0").orderBy("path").limit(5).collect()
        if wrong:
            raise files.TransactionError("; ".join(f"{r['path']}: {', '.join(r['issues'])}" for r in wrong))

    done = files.commit(root, _intents(rows, "injected"), validate)
    return {"files": len(planned), "transaction": done, **files.write_index(index_lines(_eligible(spark, root, discover(spark, root, omit)), inline_allow), root)}


def improve_skills(spark: SparkSession, root: str, out: str, ask: skills.Ask | None = None, dry_run: bool = True) -> dict[str, object]:
    """The skills mode: better descriptions and signals for skill entry points, with a report under ``out``."""
    found = discovery.tree_ledger(entries(spark, root), protect_skill=False)
    some = _eligible(spark, root, found).where(r"rlike(path, '(?i)(^|/)skill\\.md$')")
    planned = skills.plan(some, ask)
    if not dry_run:
        rows = skills.patched(some, planned).join(some.select("path", F.sha2("body", 256).alias("actual_hash")), "path")
        counts = reports.skills_report(planned, out)
        return {**counts, "transaction": files.commit(root, _intents(rows, "patched"))}
    return reports.skills_report(planned, out)


def write_all(spark: SparkSession, root: str, out: str, inline_allow: tuple[str, ...] = (), omit: tuple[str, ...] = (), threshold: float = dedup.THRESHOLD) -> dict[str, int]:
    """The pipeline mode: tables, reports and coverage of a tree under ``out``; the tree isn't written to."""
    found = discover(spark, root, omit)
    some = _eligible(spark, root, found)
    rows = report(some, inline_allow, omit)
    done = settle(rows, "strategy <> 'skip-binary' AND injectable")
    held = archives.expand(entries(spark, root).where("kind = 'file' AND lower(path) LIKE '%.zip'").select("path", "content"))
    reports.write_tables(done, some, out, threshold, held)
    named = some.select("path", F.sha2("body", 256).alias("content_hash"), "body")
    reports.write_lines(reports.dedup_markdown(dedup.exact_twins(named), dedup.near_duplicates(named, threshold), named.count(), named.select("content_hash").distinct().count()), f"{out}/dedup-report.md")
    surfaces = settle(add(_control_files(spark, root), *classify.PARTS, policy.authority_candidate), "authority_candidate")
    evidence = reconcile.conflicts(reconcile.authority_evidence(surfaces).unionByName(reconcile.authority_gaps(entries(spark, root))))
    evidence.write.mode("overwrite").json(f"{out}/authority-conflicts")
    return reports.write_coverage(found, rows, out)
