"""Reports and sidecars that a run leaves beside its index: tables by the executors, small texts by the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import MARK
from cairn.operators import dedup, meta

TABLES = ("primitive-library-index", "prompt-library-index", "dedup-twins", "dedup-near", "verification-report", "placement-plan", "meta-v3-index", "archives-expanded")


def write_tables(report: DataFrame, artifacts: DataFrame, out: str, threshold: float = dedup.THRESHOLD, archives: DataFrame | None = None) -> None:
    """The tables of a pipeline run, one folder of JSON lines each, under ``out``.

    ``report`` holds the header, placement and verification columns of the artifacts that got a header.
    """
    prompt = F.col("artifact_type") == "prompt"
    header = ["path", *dict.fromkeys(meta.HEADER_SCALARS + meta.HEADER_LISTS)]
    named = artifacts.select("path", F.sha2("body", 256).alias("content_hash"), "body")
    made = {
        "primitive-library-index": report.where(~prompt & F.col("injectable")).select(*header),
        "prompt-library-index": report.where(prompt).select(*header),
        "dedup-twins": dedup.exact_twins(named),
        "dedup-near": dedup.near_duplicates(named, threshold),
        "verification-report": report.select("path", "header_valid", "body_preserved", "taxonomy_valid", "scope_valid", "prompt_complete", "issues"),
        "placement-plan": report.select("path", "semantic_class", "semantic_confidence", "layer", "target_directory", "target_path", "quarantined"),
        "meta-v3-index": meta.meta_v3(artifacts),
    }
    if archives is not None:
        made["archives-expanded"] = archives.drop("content")
    for name, df in made.items():
        df.write.mode("overwrite").json(f"{out}/{name}")


def coverage(ledger: DataFrame, report: DataFrame) -> DataFrame:
    """One row: what was seen, what gets a header, what doesn't and why. ``report`` has a row for each eligible artifact."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    binary = F.col("strategy") == "skip-binary"
    seen = ledger.agg(F.count("*").alias("entries"), n(F.col("disposition") == "eligible").alias("eligible"))
    done = report.agg(F.count("*").alias("scanned"), n(~binary & F.col("injectable")).alias("injected"), n(binary).alias("skipped_binary"), n(~binary & ~F.col("injectable")).alias("skipped_non_injectable"), n(~binary & F.col("injectable") & (F.size("issues") > 0)).alias("verify_failed"))
    return dedup.one_row(seen, done)


def write_coverage(ledger: DataFrame, report: DataFrame, out: str) -> dict[str, int]:
    """The coverage file, also on a dry run; skipped paths are a table of their own beside it."""
    row = coverage(ledger, report).first().asDict()
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "coverage-report.json").write_text(json.dumps(row, indent=2) + "\n")
    binary = F.col("strategy") == "skip-binary"
    skipped = report.where(binary | ~F.col("injectable")).select("path", F.when(binary, "binary").otherwise("taxonomy_non_injectable").alias("reason"), "artifact_type", "confidence")
    skipped.write.mode("overwrite").json(f"{out}/coverage-skipped")
    return row


def dedup_markdown(twins: DataFrame, near: DataFrame, total: int, unique: int) -> Iterator[str]:
    """Lines of the report of copies: exact ones by hash, near ones most similar first, by path between equals."""
    counts = twins.agg(F.countDistinct("content_hash")).first()[0], near.count()
    yield from ("# Copies", "", f"Scanned: {total}, unique: {unique}, exact groups: {counts[0]}, near pairs: {counts[1]}", "", "## Exact")
    last = None
    for r in twins.orderBy("content_hash", "path").toLocalIterator():
        if r["content_hash"] != last:
            last = r["content_hash"]
            yield f"- `{last[:16]}`"
        yield f"  - {r['path']}"
    yield from ("", "## Near")
    for r in ordered_pairs(near).toLocalIterator():
        yield f"- {r['similarity']}: {r['path_a']}, {r['path_b']}"


def ordered_pairs(near: DataFrame) -> DataFrame:
    return near.orderBy(F.desc("similarity"), "path_a", "path_b")


def write_lines(lines: Iterator[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines)


def _yaml(values: dict[str, object]) -> str:
    text = {True: "true", False: "false", None: "Unknown"}
    shown = ((k, text[v] if v is None or isinstance(v, bool) else str(v) if isinstance(v, int | float) else json.dumps(v, ensure_ascii=False)) for k, v in values.items())
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in shown) + "---\n"


def write_sidecars(records: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """path, target, state of a sidecar for each record of the inventory that takes no header of its own.

    A folder's lies in it and is never written over; a file's and an archive's lie beside it and follow the record. The
    executors write them, as they hold the tree; state: written, same, kept, planned, or the error.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                folder = r["inventory_type"] == "folder"
                target = f"{r['path']}/.{MARK}.yaml" if folder else f"{r['path']}.{MARK}.yaml"
                values = {"id": r["artifact_id"], "title": r["base"], "artifact_type": r["inventory_type"], "source_path": r["path"], "content_hash": r["content_hash"], "confidence": r["inventory_confidence"], "evidence": r["evidence"], "notes": r["notes"], "injectable": r["inventory_type"] not in ("archive", "folder")}
                if r["inventory_type"] == "archive":
                    values |= {"schema": "archive-sidecar/v1", "size_bytes": int(r["size_bytes"])}
                full, text = os.path.join(root, target), _yaml(values)
                try:
                    there = os.path.lexists(full)
                    if there and (folder or os.path.islink(full)):
                        state = "kept"
                    elif there and Path(full).read_text(encoding="utf-8") == text:
                        state = "same"
                    elif dry_run:
                        state = "planned"
                    else:
                        Path(full).write_text(text, encoding="utf-8")
                        state = "written"
                except OSError as e:
                    state = f"sidecar_write_failed: {e}"
                out.append((r["path"], target, state))
            yield pd.DataFrame(out, columns=["path", "target", "state"])

    return records.where(F.col("inventory_type").isin("archive", "folder") | ~F.col("path").rlike(r"(?i)\.(md|markdown)$")).mapInPandas(write, "path string, target string, state string")


def rename_logs(names: DataFrame, dry_run: bool = True) -> DataFrame:
    """path, sidecar, log for names that aren't as they should be; nothing is renamed."""
    when = datetime.now(timezone.utc).isoformat(timespec="milliseconds")
    state = "pending_rename" if dry_run else "sidecar_written"
    log = F.format_string('# normalize.log\noriginal: "%s"\nnormalized: "%s"\ndry_run: ' + str(dry_run).lower() + f'\ntimestamp: "{when}"\nstatus: {state}\n', "base", "normalized_name")
    return names.where("normalized_name <> base").select("path", F.concat("path", F.lit(".normalize.log")).alias("sidecar"), log.alias("log"))


def inject_logs(changes: DataFrame) -> DataFrame:
    """path, sidecar, log of field changes (path, field, action, old, new); a file whose fields are all kept has none."""
    from cairn.operators.reconcile import diff_log

    touched = changes.where("action <> 'keep'").select("path").distinct()
    return diff_log(changes.join(touched, "path", "left_semi")).select("path", F.concat("path", F.lit(".inject.log")).alias("sidecar"), "log")


def skills_report(files: DataFrame, out: str) -> dict[str, int]:
    """Counts of a skills run, and the table of its files."""
    row = files.agg(F.count("*").alias("considered"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged")).first().asDict()
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "skills-report.json").write_text(json.dumps(row, indent=2) + "\n")
    files.write.mode("overwrite").json(f"{out}/skills-files")
    return row
