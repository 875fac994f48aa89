"""Artifacts made from the ``documents`` table: paths and bodies that follow from the id, for tables without a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.dialect import Dialect, add, case, nest

DIRS = "skills prompts src docs tests scripts _shared/kernels dist docs/decisions schemas .github/workflows config notes/research main/playbooks examples vendor/pkg".split()
EXTS = ".md .txt .py .ts .json .yaml .html .png .d.ts .zzz".split()
STEMS = (("Prompt-Doc", ""), ("doc.skill.item", ""), ("myDoc-", ""), ("CHANGELOG_", ""), ("api.contract.v", ""), ("x", ".test"), ("item ", ""))


def artifact(d: Dialect) -> dict[str, str]:
    """path and body; the size in bytes; no row is a directory."""
    pick = lambda x, values: case([(f"{x} = {i}", v) for i, v in enumerate(values)])
    where = pick("doc_id % 16", [f"'{x}'" for x in DIRS])
    name = pick("doc_id % 7", [f"'{a}' || {d.text('doc_id')} || '{z}'" for a, z in STEMS])
    ext = pick(f"{d.idiv('doc_id', 16)} % 10", [f"'{x}'" for x in EXTS])
    nl, t = d.char(10), "coalesce(text, '')"
    fenced = f"'---' || {nl} || 'id: doc' || {d.text('doc_id')} || {nl} || 'status: active' || {nl} || 'callable: ' || {d.char(34)} || 'true' || {d.char(34)} || {nl} || '---' || {nl} || {t}"
    lines = ["## Role", "Reviewer of plans", "", "## Objective", "Check each step", "", "## Constraints", "- keep it short", "* cite the source", "", "## Output Format", "A table", ""]
    sections = f" || {nl} || ".join(f"'{x}'" for x in lines) + f" || {nl} || {t}"
    return {"path": f"{where} || '/' || {name} || {ext}", "body": pick("doc_id % 5", [t, fenced, sections, f"'| a | b |' || {nl} || {t}", f"'runtime engine sandbox fixture mock policy' || {nl} || {t}"])}


def extent(d: Dialect) -> dict[str, str]:
    return {"size_bytes": d.octets("body"), "is_dir": "false"}


def artifacts(documents: DataFrame) -> DataFrame:
    return add(documents.select("doc_id", "text").where("doc_id IS NOT NULL"), artifact, extent).drop("text")


def entries(documents: DataFrame) -> DataFrame:
    """A tree of the artifacts: links, folders and devices among the files, some unreadable, some with odd bytes."""
    df = artifacts(documents)
    kind = F.expr("CASE WHEN doc_id % 23 = 0 THEN 'symlink' WHEN doc_id % 29 = 0 THEN 'other' WHEN doc_id % 19 = 0 THEN 'directory' ELSE 'file' END")
    path = F.expr("CASE WHEN doc_id % 13 = 0 THEN '.hidden/' || path WHEN doc_id % 17 = 0 THEN 'a/node_modules/' || path WHEN doc_id % 7 = 1 THEN path || '.dat9' ELSE path END")
    lost = F.expr("doc_id % 31 = 0")
    odd = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(X'FF', encode(body, 'UTF-8')) WHEN doc_id % 5 = 0 THEN concat(encode(body, 'UTF-8'), X'00') ELSE encode(body, 'UTF-8') END")
    return df.select("doc_id", path.alias("path"), kind.alias("kind"), "size_bytes", F.when((kind == "file") & ~lost, odd).alias("content"), F.when(lost, "no access").alias("error"))


SQL = f"SELECT * EXCLUDE (text) FROM ({nest('SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL', artifact, extent)})"
