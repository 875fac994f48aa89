"""Header records: the flat header of each kind of artifact, the nine-plane record, inventory rows, user schemas."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths, rules, text
from cairn.functions.dialect import SPARK, Cols, Dialect, add, case

from .classify import PARTS, TYPE_STEPS, coarse, inventory, mime, semantic, strategy, taxonomy, unknowns
from .policy import placement

AUTHORITY, DETECTED = "repository", "Unknown"
GENERATOR, SCHEMA_VERSION = "cairn", "3.0.0"
HASH_MAX_BYTES = 50 << 20
BASE = ("id", "title", "artifact_type", "mcp_primitive", "callable", "retrievable", "injectable", "namespace", "sharing_scope", "source_path", "content_hash", "token_cost_estimate", "authority", "created_or_detected_at")
VARIANT = ("family", "description", "input_contract", "output_contract", "role", "objective", "output_format", "model_target", "governs", "decision_drivers", "applies_to_domains", "owner")
LISTS = ("activation_signals", "validation_gates", "stop_conditions", "input_variables", "constraints", "phase_model")


def begin(d: Dialect) -> dict[str, str]:
    return {"raw": "body"}


def take_clean(d: Dialect) -> dict[str, str]:
    return {"body": "clean_body"}


def rest(d: Dialect) -> dict[str, str]:
    return {"rest": "body"}


def header(authority: str = AUTHORITY, detected: str = DETECTED) -> Cols:
    """The base fields; those of the kind of artifact, 'Unknown' (an empty list) where it has them but the text doesn't
    say; null where that kind has no such field."""

    def cols(d: Dialect) -> dict[str, str]:
        plain, prompt = "artifact_type IN ('test', 'script', 'source')", "artifact_type = 'prompt'"
        run = f"NOT ({plain} OR artifact_type = 'doctrine')"
        some = lambda cond, x: f"CASE WHEN {cond} THEN coalesce({x}, 'Unknown') END"
        none = "[]::VARCHAR[]" if d.duck else "CAST(array() AS ARRAY<STRING>)"
        many = lambda cond, x: f"CASE WHEN {cond} THEN coalesce({x}, {none}) END"
        return {
            "id": "header_id", "retrievable": "injectable", "source_path": "path", "token_cost_estimate": "token_estimate", "authority": d.q(authority), "created_or_detected_at": d.q(detected),
            "h_family": some(run, "family"), "description": some(run, "NULL"), "input_contract": some(run, "NULL"), "output_contract": some(run, "NULL"),
            "h_role": some(prompt, "role"), "h_objective": some(prompt, "objective"), "h_output_format": some(prompt, "output_format"), "h_model_target": some(prompt, "model_target"),
            "governs": some("artifact_type = 'doctrine'", "NULL"), "decision_drivers": some("artifact_type = 'doctrine'", "NULL"), "applies_to_domains": some("artifact_type = 'doctrine'", "NULL"), "owner": some(plain, "NULL"),
            "activation_signals": many(run, "signals"), "h_validation_gates": many(run, "validation_gates"), "h_stop_conditions": many(run, "stop_conditions"),
            "h_input_variables": many(prompt, "input_variables"), "h_constraints": many(prompt, "constraints"), "h_phase_model": many(prompt, "phase_model"),
        }

    return cols


CLEAN = text.clean(rules.FRONTMATTER, tuple(rules.LINE_COMMENTS), tuple(rules.BLOCK_COMMENTS))
#: From (path, body) to header columns: the body is taken without its header first.
META_STEPS: list[Cols] = [*PARTS, begin, text.split_header, strategy, CLEAN, take_clean, *TYPE_STEPS, taxonomy, rest, text.extract_fields, text.content_hash, text.token_estimate, paths.stem, paths.title, paths.folder, paths.scope(), paths.namespace(), paths.header_id, header()]
HEADER_SCALARS = [*BASE, "h_family", "description", "input_contract", "output_contract", "h_role", "h_objective", "h_output_format", "h_model_target", "governs", "decision_drivers", "applies_to_domains", "owner"]
HEADER_LISTS = ["activation_signals", "h_validation_gates", "h_stop_conditions", "h_input_variables", "h_constraints", "h_phase_model"]


def yaml_inner(d: Dialect) -> dict[str, str]:
    out = text.header_lines(HEADER_SCALARS, HEADER_LISTS)(d)["yaml_inner"]
    return {"yaml_inner": out.replace("'h_", "'")}


HEADER_STEPS: list[Cols] = [yaml_inner, text.fenced, text.comment_block, text.injected, text.recovered]


def planes(d: Dialect) -> dict[str, dict[str, str]]:
    """The nine planes and their fields, as expressions over header, semantic and placement columns."""
    unknown = "'Unknown'"
    joined = lambda x: f"coalesce(nullif({d.join(x)}, ''), {unknown})"
    return {
        "identity": {"id": "id", "title": "title", "artifact_type": "artifact_type", "content_hash": "content_hash", "version": unknown},
        "taxonomy": {"family": f"coalesce(h_family, {unknown})", "mcp_primitive": "mcp_primitive", "callable": "callable", "retrievable": "retrievable", "injectable": "injectable"},
        "placement": {"namespace": "namespace", "source_path": "source_path", "output_path": "target_path", "layer": "layer", "sharing_scope": "sharing_scope"},
        "routing": {"advisory": "true", "activation_signals": joined("activation_signals"), "input_contract": f"coalesce(input_contract, {unknown})", "output_contract": f"coalesce(output_contract, {unknown})", "targets": "target_directory"},
        "provenance": {"created_or_detected_at": "created_or_detected_at", "generated_by": f"'{GENERATOR}'", "upstream": unknown, "snapshot_hash": "content_hash"},
        "governance": {"authority": "authority", "status": "'active'", "owner": f"coalesce(owner, {unknown})", "decision_drivers": f"coalesce(decision_drivers, {unknown})"},
        "economics": {"token_cost_estimate": "token_cost_estimate", "size_bytes": "size_bytes"},
        "assurance": {"validation_gates": joined("h_validation_gates"), "stop_conditions": joined("h_stop_conditions")},
        "lineage": {"schema_version": f"'{SCHEMA_VERSION}'", "supersedes": unknown, "chain": unknown},
    }


def flat_planes(d: Dialect) -> dict[str, str]:
    return {f"{p}_{f}": e for p, fields in planes(d).items() for f, e in fields.items()}


def complete(d: Dialect) -> dict[str, str]:
    """complete: every plane is there (a plane of which each field is null isn't)."""
    return {"complete": " AND ".join(f"coalesce({', '.join(d.text(e) for e in fields.values())}) IS NOT NULL" for fields in planes(d).values())}


def build_meta(artifacts: DataFrame) -> DataFrame:
    """Header columns of (path, body) rows."""
    return with_identity(add(artifacts, *META_STEPS))


IDENTITY = {**dict.fromkeys(BASE, "string"), **dict.fromkeys(("callable", "retrievable", "injectable"), "boolean"), "token_cost_estimate": "bigint"}


def with_identity(headers: DataFrame) -> DataFrame:
    """The same rows, or an error where a column of the header's identity is missing or of another type."""
    found = {f.name: f.dataType.simpleString() for f in headers.schema.fields}
    wrong = [f"{k}: {found.get(k, 'missing')} instead of {kind}" for k, kind in IDENTITY.items() if found.get(k) != kind]
    if wrong:
        raise ValueError(f"no header: {'; '.join(wrong)}")
    return headers


def meta_v3(artifacts: DataFrame) -> DataFrame:
    """One struct column for each of the nine planes."""
    df = add(artifacts, *META_STEPS, semantic, placement())
    return df.select("source_path", "semantic_class", "semantic_confidence", *(F.struct(*(F.expr(e).alias(f) for f, e in fields.items())).alias(p) for p, fields in planes(SPARK).items()))


def record(source_system: str = "local", hash_max_bytes: int = HASH_MAX_BYTES, created_at: str = "Unknown", bytes_hash: str | None = None, modified_at: str | None = None) -> Cols:
    """``bytes_hash`` and ``modified_at`` name the columns that have these; without the first, the body is hashed as text."""

    def cols(d: Dialect) -> dict[str, str]:
        skipped = f"NOT is_dir AND size_bytes > {hash_max_bytes}"
        return {
            "artifact_id": f"'inv-' || substring({d.sha('path')}, 1, 16)",
            "source_system": d.q(source_system),
            "extension": "CASE WHEN is_dir THEN NULL ELSE nullif(ext, '') END",
            "content_hash": f"CASE WHEN is_dir OR {skipped} THEN NULL ELSE {bytes_hash or d.sha('body')} END",
            "notes": f"CASE WHEN {skipped} THEN concat_ws(';', nullif(unknowns, ''), 'content_hash_skipped:file_too_large') ELSE unknowns END",
            "created_at": modified_at or d.q(created_at),
        }

    return cols


RECORD_STEPS: list[Cols] = [*PARTS, inventory, unknowns, mime, record()]
RECORD_COLUMNS = ("artifact_id", "source_system", "path", "base", "extension", "inventory_type", "mime_type", "size_bytes", "content_hash", "parent", "depth", "inventory_confidence", "evidence", "notes", "created_at")


def inventory_records(entries: DataFrame, *, source_system: str = "local", hash_max_bytes: int = HASH_MAX_BYTES) -> DataFrame:
    """The inventory row of each file and folder of (path, body, size_bytes, is_dir).

    With a column bytes_hash, files are told apart by their bytes: those that aren't text have no body to hash. A
    column modified_at is the row's date.
    """
    own = {c: c for c in ("bytes_hash", "modified_at") if c in entries.columns}
    return add(entries, *PARTS, inventory, unknowns, mime, record(source_system, hash_max_bytes, **own)).select(*RECORD_COLUMNS)


def inventory_header(d: Dialect) -> dict[str, str]:
    """An inventory row as a header."""
    return {
        "id": "artifact_id", "title": "base", "artifact_type": "'source'", "mcp_primitive": "'resource'", "callable": "false", "retrievable": "true", "injectable": "true", "namespace": "'inventory'",
        "sharing_scope": "'agnostic'", "source_path": "path", "header_hash": "coalesce(content_hash, 'Unknown')", "token_cost_estimate": "0", "authority": "'inventory'", "evidence_text": "coalesce(evidence, 'Unknown')",
    }


@dataclass(frozen=True)
class Field:
    """A field of a user's schema: a source column, a default, or both."""

    name: str
    source: str | None = None
    default: str | None = None
    required: bool = False


def schema_projection(fields: Sequence[Field]) -> Cols:
    """Each field from its source, its default where that is null or empty; missing_required lists what stays empty."""

    def cols(d: Dialect) -> dict[str, str]:
        out: dict[str, str] = {}
        missing = []
        for f in fields:
            x = d.text(f.source) if f.source else "NULL"
            value = x if f.default is None else f"coalesce(nullif({x}, ''), {d.q(f.default)})"
            out[f"m_{f.name}"] = f"CAST({value} AS {'VARCHAR' if d.duck else 'STRING'})"
            if f.required:
                missing.append(f"CASE WHEN coalesce({value}, '') = '' THEN '{f.name}' END")
        out["missing_required"] = d.list(missing) if missing else d.list(["CAST(NULL AS VARCHAR)" if d.duck else "CAST(NULL AS STRING)"])
        return out

    return cols


def csv_row(columns: Sequence[str]) -> Cols:
    """csv: the columns as one line; quotes only round cells that need them."""

    def cols(d: Dialect) -> dict[str, str]:
        q = d.char(34)
        cell = lambda c: f"CASE WHEN {d.m(x := f'coalesce({d.text(c)}, {d.q(str())})', chr(91) + ',' + chr(92) + 'n' + chr(92) + 'x22]')} THEN {q} || replace({x}, {q}, {q} || {q}) || {q} ELSE {x} END"
        return {"csv": " || ',' || ".join(cell(c) for c in columns)}

    return cols


def normalized(d: Dialect) -> dict[str, str]:
    """Text fields of a parsed header with digits or truth words, as what they mean."""
    return {"number": f"CASE WHEN {d.m('trim(value)', '^-?[0-9]+$')} THEN CAST(trim(value) AS BIGINT) END", "truth": case([("value = 'true'", "true"), ("value = 'false'", "false")])}


WANTED = ("h_role", "h_objective", "h_output_format", "h_model_target")


def checks(d: Dialect) -> dict[str, str]:
    """Checks of a planned header."""
    return {
        "header_valid": case([("strategy = 'yaml-frontmatter'", d.starts("injected", "---" + chr(10))), ("strategy IN ('line-comment', 'block-comment')", d.has("injected", text.MARK)), ("strategy = 'sidecar'", "length(yaml_header) > 0")], "false"),
        "body_preserved": f"{d.sha('recovered')} = content_hash",
        "taxonomy_valid": "NOT (callable AND mcp_primitive = 'none')",
        "scope_valid": "NOT (sharing_scope = 'shared' AND namespace NOT IN ('shared', 'core'))",
        "prompt_complete": "artifact_type <> 'prompt' OR (" + " AND ".join(f"{w} <> 'Unknown'" for w in WANTED) + f" AND {d.size('h_input_variables')} > 0)",
    }


def issues(d: Dialect) -> dict[str, str]:
    """issues: what is wrong, in this order."""
    found = [f"CASE WHEN NOT {n} THEN '{n}' END" for n in ("header_valid", "body_preserved", "taxonomy_valid", "scope_valid")]
    found += [f"CASE WHEN artifact_type = 'prompt' AND {w} = 'Unknown' THEN 'prompt:{w[2:]}' END" for w in WANTED]
    found.append(f"CASE WHEN artifact_type = 'prompt' AND {d.size('h_input_variables')} = 0 THEN 'prompt:input_variables' END")
    return {"issues": d.list(found)}


def verify(artifacts: DataFrame) -> DataFrame:
    return add(artifacts, *META_STEPS, *HEADER_STEPS, checks, issues)


def verify_on_disk(planned: DataFrame, entries: DataFrame) -> DataFrame:
    """path, header_present, body_preserved, issues: what a plan wanted against the tree as it is now.

    ``planned`` has path, strategy, content_hash (of the body without header); ``entries`` are the tree's rows, read again.
    A header is looked for where its strategy puts it; the body is got back from the file's own bytes and hashed. A file
    that is gone or isn't text has neither.
    """
    files = entries.where("kind = 'file'").select("path", F.expr("try_validate_utf8(CAST(content AS STRING))").alias("body"))
    there = add(files.where("body IS NOT NULL"), *PARTS, begin, text.split_header, strategy, CLEAN).select("path", "body", "fence_end", F.sha2("clean_body", 256).alias("found_hash"))
    side = files.where(F.col("path").endswith(f".{text.MARK}.yaml") & (F.length(F.trim("body")) > 0)).select(F.expr(f"substring(path, 1, length(path) - {len(text.MARK) + 6})").alias("path"), F.lit(True).alias("side"))
    both = planned.select("path", F.col("strategy").alias("how"), "content_hash").join(there, "path", "left").join(side, "path", "left")
    inside = F.col("body").contains(f">>> {text.MARK} >>>") | F.col("body").contains(f"{text.MARK}:start")
    present = F.coalesce(F.when(F.col("how") == "yaml-frontmatter", F.col("fence_end") > 0).when(F.col("how").isin("line-comment", "block-comment"), inside).otherwise(F.coalesce("side", F.lit(False))), F.lit(False))
    kept = F.coalesce(F.col("found_hash") == F.col("content_hash"), F.lit(False))
    return both.select("path", present.alias("header_present"), kept.alias("body_preserved"), F.array_compact(F.array(F.when(~present, "no header on disk"), F.when(~kept, "body on disk differs"))).alias("issues"))


def injection(d: Dialect) -> dict[str, str]:
    """What an injection would write: its target, the hashes expected and found, whether it changes anything."""
    side = "strategy IN ('sidecar', 'skip-binary')"
    new = f"CASE WHEN {side} THEN yaml_header || {d.char(10)} ELSE injected END"
    return {"target": f"CASE WHEN {side} THEN path || '.{text.MARK}.yaml' ELSE path END", "expected_hash": d.sha(new), "actual_hash": f"CASE WHEN {side} THEN NULL ELSE {d.sha('raw')} END", "would_change": f"CASE WHEN {side} THEN true ELSE raw <> injected END"}
