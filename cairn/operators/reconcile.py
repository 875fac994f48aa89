"""Field-by-field merging of existing and incoming metadata; header values, signals, replies."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import rules, text
from cairn.functions.dialect import Dialect, add, case

DEPRECATED = ("deprecated", "retired", "superseded")
MARKERS = ("ARTIFACT_META", "x-meta", "CAIRN_META")


def parts_of(x: str, d: Dialect) -> str:
    """The trimmed parts of a comma-separated text, without empty ones; none where the whole text is Unknown."""
    return d.keep(d.each(d.split(f"coalesce(nullif({x}, 'Unknown'), '')", ","), "p", "trim(p)"), "p", "p <> ''")


def union(a: str, b: str, d: Dialect) -> str:
    """Of two comma-separated lists, first come first; Unknown where both are empty."""
    every = f"list_concat({parts_of(a, d)}, {parts_of(b, d)})" if d.duck else f"array_distinct(concat({parts_of(a, d)}, {parts_of(b, d)}))"
    if d.duck:
        every = f"list_transform([{every}], lambda w: list_filter(w, lambda x, i: list_position(w, x) = i))[1]"
    return f"coalesce(nullif({d.join(every, ', ')}, ''), 'Unknown')"


def deprecation(d: Dialect) -> dict[str, str]:
    """deprecated: an explicit mark, a successor, or a status that says so."""
    return {"deprecated": f"coalesce(mark = 'true', false) OR coalesce(nullif(superseded_by, 'Unknown'), '') <> '' OR coalesce({d.isin('lower(status)', DEPRECATED)}, false)"}


def better(old: str, new: str, d: Dialect) -> str:
    """The new value is good, and the old one isn't or is a sixth shorter in JSON (two quotes count)."""
    json_length = lambda x: f"(length({x}) + 2)"
    return f"({text.good_value(new, d)} AND (NOT {text.good_value(old, d)} OR {json_length(new)} > 1.2 * {json_length(old)}))"


def action(d: Dialect) -> dict[str, str]:
    """action, merged value and reason of (field, old, new, has_old, deprecated) rows."""
    lists = d.isin("field", rules.UNION_FIELDS)
    joined = union("old", "new", d)
    good = better("old", "new", d)
    return {
        "action": case([("NOT has_old", "'add'"), (f"{lists} AND {joined} = old", "'keep'"), (lists, "'append-union'"), ("deprecated", "'replace'"), (good, "'revise'")], "'keep'"),
        "merged": case([("NOT has_old", "new"), (lists, joined), (f"deprecated OR {good}", "new")], "old"),
    }


def explained(d: Dialect) -> dict[str, str]:
    return {"reason": case([("action = 'add'", "'new field'"), ("action = 'append-union'", "'list grew'"), ("action = 'replace'", "'old record is deprecated'"), ("action = 'revise'", "'new value says more'"), (d.isin("field", rules.UNION_FIELDS), "'list as it was'")], "'old value is good enough'")}


def reconcile(fields: DataFrame) -> DataFrame:
    """Adds action, merged and reason to rows of one field each."""
    return add(fields, action, explained)


def reconcile_with(fields: DataFrame, decide: Callable[[object, object], object] | None = None, decided: tuple[str, ...] = ("description",)) -> DataFrame:
    """As ``reconcile``, but ``decide`` (a pandas function of old and new values to truth or null) settles these fields.

    A null reply, or no function, leaves the heuristic's decision; path says which it was.
    """
    out = reconcile(fields)
    if decide is None:
        return out.withColumn("path", F.lit("heuristic"))
    ask = F.pandas_udf(decide, "boolean")
    open_ = F.col("field").isin(*decided) & F.col("action").isin("revise", "keep") & F.expr(text.good_value("new", _spark()) + " AND " + text.good_value("old", _spark()))
    reply = F.when(open_, ask("old", "new"))
    out = out.withColumn("reply", reply)
    settled = F.col("reply").isNotNull()
    return out.select(
        *(c for c in out.columns if c not in ("action", "merged", "reply")),
        F.when(settled, F.when(F.col("reply"), "revise").otherwise("keep")).otherwise(F.col("action")).alias("action"),
        F.when(settled, F.when(F.col("reply"), F.col("new")).otherwise(F.col("old"))).otherwise(F.col("merged")).alias("merged"),
        F.when(settled, "adapter").when(open_, "adapter_failed").otherwise("heuristic").alias("path"),
    )


def _spark() -> Dialect:
    from cairn.functions.dialect import SPARK

    return SPARK


def diff_log(changes: DataFrame, key: str = "path") -> DataFrame:
    """One text for each path: its field changes in order of field."""
    line = F.concat(F.lit("- field: "), "field", F.lit("\n  action: "), "action", F.lit("\n  old: "), F.coalesce("old", F.lit("null")), F.lit("\n  new: "), F.coalesce("new", F.lit("null")))
    return changes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))


def use_when(x: str, d: Dialect) -> str:
    return d.m(x, r"(?i)\buse when\b")


def skills(d: Dialect) -> dict[str, str]:
    """What a skill entry point's description lacks, and whether the proposed one would replace it."""
    good_old, good_new = text.good_value("description", d), text.good_value("proposal", d)
    gain = f"({use_when('proposal', d)} AND NOT coalesce({use_when('description', d)}, false))"
    longer = "(length(proposal) + 2 > 1.2 * (length(description) + 2))"
    return {
        "state": case([("description IS NULL", "'missing'"), (f"NOT {good_old}", "'weak'"), (f"NOT {use_when('description', d)}", "'no trigger'")], "'good'"),
        "revise": f"{good_new} AND (NOT {good_old} OR {gain} OR {longer}) AND proposal <> coalesce(description, '')",
    }


def signal_list(d: Dialect) -> dict[str, str]:
    return {"parsed": d.keep(d.each(d.split("raw", "[,;\n]"), "p", "trim(p)"), "p", "p <> ''")}


def materiality(d: Dialect) -> dict[str, str]:
    """The question whether one value says more than another, and what a reply means."""
    nl = d.char(10)
    return {"question": f"'Field: ' || field || {nl} || 'A: ' || old || {nl} || 'B: ' || new || {nl} || 'Does B say more than A? Answer yes or no.'", "verdict": f"coalesce({d.starts('lower(trim(reply))', 'yes')}, false)"}


def assist_prompt(d: Dialect) -> dict[str, str]:
    """The question for a missing description; the body is cut at 1200 characters."""
    nl = d.char(10)
    cut = f"CASE WHEN length(body) > 1200 THEN substring(body, 1, 1200) || {nl} || '[truncated]' ELSE body END"
    return {"prompt": f"'Say in one sentence of at most 20 words what this does:' || {nl} || {cut} || {nl} || 'Description:'"}


def authority_evidence(files: DataFrame, writer: str = "inject|verify", tool: str = "cairn", max_bytes: int = 1 << 20, markers: tuple[str, ...] = MARKERS, repository: str = "own/cairn") -> DataFrame:
    """path, kind, rule, line, excerpt: traces of metadata writers in (path, body, base, suspicious_name) control files.

    The tool's own call is its name, or its repository pinned to a commit. Of each kind and rule a path has one row, for the first match; each of the ``markers``, taken literally, is a rule
    of its own and counts in files that hold a write signal. Files over ``max_bytes`` or with NUL or
    replacement characters give a row of kind gap.
    """
    write = r"(?i)(writeFile(Sync)?|write_(text|bytes)\s*\(|fs\.write|yaml\.safe_dump|json\.dump|open\s*\([^)]*[\"']w|>\s*[^\n]*meta)"
    kinds = [
        ("canonical_invocation", "canonical-invocation", rf"(?im){re.escape(repository)}@[0-9a-f]{{40}}|(^|[\s`\"]){tool}([\s`\"/:]|$)", None),
        ("writer_invocation", "writer-invocation", rf"(?im)(^|[\s`\"])((python3?|node|bash|sh)\s+)?(\./)?[^\s`\"]*({writer})[-_]?meta[^\s`\"]*", None),
        ("writer_script", "writer-name-with-write", write, "suspicious_name"),
        *(("legacy_marker", "marker-" + m.lower().replace("_", "-"), re.escape(m), f"rlike(body, {_spark().q(write)})") for m in markers),
    ]
    bad = F.expr(f"octet_length(body) > {max_bytes} OR instr(body, char(0)) > 0 OR instr(body, char(65533)) > 0")
    found = []
    for kind, rule, pattern, also in kinds:
        at = F.expr(f"regexp_instr(body, {_spark().q(pattern)})")
        ok = (at > 0) & ~bad & (F.expr(also) if also else F.lit(True))
        found.append(F.when(ok, F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), at.alias("at"))))
    found.append(F.when(bad, F.struct(F.lit("gap").alias("kind"), F.lit("unreadable").alias("rule"), F.lit(1).alias("at"))))
    rows = files.select("path", "body", F.explode(F.array_compact(F.array(*found))).alias("e")).select("path", "body", "e.*")
    before = F.expr("substring(body, 1, at - 1)")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    tail = F.expr("substring_index(substring(body, at), char(10), 1)")
    head = F.expr("substring_index(substring(body, 1, at - 1), char(10), -1)")
    return rows.select("path", "kind", "rule", line.alias("line"), F.substring(F.trim(F.concat(head, tail)), 1, 240).alias("excerpt"))


def authority_gaps(entries: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """path, kind, rule, line, excerpt of what a scan of the control files of (path, kind, size_bytes, error) can't see.

    Links that would be control files, as they aren't followed; control files that can't be read or are too large; folders
    that can't be listed.
    """
    from cairn.operators import policy
    from cairn.operators.classify import PARTS

    df = add(entries, *PARTS, policy.authority_candidate)
    why = F.when((F.col("kind") == "symlink") & F.col("authority_candidate"), "link").when((F.col("kind") == "directory") & F.col("error").isNotNull(), "unlisted")
    why = why.when((F.col("kind") == "file") & F.col("authority_candidate") & (F.col("error").isNotNull() | (F.col("size_bytes") > max_bytes)), "unreadable")
    return df.withColumn("rule", why).where("rule IS NOT NULL").select("path", F.lit("gap").alias("kind"), "rule", F.lit(1).alias("line"), F.coalesce("error", F.lit("")).alias("excerpt"))


def conflicts(evidence: DataFrame) -> DataFrame:
    """Evidence that stands in the way of writing, with a code; the canonical tool's own calls don't."""
    code = F.when(F.col("kind") == "gap", "SCAN_INCOMPLETE").when(F.col("kind") == "legacy_marker", "LEGACY_METADATA_PRESENT").otherwise("AUTHORITY_CONFLICT")
    return evidence.where("kind <> 'canonical_invocation'").withColumn("code", code)
