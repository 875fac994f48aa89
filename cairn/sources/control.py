"""Control documents of a tree, read on the driver and refused when anything about them is off: small files, one each."""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.rules import CONTROL
from cairn.operators.frontmatter import scalar as loose_scalar
from cairn.operators.meta import Field

AUTHORITY = f"{CONTROL}/meta-authority.yaml"
AUTHORITY_SCHEMA = "meta-authority/v1"
CARRIERS = ("central_manifest", "inline_managed")
LEGACY = ("forbidden", "migration_only")
TARGETS = ("file_header", "sidecar", "manifest")
MODES = ("inventory", "check", "apply", "skills", "pipeline")
OLD_MODES = {"scan": "inventory", "verify": "check", "inject": "apply"}


class ControlError(ValueError):
    """A control document that can't be used; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _regular(path: str, label: str, required: bool) -> bool:
    """Whether there is a regular file; links and other entries are refused, and so is a missing one that is required."""
    try:
        mode = os.lstat(path).st_mode
    except (FileNotFoundError, NotADirectoryError):
        if required:
            raise ControlError("missing", f"{label} isn't there: {path}") from None
        return False
    except OSError as e:
        raise ControlError("unreadable", f"{label}: {e}") from e
    if not stat.S_ISREG(mode):
        raise ControlError("not_regular", f"{label} must be a regular file and no link: {path}")
    return True


def _text(path: str, label: str) -> str:
    try:
        with open(path, "rb") as f:
            text = f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ControlError("unreadable", f"{label} can't be read as text: {e}") from e
    if "\0" in text:
        raise ControlError("unreadable", f"{label} holds a NUL character")
    return text.removeprefix("\ufeff")


def read_omit(path: str, required: bool = False) -> tuple[str, ...]:
    """The patterns of an omit file. What can't be read for sure raises, so that nothing is taken in by mistake."""
    if not _regular(path, "omit file", required):
        return ()
    return tuple(p for line in _text(path, "omit file").splitlines() if (p := line.strip()) and not p.startswith("#"))


def _rows(text: str) -> Iterator[tuple[int, int, str]]:
    """(line number, indent, text) of lines that aren't blank, without comments."""
    for k, line in enumerate(text.splitlines(), 1):
        quote, end = "", len(line)
        for i, c in enumerate(line):
            if quote:
                quote = "" if c == quote and line[i - 1] != "\\" else quote
            elif c in "'\"":
                quote = c
            elif c == "#" and (i == 0 or line[i - 1].isspace()):
                end = i
                break
        kept = line[:end].rstrip()
        if kept:
            yield k, len(kept) - len(kept.lstrip(" ")), kept.strip()


def _strict(text: str) -> str:
    """A scalar of an authority document."""
    s = text.strip()
    for q in "\"'":
        if s.startswith(q) or s.endswith(q):
            if len(s) < 2 or s[0] != q or s[-1] != q:
                raise ControlError("invalid", f"a quote isn't closed: {s}")
            try:
                return json.loads(s) if q == '"' else s[1:-1].replace("''", "'")
            except json.JSONDecodeError as e:
                raise ControlError("invalid", f"no quoted text: {s}") from e
    if not s or s[0] in "[]{}&*!>|%@`":
        raise ControlError("invalid", f"no plain text: {s!r}")
    return s


def _items(text: str) -> list[str]:
    """The items of a list in brackets."""
    if not (text.startswith("[") and text.endswith("]")):
        raise ControlError("invalid", f"no list: {text}")
    inner = text[1:-1].strip()
    parts = re.findall(r"""((?:"(?:\\.|[^"\\])*"|'[^']*'|[^,"'])+)(?:,|\Z)""", inner) if inner else []
    if inner and sum(map(len, parts)) + inner.count(",", 0, len(inner)) < len(inner.rstrip(",")):
        raise ControlError("invalid", f"no list: {text}")
    return [_strict(p) for p in parts]


def safe_pattern(p: object) -> bool:
    """A positive pattern on relative paths, that can't leave the tree by any reading."""
    if not isinstance(p, str) or not 0 < len(p) <= 512 or p != p.strip() or p[0] in "/!" or "\\" in p or re.search(r"[\x00-\x1f\x7f]", p):
        return False
    return all(s not in ("", ".", "..") for s in p.split("/"))


@dataclass(frozen=True)
class Authority:
    """Who may write metadata into a tree, and where."""

    repository: str
    ref: str
    default_carrier: str
    legacy_writers: str
    inline_allow: tuple[str, ...] = ()
    validation_commands: tuple[str, ...] = ()


def parse_authority(text: str) -> Authority:
    """A document of one level, with the mapping ``writer``; unknown and repeated keys, tabs and odd indents are refused."""
    found: dict[str, object] = {}
    inside: str | None = None
    for k, indent, line in _rows(text):
        if "\t" in line:
            raise ControlError("invalid", f"a tab in line {k}")
        if indent:
            if indent != 2 or inside is None:
                raise ControlError("invalid", f"odd indent in line {k}")
            if inside == "writer":
                m = re.fullmatch(r"(repository|ref):\s*(.+)", line)
                writer = found["writer"]
                if not m or m[1] in writer:
                    raise ControlError("invalid", f"no writer entry in line {k}")
                writer[m[1]] = _strict(m[2])
            elif line.startswith("- "):
                found[inside].append(_strict(line[2:]))
            else:
                raise ControlError("invalid", f"no list item in line {k}")
            continue
        m = re.fullmatch(r"([A-Za-z_][\w-]*):\s*(.*)", line)
        if not m:
            raise ControlError("invalid", f"no entry in line {k}")
        key, rest = m.groups()
        if key in found:
            raise ControlError("invalid", f"{key} is there twice")
        inside = None
        if key == "writer" and not rest:
            found[key], inside = {}, key
        elif key in ("inline_allow", "validation_commands"):
            found[key], inside = (_items(rest), None) if rest else ([], key)
        elif key in ("schema", "default_carrier", "legacy_writers") and rest:
            found[key] = _strict(rest)
        else:
            raise ControlError("invalid", f"{key} isn't understood in line {k}")
    if found.get("schema") != AUTHORITY_SCHEMA:
        raise ControlError("unsupported_schema", f"not {AUTHORITY_SCHEMA}: {found.get('schema')}")
    writer, allow, commands = found.get("writer", {}), found.get("inline_allow"), found.get("validation_commands", [])
    sound = (
        re.fullmatch(r"[^/\s]+/[^/\s]+", writer.get("repository", "")) and writer.get("ref", "").strip() and found.get("default_carrier") in CARRIERS and found.get("legacy_writers") in LEGACY
        and allow is not None and all(map(safe_pattern, allow)) and all(len(set(x)) == len(x) for x in (allow, commands)) and all(c.strip() for c in commands)
    )
    if not sound:
        raise ControlError("invalid", "the authority document lacks a part or holds one that isn't allowed")
    return Authority(writer["repository"], writer["ref"], found["default_carrier"], found["legacy_writers"], tuple(allow), tuple(commands))


def load_authority(root: str, path: str = AUTHORITY, repository: str | None = None, ref: str | None = None) -> tuple[Authority | None, list[tuple[str, str]]]:
    """The tree's authority, and the conflicts (code, message) that forbid to rely on it."""
    full = os.path.normpath(os.path.join(root, path))
    if not full.startswith(os.path.normpath(root) + os.sep):
        return None, [("invalid", "the authority's path leaves the tree")]
    try:
        _regular(full, "authority", True)
        found = parse_authority(_text(full, "authority"))
    except ControlError as e:
        return None, [(e.code, str(e))]
    wrong = [f"{k}: {got} instead of {want}" for k, want, got in (("repository", repository, found.repository), ("ref", ref, found.ref)) if want and want != got]
    return found, [("writer_mismatch", "; ".join(wrong))] if wrong else []


def authority_for(mode: str, authority: Authority | None) -> Authority | None:
    """The authority for an operation; check and apply don't run without one."""
    if mode in ("check", "apply") and authority is None:
        raise ControlError("missing", f"{mode} needs {AUTHORITY}")
    return authority


def resolve_mode(asked: str) -> tuple[str, str | None]:
    """The mode and, for an older name, a warning."""
    name = asked.strip()
    if name in MODES:
        return name, None
    if name in OLD_MODES:
        return OLD_MODES[name], f"{name} is an older name of {OLD_MODES[name]}"
    raise ControlError("mode", f"no mode {name!r}: {', '.join(MODES)}")


@dataclass(frozen=True)
class Schema:
    """A user's header schema: see ``cairn.operators.meta.schema_projection`` for its fields."""

    schema_id: str
    fields: tuple[Field, ...]
    version: str = "0.0.0"
    description: str | None = None
    target: tuple[str, ...] = TARGETS

    def includes(self, target: str) -> bool:
        return target in self.target


def includes(schema: Schema | None, target: str) -> bool:
    """Without a schema everything is a target."""
    return schema is None or schema.includes(target)


@dataclass
class _Block:
    items: list[object] = field(default_factory=list)
    pairs: dict[str, object] = field(default_factory=dict)


def parse_yaml(text: str) -> dict[str, object]:
    """The subset that schemas are written in: scalars, lists in brackets, lists of scalars or of flat maps, flat maps.

    Lines that are no entry are passed over; a map within a map is refused.
    """
    root: dict[str, object] = {}
    block, key, base = _Block(), None, 0

    def close() -> None:
        if key is not None:
            root[key] = block.items or block.pairs or None

    for k, indent, line in _rows(text):
        m = re.fullmatch(r"([A-Za-z_][\w-]*):\s*(.*)", line)
        if indent == 0:
            close()
            key = None
            if m and m[2]:
                root[m[1]] = loose_scalar(m[2])
            elif m:
                block, key, base = _Block(), m[1], 0
            continue
        if key is None:
            continue
        base = base or indent
        if line.startswith("- ") and indent == base:
            inner = re.fullmatch(r"([A-Za-z_][\w-]*):\s*(.*)", line[2:])
            block.items.append({inner[1]: loose_scalar(inner[2])} if inner else loose_scalar(line[2:]))
        elif block.items:
            if m and isinstance(block.items[-1], dict):
                block.items[-1][m[1]] = loose_scalar(m[2])
        elif indent > base or (m and not m[2]):
            raise ControlError("invalid", f"a map within a map in line {k}")
        elif m:
            block.pairs[m[1]] = loose_scalar(m[2])
    close()
    return root


def parse_schema(text: str) -> Schema:
    """A schema from its text: ``schema_id`` and a list of fields with a name each, else it is refused."""
    found = parse_yaml(text)
    fields = found.get("fields")
    if not isinstance(found.get("schema_id"), str) or not found["schema_id"]:
        raise ControlError("invalid", "a schema has a schema_id")
    if not isinstance(fields, list) or not fields:
        raise ControlError("invalid", "a schema has a list of fields")
    made = []
    for k, f in enumerate(fields):
        if not isinstance(f, dict) or not isinstance(f.get("name"), str) or not f["name"]:
            raise ControlError("invalid", f"field {k} is a map with a name")
        default = f.get("default")
        made.append(Field(f["name"], f.get("source") if isinstance(f.get("source"), str) else None, None if default is None else str(default).lower() if isinstance(default, bool) else str(default), f.get("required") is True))
    text_of = lambda x: x if isinstance(x, str) else None
    target = found.get("target")
    return Schema(found["schema_id"], tuple(made), text_of(found.get("version")) or "0.0.0", text_of(found.get("description")), tuple(map(str, target)) if isinstance(target, list) else TARGETS)


def load_schema(path: str) -> Schema:
    _regular(path, "schema", True)
    return parse_schema(_text(path, "schema"))


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, line, record, problem of an index file's lines, read by the executors.

    problem: ``not canonical`` where a record written again isn't its line, ``out of order`` where a path isn't after
    the one before it; null for a sound line.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    rows = lines.withColumn("record", F.from_json("line", schema)).withColumn("path", F.col("record.path"))
    # the greatest path of the partitions before: one row for each partition of the file
    floors: dict[int, str | None] = {}
    top: str | None = None
    for r in rows.groupBy("part").agg(F.max("path").alias("high")).orderBy("part").toLocalIterator():
        floors[r["part"]] = top
        top = max(x for x in (top, r["high"], "") if x is not None)
    floor = spark.createDataFrame(list(floors.items()), "part int, floor string")
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.max("path").over(own)).join(F.broadcast(floor), "part")
    same = F.to_json("record", {"ignoreNullFields": "false"}) == F.col("line")
    problem = F.when(~F.coalesce(same, F.lit(False)), "not canonical").when(F.col("path") <= F.greatest("before", "floor"), "out of order")
    return rows.select("path", "line", "record", problem.alias("problem"))
