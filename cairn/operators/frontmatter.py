"""Fenced headers, read and patched byte for byte; Arrow functions, as text surgery has no built-in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

_KEY = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*):(.*)\Z", re.S)
_COMPLEX = re.compile(r"%|\.\.\.|[?!&*{}]|<<:")
_BAD_VALUE = re.compile(r"[&*!|>%@`{]")


@dataclass
class Header:
    """What a document's header holds; ``issue`` says why it can't be patched, if it can't."""

    issue: str | None = None
    had: bool = False
    values: dict[str, object] = field(default_factory=dict)
    start: int = 0  # of the first line after the opening fence
    close: int = 0  # of the closing fence
    body: str = ""
    newline: str = "\n"


def _lines(raw: str, at: int) -> list[tuple[int, str, str]]:
    out = []
    for m in re.finditer(r"([^\r\n]*)(\r\n|\n|\r|\Z)", raw[at:]):
        out.append((at + m.start(), m[1], m[2]))
        if not m[2]:
            break
    return out


def _uncomment(text: str) -> str:
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and (quote == "'" or text[i - 1] != "\\") else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or text[i - 1].isspace()):
            return text[:i]
    return text


def scalar(text: str) -> object:
    """A value of the YAML subset: quoted text, truth, null, whole and decimal numbers, flat lists, bare text."""
    s = text.strip()
    if len(s) >= 2 and s[0] == s[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), s[1:-1])
    if len(s) >= 2 and s[0] == s[-1] == "'":
        return s[1:-1].replace("''", "'")
    if s in ("true", "false"):
        return s == "true"
    if s in ("null", "~"):
        return None
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    if re.fullmatch(r"-?\d*\.\d+", s):
        return float(s)
    if s.startswith("[") and s.endswith("]"):
        return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
    return s


def inspect(raw: str) -> Header:
    """Reads the header; anything beyond plain keys, scalars and dashed lists makes it unsafe to patch."""
    bom = 1 if raw.startswith("\ufeff") else 0
    lines = _lines(raw, bom)
    newline = "\r\n" if "\r\n" in raw else "\n"
    if lines[0][1] != "---":
        return Header("opening fence not exact" if lines[0][1].lstrip().startswith("---") else None, body=raw[bom:], start=bom, close=bom, newline=newline)
    end = next((i for i, x in enumerate(lines[1:], 1) if x[1] == "---"), None)
    if not lines[0][2] or end is None:
        return Header("closing fence missing", body=raw)
    inner, after = lines[1:end], lines[end][0] + len(lines[end][1]) + len(lines[end][2])
    if len({x[2] for x in lines[: end + 1] if x[2]}) > 1:
        return Header("mixed line ends", body=raw)
    if any("\t" in x[1] for x in inner):
        return Header("tab", body=raw)
    nxt = [x[1] for x in _lines(raw, after)[:200] if x[1].strip()]
    if nxt and nxt[0] == "---" and "---" in nxt[1:] and _KEY.match(nxt[1]):
        return Header("second block", body=raw)
    h = Header(had=True, start=lines[1][0], close=lines[end][0], body=raw[after:], newline=lines[0][2])
    i = 0
    while i < len(inner):
        text = inner[i][1]
        i += 1
        if not text or text.lstrip().startswith("#"):
            continue
        if text[0] == " " or _COMPLEX.match(text):
            return Header("complex", body=raw)
        m = _KEY.match(text)
        if not m:
            return Header("invalid key", body=raw)
        if m[1] in h.values:
            return Header("duplicate key", body=raw)
        value = _uncomment(m[2]).strip()
        if value:
            if _BAD_VALUE.match(value) or (value[0] in "\"'" and (len(value) < 2 or value[-1] != value[0])) or (value[0] == "[") != (value[-1] == "]"):
                return Header("complex", body=raw)
            h.values[m[1]] = scalar(value)
            continue
        items = []
        while i < len(inner) and re.match(r"\s+- |\s+-\Z", inner[i][1]):
            items.append(scalar(_uncomment(inner[i][1].strip()[1:])))
            i += 1
        h.values[m[1]] = items
    return h


def render(key: str, value: object) -> list[str]:
    if isinstance(value, list):
        return [f"{key}: []"] if not value else [f"{key}:", *(f"  - {_cell(v)}" for v in value)]
    return [f"{key}: {_cell(value)}"]


def _cell(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    s = str(v)
    if not isinstance(v, str):
        return s
    if s in ("", "true", "false", "null") or s != s.strip() or re.search(r"[:#{}\[\],&*?|<>=!%@`\n'\"\\]", s):
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return s


def patch(raw: str, managed: dict[str, object]) -> tuple[str, str | None]:
    """(text, issue): managed keys set, missing ones added before the closing fence, every other byte as it was."""
    h = inspect(raw)
    if h.issue:
        return raw, h.issue
    if not managed:
        return raw, None
    nl = h.newline
    bom = "\ufeff" if raw.startswith("\ufeff") else ""
    if not h.had:
        lines = ["---", *(x for k, v in managed.items() for x in render(k, v)), "---"]
        return bom + nl.join(lines) + nl + nl + h.body, None
    out, todo, skip = [], dict(managed), False
    for at, text, eol in _lines(raw, h.start):
        if at >= h.close:
            break
        m = _KEY.match(text)
        if m and m[1] in managed:
            same = h.values.get(m[1]) == managed[m[1]] and type(h.values.get(m[1])) is type(managed[m[1]])
            todo.pop(m[1])
            skip = not same
            out.append(text + eol if same else nl.join(render(m[1], managed[m[1]])) + nl)
        elif skip and re.match(r"\s+-", text):
            continue
        else:
            skip = False
            out.append(text + eol)
    out += [nl.join(render(k, v)) + nl for k, v in todo.items()]
    return raw[: h.start] + "".join(out) + raw[h.close :], None


def inspect_headers(docs: DataFrame, body: str = "body", key: str = "path") -> DataFrame:
    """key, safe, issue, had_header, header (a map of its values as text), body_length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [inspect(t or "") for t in b["t"]]
            values = [{k: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in h.values.items()} for h in found]
            yield pd.DataFrame({"k": b["k"], "safe": [h.issue is None for h in found], "issue": [h.issue for h in found], "had_header": [h.had for h in found], "header": values, "body_length": [len(h.body) for h in found]})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS k", f"`{body}` AS t").mapInPandas(run, f"k {kind}, safe boolean, issue string, had_header boolean, header map<string,string>, body_length long")
    return out.withColumnRenamed("k", key)


def patch_headers(docs: DataFrame, managed: str = "managed", body: str = "body", key: str = "path") -> DataFrame:
    """key, patched, changed, issue: the map column ``managed`` put into each document's header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [patch(t or "", dict(m) if m else {}) for t, m in zip(b["t"], b["m"], strict=True)]
            yield pd.DataFrame({"k": b["k"], "patched": [x for x, _ in got], "changed": [x != (t or "") for (x, _), t in zip(got, b["t"], strict=True)], "issue": [i for _, i in got]})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS k", f"`{body}` AS t", f"`{managed}` AS m").mapInPandas(run, f"k {kind}, patched string, changed boolean, issue string")
    return out.withColumnRenamed("k", key)
