"""Path algebra: basename, extension, stems, ids, titles, validity."""

from __future__ import annotations

from .dialect import Cols, Dialect, any_of, case

PRIMITIVES = ("skill", "playbook", "kernel", "context", "prompt", "doctrine", "test", "script")
SHARED_SIGNALS = ("_shared", "common", "core", "shared", "universal")
PRIVATE_SIGNALS = ("internal", "legal", "ops", "private")
NAMESPACE = "main"


def parts(d: Dialect) -> dict[str, str]:
    """base, parent (null at the root), depth of a path with '/' between segments."""
    return {"base": d.ex("path", "[^/]*$"), "parent": f"nullif({d.ex('path', '^(.*)/[^/]*$', 1)}, '')", "depth": f"CASE WHEN path = '.' THEN 0 ELSE length(path) - length(replace(path, '/', '')) + 1 END", "norm": "'/' || lower(path)"}


def more_parts(d: Dialect) -> dict[str, str]:
    """ext (with its dot; a leading dot starts none), lower case forms."""
    return {"ext": d.ex("base", r"^.+(\.[^.]*)$", 1), "lext": f"lower({d.ex('base', r'^.+(\.[^.]*)$', 1)})", "lbase": "lower(base)"}


def stem(d: Dialect) -> dict[str, str]:
    """snake_stem: the basename in snake case without prompt prefix and extensions."""
    x = "substring(base, 1, length(base) - length(ext))"
    x = d.rep(x, "(?i)^prompt-")
    x = d.rep(x, r"(?i)\.[a-z]+$")
    x = d.rep(x, "([a-z])([A-Z])", "$1_$2")
    x = d.rep(x, r"[-\s]+", "_")
    x = d.rep(x, "[^A-Za-z0-9_]", "_")
    x = d.rep(x, "_+", "_")
    return {"snake_stem": f"lower({d.rep(x, '^_|_$')})"}


def title(d: Dialect) -> dict[str, str]:
    x = d.rep("substring(base, 1, length(base) - length(ext))", "[-_.]", " ")
    return {"title": f"trim({d.rep(x, '(?i)^prompt ')})"}


def scope(prose_exts: tuple[str, ...] = (".md", ".markdown"), shared: tuple[str, ...] = SHARED_SIGNALS, private: tuple[str, ...] = PRIVATE_SIGNALS) -> Cols:
    """sharing_scope: only prose files have one; a shared segment beats a private one."""

    def cols(d: Dialect) -> dict[str, str]:
        segment = lambda names: d.m("norm", f"/({'|'.join(names)})(/|$)")
        return {"sharing_scope": case([(f"NOT {d.isin('lext', prose_exts)}", "'agnostic'"), (segment(shared), "'shared'"), (segment(private), "'private'")], "'agnostic'")}

    return cols


def glob_any_segment(glob: str) -> str:
    """A namespace glob as a regular expression, held at segment borders but not at the ends."""
    out = ""
    for piece in _tokens(glob):
        out += {"**": ".*", "*": "[^/]*"}.get(piece, _escape(piece))
    return f"(^|/){out}($|/)"


def glob_anchored(glob: str) -> str:
    """An allow-list glob: ``**/`` may be empty, ``?`` is one character, both ends held."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], _escape(glob[i])), i + 1
    return f"^{out}$"


def _tokens(glob: str) -> list[str]:
    out, i = [], 0
    while i < len(glob):
        n = 2 if glob.startswith("**", i) else 1
        out.append(glob[i : i + n])
        i += n
    return out


def _escape(c: str) -> str:
    return "\\" + c if c in r".+()|[]{}^$\*?" else c


def folder(d: Dialect) -> dict[str, str]:
    """primitive_folder: the dotted name, then the first known segment, then a prompt prefix."""
    dotted = d.ex("lbase", r"\.(" + "|".join(PRIMITIVES) + r")\.", 1)
    return {"primitive_folder": case([(f"{dotted} <> ''", dotted), *((d.has("'/' || lower(path)", f"/{p}s/"), f"'{p}'") for p in PRIMITIVES), (d.starts("lbase", "prompt-"), "'prompt'")], "'unknown'")}


def namespace(default: str = NAMESPACE, globs: tuple[tuple[str, str], ...] = ()) -> Cols:
    """namespace: that of the first glob that matches."""

    def cols(d: Dialect) -> dict[str, str]:
        return {"namespace": case([(d.m("path", glob_any_segment(g)), d.q(n)) for g, n in globs], d.q(default)) if globs else d.q(default)}

    return cols


def header_id(d: Dialect) -> dict[str, str]:
    """header_id: namespace, folder (or the artifact type where the path gives none) and stem; not unique."""
    return {"header_id": "namespace || '.' || CASE WHEN primitive_folder = 'unknown' AND artifact_type <> 'unknown' THEN artifact_type ELSE primitive_folder END || '.' || snake_stem"}


def validity(d: Dialect) -> dict[str, str]:
    """path_issue: why a path isn't a canonical relative one, null where it is."""
    return {
        "path_issue": case(
            [
                ("path = ''", "'empty'"),
                (f"instr(path, {d.char(92)}) > 0", "'separator'"),
                (any_of([d.starts("path", "/"), d.starts("path", "./")]), "'not relative'"),
                (any_of([d.has("path", "//"), d.ends("path", "/")]), "'empty segment'"),
                (d.m("path", r"(^|/)\.\.?(/|$)"), "'dot segment'"),
            ]
        )
    }


def filename(d: Dialect) -> dict[str, str]:
    """normalized_name: snake case, dots kept; two dotted words at the start and a prompt prefix stay as they are."""
    snake = lambda x: f"lower({d.rep(d.rep(d.rep(d.rep(d.rep(x, '([a-z])([A-Z])', '$1_$2'), r'[-\s]+', '_'), '[^A-Za-z0-9_.]', '_'), '_+', '_'), '^_|_$')})"
    x = "substring(base, 1, length(base) - length(ext))"
    dotted = d.ex(x, r"^([A-Za-z_]+\.[A-Za-z_]+\.).+$", 1)
    return {
        "normalized_name": case(
            [
                (f"{dotted} <> ''", f"lower({dotted}) || {snake(f'substring({x}, length({dotted}) + 1)')} || lower(ext)"),
                (d.starts(f"lower({x})", "prompt-"), f"'Prompt-' || {snake(f'substring({x}, 8)')} || lower(ext)"),
            ],
            f"{snake(x)} || lower(ext)",
        )
    }
