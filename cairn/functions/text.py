"""Body expressions: hashes, token estimates, header conventions, section fields, comment blocks."""

from __future__ import annotations

from .dialect import Cols, Dialect, any_of, case

MARK = "meta"
SHINGLE = 4


def content_hash(d: Dialect) -> dict[str, str]:
    return {"content_hash": d.sha("body")}


def token_estimate(d: Dialect) -> dict[str, str]:
    """A quarter of the UTF-16 length, rounded up, 1 at least."""
    return {"token_estimate": f"greatest(1, CAST(ceil({d.units('body')} / 4.0) AS BIGINT))"}


def shingle_list(d: Dialect, x: str = "body") -> str:
    """All runs of SHINGLE lower-case words, repeats kept; fewer words make one, none make none."""
    w = d.words(f"lower({x})")
    if d.duck:
        return f"list_transform([{w}], lambda w: CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END)[1]"
    runs = " || ' ' || ".join(["x", *(f"w[i + {k}]" for k in range(1, SHINGLE))])
    return f"transform(array({w}), w -> CASE WHEN size(w) = 0 THEN array() WHEN size(w) < {SHINGLE} THEN array(array_join(w, ' ')) ELSE transform(slice(w, 1, size(w) - {SHINGLE - 1}), (x, i) -> {runs}) END)[0]"


def split_header(d: Dialect) -> dict[str, str]:
    """fence_end: place of the closing fence's line break (0 without a header that is fenced)."""
    opened = f"({d.starts('body', '---' + chr(10))} OR {d.starts('body', '---' + chr(13) + chr(10))})"
    at = f"instr(substring(body, 5), {d.char(10)} || '---')"
    return {"fence_end": f"CASE WHEN {opened} AND {at} > 0 THEN {at} + 4 ELSE 0 END"}


def header_convention(d: Dialect) -> dict[str, str]:
    """full-yaml, bare-yaml (in the first 300 characters), prose-table (first 500) or none; and the text past the header."""
    return {
        "header_convention": case(
            [("fence_end > 0", "'full-yaml'"), (d.m("substring(body, 1, 300)", r"(?m)^[a-zA-Z_]+:\s+.+"), "'bare-yaml'"), (d.m("substring(body, 1, 500)", r"\|.+\|.+\|"), "'prose-table'")], "'none'"
        ),
        "rest": f"CASE WHEN fence_end > 0 THEN {d.rep('substring(body, fence_end + 4)', chr(92) + 'A' + chr(92) + 'n')} ELSE body END",
    }


def stripped(d: Dialect) -> dict[str, str]:
    """clean_body: what follows a fenced header and the line breaks after it."""
    return {"clean_body": f"CASE WHEN fence_end > 0 THEN {d.rep('substring(body, fence_end + 4)', chr(92) + 'A' + chr(92) + 'n+')} ELSE body END"}


def body_structure(d: Dialect) -> dict[str, str]:
    return {"body_structure": case([(d.m("rest", r"(?m)^##\s+"), "'sections'"), (d.m("rest", r"\|.+\|.+\|"), "'table-driven'"), (d.m("rest", r"\S"), "'flat'")], "'unknown'")}


def _scalar(d: Dialect, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({d.ex('rest', p, 1)}), '')" for p in patterns) + ")"


def _bullets(d: Dialect, heading: str) -> str:
    """Bullets of a section up to the next second-level heading; null where there is none."""
    mark = chr(1)
    section = d.ex(d.rep("rest", rf"(?m)^##\s+(?:{heading})[ \t]*$", mark), rf"(?s){mark}([^{mark}]*)", 1)
    section = d.ex(d.rep(section, r"\n## ", mark), rf"(?s)\A([^{mark}]*)", 1)
    found = d.each(d.matches(section, r"(?m)^[-*][ \t]+(.+)$", 1), "b", "trim(b)")
    return f"CASE WHEN {d.size(found)} > 0 THEN {found} END"


def extract_fields(d: Dialect) -> dict[str, str]:
    """The nine grammar fields of a body, null where the body has none."""
    head = lambda name: rf"(?m)^##\s+{name}[ \t]*\n+([^\n#]+)"
    return {
        "role": _scalar(d, [head("Role"), r"\*\*Role\*\*:?\s*([^\n]+)"]),
        "objective": _scalar(d, [head("Objective"), r"\*\*Objective\*\*:?\s*([^\n]+)"]),
        "output_format": _scalar(d, [head("Output Format"), r"\*\*Output Format\*\*:?\s*([^\n]+)"]),
        "model_target": _scalar(d, [r"(?im)^##\s+Model[ _-]?Target[ \t]*\n+([^\n#]+)", r"(?i)model[_-]?target:?\s*([^\n,]+)", r"\*\*Model Target\*\*:?\s*([^\n]+)"]),
        "constraints": _bullets(d, "Constraints?"),
        "validation_gates": _bullets(d, "Validation Gates?"),
        "stop_conditions": _bullets(d, "Stop Conditions?"),
        "phase_model": _bullets(d, "Phase Model|Phases"),
        "input_variables": _bullets(d, "Input Variables?"),
    }


def good_value(x: str, d: Dialect) -> str:
    """Text of eight words or more."""
    return f"(coalesce({x}, 'Unknown') <> 'Unknown' AND {d.size(d.words(f'coalesce({x}, chr(32))'))} >= 8)".replace("chr(32)", "' '")


def yaml_scalar(x: str, d: Dialect) -> str:
    """Bare where that is safe, else in double quotes with escapes; line breaks become \\n."""
    value, x = x, "y.x"
    quoted = f"replace(replace(replace({x}, {d.char(92)}, {d.char(92)} || {d.char(92)}), {d.char(34)}, {d.char(92)} || {d.char(34)}), {d.char(10)}, {d.char(92)} || 'n')"
    risky = any_of([d.m(x, r"[:#{}\[\],&*?|<>=!%@`\n\x22\x27\\]"), f"trim({x}) <> {x}", d.isin(x, ("", "true", "false", "null"))])
    return d.let("y", {"x": value}, f"CASE WHEN {risky} THEN {d.char(34)} || {quoted} || {d.char(34)} ELSE {x} END")


def header_lines(scalars: list[str], lists: list[str]) -> Cols:
    """yaml_inner: a line for each column that isn't null, in this order; lists have a line for each item."""

    def cols(d: Dialect) -> dict[str, str]:
        one = lambda f: f"'{f}: ' || {yaml_scalar(d.text(f), d)}"
        item = d.each("{f}", "i", f"'  - ' || {yaml_scalar('i', d)}")
        many = lambda f: f"CASE WHEN {f} IS NULL THEN NULL WHEN {d.size(f)} = 0 THEN '{f}: Unknown' ELSE '{f}:' || {d.char(10)} || {d.join(item.replace('{f}', f), chr(10))} END"
        return {"yaml_inner": f"concat_ws({d.char(10)}, {', '.join([*map(one, scalars), *map(many, lists)])})"}

    return cols


def fenced(d: Dialect) -> dict[str, str]:
    nl = d.char(10)
    return {"yaml_header": f"'---' || {nl} || yaml_inner || {nl} || '---'"}


def clean(frontmatter: tuple[str, ...], line_prefixes: tuple[str, ...], blocks: tuple[tuple[str, str], ...]) -> Cols:
    """clean_body: the file without a header that an earlier run put there, or without its fenced header."""
    esc = lambda x: "".join("\\" + c if c in "*/.<>!-" and c in "*." else c for c in x)

    def cols(d: Dialect) -> dict[str, str]:
        pairs = [(d.isin("lext", frontmatter), stripped(d)["clean_body"])]
        for p in line_prefixes:
            pairs.append((f"line_prefix = '{p}' AND {d.has('body', f'{p} >>> {MARK} >>>')}", d.rep("body", f"(?s){esc(p)} >>> {MARK} >>>.*?{esc(p)} <<< {MARK} <<<\\r?\\n?")))
        for o, c in blocks:
            pairs.append((f"block_open = '{o}' AND {d.has('body', f'{o} {MARK}:start')}", d.rep("body", f"(?s){esc(o)} {MARK}:start.*?{MARK}:end {esc(c)}\\r?\\n?")))
        return {"clean_body": case(pairs, "body")}

    return cols


def comment_block(d: Dialect) -> dict[str, str]:
    """block: the header in the comment style of the strategy; null where that has no comments."""
    nl = d.char(10)
    # an inner line gets the prefix and a blank, an empty one the prefix alone
    prefixed = d.join(d.each(d.split("k.y", r"\n"), "l", "CASE WHEN l = '' THEN k.p ELSE k.p || ' ' || l END"), "\n")
    body = case(
        [
            ("k.s = 'line-comment'", f"k.p || ' >>> {MARK} >>>' || {nl} || {prefixed} || {nl} || k.p || ' <<< {MARK} <<<'"),
            ("k.s = 'block-comment'", f"k.o || ' {MARK}:start' || {nl} || k.y || {nl} || '{MARK}:end ' || k.c"),
        ]
    )
    return {"block": d.let("k", {"y": "yaml_inner", "s": "strategy", "p": "line_prefix", "o": "block_open", "c": "block_close"}, body)}


def injected(d: Dialect) -> dict[str, str]:
    """injected: the file with its header; a first line that starts with #! stays first; sidecars leave the body as it is."""
    nl = d.char(10)
    at = f"instr(k.c, {nl})"
    body = case(
        [
            ("k.s = 'yaml-frontmatter'", f"k.h || {nl} || {nl} || k.c"),
            ("k.b IS NULL", "k.t"),
            (f"{d.starts('k.c', '#!')} AND {at} = 0", f"k.c || {nl} || k.b || {nl}"),
            (d.starts("k.c", "#!"), f"substring(k.c, 1, {at}) || k.b || {nl} || substring(k.c, {at} + 1)"),
        ],
        f"k.b || {nl} || k.c",
    )
    return {"injected": d.let("k", {"s": "strategy", "h": "yaml_header", "b": "block", "c": "clean_body", "t": "body"}, body)}


def recovered(d: Dialect) -> dict[str, str]:
    """recovered: the body that ``injected`` holds, got back from its text alone."""
    nl = d.char(10)
    fence = f"instr(substring(k.j, 5), {nl} || '---')"
    line_end, block_end = f"k.p || ' <<< {MARK} <<<' || {nl}", f"'{MARK}:end ' || k.c || {nl}"
    first = lambda end: f"(instr(k.j, {end}) + length({end}))"
    shebang = f"CASE WHEN {d.starts('k.j', '#!')} THEN substring(k.j, 1, instr(k.j, {nl})) ELSE '' END"
    body = case(
        [
            ("k.s = 'yaml-frontmatter'", d.rep(f"substring(k.j, {fence} + 8)", chr(92) + "A" + chr(92) + "n+")),
            ("k.s = 'line-comment'", f"{shebang} || substring(k.j, {first(line_end)})"),
            ("k.s = 'block-comment'", f"{shebang} || substring(k.j, {first(block_end)})"),
        ],
        "k.j",
    )
    return {"recovered": d.let("k", {"j": "injected", "s": "strategy", "p": "line_prefix", "c": "block_close"}, body)}
