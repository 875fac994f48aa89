"""Classification cascades: the first rule that holds decides, so their order is their meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cairn.functions import paths, rules
from cairn.functions.dialect import Cols, Dialect, add, any_of, case


FAMILY_WORDS = list(dict.fromkeys(w for ws in rules.FAMILIES.values() for w in ws.split()))
KEYWORDS = sorted({*FAMILY_WORDS, *(w for ws, _ in rules.TYPES.values() for w in ws.split())})
WINDOW = 800


def hit(d: Dialect, word: str, x: str = "found") -> str:
    return d.holds(x, d.q(word))


def window(d: Dialect, n: int = WINDOW) -> str:
    """The first n UTF-16 units of the body; a character of two units that would be cut is left out."""
    return d.first_units("body", n)


def found(d: Dialect) -> dict[str, str]:
    """The keywords among the words of the basename and of the body's window: cut up once, looked up by all rules."""
    words = d.split(f"lower(base || ' ' || {window(d)})", "[^a-z0-9_]+")
    return {"found": d.both(words, d.array(map(d.q, KEYWORDS)))}


def family(d: Dialect) -> dict[str, str]:
    return {"family": case([(any_of(hit(d, w) for w in words.split()), f"'{name}'") for name, words in rules.FAMILIES.items()], "'Unknown'")}


def signals(d: Dialect) -> dict[str, str]:
    """The first six family words found, in table order."""
    return {"signals": d.head(d.listed(d.array(map(d.q, FAMILY_WORDS)), "found"), 6)}


def word(d: Dialect) -> dict[str, str]:
    """The type that words give and its score; none gives context.

    A test or script by words alone needs three of them, or two with a strong one; else the best other type wins.
    """
    every, weak = list(rules.TYPES), [t for t in rules.TYPES if t not in rules.STRONG]
    scores = {t: " + ".join(f"CASE WHEN {hit(d, w, 'c.x')} THEN 1 ELSE 0 END" for w in words.split()) or "0" for t, (words, _) in rules.TYPES.items()}
    scores |= {f"strong_{t}": any_of(hit(d, w, "c.x") for w in words) for t, words in rules.STRONG.items()}
    top = lambda ts: f"greatest({', '.join(f's.{t}' for t in ts)})"
    first = lambda ts: case([(f"{top(ts)} = 0", "'context'"), *((f"s.{t} = {top(ts)}", f"'{t}'") for t in ts)])
    best = {"t": first(every), "n": top(every), "t2": first(weak), "n2": top(weak), "strong": case([(f"{first(every)} = '{t}'", f"s.strong_{t}") for t in rules.STRONG], "true")}
    demoted = "b.t IN ('test', 'script') AND NOT (b.n >= 3 OR (b.n = 2 AND b.strong))"
    chosen = f"CASE WHEN {demoted} THEN {d.struct({'t': 'b.t2', 'n': 'b.n2'})} ELSE {d.struct({'t': 'b.t', 'n': 'b.n'})} END"
    return {"word": d.let("c", {"x": "found"}, d.let("s", scores, d.let("b", best, chosen)))}


def _type(d: Dialect) -> dict[str, str]:
    dot = d.ex("lbase", r"\.(" + "|".join(paths.PRIMITIVES) + r")\.", 1)
    by_path = [(any_of(d.has("norm", f"/{s}/") for s in segments.split()), t) for t, (_, segments) in rules.TYPES.items()]
    sure = [(f"{dot} <> ''", None), (d.starts("lbase", "prompt-"), "prompt")]
    prose = d.isin("lext", rules.PROSE)
    return {
        "artifact_type": case([(c, dot if t is None else f"'{t}'") for c, t in sure] + [(f"NOT {prose}", "'source'")] + [(c, f"'{t}'") for c, t in by_path], "word.t"),
        "confidence": case([(c, "'high'") for c, _ in sure] + [(f"NOT {prose}", "'low'")] + [(c, "'high'") for c, _ in by_path] + [("word.n >= 2", "'medium'")], "'low'"),
    }


def confidence_number(d: Dialect) -> dict[str, str]:
    return {"confidence_number": f"CAST({case([(f'confidence = {d.q(k)}', x) for k, x in (('high', '0.9'), ('medium', '0.6'))], '0.3')} AS DOUBLE)"}


TYPE_STEPS: list[Cols] = [found, word, _type, family, signals]


def semantic(d: Dialect) -> dict[str, str]:
    """semantic_class, its confidence and the signal that decided; the body isn't looked at."""
    b, e, n = "lbase", "lext", "norm"
    seg = lambda s: d.m(n, f"/({s})/")
    has = lambda *xs: any_of(d.has(b, x) for x in xs)
    ext = lambda names: d.isin(e, rules.dotted(names))
    docs = "md mdx rst txt"
    table: list[tuple[str, str, str]] = [
        (d.ends(b, ".d.ts"), "type_definitions", "'*.d.ts'"),
        (d.m(b, r"\.(test|spec)\.[cm]?[jt]sx?$"), "test_suite", "'*.test/spec.*'"),
        (seg("tests?|__tests__"), "test_suite", "'/tests/'"),
        (any_of([has(".schema."), f"{b} = 'schema.ts'", d.ends(b, "_schema.ts")]), "schema", "'.schema.'"),
        (seg("schemas?"), "schema", "'/schemas/'"),
        (has("changelog"), "changelog", "'changelog'"),
        (has("contract"), "contract", "'contract'"),
        (seg("contracts?"), "contract", "'/contracts/'"),
        (d.isin(b, ("package.json", "package-lock.json")), "build_manifest", b),
        (f"{has('manifest')} AND NOT {ext(docs)}", "build_manifest", "'manifest'"),
        (seg(r"dist|build|\.out"), "build_artifact", f"'/' || {d.ex(n, r'/(dist|build|[.]out)/', 1)} || '/'"),
        (any_of([d.starts(b, "prompt-"), has(".prompt.")]), "prompt_template", "'prompt-'"),
        (seg("prompts?"), "prompt_template", "'/prompts/'"),
        (has(".skill."), "skill_definition", "'.skill.'"),
        (seg("skills?"), "skill_definition", "'/skills/'"),
        (has("doctrine", "policy"), "governance_doctrine", "'doctrine'"),
        (seg("doctrines?"), "governance_doctrine", "'/doctrines/'"),
        (any_of([has("pipeline"), seg("pipelines?")]), "pipeline", "'pipeline'"),
        (any_of([seg("fixtures?|examples?|mocks?"), has("fixture", "mock")]), "fixture", "'fixture'"),
        (ext("bash py sh zsh"), "script", e),
        (seg("scripts?"), "script", "'/scripts/'"),
        (any_of([d.m(b, r"\.config\.[cm]?[jt]s$"), d.m(b, r"^tsconfig.*\.json$"), d.m(b, r"^\..*rc(\..+)?$")]), "configuration", "'config'"),
        (ext("ini json toml yaml yml"), "configuration", e),
        (ext(docs), "documentation", e),
        (seg("docs?"), "documentation", "'/docs/'"),
        (ext("cjs js jsx mjs ts tsx"), "source_module", e),
    ]
    return {
        "semantic_class": case([(c, f"'{k}'") for c, k, _ in table], "'unknown'"),
        "semantic_confidence": case([(c, "'medium'" if k == "source_module" else "'high'") for c, k, _ in table], "'low'"),
        "semantic_signal": case([(c, s) for c, _, s in table]),
    }


def inventory(d: Dialect) -> dict[str, str]:
    """inventory_type with a fixed confidence and the evidence for it; is_dir marks folders."""
    b, e, n = "lbase", "lext", "lower(path)"
    md = d.isin(e, rules.dotted("markdown md mdx"))
    table: list[tuple[str, str, float, str]] = [
        ("is_dir", "folder", 1.0, "'directory entry'"),
        (d.m(b, r"\.schema\.(json|ya?ml)$"), "schema", 0.92, "'schema filename convention'"),
        (any_of([d.m(b, r"\.(test|spec)\.[a-z0-9]+$"), d.m(n, "(^|/)(tests?|__tests__|spec)/")]), "test", 0.85, "'test filename/path'"),
        (any_of([d.m(b, "^prompt[-_]"), d.m(n, "(^|/)prompts?/")]), "prompt", 0.85, "'prompt filename/path'"),
        (d.isin(e, rules.ARCHIVES), "archive", 0.95, f"'archive extension ' || {e}"),
        (f"{e} = '.pdf'", "research_pdf", 0.9, "'pdf document'"),
        (d.isin(e, rules.CODE), "code", 0.9, f"'code extension ' || {e}"),
        (f"{d.m(n, '(^|/|[-_])spec([-_.]|s?/)')} AND {d.isin(e, rules.dotted('markdown md yaml yml'))}", "spec", 0.7, "'spec naming'"),
        (d.isin(e, rules.CONFIG), "config", 0.8, f"'config extension ' || {e}"),
        (f"{md} AND {d.m(n, '(^|/)(research|notes?|papers?)/')}", "research_markdown", 0.75, "'markdown under research/notes path'"),
        (md, "documentation", 0.6, "'markdown document'"),
        (d.isin(e, rules.DOCUMENTS), "documentation", 0.7, f"'document extension ' || {e}"),
        *((f"{b} = '{name}'", kind, conf, f"'{why}'") for name, (kind, conf, why) in rules.BASENAMES.items()),
        (d.m(b, r"^license([.\-_]|$)"), "documentation", 0.8, "'license file'"),
    ]
    return {
        "inventory_type": case([(c, f"'{t}'") for c, t, _, _ in table], "'unknown'"),
        "inventory_confidence": f"CAST({case([(c, str(x)) for c, _, x, _ in table], '0.2')} AS DOUBLE)",
        "evidence": case([(c, w) for c, *_, w in table], "'no recognized signal'"),
    }


def unknowns(d: Dialect) -> dict[str, str]:
    return {"unknowns": f"CASE WHEN inventory_type <> 'unknown' THEN '' WHEN lext <> '' THEN 'unrecognized_extension:' || lext ELSE 'no_extension' END"}


def mime(d: Dialect) -> dict[str, str]:
    return {"mime_type": case([("is_dir", "'inode/directory'")] + [(d.isin("lext", rules.dotted(exts)), f"'{m}'") for m, exts in sorted(rules.MIME.items())])}


def strategy(d: Dialect) -> dict[str, str]:
    """How a header can be put into the file: binary extension, NUL byte, frontmatter, line or block comment, sidecar."""
    nul = f"instr(substring(body, 1, 8192), {d.char(0)}) > 0"
    line = [(d.isin("lext", exts), f"'{p}'") for p, exts in rules.LINE_COMMENTS.items()] + [(d.isin("lbase", rules.LINE_BASENAMES), "'#'")]
    block = [(d.isin("lext", exts), o, c) for (o, c), exts in rules.BLOCK_COMMENTS.items()]
    early = [(any_of([d.isin("lext", rules.BINARY), nul]), "'skip-binary'"), (d.isin("lext", rules.FRONTMATTER), "'yaml-frontmatter'")]
    return {
        "strategy": case(early + [(c, "'line-comment'") for c, _ in line] + [(c, "'block-comment'") for c, *_ in block], "'sidecar'"),
        "line_prefix": case([(c, "NULL") for c, _ in early] + line),
        "block_open": case([(c, "NULL") for c, _ in early + line] + [(c, f"'{o}'") for c, o, _ in block]),
        "block_close": case([(c, "NULL") for c, _ in early + line] + [(c, f"'{x}'") for c, _, x in block]),
    }


def taxonomy(d: Dialect) -> dict[str, str]:
    """What a coarse type implies, and the coarse types that the two other vocabularies map to."""
    at = lambda ok: d.isin("artifact_type", sorted(t for t, v in rules.TAXONOMY.items() if ok(v)))
    kinds = [(at(lambda v, k=k: v[0] == k), f"'{k}'") for k in sorted({v[0] for v in rules.TAXONOMY.values()}) if k != "none"]
    return {"mcp_primitive": case(kinds, "'none'"), "callable": at(lambda v: v[1]), "injectable": at(lambda v: v[2])}


def coarse(d: Dialect) -> dict[str, str]:
    return {
        "semantic_coarse": case([(f"semantic_class = '{k}'", f"'{v[2]}'") for k, v in rules.CLASSES.items()]),
        "inventory_coarse": case([(f"inventory_type = '{k}'", f"'{v}'") for k, v in rules.INVENTORY_TYPES.items()]),
    }


def domain(d: Dialect) -> dict[str, str]:
    """The older hint table: the first key in path or the first 2000 characters of the body."""
    x = "lower(path || ' ' || substring(body, 1, 2000))"
    table = [(d.has(x, k), v) for k, v in rules.DOMAIN_HINTS.items()]
    return {
        "hint_type": case([(c, f"'{v[0]}'") for c, v in table], "'unknown'"),
        "hint_domain": case([(c, f"'{v[1]}'") for c, v in table], "'generic'"),
        "hint_dir": case([(c, f"'{v[2]}'") for c, v in table], f"'{rules.LOW_CONFIDENCE}'"),
        "hint_confidence": f"CAST({case([(c, str(v[3])) for c, v in table], '0.4')} AS DOUBLE)",
    }


PARTS: list[Cols] = [paths.parts, paths.more_parts]


def classify(artifacts: DataFrame) -> DataFrame:
    """artifact_type, confidence, family and signals of (path, body) rows."""
    out = add(artifacts, *PARTS, *TYPE_STEPS)
    return out.drop("found", "word")


def semantic_classes(artifacts: DataFrame) -> DataFrame:
    return add(artifacts, *PARTS, semantic)


def inventory_types(artifacts: DataFrame) -> DataFrame:
    return add(artifacts, *PARTS, inventory, unknowns, mime)


def injection_strategies(artifacts: DataFrame) -> DataFrame:
    return add(artifacts, *PARTS, strategy)
