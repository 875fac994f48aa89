"""Omit rules, metadata carriers, placement, discovery dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths, rules
from cairn.functions.dialect import Cols, Dialect, add, any_of, case

from .classify import PARTS, strategy

RANK = {"low": 0, "medium": 1, "high": 2}


def omit_regex(pattern: str) -> str:
    """A gitignore-like pattern as a case-insensitive regular expression on a relative path."""
    if not any(c in pattern for c in "*/?"):
        pattern += "/"
    only_dir = pattern.endswith("/")
    body = pattern.rstrip("/") if only_dir else pattern
    anchored = body.startswith("/")
    inner = paths.glob_anchored(body.lstrip("/"))[1:-1]
    if only_dir:
        inner = f"(?:{inner}|{inner}/.*)"
    return f"(?i)^{inner}$" if anchored else f"(?i)(?:^|/){inner}$"


def omit(patterns: tuple[str, ...] = (), protect_skill: bool = True, ignore_dirs: tuple[str, ...] = ("node_modules",)) -> Cols:
    """omitted: the last pattern that matches decides, '!' takes back; skill entry points are always protected."""
    every = [*rules.NOISE, *(rules.SKILL_PROTECT if protect_skill else ()), *(f"{x}/" for x in ignore_dirs), *patterns]

    def cols(d: Dialect) -> dict[str, str]:
        pairs = [] if not protect_skill else [("lower(base) = 'skill.md'", "true")]
        for p in reversed([p.strip() for p in every if p.strip() and not p.strip().startswith("#")]):
            negate = p.startswith("!")
            pairs.append((d.m("path", omit_regex(p[negate:])), "false" if negate else "true"))
        return {"omitted": case(pairs, "false")}

    return cols


def disposition(patterns: tuple[str, ...] = (), extension: str | None = None) -> Cols:
    """disposition of regular files, by the first rule that holds; ``probe`` says what a look at the bytes gives."""

    def cols(d: Dialect) -> dict[str, str]:
        known = any_of([d.isin("lext", rules.FRONTMATTER), "strategy IN ('line-comment', 'block-comment')"])
        pairs = [
            (any_of([f"path = '{rules.CONTROL}'", d.starts("path", rules.CONTROL + "/"), *(d.ends("base", s) for s in rules.GENERATED)]), "'generated_artifact'"),
            ("omitted", "'omitted'"),
            (d.m("path", r"(^|/)\."), "'hidden_control'"),
        ]
        if extension:
            pairs.append((f"NOT {d.ends('lbase', extension.lower())}", "'extension_filtered'"))
        pairs += [("strategy = 'skip-binary' AND " + d.isin("lext", rules.BINARY), "'known_binary'"), (known, "'eligible'"), (f"instr(substring(body, 1, 8192), {d.char(0)}) > 0", "'binary_detected'")]
        return {"disposition": case(pairs, "'eligible'"), "known_text": known}

    return cols


def reasons(d: Dialect) -> dict[str, str]:
    return {
        "reason": case(
            [
                ("disposition = 'generated_artifact'", "'written by an earlier run'"),
                ("disposition = 'omitted'", "'matched an omit pattern'"),
                ("disposition = 'hidden_control'", "'hidden control surface'"),
                ("disposition = 'extension_filtered'", "'not the wanted extension'"),
                ("disposition = 'known_binary'", "'binary by extension'"),
                ("disposition = 'binary_detected'", "'NUL byte found'"),
                ("known_text", "'text by extension'"),
            ],
            "'text by its first bytes'",
        )
    }


def carrier(inline_allow: tuple[str, ...] = (), default: str = "central_manifest", skills_mode: bool = False) -> Cols:
    """carrier, why, and the rule, in four tiers: hard skip, inventory only, central manifest, inline or the default."""

    def cols(d: Dialect) -> dict[str, str]:
        p, b, e = "lower(path)", "lbase", "lext"
        rows: list[tuple[str, str, str, str]] = []

        def tier(kind: str, why: str, tests: list[tuple[str, str]]) -> None:
            rows.extend((c, kind, why, rule) for c, rule in tests)

        quoted = lambda names, test: [(test(x), f"'{x}'") for x in names]
        tier("hard_skip", "'protected namespace'", quoted(rules.SKIP_PREFIXES, lambda x: d.starts(p, x)))
        tier("hard_skip", "'generated metadata'", quoted(rules.GENERATED, lambda x: d.ends(p, x)))
        tier("hard_skip", "'binary content'", [("strategy = 'skip-binary'", "'strategy:skip-binary'")])
        tier("inventory_only", "'generated or vendored'", quoted(rules.INVENTORY_PREFIXES, lambda x: d.starts(p, x)))
        tier("inventory_only", "'dependency lock'", [(d.isin(b, rules.LOCKS), b)])
        tier("inventory_only", "'distribution artifact'", [(any_of(d.ends(b, x) for x in (".min.js", ".min.css", ".map")), "'generated-distribution-suffix'")])
        tier("central_manifest", "'source, test or automation surface'", quoted(rules.CENTRAL_PREFIXES, lambda x: d.starts(p, x)))
        tier("central_manifest", "'type is never inline'", [("artifact_type IN ('source', 'test', 'script')", "'artifact:' || artifact_type")])
        tier("central_manifest", "'structured or executable format'", [(any_of([d.isin(b, rules.CENTRAL_BASENAMES), d.isin(e, rules.CENTRAL_EXTENSIONS)]), b)])
        tier("central_manifest", "'no prose format'", [("strategy IN ('line-comment', 'block-comment', 'sidecar')", "'strategy:' || strategy")])
        allowed = [(d.m("path", paths.glob_anchored(g)), d.q(f"inline_allow:{g}")) for g in inline_allow]
        inline = d.isin("artifact_type", rules.INLINE_TYPES)
        why = f"CASE WHEN {b} = 'skill.md' THEN 'allowed skill entry point' ELSE 'allowed prose' END" if skills_mode else "'allowed prose'"
        tier("inline_managed", why, [(f"{c} AND {inline}", r) for c, r in allowed])
        tier("central_manifest", "'type not allowed inline'", allowed)
        last = "'inline needs an allow pattern'" if default == "inline_managed" else "'default carrier'"
        return {
            "carrier": case([(c, f"'{k}'") for c, k, _, _ in rows], "'central_manifest'"),
            "carrier_reason": case([(c, w) for c, _, w, _ in rows], last),
            "carrier_rule": case([(c, r) for c, *_, r in rows], f"'default_carrier:{default}'"),
        }

    return cols


def placement(root: str = "", threshold: str = "low", namespace: str = paths.NAMESPACE) -> Cols:
    """Where a file of its class belongs; unknown and too unsure ones go to quarantine. Nothing is moved."""
    if threshold not in RANK:
        threshold = "low"
    inside = "/".join(s for s in root.replace("\\", "/").split("/") if s not in ("", ".", ".."))

    def cols(d: Dialect) -> dict[str, str]:
        bad = any_of(["semantic_class = 'unknown'", *(f"semantic_confidence = '{c}'" for c, r in RANK.items() if r <= RANK[threshold])])
        join = lambda x: "/".join(s for s in (inside, x) if s not in ("", "."))
        target = case([(bad, d.q(join(rules.QUARANTINE)))] + [(f"semantic_class = '{k}'", d.q(join(v[0]))) for k, v in rules.CLASSES.items()])
        return {
            "quarantined": bad,
            "layer": case([(bad, "'quarantine'")] + [(f"semantic_class = '{k}'", f"'{v[1]}'") for k, v in rules.CLASSES.items()]),
            "target_directory": target,
            "target_path": f"CASE WHEN {target} = '' THEN base ELSE {target} || '/' || base END",
            "placement_namespace": d.q(namespace),
        }

    return cols


def authority_candidate(d: Dialect) -> dict[str, str]:
    """authority_candidate: control files, control directories, names that suggest a metadata writer."""
    verbs = "inject|verify|write|writer|generate|sync"
    names = ("package.json", "Makefile", "makefile", "GNUmakefile", ".pre-commit-config.yaml", ".pre-commit-config.yml")
    where = tuple(x + "/" for x in ".github/workflows .github/actions .githooks .husky scripts bin tools".split())
    skipped = d.m("path", r"(^|/)(\.git|\.venv|__pycache__|build|coverage|dist|docs|fixtures?|node_modules|reports|tests?)/")
    odd = d.m("base", rf"(?i)({verbs})[-_.a-z0-9]*meta(data)?|meta(data)?[-_.a-z0-9]*({verbs})")
    return {"suspicious_name": odd, "authority_candidate": f"NOT {skipped} AND {any_of([d.isin('base', names), *(d.starts('path', w) for w in where), odd])}"}


def carriers(artifacts: DataFrame, inline_allow: tuple[str, ...] = (), default: str = "central_manifest", skills_mode: bool = False) -> DataFrame:
    """Decisions for (path, body, artifact_type) rows."""
    return add(artifacts, *PARTS, strategy, carrier(inline_allow, default, skills_mode))


def omitted(artifacts: DataFrame, patterns: tuple[str, ...] = (), protect_skill: bool = True) -> DataFrame:
    return add(artifacts, paths.parts, omit(patterns, protect_skill))


def ledger(artifacts: DataFrame, patterns: tuple[str, ...] = (), extension: str | None = None) -> DataFrame:
    """One disposition for each regular file, with the reason."""
    return add(artifacts, *PARTS, strategy, omit(patterns), disposition(patterns, extension), reasons)


def discovery_summary(entries: DataFrame) -> DataFrame:
    """Every disposition with its count, zeros included, and whether it blocks a run."""
    every = entries.sparkSession.createDataFrame([(x, x in rules.BLOCKING) for x in rules.DISPOSITIONS], "disposition string, blocking boolean")
    n = entries.groupBy("disposition").count()
    return F.broadcast(every).join(n, "disposition", "left").select("disposition", "blocking", F.coalesce("count", F.lit(0)).alias("n"))
