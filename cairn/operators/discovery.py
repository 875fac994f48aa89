"""Every entry of a tree with one disposition: files, folders, links, what can't be read, what isn't supported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import rules
from cairn.functions.dialect import SPARK, add, any_of, case

from . import policy
from .classify import PARTS, strategy

CONTROL = f"^{rules.CONTROL.replace('.', '[.]')}(/|$)"


def omit_test(x: str, patterns: tuple[str, ...] = (), protect_skill: bool = True, ignore_dirs: tuple[str, ...] = ("node_modules",)) -> str:
    """Whether the omit rules leave out the path in the expression ``x``: the last pattern that matches decides."""
    every = [*rules.NOISE, *(rules.SKILL_PROTECT if protect_skill else ()), *(f"{n}/" for n in ignore_dirs), *patterns]
    pairs = [(SPARK.m(x, r"(?i)(^|/)skill\.md$"), "true")] if protect_skill else []
    for p in reversed([p.strip() for p in every if p.strip() and not p.strip().startswith("#")]):
        negate = p.startswith("!")
        pairs.append((SPARK.m(x, policy.omit_regex(p[negate:])), "false" if negate else "true"))
    return case(pairs, "false")


def closed(x: str, patterns: tuple[str, ...], protect_skill: bool = True) -> str:
    """Whether the folder in ``x`` isn't entered: generated, omitted or hidden."""
    omitted = lambda y: omit_test(y, patterns, protect_skill)
    return any_of([SPARK.m(x, CONTROL), omitted(x), omitted(f"concat({x}, '/')"), SPARK.m(x, r"(^|/)\.")])


def tree_ledger(entries: DataFrame, patterns: tuple[str, ...] = (), extension: str | None = None, protect_skill: bool = True) -> DataFrame:
    """path, kind, disposition, reason, size_bytes of the (path, kind, size_bytes, content, error) rows of a tree.

    Each entry that a walk meets has one row; what lies in a folder that isn't entered has none. A link is never
    followed. A file with a text extension is eligible on that alone; others are judged by their bytes: 8192 of them,
    where a NUL makes a file binary and what isn't UTF-8 an unsupported encoding.
    """
    from cairn.sources.tree import text_probe

    above = "filter(transform(sequence(1, size(split(path, '/'))), k -> array_join(slice(split(path, '/'), 1, k - 1), '/')), p -> p <> '')"
    met = entries.where(~F.expr(f"exists({above}, p -> {closed('p', patterns, protect_skill)})"))
    df = text_probe(met).withColumn("body", F.lit("")).withColumn("is_dir", F.col("kind") == "directory")
    df = add(df, *PARTS, strategy)
    folder, own = "kind = 'directory'", omit_test("path", patterns, protect_skill)
    known = any_of([SPARK.isin("lext", rules.FRONTMATTER), "strategy IN ('line-comment', 'block-comment')"])
    table: list[tuple[str, str, str]] = [
        ("kind = 'symlink'", "symlink", "'a link is neither followed nor changed'"),
        (f"error IS NOT NULL AND ({folder} OR kind = 'other')", "unreadable", "error"),
        (SPARK.m("path", CONTROL), "generated_artifact", "'reserved for what a run writes'"),
        (f"{folder} AND ({own} OR {omit_test(chr(99) + 'oncat(path, ' + chr(39) + '/' + chr(39) + ')', patterns, protect_skill)})", "omitted", "'folder matched an omit pattern'"),
        (f"{folder} AND {SPARK.m('path', chr(40) + '^|/)[.]')}", "hidden_control", "'hidden control folder'"),
        (folder, "traversed_directory", "'folder entered'"),
        ("kind <> 'file'", "unsupported_entry", "'neither file, folder nor link'"),
        (any_of(SPARK.ends("base", s) for s in rules.GENERATED), "generated_artifact", "'written by an earlier run'"),
        (own, "omitted", "'matched an omit pattern'"),
        (SPARK.m("path", r"(^|/)\."), "hidden_control", "'hidden control surface'"),
        *([(f"NOT {SPARK.ends('lbase', extension.lower())}", "extension_filtered", "'not the wanted extension'")] if extension else []),
        (SPARK.isin("lext", rules.BINARY), "known_binary", "'binary by extension'"),
        (known, "eligible", "'text by extension'"),
        ("probe = 'binary'", "binary_detected", "'NUL byte found'"),
        ("probe = 'unsupported_encoding'", "unsupported_encoding", "'not UTF-8'"),
        ("probe = 'unreadable'", "unreadable", "coalesce(error, 'content not read')"),
    ]
    return df.select(
        "path", "kind", F.expr(case([(c, f"'{d}'") for c, d, _ in table], "'eligible'")).alias("disposition"), F.expr(case([(c, r) for c, _, r in table], "'text by its first bytes'")).alias("reason"), "size_bytes",
    )


def blocking(ledger: DataFrame) -> DataFrame:
    """The rows that forbid a run: what it can't see whole, it doesn't change."""
    return ledger.where(F.col("disposition").isin(*rules.BLOCKING))


def ordered(ledger: DataFrame) -> DataFrame:
    """By path and disposition, in the order of words: case and accents decide only between equals."""
    return ledger.orderBy(F.expr("collate(path, 'UNICODE')"), "disposition")
