"""Operators by tables of cases."""

from __future__ import annotations

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import paths, text
from cairn.functions.dialect import SPARK, add
from cairn.operators import classify, dedup, frontmatter, ledger, meta, policy, reconcile


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_path(df, *columns):
    return {r["path"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


CLASSIFIED = [
    ("x/main.skill.foo.md", "", "skill", "high"),
    ("Prompt-Any.txt", "", "prompt", "high"),
    ("src/test_engine.ts", "runtime engine sandbox", "source", "low"),
    ("docs/decisions/001-engine.md", "test fixture mock", "doctrine", "high"),
    ("skills/a.md", "", "skill", "high"),
    ("notes/a.md", "", "context", "low"),
    ("notes/b.md", "the runtime engine", "kernel", "medium"),
    ("notes/tool-search.md", "a script for it", "context", "low"),
    ("notes/c.md", "test fixture", "test", "medium"),
    ("notes/d.md", "test spec for the engine", "kernel", "low"),
    ("notes/e.md", "contest inspect", "context", "low"),
]


def test_classification_cascade(spark):
    df = frame(spark, [(p, b) for p, b, *_ in CLASSIFIED], "path string, body string")
    assert by_path(classify.classify(df), "artifact_type", "confidence") == {p: (t, c) for p, _, t, c in CLASSIFIED}


def test_family_and_signals(spark):
    df = frame(spark, [("a.md", "build and review the plan; legal search, compile, route"), ("b.md", "nothing here")], "path string, body string")
    got = by_path(classify.classify(df), "family", "signals")
    assert got == {"a.md": ("auditor", ["review", "compile", "build", "plan", "search", "route"]), "b.md": ("Unknown", [])}


SEMANTIC = {
    "a/types.d.ts": "type_definitions", "a/x.test.ts": "test_suite", "tests/y.py": "test_suite", "a/user.schema.json": "schema", "CHANGELOG.md": "changelog", "api.contract.md": "contract",
    "package.json": "build_manifest", "manifest.md": "documentation", "dist/x.js": "build_artifact", "prompts/x.md": "prompt_template", "a.skill.md": "skill_definition", "policy.md": "governance_doctrine",
    "ci/pipeline.yaml": "pipeline", "examples/a.js": "fixture", "run.sh": "script", "tsconfig.base.json": "configuration", ".eslintrc": "configuration", "a/b.md": "documentation", "src/a.mjs": "source_module", "a/b.zzz": "unknown",
}


def test_semantic_classes_and_placement(spark):
    df = frame(spark, [(p, "") for p in SEMANTIC], "path string, body string")
    got = add(classify.semantic_classes(df), policy.placement("/../r/./s"))
    assert by_path(got, "semantic_class") == SEMANTIC
    where = by_path(got, "target_path", "quarantined")
    assert where["a/b.zzz"] == ("r/s/99_CONFLICTS_AND_UNKNOWN/b.zzz", True) and where["package.json"] == ("r/s/package.json", False) and where["src/a.mjs"] == ("r/s/src/a.mjs", False)
    strict = by_path(add(classify.semantic_classes(df), policy.placement(threshold="medium")), "quarantined")
    assert strict["src/a.mjs"] and not strict["a/b.md"]


INVENTORY = {
    "a/x.schema.json": ("schema", 0.92), "spec/a.py": ("test", 0.85), "Prompt_x.md": ("prompt", 0.85), "a.tgz": ("archive", 0.95), "p.pdf": ("research_pdf", 0.9), "a.kt": ("code", 0.9), "api-spec.md": ("spec", 0.7),
    "c.toml": ("config", 0.8), "notes/a.md": ("research_markdown", 0.75), "a/readme.md": ("documentation", 0.6), "a.docx": ("documentation", 0.7), ".gitignore": ("config", 0.85), "NOTICE": ("documentation", 0.75), "LICENSE-MIT": ("documentation", 0.8), "x.zzz": ("unknown", 0.2),
}


def test_inventory_types(spark):
    df = frame(spark, [(p, "", 3, False) for p in INVENTORY] + [("dir", "", 0, True)], "path string, body string, size_bytes long, is_dir boolean")
    got = by_path(meta.inventory_records(df), "inventory_type", "inventory_confidence")
    assert got == {**INVENTORY, "dir": ("folder", 1.0)}
    small = {r["path"]: r for r in meta.inventory_records(df, hash_max_bytes=2).collect()}
    assert small["a.kt"]["content_hash"] is None and "too_large" in small["a.kt"]["notes"] and small["dir"]["mime_type"] == "inode/directory" and small["x.zzz"]["notes"].startswith("unrecognized_extension:.zzz")


STRATEGY = {"a.md": ("yaml-frontmatter", None), "a.ts": ("line-comment", "//"), "a.sql": ("line-comment", "--"), "Dockerfile": ("line-comment", "#"), "a.html": ("block-comment", None), "a.json": ("sidecar", None), "a.txt": ("sidecar", None), "a.png": ("skip-binary", None)}


def test_strategies(spark):
    df = frame(spark, [(p, "x") for p in STRATEGY] + [("nul.md", "a\0b")], "path string, body string")
    got = by_path(classify.injection_strategies(df), "strategy", "line_prefix")
    assert got == {**STRATEGY, "nul.md": ("skip-binary", None)}


CARRIERS = [
    (".git/config", "source", "hard_skip"), ("a.md.meta.yaml", "context", "hard_skip"), ("x.png", "source", "hard_skip"), ("dist/a.md", "context", "inventory_only"), ("web/yarn.lock", "source", "inventory_only"), ("a/b.min.js", "source", "inventory_only"),
    ("src/a.md", "skill", "central_manifest"), ("docs/a.md", "source", "central_manifest"), ("docs/skill.md", "skill", "inline_managed"), ("other/a.md", "skill", "central_manifest"), ("docs/a.json", "context", "central_manifest"),
]


def test_carriers(spark):
    df = frame(spark, [(p, "x", t) for p, t, _ in CARRIERS], "path string, body string, artifact_type string")
    assert by_path(policy.carriers(df, ("docs/**",), "inline_managed"), "carrier") == {p: c for p, _, c in CARRIERS}
    assert by_path(policy.carriers(df, ("docs/**",)), "carrier_rule")["other/a.md"] == "default_carrier:central_manifest"


def test_omit_last_match_wins_and_skills_are_protected(spark):
    cases = {"a/x.pyc": True, "__pycache__/y.py": True, "a/SKILL.md": True, "vendor/a.md": True, "vendor/keep.md": False, "a/vendor/b": True, "src/a.log.md": False, "top.txt": True, "a/top.txt": False, "q1.md": True, "node_modules/a/b.js": True}
    df = frame(spark, [(p,) for p in cases], "path string")
    got = policy.omitted(df, ("vendor", "!vendor/keep.md", "/top.txt", "q?.md", "# note", ""))
    assert by_path(got, "omitted") == cases
    assert not by_path(policy.omitted(df, protect_skill=False), "omitted")["a/SKILL.md"]


def test_ledger_and_summary(spark):
    rows = [("a.md", "x"), (".meta/index", "x"), ("b.inject.log", "x"), (".hidden/c.md", "x"), ("d.png", "x"), ("e.zzz", "a\0"), ("f.zzz", "t"), ("g.pyc", "x")]
    led = policy.ledger(frame(spark, rows, "path string, body string"))
    got = by_path(led, "disposition")
    assert got == {"a.md": "eligible", ".meta/index": "generated_artifact", "b.inject.log": "generated_artifact", ".hidden/c.md": "hidden_control", "d.png": "known_binary", "e.zzz": "binary_detected", "f.zzz": "eligible", "g.pyc": "omitted"}
    summary = {r["disposition"]: (r["n"], r["blocking"]) for r in policy.discovery_summary(led).collect()}
    assert len(summary) == 12 and summary["eligible"] == (2, False) and summary["symlink"] == (0, True)
    assert by_path(policy.ledger(frame(spark, rows, "path string, body string"), extension=".md"), "disposition")["f.zzz"] == "extension_filtered"


NAMES = [("Prompt-LegalAnalysis.md", "legal_analysis", "LegalAnalysis", "Prompt-legal_analysis.md"), ("lint_file.md", "lint_file", "lint file", "lint_file.md"), ("myDoc v2.test.ts", "my_doc_v2", "myDoc v2 test", "my_doc_v2.test.ts"), ("Main.Skill.BigThing.md", "main_skill", "Main Skill BigThing", "main.skill.big_thing.md")]


def test_names(spark):
    df = add(frame(spark, [(n,) for n, *_ in NAMES], "path string"), *classify.PARTS, paths.stem, paths.title, paths.filename)
    assert by_path(df, "snake_stem", "title", "normalized_name") == {n: rest for n, *rest in ((n, *t) for n, *t in NAMES) for rest in [tuple(rest)]}


def test_path_validity(spark):
    cases = {"a/b": None, "/a": "not relative", "./a": "not relative", "a//b": "empty segment", "a/../b": "dot segment", "a\\b": "separator", "": "empty", "a/": "empty segment", "a/..b": None}
    assert by_path(add(frame(spark, [(p,) for p in cases], "path string"), paths.validity), "path_issue") == cases


def test_headers_and_sections(spark):
    body = "---\nid: x\n---\n\n## Role\n\nReader\n\n## Constraints\n- one\n* two \n\n## Other\n- three\n\n**Objective**: win\nmodel-target: big, small\n"
    rows = [("a", body), ("b", "key: value\n"), ("c", "| a | b |\n"), ("d", "x"), ("e", "---\nnever closed")]
    df = add(frame(spark, rows, "path string, body string"), text.split_header, text.header_convention, text.body_structure, text.extract_fields)
    got = {r["path"]: r for r in df.collect()}
    assert [got[p]["header_convention"] for p in "abcde"] == ["full-yaml", "bare-yaml", "prose-table", "none", "none"]
    a = got["a"]
    assert (a["role"], a["objective"], a["constraints"], a["model_target"], a["body_structure"]) == ("Reader", "win", ["one", "two"], "big", "sections") and a["stop_conditions"] is None
    assert got["d"]["body_structure"] == "flat"


@pytest.mark.parametrize("path", ["a.md", "b.py", "c.html", "d.json"])
def test_injection_keeps_the_body_and_a_second_run_changes_nothing(spark, path):
    rows = [(path, b) for b in ("#!/bin/x\nline\n", "plain\n", "", "#!only")]
    steps = [*meta.META_STEPS, *meta.HEADER_STEPS, meta.checks, meta.issues, meta.injection]
    first = add(frame(spark, rows, "path string, body string"), *steps).collect()
    assert all(r["body_preserved"] or r["strategy"] == "skip-binary" for r in first if r["raw"] != "#!only" and not (path == "a.md" and r["raw"] == ""))
    again = add(frame(spark, [(path, r["injected"]) for r in first if r["raw"] == "plain\n"], "path string, body string"), *steps).collect()
    assert [r["body"] for r in again] == ["plain\n"]
    if path != "d.json":
        assert not again[0]["would_change"]


def test_duplicates(spark):
    rows = [("bb/x", "h1", 10, False), ("a/x", "h1", 10, False), ("c/y", "h1", 10, False), ("d", "h2", 5, False), ("e", None, 5, False), ("f", "h3", 1, True), ("g", "h3", 1, True)]
    df = frame(spark, rows, "path string, content_hash string, size_bytes long, is_dir boolean")
    got = dedup.duplicate_clusters(df)
    assert [tuple(r) for r in got.collect()] == [("h1", 3, 20, "a/x")]
    assert sorted(tuple(r) for r in dedup.members(df, got).collect()) == [("h1", "a/x", True), ("h1", "bb/x", False), ("h1", "c/y", False)]
    assert tuple(dedup.recoverable(got).first()) == (1, 20) and tuple(dedup.recoverable(got.limit(0)).first()) == (0, 0)


def brute(rows, t):
    def grams(s):
        w = s.lower().split()
        return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {" ".join(w)} if w else set()

    out = set()
    keeper: dict[str, str] = {}
    for p, b in rows:
        keeper[b] = min(p, keeper.get(b, p), key=lambda x: (len(x), x))
    rows = [(p, b) for b, p in keeper.items()]
    for i, (p, b) in enumerate(rows):
        for q, c in rows[i + 1 :]:
            x, y = grams(b), grams(c)
            s = len(x & y) / len(x | y) if x and y else 0.0
            if b != c and s >= t:
                out.add((min(p, q), max(p, q), int(s * 1000 + 0.5) / 1000))
    return out


@pytest.mark.parametrize("t", [0, 0.4, 0.9, 1])
def test_near_duplicates_match_all_pairs(spark, t):
    base = [f"w{i % 7} w{i % 5} w{i}" for i in range(12)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[:-1])), ("c", " ".join(base)), ("d", " ".join(base[3:])), ("e", "one two"), ("f", "one  TWO"), ("g", ""), ("h", "other words that share nothing")]
    df = frame(spark, rows, "path string, body string").withColumn("content_hash", F.sha2("body", 256))
    assert {tuple(r) for r in dedup.near_duplicates(df, t).collect()} == brute(rows, t)


@pytest.mark.parametrize("ask", [dedup.near_duplicates, dedup.summary])
def test_near_copies_send_no_texts(spark, ask):
    """What is shuffled is less than the texts twice over: packed grams, and nothing for each shingle's own string."""
    rows = [(f"p{i}", " ".join(f"w{(i * 7919 + j * 104729) % 999983}" for j in range(400))) for i in range(300)]
    rows += [("near", rows[5][1] + " more"), ("spaced", rows[6][1].replace(" ", "  ")), ("upper", rows[6][1].upper())]
    df = frame(spark, rows, "path string, body string").withColumn("content_hash", F.sha2("body", 256))
    shuffled = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = shuffled()
    got = {tuple(r) for r in ask(df, 0.5).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == {(303, 303, 0, 4)} if ask is dedup.summary else {r[:2] for r in got} == {("near", "p5"), ("p6", "spaced"), ("p6", "upper"), ("spaced", "upper")}
    assert shuffled() - before < 2 * sum(len(b) for _, b in rows)


@pytest.mark.parametrize("t", [0, 0.4, 1])
def test_summary_counts_near_pairs_unnamed(spark, t):
    base = [f"w{i % 7} w{i % 5} w{i}" for i in range(12)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[:-1])), ("c", "  ".join(base)), ("d", " ".join(base).upper()), ("e", " ".join(base)), ("f", "one two"), ("g", "one  TWO"), ("h", ""), ("i", " ".join(base[1:]))]
    df = frame(spark, rows, "path string, body string").withColumn("content_hash", F.sha2("body", 256))
    assert tuple(dedup.summary(df, t).first()) == (9, 8, 1, len(brute(rows, t)))


def test_gate(spark):
    rows = [(1, "h", "p"), (2, "h", "q"), (3, "i", "p"), (4, "j", "r")]
    got = {r["seq"]: r["dedup_status"] for r in dedup.gate(frame(spark, rows, "seq long, content_hash string, output_path string")).collect()}
    assert got == {1: "unique", 2: "duplicate", 3: "collision", 4: "unique"}


LONG, LONGER = "one two three four five six seven eight", "one two three four five six seven eight nine ten eleven twelve"
FIELDS = [("description", "short", LONG, True, False, "revise"), ("description", LONG, LONGER, True, False, "revise"), ("description", LONGER, LONG, True, False, "keep"), ("content_hash", "a", "b", True, False, "keep"), ("content_hash", "a", "b", True, True, "replace"), ("owner", None, "x", False, False, "add"), ("triggers", "a, b", "b, c", True, True, "append-union"), ("triggers", "a, b", "b", True, False, "keep"), ("triggers", "a, Unknown", "b", True, False, "append-union"), ("triggers", "Unknown", "Unknown", True, False, "keep")]


def test_reconcile(spark):
    df = frame(spark, [(i, *f[:5]) for i, f in enumerate(FIELDS)], "k long, field string, old string, new string, has_old boolean, deprecated boolean")
    got = {r["k"]: r for r in reconcile.reconcile(df).collect()}
    assert [got[i]["action"] for i in range(len(FIELDS))] == [f[5] for f in FIELDS]
    assert got[6]["merged"] == "a, b, c" and got[2]["merged"] == LONGER and got[8]["merged"] == "a, Unknown, b" and got[9]["merged"] == "Unknown"

    def decide(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([True] * len(old))

    asked = {r["k"]: r for r in reconcile.reconcile_with(df, decide).collect()}
    assert (asked[2]["action"], asked[2]["path"], asked[2]["merged"]) == ("revise", "adapter", LONG) and asked[0]["path"] == "heuristic"


def test_ledger_relations(spark):
    e = frame(spark, [("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    a = frame(spark, [("a", "1"), ("b", "x")], "path string, hash string")
    assert {r["path"]: r["kind"] for r in ledger.drift(e, a).collect()} == {"b": "stale", "c": "missing"}
    assert {r["path"]: r["change"] for r in ledger.snapshot_diff(e, a, ["hash"]).collect()} == {"b": "changed", "c": "removed"}
    assert ledger.coverage_mismatch(e, a).collect()[0]["path"] == "c"
    lines = frame(spark, [(p, p * 3) for p in "abcdef"], "path string, line string")
    assert ledger.digest(lines).first() == ledger.digest(lines.repartition(5)).first()
    with pytest.raises(ValueError):
        ledger.canonical_lines(lines, ["generated_at"])


UNSAFE = {"--- \na: b\n---\n": "opening fence not exact", "---\na: b\n": "closing fence missing", "---\na: b\r\nc: d\n---\n": "mixed line ends", "---\na:\tb\n---\n": "tab", "---\na: 1\na: 2\n---\n": "duplicate key", "---\na: &x\n---\n": "complex", "---\n  a: b\n---\n": "complex", "---\nnot a key\n---\n": "invalid key", "---\na: b\n---\n---\nc: d\n---\n": "second block"}


def test_canonical_values_and_identity(spark):
    df = frame(spark, [("p", "t", "h", "c", -0.0, {"b": 1, "a": 2}), ("q", "t", "h", "c", 1.5, None)], "path string, artifact_type string, content_hash string, carrier string, x double, m map<string,int>").withColumn("schema", F.lit("s"))
    lines = {r["path"]: r["line"] for r in ledger.canonical_lines(df, ("x", "m")).collect()}
    assert '"metadata":{"m":{"a":2,"b":1},"x":0.0}' in lines["p"] and '"metadata":{"m":null,"x":1.5}' in lines["q"]
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="no number"):
            ledger.canonical_lines(df.withColumn("x", F.lit(bad)), ("x",)).collect()
    headers = meta.build_meta(frame(spark, [("a/b.md", "text")], "path string, body string"))
    assert meta.with_identity(headers) is headers
    with pytest.raises(ValueError, match="title: missing"):
        meta.with_identity(headers.drop("title"))
    with pytest.raises(ValueError, match="callable: string"):
        meta.with_identity(headers.withColumn("callable", F.lit("true")))


def test_frontmatter():
    assert {raw: frontmatter.inspect(raw).issue for raw in UNSAFE} == UNSAFE
    raw = "﻿---\r\n# note\r\nid: x # why\r\nlist:\r\n  - a\r\n  - b\r\n---\r\nbody\r\n"
    out, issue = frontmatter.patch(raw, {"list": ["c"], "new": "v: w"})
    assert issue is None and out == "﻿---\r\n# note\r\nid: x # why\r\nlist:\r\n  - c\r\nnew: \"v: w\"\r\n---\r\nbody\r\n"
    assert frontmatter.patch(out, {"list": ["c"], "new": "v: w"}) == (out, None)
    assert frontmatter.patch("body", {"a": 1}) == ("---\na: 1\n---\n\nbody", None)
    assert frontmatter.inspect("---\na: [1, x]\nb: \"q\\\"r\"\nc: true\nd: -1.5\ne: ~\n---\n").values == {"a": [1, "x"], "b": 'q"r', "c": True, "d": -1.5, "e": None}


def test_authority(spark):
    rows = [("package.json", "a\n run cairn now", "package.json", False), ("scripts/inject_meta.py", "x-meta\nwrite_text(out)", "inject_meta.py", True), ("scripts/b.sh", "ok", "b.sh", False), ("bin/c", "a\0", "c", False)]
    got = reconcile.authority_evidence(frame(spark, rows, "path string, body string, base string, suspicious_name boolean"))
    found = {(r["path"], r["kind"]): (r["line"], r["excerpt"]) for r in got.collect()}
    assert found == {("package.json", "canonical_invocation"): (2, "run cairn now"), ("scripts/inject_meta.py", "writer_script"): (2, "write_text(out)"), ("scripts/inject_meta.py", "legacy_marker"): (1, "x-meta"), ("bin/c", "gap"): (1, "a\0")}
    assert reconcile.conflicts(got).count() == 3


def test_authority_pins_and_gaps(spark):
    files = frame(spark, [("Makefile", "use: own/cairn@" + "0a" * 20, "Makefile", False), ("bin/x", "own/cairn@main", "x", False)], "path string, body string, base string, suspicious_name boolean")
    assert [(r["path"], r["kind"]) for r in reconcile.authority_evidence(files).collect()] == [("Makefile", "canonical_invocation")]
    rows = [("Makefile", "symlink", None, None), ("scripts/a", "file", 5, "no access"), ("scripts/b", "file", 1 << 21, None), ("scripts/c", "file", 5, None), ("docs/a", "symlink", None, None), ("x", "directory", None, "no access")]
    gaps = reconcile.authority_gaps(frame(spark, rows, "path string, kind string, size_bytes long, error string"))
    assert {(r["path"], r["rule"]) for r in gaps.collect()} == {("Makefile", "link"), ("scripts/a", "unreadable"), ("scripts/b", "unreadable"), ("x", "unlisted")}
    assert {r["code"] for r in reconcile.conflicts(gaps).collect()} == {"SCAN_INCOMPLETE"}


def test_authority_has_all_markers_and_open_for_write(spark):
    rows = [("bin/a", "ARTIFACT_META\nCAIRN_META x-meta\nwith open(out, 'w') as f:", "a", True), ("bin/b", 'ARTIFACT_META\nopen(p, "r")', "b", True), ("bin/c", 'open(p, "wb")', "c", True), ("bin/d", "a.b\naxb > meta", "d", False)]
    df = frame(spark, rows, "path string, body string, base string, suspicious_name boolean")
    got = {(r["path"], r["rule"]): r["line"] for r in reconcile.authority_evidence(df).collect()}
    assert got == {("bin/a", "writer-name-with-write"): 3, ("bin/a", "marker-artifact-meta"): 1, ("bin/a", "marker-x-meta"): 2, ("bin/a", "marker-cairn-meta"): 2, ("bin/c", "writer-name-with-write"): 1}
    assert {(r["path"], r["rule"], r["line"]) for r in reconcile.authority_evidence(df, markers=("a.b",)).collect() if r["kind"] == "legacy_marker"} == {("bin/d", "marker-a.b", 1)}


def test_authority_query_reads_whole_bodies(spark, tmp_path):
    from cairn import registry

    docs = [(i, "some prose. " * 100 + "\nyaml.safe_dump(x)", "en", "s", 0) for i in (30, 34)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["rule"], r["line"], r["excerpt"]) for r in registry.QUERIES["authority_evidence"](spark, str(tmp_path)).collect()}
    assert ("writer-name-with-write", 3, "yaml.safe_dump(x)") in got
    assert any(rule == "marker-x-meta" and line == 4 for rule, line, _ in got)


def test_queries_of_values_meet_whole_texts(spark, tmp_path):
    from cairn import registry

    docs = [(i, "some prose here. " * 40 + "the last word", "en", "s", 0) for i in (1, 2, 3, 4, 6, 8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda q: registry.QUERIES[q](spark, str(tmp_path)).collect()
    assert all(r["parsed"].endswith("|the last word") for r in run("signal_list"))
    assert all(r["question"].count("the last word") == 2 for r in run("materiality_reply"))
    described = [r for q in ("reconcile", "reconcile_llm") for r in run(q) if r["field"] == "description"]
    assert all(r["merged"].endswith("the last word") for r in described if r["merged"] != "short") and {"keep", "revise"} <= {r["action"] for r in described}
    assert all("the last word" in r["log"] for r in run("diff_log"))


def test_schema_projection(spark):
    fields = [meta.Field("a", "x", "d"), meta.Field("b", "x", required=True), meta.Field("c", None, "e"), meta.Field("z")]
    df = add(frame(spark, [("v",), ("",), (None,)], "x string"), meta.schema_projection(fields))
    got = sorted((r["m_a"], r["m_b"] or "", r["m_c"], r["m_z"], r["missing_required"]) for r in df.collect())
    assert got == [("d", "", "e", None, ["b"]), ("d", "", "e", None, ["b"]), ("v", "v", "e", None, [])]


def test_token_estimate_counts_utf16(spark):
    df = add(frame(spark, [("",), ("abcde",), ("🙂🙂🙂",)], "body string"), text.token_estimate, text.content_hash)
    assert sorted((r["body"], r["token_estimate"]) for r in df.collect()) == sorted([("", 1), ("abcde", 2), ("🙂🙂🙂", 2)])
    assert df.first()["content_hash"] == hashlib.sha256(b"").hexdigest()
    assert SPARK.q("a'b") == "'a\\'b'"


def test_a_wrong_rule_parts_a_query_from_its_sql(spark, tmp_path, monkeypatch):
    """The SQL of the cascades is of another make: a slip in the queries' tables or expressions shows."""
    import duckdb

    from cairn import registry
    from cairn.functions import rules

    texts = ["audit the build", "plan a kernel runtime", "legal clause", "script utility helper", "test spec mock", "nothing", "tool script", "policy", "workflow process", "route"]
    frame(spark, [(i, f"{texts[i % 10]} {i}") for i in range(1200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")

    def agree(name):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE[name]})").fetchall()
        return sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))

    assert all(agree(n) for n in ("classify", "carrier_decision", "omit_filter", "reconcile"))
    monkeypatch.setattr(rules, "FAMILIES", dict(reversed(rules.FAMILIES.items())))
    monkeypatch.setattr(rules, "STRONG", {"test": ("spec",), "script": ("tool",)})
    monkeypatch.setattr(rules, "NOISE", ())
    monkeypatch.setattr(rules, "CENTRAL_PREFIXES", ("srcs/",))
    monkeypatch.setattr(rules, "UNION_FIELDS", ("triggers",))
    assert not any(agree(n) for n in ("family", "classify", "carrier_decision", "reconcile"))


def test_the_keyword_window_ends_after_800_utf16_units(spark):
    wide = "\U0001f600" * 395  # 790 units in 395 characters
    rows = [("a/x.md", wide + " kernel runtime"), ("a/y.md", wide + "ab audit"), ("a/z.md", "x" * 790 + " audit")]
    got = {r["path"]: (r["family"], r["signals"]) for r in classify.classify(frame(spark, rows, "path string, body string")).collect()}
    assert got == {"a/x.md": ("meta_kernel_forge", ["kernel"]), "a/y.md": ("auditor", ["audit"]), "a/z.md": ("auditor", ["audit"])}


def test_signals_are_looked_up_once(spark):
    """The words are cut up outside of lambdas, in which they would be cut up again for each item."""
    rows = [("a.md", "lint scan, audit: law"), ("b.md", None), ("c.md", "nothing"), ("d.md", "x " * 399 + "\U0001f600 build"), ("e.md", "x " * 396 + " \U0001f600build")]
    df = add(frame(spark, rows, "path string, body string"), *classify.PARTS, classify.found, classify.signals).select("path", "signals")
    assert by_path(df, "signals") == {"a.md": ["audit", "lint", "scan", "law"], "b.md": [], "c.md": [], "d.md": [], "e.md": ["build"]}
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_window_of_units(spark):
    bodies = ["", "ab", "\U0001f600", *(x * n + y for x in ("a", "\U0001f600", "a\U0001f600", "\ud7ff\ue000") for n in (2, 3, 4, 5) for y in ("", "b", "\U0001f600", "\U0001f600b"))]
    for r in frame(spark, [(b,) for b in bodies], "body string").selectExpr("body", *(f"{classify.window(SPARK, n)} AS w{n}" for n in (1, 4, 5))).collect():
        for n in (1, 4, 5):
            assert r[f"w{n}"] == r["body"].encode("utf-16-le")[: 2 * n].decode("utf-16-le", "ignore")
