"""Sources, sinks, streams and the registry."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.functions.dialect import add
from cairn.operators import dedup, discovery, meta, skills
from cairn.plans import pipeline
from cairn.sinks import files, reports
from cairn.sources import archives, control, tree
from cairn.streaming import incremental


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for p, data in {"docs/a.md": b"# A\nbody\n", "_shared/k.md": b"runtime engine\n", ".github/w.yml": b"x: 1\n", "src/app.ts": b"let a\n", "empty.md": b"", "bin.dat2": b"a\0b", "bad.qq": b"\xff\xfe\xfd", "node_modules/x/y.js": b"z", "twin.txt": b"same", "twin2.txt": b"same"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(data)
    os.symlink(root / "docs", root / "link")
    return root


def test_tree_has_every_entry_once(spark, repo):
    rows = {r["path"]: r for r in tree.text_probe(tree.read_tree(spark, str(repo))).collect()}
    assert set(rows) == {"docs", "docs/a.md", "_shared", "_shared/k.md", ".github", ".github/w.yml", "src", "src/app.ts", "empty.md", "bin.dat2", "bad.qq", "twin.txt", "twin2.txt", "link"}
    assert rows["link"]["kind"] == "symlink" and rows["empty.md"]["content"] == b"" and rows["empty.md"]["probe"] == "text"
    assert rows["bin.dat2"]["probe"] == "binary" and rows["bad.qq"]["probe"] == "unsupported_encoding" and rows["docs"]["probe"] == "unreadable"


def test_probe_allows_a_character_cut_at_the_end(spark):
    df = spark.createDataFrame([(1, b"a" * 8191 + "é".encode() * 3), (2, b"a" * 8190 + b"\xff" + b"a" * 50), (3, b"a" * 8190 + "🙂".encode())], "id long, content binary")
    assert {r["id"]: r["probe"] for r in tree.text_probe(df).collect()} == {1: "text", 2: "unsupported_encoding", 3: "text"}


def zipped(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/"), content)
    return data.getvalue()


def test_archives(spark):
    deep = zipped(**{"x.md": "deep"})
    for _ in range(4):
        deep = zipped(**{"in.zip": deep})
    outer = zipped(**{"a__b.md": "text", "..__evil.md": "no", "n.zip": deep})
    got = [tuple(r) for r in archives.expand(spark.createDataFrame([("o.zip", outer), ("bad.zip", b"nothing"), ("none.zip", None)], "path string, content binary")).collect()]
    by = {(r[0], r[1]): r for r in got}
    assert by["o.zip", "a/b.md"][4] == b"text" and by["o.zip", "../evil.md"][5] == "leaves the archive" and by["o.zip", "../evil.md"][4] is None
    assert max(r[2] for r in got) == 3 and by["bad.zip", None][5]


def test_small_archives_share_a_batch(monkeypatch):
    some = [(f"{i}.zip", zipped(**{"a.txt": "x" * i})) for i in range(300)] + [("none.zip", None), ("bad.zip", b"nothing")]
    read = pa.RecordBatch.from_pydict({"path": [p for p, _ in some], "content": pa.array([c for _, c in some], pa.binary())})
    want = [tuple(m) for p, c in some if c is not None for m in archives.members(p, c)]
    got = list(archives.rows(iter([read, read])))
    assert len(got) == 1 and [tuple(r.values()) for r in got[0].to_pylist()] == want * 2
    slim = list(archives.rows(iter([read]), content=False))
    assert [tuple(r.values()) for b in slim for r in b.to_pylist()] == [(*m[:4], m[5]) for m in want]
    monkeypatch.setattr(archives, "BATCH_BYTES", 1000)
    parts = list(archives.rows(iter([read])))
    assert [tuple(r.values()) for b in parts for r in b.to_pylist()] == want and all(sum(map(len, filter(None, b.column("content").to_pylist()))) < 1300 for b in parts)


STAGES = ("prepared", "staged", "committing", "backup:0", "replaced:0", "backup:1", "replaced:1", "validating")


@pytest.mark.parametrize("stage", STAGES)
@pytest.mark.parametrize("dead", [False, True])
def test_a_fault_at_any_stage_leaves_all_as_it_was(tmp_path, stage, dead, monkeypatch):
    (tmp_path / "a").write_text("old")

    def fault(at):
        if at == stage:
            raise OSError("fault")

    intents = [files.Intent("a", b"new", files.sha(b"old")), files.Intent("b/c", b"made", None)]
    if dead:
        monkeypatch.setattr(files, "_roll_back", lambda *a: None)
    with pytest.raises(OSError, match="fault"):
        files.commit(str(tmp_path), intents, fault=fault)
    monkeypatch.undo()
    files.recover(str(tmp_path))
    assert (tmp_path / "a").read_text() == "old" and not (tmp_path / "b/c").exists()
    assert files.commit(str(tmp_path), intents) == "committed" and (tmp_path / "b/c").read_text() == "made"
    assert files.commit(str(tmp_path), [files.Intent("a", b"new", files.sha(b"new"))]) == "unchanged"


def test_transactions_refuse(tmp_path):
    (tmp_path / "a").write_text("other")
    for bad in ([files.Intent("a", b"new", files.sha(b"old"))], [files.Intent("../x", b"", None)], [files.Intent("n", b"", None)] * 2):
        with pytest.raises(files.TransactionError):
            files.commit(str(tmp_path), bad)
    assert (tmp_path / "a").read_text() == "other"


def test_inventory_check_and_apply(spark, repo, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    n = pipeline.inventory(spark, str(repo), str(out)).count()
    assert n == 13 and "twin.txt" in (out / "inventory.md").read_text()
    (repo / "link").unlink()  # a link blocks an apply
    (repo / "docs/latin.md").write_bytes("caf\xe9\n".encode("latin-1"))
    before = {p: p.read_bytes() if p.is_file() else None for p in repo.rglob("*")}
    got = pipeline.check(spark, str(repo), ("docs/**",))
    assert got["changed"] and [(r["path"], r["kind"]) for r in got["shown"]] == [(files.INDEX, "missing"), ("docs/a.md", "stale")]
    assert {p: p.read_bytes() if p.is_file() else None for p in repo.rglob("*")} == before
    assert pipeline.apply(spark, str(repo), ("docs/**",))["files"] == 1
    assert (repo / "docs/latin.md").read_bytes() == "caf\xe9\n".encode("latin-1")
    header, body = (repo / "docs/a.md").read_text().split("\n---\n\n")
    assert header.startswith("---\nid: main.context.a\n") and body == "# A\nbody\n"
    records = files.parse_index((repo / files.INDEX).read_text())
    assert {"docs/a.md", "src/app.ts", "_shared/k.md"} <= {r["path"] for r in records}
    assert not pipeline.check(spark, str(repo), ("docs/**",))["changed"]
    assert pipeline.apply(spark, str(repo), ("docs/**",)) | {"sha256": 0} == {"files": 0, "transaction": "unchanged", "changed": False, "written": False, "missing": False, "sha256": 0}
    (repo / "docs/a.md").write_text(header + "\n---\n\nother body\n")
    assert [r["path"] for r in pipeline.check(spark, str(repo), ("docs/**",))["shown"]] == [files.INDEX, "docs/a.md"]


def test_files_that_are_no_text_are_told_apart_by_their_bytes(spark, tmp_path):
    for name, data in {"a.png": b"\x89\xff1", "b.png": b"\x89\xff2", "c.md": b"\xe9", "d.md": b"\xe9", "e.md": b"", "f.md": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = meta.inventory_records(tree.artifacts(tree.read_tree(spark, str(tmp_path))))
    clusters = dedup.duplicate_clusters(rows.withColumn("is_dir", F.lit(False)))
    assert sorted(r["keeper"] for r in clusters.collect()) == ["c.md", "e.md"]
    assert {r["path"]: r["content_hash"] for r in rows.collect()}["a.png"] == files.sha(b"\x89\xff1") and all(r["created_at"].endswith("Z") for r in rows.collect())


def test_every_entry_has_one_disposition(spark, repo):
    (repo / "node_modules/z").mkdir()
    (repo / ".meta").mkdir()
    (repo / ".meta/x.jsonl").write_text("x")
    (repo / "docs/a.md.inject.log").write_text("x")
    os.mkfifo(repo / "pipe")
    rows = discovery.tree_ledger(pipeline.entries(spark, str(repo)), ("src/",)).collect()
    got = {r["path"]: r["disposition"] for r in rows}
    assert len(rows) == len(got) and got == {
        "docs": "traversed_directory", "docs/a.md": "eligible", "docs/a.md.inject.log": "generated_artifact", "_shared": "traversed_directory", "_shared/k.md": "eligible", ".github": "hidden_control", "src": "omitted", "empty.md": "eligible",
        "bin.dat2": "binary_detected", "bad.qq": "unsupported_encoding", "twin.txt": "eligible", "twin2.txt": "eligible", "link": "symlink", "node_modules": "omitted", ".meta": "generated_artifact", "pipe": "unsupported_entry",
    }
    ledger = spark.createDataFrame(rows)
    assert {r["path"] for r in discovery.blocking(ledger).collect()} == {"link", "pipe"}
    order = [r["path"] for r in discovery.ordered(ledger).collect()]
    assert order.index("bad.qq") < order.index("docs") < order.index("twin.txt")
    with pytest.raises(RuntimeError, match="link"):
        pipeline.apply(spark, str(repo))


def test_a_header_that_is_lost_on_disk_is_seen(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: x\n---\n\nbody\n")
    (tmp_path / "b.md").write_text("body\n")
    (tmp_path / "c.py").write_text("# >>> meta >>>\n# id: x\n# <<< meta <<<\nbody\n")
    (tmp_path / "d.json").write_text("body\n")
    (tmp_path / "d.json.meta.yaml").write_text("---\nid: x\n---\n")
    h = files.sha(b"body\n")
    planned = [("a.md", "yaml-frontmatter", h), ("b.md", "yaml-frontmatter", h), ("c.py", "line-comment", h), ("d.json", "sidecar", h), ("gone.md", "yaml-frontmatter", h), ("a.md", "yaml-frontmatter", "other")]
    got = meta.verify_on_disk(spark.createDataFrame(planned, "path string, strategy string, content_hash string"), tree.read_tree(spark, str(tmp_path))).collect()
    assert sorted((r["path"], r["header_present"], r["body_preserved"]) for r in got) == [("a.md", True, False), ("a.md", True, True), ("b.md", False, True), ("c.py", True, True), ("d.json", True, True), ("gone.md", False, False)]


SOUND = """schema: meta-authority/v1  # which
writer:
  repository: "own/tool"
  ref: 'v1'
default_carrier: central_manifest
legacy_writers: forbidden
inline_allow: [docs/**, "a, b/*"]
validation_commands:
  - make check
"""


def test_authority_documents(tmp_path):
    got = control.parse_authority(SOUND)
    assert got == control.Authority("own/tool", "v1", "central_manifest", "forbidden", ("docs/**", "a, b/*"), ("make check",))
    for a, b in (("v1'", "v1"), ("forbidden", "allowed"), ("own/tool", "tool"), ("docs/**", "../docs"), ("docs/**", "/docs"), ("docs/**", "a//b"), ("  ref", "   ref"), ("  ref", "\tref"), ("meta-authority/v1", "v9"), ("legacy_writers: forbidden", "extra: 1"), ("legacy_writers: forbidden", "schema: x"), ("  - make check", "  - make check\n  - make check"), ("writer:", "writer: me"), ("docs/**", "!docs")):
        with pytest.raises(control.ControlError):
            control.parse_authority(SOUND.replace(a, b, 1))
    assert control.load_authority(str(tmp_path))[1][0][0] == "missing"
    (tmp_path / ".meta").mkdir()
    (tmp_path / control.AUTHORITY).write_text(SOUND)
    assert control.load_authority(str(tmp_path), repository="own/tool") == (got, [])
    assert control.load_authority(str(tmp_path), repository="other/tool")[1][0][0] == "writer_mismatch"
    assert control.load_authority(str(tmp_path), path="../x")[1][0][0] == "invalid"
    os.symlink(tmp_path / control.AUTHORITY, tmp_path / "linked.yaml")
    assert control.load_authority(str(tmp_path), path="linked.yaml")[1][0][0] == "not_regular"
    with pytest.raises(control.ControlError):
        control.authority_for("apply", None)
    assert control.resolve_mode("verify") == ("check", "verify is an older name of check") and control.resolve_mode(" apply ") == ("apply", None)
    with pytest.raises(control.ControlError):
        control.resolve_mode("other")


def test_omit_files_fail_closed(tmp_path):
    f = tmp_path / "omit"
    assert control.read_omit(str(f)) == ()
    with pytest.raises(control.ControlError):
        control.read_omit(str(f), required=True)
    f.write_text("# words\n\n vendor/ \r\n!keep.md\n")
    assert control.read_omit(str(f)) == ("vendor/", "!keep.md")
    os.symlink(f, tmp_path / "link")
    for bad, data in (("nul", b"a\0b"), ("latin", b"\xe9")):
        (tmp_path / bad).write_bytes(data)
    for bad in ("nul", "latin", "link", "."):
        with pytest.raises(control.ControlError):
            control.read_omit(str(tmp_path / bad))


def test_schemas_from_text(spark):
    got = control.parse_schema("schema_id: own\nversion: '1.2'\ntarget: [sidecar]\nfields:\n  - name: id\n    source: artifact_id\n    required: true\n  - name: owner  # who\n    default: nobody\n  - name: live\n    default: false\n")
    assert got.fields == (meta.Field("id", "artifact_id", None, True), meta.Field("owner", None, "nobody"), meta.Field("live", None, "false")) and got.version == "1.2"
    assert control.includes(got, "sidecar") and not control.includes(got, "manifest") and control.includes(None, "manifest")
    row = add(spark.createDataFrame([("a",), ("",)], "artifact_id string"), meta.schema_projection(got.fields)).collect()
    assert [tuple(r)[1:] for r in row] == [("a", "nobody", "false", []), ("", "nobody", "false", ["id"])]
    for bad in ("fields:\n  - name: x\n", "schema_id: a\n", "schema_id: a\nfields: []\n", "schema_id: a\nfields:\n  - source: x\n", "schema_id: a\nfields:\n  - name: x\nmap:\n  a: 1\n    b: 2\n"):
        with pytest.raises(control.ControlError):
            control.parse_schema(bad)


def test_index_lines_are_read_by_the_executors(spark, tmp_path):
    lines = [json.dumps({"n": i, "path": f"p{i:03d}"}, separators=(",", ":")) for i in range(40)]
    (tmp_path / "good").write_text("\n".join(lines) + "\n")
    (tmp_path / "bad").write_text("\n".join([lines[1], lines[0], lines[2], lines[2], lines[3].replace(":", ": ", 1), "nothing"]) + "\n")
    assert control.read_index(spark, str(tmp_path / "good"), "n int, path string").where("problem IS NOT NULL").count() == 0
    got = control.read_index(spark, str(tmp_path / "bad"), "n int, path string").collect()
    assert sorted((r["line"], r["problem"]) for r in got if r["problem"]) == sorted([(lines[0], "out of order"), (lines[2], "out of order"), (lines[3].replace(":", ": ", 1), "not canonical"), ("nothing", "not canonical")])


def test_reports_and_sidecars(spark, repo, tmp_path):
    (repo / "z.zip").write_bytes(zipped(a="x"))
    out = tmp_path / "out"
    out.mkdir()
    (repo / "docs/.meta.yaml").write_text("mine\n")
    pipeline.inventory(spark, str(repo), str(out), sidecars=True)
    state = {r["target"]: r["state"] for r in spark.read.json(f"{out}/sidecars").collect()}
    assert state["docs/.meta.yaml"] == "kept" and (repo / "docs/.meta.yaml").read_text() == "mine\n"
    assert state["z.zip.meta.yaml"] == "written" and "schema: \"archive-sidecar/v1\"" in (repo / "z.zip.meta.yaml").read_text() and "docs/a.md.meta.yaml" not in state
    row = pipeline.write_all(spark, str(repo), str(tmp_path / "all"))
    assert row["scanned"] == row["eligible"] and row["entries"] > row["eligible"] and json.loads((tmp_path / "all/coverage-report.json").read_text()) == row
    assert {p.name for p in (tmp_path / "all").iterdir() if p.is_dir()} >= {*reports.TABLES, "coverage-skipped", "authority-conflicts"}
    text = (tmp_path / "all/dedup-report.md").read_text()
    assert "  - twin.txt\n  - twin2.txt\n" in text
    names = spark.createDataFrame([("a/B c.md", "B c.md", "b-c.md"), ("d", "d", "d")], "path string, base string, normalized_name string")
    (log,) = reports.rename_logs(names).collect()
    assert log["sidecar"] == "a/B c.md.normalize.log" and 'normalized: "b-c.md"' in log["log"] and "status: pending_rename" in log["log"]
    changes = spark.createDataFrame([("a", "x", "keep", "1", "2"), ("b", "x", "keep", "1", "2"), ("b", "y", "revise", "1", "2")], "path string, field string, action string, old string, new string")
    assert [(r["path"], r["sidecar"]) for r in reports.inject_logs(changes).collect()] == [("b", "b.inject.log")]


def test_skills_end_to_end(spark, tmp_path):
    root = tmp_path / "r"
    texts = {"a": "---\nname: a\n---\nbody a\n", "b": "---\nname: b\ndescription: Use when a plan needs a second reader and nobody else is there\nactivation_signals: plan\n---\nbody\n", "c": "plain\n", "d": "---\nname: &x d\n---\nbody\n"}
    for k, t in texts.items():
        (root / "skills" / k).mkdir(parents=True)
        (root / "skills" / k / "SKILL.md").write_text(t)
    (root / "other.md").write_text("---\nname: o\n---\n")

    def ask(q: pd.Series) -> pd.Series:
        return q.map(lambda x: None if x is None else "plan, review" if x.endswith("Signals:") else "Reads a plan line by line. Use when a plan needs a reader.")

    assert pipeline.improve_skills(spark, str(root), str(tmp_path / "o")) == {"considered": 4, "changed": 0, "unchanged": 4}
    got = pipeline.improve_skills(spark, str(root), str(tmp_path / "o"), ask, dry_run=False)
    assert got == {"considered": 4, "changed": 2, "unchanged": 2, "transaction": "committed"} and json.loads((tmp_path / "o/skills-report.json").read_text())["changed"] == 2
    now = {k: (root / "skills" / k / "SKILL.md").read_text() for k in texts}
    assert now["b"] == texts["b"] and now["d"] == texts["d"] and (root / "other.md").read_text() == "---\nname: o\n---\n"
    assert now["a"] == "---\nname: a\ndescription: Reads a plan line by line. Use when a plan needs a reader.\nactivation_signals:\n  - plan\n  - review\n---\nbody a\n"
    assert now["c"].startswith("---\ndescription:") and now["c"].endswith("---\n\nplain\n")
    assert pipeline.improve_skills(spark, str(root), str(tmp_path / "o"), ask)["changed"] == 0


def test_assist_says_how_it_came_by_a_value(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight", "b"), (2, "short", "b"), (3, None, "silent")], "k int, seed string, body string")
    ask = lambda q: q.map(lambda x: None if x is None else " told " if "silent" not in x else "Unknown")
    got = {r["k"]: (r["value"], r["path"]) for r in skills.assist(df, "input_contract", "seed", ask).collect()}
    assert got == {1: ("one two three four five six seven eight", "heuristic"), 2: ("told", "ok"), 3: ("Unknown", "failed")}
    assert {r["path"] for r in skills.assist(df, "description", "seed").collect()} == {"heuristic", "no_adapter"}
    assert skills.assist(df.where("k = 1"), "description", "seed", ask, skill=True).first()["path"] == "ok"  # good, but without a trigger
    cut = df.select(skills.question("output_contract", "body").alias("q")).first()["q"]
    assert cut.endswith("\nb\nOutput:")


def test_index_is_canonical():
    good = json.dumps({"a": 1, "path": "a"}, separators=(",", ":")) + "\n"
    assert files.parse_index(good) and files.parse_index("") == []
    for bad in (good[:-1], good.replace(":1", ": 1"), good + good):
        with pytest.raises(ValueError):
            files.parse_index(bad)


def test_command_line_refuses(tmp_path):
    for argv in (["inventory", str(tmp_path)], ["inventory", str(tmp_path), "--out", str(tmp_path / "x")], ["check", str(tmp_path / "none")]):
        with pytest.raises(SystemExit):
            cli.main(argv)


def test_stream_keeps_the_latest_of_each_path(spark, tmp_path):
    source, schema = tmp_path / "in", "path string, body string, modified_at string"
    spark.createDataFrame([("a.md", "one", "1"), ("b.md", "two", "1")], schema).write.parquet(str(source))
    for rows in ([], [("a.md", "three", "2"), ("b.md", "late", "0")]):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        incremental.run(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["path"]: r["modified_at"] for r in incremental.state(spark, str(tmp_path / "out")).collect()}
    assert got == {"a.md": "2", "b.md": "1"}


def test_every_query_has_its_columns_named(spark):
    import __spark_entry__ as entry
    from cairn import registry

    assert set(registry.ORACLE) <= set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
