"""python -m cairn.cli inventory|check|apply|skills|pipeline ROOT [--out DIR] [--inline-allow GLOB ...] [--omit GLOB ...] [--write]

check and apply take carriers and allowed paths from the tree's authority document, if it has one; with --authority they need it.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from cairn.plans import pipeline
from cairn.session import ship
from cairn.sources import control


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("mode")
    p.add_argument("root")
    p.add_argument("--out")
    p.add_argument("--inline-allow", nargs="*", default=[])
    p.add_argument("--omit", nargs="*", default=[])
    p.add_argument("--omit-file")
    p.add_argument("--authority", action="store_true", help="refuse to run without the tree's authority document")
    p.add_argument("--writer", help="the writer that the authority document must name")
    p.add_argument("--write", action="store_true", help="skills: change the files")
    p.add_argument("--sidecars", action="store_true", help="inventory: write sidecars into the tree")
    p.add_argument("--ci", action="store_true", help="print key=value lines instead of JSON")
    a = p.parse_args(argv)
    try:
        mode, warning = control.resolve_mode(a.mode)
    except control.ControlError as e:
        p.error(str(e))
    if warning:
        print(warning, file=sys.stderr)
    root = os.path.realpath(a.root)
    if os.path.islink(a.root) or not os.path.isdir(root) or ".git" in root.split(os.sep):
        p.error(f"no directory, or not one to run on: {a.root}")
    inside = a.out and (os.path.realpath(a.out) + os.sep).startswith(root + os.sep)
    if mode in ("inventory", "skills", "pipeline") and (not a.out or inside):
        p.error(f"{mode} needs --out, outside the root")
    allow = tuple(a.inline_allow)
    try:
        omit = (*a.omit, *(control.read_omit(a.omit_file, required=True) if a.omit_file else ()))
        if mode in ("check", "apply"):
            authority, conflicts = control.load_authority(root, repository=a.writer)
            if a.authority or [c for c, _ in conflicts if c != "missing"]:
                if conflicts:
                    print(json.dumps({"passed": False, "conflicts": conflicts}))
                    return 2
                control.authority_for(mode, authority)
            if authority:
                allow = (*allow, *authority.inline_allow)
    except control.ControlError as e:
        p.error(str(e))
    spark = ship(SparkSession.builder.appName("cairn").getOrCreate())
    if mode == "inventory":
        out: dict[str, object] = {"records": pipeline.inventory(spark, root, a.out, a.sidecars).count()}
    elif mode == "skills":
        out = pipeline.improve_skills(spark, root, a.out, dry_run=not a.write)
    elif mode == "pipeline":
        out = dict(pipeline.write_all(spark, root, a.out, allow, omit))
    else:
        out = (pipeline.check if mode == "check" else pipeline.apply)(spark, root, allow, omit)
    print("\n".join(f"{k}={json.dumps(v) if isinstance(v, list | bool) else v}" for k, v in out.items()) if a.ci else json.dumps(out))
    return 1 if mode == "check" and out["changed"] else 0


if __name__ == "__main__":
    sys.exit(main())
