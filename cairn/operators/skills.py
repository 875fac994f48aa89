"""Skill entry points: better descriptions and signals, with an optional model to ask; prose fields that it may fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.dialect import SPARK

from . import frontmatter
from .reconcile import use_when

Ask = Callable[[pd.Series], pd.Series]

PROSE = ("description", "activation_signals", "input_contract", "output_contract")
LONGEST = 1024
BODY = 1200
QUESTIONS = {
    "description": ("Say in one sentence of at most 20 words what this does:", "Description:"),
    "skill": ("Say in the third person, in at most 1024 characters, what this skill does, and then when to take it: 'Use when ...'.", "Description:"),
    "activation_signals": ("Give three to six short phrases, with commas between, that should bring this up:", "Signals:"),
    "input_contract": ("Say in at most 15 words what this needs:", "Input:"),
    "output_contract": ("Say in at most 15 words what this gives:", "Output:"),
}


def question(field: str, body: str = "body", skill: bool = False) -> F.Column:
    """What a model is asked for a field; the body is cut at 1200 characters, as a question has a limit."""
    first, last = QUESTIONS["skill" if skill and field == "description" else field] if field in QUESTIONS else (f"Take the {field} from this text, in at most 20 words:", f"{field}:")
    cut = F.when(F.length(body) > BODY, F.concat(F.substring(body, 1, BODY), F.lit("\n[truncated]"))).otherwise(F.col(body))
    return F.concat(F.lit(first + "\n"), cut, F.lit("\n" + last))


def assist(rows: DataFrame, field: str, seed: str, ask: Ask | None = None, body: str = "body", skill: bool = False) -> DataFrame:
    """Adds value and path: the seed where it is good enough, else what the model says, else the seed again.

    path says which: heuristic (not asked), no_adapter (none to ask), failed (no usable reply), ok. A skill's description is good
    enough only with a trigger in it. Null seeds are Unknown.
    """
    given = F.coalesce(F.col(seed), F.lit("Unknown"))
    good = F.expr(text.good_value(seed, SPARK))
    if skill and field == "description":
        good = good & F.coalesce(F.expr(use_when(seed, SPARK)), F.lit(False))
    if ask is None:
        return rows.withColumn("value", given).withColumn("path", F.when(good, "heuristic").otherwise("no_adapter"))
    reply = F.trim(F.pandas_udf(ask, "string")(F.when(~good, question(field, body, skill))))
    out = rows.withColumn("reply_", F.when(~good, reply))
    usable = F.coalesce(~F.col("reply_").isin("", "Unknown"), F.lit(False))
    return out.withColumn("value", F.when(usable, F.col("reply_")).otherwise(given)).withColumn("path", F.when(good, "heuristic").when(usable, "ok").otherwise("failed")).drop("reply_")


def plan(files: DataFrame, ask: Ask | None = None) -> DataFrame:
    """path, changed, skipped, description_action, description, signals of the (path, body) of skill entry points.

    A header that can't be patched is skipped, with its issue. A description is added where there is none, and revised where
    it is weak or lacks a trigger and the proposal is better, or where the proposal says a fifth more; it is cut at 1024
    characters. Signals are only filled in. Null where a field stays.
    """
    heads = frontmatter.inspect_headers(files).select("path", "safe", "issue", F.col("header")["description"].alias("old"), F.col("header")["activation_signals"].alias("old_signals"))
    rows = files.select("path", "body").join(heads, "path")
    rows = _proposed(rows, ask)
    good = lambda c: F.expr(text.good_value(c, SPARK))
    trigger = lambda c: F.coalesce(F.expr(use_when(c, SPARK)), F.lit(False))
    weak = F.col("old").isNull() | ~good("old") | ~trigger("old")
    longer = F.length("proposal") + 2 > 1.2 * (F.coalesce(F.length("old"), F.lit(0)) + 2)
    better = good("proposal") & ~F.col("proposal").eqNullSafe(F.col("old"))
    take = better & F.when(weak, (trigger("proposal") | ~good("old")) & (~good("old") | (trigger("proposal") & ~trigger("old")) | longer)).otherwise(longer)
    take = F.col("safe") & F.coalesce(take, F.lit(False))
    items = lambda c: F.filter(F.transform(F.split(c, "[,;\n]"), lambda x: F.trim(x)), lambda x: ~x.isin("", "Unknown"))
    named = items("found")
    fill = F.col("safe") & (F.size(items(F.coalesce("old_signals", F.lit("")))) == 0) & (F.size(named) > 0)
    return rows.select(
        "path", (take | fill).alias("changed"), "issue", F.when(take, F.when(F.col("old").isNull(), "add").otherwise("revise")).alias("description_action"),
        F.when(take, F.substring("proposal", 1, LONGEST)).alias("description"), F.when(fill, named).alias("signals"),
    ).withColumnRenamed("issue", "skipped")


def _proposed(rows: DataFrame, ask: Ask | None) -> DataFrame:
    kept = rows.withColumnRenamed("path", "file")
    kept = assist(kept, "description", "old", ask, skill=True).withColumnRenamed("value", "proposal").drop("path")
    empty = kept.withColumn("none", F.lit(None).cast("string"))
    return assist(empty, "activation_signals", "none", ask).withColumnRenamed("value", "found").drop("path", "none").withColumnRenamed("file", "path")


def patched(files: DataFrame, planned: DataFrame) -> DataFrame:
    """path, patched of the files that a plan changes; every byte outside the two fields is as it was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                managed: dict[str, object] = {}
                if r["description"] is not None:
                    managed["description"] = r["description"]
                if r["signals"] is not None:
                    managed["activation_signals"] = list(r["signals"])
                new, issue = frontmatter.patch(r["body"] or "", managed)
                if issue is None:
                    out.append((r["path"], new))
            yield pd.DataFrame(out, columns=["path", "patched"])

    changed = planned.where("changed").select("path", "description", "signals")
    return files.select("path", "body").join(changed, "path").mapInPandas(run, "path string, patched string")
