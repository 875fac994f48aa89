"""Spells column expressions for Spark (run by Catalyst) and for DuckDB (the correctness check).

An operator's columns are a function from a dialect to ``{name: expression}``. ``add`` puts them on a DataFrame;
``nest`` wraps them round an SQL query. Regular expressions keep to what Java and RE2 share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dialect:
    """DuckDB's spelling; ``Spark`` overrides what differs."""

    duck = True

    def q(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def m(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.q(pattern)})"

    def ex(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.q(pattern)}, {group})"

    def rep(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.q(pattern)}, {self.q(re.sub(r'[$](\d)', r'\\\1', to))}, 'g')"

    def starts(self, x: str, s: str) -> str:
        return f"starts_with({x}, {self.q(s)})"

    def ends(self, x: str, s: str) -> str:
        return f"ends_with({x}, {self.q(s)})"

    def has(self, x: str, s: str) -> str:
        return f"contains({x}, {self.q(s)})"

    def pos(self, x: str, s: str) -> str:
        return f"instr({x}, {self.q(s)})"

    def isin(self, x: str, values: Iterable[str]) -> str:
        return f"{x} IN ({', '.join(self.q(v) for v in values)})"

    def list(self, items: Iterable[str]) -> str:
        """The items that aren't null, in order."""
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"

    def array(self, items: Iterable[str]) -> str:
        return f"[{', '.join(items)}]"

    def holds(self, x: str, item: str) -> str:
        return f"list_contains({x}, {item})"

    def both(self, x: str, y: str) -> str:
        """The items of x that y has too, each once; in no order that counts."""
        return f"list_intersect({x}, {y})"

    def listed(self, x: str, y: str) -> str:
        """The items of x, none of them twice, that y has too, in x's order; none if y is null."""
        return self.keep(x, "w", self.holds(y, "w"))

    def range(self, n: int) -> str:
        """The list 0 .. n."""
        return f"range(0, {n + 1})"

    def most(self, x: str) -> str:
        return f"list_max({x})"

    def first_units(self, x: str, n: int) -> str:
        """The first n UTF-16 units; a character of two units that would be cut is left out."""
        head = f"substring({x}, 1, {n})"
        fits = self.keep(self.range(n), "k", f"{self.units(f'substring({x}, 1, k)')} <= {n}")
        return f"CASE WHEN {self.units(head)} <= {n} THEN {head} ELSE substring({x}, 1, {self.most(fits)}) END"

    def head(self, x: str, n: int) -> str:
        return f"({x})[1:{n}]"

    def size(self, x: str) -> str:
        return f"len({x})"

    def join(self, x: str, sep: str = "|") -> str:
        return f"array_to_string({x}, {self.q(sep)})"

    def words(self, x: str) -> str:
        """The parts between runs of white space, as a list."""
        return f"list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.q(pattern)})"

    def each(self, x: str, var: str, body: str) -> str:
        return f"list_transform({x}, lambda {var}: {body})"

    def keep(self, x: str, var: str, cond: str) -> str:
        return f"list_filter({x}, lambda {var}: {cond})"

    def struct(self, fields: dict[str, str]) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def let(self, var: str, fields: dict[str, str], body: str) -> str:
        """The body with ``var``.field bound: each is worked out once, even where the optimizer copies the expression."""
        return f"list_transform([{self.struct(fields)}], lambda {var}: {body})[1]"

    def matches(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.q(pattern)}, {group})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def idiv(self, a: str, b: int) -> str:
        return f"({a} // {b})"

    def units(self, x: str) -> str:
        """Length in UTF-16 units: a code point beyond the first plane counts twice."""
        return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"

    def octets(self, x: str) -> str:
        return f"strlen({x})"

    def char(self, n: int) -> str:
        return f"chr({n})"


class Spark(Dialect):
    duck = False

    def q(self, s: str) -> str:
        if "'" in s:
            return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
        return ("r'" if "\\" in s else "'") + s + "'"

    def m(self, x: str, pattern: str) -> str:
        return f"rlike({x}, {self.q(pattern)})"

    def rep(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.q(pattern)}, {self.q(to)})"

    def starts(self, x: str, s: str) -> str:
        return f"startswith({x}, {self.q(s)})"

    def ends(self, x: str, s: str) -> str:
        return f"endswith({x}, {self.q(s)})"

    def list(self, items: Iterable[str]) -> str:
        return f"array_compact(array({', '.join(items)}))"

    def array(self, items: Iterable[str]) -> str:
        return f"array({', '.join(items)})"

    def holds(self, x: str, item: str) -> str:
        return f"array_contains({x}, {item})"

    def both(self, x: str, y: str) -> str:
        return f"array_intersect({x}, {y})"

    def listed(self, x: str, y: str) -> str:
        # no filter: Catalyst puts the expression of y into a lambda, to be worked out again for every item of x
        return f"coalesce(array_intersect({x}, {y}), array())"

    def range(self, n: int) -> str:
        return f"sequence(0, {n})"

    def most(self, x: str) -> str:
        return f"array_max({x})"

    def first_units(self, x: str, n: int) -> str:
        # cut once, before the first half of a pair (D8 to DB) that would stand last
        head = f"substring({x}, 1, {n})"
        units = f"encode({head}, 'UTF-16BE')"
        split = f"hex(substring({units}, {2 * n - 1}, 1)) BETWEEN 'D8' AND 'DB'"
        return f"CASE WHEN {self.units(head)} <= {n} THEN {head} ELSE decode(substring({units}, 1, CASE WHEN {split} THEN {2 * n - 2} ELSE {2 * n} END), 'UTF-16BE') END"

    def head(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def join(self, x: str, sep: str = "|") -> str:
        return f"array_join({x}, {self.q(sep)})"

    def words(self, x: str) -> str:
        return f"filter(split({x}, r'[ \\t\\n\\r\\f\\x0b]+'), x -> x <> '')"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.q(pattern)})"

    def each(self, x: str, var: str, body: str) -> str:
        return f"transform({x}, {var} -> {body})"

    def keep(self, x: str, var: str, cond: str) -> str:
        return f"filter({x}, {var} -> {cond})"

    def struct(self, fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def let(self, var: str, fields: dict[str, str], body: str) -> str:
        return f"transform(array({self.struct(fields)}), {var} -> {body})[0]"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def idiv(self, a: str, b: int) -> str:
        return f"({a} DIV {b})"

    def units(self, x: str) -> str:
        return f"(octet_length(encode({x}, 'UTF-16BE')) DIV 2)"

    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def char(self, n: int) -> str:
        return f"char({n})"


SPARK, DUCK = Spark(), Dialect()
Cols = Callable[[Dialect], dict[str, str]]


def add(df: DataFrame, *steps: Cols) -> DataFrame:
    """Adds each step's columns; a column of the same name is replaced."""
    for step in steps:
        df = df.withColumns({name: F.expr(e) for name, e in step(SPARK).items()})
    return df


def settle(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition holds, its columns worked out first and once.

    Catalyst pushes a filter below the projections that make its columns and so copies their expressions into it;
    for cascades that build on each other the copies multiply. A row number that the filter also reads keeps it above.
    """
    return df.withColumn("row_", F.monotonically_increasing_id()).where(f"({condition}) AND row_ >= 0").drop("row_")


def nest(query: str, *steps: Cols, d: Dialect = DUCK) -> str:
    """The SQL query with each step's columns; a step of ``path`` or ``body`` alone replaces it."""
    for step in steps:
        cols = step(d)
        new = ", ".join(f"{e} AS {n}" for n, e in cols.items())
        query = f"SELECT * REPLACE ({new}) FROM ({query}) t" if set(cols) in ({"path"}, {"body"}) else f"SELECT *, {new} FROM ({query}) t"
    return query


def case(pairs: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    """The value of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"
