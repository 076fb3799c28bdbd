"""Registry of named queries and the SQL text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phonolake.functions import text as tx
from phonolake.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL where SQL can say it."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table (all, if none are named) for work that is heavy a row."""
    t = table(spark, folder, name)
    return spread(t.select(*columns) if columns else t)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(x: str) -> str:
    a, b, many = tx.folding()
    out = f"translate(lower({x}), {q(a)}, {q(b)})"
    for c, d in many:
        out = f"replace({out}, {q(c)}, {q(d)})"
    return out


def sql_norm(x: str) -> str:
    """The normalization in RE2: separators twice, as there is no lookbehind."""
    out = f"translate({sql_fold(x)}, {q(tx.ZERO_WIDTH)}, '')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(\\p{{Nd}})[.,](\\p{{Nd}})', '\\1\\2', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s\\x{{0900}}-\\x{{097f}}]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sql_words(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"


def sql_chars(norm: str) -> str:
    return f"list_filter(string_split(replace({norm}, ' ', ''), ''), lambda c: c <> '')"


def sql_distance(a: str, b: str) -> str:
    """Distance of two lists by one ASCII letter for each distinct element: the built-in distance counts bytes."""
    known = f"list_distinct(list_concat({a}, {b}))"
    spell = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda w: chr(list_position({known}, w)::INT)), ''), '')"
    return f"levenshtein({spell(a)}, {spell(b)})"


#: Pairs with their normalized words and characters, as other SQL builds on it.
PAIRS = f"""
WITH n AS (SELECT *, {sql_norm("reference")} AS r, {sql_norm("coalesce(hypothesis, '')")} AS h FROM experiment_results WHERE reference IS NOT NULL),
t AS (SELECT *, {sql_words("r")} AS rw, {sql_words("h")} AS hw, {sql_chars("r")} AS rc, {sql_chars("h")} AS hc FROM n),
p AS (SELECT *, {sql_distance("rw", "hw")}::INT AS word_errors, len(rw)::INT AS reference_words, {sql_distance("rc", "hc")}::INT AS character_errors, len(rc)::INT AS reference_characters FROM t)
"""
