"""Data-quality rules and metric gates: violations and bounds as rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for each row and rule that doesn't hold; an unknown outcome counts as a violation."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))
    return rows.select(F.col(ident).alias("id"), F.explode(broken).alias("rule"))


def missing(rows: DataFrame, ident: str, key: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """(id, rule) of rows whose key no known row has."""
    return rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias(key)), key, "left_anti").select(F.col(ident).alias("id"), F.lit(rule).alias("rule"))


def repeated(rows: DataFrame, ident: str, rule: str = "repeated id") -> DataFrame:
    return rows.groupBy(F.col(ident).alias("id")).count().where("count > 1").select("id", F.lit(rule).alias("rule"))


class Row(NamedTuple):
    """``holds`` must be true of each row."""

    name: str
    holds: Column


class Unique(NamedTuple):
    """No two rows have equal values in these columns."""

    name: str
    columns: tuple[str, ...]


class Known(NamedTuple):
    """Each value of ``keys``, an array that may be null or empty, is a key of the table of that name."""

    name: str
    keys: Column
    table: str


class Pair(NamedTuple):
    """``holds`` must be true of each row whose ``link`` names another one, which it sees as the struct ``other``."""

    name: str
    link: str
    holds: Column


Rule = Row | Unique | Known | Pair


def audit(rows: DataFrame, ident: str, rules: Iterable[Rule], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id, rule) for each row and rule that it breaks; what can't be decided counts as broken.

    Rules are compiled by what they need: all row rules are one pass; all references into a table (key) meet it in one
    join, each distinct key once; all rules along a link share one join of the rows with themselves. A link that leads
    nowhere breaks each rule along it.
    """
    rules = list(rules)
    found = [violations(rows, ident, {r.name: r.holds for r in rules if isinstance(r, Row)})]
    for r in rules:
        if isinstance(r, Unique):
            # Only keys that occur twice go back to the rows.
            twice = rows.groupBy(*r.columns).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
            same = reduce(lambda a, b: a & b, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in r.columns))
            found.append(rows.alias("x").join(twice.alias("y"), same, "left_semi").select(F.col(ident).alias("id"), F.lit(r.name).alias("rule")))
    for name in dict.fromkeys(r.table for r in rules if isinstance(r, Known)):
        asked = F.array(*(F.struct(F.lit(r.name).alias("rule"), r.keys.alias("keys")) for r in rules if isinstance(r, Known) and r.table == name))
        each = rows.select(F.col(ident).alias("id"), F.inline(asked)).select("id", "rule", F.explode("keys").alias("key"))
        found.append(each.join(tables[name].select("key").distinct(), "key", "left_anti").select("id", "rule").distinct())
    for link in dict.fromkeys(r.link for r in rules if isinstance(r, Pair)):
        other = rows.select(F.col(ident).alias("_other_id"), F.struct(*rows.columns).alias("other"))
        pairs = rows.where(F.col(link).isNotNull()).join(other, F.col(link) == F.col("_other_id"), "left")
        found.append(violations(pairs, ident, {r.name: r.holds for r in rules if isinstance(r, Pair) and r.link == link}))
    return reduce(DataFrame.union, found)


def gates(metrics: DataFrame, bounds: list[tuple[str, str, float]]) -> DataFrame:
    """(name, value, bound, ok) from one row of metrics; a bound is (metric, 'min' or 'max', value)."""

    def gate(name: str, kind: str, bound: float) -> Column:
        value = F.col(name).cast("double")
        return F.struct(F.lit(f"{name}_{kind}").alias("name"), value.alias("value"), F.lit(float(bound)).alias("bound"), ((value >= bound) if kind == "min" else (value <= bound)).alias("ok"))

    return metrics.select(F.inline(F.array(*(gate(*b) for b in bounds))))


def identical(rows: DataFrame, source: str, ident: str, columns: list[str]) -> DataFrame:
    """(id, rule) of rows that differ from the row they claim to copy, or stand before it."""
    other = rows.select(F.col(ident).alias("_of"), *(F.col(c).alias(f"_of_{c}") for c in columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns))
    pairs = rows.where(F.col(source).isNotNull()).join(other, F.col(source) == F.col("_of"), "left")
    return violations(pairs, ident, {"differs from its source": same, "stands before its source": F.col(ident) > F.col(source)})


def expand_cluster(rows: DataFrame) -> DataFrame:
    """Rows (cluster_id, local_index, variant, copy, answer_id, ...) with what they inherit.

    An ``exact`` row takes everything of the row that it copies; a ``semantic`` row takes reference, case and
    difficulty of the first row with its answer.
    """
    taken = ["query", "reference", "case_id", "difficulty", "answer_id"]
    known = rows.select("cluster_id", F.col("local_index").alias("copy"), *(F.col(c).alias(f"src_{c}") for c in taken))
    first = rows.groupBy("cluster_id", "answer_id").agg(F.min_by(F.struct("reference", "case_id", "difficulty", "local_index"), "local_index").alias("f"))
    joined = rows.join(known, ["cluster_id", "copy"], "left").join(first, ["cluster_id", "answer_id"], "left")
    exact, semantic = F.col("variant") == "exact", F.col("variant") == "semantic"

    def pick(c: str) -> Column:
        found = F.when(exact, F.col(f"src_{c}"))
        return (found.when(semantic, F.col(f"f.{c}")) if c in ("reference", "case_id", "difficulty") else found).otherwise(F.col(c)).alias(c)

    return joined.select(
        "cluster_id",
        "local_index",
        "variant",
        *(pick(c) for c in taken),
        F.when(exact, "exact_hit").when(semantic, "semantic_hit").when(F.col("variant") == "cold", "cold").otherwise("miss").alias("expected_cache"),
        F.when(exact, F.col("copy")).alias("exact_of"),
        F.when(semantic, F.col("f.local_index")).alias("semantic_of"),
    )
