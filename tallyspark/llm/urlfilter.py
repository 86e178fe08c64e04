"""URL filters: a trie over reversed host labels and path segments decides between allow and block entries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A trie goes to every executor only up to this many bytes in memory; beyond it the rules are joined.
MAX_BROADCAST_BYTES = 64 << 20
#: At most so many bytes for each label and segment of a rule, and one more for what the rule itself takes.
NODE_BYTES = 600


class Rule(NamedTuple):
    """``entry`` is ``host/path-prefix``; ``verdict`` is ``allow`` or ``block``."""

    entry: str
    verdict: str

    @property
    def host(self) -> str:
        return self.entry.partition("/")[0]

    @property
    def path(self) -> str:
        host, slash, rest = self.entry.partition("/")
        return slash + rest


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, ASCII lower case; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


class Trie:
    """Host labels from the last one on, then whole path segments; a rule's unfinished last segment is a prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            *whole, rest = rule.path.split("/")
            node = node.setdefault(("path",), {})
            for segment in whole:
                node = node.setdefault(segment, {})
            kept = node.setdefault(("ends",), {})
            node.setdefault(("lengths",), set()).add(len(rest))
            # The same entry twice: block stands before allow, whatever their order.
            kept[rest] = max(kept.get(rest, rule), rule, key=lambda r: r.verdict)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest entry that fits, the one with the longer host among equals; None if there is none."""
        best, segments, node = None, path.split("/"), self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(("path",))
            for i, segment in enumerate(segments):
                if below is None:
                    break
                # One probe for each length that the unfinished segments here have, however many there are.
                ends = below.get(("ends",))
                for n in below.get(("lengths",), ()):
                    rule = ends.get(segment[:n]) if n <= len(segment) else None
                    if rule and (best is None or _order(rule) > _order(best)):
                        best = rule
                below = below.get(segment) if i + 1 < len(segments) else None
        return best


def trie_bytes(rules: Iterable[Rule]) -> int:
    """A bound of what a trie of these rules takes: nodes of their labels and segments, and their texts at up to four bytes a
    character."""
    return sum(NODE_BYTES * (r.entry.count(".") + r.entry.count("/") + 3) + 4 * len(r.entry) for r in rules)


def _order(rule: Rule) -> tuple[int, int]:
    return len(rule.entry), len(rule.host)


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", default: str = "allow", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to every row.

    ``rules`` is a list of rules, or a table (entry, verdict) of any size: where its trie might take more than
    max_broadcast_bytes in memory pages and rules are joined. Null urls and urls without ``://`` have an empty host and path, which no rule fits: they get ``default``.
    Repeated rows are judged each for itself, an empty table gives an empty one, and columns of the input that are
    named like one of the four new ones are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("entry", "verdict").where("entry is not null and verdict is not null")
        nodes = F.length(F.regexp_replace("entry", "[^./]", "")) + 3
        size = rules.agg(F.sum(NODE_BYTES * nodes + 4 * F.length("entry"))).first()[0] or 0
        listed = rules if size > max_broadcast_bytes else [Rule(*r) for r in rules.collect()]
    else:
        listed = [Rule(*r) for r in rules]
        if trie_bytes(listed) > max_broadcast_bytes:
            listed = pages.sparkSession.createDataFrame(listed, "entry string, verdict string")
    if isinstance(listed, DataFrame):
        found = _joined(parts, listed)
    else:
        found = parts.withColumn("found", _lookup(pages.sparkSession, listed)("host", "path"))
    return found.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def _lookup(spark: SparkSession, rules: list[Rule]):
    # The trie itself is sent, so that a worker reads it once and builds none.
    sent = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def lookup(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = sent.value.find
        found = [find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return lookup


def _joined(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same answer without a broadcast: each distinct host and path meets the rules of its own suffixes and folders."""
    path = F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)")
    rest = F.substring_index("path", "/", -1)
    known = rules.select(F.substring_index("entry", "/", 1).alias("suffix"), path.alias("path"), F.col("entry").alias("rule"), "verdict")
    known = known.withColumn("rest", rest).withColumn("folder", F.expr("left(path, length(path) - length(rest))")).drop("path")
    # Only as many labels and segments as some rule has: a deep path makes no more rows than there are depths of rules.
    depths = known.agg(F.collect_set(F.size(F.split("suffix", r"\."))).alias("l"), F.collect_set(F.size(F.split("folder", "/")) - 1).alias("s")).first()
    labels, segments = (F.array(*map(F.lit, sorted(found))).cast("array<int>") for found in (depths.l, depths.s))
    places = parts.select("host", "path").distinct()
    keys = (
        places.withColumn("labels", F.split("host", r"\."))
        .withColumn("i", F.explode(F.filter(labels, lambda i: i <= F.size("labels"))))
        .withColumn("suffix", F.expr("array_join(slice(labels, -i, i), '.')"))
        .withColumn("segments", F.split("path", "/"))
        .withColumn("j", F.explode(F.filter(segments, lambda j: j < F.size("segments"))))
        .withColumn("folder", F.expr("concat(array_join(slice(segments, 1, j), '/'), if(j > 0, '/', ''))"))
    )
    best = (
        keys.join(known, ["suffix", "folder"])
        .where(F.expr("startswith(substring(path, length(folder) + 1), rest)"))
        .groupBy("host", "path")
        .agg(F.expr("max_by(struct(rule, verdict), struct(length(rule), length(suffix), verdict))").alias("found"))
    )
    return parts.join(best, ["host", "path"], "left")
