"""Conversation repair: an auction on the lattice of rows and roles finds the cheapest edits that make turns alternate.

Rows are judged on narrow columns, equal ones counted together, and cut into segments in the order of a range sort, so a
conversation may be spread over many tasks. In a segment an auction runs from an entry state: the last node of a path is
extended along the cheapest arc, or its price rises to that arc's and the path contracts. Converged prices show the
tight arcs, which are traced in the order of letters. Segments of one conversation hand each other the prices at their
ends. Texts are read once more, in order, to render what the edits leave.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import sliced, small_batches

BLANKS = " \t\n\x0b\f\r"
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a segment: an auction takes time that grows with the square of its length.
SEGMENT = 48
#: States: nothing yet, after a system row, after a user row, after an assistant row. What an inserted or retyped row leads to:
STATES, NEXT = range(4), (2, 2, 3, 2)
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = {0: 0, 3: 0}
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
END = -1

#: A row to the lattice: the initial of its role and its fault (b, d, t or -).
Row = tuple[str, str]
Arc = tuple[str, int, int]


class Lattice:
    """Nodes 4 * i + state before row i; arcs are edits. ``ends`` are the states that may be left after the last row, at a
    price each; rows may be inserted there only if the conversation is over, since a following segment does so itself."""

    def __init__(self, rows: list[Row], ends: dict[int, int], over: bool):
        self.rows, self.ends, self.over, self.known = rows, ends, over, {}

    def arcs(self, node: int) -> list[Arc]:
        found = self.known.get(node)
        if found is None:
            found = self.known[node] = sorted(self._arcs(*divmod(node, 4)))
        return found

    def _arcs(self, i: int, state: int) -> Iterator[Arc]:
        to = NEXT[state]
        if i < len(self.rows):
            initial, fault = self.rows[i]
            if fault not in "bd":
                more = TRUNCATED if fault == "t" else 0
                if (state, initial) in KEEP:
                    yield "K", more, 4 * i + 4 + KEEP[state, initial]
                yield "R", RETYPE + more, 4 * i + 4 + to
            yield "D", DELETE, 4 * i + 4 + state
            yield "I", INSERT, 4 * i + to
        else:
            if state in self.ends:
                yield "", self.ends[state], END
            if self.over:
                yield "I", INSERT, 4 * i + to

    def can_end(self, state: int) -> bool:
        """Whether some path from an entry state reaches an end: prices would rise for ever without one."""
        reached = {0: {0, 2, 3}, 1: {1, 2, 3}}.get(state, {2, 3})
        if state == 0 and any(r[0] == "s" and r[1] not in "bd" for r in self.rows):
            reached = reached | {1}
        return self.over or bool(reached & self.ends.keys())

    def auction(self, source: int) -> dict[int, float] | None:
        """Prices under which no arc costs less than it gains and every arc of a shortest path is tight."""
        if not self.can_end(source):
            return None
        price: dict[int, float] = defaultdict(int)
        path = [source]
        while path[-1] != END:
            node = path[-1]
            level, to = min(((cost + price[j], j) for _, cost, j in self.arcs(node)), default=(inf, END))
            if price[node] < level:
                price[node] = level
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price

    def trace(self, source: int, price: dict[int, float]) -> tuple[str, int]:
        """The least letters of a path of tight arcs to the end, and the state that it leaves from."""
        path, letters, dead = [source], [], set()
        while path[-1] != END:
            node = path[-1]
            for letter, cost, j in self.arcs(node):
                if j not in dead and price[node] == cost + price[j]:
                    path.append(j)
                    letters.append(letter)
                    break
            else:
                dead.add(path.pop())
                letters.pop()
        return "".join(letters), path[-2] % 4


def cheapest(rows: list[Row], source: int, ends: dict[int, int], over: bool) -> tuple[int, str, int] | None:
    """Cost, letters and last state of the cheapest edits of a segment, or None if no end can be reached."""
    lattice = Lattice(rows, ends, over)
    price = lattice.auction(source)
    return None if price is None else (int(price[source] - price[END]), *lattice.trace(source, price))


def _costs(rows: list[Row], source: int) -> list[int | None]:
    """What it costs to leave a segment in each state."""
    found = []
    for end in STATES:
        price = Lattice(rows, {end: 0}, over=False).auction(source)
        found.append(None if price is None else int(price[source] - price[END]))
    return found


def _keyed(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text and digest; a null id, role or text is one space."""
    space = F.lit(" ")
    return turns.select(
        F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    ).withColumn("digest", F.md5("text"))


def _tail(text: Column) -> Column:
    """b for a text of nothing but blanks, t for one that ends without a full stop, exclamation or question mark."""
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return F.when(last == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut at each conversation and after SEGMENT rows."""
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("kinds", pa.list_(pa.string())), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])
    conv, part, seg, kinds, out = None, 0, 0, [], []

    def cut() -> None:
        nonlocal seg
        if kinds:
            initials = [k[:-1] for k in kinds]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            out.append({"conv": conv, "part": part, "seg": seg, "kinds": list(kinds), "illegal": illegal, "first": initials[0], "last": initials[-1]})
            kinds.clear()
            seg += 1

    for batch in batches:
        for name, part, role, tail, again, n in zip(*(batch[c].to_pylist() for c in ("conv", "part", "role", "tail", "again", "n")), strict=True):
            if name != conv:
                cut()
                conv, seg = name, 0
            copy = role[:1] + ("b" if tail == "b" else "d")
            for k in range(n):
                kinds.append(copy if k or again else role[:1] + tail)
                if len(kinds) == SEGMENT:
                    cut()
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    cut()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _rows(kinds: list[str]) -> list[Row]:
    return [(k[:-1], k[-1]) for k in kinds]


_SOLVED = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("costs", pa.list_(pa.list_(pa.int64()))), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))])
_SOLVED_DDL = "conv string, part int, seg long, costs array<array<bigint>>, audits array<string>, exits array<int>"


def _entries(first: bool) -> list[int]:
    return [0] if first else list(STATES)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each entry state: of a last segment cost and letters, of others what each state at its end costs."""
    for batch in sliced(batches):
        out = []
        for conv, part, seg, kinds, first, last in zip(*(batch[c].to_pylist() for c in ("conv", "part", "seg", "kinds", "is_first", "is_last")), strict=True):
            rows = _rows(kinds)
            if last:
                found = [cheapest(rows, q, FINAL, over=True) for q in _entries(first)]
                out.append({"conv": conv, "part": part, "seg": seg, "costs": [[c] for c, _, _ in found], "audits": [a for _, a, _ in found], "exits": [e for _, _, e in found]})
            else:
                out.append({"conv": conv, "part": part, "seg": seg, "costs": [_costs(rows, q) for q in _entries(first)], "audits": None, "exits": None})
        yield pa.RecordBatch.from_pylist(out, _SOLVED)


def _priced(group: pa.Table) -> pa.Table:
    """From the last segment back: what the rest of the conversation costs from each state at a segment's end."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seg"]))
    rest = [c[0] for c in rows[-1]["costs"]]
    out = []
    for r in reversed(rows[:-1]):
        out.append({"conv": r["conv"], "part": r["part"], "seg": r["seg"], "prices": rest})
        rest = [min(a + b for a, b in zip(costs, rest, strict=True) if a is not None) for costs in r["costs"]]
    return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("prices", pa.list_(pa.int64()))]))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out = []
        for conv, part, seg, kinds, first, prices in zip(*(batch[c].to_pylist() for c in ("conv", "part", "seg", "kinds", "is_first", "prices")), strict=True):
            found = [cheapest(_rows(kinds), q, dict(enumerate(prices)), over=False) for q in _entries(first)]
            out.append({"conv": conv, "part": part, "seg": seg, "costs": [[c] for c, _, _ in found], "audits": [a for _, a, _ in found], "exits": [e for _, _, e in found]})
        yield pa.RecordBatch.from_pylist(out, _SOLVED)


def _chained(group: pa.Table) -> pa.Table:
    """From the first segment on: each goes on in the state that the one before it leaves. The letters fill one cell of the
    result, so that what is collected here is of its size."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["seg"]))
    state, letters = 0, []
    for r in rows:
        letters.append(r["audits"][state])
        state = r["exits"][state]
    return pa.table({"conv": [rows[0]["conv"]], "audit": ["".join(letters)], "cost": pa.array([rows[0]["costs"][0][0]], pa.int64())})


def _judged(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with their faults, and conv, audit, cost of each conversation."""
    order = ["conv", "turn", "role", "digest"]
    slim = keyed.select(*order, _tail(F.col("text")).alias("tail")).groupBy(*order, "tail").agg(F.count("*").alias("n"))
    slim = scratch.stage(slim, "turns")
    # Null turns come first, in structs as in sorts.
    seen = slim.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("seen"))
    told = slim.join(seen, ["conv", "role", "digest"]).select(*order, "tail", "n", (~F.col("seen.turn").eqNullSafe(F.col("turn"))).alias("again"))
    told = scratch.stage(told, "judged-turns")
    ordered = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    segments = scratch.stage(ordered.mapInArrow(_segments, "conv string, part int, seg long, kinds array<string>, illegal long, first string, last string"), "segments")
    place = F.struct("part", "seg")
    bounds = segments.groupBy("conv").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count("*").alias("segments"))
    placed = segments.join(bounds, "conv").select("conv", "part", "seg", "kinds", "segments", (place == F.col("least")).alias("is_first"), (place == F.col("most")).alias("is_last"))
    # Auctions take long for the bytes that they read: segments are dealt to as many tasks as shuffles have.
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.stage(placed.repartition(tasks, "conv", "seg"), "placed-segments")
    solved = scratch.stage(placed.mapInArrow(_solved, _SOLVED_DDL), "solved-segments")
    several = placed.where("segments > 1").select("conv", "part", "seg", "kinds", "is_first", "is_last")
    priced = solved.join(several.select("conv", "part", "seg"), ["conv", "part", "seg"]).groupBy("conv").applyInArrow(_priced, "conv string, part int, seg long, prices array<bigint>")
    traced = several.join(priced, ["conv", "part", "seg"]).mapInArrow(_traced, _SOLVED_DDL)
    lasts = solved.join(several.where("is_last").select("conv", "part", "seg"), ["conv", "part", "seg"])
    long = traced.union(lasts.select(*traced.columns)).groupBy("conv").applyInArrow(_chained, "conv string, audit string, cost long")
    short = solved.join(placed.where("segments = 1").select("conv"), "conv").select("conv", F.col("audits")[0].alias("audit"), F.col("costs")[0][0].alias("cost"))
    audits = scratch.stage(short.union(long), "audits")
    scratch.drop(slim, told, placed, solved)
    return segments, audits


Rendered = tuple[str, str | None, str, str, str]


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[Rendered]:
    """conv, then either its letters or a row that the edits leave: role, text and letter. An audit comes before its rows."""
    letters, at, state = "", 0, 0

    def inserted(conv: str) -> Iterator[Rendered]:
        nonlocal at, state
        while letters[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield conv, None, ROLE[state], "", "I"

    conv = None
    for batch in sliced(batches):
        for name, audit, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "audit", "role", "text")), strict=True):
            if audit is not None:
                if conv is not None:
                    yield from inserted(conv)
                conv, letters, at, state = name, audit, 0, 0
                yield conv, audit, "", "", ""
                continue
            yield from inserted(conv)
            letter, at = letters[at], at + 1
            if letter == "K":
                state = KEEP[state, role[:1]]
                yield conv, None, role, text, "K"
            elif letter == "R":
                state = NEXT[state]
                yield conv, None, ROLE[state], text, "R"
    if conv is not None:
        yield from inserted(conv)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation, fed row by row."""
    done, conv, digest, between = [], None, hashlib.sha256(), b""

    def packed() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["conv", "repaired_sha256"])
        done.clear()
        return found

    for name, audit, role, text, _ in _rendered(batches):
        if audit is not None:
            if conv is not None:
                done.append((conv, digest.hexdigest()))
            if len(done) >= 1000:
                yield packed()
            conv, digest, between = name, hashlib.sha256(), b""
        else:
            digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            between = b"\n"
    if conv is not None:
        done.append((conv, digest.hexdigest()))
    yield packed()


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that the edits leave, numbered from 0."""
    out, pos = [], 0
    for conv, audit, role, text, letter in _rendered(batches):
        pos = 0 if audit is not None else pos + 1
        if audit is None:
            out.append((conv, pos - 1, role, text, letter))
        if len(out) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_LEFT.types)], schema=_LEFT)
            out.clear()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_LEFT.types)], schema=_LEFT)


_LEFT = pa.schema([("conv", pa.string()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _streamed(keyed: DataFrame, audits: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Each conversation's letters, then its rows in order, to one task that holds a slice of them at a time: a hash of a
    whole conversation can't be put together from parts."""
    rows = keyed.select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text")
    heads = audits.select("conv", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"))
    mixed = heads.union(rows).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), "turn", "role", "digest")
    return mixed.select("conv", "audit", "role", "text").mapInArrow(run, schema)


def report(turns: DataFrame) -> DataFrame:
    """A row per conversation of ``turns`` (conv_id, turn, role, text): what is wrong with it, and the cheapest repair.

    conv_id, gaps (missing whole turn numbers between the least and the largest), blank, duplicate and truncated rows
    (each row's first fault), illegal (neighbours whose roles don't follow each other), cost, audit (the edits' initials:
    Delete, Insert, Keep, Rerole) and repaired_sha256 (of ``role:text``, joined by newlines).

    Rows go by turn, null ones first, and among equal turns by role and the text's MD5; equal rows are copies of each
    other. A null id, role or text is one space; a role without letters fits nowhere, so its row is deleted or
    retyped. Other columns are ignored, and an empty table gives an empty result. No bound on a conversation's rows:
    only its letters, a cell of the result, come together in one place, and its texts pass through one task in slices.
    """
    small_batches(turns.sparkSession)
    keyed = _keyed(turns)
    ids = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    segments, audits = _judged(keyed)
    fault = lambda f: F.sum(F.size(F.filter("kinds", lambda k: F.right(k, F.lit(1)) == f)))
    inner = segments.groupBy("conv").agg(fault("b").alias("blank"), fault("d").alias("duplicate"), fault("t").alias("truncated"), F.sum("illegal").alias("illegal"), F.count("*").alias("segments"))
    # Between segments the last row of one and the first of the next are neighbours.
    ends = segments.join(inner.where("segments > 1").select("conv"), "conv").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "first", "last"))).alias("s"))
    between = ends.select("conv", F.expr(f"size(filter(sequence(0, size(s) - 2), i -> concat(s[i].last, s[i + 1].first) not in ({', '.join(repr(x) for x in sorted(LEGAL))})))").cast("long").alias("between"))
    gaps = keyed.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    hashes = _streamed(keyed, audits, _digests, "conv string, repaired_sha256 string")
    told = ids.join(gaps, "conv").join(inner, "conv").join(between, "conv", "left").join(audits, "conv").join(hashes, "conv")
    return told.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"), "cost", "audit", "repaired_sha256")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id (as text), pos, role, text, edit of the rows that the cheapest repair leaves, with its inserted ones."""
    small_batches(turns.sparkSession)
    keyed = _keyed(turns)
    _, audits = _judged(keyed)
    return _streamed(keyed, audits, _left, "conv string, pos long, role string, text string, edit string").withColumnRenamed("conv", "conv_id")
