import hashlib
import heapq
import random

import pytest

from tallyspark.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def cheapest(rows):
    """Dijkstra over (cost, letters) for rows of (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, letters, out
        if (i, q) in done and not letters.endswith("I"):
            continue
        done.add((i, q))
        to = (2, 2, 3, 2)[q]
        name = {2: "user", 3: "assistant"}[to]
        if letters[-4:] != "IIII":
            heapq.heappush(heap, (cost + 2, letters + "I", i, to, (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q, out))
            if fault not in "bd":
                more = fault == "t"
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                if kept is not None:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, kept, (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, letters + "R", i + 1, to, (*out, f"{name}:{text}")))


def expected(turns):
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"))
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, left = cheapest(judged)
        out[c] = (gaps, *(sum(j[2] == f for j in judged) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def got(spark, turns):
    found = repair.report(spark.createDataFrame([(*t, "clash") for t in turns], SCHEMA)).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def drawn(seed, n, size):
    draw = random.Random(seed)
    roles = ["system", "user", "user", "user", "assistant", "assistant", "assistant", "tool", "", None]
    texts = ["yes.", "no?", "what!", "cut short", "", " \n", None, "x. ", " ", "é.\x0b"]
    return [(c, draw.choice([None, *range(9)]) if draw.random() < 0.3 else t, draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.randint(0, 9)}.") for c in range(n) for t in range(draw.randint(1, size))]


def test_random_conversations(spark):
    turns = [*drawn(1, 150, 9), (None, None, "user", "hi."), (None, 1, "assistant", "ho."), (-5, None, None, None), (7, 3, "user", "a."), (7, 3, "user", "a.")]
    assert got(spark, turns) == expected(turns)
    assert got(spark, []) == {}


@pytest.mark.parametrize("segment", [1, 3])
def test_conversations_of_many_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    turns = [t for t in drawn(2, 40, 12)]
    assert got(spark, turns) == expected(turns)


def test_one_conversation_of_a_third_of_all_rows(spark):
    turns = [(0, i, "user" if i % 2 else "assistant", f"turn {i}" + ("." if i % 11 else "")) for i in range(1500)] + [(0, None, "user", "same.")] * 300 + drawn(3, 30, 6)
    turns = [t for t in turns if t[0] == 0 and len(t[3] or "") > 0 or t[0] != 0]
    found = got(spark, turns)
    want = expected(turns)
    assert found == want


def test_repaired_rows(spark):
    turns = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "u"), (1, 3, "user", "v.")]
    rows = sorted((r.pos, r.role, r.text, r.edit) for r in repair.repaired(spark.createDataFrame([(*t, "x") for t in turns], SCHEMA)).collect())
    cost, audit, left = cheapest([("system", "s.", "-"), ("assistant", "a.", "-"), ("user", "u", "t"), ("user", "v.", "-")])
    assert [f"{r}:{t}" for _, r, t, _ in rows] == list(left) and "".join(e for *_, e in rows) == audit.replace("D", "") and [r[0] for r in rows] == list(range(len(rows)))


def test_prices_make_every_arc_of_a_shortest_path_tight():
    draw = random.Random(4)
    for _ in range(200):
        rows = [(draw.choice(["s", "u", "a", "t", ""]), draw.choice("--tbd")) for _ in range(draw.randint(0, 8))]
        lattice = repair.Lattice(rows, repair.FINAL, over=True)
        price = lattice.auction(0)
        assert all(price[i] <= cost + price[j] for i in list(price) if i != repair.END for _, cost, j in lattice.arcs(i))
        assert repair.cheapest(rows, 0, repair.FINAL, True)[:2] == cheapest([(r, "", f) for r, f in rows])[:2]


def test_query_over_the_table(spark, sf_dir):
    assert queries.op12_conversation_repair(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
