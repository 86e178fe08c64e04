import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.read_back(chat.format_windows(df, **kw))).collect()}


HARD = ["", "<s>", "</s>", "<\\s>", "[INST]", "[\\\\/INST]", " [/INST] ", "<</s>", "[[INST]]", "<\\</s>", "é😀\n", "\\", None, "a b"]


def test_control_strings_and_odd_rows(spark):
    rows = [(i, t, r, x) for i, x in enumerate(HARD) for t, r in enumerate(["system", "user", "assistant", None, "<s>"])]
    rows += [(50, None, "user", "x"), (50, 0, "assistant", "y"), (None, 1, "assistant", "z"), (50, 0, "assistant", "y"), (51, 3, "assistant", "only")]
    for kw in ({}, {"budget": 8, "history": 2}, {"budget": 40, "history": 20}):
        assert got(spark, rows, **kw) == expected(rows)
    assert got(spark, []) == {}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["system", "user", "assistant"]), st.text(alphabet="<s>/[INST]\\ é", max_size=30)), max_size=12), st.integers(1, 60))
def test_round_trip(spark, turns, budget):
    rows = [(c, i, r, x) for i, (c, r, x) in enumerate(turns)]
    assert got(spark, rows, budget=budget, history=budget // 3) == expected(rows)


def test_windows_keep_budget_history_and_masks(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"word{i} " * 10) for i in range(1, 21)]
    windows = chat.format_windows(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), budget=70, history=20).orderBy("window").collect()
    assert len(windows) > 3 and all(w.n_tokens <= 70 for w in windows)
    for w in windows:
        assert w.formatted.startswith("<s>[INST] system [/INST] be brief</s>")
        assert (w.n_repeated > 0) == (w.window > 0)
    # Repeated assistant turns stand in the text but not under the mask.
    assert any(w.formatted.count("assistant [/INST]") > len(w.loss_spans) for w in windows[1:])
    assert sum(len(w.loss_spans) for w in windows) == 10


def test_one_turn_above_the_budget_stands_alone(spark):
    rows = [(1, 0, "user", "a " * 500), (1, 1, "assistant", "b"), (1, 2, "user", "c")]
    windows = chat.format_windows(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), budget=100, history=10).collect()
    assert sorted(w.window for w in windows) == [0, 1]
    assert got(spark, rows, budget=100, history=10) == expected(rows)


def test_query_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.HOSTILE), (-1, 1, "assistant", queries.HOSTILE)]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op10_chat_windows(spark, sf_dir).collect()}
    assert found == expected(rows)


def test_a_conversation_of_many_turns_and_a_very_long_one(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 5)) for i in range(3000)] + [(2, 0, "system", "s " * 3000), (2, 1, "user", "u"), (2, 2, "assistant", "</s>" * 40_000)]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows, budget=64, history=30) == expected(rows)


def test_windows_equal_a_plain_cut(spark):
    """Spans and repeated turns by the definition, turn by turn."""
    draw = __import__("random").Random(6)
    for lead in (True, False):
        rows = [(1, 0, "system", "be kind")] * lead + [(1, i, "user", "w " * draw.randint(0, 12)) for i in range(1, 60)]
        n = [len(t.split()) + 4 for _, _, _, t in rows]
        budget, history = 60, 25
        first = int(lead)
        room = max(1, budget - history - (n[0] if lead else 0))
        starts = [first]
        for i in range(first, len(rows)):
            if i > starts[-1] and sum(n[starts[-1] : i + 1]) > room:
                starts.append(i)
        repeated = [0]
        for s in starts[1:]:
            past = 0
            while s - past - 1 >= first and sum(n[s - past - 1 : s]) <= history:
                past += 1
            repeated.append(past + first)
        windows = chat.format_windows(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), budget=budget, history=history).orderBy("window").collect()
        assert [w.n_repeated for w in windows] == repeated
        ends = [*starts[1:], len(rows)]
        assert [w.formatted.count("[INST]") for w in windows] == [e - s + r + (first if k == 0 else 0) for k, (s, e, r) in enumerate(zip(starts, ends, repeated, strict=True))]
