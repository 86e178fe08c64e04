"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written ``<s>[INST] role [/INST] text</s>``. Control strings inside roles and texts get a backslash after
their first character, one more than they have already, so that reading them back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"$1$2$3")


def turn_tokens(text: Column) -> Column:
    """An estimate from the text alone: words and single symbols, and four for the marks of a turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 4


def format_windows(conversations: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """One row per window: conv_id, window, n_repeated, n_tokens, formatted, loss_spans.

    Turns are ordered by turn, then role and text. Prefix sums of their tokens cut a conversation into spans of whole
    turns that fit beside the system turn and the history allowance; a turn above that stands alone. Every window
    repeats the leading system turn and the longest run of earlier turns within ``history`` tokens. ``loss_spans``
    (start, len in code points of ``formatted``) hold assistant texts of the span itself: repeated targets are masked.

    Null roles and texts are empty, rows with a null conv_id form one conversation, null turns come first, and
    repeated rows are repeated turns. Other columns are ignored; an empty table gives no window.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # before: the tokens of all earlier turns, a prefix sum; it grows from turn to turn, as every turn has some.
    rows = rows.withColumn("n", turn_tokens(F.col("text")).cast("long")).withColumn("i", F.row_number().over(told) - 1)
    rows = rows.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    # past: how many turns right before a turn fit the history together, the leading system turn left out.
    near = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)
    led = (F.col("i") == 0) & (F.col("role") == "system")
    rows = rows.withColumn("past", F.count_if(~led).over(near) - F.when(led, 0).otherwise(1))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "n", "before", "past"))).alias("ts"))
    summed = whole.withColumn("lead", F.when(F.col("ts")[0].role == "system", 1).otherwise(0))
    room = summed.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("lead") == 1, F.col("ts")[0].n).otherwise(0)))
    # starts: positions (from 0) of the first turn of each span, the leading system turn counting to the first.
    spans = room.withColumn(
        "starts",
        F.expr("""aggregate(slice(ts, lead + 1, size(ts)), named_struct('from', if(lead = 1, ts[0].n, 0L), 'starts', array(lead)), (a, t) ->
            if(t.i > lead and t.before + t.n - a.from > room, named_struct('from', t.before, 'starts', array_append(a.starts, t.i)), a)).starts"""),
    )
    windows = spans.select(
        "conv_id",
        F.expr("""inline(transform(starts, (s, k) -> named_struct(
            'window', k,
            'system', slice(ts, 1, lead),
            'past', if(s > lead, slice(ts, cast(s - ts[s].past + 1 as int), cast(ts[s].past as int)), slice(ts, 1, 0)),
            'own', slice(ts, s + 1, coalesce(try_element_at(starts, k + 2), size(ts)) - s))))"""),
    )
    laid = windows.select(
        "conv_id",
        "window",
        # The system turn is new in the first window only.
        (F.when(F.col("window") > 0, F.size("system")).otherwise(0) + F.size("past")).alias("n_repeated"),
        F.concat(
            F.transform("system", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), t.n.alias("n"), F.lit(False).alias("loss"))),
            F.transform("past", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), t.n.alias("n"), F.lit(False).alias("loss"))),
            F.transform("own", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), t.n.alias("n"), (t.role == "assistant").alias("loss"))),
        ).alias("ts"),
    )
    marked = laid.withColumn("ts", F.transform("ts", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t.role), F.lit(MIDDLE)).alias("head"), escape(t.text).alias("body"), t.n.alias("n"), t.loss.alias("loss"))))
    return marked.select(
        "conv_id",
        "window",
        "n_repeated",
        F.expr("aggregate(ts, 0L, (a, t) -> a + t.n)").alias("n_tokens"),
        F.expr(f"array_join(transform(ts, t -> concat(t.head, t.body, '{CLOSE}')), '')").alias("formatted"),
        F.expr(f"""aggregate(ts, named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, len: int>>)), (a, t) -> named_struct(
            'at', a.at + length(t.head) + length(t.body) + {len(CLOSE)},
            'spans', if(t.loss, array_append(a.spans, named_struct('start', a.at + length(t.head), 'len', length(t.body))), a.spans))).spans""").alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a window, as an array of (role, text)."""
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        rest = F.substr(part, F.lit(len(OPEN) + 1))
        role = F.substring_index(rest, MIDDLE, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(rest, F.length(role) + len(MIDDLE) + 1)).alias("text"))

    return F.transform(parts, turn)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns once each, its target texts, and the characters written."""
    read = windows.select(
        "conv_id",
        "window",
        "n_repeated",
        read_turns(F.col("formatted")).alias("all"),
        F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s.start + 1, s.len))).alias("targets"),
        F.length("formatted").cast("long").alias("chars"),
    )
    # Beyond the first window, the repeated turns stand in front; in the first there are none.
    own = read.select("conv_id", F.struct("window", F.expr("slice(all, n_repeated + 1, size(all))").alias("turns"), "targets").alias("w"), "chars")
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars")).select("conv_id", F.flatten("ws.turns").alias("turns"), F.flatten("ws.targets").alias("targets"), "formatted_chars")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of ``read_back`` rows."""
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join("targets", "").alias("loss"),
        "formatted_chars",
    ).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
