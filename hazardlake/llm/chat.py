"""Chat formatting in budgeted windows.

Turns get prefix sums of their tokens. Windows are turn-aligned spans of a grid
over these sums: a turn belongs to the cell in which it begins. A cell is half
of what the budget leaves after history and system turn, so a cell and the end
of its last turn fit; a turn that is longer than a cell is the last of its cell
and gets a window of its own. Every window starts with the conversation's first
system turn, repeats the turns that begin within ``history`` tokens before it,
and then has its new turns. The window of a long turn repeats as many of these,
the nearest first, as the budget leaves room for beside it. Only new assistant texts are under the loss mask, so
each is learned once.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts ``\\``
becomes ``\\\\`` and ``<|`` becomes ``<\\|``; no control string can then appear
inside them, and replacing ``\\x`` by ``x`` gives the text back.

Prefix sums and positions are two-level (stretches of turns, then inside one),
so a conversation with a third of all rows is not sorted in one task.

Cases: null role or text is empty; rows are ordered by turn (null last), then
role, then text, so ties and repeated rows have a fixed order; rows without
conversation id form one conversation; an oversize turn stays whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.llm.common import join_same, stage

# fixed values: the control strings of the template
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
STRETCH = 64


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def token_count(text: Column) -> Column:
    """Words and single marks; the default measure of a turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def turns_in_order(conv: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, tokens, seq (position) and start (tokens before)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = conv.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        text.alias("text"),
        (token_count(text) + 4).cast("bigint").alias("tokens"),  # with the marks around it
    )
    last = F.lit((1 << 62)).cast("bigint")
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH).cast("bigint"), last))
    sums = rows.groupBy("conv", "stretch").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = sums.select("conv", "stretch", F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.coalesce(F.sum("n").over(before), zero).alias("n0"))
    w = Window.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = join_same(rows, sums, ["conv", "stretch"])
    return placed.select(
        "conv", "turn", "role", "text", "tokens",
        (F.col("n0") + F.row_number().over(w)).alias("seq"),
        (F.col("t0") + F.coalesce(F.sum("tokens").over(upto), zero)).alias("start"),
    )


def chat_windows(
    conv: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 1024,
    history: int = 128,
    learned_role: str = "assistant",
    system_role: str = "system",
) -> DataFrame:
    """conv id, window, formatted, loss (spans of code points), fresh (per turn: not a repeat)."""
    rows = stage(turns_in_order(conv, conv_col, turn_col, role_col, text_col), "turns")
    system = rows.filter(F.col("role") == system_role).groupBy("conv").agg(F.min_by(F.struct("seq", "tokens", "role", "text"), "seq").alias("system"))
    rows = join_same(rows, system.select("conv", F.col("system.tokens").alias("st"), F.col("system.seq").alias("sq")), ["conv"], "left")
    cell = F.greatest(F.lit(1).cast("bigint"), F.floor((F.lit(budget - history) - F.coalesce("st", F.lit(0))) / 2))
    rows = rows.withColumn("cell", cell)
    long = F.when(F.col("tokens") > F.col("cell"), 1).otherwise(0)
    rows = rows.withColumn("window", F.floor(F.col("start") / F.col("cell")) * 2 + long)
    # tokens left beside a long turn, which is alone in its window; the other windows have room for all history
    told_too = F.when(F.col("sq") != F.col("seq"), F.col("st"))
    room = F.when(F.col("tokens") > F.col("cell"), budget - F.col("tokens") - F.coalesce(told_too, F.lit(0)))
    spans = rows.groupBy("conv", "window").agg(F.min("start").alias("from"), F.min("seq").alias("head"), F.min(room).alias("room"))

    item = F.struct("seq", F.lit(True).alias("fresh"), "role", "text").alias("item")
    new = rows.select("conv", "window", item)
    # windows that begin within `history` tokens after this turn began
    first, reach = F.floor(F.col("start") / F.col("cell")), F.floor((F.col("start") + history) / F.col("cell"))
    old = F.struct("seq", F.lit(False).alias("fresh"), "role", "text").alias("item")
    earlier = rows.filter(F.col("sq").isNull() | (F.col("seq") != F.col("sq")))
    windows = F.sequence(first * 2, reach * 2 + 1)
    earlier = earlier.select("conv", "start", "seq", "sq", "st", old, F.explode(windows).alias("window"))
    # the system turn is counted once, in `room`
    told_between = F.when((F.col("sq") > F.col("seq")) & (F.col("sq") < F.col("head")), F.col("st"))
    needed = F.col("from") - F.col("start") - F.coalesce(told_between, F.lit(0))
    repeats = join_same(earlier, spans, ["conv", "window"]).filter(
        (F.col("head") > F.col("seq")) & (F.col("from") <= F.col("start") + history) & (F.col("room").isNull() | (needed <= F.col("room")))
    )
    told = join_same(spans, system, ["conv"]).select(
        "conv", "window", F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("fresh"), F.col("system.role").alias("role"), F.col("system.text").alias("text")).alias("item"), F.col("system.seq").alias("sq"),
    )
    own = rows.filter(F.col("seq") == F.col("sq")).select("conv", F.col("window").alias("own"))
    told = join_same(told, own, ["conv"]).filter(F.col("own") != F.col("window")).select("conv", "window", "item")
    parts = new.unionByName(repeats.select("conv", "window", "item")).unionByName(told)
    # a window's turns are bounded by the budget, or by its one oversize turn
    listed = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list("item")).alias("items"))
    listed = listed.withColumn("texts", F.transform("items", lambda x: escaped(x["text"])))
    listed = listed.withColumn(
        "marked",
        F.transform("items", lambda x, i: F.concat(F.lit(START), escaped(x["role"]), F.lit(SEP), F.get("texts", i), F.lit(END))),
    )
    ends = F.aggregate(
        "marked",
        F.array(F.lit(0)),
        lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(m))),
    )
    listed = listed.withColumn("ends", ends)
    span = F.transform(
        "items",
        lambda x, i: F.when(
            x["fresh"] & (x["role"] == learned_role),
            F.struct(
                (F.get("ends", i + 1) - len(END) - F.length(F.get("texts", i))).alias("start"),
                (F.get("ends", i + 1) - len(END)).alias("end"),
            ),
        ),
    )
    return listed.select(
        F.col("conv").alias(conv_col),
        "window",
        F.concat_ws("", "marked").alias("formatted"),
        F.filter(span, lambda s: s.isNotNull()).alias("loss"),
        F.transform("items", lambda x: x["fresh"]).alias("fresh"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted windows say: turns and learned text of every conversation."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    turn = lambda p: F.concat(
        unescaped(F.substring_index(p, SEP, 1)), F.lit("\n"), unescaped(F.substring_index(F.substring_index(p, SEP, -1), END, 1)), F.lit("\n")
    )
    turns = F.transform(F.filter(F.arrays_zip(pieces.alias("p"), F.col("fresh").alias("f")), lambda x: x["f"]), lambda x: turn(x["p"]))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    read = windows.select(
        conv_col, "window", F.length("formatted").alias("chars"), F.size(turns).alias("n"), F.concat_ws("", turns).alias("turns"), F.concat_ws("", learned).alias("learned")
    )
    # a digest of a conversation needs its whole text in one value
    whole = read.groupBy(conv_col).agg(
        F.sum("n").cast("bigint").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
    )
    learned_text = F.concat_ws("", "w.learned")
    return whole.select(
        conv_col,
        "n_turns",
        F.sha2(F.concat_ws("", "w.turns"), 256).alias("turns_sha256"),
        F.length(learned_text).cast("bigint").alias("loss_chars"),
        F.sha2(learned_text, 256).alias("loss_sha256"),
        "formatted_chars",
    )
