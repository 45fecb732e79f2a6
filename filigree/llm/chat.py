"""Chat formatting in budgeted windows, with column expressions alone.

A conversation's turns have token counts; their prefix sums choose windows of
whole turns whose new turns fit the budget together with the system turn and a
limited history.  Every window repeats the system turn and as many of the turns
before it as the history allows and as leave room for its first new turn.  Loss falls on the texts of new assistant turns;
repeated ones are masked, so each is learnt once.

A turn is ``<turn role="R" seen="0">TEXT</turn>`` and a line feed; seen is 1 where
it is repeated.  In R and TEXT, ``\\``, ``<``, ``#`` and ``"`` stand as ``\\b``,
``\\l``, ``\\h`` and ``\\q``: no mark of the template can occur in them, and the
way back is unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import blocked, let, part_of, pick, scan

# What is escaped, the backslash first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), ('"', "\\q"))
END = "</turn>\n"


@dataclass(frozen=True)
class Settings:
    #: Tokens of a window: system turn, history and new turns.
    budget: int = 512
    #: Tokens of repeated turns in a window, beside the system turn.
    history: int = 128
    #: Tokens that the template takes for a turn; positive, so a history has few turns.
    overhead: int = 4
    loss_role: str = "assistant"
    system_role: str = "system"


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def token_count(text: Column) -> Column:
    """Runs of letters, marks and digits, and other visible characters one by one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *,
    tokens_col: str | None = None, settings: Settings = Settings(),
) -> DataFrame:
    """Windows of conversations.

    Returns conv_id, window (from 0), formatted, loss (array of start, end: code
    points of formatted that bear loss, end exclusive), tokens, new_turns.

    Turns are taken by turn number, nulls first, then role, then text, so that
    turns with one number have a fixed order; repeated rows are turns of their
    own.  A null role or text is empty.  Rows with a null conversation id form one
    conversation.  The system turn is the first one, if it has that role.  An empty
    table gives no rows.

    ``tokens_col`` names a column of the turns' token counts by the tokenizer that the
    budget is meant for (null counts as 0); without it :func:`token_count` stands for
    one.  A window holds at most the budget's tokens, but for a turn that is longer than
    what the system turn leaves: it has a window of its own, whole and without history.

    A conversation is one training example and has to fit one row, as its window
    rows have to.
    """
    s = settings
    if s.budget < 1 or s.history < 0 or s.overhead < 1:
        raise ValueError("budget and overhead must be positive and history not negative")
    named = {"tokens": tokens_col} if tokens_col else {}
    turns = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col, **named)
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        *([F.greatest(F.coalesce(F.col("tokens").cast("int"), F.lit(0)), F.lit(0)).alias("tokens")] if tokens_col else []),
    )
    count = F.col("tokens") if tokens_col else token_count(F.col("text"))
    # Sorted before it is gathered: only the order counts from here on.
    one = F.struct("turn", "role", "text", (count + s.overhead).cast("int").alias("n"))
    t = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    t = t.withColumn("lead", F.when(F.get("t", F.lit(0))["role"] == s.system_role, 1).otherwise(0))
    t = t.withColumn("lead_n", F.when(F.col("lead") == 1, F.get("t", F.lit(0))["n"]).otherwise(0))
    t = t.withColumn("count", F.size("t") - F.col("lead"))
    t = t.withColumn("room", F.greatest(F.lit(s.budget) - F.col("lead_n"), F.lit(1)).cast("long"))

    def mark(now: Column, x: Column) -> tuple[Column, Column]:
        """Whether a window begins at a turn, and the first turn of its history.

        now: the turn's number, the tokens before it (``sum``), those before the window's
        first turn (``base``), and the turns that a history could begin with.
        """
        through = now["sum"] + x["n"]
        new = (now["i"] > 0) & (through - now["base"] > F.col("room"))
        spare = F.greatest(F.least(F.lit(s.history).cast("long"), F.col("room") - x["n"]), F.lit(0).cast("long"))
        here = F.struct(now["i"].alias("i"), now["sum"].alias("sum"))
        old = F.get(F.filter(now["recent"], lambda r: now["sum"] - r["sum"] <= spare), F.lit(0))
        begin = F.when(new, F.coalesce(old, here)).otherwise(F.struct(F.lit(0).alias("i"), now["base"].alias("sum")))
        recent = F.filter(F.concat(now["recent"], F.array(here)), lambda r: through - r["sum"] <= s.history)
        later = F.struct((now["i"] + 1).alias("i"), through.alias("sum"), begin["sum"].alias("base"), recent.alias("recent"))
        return later, F.struct(now["i"].alias("begin"), begin["i"].alias("first"), (new | (now["i"] == 0)).alias("new"))

    zero = F.lit(0).cast("long")
    state = F.struct(F.lit(0).alias("i"), zero.alias("sum"), zero.alias("base"), F.array().cast("array<struct<i:int,sum:bigint>>").alias("recent"))
    marks = scan(F.slice("t", F.col("lead") + 1, F.size("t")), state, mark, "struct<begin:int,first:int,new:boolean>")
    nothing = F.array(F.struct(F.lit(0).alias("begin"), F.lit(0).alias("first"), F.lit(True).alias("new")))
    marks = F.when(F.col("count") > 0, F.filter(marks, lambda x: x["new"])).otherwise(nothing)

    def shown(x: Column, seen: Column) -> Column:
        return F.struct(
            F.concat(F.lit('<turn role="'), escape(x["role"]), F.lit('" seen="'), seen, F.lit('">')).alias("head"),
            escape(x["text"]).alias("body"),
            (x["role"].eqNullSafe(F.lit(s.loss_role)) & (seen == "0")).alias("bears"),
            x["n"].alias("n"),
        )

    def window(m: Column, k: Column, b: Column) -> Column:
        begin, first, end = m["m"]["begin"], m["m"]["first"], m["end"]
        lead = F.transform(part_of(b, F.lit(0), F.col("lead")), lambda x: shown(x, F.when(k > 0, "1").otherwise("0")))
        old = F.transform(part_of(b, F.col("lead") + first, begin - first), lambda x: shown(x, F.lit("1")))
        new = F.transform(part_of(b, F.col("lead") + begin, end - begin), lambda x: shown(x, F.lit("0")))
        return F.struct(k.alias("window"), F.concat(lead, old, new).alias("turns"), (end - begin + F.when(k == 0, F.col("lead")).otherwise(0)).alias("new_turns"))

    def windows(m: Column, b: Column) -> Column:
        ends = F.concat(F.transform(F.slice(m, F.lit(2), F.size(m)), lambda x: x["begin"]), F.array("count"))
        return F.transform(F.arrays_zip(m.alias("m"), ends.alias("end")), lambda x, k: window(x, k, b))

    rows = t.select("conv_id", F.explode(let(marks, lambda m: let(blocked(F.col("t")), lambda b: windows(m, b)))).alias("w")).select("conv_id", "w.*")
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        mark = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(x["bears"], F.concat(acc["loss"], mark)).otherwise(acc["loss"]).alias("loss"))

    return rows.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", place, step, lambda acc: acc["loss"]).alias("loss"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("tokens"), "new_turns",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations from windows: conv_id, turns (array of role, text), losses
    (array of texts under the loss mask, in order), formatted_chars, windows."""
    pieces = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    parsed = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, r'^<turn role="([^"]*)"', 1)).alias("role"),
            unescape(F.regexp_extract(x, r'(?s)^<turn role="[^"]*" seen="[01]">(.*)$', 1)).alias("text"),
            (F.regexp_extract(x, r'^<turn role="[^"]*" seen="([01])"', 1) == "0").alias("new"),
        ),
    )
    fresh = F.transform(F.filter(parsed, lambda x: x["new"]), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    lost = F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])))
    one = windows.select("conv_id", F.struct("window", fresh.alias("turns"), lost.alias("losses"), F.length("formatted").alias("chars")).alias("w"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["losses"])).alias("losses"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"), F.size("w").alias("windows"),
    )
