"""Chat formatting by prefix-target expansion. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a turn: `<s>role`, a line feed, the text, `</s>`.
OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    """Reversible: afterwards the text holds neither `<` nor `[`, so no control string."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("&lb;", "["), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One example per turn of the role `target`: all turns before it, then that turn.

    Returns conv_id, example (from 0), formatted, loss_start and loss_end (code points from 0, the
    escaped text of the last turn, end exclusive). Turns after the last reply, or of a conversation
    without one, come as one more row whose loss span is null, so that nothing is lost.

    Turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of their
    own. Null text and null role count as empty. An empty table gives no rows; other columns are
    ignored. A conversation's turns are gathered into one row, since each example repeats them."""
    rows = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    marked = convs.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))).alias("marked"),
        F.transform("ts", lambda t: t["role"] == target).alias("is_target"),
        F.transform("ts", lambda t: F.length(escape(t["text"]))).alias("chars"),
    )
    last = F.size("marked") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("is_target", i) | (i == last))
    examples = marked.select("conv_id", "marked", "is_target", "chars", F.posexplode(ends).alias("example", "k"))
    out = examples.select(
        "conv_id", "example", F.array_join(F.slice("marked", F.lit(1), F.col("k") + 1), "").alias("formatted"),
        F.get("is_target", F.col("k")).alias("trains"), F.get("chars", F.col("k")).alias("n"),
    )
    end = F.when(F.col("trains"), F.length("formatted") - len(CLOSE))
    return out.select("conv_id", "example", "formatted", (end - F.col("n")).cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, and the text under the loss mask."""
    got = examples.select(
        "conv_id", "example", "formatted",
        F.when(F.col("loss_end").isNotNull(), unescape(F.expr("substring(formatted, int(loss_start) + 1, int(loss_end - loss_start))"))).alias("loss"),
        F.length("formatted").alias("n"),
    )
    per = got.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("n").cast("long").alias("formatted_chars"),
    )
    parts = F.filter(F.split("whole", CLOSE), lambda x: x != "")
    turn = lambda x: F.concat(unescape_role(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)), F.lit("\n"), unescape(F.substr(x, F.instr(x, "\n") + 1)), F.lit("\n"))
    per = per.select("conv_id", "formatted_chars", F.transform(parts, turn).alias("turns"), F.array_join("losses.loss", "").alias("loss"))
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
