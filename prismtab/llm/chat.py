"""Chat formatting by relational expressions only.

The turns of a conversation are collected as structs, sorted, and turned into one string:

    <|im_start|>role\\ntext<|next|>text<|im_end|>\\n...

Adjacent turns of one role share a block; <|next|> keeps them apart. Inside texts and roles a
backslash is put between `<` (and the backslashes behind it) and `|`, so control strings only come from
the template, and taking one backslash away restores the text. A line end inside a role becomes
<|nl|>. The loss mask is a list of runs (characters, in the loss or not) over the formatted string; it
covers the texts of the loss roles.

Null roles and texts count as empty. Turns are ordered by turn (null first), then role and text, so
ties and rows that repeat are in a fixed order and all kept. Rows with a null conv_id belong to no other
row: each is a conversation of its own, so many of them never meet. An empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, NEXT, END, LINE = "<|im_start|>", "<|next|>", "<|im_end|>\n", "<|nl|>"
LOSS_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_roles=LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted, loss_runs): loss_runs are structs (chars, loss) in order over formatted."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(conv_id).alias("conv_id"), alone.alias("_alone"), one.alias("_one"))
    chats = rows.groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list("_one")).alias("turns"))
    lit = F.lit

    def piece(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        head = F.when(before.eqNullSafe(t["role"]), lit(NEXT)).otherwise(
            F.concat(lit(START), F.replace(escaped(t["role"]), lit("\n"), lit(LINE)), lit("\n")))
        tail = F.when(after.eqNullSafe(t["role"]), lit("")).otherwise(lit(END))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), tail.alias("tail"),
                        t["role"].isin(*loss_roles).alias("loss"))

    chats = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    runs = F.flatten(F.transform("pieces", lambda p: F.array(
        F.struct(F.length(p["head"]).alias("chars"), lit(False).alias("loss")),
        F.struct(F.length(p["body"]).alias("chars"), p["loss"].alias("loss")),
        F.struct(F.length(p["tail"]).alias("chars"), lit(False).alias("loss")))))
    return chats.select("conv_id", whole.alias("formatted"), runs.alias("loss_runs"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) from formatted chats: turns are structs (role, text); loss_texts what lies under
    the loss mask, cut from the formatted string at the running sums of its runs; all unescaped."""
    blocks = F.transform(F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30), lambda b: F.struct(
        unescaped(F.replace(F.substring_index(b, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"),
        F.substring_index(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2), END, 1).alias("texts")))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(
        F.split(b["texts"], r"<\|next\|>", -1), lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))
    read = chats.select("conv_id", "formatted", "loss_runs", blocks.alias("blocks")).select(
        "conv_id", "formatted", "loss_runs", turns.alias("turns"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("found"))
    under = F.aggregate("loss_runs", start, lambda state, run: F.struct(
        (state["at"] + run["chars"]).alias("at"),
        F.when(run["loss"], F.concat(state["found"], F.array(unescaped(F.substr(F.col("formatted"), state["at"], run["chars"])))))
        .otherwise(state["found"]).alias("found")), lambda state: state["found"])
    return read.withColumn("loss_texts", under)


def chat_digests(turns: DataFrame, **options) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    read = read_back(format_chats(turns, **options))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.array_join("loss_texts", "").alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
                       F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
