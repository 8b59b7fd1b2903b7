"""Chat formatting with Spark expressions only.

A conversation's rows are sorted by (turn, role, text), neighbours of the same role become one block, and the
blocks are joined to one string:

    <|start|>role<|text|>first text<|next|>second text of the same role<|end|>

Control strings inside a role or a text get one more backslash behind their first character (``<|end|>`` becomes
``<\\|end|>``, ``<\\|end|>`` becomes ``<\\\\|end|>``), so no text can end or open a turn, and reading back takes
one backslash away. Besides the template's own, the control strings of other common templates are escaped.

Long conversations are formatted in runs of ``run`` turns that are aggregated apart and put together afterwards,
so that the first aggregation deals a huge conversation to many tasks; only its finished text meets in one row.

Defined results: null text and null role are empty; a null turn sorts first; rows with equal turn are ordered by
role, then text, and repeated rows all stay; a null conv_id is a conversation of its own; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: What follows the first character and any backslashes of a control string.
_TAIL = r"(\|[A-Za-z_]+\|>|/?s>|/?SYS>>|/?INST\])"
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _TAIL, r"([<\[])\\(\\*)" + _TAIL
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame, run: int = 512) -> DataFrame:
    """(conv_id, formatted) of every conversation in rows (conv_id, turn, role, text)."""
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("run", F.floor(F.col("turn") / run))
    parts = clean.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # A turn opens a block where the role changes; elsewhere it follows its predecessor inside the block.
    body = F.array_join(
        F.transform(
            "turns",
            lambda t, i: F.when(i == 0, t["text"])
            .when(F.col("turns")[i - 1]["role"] == t["role"], F.concat(F.lit(NEXT), t["text"]))
            .otherwise(F.concat(F.lit(END + START), t["role"], F.lit(TEXT), t["text"])),
        ),
        "",
    )
    parts = parts.select(
        "conv_id", F.struct("run", F.col("turns")[0]["role"].alias("first"), F.element_at("turns", -1)["role"].alias("last"), body.alias("body")).alias("part")
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    joined = F.array_join(
        F.transform(
            "parts",
            lambda p, i: F.when((i > 0) & (F.col("parts")[i - 1]["last"] == p["first"]), F.concat(F.lit(NEXT), p["body"])).otherwise(
                F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), p["first"], F.lit(TEXT), p["body"])
            ),
        ),
        "",
    )
    return whole.select("conv_id", F.concat(joined, F.lit(END)).alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns, array of struct(role, text), that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"\Q<|end|>\E"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, TEXT, -1), r"\Q<|next|>\E"),
                lambda t: F.struct(
                    unescape(F.replace(F.substring_index(b, TEXT, 1), F.lit(START), F.lit(""))).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: turns, text under the loss mask (assistant texts), and their digests."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    read = read.select("conv_id", "formatted", "turns", loss.alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
