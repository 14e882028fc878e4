"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged (the positions where the
role changes name the slices that are gathered), and the blocks are concatenated. The template writes a block as
<turn:ROLE>TEXT</turn>, and marks the seam of merged turns with <turn+>. Inside roles and texts the strings that could be
read as marks are escaped, so formatted text can be read back turn by turn; loss_spans are the places of the assistant's
texts in it, in UTF-8 bytes, so that none is searched for from the beginning.

No array or text grows turn by turn: work is in proportion to a conversation's length, but for the sums of lengths, which
take n * sqrt(n) additions for n turns. A conversation is one row and so must fit in a task.

Contract of the cases: a null text or role counts as empty; turns are ordered by (turn, role, text), null turns first, so
ties and repeated rows have one order and all stay; empty texts stay as empty turns; rows without a conv_id are one
conversation; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
OPEN, CLOSE, SEAM, OPEN_END = "<turn:", "</turn>", "<turn+>", ">"
#: What is written for a backslash and for the beginnings of marks; the order is that of escaping.
ESCAPES = [("\\", "\\b"), ("<turn", "\\o"), ("</turn", "\\c")]
#: A role stands before the end of an opening mark, which it must not hold.
ROLE_ESCAPES = [*ESCAPES, (">", "\\g")]
LOSS_ROLE = "assistant"


def escape(text: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    """text without marks; after a backslash only the letters of escapes follow, so unescape can undo it."""
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def with_sums_before(rows: DataFrame, lengths: str) -> DataFrame:
    """rows with _before: for each of an array of ints the sum of those before it, by way of the sums of stretches of sqrt(n)."""
    zero, add = F.lit(0), lambda a, x: a + x
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    rows = rows.select("*", step.alias("_step"), F.ceil(F.size(lengths) / step).cast("int").alias("_n"))
    own = lambda k: F.slice(lengths, k * F.col("_step") + 1, F.col("_step"))
    numbers = F.when(F.col("_n") > 0, F.sequence(zero, F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", F.transform(numbers, lambda k: F.aggregate(own(k), zero, add)).alias("_stretches"))
    rows = rows.select("*", F.transform("_stretches", lambda _, k: F.aggregate(F.slice("_stretches", F.lit(1), k), zero, add)).alias("_until"))
    within = lambda total, k: F.transform(own(k), lambda _, i: total + F.aggregate(F.slice(lengths, k * F.col("_step") + 1, i), zero, add))
    return rows.select("*", F.flatten(F.transform("_until", within)).alias("_before"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, counted from 1, and len in UTF-8 bytes of formatted)."""
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns, starts, size = F.col("turns"), F.col("starts"), F.size("turns")
    changes = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, F.greatest(i - 1, F.lit(0)))["role"]))
    rows = rows.select("conv_id", "turns", changes.alias("starts"))

    def block(s: Column, k: Column) -> Column:
        own = F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), size) - s)
        role = F.get(turns, s)["role"]
        return F.struct(F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(OPEN_END)).alias("head"), F.transform(own, lambda t: escape(t["text"])).alias("texts"), (role == LOSS_ROLE).alias("loss"))

    rows = rows.select("conv_id", F.transform(starts, block).alias("blocks"))

    def pieces(b: Column) -> Column:
        """What stands before and after each text of a block and how long the text is, in bytes."""
        before = lambda i: F.when(i == 0, F.octet_length(b["head"])).otherwise(F.lit(len(SEAM)))
        after = lambda i: F.when(i == F.size(b["texts"]) - 1, F.lit(len(CLOSE))).otherwise(F.lit(0))
        return F.transform(b["texts"], lambda t, i: F.struct(before(i).alias("before"), F.octet_length(t).alias("len"), (before(i) + F.octet_length(t) + after(i)).alias("all"), b["loss"].alias("loss")))

    body = F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], SEAM), F.lit(CLOSE)))
    rows = rows.select("conv_id", F.array_join(body, "").alias("formatted"), F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    rows = rows.select("conv_id", "formatted", "pieces", F.transform("pieces", lambda x: x["all"]).alias("lengths"))
    rows = with_sums_before(rows, "lengths")
    placed = F.zip_with("pieces", "_before", lambda x, at: F.struct((at + x["before"] + 1).alias("start"), x["len"].alias("len"), x["loss"].alias("loss")))
    spans = F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len")))
    return rows.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array<struct<role, text>>, one element for each turn formatted) and loss (the text under loss_spans)."""
    pattern = rf"(?s){OPEN}([^{OPEN_END}]*){OPEN_END}(.*?){CLOSE}"
    roles = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(2))

    def turns_of(role: Column, body: Column) -> Column:
        texts = F.split(body, r"<turn\+>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(t).alias("text")))

    turns = F.flatten(F.zip_with(roles, bodies, turns_of))
    # formatted_bytes keeps _data a column of its own, which is not made anew for every span
    data = formatted.select("*", F.col("formatted").cast("binary").alias("_data"))
    data = data.select("*", F.length("_data").alias("formatted_bytes"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("_data"), s["start"], s["len"]).cast("string"))), "")
    return data.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), F.size(roles).cast("long").alias("n_blocks"), "formatted_bytes")


def digest(back: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_blocks",
    )
