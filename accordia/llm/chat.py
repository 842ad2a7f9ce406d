r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become a run; runs are
concatenated as

    ### ROLE: <turn>TEXT</turn><turn>TEXT</turn>\n

where in ROLE and TEXT `\` is written `\b`, `<` is written `\l` and `#` is written `\h`. The template's marks hold a `<`
or `#` each, so that no text can hold a mark, and unescaping restores every text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, OPEN, CLOSE, END = "### ", ": ", "<turn>", "</turn>", "\n"
LOSS_ROLE = "assistant"
#: Segments that are placed at a time, and code points of a piece of output that is read at a time.
BLOCK, PIECE = 256, 1 << 14
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; written out in a lambda, it would be anew for each element."""
    return F.transform(F.array(value), body)[0]


def _runs(turns: Column) -> Column:
    """Sorted turns -> array of runs (role, texts): adjacent turns of one role are merged, their texts kept apart."""
    n = F.size(turns)
    index = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(index, lambda i: (i == 1) | (turns[i - 1]["role"] != turns[F.greatest(i - 2, F.lit(0))]["role"]))
    following = lambda at: F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(n + 1))
    bounds = let(begins, lambda at: F.zip_with(at, following(at), lambda b, e: F.struct(b.alias("begin"), e.alias("end"))))
    return F.transform(bounds, lambda x: F.struct(turns[x["begin"] - 1]["role"].alias("role"), F.transform(F.slice(turns, x["begin"], x["end"] - x["begin"]), lambda t: t["text"]).alias("texts")))


def _segments(runs: Column) -> Column:
    """Runs -> pieces of the output, each with whether the loss counts it."""
    mark = lambda text: F.struct(F.lit(False).alias("loss"), text.alias("text"))
    body = lambda run: F.flatten(F.transform(run["texts"], lambda t: F.array(mark(F.lit(OPEN)), F.struct((run["role"] == LOSS_ROLE).alias("loss"), escape(t).alias("text")), mark(F.lit(CLOSE)))))
    return F.flatten(F.transform(runs, lambda run: F.concat(F.array(mark(F.concat(F.lit(HEAD), escape(run["role"]), F.lit(MID)))), body(run), F.array(mark(F.lit(END))))))


def _blocks(n: Column) -> Column:
    """Numbers, from 0, of the blocks of BLOCK that n things make; one at least."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(n / BLOCK) - 1, F.lit(0)).cast("int"))


def _spans(segments: Column) -> Column:
    """Places (begin, end), in code points, of the segments under the loss.

    Growing an array in an aggregate copies it each time: places are summed by block, then within each block.
    """
    block = lambda b: F.slice(segments, b * BLOCK + 1, F.lit(BLOCK))
    zero = F.lit(0).cast("long")
    sizes = F.transform(_blocks(F.size(segments)), lambda b: F.aggregate(block(b), zero, lambda n, x: n + F.length(x["text"])))
    starts = F.aggregate(sizes, F.array(zero), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x["text"])
        grown = F.concat(state["spans"], F.array(F.struct(state["at"].alias("begin"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["loss"], grown).otherwise(state["spans"]).alias("spans"))

    inner = lambda start, b: F.aggregate(block(b), F.struct(start.alias("at"), none.alias("spans")), step, lambda state: state["spans"])
    return F.flatten(F.transform(F.slice(starts, F.lit(1), F.size(sizes)), inner))


def _cut_out(text: Column, spans: Column) -> Column:
    """The texts of spans. Places are found from the start of a text each time, hence first cut into pieces of PIECE."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda k: F.call_function("substring", text, k * PIECE + 1, F.lit(PIECE)))
    piece = lambda at: F.floor(at / PIECE).cast("int")
    near = lambda held, s: F.array_join(F.slice(held, piece(s["begin"]) + 1, piece(s["end"]) - piece(s["begin"]) + 1), "")
    return let(pieces, lambda held: F.transform(spans, lambda s: F.call_function("substring", near(held, s), (s["begin"] % PIECE + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, formatted, loss_spans (begin, end in code points).

    Turns sort by turn (null first), then role and text; repeated rows stay. A null role or text is empty; a null conv
    is a conversation. Other columns are ignored. An empty table gives an empty result. A conversation is one row of
    the result, and so is the most that a task must hold; grouping collects its turns in parts before the shuffle.
    """
    turns = F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    grouped = rows.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(turns).alias("turns"))
    cut = grouped.select("conv", _segments(_runs(F.col("turns"))).alias("segments"))
    return cut.select("conv", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), _spans(F.col("segments")).alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """From format_chats' output alone: conv, turns (role, text in order), loss_text (unescaped)."""
    runs = F.slice(F.split(F.col("formatted"), HEAD), 2, F.greatest(F.size(F.split(F.col("formatted"), HEAD)), F.lit(1)))
    role = lambda run: unescape(F.substring_index(run, MID + OPEN, 1))
    texts = lambda run: F.slice(F.split(run, OPEN), 2, F.greatest(F.size(F.split(run, OPEN)), F.lit(1)))
    turns = F.flatten(F.transform(runs, lambda run: F.transform(texts(run), lambda t: F.struct(role(run).alias("role"), unescape(F.substring_index(t, CLOSE, 1)).alias("text")))))
    under = F.transform(_cut_out(F.col("formatted"), F.col("loss_spans")), unescape)
    return chats.select("conv", turns.alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of format_chats' rows, read back from its output alone.

    A null conv stays one; a conversation without the loss's role has a loss of 0 characters.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(chats).select(
        F.col("conv").alias(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), "formatted_chars",
    )
