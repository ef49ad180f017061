"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all
turns before it as context and only its reply to be learnt.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Roles and texts may hold anything: a backslash is
doubled, and a control string gets one behind its first character, so that none is left whole inside a
text and taking the backslashes out again gives back what was there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the template.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What tokenizers of common chat models read as a command.
CONTROL = (START, SEPARATOR, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """``text`` with no control string in it; :func:`unescaped` is its inverse."""
    return reduce(lambda out, mark: F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}")), CONTROL, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """``conv_id, example, n_turns, formatted, loss_start, loss_end, last``: an example (numbered from 0) for each turn of
    the role ``trained``. ``formatted`` holds its ``n_turns`` turns; the reply's own text is what lies between the
    offsets (code points), and nothing else is under the loss mask. Turns behind the last such turn, or all
    of a conversation without one, become a further example whose offsets are equal, so no turn is
    lost. ``last`` is true for the example with all turns.

    Turns go by ``turn_col``, equal ones by role and text, repeated rows each; nulls come first. A null role
    or text is empty; null ids are one conversation; other columns are ignored; an empty table gives no rows.
    A conversation is gathered into one row, as its last example is one text; texts of the other
    examples are prefixes, cut one row at a time. Their total length is quadratic in a conversation's
    turns, which is what the method asks for."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"))
    inner = turns.select("*", escaped(F.col("role")).alias("_role"), escaped(F.col("text")).alias("_text"))
    written = inner.select("conv_id", "turn", "role", "text", F.char_length("_text").alias("size"), F.concat(F.lit(START), "_role", F.lit(SEPARATOR), "_text", F.lit(END)).alias("written"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = F.sum(F.char_length("written")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    placed = written.select("conv_id", F.struct(F.row_number().over(order).alias("n"), so_far.alias("end"), "size", (F.col("role") == trained).alias("trained"), "written").alias("turn"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    targets = F.filter(F.transform("turns", lambda t: t.dropFields("written")), lambda t: t["trained"] | (t["n"] == F.size("turns")))
    each = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("whole"), F.size("turns").alias("all"), F.posexplode(targets).alias("example", "target"))
    stop = F.col("target.end") - len(END)
    return each.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.col("target.n").cast("long").alias("n_turns"), F.substring("whole", F.lit(1), F.col("target.end")).alias("formatted"),
        F.when(F.col("target.trained"), stop - F.col("target.size")).otherwise(stop).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end"), (F.col("target.n") == F.col("all")).alias("last"))


def learnt() -> Column:
    """The text under an example's loss mask, as it was before it was escaped."""
    return unescaped(F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))


def turns_of(formatted: Column) -> Column:
    """``role, text`` of each turn of a formatted text, read back."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substring(p, F.lit(len(START) + 1), F.char_length(p)), r"\Q" + SEPARATOR + r"\E", 2))
    return F.transform(turns, lambda t: F.struct(unescaped(t[0]).alias("role"), unescaped(t[1]).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations out of :func:`examples`: ``conv_id, turns`` (role and text), ``learnt`` (the trained texts in order)
    and ``formatted_chars`` (code points of all its examples)."""
    rows = formatted.select(
        "conv_id", F.when(F.col("last"), turns_of(F.col("formatted"))).alias("turns"), F.struct("example", learnt().alias("text")).alias("learnt"),
        F.char_length("formatted").cast("long").alias("chars"))
    found = rows.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), F.sort_array(F.collect_list("learnt")).alias("learnt"), F.sum("chars").alias("formatted_chars"))
    return found.withColumn("learnt", F.transform("learnt", lambda x: x["text"]))
