"""Chat formatting with typed content parts.

A message is an ordered array of parts ``struct<type, text, ref, width, height, seconds, pages>``. The visitor turns a
text part into its escaped text and an image, audio or document part into a placeholder repeated once per token that
it stands for, and records an attachment (place among the parts, type, ref, tokens). Messages are then framed as
``<|im_start|>role\\n...<|im_end|>\\n`` and joined per conversation.

Escaping is reversible: ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so that no control string can begin
inside a text; roles have their line feeds escaped too. The loss mask holds the (start, length) of every assistant
text part, in code points of the formatted string.

Built-in expressions only. The one shuffle is by conversation: offsets come from a running sum in the same
partitioning that the final grouping uses. A conversation is one output string, so it must fit in one row.

Defined cases: null text, role or parts count as empty; rows of equal turn go by role, then text; repeated rows are
repeated turns; null turns come first; part types that are not known give no text and an attachment of 0 tokens; a very long conversation is
one row in the memory of one task; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PATCH, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A text as the array of its one part."""
    none = F.lit(None)
    return F.array(
        F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"))
    )


def tokens_of(part: Column) -> Column:
    """Placeholders that a part expands to; 0 for text."""
    zero = F.lit(0)
    patches = F.ceil(F.coalesce(part["width"], zero) / PATCH) * F.ceil(F.coalesce(part["height"], zero) / PATCH)
    return (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_PER_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], zero) * TOKENS_PER_PAGE)
        .otherwise(zero)
        .cast("int")
    )


def visit(part: Column) -> Column:
    """The string that stands for a part."""
    media = F.concat(F.lit("<|"), part["type"], F.lit("|>"))
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).when(part["type"].isin("image", "audio", "document"), F.repeat(media, tokens_of(part))).otherwise(F.lit(""))


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans array<struct<start,length>>, attachments array<struct<turn,part,type,ref,tokens>>."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.select("*", F.transform("parts", visit).alias("pieces"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"))
    rows = rows.withColumn("line", F.concat("head", F.array_join("pieces", ""), F.lit(END + "\n")))
    rows = rows.withColumn("said", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said", "line")
    before = F.coalesce(F.sum(F.char_length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before).withColumn("place", F.row_number().over(order))
    ends = F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.char_length(F.array_join(F.slice("pieces", 1, i - 1), "")))
    spans = F.transform(F.arrays_zip(F.col("parts"), F.col("pieces"), ends.alias("at")), lambda z: F.struct((F.col("start") + F.char_length("head") + z["at"]).alias("start"), F.char_length(z["pieces"]).cast("long").alias("length"), (z["parts"]["type"] == "text").alias("is_text")))
    spans = F.transform(F.filter(spans, lambda s: s["is_text"]), lambda s: F.struct(s["start"], s["length"]))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    rows = rows.withColumn("spans", F.when((F.col("role") == "assistant") & (F.size("parts") > 0), spans).otherwise(none))
    media = F.filter(F.transform("parts", lambda p, i: F.struct(F.col("place").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens"))), lambda a: ~a["type"].eqNullSafe("text"))
    rows = rows.withColumn("media", media)
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "line", "spans", "media"))).alias("all"))
    return got.select(
        "conv_id", F.size("all").cast("long").alias("n_turns"), F.array_join(F.transform("all", lambda t: t["line"]), "").alias("formatted"), F.flatten(F.transform("all", lambda t: t["spans"])).alias("loss_spans"), F.flatten(F.transform("all", lambda t: t["media"])).alias("attachments")
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted string: array<struct<role, text>>."""
    lines = F.split(formatted, r"<\|im_end\|>\n", -1)
    lines = F.slice(lines, 1, F.size(lines) - 1)
    at = lambda x: F.locate("\n", x)
    skip = len(START)
    return F.transform(lines, lambda x: F.struct(unescape_role(F.substring(x, F.lit(skip + 1), at(x) - skip - 1)).alias("role"), unescape(F.substring(x, at(x) + 1, F.char_length(x))).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
