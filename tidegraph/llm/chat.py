"""Chat formatting with typed content parts, in DataFrame operations only.

A visitor walks a turn's parts: text is escaped, an image, audio or document part becomes an ordered placeholder and is
recorded as an attachment with its reference and the tokens it expands to. A turn is
`<|turn|>role<|body|>text<|end|>`. Inside roles and texts the escape character U+241B becomes U+241B 0, and each
control string gets U+241B 1 behind its first character; undoing both in reverse order restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESC = "␛"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: The first character of a control string: our own marks, and those of common public templates.
CONTROL = r"(?i)[<\[](?=\||/?s>|/?INST\]|<?/?SYS>>|/?(?:image|audio|document):)"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(ESC), F.lit(ESC + "0")), CONTROL, "$0" + ESC + "1")


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def expanded_tokens(part: Column, patch: int = 14, audio_rate: float = 12.5, page_tokens: int = 576) -> Column:
    """Tokens that an attachment stands for: image patches, audio frames, pages; 0 where its measures are missing."""
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / patch)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate)
    pages = F.coalesce(part["pages"], F.lit(0)).cast("long") * page_tokens
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages).otherwise(F.lit(0)).cast("long")


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """(text, attachments) of a turn's content parts, in order.

    Placeholders are `<|image:0|>`, numbered over the turn's attachments; text parts and parts of unknown type give
    their escaped text; null parts and null texts give nothing.
    """
    parts = F.coalesce(parts, F.array().cast(PARTS))
    media = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    attached = F.filter(parts, media)
    attachments = F.transform(attached, lambda p, i: F.struct(i.alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    place = lambda p, i: F.concat(F.lit("<|"), p["type"], F.lit(":"), F.size(F.filter(F.slice(parts, F.lit(1), i), media)).cast("string"), F.lit("|>"))
    texts = F.transform(parts, lambda p, i: F.when(media(p), place(p, i)).otherwise(escape(F.coalesce(p["text"], F.lit("")))))
    return F.array_join(texts, ""), attachments


def text_part(text: Column) -> Column:
    """A plain text as one content part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))).cast(PARTS)


def format_chats(turns: DataFrame, loss_roles=("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments), one row per conversation.

    loss_spans: array of (start, length) in code points of formatted, the bodies of loss_roles' turns in order.
    attachments: array of (turn, index, type, ref, tokens). Turns are ordered by turn, null first, then role and text;
    repeated rows are turns of their own. Null texts and roles are empty; rows with a null conv_id are one
    conversation; an empty table gives an empty result; extra columns are not read. A conversation is one string, so
    its turns meet in one task.
    """
    parts = F.col(parts_col) if parts_col else text_part(F.col(text_col))
    body, attached = visit_parts(parts)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), body.alias("body"), attached.alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.select("*", head.alias("head")).withColumn("size", F.char_length("head") + F.char_length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.withColumns({"at": F.row_number().over(order), "start": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.char_length("head")})
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "head", "body", "start", "attached"))).alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    spans = F.transform(F.filter("t", lambda x: x["role"].isin(*loss_roles)), lambda x: F.struct(x["start"].alias("start"), F.char_length(x["body"]).cast("long").alias("length")))
    files = F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(x["turn"].alias("turn"), a["index"].alias("index"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return rows.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), files.alias("attachments"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Reads format_chats' output back: adds turns, an array of (role, text), and loss_text, from formatted and spans."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    cut = lambda p: F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), unescape(F.substring(p, F.instr(p, BODY) + len(BODY), F.char_length(p) - F.instr(p, BODY) - len(BODY) - len(END) + 1)).alias("text"))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumns({"turns": F.transform(pieces, cut), "loss_text": F.array_join(masked, "")})
