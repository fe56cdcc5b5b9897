"""Chat formatting with typed content parts, in DataFrame functions only.

A message's parts (text, image, audio, document) are visited in order: a text
stays, any other part becomes a placeholder with the running number of its
attachment, and the attachments' references and expanded token counts are kept
in arrays. Every turn is framed by markers that hold "<" or "["; inside texts and
roles these characters and the escape character are escaped, so no text can hold
a marker, and reading the output back gives the texts unchanged.

Defined cases: null text, role and parts count as empty; an unknown or null part
type is kept as a text part; rows of a conversation go by turn, then role, then
text; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[TURN]", "[/ROLE]", "[/TURN]</s>"
PART = "struct<type:string,text:string,ref:string,tokens:long>"
#: Tokens that an attachment takes where its part gives none.
TOKENS = {"image": 576, "audio": 150, "document": 1024}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Splits at doubled escape characters first, so what they hid stays hidden."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def visit(parts: Column) -> Column:
    """struct(body, refs, tokens): texts escaped and joined in order, placeholders for the rest."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    attached = F.filter(parts, lambda p: p["type"].isin(*TOKENS))
    number = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda p: p["type"].isin(*TOKENS)))
    body = F.transform(
        parts,
        lambda p, i: F.when(p["type"].isin(*TOKENS), F.concat(F.lit("<"), p["type"], F.lit(" "), number(i).cast("string"), F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))),
    )
    default = F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])
    return F.struct(
        F.array_join(body, "").alias("body"),
        F.transform(attached, lambda p: p["ref"]).alias("refs"),
        F.transform(attached, lambda p: F.coalesce(p["tokens"], default[p["type"]].cast("long"))).alias("tokens"),
    )


def format_chats(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, parts) → conv_id, formatted, attachments, attachment_tokens,
    loss (array of struct(start, length): where assistant texts stand in ``formatted``)."""
    seen = messages.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts")).alias("v")).alias("m"))
    turns = seen.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("turns"))
    head = lambda m: F.concat(F.lit(OPEN), escape(m["role"]), F.lit(MIDDLE))
    framed = turns.select(
        "conv_id",
        "turns",
        F.transform("turns", lambda m: F.concat(head(m), m["v"]["body"], F.lit(CLOSE))).alias("frames"),
    )
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.char_length(head(m)) + F.char_length(m["v"]["body"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(
                m["role"] == "assistant",
                F.array_append(acc["spans"], F.struct((acc["at"] + F.char_length(head(m))).cast("long").alias("start"), F.char_length(m["v"]["body"]).cast("long").alias("length"))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return framed.select(
        "conv_id",
        F.array_join("frames", "").alias("formatted"),
        F.flatten(F.transform("turns", lambda m: m["v"]["refs"])).alias("attachments"),
        F.flatten(F.transform("turns", lambda m: m["v"]["tokens"])).alias("attachment_tokens"),
        starts.alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted chat: array of struct(role, text), unescaped."""
    frames = F.filter(F.split(formatted, r"\[/TURN\]</s>", -1), lambda f: f != "")
    return F.transform(
        frames,
        lambda f: F.struct(
            unescape(F.substring_index(F.substr(f, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substr(f, F.locate(MIDDLE, f) + len(MIDDLE))).alias("text"),
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    turns = read_back(F.col("formatted"))
    return chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(masked(F.col("formatted"), F.col("loss"))).cast("long").alias("loss_chars"),
        F.sha2(masked(F.col("formatted"), F.col("loss")), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
