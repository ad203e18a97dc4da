"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn's content is a list of typed parts.  The visitor turns each part into
text: a text part stands for itself, an image, audio or document part becomes
a numbered placeholder, and the attachment's reference and the number of model
tokens it expands to are recorded.  Turns are marked by control strings; every
control string that a text holds is escaped reversibly, so the formatted
conversation can be read back exactly.

Escape: a backslash goes between ``<`` and ``|``, also where backslashes stand
between them already, so no escaped text holds ``<|`` and taking one backslash
out of each ``<\\...\\|`` restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH = 28             # image pixels per token side
AUDIO_PER_SECOND = 25  # tokens
PER_PAGE = 512         # tokens


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles end at the first line break, so theirs become a control string."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def text_part(text: Column) -> Column:
    """The parts of a plain text."""
    none = [F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *none)).cast(f"array<{PART}>")


def expanded_tokens(p: Column) -> Column:
    """Model tokens that a part's placeholder stands for; zero for text, unknown kinds and missing sizes."""
    def up(c: Column) -> Column:
        return F.ceil(c).cast("long")

    n = (F.when(p.kind == "image", up(p.width / PATCH) * up(p.height / PATCH))
         .when(p.kind == "audio", up(p.seconds * AUDIO_PER_SECOND))
         .when(p.kind == "document", p.pages.cast("long") * PER_PAGE))
    return F.greatest(F.coalesce(n, F.lit(0).cast("long")), F.lit(0).cast("long"))


def visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of one turn's parts (array of ``PART``).

    Null parts are skipped; a null text is empty; text parts that follow one another are escaped as
    one text, so no control string can be split over them; a part of another kind is an
    attachment of that kind without tokens.  Attachments are structs (kind, ref,
    tokens), the k-th one's placeholder in the turn is ``<|kind:k|>``."""
    parts = F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>"))
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.coalesce(p.kind, F.lit("text")).alias("kind"), p.alias("p")))
    attached = F.filter(numbered, lambda x: x.kind != "text")
    places = F.transform(attached, lambda x: x.i)

    def placeholder(x: Column) -> Column:
        return F.concat(F.lit("<|"), escape(F.regexp_replace(x.kind, r"[|>]", "")), F.lit(":"),
                        F.array_position(places, x.i).cast("string"), F.lit("|>"))

    # done: text as far as the last placeholder; open: the texts since then, not escaped yet
    content = F.aggregate(numbered, F.struct(F.lit("").alias("done"), F.lit("").alias("open")), lambda a, x: F.when(
        x.kind == "text", F.struct(a.done.alias("done"), F.concat(a.open, F.coalesce(x.p.text, F.lit(""))).alias("open")),
    ).otherwise(F.struct(F.concat(a.done, escape(a.open), placeholder(x)).alias("done"), F.lit("").alias("open"))),
        lambda a: F.concat(a.done, escape(a.open)))
    attachments = F.transform(attached, lambda x: F.struct(
        x.p.kind.alias("kind"), x.p.ref.alias("ref"), expanded_tokens(x.p).alias("tokens")))
    return content, attachments


def format_chats(turns: DataFrame, parts: Column | None = None, learned_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of (start, length) in code
    points over ``formatted``: the contents of ``learned_role``), attachments (in order, with their
    turn), expanded_tokens.

    Turns go by (turn, role, content), nulls first, so ties have one order and repeated rows stay;
    null roles and texts are empty; turns without conv_id form one conversation.  Without ``parts``
    the column ``text`` is the only part.  Only the columns conv_id, turn, role and those of
    ``parts`` are read."""
    content, attached = visit(text_part(F.col("text")) if parts is None else parts)
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    rows = turns.select("conv_id", "turn", "role", content.alias("content"), attached.alias("attached"), head.alias("head"))
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "start": F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head"),
        "nth": F.count(F.lit(1)).over(before)})
    mask = F.when(F.col("role") == learned_role, F.struct(F.col("start"), F.length("content").cast("long").alias("length")))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "nth", "piece", mask.alias("mask"), "attached"))).alias("t"))
    files = F.flatten(F.transform("t", lambda t: F.transform(t.attached, lambda a: F.struct(
        t.nth.alias("turn"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens")))))
    return grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t.piece), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t.mask), lambda m: m.isNotNull()).alias("loss_mask"), files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda n, a: n + a.tokens).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` plus turns (array of (role, content)) parsed from the formatted string, and loss_text,
    the unescaped contents under the mask one after the other."""
    cut = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))
    turns = F.transform(cut, lambda s: F.struct(
        unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.substring(s, F.locate("\n", s) + 1, F.length(s) - F.locate("\n", s) - len(END) - 1)).alias("content")))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(
        F.col("formatted"), (m.start + 1).cast("int"), m.length.cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; read back from the output."""
    back = read_back(format_chats(conversations))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.content, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("loss_mask").cast("long").alias("n_learned"))
