"""Chat formatting with typed content parts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks of the template. <|turn|>role, a newline, the content, <|end|>, a newline.
TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings that are escaped inside texts: what the template's own marks begin with, and marks of other common templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
#: Tokens that one unit of an attachment takes: image tiles, audio seconds, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,uri:string,units:bigint>"


def escape(text: Column) -> Column:
    """Reversible: & becomes &amp;, then the first character of each control string becomes a character reference."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"&#{ord(c[0])};{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in dict.fromkeys(c[0] for c in CONTROL):
        out = F.replace(out, F.lit(f"&#{ord(c)};"), F.lit(c))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A content of one text part; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("bigint").alias("units")))


def visit(parts: Column, first: Column) -> tuple[Column, Column]:
    """What a turn's parts come to: the content string, and the attachments as an array of (ordinal, kind, uri, tokens).

    Text is escaped, neighbouring text parts as one, so that no control string arises where they meet. Each other part becomes the placeholder <|kind:ordinal|>; ordinals count the conversation's attachments from
    `first`. A null part is skipped, a null kind counts as text.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    before = lambda i: first + F.size(F.filter(F.slice(parts, 1, i), lambda q: ~is_text(q)))
    mark = lambda p, i: F.concat(F.lit("<|"), escape(p["kind"]), F.lit(":"), before(i).cast("string"), F.lit("|>"))
    said = F.transform(parts, lambda p, i: F.struct(is_text(p).alias("text"), F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(mark(p, i)).alias("said")))
    content = F.aggregate(
        said,
        F.struct(F.lit("").alias("done"), F.lit("").alias("run")),
        lambda a, x: F.struct(
            F.when(x["text"], a["done"]).otherwise(F.concat(a["done"], escape(a["run"]), x["said"])).alias("done"),
            F.when(x["text"], F.concat(a["run"], x["said"])).otherwise("").alias("run"),
        ),
        lambda a: F.concat(a["done"], escape(a["run"])),
    )
    per = F.create_map(*[x for k, v in UNIT_TOKENS.items() for x in (F.lit(k), F.lit(v))])
    made = F.transform(
        parts,
        lambda p, i: F.when(
            ~is_text(p),
            F.struct(before(i).cast("bigint").alias("ordinal"), p["kind"].alias("kind"), p["uri"].alias("uri"), (F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)) * F.coalesce(F.try_element_at(per, p["kind"]), F.lit(1))).alias("tokens")),
        ),
    )
    return content, F.filter(made, lambda a: a.isNotNull())


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans, attachments, expanded_tokens.

    turns: one row per turn, its content in parts_col, an array of (kind, text, uri, units). loss_spans are (start, length) in code
    points of formatted, start from 0, one for each turn of loss_roles, and cover the content alone. attachments are in order.

    Turns are ordered by turn, then role, then content; a null turn comes first, a null role is empty. A turn with a null conversation id
    is a conversation of its own, so such turns don't gather. A repeated row is a turn of its own. No rows give no rows; other columns are ignored. A conversation becomes one
    string, so it has to fit a row; different conversations never meet in one.

    One shuffle, by conversation: the offsets (window) and the joining (aggregation) need the same partitioning.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    n_att = F.size(F.filter(parts, lambda p: p.isNotNull() & (F.coalesce(p["kind"], F.lit("text")) != "text")))
    own = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("_own")
    rows = turns.select(F.col(conv_col), own, F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), parts.alias("_parts"), n_att.alias("_att"))
    order = Window.partitionBy(conv_col, "_own").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_first", F.coalesce(F.sum("_att").over(before), F.lit(0)))
    content, attached = visit(F.col("_parts"), F.col("_first"))
    rows = rows.select(conv_col, "_own", "_n", "_role", F.concat(F.lit(TURN), escape_role(F.col("_role")), F.lit("\n")).alias("_head"), content.alias("_body"), attached.alias("_attached"))
    rows = rows.withColumn("_size", F.length("_head") + F.length("_body") + len(END))
    # no second sort or shuffle: the rows are already dealt and sorted this way
    run = Window.partitionBy(conv_col, "_own").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_size").over(run), F.lit(0)) + F.length("_head"))
    span = F.when(F.col("_role").isin(*loss_roles), F.struct(F.col("_start").cast("bigint").alias("start"), F.length("_body").cast("bigint").alias("length")))
    one = F.struct("_n", F.concat("_head", "_body", F.lit(END)).alias("text"), span.alias("span"), F.col("_attached").alias("attached"))
    out = rows.groupBy(conv_col, "_own").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    attachments = F.flatten(F.transform("_all", lambda x: x["attached"]))
    return out.select(
        conv_col,
        F.array_join(F.transform("_all", lambda x: x["text"]), "").alias("formatted"),
        F.filter(F.transform("_all", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of (role, content), unescaped; placeholders stay in the content."""
    turns = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda t: t != "")
    head = len(TURN)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape_role(F.substring_index(t.substr(F.lit(head + 1), F.length(t)), "\n", 1)).alias("role"),
            unescape(t.substr(F.instr(t, "\n") + 1, F.length(t))).alias("content"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
