"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is written `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. A deterministic parser (cut at every end mark, expect one start mark,
cut at the first line break after it, undo escapes) reads rendered turns back. A turn that doesn't come back as it was,
because its content holds control strings or looks like an escape, is escaped and rendered again. The escape puts one
backslash more between `<` and `|` (and, in roles, a mark for a line break), which the parser takes away; it is
reversible for every text, so one escaped rendering is always enough, and the whole conversation is checked once more.

Defined cases: a null text or role counts as empty; turns are ordered by (turn, role, text), null turns first; repeated
rows stay; a null conversation id is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|br|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def _parse(rendered: Column) -> Column:
    """Turns of a rendered text: array of (role, text); what isn't a turn comes back with a null role."""
    parts = F.split(rendered, r"<\|im_end\|>\n?", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        cut = F.locate("\n", part)
        is_turn = part.startswith(START) & (cut > 0) & (F.locate(START, part, 2) == 0)
        role = part.substr(F.lit(len(START) + 1), cut - F.lit(len(START) + 1))
        text = part.substr(cut + 1, F.length(part))
        return F.struct(
            F.when(is_turn, unescape(F.regexp_replace(role, r"<\|br\|>", "\n"))).alias("role"),
            F.when(is_turn, unescape(text)).otherwise(part).alias("text"),
        )

    return F.transform(parts, turn)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    back = _parse(rendered)
    return rendered.endswith(END + "\n") & (F.size(back) == 1) & back[0]["role"].eqNullSafe(role) & back[0]["text"].eqNullSafe(text)


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, escaped_turns): a row for each conversation.

    loss_spans has, for each turn under the loss mask, its place in `formatted` in bytes of UTF-8 (start, length) and in
    code points (char_start, char_length).
    """
    turns = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    plain = turns.withColumn("plain_ok", _same(_render(F.col("role"), F.col("text")), F.col("role"), F.col("text")))
    safe_role = F.regexp_replace(escape(F.col("role")), "\n", BREAK.replace("$", "\\$"))
    written = plain.select(
        "conv_id", "turn", "role", "text", "plain_ok",
        F.when(F.col("plain_ok"), F.col("role")).otherwise(safe_role).alias("w_role"),
        F.when(F.col("plain_ok"), F.col("text")).otherwise(escape(F.col("text"))).alias("w_text"),
    ).withColumn("part", _render(F.col("w_role"), F.col("w_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.length(F.concat(F.lit(START), F.col("w_role"))) + 1
    head_bytes = F.octet_length(F.concat(F.lit(START), F.col("w_role"))) + 1
    placed = written.select(
        "conv_id", "role", "text", "part", "plain_ok",
        F.row_number().over(order).alias("place"),
        (F.coalesce(F.sum(F.octet_length("part").cast("long")).over(before), F.lit(0)) + head_bytes).alias("start"),
        F.octet_length("w_text").cast("long").alias("length"),
        (F.coalesce(F.sum(F.length("part").cast("long")).over(before), F.lit(0)) + head).alias("char_start"),
        F.length("w_text").cast("long").alias("char_length"),
    )
    span = F.struct("place", "start", "length", "char_start", "char_length")
    whole = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "part", "role", "text"))).alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("role") == TRAINED_ROLE, span))).alias("loss_spans"),
        F.count_if(~F.col("plain_ok")).alias("escaped_turns"),
    )
    formatted = whole.select(
        "conv_id", "loss_spans", "escaped_turns",
        F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"),
        F.transform("parts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    checked = F.when(_parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back to its turns")).cast("string"))
    return formatted.select("conv_id", checked.alias("formatted"), "loss_spans", "escaped_turns")


def parse_turns(formatted: DataFrame) -> DataFrame:
    """The formatted conversations with `turns` (array of role, text) parsed back and `loss_text` under the mask."""
    data = F.encode("formatted", "utf-8")
    piece = lambda s: unescape(F.decode(F.substring(data, s["start"].cast("int") + 1, s["length"].cast("int")), "utf-8"))
    return formatted.withColumn("turns", _parse(F.col("formatted"))).withColumn("loss_text", F.array_join(F.transform("loss_spans", piece), ""))


def summarize(parsed: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(listed, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
