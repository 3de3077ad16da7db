"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation is ``<s>`` and its turns, one after the other:

    [INST] text [/INST]            user
    [SYS] text [/SYS]              system
    [ANS] text</s>                 assistant
    [ROLE] role[SEP] text [/ROLE]  any other role (also none: the empty string)

The parser is deterministic: at each place the opener says which closer comes next, and the nearest one ends the turn; a turn
that does not start where the last one ended stops it.  Each turn is rendered, parsed again and compared with its source; where they
differ, the control strings inside its role and text get a backslash after their first character and it is tried again.  The parser takes
one backslash out of every control string that has any, so the second try gives the source back (a third is an error).  A text without control strings
is left as it is.  No closer begins inside another or inside itself, so turns that come back one by one come back in a row; ``read`` parses
whole conversations anyway.

Turns are sorted by turn (nulls first), then role, then text; repeated rows stay.  Null texts and roles are empty, rows without a conversation id
are one conversation, an empty table has none.  Other columns are not read.  Rendering works row by row; a conversation becomes one string (at most 2 GB, Spark's limit
for any string), which its digest needs in any case, so one conversation's turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
START = "<s>"
TURNS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[ANS] ", "</s>")}
OTHER, SEPARATOR = ("[ROLE] ", " [/ROLE]"), "[SEP] "
# A control string, with any number of backslashes after its first character.
CONTROL = r"(<)(\\*)(/?s>)|(\[)(\\*)(/?(?:INST|SYS|ROLE)\]|(?:ANS|SEP)\])"
ESCAPED = r"([<\[])\\(\\*(?:/?s>|/?(?:INST|SYS|ROLE)\]|(?:ANS|SEP)\]))"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"[]()\{}.*+?^$|/" else c for c in text)


GRAMMAR = "|".join(f"{_quoted(a)}[\\s\\S]*?{_quoted(b)}" for a, b in [*TURNS.values(), OTHER])


def escape(text: Column) -> Column:
    """One backslash more in every control string."""
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    """One backslash less in every control string that has any."""
    return F.regexp_replace(text, ESCAPED, "$1$2")


def render(role: Column, text: Column) -> Column:
    """One turn in the template."""
    out = F.concat(F.lit(OTHER[0]), role, F.lit(SEPARATOR), text, F.lit(OTHER[1]))
    for name, (a, b) in TURNS.items():
        out = F.when(role == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """Rendered turns of a conversation (or of one turn), as far as the grammar goes."""
    return F.regexp_extract_all(formatted, F.lit(rf"\G(?:^{_quoted(START)})?({GRAMMAR})"), F.lit(1))


def turn(piece: Column) -> Column:
    """``(role, text)`` of one parsed turn."""
    inner = lambda a, b: F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))
    rest = inner(*OTHER)
    at = F.call_function("instr", rest, F.lit(SEPARATOR))
    out = F.struct(unescape(F.substring(rest, F.lit(1), at - 1)).alias("role"),
                   unescape(F.substring(rest, at + len(SEPARATOR), F.length(rest))).alias("text"))
    for name, (a, b) in TURNS.items():
        out = F.when(piece.startswith(a), F.struct(F.lit(name).alias("role"), unescape(inner(a, b)).alias("text"))).otherwise(out)
    return out


def _same(piece: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn is parsed as one turn, that of the source."""
    pieces = parse(piece)
    one = F.struct(role.alias("role"), text.alias("text"))
    return (F.array_join(pieces, "") == piece) & (F.transform(pieces, turn) == F.array(one))


def rendered(turns: DataFrame) -> DataFrame:
    """``turns`` (``role, text`` without nulls) with ``piece``, the turn as rendered, and ``tries``: 0 as it is, 1 escaped."""
    role, text = F.col("role"), F.col("text")
    known = role.isin(*TURNS)
    plain = render(role, text)
    guarded = render(F.when(known, role).otherwise(escape(role)), escape(text))
    suspect = F.concat(role, F.lit(" "), text).rlike(CONTROL)  # without control strings the first try is the source
    failed = F.raise_error(F.concat(F.lit("turn does not come back: "), text))
    tries = F.when(~suspect, F.lit(0)).when(_same(plain, role, text), F.lit(0)).when(_same(guarded, role, text), F.lit(1)).otherwise(failed.cast("int"))
    return turns.withColumn("tries", tries).withColumn("piece", F.when(F.col("tries") == 0, plain).otherwise(guarded))


def formatted(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``formatted``, ``n_turns``, the ``source_sha256`` of its turns and ``loss``, the spans of the
    assistants' (escaped) texts in code points, ends exclusive."""
    turns = rows.select(F.col(conv).alias("conv"), F.col(order).alias("place"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    by = Window.partitionBy("conv").orderBy(F.col("place").asc_nulls_first(), "role", "text")
    size = F.length("piece")
    placed = rendered(turns).select(
        "conv", "piece", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("source"), (F.col("role") == "assistant").alias("mask"),
        F.row_number().over(by).alias("no"), (F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)) - size + len(START)).alias("at"))
    a, b = TURNS["assistant"]
    span = F.struct((F.col("at") + len(a)).alias("start"), (F.col("at") + size - len(b)).alias("end"))
    group = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("no", "piece", "source", F.when(F.col("mask"), span).alias("span")))).alias("turns"))
    part = lambda name: F.transform("turns", lambda t: t[name])
    return group.select(
        F.col("conv").alias(conv), F.concat(F.lit(START), F.array_join(part("piece"), "")).alias("formatted"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(part("source"), ""), 256).alias("source_sha256"), F.filter(part("span"), lambda s: s.isNotNull()).alias("loss"))


def read(chats: DataFrame, column: str = "formatted") -> DataFrame:
    """``chats`` with ``turns``, the ``(role, text)`` parsed from the formatted conversations; a conversation that is
    not all parsed is an error."""
    parsed = chats.withColumn("pieces_", parse(F.col(column)))
    whole = F.length(column) == len(START) + F.aggregate("pieces_", F.lit(0), lambda n, p: n + F.length(p))
    checked = F.when(whole, F.col("pieces_")).otherwise(F.raise_error(F.lit("conversation breaks the grammar")).cast("array<string>"))
    return parsed.withColumn("turns", F.transform(checked, turn)).drop("pieces_")


def digests(chats: DataFrame) -> DataFrame:
    """``chats`` of ``read`` with the digest of all turns, and characters and digest of the text under the loss mask."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return (chats.withColumns({"turns_sha256": F.sha2(turns, 256), "loss_": loss})
                 .withColumns({"loss_chars": F.length("loss_").cast("long"), "loss_sha256": F.sha2("loss_", 256)}).drop("loss_"))
