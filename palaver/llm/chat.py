"""Chat formatting over typed content parts, in Spark expressions only.

A turn's content is a list of parts: text, image, audio or document. Each part becomes one piece of the turn's string: a
text its escaped self, any other part a numbered run of placeholder tokens whose length its size determines. Attachment
references are kept in order beside the string. Turns are then marked and joined by conversation.

The template is ``<s>`` once, then for each turn ``[INST]role\\ncontent[/INST]``, and for the assistant a closing
``</s>`` behind it. Control strings in roles and texts are escaped: backslashes are doubled and each control string
gets a backslash behind its first character; a line end in a role, which would end it, gets one before it. Dropping every
single backslash undoes all of them, so texts come back exactly.

An image of more than ``MAX_PATCHES`` patches expands to that many tokens, since image encoders scale larger ones down to
their limit; its reference is kept as any other. Audio and documents expand in full.

Formatting a turn needs nothing but its row. Joining a conversation gathers its turns, because the string is one value;
the turns themselves (``format_turns``) stay rows, for uses that need no joined string. Where a turn begins in the string
is a running sum over the conversation's sorted rows, so the work grows with the turns, not with their square.

Defined cases: a null text, role or part is empty; rows order by turn (null first), then role, then text; equal rows
are all kept; rows with a null conversation id form one conversation. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.common import fresh

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROL = (BEGIN, OPEN, CLOSE, END, *PLACEHOLDERS.values())

# Tokens an attachment expands to: image patches, audio frames, document pages.
PATCH, MAX_PATCHES, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 28, 4096, 25, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Reversibly break up control strings."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        escaped = F.replace(escaped, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return escaped


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_string(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    part = F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), text, F.lit("ref"), F.lit(None).cast("string"),
                          F.lit("width"), F.lit(None).cast("int"), F.lit("height"), F.lit(None).cast("int"),
                          F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("int"))
    return F.array(part)


def expanded_tokens(part: Column) -> Column:
    """How many placeholder tokens a part stands for; a text has none."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    kind = part["type"]
    return (
        F.when(kind == "image", F.least(F.greatest(patches, F.lit(1)), F.lit(MAX_PATCHES)))
        .when(kind == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_PER_SECOND), F.lit(1)))
        .when(kind == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(0).cast("int")
    )


def part_string(part: Column) -> Column:
    """What a part contributes to its turn: visited by type."""
    shown = F.lit("")
    for kind, placeholder in PLACEHOLDERS.items():
        shown = F.when(part["type"] == kind, F.repeat(F.lit(placeholder), expanded_tokens(part))).otherwise(shown)
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(shown)


def format_turns(turns: DataFrame, role: str = "role", parts: str = "parts") -> DataFrame:
    """Each turn with ``formatted`` (its marked string), ``loss`` (the trained span in it: start, length, or null),
    ``attachments`` (references in order with type and expanded count) and ``expanded`` (their sum) appended."""
    content = fresh(turns.columns, "_content")
    known_parts = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda part: part.isNotNull())
    speaker = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(OPEN), role_string(speaker), F.lit("\n"))
    attached = F.transform(
        F.filter(known_parts, lambda part: part["type"].isin(*PLACEHOLDERS)),
        lambda part: F.struct(part["type"].alias("type"), part["ref"].alias("ref"), expanded_tokens(part).alias("tokens")))
    tail = F.when(speaker == TRAINED, F.lit(CLOSE + END)).otherwise(F.lit(CLOSE))
    loss = F.when(speaker == TRAINED, F.struct(F.length(head).alias("start"), F.length(content).alias("length")))
    return (
        turns.withColumn(content, F.array_join(F.transform(known_parts, part_string), ""))
        .withColumn("formatted", F.concat(head, F.col(content), tail))
        .withColumn("loss", loss).withColumn("attachments", attached)
        .withColumn("expanded", F.aggregate("attachments", F.lit(0), lambda sum, one: sum + one["tokens"]))
        .drop(content)
    )


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: str | None = None) -> DataFrame:
    """One row for each conversation: its string, the trained spans in it, and its attachments in order."""
    content = fresh(turns.columns, "parts")
    visited = turns.select(conversation, turn, role, text, (F.col(parts) if parts else text_part(F.col(text))).alias(content))
    done = format_turns(visited, role, content)
    begin = fresh(done.columns, "_begin")
    # The order of the window and of the sorted rows is one: rows equal up to their string are of one length.
    order = W.partitionBy(conversation).orderBy(turn, role, text, "formatted")
    before = F.sum(F.length("formatted")).over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = done.withColumn(begin, (F.coalesce(before, F.lit(0)) + len(BEGIN)).cast("int"))
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), "formatted",
                   F.col(begin).alias("begin"), "loss", "attachments", "expanded")
    joined = placed.groupBy(conversation).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def span(row):
        return F.struct((row["begin"] + row["loss"]["start"]).alias("start"), row["loss"]["length"].alias("length"))

    return joined.select(
        conversation,
        F.concat(F.lit(BEGIN), F.array_join(F.transform("rows", lambda row: row["formatted"]), "")).alias("formatted"),
        F.transform(F.filter("rows", lambda row: row["loss"].isNotNull()), span).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda row: row["attachments"])).alias("attachments"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda sum, row: sum + row["expanded"]).alias("expanded"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text). Placeholders read as they stand."""
    body = F.replace(F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted)), F.lit(CLOSE + END), F.lit(CLOSE))
    pieces = F.filter(F.split(body, r"\[/INST\]", -1), lambda piece: piece != "")
    inner = F.transform(pieces, lambda piece: F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece)))

    def parted(piece):
        # The first line end without a backslash of its own.
        cut = F.length(F.regexp_extract(piece, r"(?s)\A(?:[^\\\n]++|\\.)*+", 0)) + 1
        return F.struct(unescape(F.substring(piece, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(piece, cut + 1, F.length(piece))).alias("text"))

    return F.transform(inner, parted)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(spans, lambda span: unescape(F.substring(formatted, span["start"] + 1, span["length"])))
