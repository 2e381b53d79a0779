import math

from pyspark.sql import functions as F

from palaver.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[\\INST]", "[/INST]\n</s>", "", None, "a\nb", "<s><image>", "\\\\n$1",
         "日本🙂", "[INST", "<document>" * 3]


ROLES = ["user", "assistant", "system", None, "[INST]\\", "a\nb", "\n", "\\\n\\", "</s>\n[/INST]"]


def read(formatted):
    read_back = formatted.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
                                 chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    return {row.conv_id: row for row in read_back.collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, role, text) for c, role in enumerate(ROLES)
            for t, text in enumerate(NASTY)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1))
    found = read(chat.format_conversations(turns))
    for number, role in enumerate(ROLES):
        row = found[number]
        assert [tuple(turn) for turn in row.turns] == [(role or "", text or "") for text in NASTY]
        assert row.loss == ([text or "" for text in NASTY] if role == "assistant" else [])


def test_order_ties_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame(
        [(1, 2, "user", "b"), (1, 1, "user", "z"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (None, None, None, None)], schema)
    found = read(chat.format_conversations(turns))
    assert [tuple(turn) for turn in found[1].turns] == [("assistant", "y"), ("assistant", "y"), ("user", "z"), ("user", "b")]
    assert [tuple(turn) for turn in found[None].turns] == [("", "")]
    assert chat.format_conversations(turns.limit(0)).collect() == []


def test_typed_parts(spark):
    parts = [("text", "see [INST]", None, None, None, None, None), ("image", None, "a.png", 100, 57, None, None),
             ("audio", None, "b.wav", None, None, 1.5, None), None, ("text", "and", None, None, None, None, None),
             ("document", None, "c.pdf", None, None, None, 2), ("image", None, None, 10**6, 10**6, None, None),
             ("video", None, "d.mp4", None, None, None, None)]
    turns = spark.createDataFrame([(1, 1, "assistant", parts), (1, 2, "user", None)],
                                  f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("text", F.lit(""))
    row = chat.format_conversations(turns, parts="parts").first()
    image, audio, pages = math.ceil(100 / 28) * math.ceil(57 / 28), math.ceil(1.5 * 25), 1024
    assert [tuple(one) for one in row.attachments] == [
        ("image", "a.png", image), ("audio", "b.wav", audio), ("document", "c.pdf", pages), ("image", None, chat.MAX_PATCHES)]
    assert row.expanded == image + audio + pages + chat.MAX_PATCHES
    content = ("see [\\INST]" + "<image>" * image + "<audio>" * audio + "and" + "<document>" * pages
               + "<image>" * chat.MAX_PATCHES)
    assert row.formatted == f"<s>[INST]assistant\n{content}[/INST]</s>[INST]user\n[/INST]"
    start, length = row.loss_spans[0]
    assert row.formatted[start:start + length] == content


def test_long_conversation_and_equal_strings(spark):
    rows = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.floor(F.col("id") / 3).alias("turn"),
        F.when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("t\n"), F.col("id") % 7)).alias("text"))
    row = read(chat.format_conversations(rows))[1]
    order = sorted(rows.collect(), key=lambda r: (r.turn, r.role, r.text is not None, r.text or ""))
    assert [tuple(one) for one in row.turns] == [(r.role, r.text or "") for r in order]
    assert row.loss == [r.text or "" for r in order if r.role == "assistant"]
