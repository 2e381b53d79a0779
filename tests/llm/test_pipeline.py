import importlib
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm.queries import MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the tokenizer's file is not here")

EN = ["the", "house", "stands", "near", "water", "where", "light", "falls", "over", "stones", "and", "wind"]
FR = ["où", "été", "maison", "près", "lumière", "être", "château", "forêt", "vent", "même", "là", "très"]
PASSAGE = "questions of the exam ask how many apples remain when seven are eaten by birds"


def sentence(words, number, size=60):
    chance = random.Random(number)
    return " ".join(chance.choice(words) + str(chance.randrange(97)) for _ in range(size))


def make_documents():
    rows = [(n, sentence(EN if n % 2 else FR, n), "en" if n % 2 else "fr", "src", 1) for n in range(120)]
    rows.append((200, "12345 ... !!", "en", "src", 1))
    rows.append((201, None, None, None, None))
    rows.append((202, rows[11][1], "en", "src", 1))
    rows.append((203, rows[12][1] + " appended", "fr", "src", 1))
    rows.append((204, f"{sentence(EN, 204)} {PASSAGE.upper()} {sentence(EN, 205)}", "en", "src", 1))
    rows.append((205, PASSAGE, "en", "src", 1))
    rows.append((206, f"{sentence(EN, 301)} write to me@home.example or 10.1.2.3 {sentence(EN, 302)}", "en", "src", 1))
    return rows + [rows[30]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(make_documents(), schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_effect(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    found = {row.doc_id: row for row in rows}
    assert len(found) == len(rows)
    texts = {row[0]: row[1] for row in make_documents()}
    assert set(found) == set(range(120)) | {204, 206}  # the others are no language, copies, or mostly a test item
    for number in range(120):
        assert found[number].text == texts[number]
    assert "APPLES" not in found[204].text and found[204].text.startswith(sentence(EN, 204)[:50])
    assert "[EMAIL]" in found[206].text and "[IP]" in found[206].text and "home" not in found[206].text
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "ids"}
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    assert all(row.ids == library.encode(row.text) for row in rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0


def test_rows_without_id_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.drop_near_duplicates(spark, docs, folder).count() == 3


def test_near_copies_at_five_words_and_four_fifths(spark, folder):
    def shingles(text, size):
        words = text.split()
        return {tuple(words[at:at + size]) for at in range(len(words) - size + 1)}

    words = sentence(EN, 400, 100).split()
    near = words[:20] + ["changed"] + words[21:70] + ["also"] + words[71:]
    far = words[:20] + ["changed"] + words[21:45] + ["more"] + words[46:70] + ["also"] + words[71:]
    texts = [" ".join(words), " ".join(near), " ".join(words[:15] + far[15:])]

    def alike(a, b, size):
        return len(shingles(a, size) & shingles(b, size)) / len(shingles(a, size) | shingles(b, size))

    assert 0.8 <= alike(texts[0], texts[1], 5) < 0.9 and alike(texts[0], texts[1], 3) < 0.9
    assert alike(texts[0], texts[2], 5) < 0.8
    rows = [(400, texts[0]), (401, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()] == [400]
    apart = spark.createDataFrame([(400, texts[0]), (402, texts[2])], docs.schema)
    assert sorted(row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, apart, folder).collect()) == [400, 402]


def test_entry_lists_the_pipeline():
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
