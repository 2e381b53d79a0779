import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the tokenizer's file is not here")
ODD = ["", "a", " ", "  ", "   x  y", "a" * 43, "=====-----=====" * 7, "\n\n a\n b \n", "日本語のテキスト🙂🙂 é é",
       "<s> </s> <0x0A>", "\x00\x01", "ﬁ", "ends in space ", "\n", "x" * 300 + " " * 70 + "y"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(MODEL)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def made(seed, alphabets, count, longest):
    chance = random.Random(seed)
    return ["".join(chance.choice(letters) for _ in range(chance.randrange(longest)))
            for letters in alphabets for _ in range(count)]


ALPHABETS = ["ab ", "aeiou thnsr", "=-* \n", "abcdefghijklmnopqrstuvwxyz", "thieran ", "🙂é日 a\n", " \n", "a"]


def test_whole_texts_equal_the_library(vocabulary, library):
    encoder = pieces.Encoder(vocabulary)
    for text in ODD + made(1, ALPHABETS, 100, 60):
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == library.encode(text), text


def test_chunks_equal_the_library(spark, vocabulary, library):
    texts = ODD + made(2, ALPHABETS, 12, 1500) + ["the thing " * 900, "=" * 9000, None, None, "the thing " * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("old"))
    found = pieces.encode(docs, vocabulary, giant=90, chunk=64, read_back=True)
    rows = {row.doc_id: row for row in found.collect()}
    assert len(rows) == len(texts)
    for number, text in enumerate(texts):
        assert rows[number].ids == library.encode(text or ""), text
        assert rows[number].decoded == (text or "")


def test_empty_table_and_sign_for_space(spark, vocabulary):
    empty = spark.createDataFrame([], "text string")
    assert pieces.encode(empty, vocabulary).collect() == []
    sign = spark.createDataFrame([("a▁b",)], "text string")
    row = pieces.encode(sign, vocabulary).select(pieces.decode(F.col("ids"), vocabulary).alias("decoded")).first()
    assert row.decoded == "a b"


def test_products_are_associative():
    chance = np.random.default_rng(3)
    a, b, c = (np.where(chance.random((4, 4)) < 0.5, 0.0, -np.inf) for _ in range(3))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_an_encoder_forgets_and_gives_the_same_ids_again():
    encoder = pieces.Encoder(pieces.Vocabulary.load(MODEL))
    text = "The house stands near the water, 12 stones.\nEnd"
    first = encoder.encode(text)
    encoder.forget()
    assert not encoder.words and not encoder.histories and "tree" not in encoder.__dict__
    assert encoder.encode(text) == first and len(encoder.words)
