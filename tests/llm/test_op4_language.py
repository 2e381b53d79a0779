import random
import zlib

import numpy as np
import pytest

from palaver.llm import language

WORDS = {"aa": ["kalo", "minu", "tasi", "rolu"], "bb": ["grünz", "schpa", "tchöß", "wrumpf"], "cc": ["ñoél", "üiçe", "áeio", "oué"]}


def corpus(count=400):
    chance = random.Random(4)
    rows = []
    for number in range(count):
        lang = chance.choice(sorted(WORDS))
        rows.append((number, " ".join(chance.choice(WORDS[lang]) for _ in range(chance.randrange(1, 200))), lang))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    return docs, language.train(docs, max_labelled=300, epochs=6)


def test_held_out_accuracy_and_clashing_columns(spark, trained):
    docs, network = trained
    rows = language.identify(docs.withColumnRenamed("lang", "score"), network).collect()
    truth = {number: lang for number, _, lang in corpus()}
    unseen = [row for row in rows if zlib.crc32(str(row.doc_id).encode()) % 5 == 0]
    assert len(unseen) > 50 and all(row.lang_pred == truth[row.doc_id] for row in unseen)
    assert all(0.5 < row.score <= 1 for row in unseen)


def test_tables_equal_the_convolution(trained):
    network = trained[1]
    windows, _ = language.cut_windows([text.encode() for _, text, _ in corpus(12)])
    w, pooled = network.weights, []
    for width in language.WIDTHS:
        spans = np.lib.stride_tricks.sliding_window_view(w["embed"][windows], width, axis=1).transpose(0, 1, 3, 2)
        pooled.append((spans.reshape(len(windows), -1, width * network.dim) @ w[f"w{width}"]).max(1) + w[f"b{width}"])
    expected = language.softmax(np.maximum(np.concatenate(pooled, 1), 0) @ w["out"] + w["bias"])
    assert np.allclose(np.exp(language.window_scores(network.tables(), windows)), expected, atol=1e-4)


def test_gradient_equals_differences(trained):
    network = language.ByteNetwork(["a", "b"], dim=3, filters=2, seed=5)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    windows, _ = language.cut_windows([b"some bytes here", b"other things"])
    labels = np.array([0, 1])

    def loss():
        return -np.log(np.exp(language.window_scores(
            {k: v.astype(np.float64) for k, v in network.tables().items()}, windows))[np.arange(2), labels]).mean()

    found = network.gradients(windows, labels)
    for name in ("out", "w2", "w4", "b3"):
        place = (0,) * network.weights[name].ndim
        network.weights[name][place] += 1e-3
        high = loss()
        network.weights[name][place] -= 2e-3
        low = loss()
        network.weights[name][place] += 1e-3
        assert abs((high - low) / 2e-3 - found[name][place]) < 2e-3


def test_odd_texts_and_missing_labels(spark, trained):
    docs, network = trained
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 .. \n"), (4, "kalo " * 50000), (None, "日本語"), (4, "kalo " * 50000)],
                                "doc_id long, text string")
    rows = [(row.doc_id, row.lang_pred, row.score) for row in language.identify(odd, network).collect()]
    assert all(row[1:] == ("und", 0.0) for row in rows if row[0] in (1, 2, 3))
    assert [row[1] for row in rows if row[0] == 4] == ["aa", "aa"]
    assert language.train(docs.limit(0)) is None
    assert {row.lang_pred for row in language.identify(odd, None).collect()} == {"und"}
