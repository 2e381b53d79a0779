import random
import time
import zlib

import numpy as np

from palaver.llm import toxicity


def brute_segments(scores):
    """Maximal scoring segments by their definition: cut out the best one, go on left and right of it."""
    best = None
    for first in range(len(scores)):
        total = 0.0
        for end in range(first + 1, len(scores) + 1):
            total += scores[end - 1]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = first, end, total
    if best is None:
        return []
    first, end, _ = best
    right = [(a + end, b + end, s) for a, b, s in brute_segments(scores[end:])]
    return brute_segments(scores[:first]) + [best] + right


def test_segments_against_brute_force():
    chance = random.Random(8)
    for _ in range(400):
        scores = np.array([chance.uniform(-2, 1.5) for _ in range(chance.randrange(25))])
        found = toxicity.maximal_segments(scores)
        expected = brute_segments(scores.tolist())
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in found], [s for *_, s in expected])


def test_long_texts_cost_as_much_a_word_as_short_ones():
    falling = np.tile([1.0, -2.0], 150_000)
    uneven = np.concatenate([np.tile([3.0, -1.0], 50_000), falling, np.tile([1.0, -0.5], 50_000)])
    started = time.perf_counter()
    assert len(toxicity.maximal_segments(falling)) == 150_000
    assert len(toxicity.maximal_segments(uneven)) == 150_002
    assert time.perf_counter() - started < 5


def corpus(spark, count=900):
    chance = random.Random(3)
    plain = ["stone", "river", "house", "green", "walk", "light", "paper", "window", "small", "sound"]
    rows, labels = [], []
    for number in range(count):
        words = [chance.choice(plain) for _ in range(chance.randrange(5, 120))]
        toxic = number % 6 == 0
        if toxic:
            at = chance.randrange(len(words))
            words[at:at] = [chance.choice(["grubnik", "zoltpig"]) for _ in range(3)]
        rows.append((number, " ".join(words), "x"))
        labels.append((number, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")


def test_held_out_accuracy_and_passages(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    unseen = [row for row in rows if zlib.crc32(str(row.doc_id).encode()) % 5 == 0]
    assert len(unseen) > 100
    assert all((row.score >= 0.5) == (row.doc_id % 6 == 0) for row in unseen)
    for row in unseen:
        words = toxicity.words_of(row.text.encode())
        inside = {word for s in row.segments for word in words[s.first:s.end]}
        assert inside & {"grubnik", "zoltpig"} if row.doc_id % 6 == 0 else not row.segments


def test_odd_texts_and_missing_labels(spark):
    docs, labels = corpus(spark, 300)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 .. !"), (None, "x" * 100000), (2, "")], "doc_id long, text string")
    found = [row.score for row in toxicity.score(odd, toxicity.train(docs, labels)).collect()]
    assert len(found) == 5 and all(0 <= value < 0.5 for value in found)
    for bare in (labels.limit(0), labels.filter("toxic = 0")):
        assert {row.score < 0.5 for row in toxicity.score(docs, toxicity.train(docs, bare)).collect()} == {True}
    assert toxicity.score(docs.limit(0), toxicity.ToxicityModel()).collect() == []
