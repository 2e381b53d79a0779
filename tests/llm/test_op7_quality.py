import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from palaver.llm import quality

SPACES = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = SPACES.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if SPACES.search(line)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_repeat_words": len(inside)}


def grams(text, buckets):
    def hashed(*parts):
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % buckets

    words = SPACES.findall(text or "")
    return [hashed(word) for word in words] + [hashed(*pair) for pair in zip(words, words[1:])]


TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve",
    "one two three four five six seven one two three four five and more words here to see",
    "a b c d e " * 9, None, "", " \n\t ", "line\nline\n\n \nline\nother # $ <", "é ü 日本 \x0b words\x0chere 🙂",
    "same same same same same same same same same same same same", "x " * 5000, "word " * 11 + "#" * 50,
    "one two three four five six seven eight nine ten eleven twelve",
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "kept?", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string, _words int")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (7, 1), (2, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    found = {row.doc_id: row for row in quality.quality_rules(docs, labels, buckets=50, tolerance=0.5).collect()}
    counts = {number: Counter(grams(text, 50)) for number, text in enumerate(TEXTS)}
    raw, target = Counter({b: 1 for b in range(50)}), Counter({b: 1 for b in range(50)})
    for number, own in counts.items():
        raw.update(own)
        if number in (0, 1, 7):
            target.update(own)
    shift = math.log(sum(raw.values()) / sum(target.values()))
    scores = {}
    for number, text in enumerate(TEXTS):
        own = grams(text, 50)
        scores[number] = sum(math.log(target[b] / raw[b]) + shift for b in own) / len(own) if own else 0.0
    middle = sum(scores[n] for n in (0, 1, 7)) / 3
    spread = math.sqrt(sum((scores[n] - middle) ** 2 for n in (0, 1, 7)) / 3)
    for number, text in enumerate(TEXTS):
        row, expected = found[number], base(text)
        assert {key: row[key] for key in expected} == expected
        assert abs(row.score - scores[number]) < 1e-4
        failed = expected["n_words"] < 10 or 100 * expected["n_repeat_words"] > 20 * expected["n_words"]
        assert row.base_failed == failed
        assert row.kept == (not failed and scores[number] >= middle - 0.5 * spread)


def test_every_trusted_text_counts(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_ids(labels, 1_000, "doc_id", "quality").count() == 30_000
    docs = spark.createDataFrame(list(enumerate(TEXTS)) * 2, "doc_id long, text string")
    sent, joined = (quality.quality_rules(docs, labels.filter("doc_id % 3 = 0"), 50, bound).collect() for bound in (20_000, 0))
    assert sorted(sent, key=str) == sorted(joined, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(docs, labels).collect() == []
    one = spark.createDataFrame([(1, " ".join(map(str, range(20))))], docs.schema)
    row = quality.quality_rules(one, labels).first()
    assert row.kept and row.score == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").select("doc_id", F.concat("text", F.lit(" c")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = quality.quality_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
