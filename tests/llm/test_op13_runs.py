import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from palaver.llm import runs
from palaver.llm.queries import QUERIES


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def periodic(words, low, high, q):
    return all(words[i] == words[i + q] for i in range(low, high - q))


def brute_runs(words, least_words=6, least_exponent=4):
    found = []
    for q in range(1, len(words) // least_exponent + 1):
        low = 0
        while low + q < len(words):
            high = low + q
            while high < len(words) and words[high] == words[high - q]:
                high += 1
            if high - low >= max(least_words, least_exponent * q) and not any(periodic(words, low, high, p) for p in range(1, q)):
                found.append((low, high - low, q))
            low = high - q + 1
    return sorted(found)


def brute_kept(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [word for i, word in enumerate(words) if i not in gone]


def tailed(doc_id, text):
    words = split(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def made_texts(seed, count):
    chance = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(chance.randrange(1, 8)):
            own = [f"w{chance.randrange(chance.choice([1, 2, 3, 9]))}" for _ in range(chance.randrange(1, 12))]
            times = chance.choice([1, 1, 2, 4, 5, 7])
            words += own * times + own[:chance.randrange(len(own) + 1)]
        yield words


def test_runs_against_brute_force():
    for number, words in enumerate([*made_texts(1, 400), [], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3]):
        codes = runs.coded([word.encode() for word in words])
        assert runs.word_runs(codes) == brute_runs(words), (number, words)
        assert runs.word_runs(codes, 4, 2) == brute_runs(words, 4, 2), (number, words)


def test_long_periods_are_found_by_looks():
    chance = random.Random(3)
    for period in (31, 32, 33, 100, 257, 500):
        own = [f"p{chance.randrange(period // 2)}" for _ in range(period)]
        words = [f"x{n}" for n in range(50)] + own * 4 + own[:7] + ["end"] + own * 3
        codes = runs.coded([word.encode() for word in words])
        assert (50, 4 * period + 7, period) in runs.word_runs(codes)
        assert runs.word_runs(codes) == brute_runs(words)


def test_surviving_segments_hold_no_rare_word_and_all_runs():
    for words in made_texts(4, 100):
        codes = runs.coded([word.encode() for word in words])
        kept = runs.surviving(codes, 6, 4)
        for low, high in kept:
            assert np.unique(codes[low:high], return_counts=True)[1].min() >= 4
        for start, length, _ in brute_runs(words):
            assert any(low <= start and start + length <= high for low, high in kept)


def test_deep_splits_and_few_words_stay_cheap():
    # Each split takes one occurrence of the next word from the end, which makes that word rare.
    depth = 20_000
    chain = [n for k in range(depth) for n in (k, k, k, k + 1)]
    started = time.perf_counter()
    runs.word_runs(np.array(chain, np.int64))
    runs.word_runs(np.random.default_rng(5).integers(0, 2, 200_000))
    runs.word_runs(np.zeros(200_000, np.int64))
    assert time.perf_counter() - started < 60


def test_the_query_against_brute_force(spark, tmp_path):
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "É é é é é é é", "a\x0bb\x1cc " * 8, "no repeats here at all"]
    texts += [" ".join(words) for words in made_texts(2, 150)] + [" ".join(["long"] + ["x", "y", "z"] * 30_000)]
    rows = [(n, text, "other") for n, text in enumerate(texts)] + [(5, texts[5], "copy"), (None, "b b b b b b b", "none")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_runs"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    by_id = {doc_id: text for doc_id, text, _ in rows}
    changed = 0
    for row in found:
        words = tailed(row.doc_id, by_id[row.doc_id])
        changed += words != split(by_id[row.doc_id])
        own = brute_runs(words) if len(words) < 5000 else [(1, 90_000, 3)] if words == split(by_id[row.doc_id]) else None
        if own is None:
            continue
        best = min(((-length, start, q) for start, length, q in own), default=None)
        assert row.n_runs == len(own)
        assert (row.start, row.length, row.period) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert row.exponent_milli == (1000 * row.length // row.period if best else None)
        assert row.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % run for run in own).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(brute_kept(words, own)).encode()).hexdigest()
    assert changed > 5


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("a b " * 5, 1, "old")], "text string, RUNS int, collapsed string")
    row = runs.find_runs(docs).first()
    assert row["text"] == "a b " * 5 and row["collapsed"] == "a b" and [tuple(run) for run in row["runs"]] == [(0, 10, 2)]
    assert runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(docs, least_exponent=1)
