import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palaver.llm import components, fingerprints, similar


def word_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:]))


def brute(rows):
    sets = [(doc_id, word_set(text)) for doc_id, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 90 * len(s | t):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {doc_id: (len(s), root(doc_id)) for doc_id, s in sets}


def texts(seed):
    chance = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    found = [None, "", " \n", "one", "ONE", "two words", "Two\twords", "a b c", "a b c a b c", "É b c", "é b c", "x " * 3000, "x " * 50]
    for _ in range(12):
        base = [chance.choice(vocabulary) for _ in range(chance.randrange(20, 150))]
        for _ in range(chance.randrange(1, 14)):
            copy = list(base)
            for _ in range(chance.randrange(0, 6)):
                copy[chance.randrange(len(copy))] = chance.choice(vocabulary)
            found.append(" ".join(copy))
    chain = [f"c{n}" for n in range(200)]
    for step in range(0, 60, 5):  # each linked to the next, the ends far apart
        found.append(" ".join(chain[step:] + [f"d{n}" for n in range(step)]))
    shared = [f"s{n}" for n in range(40)]
    found += [" ".join(shared + [f"own{n}_{k}" for k in range(30)]) for n in range(20)]
    return found


@pytest.mark.parametrize("block", [1000, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = list(enumerate(texts(block), 100))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*row, 1, "c") for row in rows], "doc_id long, text string, n int, component string").repartition(3)
    found = {row.doc_id: (row.n_shingles, row.component_id) for row in similar.similar_components(docs).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("block", [1000, 4])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    base = [f"g{n}" for n in range(120)]
    group = [" ".join(base[:n] + [f"h{n}"] + base[n + 1:]) for n in range(3, 118, 4)]  # all alike, far more than the nearest
    rows = list(enumerate(texts(block) + group + group[:2], 100))
    sets = [(doc_id, word_set(text)) for doc_id, text in rows]
    expected = {a: sum(1 for b, t in sets if a != b and s and t and 100 * len(s & t) >= 90 * len(s | t)) for a, s in sets}
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string").repartition(3)
    found = similar.similar_links(docs).collect()
    assert len(found) == len(rows) + 1
    assert {row.doc_id: row.n_links for row in found} == expected
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in found} == brute(rows)


def test_the_query_gives_links(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, ""), (None, "a b c d")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from palaver.llm.queries import QUERIES

    rows = [tuple(row) for row in QUERIES["op3_similar"](spark, str(tmp_path)).fillna(-1).collect()]
    assert sorted(rows) == [(-1, 2, 1, 2), (1, 2, 1, 2), (2, 2, 1, 2), (3, 0, 3, 0)]


def test_empty_table_and_missing_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar.similar_components(docs).collect() == []
    odd = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t")], docs.schema)
    rows = sorted(tuple(row) for row in similar.similar_components(odd).fillna(-1).collect())
    assert rows == [(-1, 2, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7)]


def test_classes_without_ids_link(spark):
    base = [f"w{n}" for n in range(100)]
    rows = [(None, " ".join(base[:n] + ["x"] + base[n + 1:])) for n in (10, 40)] + [(9, " ".join(base)), (None, "q r s t"), (None, "q r s t")]
    docs = spark.createDataFrame([rows[0], *rows], "doc_id long, text string")
    found = [(-1 if row.doc_id is None else row.doc_id, row.component_id, row.n_links) for row in similar.similar_links(docs).collect()]
    assert sorted(found, key=str) == sorted([(-1, 9, 2)] * 2 + [(-1, 9, 1), (9, 9, 3)] + [(-1, None, 1)] * 2, key=str)


def test_components_of_paths_and_stars(spark):
    chance = random.Random(2)
    path = list(range(1000, 1120))
    chance.shuffle(path)
    links = list(zip(path, path[1:])) + [(5, n) for n in range(6, 60)] + [(70, 70), (80, 81), (81, 80)]
    found = {row.node: row.component for row in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[n] for n in path} == {1000} and {found[n] for n in range(5, 60)} == {5} and found[81] == found[80] == 80


def test_groups_are_cut_whole():
    table = pa.table({"token": [1, 1, 1, 2, 2, 3], "low": [0] * 6, "high": [0] * 6})
    parts = [t.column("token").to_pylist() for t in fingerprints.whole_groups(
        iter(table.to_batches(max_chunksize=2)), ("token", "low", "high"), 1)]
    assert sum(parts, []) == [1, 1, 1, 2, 2, 3]
    assert all(not set(a) & set(b) for i, a in enumerate(parts) for b in parts[:i])


def test_filters_lose_no_pair():
    chance = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(chance.integers(0, 60, 40).astype(np.uint64))
        b = np.unique(np.concatenate([a[chance.random(len(a)) < 0.97], chance.integers(0, 60, 2).astype(np.uint64)]))
        alike = 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
        if alike and min(len(a), len(b)):
            la, lb = (similar.prefix_length(len(x), 90) for x in (a, b))
            assert set(a[:la].tolist()) & set(b[:lb].tolist())
