import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from palaver.llm import fingerprints
from palaver.llm.queries import QUERIES


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(gram.encode(), 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    """The smallest number of each fingerprint's component, fingerprints being numbered."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [root(i) for i in range(len(prints))]


def made_prints(seed, count=500):
    chance = random.Random(seed)
    found = [0, (1 << 64) - 1, 1 << 63, 7, 0xFFFFFFFF, 0xFFFFFFFF00000000]
    while len(found) < count:
        base = chance.getrandbits(64)
        found.append(base)
        for _ in range(chance.choice([0, 1, 8, 60])):
            bits = chance.sample(range(64), chance.randrange(1, 6))
            found.append((chance.choice(found[-20:]) if chance.random() < 0.3 else base) ^ sum(1 << bit for bit in bits))
    return list(dict.fromkeys(found))


@pytest.mark.parametrize(("block", "distance"), [(2048, 3), (8, 3), (8, 1), (2048, 0)])
def test_links_connect_what_brute_force_connects(spark, block, distance):
    prints = made_prints(block)
    classes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long").repartition(3)
    links = [(int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64)))
             for a, b in fingerprints.near_links(classes, distance, block).collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in links)
    place = {p: n for n, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(place[a]), root(place[b])))
        parent[high] = low
    assert [root(n) for n in range(len(prints))] == brute_components(prints, distance)


def test_each_pair_is_compared_under_one_key(spark):
    chance = random.Random(9)
    for _ in range(300):
        a = chance.getrandbits(64)
        b = a ^ sum(1 << bit for bit in chance.sample(range(64), chance.randrange(1, 4)))
        shared = []
        for bit in range(64):
            low = 32 * (bit // 32)
            mask = (((1 << 32) - 1) << low) & ~(1 << bit)
            if a & mask == b & mask:
                shared.append(bit << 32)
        keys = np.array(shared, np.int64)
        apart = np.full(len(keys), a ^ b, np.uint64)
        assert fingerprints.same_bits(apart, keys, 3).sum() == 1


def test_keys_are_the_segments_with_one_bit_cleared(spark):
    values = [0, -1, 5, -(1 << 63), 0x1234567890ABCDEF]
    rows = spark.createDataFrame([(v,) for v in values], "print long").select("print", *[
        fingerprints.variants(fingerprints.segment(F.col("print"), k), k).alias(f"k{k}") for k in (0, 1)]).collect()
    for row in rows:
        bits = row["print"] % (1 << 64)
        for k in (0, 1):
            own = bits >> 32 * k & 0xFFFFFFFF
            assert row[f"k{k}"] == [(32 * k + bit) << 32 | own & ~(1 << bit) for bit in range(32)]


def test_a_large_group_leaves_a_forest():
    chance = np.random.default_rng(1)
    base = np.uint64(0xFFFF0000FFFF0000)
    prints = np.unique(base ^ (np.uint64(1) << chance.integers(32, 64, 3000, dtype=np.uint64)) ^ (
        np.uint64(1) << chance.integers(32, 64, 3000, dtype=np.uint64)))
    n = len(prints)
    group, key = np.zeros(n, np.int64), np.full(n, int(base & np.uint64(0xFFFFFFFE)))
    i, j = fingerprints.group_links(group, key, prints, np.full(n, -1), 3)
    assert len(i) <= n - 1


def test_the_query_against_brute_force(spark, tmp_path):
    chance = random.Random(4)
    texts = [None, "", " \n\t", "one", "ONE", "two words", "Two\twords", "É b c", "é b c", "a b c", "x " * 5000, "x y " * 2000]
    for _ in range(30):
        base = [f"w{chance.randrange(500)}" for _ in range(chance.randrange(3, 400))]
        for _ in range(chance.randrange(1, 9)):
            copy = list(base)
            for _ in range(chance.randrange(0, 4)):
                copy[chance.randrange(len(copy))] = f"w{chance.randrange(500)}"
            texts.append(" ".join(copy))
    rows = [(n + 100, text, "a") for n, text in enumerate(texts)]
    rows += [rows[20], (None, texts[20], "b"), (None, "alone without an id", "c"), (7, texts[-1], "d")]
    chance.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op12_fingerprints"](spark, str(tmp_path)).collect()
    prints = [brute_print(text) for _, text, _ in rows]
    groups = brute_components(prints)
    least = {}
    for (doc_id, _, _), group in zip(rows, groups):
        if doc_id is not None:
            least[group] = min(least.get(group, doc_id), doc_id)
    expected = [(doc_id, f"{p:016x}", least.get(group)) for (doc_id, _, _), p, group in zip(rows, prints, groups)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert len({row[2] for row in expected}) < len(rows) - 30


def test_empty_table_and_tables_cut_between_groups(spark):
    assert fingerprints.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    table = pa.table({"key": [1, 1, 1, 2, 2, 3], "low": [0] * 6})
    parts = [t.column("key").to_pylist() for t in fingerprints.whole_groups(iter(table.to_batches(max_chunksize=2)), ("key", "low"), 2)]
    assert sum(parts, []) == [1, 1, 1, 2, 2, 3]
    assert all(not set(a) & set(b) for n, a in enumerate(parts) for b in parts[:n])
