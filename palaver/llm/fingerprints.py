"""SimHash fingerprints of texts, and groups of texts whose fingerprints differ in few bits.

Of 64 bits cut into two segments, one differs by one bit at most where the whole differs by three at most. So each
fingerprint is indexed under every variant of a segment in which one bit is a wildcard, 64 in all, and an equality join
over the variants brings together all fingerprints of which one segment differs by one bit or none. A pair is looked at
where its segments differ in the wildcard, or, if they are equal, where the wildcard is the segment's first bit; the second
segment counts only for pairs that the first does not bring together. So each pair is compared once, on all 64 bits.

Texts of equal fingerprints are one class, which takes part once. What leaves a group of the join is a spanning forest of
its links: enough for the components, and no more rows than the group has. A variant that more than ``BLOCK`` classes may
share is dealt out as pairs of blocks, so no task sees more than two blocks of it.

Defined cases: a null or empty text, and one without words, has the fingerprint zero, which links like any other; with
fewer words than a shingle has, the whole sequence is the only shingle. Repeated rows are one class. Rows without an id
take part and link others, but name no component; a component of such rows alone has none. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import keep, salted_left_join, utf8
from palaver.llm.components import connected

SIZE = 3
SEED = 42
MAX_DISTANCE = 3
SEGMENT = 32
BLOCK = 2_048
SALTS = 16
# Shingles whose bits are counted at a time, and linked pairs held before they are thinned to a forest.
CHUNK = 4_096
HELD = 1 << 20
# Rows of the join that a task compares at a time.
GATHERED = 1 << 15


def fingerprint(text: bytes | None, size: int = SIZE) -> int:
    """The SimHash of a text over the XXH64 hashes of its shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(shingle, SEED) for shingle in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[start:start + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, size: int = SIZE) -> Column:
    """The fingerprints of texts, as the signed number of the same 64 bits."""

    @F.arrow_udf("bigint")
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(value, size) for value in utf8(batch)], np.uint64).view(np.int64))

    return printed(text)


def segment(prints: Column, number: int) -> Column:
    """A segment's 32 bits, as a number from 0."""
    shifted = F.shiftrightunsigned(prints, number * SEGMENT)
    return shifted.bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("long"))


def variants(value: Column, number: int) -> Column:
    """The keys of a segment's variants: the number of the wildcard bit, then the segment with that bit cleared."""
    keys = [F.lit((number * SEGMENT + bit) << SEGMENT).cast("long").bitwiseOR(
        value.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit)).cast("long"))) for bit in range(SEGMENT)]
    return F.array(*keys)


def large_variants(classes: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of the variants that may have more than ``block`` classes. A variant joins two values of a segment,
    so one of them has half as many; values are counted, two a class, rather than variants."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("number"), segment(F.col("print"), k).alias("value")) for k in (0, 1)]))
    counts = classes.select(values.alias("s")).groupBy("s.number", "s.value").agg(F.count("*").alias("n"))
    many = counts.filter(F.col("n") > block // 2)
    keys = F.when(F.col("number") == 0, variants(F.col("value"), 0)).otherwise(variants(F.col("value"), 1))
    sizes = many.select("n", F.explode(keys).alias("key")).groupBy("key").agg(F.sum("n").alias("n"))
    return sizes.select("key", F.ceil(F.col("n") / block + 1).cast("int").alias("blocks"))


def same_bits(apart: np.ndarray, key: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs, by the bits in which they differ, are near enough and are compared under this key."""
    bit = (key >> SEGMENT).astype(np.uint64)
    low = apart & np.uint64((1 << SEGMENT) - 1)
    high = apart >> np.uint64(SEGMENT)
    first = bit < SEGMENT
    own, local = np.where(first, low, high), bit % np.uint64(SEGMENT)
    here = (own == np.uint64(1) << local) | ((own == 0) & (local == 0))
    return here & (first | (np.bitwise_count(low) > 1)) & (np.bitwise_count(apart) <= distance)


def forest(label: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that join what ``label`` holds apart, without circles; ``label`` is brought up to date."""
    chosen, left = [], np.arange(len(first))
    while len(left):
        a, b = label[first[left]], label[second[left]]
        apart = a != b
        left, high, low = left[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        hung, picked = np.unique(high, return_index=True)
        chosen.append(left[picked])
        root = np.arange(len(label))
        root[hung] = low[picked]
        while not np.array_equal(deeper := root[root], root):
            root = deeper
        label[:] = root[label]
    return np.concatenate(chosen) if chosen else left


def group_links(group: np.ndarray, key: np.ndarray, prints: np.ndarray, cross: np.ndarray,
                distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a spanning forest of each group's links. Rows are sorted by group; ``cross`` is the block of a row
    in a group of two blocks, where only pairs of both are looked at, and -1 in a group of one."""
    label = np.arange(len(group))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if waiting:
            i, j = (np.concatenate(part) for part in zip(*waiting))
            waiting.clear()
            picked = forest(label, i, j)
            edges.append((i[picked], j[picked]))

    held, step, i = 0, 1, np.arange(len(group))
    while True:
        i = i[i + step < len(group)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        j = i + step
        near = same_bits(prints[i] ^ prints[j], key[i], distance) & ((cross[i] < 0) | (cross[i] != cross[j]))
        if near.any():
            waiting.append((i[near], j[near]))
            held += int(near.sum())
            if held > HELD:
                settle()
                held = 0
        step += 1
    settle()
    if not edges:
        return np.array([], np.int64), np.array([], np.int64)
    return tuple(np.concatenate(part) for part in zip(*edges))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = GATHERED) -> Iterator[pa.Table]:
    """Sorted rows again, in larger tables cut between groups only. A group has two blocks at most, so little is held."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            last = np.logical_and.reduce([(column := table.column(name).to_numpy()) == column[-1] for name in keys])
            start = 0 if last.all() else size - int(last[::-1].argmin())
            if start:
                yield table.slice(0, start)
            held, size = table.slice(start).to_batches(), size - start
    if size:
        yield pa.Table.from_batches(held)


def near_links(classes: DataFrame, distance: int = MAX_DISTANCE, block: int | None = None) -> DataFrame:
    """Links (a, b) between the fingerprints in ``print``, different ones, that connect all near ones."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"two segments find distances up to {MAX_DISTANCE}")
    block = block or BLOCK
    large = keep(large_variants(classes, block), "variants")
    keys = F.concat(variants(segment(F.col("print"), 0), 0), variants(segment(F.col("print"), 1), 1))
    indexed = classes.select("print", F.explode(keys).alias("key")).join(large, "key", "left")
    own = F.coalesce(F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"), F.lit(0))
    others = F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)
    paired = indexed.select("key", "print", own.alias("block"), F.explode(others).alias("other"))
    paired = paired.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                           "print", "block")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("key", "low", "high")):
            key, low, high, block = (rows.column(name).to_numpy() for name in ("key", "low", "high", "block"))
            prints = rows.column("print").to_numpy().view(np.uint64)
            change = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            group = np.concatenate([[0], np.cumsum(change)])
            i, j = group_links(group, key, prints, np.where(low == high, -1, block), distance)
            if len(i):
                numbers = prints.view(np.int64)
                yield pa.RecordBatch.from_pydict({"a": np.maximum(numbers[i], numbers[j]), "b": np.minimum(numbers[i], numbers[j])})

    grouped = paired.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return grouped.mapInArrow(link, "a long, b long")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                    distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; ``component_id`` is the smallest id that links lead to."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), fingerprints(F.col(f"`{text}`"), size).alias("print"))
    printed = keep(plain, "prints")
    classes = keep(printed.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    nodes = classes.join(connected(near_links(classes, distance)).withColumnRenamed("node", "print"), "print", "left")
    nodes = keep(nodes.select("print", "least", F.coalesce("component", "print").alias("component")), "nodes")
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = salted_left_join(nodes.select("print", "component"), named, ["component"], F.col("print"), SALTS)
    found = salted_left_join(printed, named.select("print", "component_id"), ["print"], F.col("doc_id"), SALTS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
