"""Similarity join of word n-gram sets by rare-first prefixes, with the components of the links.

Each text's set of hashed shingles is put into one global order, rare ones first; how common a shingle is comes from
counts over all texts in a fixed number of buckets, which any order may use without losing a pair. Two sets as similar
as asked for share a shingle of their prefixes. So the prefixes are joined by shingle, and a pair must then pass the
length filter, the positional filter, and the suffix filter: the sets are parted by hash into fixed parts, and the
differences of the parts' sizes bound the sets' difference from below. Pairs never leave a task: what leaves the filters is
the classes of a shingle that are in a pair. Their whole texts come to the shingle, once each, and the pairs are verified there.

A pair meets at every shingle that both prefixes hold. It is passed over where both hold one of the few shared shingles
just before as well, for it meets there too; and it counts only at the first shingle that both sets hold, which their
prefixes hold as well.

Texts with equal sets form one class, which takes part once. ``similar_links`` verifies every candidate pair of classes
and counts each document's links. Where components alone are wanted, as in ``similar_components``, pairs that the links of
their shingle already connect are passed over, and no component is missed by that. Either way a shingle leaves a spanning
forest of its links, and no more rows than it has classes. A shingle shared by many classes, or by large ones, is dealt out
as pairs of blocks, so no task holds more than two blocks of it.

Defined cases: a null or empty text has no shingle and is linked with nothing; with fewer words than a shingle has, the
whole sequence is the only shingle. Repeated rows are one class. Rows without an id take part and link others, but name no
component; a component of such rows alone has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.common import give_back, keep, salted_left_join, utf8
from palaver.llm.components import connected
from palaver.llm.fingerprints import forest, whole_groups

SIZE = 3
PERCENT = 90
BUCKET_BITS = 18
PARTS = 128
# Classes, and shingles of their sets, in a block.
BLOCK = 1_000
BLOCK_SHINGLES = 1 << 20
# Shared shingles before a shingle that are looked at.
BEFORE = 3
SALTS = 16
FILTER_WORDS = 1 << 14
REMEMBERED = 100_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


@dataclass(frozen=True)
class Shingler:
    size: int = SIZE

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of each text's shingles."""
        known: dict[bytes, int] = {}
        for text in texts:
            words = text.lower().split() if text else []
            for word in words:
                if word not in known:
                    if len(known) >= REMEMBERED:
                        known = {other: known[other] for other in set(words) if other in known}
                    known[word] = xxhash.xxh64_intdigest(word)
            codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            width = min(self.size, len(codes))
            hashes = np.full(len(codes) - width + 1 if width else 0, np.uint64(width))
            for offset in range(width):
                factor = FACTORS[offset % len(FACTORS)]
                hashes = (hashes ^ (hashes >> np.uint64(29))) * factor + codes[offset:offset + len(hashes)]
            hashes = (hashes ^ (hashes >> np.uint64(31))) * FACTORS[0]
            yield np.unique(hashes ^ (hashes >> np.uint64(32)))


def bucket_counts(docs: DataFrame, text: str, shingler: Shingler) -> np.ndarray:
    """How many texts' shingles fall into each bucket; the buckets are fixed in number."""
    shift = np.uint64(64 - BUCKET_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for hashes in shingler.sets(utf8(batch.column(0))):
                np.add.at(sums, (hashes >> shift).astype(np.int64), 1)
        places = np.flatnonzero(sums)
        for start in range(0, len(places), 20_000):
            part = places[start:start + 20_000]
            yield pa.RecordBatch.from_pydict({"bucket": part.astype(np.int32), "n": sums[part]})
        give_back()

    rows = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in rows:
        found[row["bucket"]] = row["n"]
    return np.minimum(found, np.iinfo(np.uint32).max).astype(np.uint32)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def part_sizes(hashes: np.ndarray) -> np.ndarray:
    """Sizes of a set's parts. Large ones are cut off, which leaves a lower bound of a difference one."""
    by_part = np.bincount(((hashes >> np.uint64(8)) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
    return np.minimum(by_part, 255).astype(np.uint8)


def signatures(docs: DataFrame, text: str, shingler: Shingler, percent: int, counts: np.ndarray) -> Column:
    """A struct of the set's fingerprint, its size, its prefix, rare shingles first, and its sizes by part."""
    shift = np.uint64(64 - BUCKET_BITS)

    @F.arrow_udf("fingerprint binary, n int, prefix array<long>, parts binary")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints, sizes, prefixes, ends, parts = [], [], [], [0], []
            for hashes in shingler.sets(utf8(batch)):
                prints.append(fingerprint(hashes))
                sizes.append(len(hashes))
                length = prefix_length(len(hashes), percent)
                order = np.lexsort((hashes, counts[(hashes >> shift).astype(np.int64)]))
                prefixes.append(hashes[order[:length]].view(np.int64))
                ends.append(ends[-1] + length)
                parts.append(part_sizes(hashes).tobytes())
            flat = np.concatenate(prefixes) if prefixes else np.array([], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.StructArray.from_arrays(
                [pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(parts, pa.binary())],
                ["fingerprint", "n", "prefix", "parts"])
            give_back()

    return signed(F.col(text))


def overlap_needed(total: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of two sets of ``total`` shingles together."""
    return -(-percent * total // (100 + percent))


def surviving_pairs(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within a group that pass the filters, some at a time. Rows are sorted by group and size;
    ``block`` is a row's block in a group of two blocks, where only pairs of both are looked at, and -1 in a group of one;
    ``before`` are shared shingles before the group's own one in a row's prefix, the own one standing for none."""
    group, n, place, parts, block = (rows[name] for name in ("group", "n", "place", "parts", "block"))
    token, before = rows["token"], rows["before"]
    step, i = 1, np.arange(len(group))
    while True:
        i = i[i + step < len(group)]
        j = i + step
        # Larger sets only come later, so a row that has met one too large is done.
        i = i[(group[i] == group[j]) & (100 * n[i] >= percent * n[j])]
        if not len(i):
            return
        j = i + step
        here = (block[i] < 0) | (block[i] != block[j])
        a, b = i[here], j[here]
        earlier = np.zeros(len(a), bool)
        for one in before:
            for other in before:
                earlier |= (one[a] == other[b]) & (one[a] != token[a])
        a, b = a[~earlier], b[~earlier]
        needed = overlap_needed(n[a] + n[b], percent)
        near = np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b]) >= needed
        a, b, needed = a[near], b[near], needed[near]
        apart = np.abs(parts[a].astype(np.int16) - parts[b]).sum(1, dtype=np.int64)
        near = apart <= n[a] + n[b] - 2 * needed
        if near.any():
            yield a[near], b[near]
        step += 1


def group_numbers(rows: pa.Table) -> np.ndarray:
    token, low, high = (rows.column(name).to_numpy() for name in ("token", "low", "high"))
    change = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return np.concatenate([[0], np.cumsum(change)])


def pair_rows(rows: pa.Table, n: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
    """What ``surviving_pairs`` reads."""
    token, low, high, block, place = (rows.column(name).to_numpy() for name in ("token", "low", "high", "block", "place"))
    return {"group": group_numbers(rows), "n": n.astype(np.int64), "place": place.astype(np.int64), "parts": parts,
            "block": np.where(low == high, -1, block), "token": token,
            "before": [rows.column(name).to_numpy() for name in EARLIER]}


GROUP = ["token", "low", "high"]
EARLIER = [f"before{number}" for number in range(1, BEFORE + 1)]
PAIRED = ", ".join(["token long, low int, high int, node long, n int, place int, block int", *[f"{name} long" for name in EARLIER]])


def paired(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The classes of each shingle, in pairs of its blocks, that are in a pair there which passes the filters."""
    # The order and the join are both by class: one exchange.
    in_order = W.partitionBy("node").orderBy("place")
    before = [F.coalesce(F.lag("token", number).over(in_order), F.col("token")).alias(name)
              for number, name in enumerate(EARLIER, 1)]
    rows = shared.select("*", *before).join(classes.select("node", "n", "parts"), "node")
    # Blocks of a shingle that many classes share meet in pairs of blocks, each pair in one group.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("token", "node", "n", "place", *EARLIER, "parts", "block", other)
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, tuple(GROUP)):
            parts = np.frombuffer(b"".join(table.column("parts").to_pylist()), np.uint8).reshape(-1, PARTS)
            alive = np.zeros(len(table), bool)
            for a, b in surviving_pairs(pair_rows(table, table.column("n").to_numpy(), parts), percent):
                alive[a] = alive[b] = True
            if alive.any():
                yield from table.drop_columns(["parts"]).filter(pa.array(alive)).to_batches()
        give_back()

    grouped = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "n", "node")
    return grouped.select(*[field.split()[0] for field in PAIRED.split(", ")], "parts").mapInArrow(found, PAIRED)


def whole_texts(wanted: DataFrame, docs: DataFrame, shingler: Shingler) -> DataFrame:
    """(node, text) of the wanted classes, once each: equal sets, so any of their texts will do."""
    # A bitmap of fixed size over hashes of the ids keeps most other texts out of the join.
    slot = F.pmod(F.xxhash64("node"), F.lit(64 * FILTER_WORDS))
    bits = wanted.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits")).collect()
    bitmap = [0] * FILTER_WORDS
    for row in bits:
        bitmap[row["word"]] = row["bits"]
    constant = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")
    own = F.pmod(F.xxhash64("doc_id"), F.lit(64 * FILTER_WORDS))
    likely = docs.filter(F.getbit(F.get(constant, F.floor(own / 64).cast("int")), F.pmod(own, F.lit(64)).cast("int")) == 1)

    named = likely.select(F.col("doc_id").alias("node"), "text")

    @F.arrow_udf("binary")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(hashes) for hashes in shingler.sets(utf8(batch))], pa.binary())

    # Classes of rows without an id are known by their set alone.
    unnamed = docs.filter("doc_id IS NULL").select(F.xxhash64(prints("text")).alias("node"), "text")
    return named.unionByName(unnamed).join(wanted, "node").groupBy("node").agg(F.first("text").alias("text"))


def set_links(hashes: list[np.ndarray], members: np.ndarray, token: int, pairs: list[tuple[np.ndarray, np.ndarray]],
              percent: int, counts: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: a spanning forest of its links, and how many members each row is linked with at this shingle."""
    ends = np.cumsum([len(row) for row in hashes])
    starts, n = ends - [len(row) for row in hashes], np.array([len(row) for row in hashes])
    words, place = np.unique(np.concatenate(hashes), return_inverse=True)
    order = np.lexsort((words, counts[(words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ids = rank[place]
    own = [np.sort(ids[start:end]) for start, end in zip(starts, ends)]
    here = rank[np.searchsorted(words, np.uint64(token))]
    left, right = (np.concatenate(part) for part in zip(*pairs))
    by_left = np.argsort(left, kind="stable")
    left, right = left[by_left], right[by_left]
    label, linked, edges = np.arange(len(hashes)), np.zeros(len(hashes), np.int64), []
    held = np.zeros(len(words), bool)
    for start, end in zip(*_stretches(left)):
        a, b = left[start], right[start:end]
        if not every:
            b = b[label[b] != label[a]]
        if not len(b):
            continue
        held[own[a]] = True
        joined = np.concatenate([own[row] for row in b])
        cuts = np.cumsum(n[b]) - n[b]
        hit = held[joined]
        held[own[a]] = False
        common = np.add.reduceat(hit, cuts, dtype=np.int64)
        places = np.flatnonzero(hit)
        # The first common shingle: both hold the group's own one, so there is one.
        earliest = joined[places[np.searchsorted(places, cuts)]]
        alike = (100 * common >= percent * (n[a] + n[b] - common)) & (earliest == here)
        b = b[alike]
        linked[a] += members[b].sum()
        linked[b] += members[a]
        from_a = np.full(len(b), a)
        picked = forest(label, from_a, b)
        edges += zip(from_a[picked], b[picked])
    if not edges:
        return np.array([], np.int64), np.array([], np.int64), linked
    first, second = np.array(edges).T
    return first, second, linked


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.concatenate([starts[1:], [len(values)]])


def verified(candidates: DataFrame, texts: DataFrame, members: DataFrame | None, shingler: Shingler, percent: int,
             counts: np.ndarray) -> DataFrame:
    """Rows (a, b, null), links that connect what any links connect, and, given the classes' members, (a, null, linked):
    how many members of other classes ``a`` is linked with, in parts to be summed."""
    every = members is not None
    rows = candidates.join(texts, "node")
    rows = rows.join(members, "node") if every else rows.withColumn("members", F.lit(1).cast("long"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, tuple(GROUP), 1):
            node, token, members = (table.column(name).to_numpy() for name in ("node", "token", "members"))
            whole = list(shingler.sets(utf8(table.column("text").combine_chunks())))
            parts = np.stack([part_sizes(hashes) for hashes in whole])
            rows = pair_rows(table, np.array([len(hashes) for hashes in whole]), parts)
            found = list(surviving_pairs(rows, percent))
            for start, end in zip(*_stretches(rows["group"])):
                mine = [(a[inside] - start, b[inside] - start) for a, b in found
                        if (inside := (a >= start) & (a < end)).any()] if len(table) > end - start else found
                if not mine:
                    continue
                a, b, linked = set_links(whole[start:end], members[start:end], token[start:start + 1].view(np.uint64)[0], mine,
                                         percent, counts, every)
                a, b = node[start:end][a], node[start:end][b]
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b, "linked": pa.nulls(len(a), pa.int64())})
                some = np.flatnonzero(linked)
                if every and len(some):
                    yield pa.RecordBatch.from_pydict(
                        {"a": node[start:end][some], "b": pa.nulls(len(some), pa.int64()), "linked": linked[some]})
        give_back()

    grouped = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "n", "node")
    return grouped.mapInArrow(found, "a long, b long, linked long")


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def class_members(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(fingerprint, node, members): rows that repeat an id are one document, each row without id is one."""
    rows = signed.filter("n > 0").groupBy("fingerprint", "doc_id").agg(F.count("*").alias("rows"))
    sizes = rows.groupBy("fingerprint").agg(
        F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("members"))
    return sizes.join(classes.select("fingerprint", "node"), "fingerprint")


def joined_documents(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, every: bool) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, and with ``every`` its ``n_links``."""
    shingler = Shingler(size)
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = bucket_counts(plain, "text", shingler)
    signed = keep(plain.select("doc_id", signatures(plain, "text", shingler, percent, counts).alias("s")).select("doc_id", "s.*"),
                  "signatures")
    classes = signed.filter("n > 0").groupBy("fingerprint").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts"))
    classes = keep(classes.withColumn("node", F.coalesce("rep", F.xxhash64("fingerprint"))), "classes")
    prefixes = classes.select("node", "n", F.posexplode("prefix").alias("place", "token"))
    shares = prefixes.groupBy("token").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).filter("classes > 1")
    blocks = F.ceil(F.greatest(F.col("classes") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    shared = prefixes.drop("n").join(shares, "token").withColumn("blocks", blocks).select(
        "token", "node", "place", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    candidates = keep(paired(shared, classes, percent), "paired")
    texts = whole_texts(candidates.select("node").distinct(), plain, shingler)
    members = keep(class_members(signed, classes), "members") if every else None
    found = keep(verified(candidates, texts, members.select("node", "members") if every else None, shingler, percent, counts),
                 "near")

    component = connected(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "_node")
    nodes = keep(classes.select("fingerprint", "node", "rep").join(component, F.col("node") == F.col("_node"), "left").select(
        "fingerprint", "node", "rep", F.coalesce("component", "node").alias("component")), "nodes")
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = salted_left_join(nodes, least, ["component"], F.col("node"), SALTS).select("fingerprint", "node", "component_id")
    if every:
        linked = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
        named = named.join(members.select("node", "members"), "node").join(linked, "node", "left").select(
            "fingerprint", "component_id", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    named = named.drop("node")
    rows = salted_left_join(signed.select("doc_id", "fingerprint", "n"), named, ["fingerprint"], F.col("doc_id"), SALTS)
    # A text without shingles has no class: its row is its own component.
    single = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if every else []
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), single, *links)


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                       percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. Ids are whole numbers, different for different texts."""
    return joined_documents(docs, doc_id, text, size, percent, False)


def similar_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                  percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row, ``n_links`` being the number of other documents as
    similar as asked for. Rows that repeat an id are one document, each row without id is one."""
    return joined_documents(docs, doc_id, text, size, percent, True)
