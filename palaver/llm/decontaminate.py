"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items are put into one automaton over words. Each text is streamed through it word by word while
the longest suffix that occurs in some item is tracked. Wherever that suffix is as long as a window, all of its words
are hit; an item shorter than a window is hit where it occurs as a whole.

The automaton lives in every task, so its size is bounded: the items are taken in blocks of at most ``block_words``
words, and the texts are run against one block after another, each row carrying its hits along.

Defined cases: a null text or item has no words. Items that share an id count once. Items without an id are hit like any
others, but not named among those found. Repeated rows get equal results. No item gives no hits. Columns of the result's
names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import add_struct, fresh, give_back, let, utf8

WINDOW = 10
BLOCK_WORDS = 500_000
# Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Hit words from the first to before the end, and the bytes of the text that hold them.
SPANS = "array<struct<first:long,end:long,start:long,stop:long>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """Generalised suffix automaton of the items' words, with what each state says about windows and short items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        coded = []
        for item, tokens in items:
            codes = [self.vocabulary.setdefault(token, len(self.vocabulary)) for token in tokens]
            if not codes:
                continue
            coded.append((item, codes))
            state = 0
            for code in codes:
                state = self._extend(state, code, ends)
                ends[state].add(item)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(by_length):
            ends[self.link[state]] |= ends[state] if self.link[state] else set()
        # For a state with suffixes of window length: the items that contain that window.
        self.items: list[frozenset[int] | None] = [None] * len(self.length)
        # Whole short items ending here: (length, item), own ones last and longest first among the inherited.
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for item, codes in coded:
            if len(codes) < window:
                state = 0
                for code in codes:
                    state = self.next[state][code]
                self.short[state].append((len(codes), item))
        for state in by_length:
            parent = self.link[state]
            self.short[state] = sorted({*self.short[state], *self.short[parent]}, key=lambda one: one[0], reverse=True)
            if self.length[parent] >= window:
                self.items[state] = self.items[parent]
            elif self.length[state] >= window:
                self.items[state] = frozenset(ends[state])
        self.least = min((min(len(codes), window) for _, codes in coded), default=0)

    def _extend(self, last: int, code: int, ends: list[set[int]]) -> int:
        known = self.next[last].get(code)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, code, known, ends)
        state = self._add(self.length[last] + 1, {}, ends)
        while last >= 0 and code not in self.next[last]:
            self.next[last][code] = state
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        else:
            known = self.next[last][code]
            fits = self.length[known] == self.length[last] + 1
            self.link[state] = known if fits else self._split(last, code, known, ends)
        return state

    def _add(self, length: int, following: dict[int, int], ends: list[set[int]]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, last: int, code: int, known: int, ends: list[set[int]]) -> int:
        clone = self._add(self.length[last] + 1, dict(self.next[known]), ends)
        self.link[clone], self.link[known] = self.link[known], clone
        while last >= 0 and self.next[last].get(code) == known:
            self.next[last][code] = clone
            last = self.link[last]
        return clone

    def hits(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged (first, end) word spans that are hit, and the items found. Unknown words have code -1."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        inside = np.concatenate([[False], codes >= 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.least:
                self._stream(codes[start:end].tolist(), start, spans, items)
        return spans, items

    def _stream(self, codes: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        state, matched = 0, 0
        following, link, length, window = self.next, self.link, self.length, self.window
        for end, code in enumerate(codes, offset + 1):
            while state and code not in following[state]:
                state = link[state]
                matched = length[state]
            target = following[state].get(code)
            if target is None:
                continue
            state, matched = target, matched + 1
            covered = 0
            if matched >= window:
                covered = matched
                items |= self.items[state]
            for size, item in self.short[state]:
                if size <= matched:
                    covered = max(covered, size)
                    items.add(item)
            if covered:
                start = end - covered
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of about ``block_words`` words at most, dealt by a hash of their rows."""
    known = items.filter(F.col(text).isNotNull()).select(item_id, text)
    total = known.select(F.sum(F.regexp_count(F.col(text), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    blocks = -(-total // block_words)
    for block in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64(item_id, text), F.lit(blocks)) == block).collect()
        yield [(row[0], words(row[1].encode("utf-8", "surrogatepass")))
               for row in sorted(map(tuple, rows), key=lambda row: (row[0] is None, row[0] or 0, row[1]))]


def probe(text: Column, automaton: Automaton) -> Column:
    """A struct of the number of words, the hit word spans and the items found.

    It counts as not deterministic, so that a filter on it stays behind it: pushed before it, the texts would be streamed
    through the automaton once for the filter and once more for the spans, by Python workers of their own.
    """

    @F.arrow_udf(f"n_words long, spans {SPANS}, items array<long>")
    def probed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = automaton.vocabulary.get
        for batch in batches:
            counts, spans, items = [], [], []
            for value in utf8(batch):
                tokens = words(value)
                counts.append(len(tokens))
                codes = np.fromiter(map(code, tokens, repeat(-1)), np.int32, len(tokens))
                found, named = automaton.hits(codes) if tokens and automaton.least else ([], set())
                places = [match.span() for match in WORD.finditer(value)] if found else []
                spans.append([{"first": first, "end": end, "start": places[first][0], "stop": places[end - 1][1]}
                              for first, end in found])
                items.append(sorted(named - {None}))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([(field, pa.int64()) for field in ("first", "end", "start", "stop")]))),
                 pa.array(items, pa.list_(pa.int64()))], ["n_words", "spans", "items"])
            give_back()

    return probed.asNondeterministic()(text)


def merge_spans(old: Column, new: Column) -> Column:
    """Union of two sorted lists of spans."""
    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"),
                          last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["first"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
                          F.concat(done, F.array(span)))

    empty = F.array().cast(SPANS)
    return F.aggregate(F.array_sort(F.concat(old, new)), empty, step)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                       text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows and columns with ``n_words``, ``n_hit``, ``spans`` (hit words and their bytes) and ``items`` appended."""
    name = fresh(docs.columns, "_probe")
    found = None
    for block in item_blocks(items, item_id, item_text, block_words):
        result = probe(F.col(text), Automaton(block, window))
        if found is None:
            found = docs.withColumn(name, result)
            continue
        other = fresh(found.columns, "_more")
        merged = F.struct(
            F.col(name)["n_words"].alias("n_words"),
            merge_spans(F.col(name)["spans"], F.col(other)["spans"]).alias("spans"),
            F.array_sort(F.array_union(F.col(name)["items"], F.col(other)["items"])).alias("items"))
        found = found.withColumn(other, result).withColumn(name, merged).drop(other)
    if found is None:
        found = docs.withColumn(name, probe(F.col(text), Automaton([], window)))
    hit = F.aggregate(F.col(name)["spans"], F.lit(0).cast("long"), lambda sum, span: sum + span["end"] - span["first"])
    whole = F.struct(F.col(name)["n_words"].alias("n_words"), hit.alias("n_hit"), F.col(name)["spans"].alias("spans"),
                     F.col(name)["items"].alias("items"))
    return add_struct(found, whole, ["n_words", "n_hit", "spans", "items"]).drop(name)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans of words; one space stands where words were cut out. Native: no second Python worker."""
    whole = F.struct(
        text.cast("binary").alias("bytes"), F.concat(F.array(F.lit(0).cast("long")), spans["stop"]).alias("starts"),
        F.concat(spans["start"], F.array(F.octet_length(text).cast("long"))).alias("stops"))

    def kept(one: Column) -> Column:
        def part(start: Column, number: Column) -> Column:
            size = F.get(one["stops"], number) - start
            value = F.substring(one["bytes"], (start + 1).cast("int"), size.cast("int")).cast("string")
            return F.when(number < F.size(one["stops"]) - 1, F.rtrim(value)).otherwise(value)

        return F.array_join(F.transform(one["starts"], part), " ")

    return let(whole, kept)


def remove_contamination(found: DataFrame, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """Drop rows of which more than ``max_coverage`` of the words are hit; cut the hit words out of the others."""
    spans = F.col("spans")
    cleaned = F.when(F.size(spans) > 0, without_spans(F.col(text), spans)).otherwise(F.col(text))
    return found.filter(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")).withColumn(text, cleaned)
