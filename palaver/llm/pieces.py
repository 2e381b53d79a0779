"""SentencePiece encoding and decoding as a max-plus parallel scan.

A model of merge type segments a text uniquely, and a segmentation is the right one exactly if every two neighbouring
pieces stay apart when they are merged by themselves. So a pair of pieces scores 0 if its seam holds and minus infinity
if a merge would cross it, and the encoding is the path of score 0. The last piece before each place is unique, which
makes the search linear.

A giant text is cut into chunks of fixed length, in different tasks. The state at a cut is the piece that starts before
it and reaches or crosses it; a chunk's transfer matrix says which state at its left cut leads to which at its right
cut. The matrices are multiplied in the max-plus semiring, in blocks first and then over the blocks, products from
both sides give the one state at each cut that lies on a whole path, and every chunk is traced back by itself between
its two states. Other texts are a single chunk between a fixed start and end.

Within a chunk, no piece and no merge crosses a place where a space follows another character (the vocabulary is
checked for that), so the states meet there and the words between are encoded once each and remembered.

Characters outside the vocabulary become byte pieces. Decoding joins the pieces and drops the space that encoding puts
in front. A text that holds the character U+2581, SentencePiece's sign for a space, decodes to a space there.

Defined cases: null and empty texts give no ids and decode to the empty text. Repeated texts get equal ids.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import add_struct, fresh, give_back, utf8

CHUNK = 16_384
GIANT = 65_536
BLOCK = 64
REMEMBERED = 200_000
SPACE = "▁"
# No piece holds a letter with a mark right behind it.
LETTERS, MARKS = "A-Za-zÀ-ɏ", ".,!?:*$%&#|<>"
IMPOSSIBLE = float("-inf")


@dataclass
class Vocabulary:
    """Pieces with their ids and scores; spaces are written as spaces."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    size: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file of merge type with byte pieces and no normalisation but the leading space."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids = {}, {}, [0] * 256
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                byte_ids[int(piece[3:5], 16)] = number
            elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
                text = piece.replace(SPACE, " ")
                ids[text], scores[text] = number, model.get_score(number)
        if any(re.search(f"[^ ] |\n|[{LETTERS}][{MARKS}]", piece) for piece in ids):
            raise ValueError("pieces that go on after a space, or over a mark behind a letter, are not supported")
        if not any(byte_ids):
            raise ValueError("the model has no byte pieces")
        return cls(ids, scores, byte_ids, model.get_piece_size())

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def endings(self) -> set[str]:
        """All texts that some piece ends in."""
        return {piece[start:] for piece in self.ids for start in range(len(piece))}

    @cached_property
    def shown(self) -> list[bytes]:
        """The bytes of each id when decoded."""
        texts = [b""] * self.size
        for piece, number in self.ids.items():
            texts[number] = piece.encode()
        for value, number in enumerate(self.byte_ids):
            texts[number] = bytes([value])
        return texts

    def ids_of(self, piece: str) -> list[int]:
        number = self.ids.get(piece)
        return [self.byte_ids[value] for value in piece.encode("utf-8", "surrogatepass")] if number is None else [number]


class Remembered(dict):
    """Results by key in bounded memory: emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Segmentation of whole texts and of chunks."""

    WORD = re.compile(f" *[{LETTERS}]+(?=[{MARKS}])| *[^ \n]+| +|\n")

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = Remembered(self._word)
        self.seams = Remembered(lambda pair: self._holds(*pair))
        self.histories = Remembered(self._history)
        self.tails = Remembered(self._tail)
        self.valid = {piece for piece in vocabulary.ids if self.histories[piece] is not None}
        self.histories.clear()

    def forget(self) -> None:
        """Drop what can be built again. A worker outlives its task, and the memories refer to their encoder in a cycle,
        so that the next task's ones would come on top of them."""
        for memory in (self.words, self.seams, self.histories, self.tails):
            memory.clear()
        self.__dict__.pop("tree", None)

    @cached_property
    def tree(self) -> dict:
        """All pieces by their characters; a piece stands under the empty key where it ends. Built in each task."""
        root: dict = {}
        for piece in self.valid:
            node = root
            for character in piece:
                node = node.setdefault(character, {})
            if len(piece) > 1:
                node[""] = piece
        return root

    def _history(self, piece: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How merging builds a piece from its characters: the score of each step with the first and with the last
        symbol after it. None if merging ends in something else."""
        scores, symbols = self.vocabulary.scores, list(piece)
        firsts, lasts = [(0.0, symbols[0])], [(0.0, symbols[-1])]
        while len(symbols) > 1:
            best, place = None, 0
            for number in range(len(symbols) - 1):
                score = scores.get(symbols[number] + symbols[number + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, number
            if best is None:
                return None
            symbols[place:place + 2] = [symbols[place] + symbols[place + 1]]
            firsts.append((best, symbols[0]))
            lasts.append((best, symbols[-1]))
        return firsts, lasts

    def _holds(self, left: str, right: str) -> bool:
        """Whether merging keeps the two pieces apart. The steps of both run in the order of their scores, the left
        one first among equals; the seam gives way if a merge across it would come before the next step."""
        lasts, firsts = self.histories[left][1], self.histories[right][0]
        scores, i, j = self.vocabulary.scores, 0, 0
        while True:
            across = scores.get(lasts[i][1] + firsts[j][1])
            more_left, more_right = i + 1 < len(lasts), j + 1 < len(firsts)
            if across is not None and not (more_left and lasts[i + 1][0] >= across) \
                    and not (more_right and firsts[j + 1][0] > across):
                return False
            if more_left and not (more_right and firsts[j + 1][0] > lasts[i + 1][0]):
                i += 1
            elif more_right:
                j += 1
            else:
                return True

    def _piece(self, text: str) -> bool:
        return len(text) == 1 or text in self.valid

    def _tail(self, text: str) -> bool | None:
        """Whether a text is a piece; None if no piece even ends in it."""
        return self._piece(text) if text in self.vocabulary.endings else None

    def _last_pieces(self, text: str, start: int, end: int, before: str | None) -> list[int]:
        """For each place up to ``end``, the length of the last piece of the path from ``start``; 0 if none leads
        there. ``before`` is the piece that ends at ``start``; at a place where nothing can cross there is none."""
        last = [0] * (end + 1)
        ending: list[str | None] = [None] * (end + 1)
        ending[start], last[start] = before, -1
        seams, tails = self.seams, self.tails
        for place in range(start + 1, end + 1):
            found = [text[place - 1]]
            for middle in range(place - 2, start - 1, -1):
                piece = text[middle:place]
                kind = tails[piece]
                if kind:
                    found.append(piece)
                elif kind is None:
                    break
            for piece in reversed(found):
                middle = place - len(piece)
                if last[middle] and (ending[middle] is None or seams[ending[middle], piece]):
                    last[place], ending[place] = len(piece), piece
                    break
        last[start] = 0
        return last

    def _trace(self, text: str, last: list[int], start: int, end: int) -> list[str]:
        pieces = []
        while end > start:
            pieces.append(text[end - last[end]:end])
            end -= last[end]
        return pieces[::-1]

    def _word(self, word: str) -> bytes:
        return self._ids(self._path(word))

    def _path(self, word: str) -> list[str]:
        """The path of score 0 through a whole word, searched with the longest pieces first. Only one such path leads
        to any place, so a place from which the end was not reached need not be tried again."""
        tree, seams, end = self.tree, self.seams, len(word)
        pieces: list[str] = []
        choices: list[list[str]] = []
        dead: set[int] = set()
        at, previous = 0, None
        while at < end:
            if len(choices) == len(pieces):
                options, node = [word[at]], tree
                for place in range(at, end):
                    node = node.get(word[place])
                    if node is None:
                        break
                    if "" in node:
                        options.append(node[""])
                choices.append(options)
            else:
                options = choices[-1]
            while options:
                piece = options.pop()
                if (previous is None or seams[previous, piece]) and at + len(piece) not in dead:
                    pieces.append(piece)
                    at, previous = at + len(piece), piece
                    break
            else:
                dead.add(at)
                choices.pop()
                at -= len(pieces.pop())
                previous = pieces[-1] if pieces else None
        return pieces

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian integers of four bytes."""
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, self.WORD.findall(" " + text.replace(SPACE, " "))))

    # --- chunks of a giant text

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """All pieces (start, end) that start before the cut and reach or cross it."""
        span = self.vocabulary.longest
        return [(start, end) for start in range(max(0, cut - span), cut)
                for end in range(cut, min(len(text), start + span) + 1)
                if self._piece(text[start:end])]

    @staticmethod
    def meeting_places(text: str, start: int, end: int) -> tuple[int, int] | None:
        """The first and the last place in (start, end) that nothing crosses."""
        first = re.compile("(?<=[^ ])(?= )|(?<=\n)|(?=\n)").search(text, start + 1, end)
        if not first:
            return None
        last = max(text.rfind("\n", start + 1, end), start)
        place = end
        while (place := text.rfind(" ", max(last, start) + 1, place)) > 0:
            if text[place - 1] != " ":
                last = max(last, place)
                break
        return first.start(), max(first.start(), last)

    def _arrivals(self, text: str, start: int, before: str | None, cut: int,
                  goals: list[tuple[int, int]] | None) -> list[bool]:
        """Which of the pieces across the right cut the path from ``start`` can go on with."""
        last = self._last_pieces(text, start, len(text) if goals is None else cut, before)
        if goals is None:
            return [start == len(text) or last[len(text)] > 0]
        found = []
        for first, end in goals:
            previous = before if first == start else text[first - last[first]:first] if first > start and last[first] else ""
            found.append(previous is None or previous != "" and self.seams[previous, text[first:end]])
        return found

    def transfer(self, text: str, left: int, right: int | None) -> list[list[float]]:
        """The matrix of a chunk. ``text`` has context on both sides; ``left`` is 0 in the first chunk, ``right`` is
        None in the last one."""
        entries = self.states(text, left) if left else [(0, 0)]
        goals = None if right is None else self.states(text, right)
        cut = len(text) if right is None else right
        # Beyond the longest piece after the left cut, so that no entering piece reaches over the place.
        places = self.meeting_places(text, left + self.vocabulary.longest, cut - 1)
        if places:
            first, last = places
            ways = self._arrivals(text, last, None, cut, goals)
            reached = [self._last_pieces(text, end, first, text[start:end] or None)[first] > 0 for start, end in entries]
            return [[0.0 if here and there else IMPOSSIBLE for there in ways] for here in reached]
        return [[0.0 if there else IMPOSSIBLE
                 for there in self._arrivals(text, end, text[start:end] or None, cut, goals)] for start, end in entries]

    def trace(self, text: str, left: int, right: int | None, entry: int, goal: int) -> bytes:
        """Ids of the pieces that start within the chunk, between its two states."""
        start, end = self.states(text, left)[entry] if left else (0, 0)
        stop = len(text) if right is None else self.states(text, right)[goal][0]
        tail = b"" if right is None else self._ids([text[slice(*self.states(text, right)[goal])]])
        before = text[start:end] or None
        places = self.meeting_places(text, left + self.vocabulary.longest, (len(text) if right is None else right) - 1)
        if places and places[0] <= stop:
            first, last = places[0], min(places[1], stop)
            head = self._trace(text, self._last_pieces(text, end, first, before), end, first)
            words = b"".join(map(self.words.__getitem__, self.WORD.findall(text, first, last)))
            rest = self._trace(text, self._last_pieces(text, last, stop, None), last, stop)
            return self._ids(head) + words + self._ids(rest) + tail
        return self._ids(self._trace(text, self._last_pieces(text, end, stop, before), end, stop)) + tail

    def _ids(self, pieces: list[str]) -> bytes:
        return np.array([i for piece in pieces for i in self.vocabulary.ids_of(piece)], "<i4").tobytes()


def id_lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(value) // 4 for value in found], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))


def texts_of(batch: pa.Array) -> list[str | None]:
    return [None if value is None else value.decode("utf-8", "replace") for value in utf8(batch)]


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (left[:, :, None] + right[None]).max(1)


def through(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """The state at each inner cut on the best path from state ``start`` to state ``end``."""
    suffix = [None] * len(matrices)
    value = np.full((matrices[-1].shape[1], 1), IMPOSSIBLE)
    value[end] = 0
    for number in range(len(matrices) - 1, -1, -1):
        suffix[number] = value = product(matrices[number], value)
    states, state = [], start
    for number in range(len(matrices) - 1):
        state = int((matrices[number][state] + suffix[number + 1][:, 0]).argmax())
        states.append(state)
    return states


MATRIX = "key string, block int, n_in int, n_out int, cells array<float>"
BLOCK_STATES = "key string, block int, enter int, leave int"
CHUNK_STATES = "key string, chunk int, entry int, goal int"
ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "array<float>": pa.list_(pa.float32())}


def as_table(schema: str, columns: dict[str, list]) -> pa.Table:
    """Columns in the types of a schema string."""
    fields = [field.split(" ") for field in schema.split(", ")]
    return pa.table([pa.array(columns[name], ARROW_TYPES[kind]) for name, kind in fields], names=[name for name, _ in fields])


def matrix(row: dict) -> np.ndarray:
    return np.array(row["cells"], float).reshape(row["n_in"], row["n_out"])


def chunks_of(giants: DataFrame, key: str, text: str, chunk: int, context: int) -> DataFrame:
    """One row for each chunk: (key, chunk, piece of text with context, left cut, right cut or null)."""
    whole = F.concat(F.lit(" "), F.translate(F.col(text), SPACE, " "))
    frame = giants.select(F.col(key).alias("key"), whole.alias("whole"))
    last = F.floor((F.length("whole") - 1) / chunk).cast("int")
    # A short rest joins the chunk before it, so that every cut has its context on both sides.
    last = F.when((last > 0) & (F.length("whole") - last * chunk <= 2 * context), last - 1).otherwise(last)
    first = F.greatest(F.col("chunk") * chunk - context, F.lit(0))
    length = F.when(F.col("chunk") == F.col("last"), F.length("whole")).otherwise(chunk * (F.col("chunk") + 1) + context) - first
    return (
        frame.withColumn("last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", "chunk", F.floor(F.col("chunk") / BLOCK).cast("int").alias("block"),
                F.substring("whole", first + 1, length).alias("window"),
                (F.col("chunk") * chunk - first).cast("int").alias("left"),
                F.when(F.col("chunk") < F.col("last"), chunk * (F.col("chunk") + 1) - first).cast("int").alias("right"))
    )


def encode_giants(giants: DataFrame, vocabulary: Vocabulary, key: str, text: str, chunk: int) -> DataFrame:
    """(key, ids) of giant texts with distinct keys."""
    encoder = Encoder(vocabulary)

    @F.arrow_udf("n_in int, n_out int, cells array<float>")
    def transfers(windows: pa.Array, lefts: pa.Array, rights: pa.Array) -> pa.Array:
        found = [encoder.transfer(*row) for row in zip(texts_of(windows), lefts.to_pylist(), rights.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([len(rows) for rows in found], pa.int32()), pa.array([len(rows[0]) for rows in found], pa.int32()),
             pa.array([[cell for row in rows for cell in row] for rows in found], pa.list_(pa.float32()))],
            ["n_in", "n_out", "cells"])

    @F.arrow_udf("array<int>")
    def traces(windows: pa.Array, lefts: pa.Array, rights: pa.Array, entries: pa.Array, goals: pa.Array) -> pa.Array:
        columns = (texts_of(windows), *[c.to_pylist() for c in (lefts, rights, entries, goals)])
        return id_lists([encoder.trace(*row) for row in zip(*columns)])

    def in_order(rows: pa.Table, column: str) -> list[dict]:
        return sorted(rows.to_pylist(), key=lambda row: row[column])

    def multiply(rows: pa.Table) -> pa.Table:
        ordered = in_order(rows, "chunk")
        whole = matrix(ordered[0])
        for row in ordered[1:]:
            whole = product(whole, matrix(row))
        return as_table(MATRIX, {"key": [ordered[0]["key"]], "block": [ordered[0]["block"]], "n_in": [whole.shape[0]],
                                 "n_out": [whole.shape[1]], "cells": [whole.ravel().tolist()]})

    def cut_blocks(rows: pa.Table) -> pa.Table:
        ordered = in_order(rows, "block")
        states = [0, *through([matrix(row) for row in ordered], 0, 0), 0]
        return as_table(BLOCK_STATES, {"key": [row["key"] for row in ordered], "block": [row["block"] for row in ordered],
                                       "enter": states[:-1], "leave": states[1:]})

    def cut_chunks(rows: pa.Table) -> pa.Table:
        ordered = in_order(rows, "chunk")
        enter, leave = ordered[0]["enter"], ordered[0]["leave"]
        states = [enter, *through([matrix(row) for row in ordered], enter, leave), leave]
        return as_table(CHUNK_STATES, {"key": [row["key"] for row in ordered], "chunk": [row["chunk"] for row in ordered],
                                       "entry": states[:-1], "goal": states[1:]})

    chunks = chunks_of(giants, key, text, chunk, vocabulary.longest)
    dealt = chunks.repartition("key", "chunk")
    matrices = dealt.withColumn("found", transfers("window", "left", "right")).select("key", "chunk", "block", "found.*")
    blocks = matrices.groupBy("key", "block").applyInArrow(multiply, MATRIX)
    block_states = blocks.groupBy("key").applyInArrow(cut_blocks, BLOCK_STATES)
    states = matrices.join(block_states, ["key", "block"]).groupBy("key", "block").applyInArrow(cut_chunks, CHUNK_STATES)
    traced = dealt.join(states, ["key", "chunk"]).select(
        "key", "chunk", traces("window", "left", "right", "entry", "goal").alias("ids"))
    return traced.groupBy("key").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda part: part["ids"])).alias("ids"))


def encode_texts(text: Column, vocabulary: Vocabulary, read_back: bool) -> Column:
    """A struct of the ids of texts that are one chunk each and, if asked for, the text decoded from the ids."""
    encoder = Encoder(vocabulary)
    shown = vocabulary.shown if read_back else []

    @F.arrow_udf("ids array<int>, decoded string" if read_back else "ids array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.collect()
        for batch in batches:
            found = [encoder.encode(value) if value else b"" for value in texts_of(batch)]
            columns = {"ids": id_lists(found)}
            if read_back:
                columns["decoded"] = pa.array([decode_ids(np.frombuffer(value, "<i4"), shown) for value in found], pa.string())
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))
            give_back()
        encoder.forget()
        give_back()

    return encoded(text)


def decode_ids(ids: np.ndarray, shown: list[bytes]) -> str:
    return b"".join(map(shown.__getitem__, ids.tolist())).removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", giant: int = GIANT,
           chunk: int = CHUNK, read_back: bool = False) -> DataFrame:
    """All rows and columns with ``ids`` appended, and ``decoded``, the text they decode to, if ``read_back`` is set.
    Texts of more than ``giant`` characters are cut into chunks."""
    if chunk < 4 * vocabulary.longest:
        raise ValueError("chunks must be at least four times as long as the longest piece")
    large = F.coalesce(F.length(F.col(text)) > giant, F.lit(False))
    names = ["ids", "decoded"] if read_back else ["ids"]
    small = add_struct(docs.filter(~large), encode_texts(F.col(text), vocabulary, read_back), names)
    key = fresh(docs.columns, "_key")
    found_key = fresh([*docs.columns, key], "_found_key")
    keyed = docs.filter(large).withColumn(key, F.sha2(F.col(text), 256))
    distinct = keyed.groupBy(key).agg(F.first(text).alias("text"))
    found_ids = fresh([*docs.columns, key], "_found_ids")
    found = encode_giants(distinct, vocabulary, key, "text", chunk).select(
        F.col("key").alias(found_key), F.col("ids").alias(found_ids))
    joined = keyed.join(found, F.col(key) == F.col(found_key))
    results = [F.col(found_ids).alias("ids")] + ([decode(F.col(found_ids), vocabulary).alias("decoded")] if read_back else [])
    whole = add_struct(joined, F.struct(*results), names)
    return small.unionByName(whole.select(*small.columns))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of a list of ids. Bytes that are not UTF-8 come out as replacement characters."""
    shown = vocabulary.shown

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *[size or 0 for size in pa.compute.list_value_length(batch).to_pylist()]]).tolist()
            yield pa.array([decode_ids(values[a:b], shown) for a, b in zip(ends, ends[1:])], pa.string())

    return decoded(ids)
