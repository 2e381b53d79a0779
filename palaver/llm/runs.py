"""Periodic runs of words: stretches that repeat a short sequence of words over and over, and texts without the repeats.

A run is a stretch of words of smallest period q (words q apart are equal) that no neighbouring word extends, of at
least ``LEAST_WORDS`` words and ``LEAST_EXPONENT`` periods. Every word of such a run occurs in it that many times as it
has whole periods. So a word that occurs more rarely in a segment of the text lies in no run of that segment and splits
it; a split makes other words rare, until nothing changes. Each split counts anew only the smaller pieces and takes them
off the counts of the largest, so a text of n words costs n log n however deep the splits go. What survives is scanned
lag by lag. For long lags only every sixteenth part of the lag is looked at: a run leaves three lags of equal pairs in a
row, so none of those looked at may differ; where none does, the pairs are compared one by one.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text. Rows that repeat are each done on
their own. Other columns pass through; ``runs`` and ``collapsed`` replace columns of those names. A text is one task's
work: memory and time follow its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import SPACES, add_struct, utf8

LEAST_WORDS = 6
LEAST_EXPONENT = 4
LOOKS = 16


def coded(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence among different words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(word, len(known)) for word in words), np.int64, len(words))


def surviving(codes: np.ndarray, least_words: int, least_exponent: int) -> list[tuple[int, int]]:
    """The segments (start, end) whose every word occurs in them often enough to lie in a run."""
    found, waiting = [], [(0, len(codes))]
    while waiting:
        base, end = waiting.pop()
        if end - base < least_words:
            continue
        _, local, counts = np.unique(codes[base:end], return_inverse=True, return_counts=True)
        low, high, places, starts = 0, end - base, None, None
        cuts = np.flatnonzero(counts[local] < least_exponent)
        while len(cuts):
            bounds = np.concatenate([[low - 1], cuts, [high]])
            pieces = np.diff(bounds) - 1
            largest = int(pieces.argmax())
            for piece in np.flatnonzero(pieces >= least_words):
                if piece != largest:
                    waiting.append((base + int(bounds[piece]) + 1, base + int(bounds[piece + 1])))
            before, after = int(bounds[largest]) + 1, int(bounds[largest + 1])
            gone, times = np.unique(np.concatenate([local[low:before], local[after:high]]), return_counts=True)
            counts[gone] -= times
            low, high = before, after
            if high - low < least_words:
                break
            rare = gone[(counts[gone] > 0) & (counts[gone] < least_exponent)]
            if not len(rare):
                break
            if places is None:
                places = np.argsort(local, kind="stable")
                starts = np.searchsorted(local[places], np.arange(len(counts) + 1))
            cuts = np.concatenate([places[starts[word]:starts[word + 1]] for word in rare])
            cuts = np.sort(cuts[(cuts >= low) & (cuts < high)])
        if high - low >= least_words:
            found.append((base + low, base + high))
    return found


def stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of at least ``least`` true values in a row."""
    if not equal.any():
        return
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    for at in np.flatnonzero(ends - starts >= least):
        yield int(starts[at]), int(ends[at])


def lag_scan(codes: np.ndarray, least_words: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in one segment, by start and period."""
    found: dict[tuple[int, int], int] = {}
    # Of each word the longest run so far: its start, end and period.
    start_of, end_of, period_of = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)
    for lag in range(1, len(codes) // least_exponent + 1):
        least = max(least_words, least_exponent * lag) - lag
        step = max(1, lag // LOOKS)
        looks = codes[:len(codes) - lag:step] == codes[lag::step]
        for first, last in stretches(looks, least // step):
            middle = (first + last) // 2 * step
            if lag % period_of[middle] == 0 and start_of[middle] <= first * step and (last - 1) * step + lag < end_of[middle]:
                continue  # a run of a period that divides the lag ends where that of the lag does
            # The pairs between two looks, and those up to the looks that differ, one by one.
            low, high = max(0, (first - 1) * step + 1), min(len(codes) - lag, last * step)
            pairs = codes[low:high] == codes[low + lag:high + lag]
            for start, end in stretches(pairs, least):
                start, end = low + start, low + end + lag
                # A stretch of a smaller period has been found as the same stretch.
                if (start, end) not in found:
                    found[start, end] = lag
                    longer = start + np.flatnonzero((end_of - start_of)[start:end] < end - start)
                    start_of[longer], end_of[longer], period_of[longer] = start, end, lag
    return sorted((start, end - start, lag) for (start, end), lag in found.items())


def word_runs(codes: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period."""
    return sorted((low + start, length, period)
                  for low, high in surviving(codes, least_words, least_exponent)
                  for start, length, period in lag_scan(codes[low:high], least_words, least_exponent))


def without_repeats(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change)[:-1] == 0
    return [word for word, stays in zip(words, kept.tolist()) if stays]


def runs_of(text: Column, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> Column:
    """A struct of a text's runs and of the text without their repeats, its words joined by one space."""
    if least_words < 1 or least_exponent < 2:
        raise ValueError("a run has at least one word and two periods")

    @F.arrow_udf("runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, ends, collapsed = [], [0], []
            for value in utf8(batch):
                words = value.split() if value else []
                found = word_runs(coded(words), least_words, least_exponent) if len(words) >= least_words else []
                flat += found
                ends.append(len(flat))
                collapsed.append(b" ".join(without_repeats(words, found) if found else words))
            numbers = np.array(flat, np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(numbers[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
            texts = pa.array(collapsed, pa.binary()).view(pa.string())
            yield pa.StructArray.from_arrays([lists, texts], ["runs", "collapsed"])

    return scanned(text)


def find_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS,
              least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """The rows with their ``runs`` (start, length, period; in words) and their ``collapsed`` text."""
    return add_struct(docs, runs_of(F.col(f"`{text}`"), least_words, least_exponent), ["runs", "collapsed"])


def longest(runs: Column) -> Column:
    """The longest run of a list, of equally long ones that of smallest start, then period; null for none."""
    order = F.transform(runs, lambda run: F.struct((-run["length"]).alias("_shorter"), run["start"].alias("start"),
                                                   run["length"].alias("length"), run["period"].alias("period")))
    return F.array_min(order)


def with_periodic_tail(text: Column, number: Column) -> Column:
    """The text, its words joined by one space, with a tail that repeats some of its words; ``number`` says from which
    word on, how many words, and so how often. A text without words is as it was."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
    n = F.size(words)
    at = F.pmod(number, n.cast("long")).cast("int")
    period = (F.lit(1) + F.floor((n - at) / (F.lit(3) + F.pmod(number, F.lit(8))))).cast("int")
    times = F.ceil((n - at) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, at + 1, period), times)), F.lit(1), n - at)
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), at), tail), " ")).otherwise(text)
