"""Toxic passages as maximum-scoring segments, with extreme-value calibration.

A word's score is the log-odds of toxic over other labelled texts under an informative Dirichlet prior, taken from the
most telling of its units: the whole word and its beginnings. Scores that could be chance are 0, and every word pays a
cost, so that clean text scores far below zero on average and a segment is a word or words in close company. One scan over a text, linear in its words, finds all of
its maximal segments (the method of Ruzzo and Tompa). How large the largest segment of a clean text gets follows an
extreme-value law whose two parameters are fitted on clean labelled texts that the scores were not learned from. A
segment is significant by its expected number in a clean text of that length. Segments are combined by the
sum statistic of Karlin and Altschul, and a logistic curve over that evidence gives the chance that the label is 1.

Words are hashed into a fixed number of buckets, so the table of scores has a fixed size however many words there are.

Defined cases: null and empty texts have no evidence and get the score of a text without it. Without any labelled
row, or with one label only, every text scores the share of label 1 (0 without rows). Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import add_struct, hash_share, held_out, utf8

MAX_LABELLED = 10_000
BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6, 7)
PRIOR = 500.0
LEAST_Z = 5.0
COST = 2.0
SIGNIFICANT = 0.05
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    data = [word + "$", *[word[:size] for size in BEGINNINGS if size <= len(word)]]
    return [zlib.crc32(unit.encode("utf-8", "surrogatepass")) % BUCKETS for unit in data]


class Scores(dict):
    """Score by word, filled when asked for and emptied when full."""

    def __init__(self, table: np.ndarray, z: np.ndarray):
        super().__init__()
        self.table, self.z = table, z

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        places = units(word)
        best = max(places, key=lambda place: abs(self.z[place]))
        value = self[word] = float(self.table[best]) - COST
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score). Only words of positive score are visited. Each segment knows the
    last one before it whose sum starts lower; those between can never be joined once it stands, so none is passed twice."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []
    for place in np.flatnonzero(scores > 0).tolist():
        first, end, low, high = place, place + 1, float(sums[place]), float(sums[place + 1])
        number = len(found) - 1
        while True:
            while number >= 0 and found[number][2] >= low:
                number = found[number][4]
            if number < 0 or found[number][3] >= high:
                break
            joined, (first, _, low, _, number) = number, found[number]
            del found[joined:]
        found.append((first, end, low, high, number))
    return [(first, end, high - low) for first, end, low, high, _ in found]


@dataclass
class ToxicityModel:
    table: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    z: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    rate: float = 1.0
    scale: float = 1.0
    offset: float = 0.0
    slope: float = 0.0

    def evidence(self, segments: list[tuple[int, int, float]], words: int) -> float:
        """How unlikely the best segments are in a clean text of that length: the largest, over k, of the negative
        logarithm of the chance of k segments as large as the k-th; 0 if none goes beyond what is expected."""
        best = 0.0
        for number, score in enumerate(sorted((score for _, _, score in segments), reverse=True), 1):
            expected = self.scale * words * math.exp(-self.rate * score)
            if expected < number:
                tail = math.log(1 - expected / (number + 1))
                best = max(best, expected - number * math.log(max(expected, 1e-300)) + math.lgamma(number + 1) + tail)
        return best

    def significant(self, segments: list[tuple[int, int, float]], words: int) -> list[tuple[int, int, float]]:
        return [s for s in segments if self.scale * words * math.exp(-self.rate * s[2]) <= SIGNIFICANT]

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -50, 50)))


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict]:
    """(text, toxic, learn) of a sample of the labelled rows that are not held out, and the counts by label.

    ``bound`` is for each label; the ids are few enough by it to be sent to every task."""
    known = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("labelled_id")).agg(F.max(label).cast("int").alias("toxic"))
    )
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    chosen = F.lit(False)
    for value, count in counts.items():
        chosen = chosen | ((F.col("toxic") == value) & hash_share(F.col("labelled_id"), 41, bound / count))
    sample = F.broadcast(known.filter(chosen).withColumn("learn", hash_share(F.col("labelled_id"), 43, 0.7)))
    texts = docs.select(F.col(doc_id).alias("labelled_id"), F.col(text).alias("text"))
    return texts.join(sample, "labelled_id").select("text", "toxic", "learn"), counts


def words_of(value: bytes | None) -> list[str]:
    return WORD.findall(value.decode("utf-8", "replace").lower()) if value else []


def count_units(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit counts by bucket of clean and of toxic texts, added up in every task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for value, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                places: list[int] = []
                for word in words_of(value):
                    if word not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = units(word)
                    places += known[word]
                np.add.at(sums[toxic], np.array(places, np.int64), 1)
        places = np.flatnonzero(sums.any(0))
        for start in range(0, len(places), 10_000):
            part = places[start:start + 10_000]
            yield pa.RecordBatch.from_pydict({"bucket": part.astype(np.int32), "clean": sums[0, part], "toxic": sums[1, part]})

    rows = (
        texts.select("text", "toxic").mapInArrow(count, "bucket int, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    )
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in rows:
        clean[row["bucket"]], toxic[row["bucket"]] = row["clean"], row["toxic"]
    return clean, toxic


def log_odds(clean: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds under a Dirichlet prior in proportion to the pooled counts, cut to what exceeds chance, and z values."""
    pooled = clean + toxic
    prior = PRIOR * (pooled + 0.01) / (pooled + 0.01).sum()
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    deviation = np.sqrt(1 / a + 1 / b)
    z = np.where(pooled > 0, odds / deviation, 0.0)
    sure = np.sign(odds) * np.maximum(np.abs(odds) - deviation, 0)
    kept = np.where(np.abs(z) >= LEAST_Z, sure, 0.0)
    return kept.astype(np.float32), np.where(kept != 0, z, 0.0).astype(np.float32)


def fit_extremes(largest: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Rate and scale of the law of the largest segment in clean texts, by maximum likelihood. A text without any
    segment only says that its largest one is below the smallest seen."""
    seen = largest > 0
    if seen.sum() < 2:
        return 1.0, 1.0 / max(1.0, words.sum())
    value = np.where(seen, largest, largest[seen].min())
    best = None
    for rate in np.geomspace(0.05, 10, 200):
        weights = words * np.exp(-rate * value)
        scale = seen.sum() / weights.sum()
        fit = seen.sum() * math.log(rate * scale) - rate * value[seen].sum() - scale * weights.sum()
        if best is None or fit > best[0]:
            best = fit, float(rate), float(scale)
    return best[1], best[2]


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on the logarithm of the evidence, slightly ridged, by Newton steps."""
    x = np.stack([np.ones(len(evidence)), np.log1p(evidence)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        gradient = x.T @ (weights * (toxic - chance)) - 0.01 * beta
        hessian = (x * (weights * chance * (1 - chance))[:, None]).T @ x + 0.01 * np.eye(2)
        beta += np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(beta[0]), float(max(beta[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id",
          text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Scores from seven tenths of a bounded labelled sample, calibration from the rest."""
    texts, counts = labelled_texts(docs, labels, max_labelled, doc_id, text, label)
    model = ToxicityModel()
    if len(counts) < 2:
        model.offset = 50.0 if 1 in counts else -50.0
        return model
    model.table, model.z = log_odds(*count_units(texts.filter("learn")))
    rows = (
        texts.filter("NOT learn").select("toxic", segments_of(F.col("text"), model).alias("found"))
        .select("toxic", "found.n_words", F.col("found.segments.score").alias("scores")).collect()
    )
    toxic = np.array([row["toxic"] for row in rows], float)
    if len(set(toxic.tolist())) < 2:
        model.offset = math.log(counts[1] / counts[0])
        return model
    words = np.array([max(1, row["n_words"]) for row in rows], float)
    largest = np.array([max(row["scores"], default=0.0) for row in rows])
    model.rate, model.scale = fit_extremes(largest[toxic == 0], words[toxic == 0])
    evidence = np.array([model.evidence([(0, 0, s) for s in row["scores"]], int(n)) for row, n in zip(rows, words)])
    weights = np.where(toxic == 1, counts[1] / toxic.sum(), counts[0] / (1 - toxic).sum())
    model.offset, model.slope = fit_curve(evidence, toxic, weights * len(toxic) / weights.sum())
    return model


def segments_of(text: Column, model: ToxicityModel) -> Column:
    """A struct of the number of words, the evidence, and the significant segments in words; before calibration, all."""
    calibrated = model.slope > 0

    @F.arrow_udf("n_words long, evidence double, segments array<struct<first:long,end:long,score:double>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = Scores(model.table, model.z)
        for batch in batches:
            counts, evidence, kept = [], [], []
            for value in utf8(batch):
                words = words_of(value)
                found = maximal_segments(np.array([scores[word] for word in words])) if words else []
                counts.append(len(words))
                evidence.append(model.evidence(found, len(words)) if found else 0.0)
                kept.append([{"first": first, "end": end, "score": score} for first, end, score in
                             (model.significant(found, len(words)) if calibrated else found)])
            segment = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(evidence, pa.float64()), pa.array(kept, pa.list_(segment))],
                ["n_words", "evidence", "segments"])

    return scanned(text)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All rows and columns with ``n_words``, ``evidence``, ``segments`` (significant passages) and ``score`` appended."""
    found = add_struct(docs, segments_of(F.col(text), model), ["n_words", "evidence", "segments"])
    shape = F.lit(model.offset) + F.lit(model.slope) * F.log1p(F.col("evidence"))
    chance = 1 / (1 + F.exp(-F.greatest(F.least(shape, F.lit(50.0)), F.lit(-50.0))))
    return add_struct(found, F.struct(chance.alias("score")), ["score"])
