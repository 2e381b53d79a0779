"""Language identification by a byte convolutional network.

The network embeds bytes, applies filters of several widths, takes the maximum over the window, and ends in a softmax.
It is trained in numpy on a bounded sample of labelled texts and applied to every window of every text: a text is cut
into windows of a fixed number of bytes, the last one padded, and its windows vote by their log probabilities.

At prediction a filter's response is a sum over pairs of bytes, so it is read from tables over all byte pairs instead
of multiplied out; the responses are the same.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Without any labelled row no language is
known and every text is ``und``. Equal texts get equal answers. Columns of the result's names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import add_struct, give_back, hash_share, held_out, utf8

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
WINDOW = 192
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class ByteNetwork:
    """Byte embedding, filters per width, and an output layer."""

    labels: list[str]
    dim: int = 12
    filters: int = 24
    seed: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            random = np.random.default_rng(self.seed)
            self.weights["embed"] = random.normal(0, 0.3, (256, self.dim)).astype(np.float32)
            for width in WIDTHS:
                scale = 1 / np.sqrt(width * self.dim)
                size = (width * self.dim, self.filters)
                self.weights[f"w{width}"] = random.normal(0, scale, size).astype(np.float32)
                self.weights[f"b{width}"] = np.zeros(self.filters, np.float32)
            size = (len(WIDTHS) * self.filters, len(self.labels))
            self.weights["out"] = random.normal(0, 0.1, size).astype(np.float32)
            self.weights["bias"] = np.zeros(len(self.labels), np.float32)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy over a batch of windows."""
        w, rows = self.weights, np.arange(len(windows))
        embedded = w["embed"][windows]
        pooled, places, slices = [], [], []
        for width in WIDTHS:
            spans = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1)
            spans = spans.transpose(0, 1, 3, 2).reshape(len(windows), -1, width * self.dim)
            responses = spans @ w[f"w{width}"]
            place = responses.argmax(1)
            pooled.append(np.take_along_axis(responses, place[:, None], 1)[:, 0] + w[f"b{width}"])
            places.append(place)
            slices.append(spans[rows[:, None], place])
        hidden = np.concatenate(pooled, 1)
        active = np.maximum(hidden, 0)
        error = softmax(active @ w["out"] + w["bias"])
        error[rows, labels] -= 1
        error /= len(windows)
        found = {"out": active.T @ error, "bias": error.sum(0), "embed": np.zeros_like(w["embed"])}
        back = (error @ w["out"].T) * (hidden > 0)
        for number, width in enumerate(WIDTHS):
            part = back[:, number * self.filters:(number + 1) * self.filters]
            found[f"w{width}"] = np.einsum("bfk,bf->kf", slices[number], part)
            found[f"b{width}"] = part.sum(0)
            to_bytes = part[:, :, None] * w[f"w{width}"].T[None]
            reached = windows[rows[:, None, None], places[number][:, :, None] + np.arange(width)]
            np.add.at(found["embed"], reached.reshape(-1), to_bytes.reshape(-1, self.dim))
        return found

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.004) -> None:
        """Adam over shuffled batches. Windows are cut to random lengths, so that short texts are learned as well."""
        random = np.random.default_rng(self.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(windows))
            for start in range(0, len(order), batch):
                chosen = order[start:start + batch]
                cut = windows[chosen].copy()
                lengths = np.where(random.random(len(cut)) < 0.5, WINDOW, random.integers(8, WINDOW, len(cut)))
                cut[np.arange(WINDOW) >= lengths[:, None]] = 0
                step += 1
                for name, gradient in self.gradients(cut, labels[chosen]).items():
                    first[name] = 0.9 * first[name] + 0.1 * gradient
                    second[name] = 0.999 * second[name] + 0.001 * gradient * gradient
                    change = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] -= (rate * change).astype(np.float32)

    def tables(self) -> dict[str, np.ndarray]:
        """Responses by byte pair: ``first`` for the leading pair of all widths, ``third`` and ``last`` for the rest."""
        w, part = self.weights, {}
        for width in WIDTHS:
            kernel = w[f"w{width}"].reshape(width, self.dim, self.filters)
            part[width] = [w["embed"] @ kernel[offset] for offset in range(width)]

        def pairs(a, b):
            return (a[:, None] + b[None]).reshape(65536, self.filters)

        first = np.concatenate([pairs(part[width][0], part[width][1]) + w[f"b{width}"] for width in WIDTHS], 1)
        return {"first": first.astype(np.float32), "third": part[3][2].astype(np.float32),
                "last": pairs(part[4][2], part[4][3]).astype(np.float32), "out": w["out"], "bias": w["bias"]}


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(1, keepdims=True))
    return shifted / shifted.sum(1, keepdims=True)


def window_scores(tables: dict[str, np.ndarray], windows: np.ndarray, block: int = 64) -> np.ndarray:
    """Log probabilities of every window."""
    n = tables["third"].shape[1]
    found = []
    for start in range(0, len(windows), block):
        data = windows[start:start + block].astype(np.int32)
        pairs = data[:, :-1] * 256 + data[:, 1:]
        lead = tables["first"][pairs]
        two = lead[:, :, :n].max(1)
        three = (lead[:, :-1, n:2 * n] + tables["third"][data[:, 2:]]).max(1)
        four = (lead[:, :-2, 2 * n:] + tables["last"][pairs[:, 2:]]).max(1)
        active = np.maximum(np.concatenate([two, three, four], 1), 0)
        scores = active @ tables["out"] + tables["bias"]
        shifted = scores - scores.max(1, keepdims=True)
        found.append(shifted - np.log(np.exp(shifted).sum(1, keepdims=True)))
    return np.concatenate(found)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, zero-padded, and the number of windows of each text."""
    counts = np.array([-(-len(text) // WINDOW) for text in texts], np.int64)
    padded = b"".join(text.ljust(count * WINDOW, b"\0") for text, count in zip(texts, counts.tolist()))
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), counts


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def training_sample(docs: DataFrame, bound: int, doc_id: str, text: str, lang: str) -> tuple[list[bytes], list[str]]:
    """One snippet of about ``bound`` labelled texts, the same number for each language, from places set by the id."""
    labelled = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {row[0]: row[1] for row in labelled.groupBy(lang).agg(F.count("*")).collect()}
    if not counts:
        return [], []
    chosen = F.lit(False)
    for value, count in sorted(counts.items()):
        share = bound / len(counts) / count
        chosen = chosen | ((F.col(lang) == F.lit(value)) & hash_share(F.col(doc_id), 17, share))
    start = F.pmod(F.xxhash64(F.col(doc_id), F.lit(3)), F.greatest(F.length(text) - 2 * WINDOW, F.lit(1))) + 1
    rows = (
        labelled.filter(chosen)
        .select(F.substring(F.col(text), start.cast("int"), F.lit(2 * WINDOW)).alias("snippet"), F.col(lang).alias("lang"))
        .collect()
    )
    rows = sorted((row["lang"], row["snippet"].encode("utf-8", "surrogatepass").lower()) for row in rows)
    rows = [row for row in rows if row[1]]
    return [row[1] for row in rows], [row[0] for row in rows]


def train(docs: DataFrame, max_labelled: int = 4_000, epochs: int = 8, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> ByteNetwork | None:
    """A network learned from about ``max_labelled`` rows that are not held out; None without labelled rows."""
    snippets, names = training_sample(docs, max_labelled, doc_id, text, lang)
    if not snippets:
        return None
    labels = sorted(set(names))
    windows, counts = cut_windows(snippets)
    targets = np.repeat([labels.index(name) for name in names], counts)
    network = ByteNetwork(labels)
    network.fit(windows, targets, epochs)
    return network


def predict(text: Column | str, network: ByteNetwork | None) -> Column:
    """A struct of ``lang_pred`` and ``score`` for every whole text."""
    if network is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    labels, tables = network.labels, network.tables()

    @F.arrow_udf("lang_pred string, score double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names: list[str] = [UNKNOWN] * len(batch)
            scores = np.zeros(len(batch))
            texts = utf8(batch)
            known = [number for number, value in enumerate(texts) if value and has_letter(value)]
            if known:
                windows, counts = cut_windows([texts[number].lower() for number in known])
                sizes = np.full(len(windows), float(WINDOW))
                ends = np.cumsum(counts)
                lengths = np.array([len(texts[number]) for number in known])
                sizes[ends - 1] = lengths - (counts - 1) * WINDOW
                weighted = window_scores(tables, windows) * sizes[:, None]
                means = np.add.reduceat(weighted, ends - counts, axis=0) / lengths[:, None]
                chances = softmax(means)
                for number, best in zip(known, chances.argmax(1).tolist()):
                    names[number] = labels[best]
                scores[known] = chances.max(1)
            yield pa.StructArray.from_arrays([pa.array(names), pa.array(scores)], ["lang_pred", "score"])
            give_back()

    return scored(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, network: ByteNetwork | None, text: str = "text") -> DataFrame:
    """All rows and columns with ``lang_pred`` and ``score`` appended."""
    return add_struct(docs, predict(text, network), ["lang_pred", "score"])
