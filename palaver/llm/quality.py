"""Quality rules in Spark expressions only: base statistics of each text and a hashed n-gram likelihood ratio.

Two multinomials over hashed unigrams and bigrams are counted: one from trusted texts, one from the whole corpus. A
text's score is the mean log-likelihood ratio of its n-grams. Every text is then thresholded, without chance: it is
kept unless its score lies further below the trusted texts' mean than ``tolerance`` of their standard deviations.

The buckets are fixed in number, so the ratios are a constant of bounded size in the plan. The corpus side is counted
over all texts, the trusted side, like the mean and deviation of its scores, over all texts labelled 1. Up to
``max_broadcast`` trusted ids are sent to the tasks, so that no texts are shuffled; more are joined as Spark plans it.

Defined cases: a null text has no words and scores 0; texts that fail a base rule are not kept; without trusted texts
all ratios are 0 and the base rules decide alone. Repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import SPACES, add_struct, fresh, let

BUCKETS = 10_000
MAX_BROADCAST = 2_000_000
TOLERANCE = 6.0
REPEAT_WINDOW = 5
SPACE_CHARACTERS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda word: word != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the same text."""
    count = F.size(words) - (REPEAT_WINDOW - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

    def window(i):
        return F.xxhash64(*[F.get(words, i + (offset - 1)) for offset in range(REPEAT_WINDOW)])

    def repeated_starts(ordered):
        def repeated(pair, at):
            before = (at > 0) & (F.get(ordered, at - 1)["h"] == pair["h"])
            return before | F.coalesce(F.get(ordered, at + 1)["h"] == pair["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, repeated), lambda pair: pair["i"]))

    def covered(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), (at + 1).alias("i"))))
        return F.aggregate(
            let(ordered, repeated_starts), F.struct(F.lit(-REPEAT_WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda done, i: F.struct(i.alias("last"),
                                     (done["sum"] + F.least(i - done["last"], F.lit(REPEAT_WINDOW))).alias("sum")),
            lambda done: done["sum"])

    def unless_distinct(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    return let(F.transform(starts, window), unless_distinct)


def base_statistics(text: Column, words: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(whole, SPACE_CHARACTERS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def buckets_of(words: Column, buckets: int) -> Column:
    """Hashed unigrams and bigrams in order."""
    def hashed(*parts):
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    single = F.transform(words, lambda word: hashed(word))
    pairs = F.transform(words, lambda word, at: hashed(word, F.get(words, at + 1)))
    # ``words`` must be a plain column here: the lambdas refer to it for each element.
    return F.concat(single, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, max_broadcast: int, doc_id: str, quality: str) -> DataFrame:
    """All ids labelled 1, once each, to be broadcast if there are up to ``max_broadcast``."""
    good = labels.filter((F.col(quality) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("trusted_id")).distinct()
    return F.broadcast(good) if good.count() <= max_broadcast else good


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int, doc_id: str, text: str) -> list[float]:
    """The log ratio of each bucket, trusted over raw, with one added to every count."""
    flagged = docs.select(doc_id, text).join(trusted, F.col(doc_id) == F.col("trusted_id"), "left")
    split = flagged.select(words_of(F.col(text)).alias("words"), F.col("trusted_id").isNotNull().cast("long").alias("trusted"))
    grams = split.select(F.explode(buckets_of(F.col("words"), buckets)).alias("bucket"), "trusted")
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    raw, target = [1.0] * buckets, [1.0] * buckets
    for row in rows:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["trusted"]
    if sum(target) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(math.log(a) - math.log(b) + shift, 6) for a, b in zip(target, raw)]


def ratio_score(words: Column, table: list[float]) -> Column:
    """Mean ratio of a text's n-grams."""
    constant = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    grams = buckets_of(words, len(table))
    total = let(constant, lambda ratio: F.aggregate(grams, F.lit(0.0), lambda sum, bucket: sum + F.get(ratio, bucket)))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_broadcast: int = MAX_BROADCAST,
                  tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text",
                  quality: str = "quality") -> DataFrame:
    """All rows and columns with the base statistics, ``score``, ``base_failed`` and ``kept`` appended."""
    trusted = trusted_ids(labels, max_broadcast, doc_id, quality)
    table = ratios(docs, trusted, buckets, doc_id, text)
    split = fresh(docs.columns, "_words")
    words = F.col(split)
    good = docs.join(trusted, F.col(doc_id) == F.col("trusted_id"), "left_semi").withColumn(split, words_of(F.col(text)))
    middle = good.select(ratio_score(words, table).alias("s")).agg(F.avg("s"), F.stddev_pop("s")).first()
    threshold = (middle[0] or 0.0) - tolerance * max(middle[1] or 0.0, 1e-6)
    statistics = base_statistics(F.col(text), words)
    result = F.struct(*[value.alias(name) for name, value in statistics.items()], ratio_score(words, table).alias("score"))
    found = add_struct(docs.withColumn(split, words_of(F.col(text))), result, [*statistics, "score"]).drop(split)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return add_struct(found, F.struct(failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept")),
                      ["base_failed", "kept"])
