"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import (
    chat, decontaminate, fingerprints, html_text, language, pieces, private, quality, runs, similar, toxicity,
    warc, whitening,
)
from palaver.llm.common import held_out, table

# The tokenizer's file is the same on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def joined(values, between=","):
    return F.array_join(values, between)


@query
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(joined(names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_pieces(spark, sf_dir):
    vocabulary = pieces.Vocabulary.load(MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, vocabulary, read_back=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query
def op5_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = chat.format_conversations(turns.unionByName(added))
    turns_read, loss_read = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    lines = F.transform(turns_read, lambda one: F.concat(one["role"], F.lit("\n"), one["text"], F.lit("\n")))
    loss = F.array_join(loss_read, "")
    return done.select(
        "conv_id", F.size(turns_read).cast("long").alias("n_turns"), F.sha2(joined(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, table(spark, sf_dir, "labels")).drop("text")


@query
def op2_private(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private.find_private(docs)
    spans = F.col("spans")
    counts = [F.size(private.of_kinds(spans, kind)).cast("long").alias(f"n_{kind}") for kind in private.KINDS]
    return found.select("doc_id", *counts,
                        F.sha2(private.shown(private.of_kinds(spans, *private.KINDS)), 256).alias("base_sha256"),
                        private.shown(spans).alias("spans"))


@query
def op8_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return warc.archive(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("segments").cast("long").alias("n_passages"))


@query
def op1_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_pages(pages).drop("html")


@query
def op3_similar(spark, sf_dir):
    return similar.similar_links(table(spark, sf_dir, "documents"))


@query
def op13_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(F.pmod(number, F.lit(10)) == 0, runs.with_periodic_tail(F.col("text"), F.floor(number / 10)))
    found = runs.find_runs(docs.withColumn("text", F.coalesce(chosen, "text")))
    best = runs.longest(F.col("runs"))
    lines = F.transform("runs", lambda run: F.concat(
        run["start"].cast("string"), F.lit(","), run["length"].cast("string"), F.lit(","), run["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(joined(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_fingerprints(spark, sf_dir):
    return fingerprints.near_components(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark, sf_dir):
    """A deviation that no long can hold is null."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    rows = found.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error",
                        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "one"))
    return rows.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation",
                       F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"), "identity_error")
