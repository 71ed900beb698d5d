"""The operators of this folder as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations, exact, languages, licences, lines, mixing, passages, pii, ranking, simhash,
    templates, tokens, warc,
)
from .common import staged, table

WORD_BPE = "word_bpe_49k.json"


def word_bpe(path: str | None = None) -> str:
    """The text of a tokenizer's file; the public word BPE by default."""
    with open(path or public_tokenizers.path(WORD_BPE), encoding="utf-8") as file:
        return file.read()


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs)).select(
        "doc_id", F.concat_ws(",", "families").alias("families"),
        "n_paragraphs", "n_licence", "n_unknown", "confidence",
    )


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.length("cleaned").cast("long").alias("cleaned_chars"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"), word_bpe())


def digested(docs: DataFrame, description: str) -> DataFrame:
    """Digests of the ids of each document, and of what these ids decode to."""
    # Written: in one stage each task would hold two Python workers, each with a tokenizer.
    encoded = staged(tokens.encode_documents(docs, description), "token-ids")
    return tokens.decode_documents(encoded, description).select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    # Rows of one document have one place in the stream; only such without words share it.
    own = ["doc_id", "source", "size", "source_size", "target", "start"]
    each = mixed.groupBy(*own).agg(
        F.sum("words").alias("taken"), F.count_if(F.coalesce("pass", F.lit(0)) == 0).alias("n")
    )
    copies = each.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def told(spans: Column, kind: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    number = {k: F.lit(i) for i, k in enumerate(pii.KINDS)}
    base = F.concat(*(told(F.col(k), number[k]) for k in pii.KINDS))
    added = F.transform(
        "added",
        lambda s: F.struct(
            (F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]) - 1).cast("int").alias("kind"),
            s["start"].alias("start"), s["end"].alias("end"),
        ),
    )

    def joined(spans: Column) -> Column:
        names = F.array(*map(F.lit, pii.KINDS))
        texts = F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        )
        return F.array_join(texts, ",")

    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, added)).alias("spans"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = languages.prototypes(docs.where(~languages.held_out(F.col("doc_id"))))
    told = languages.identify(docs, learned)
    return told.select(
        "doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = templates.drop_recurring_lines(docs)
    return cleaned.select(
        "doc_id", "n_dropped", F.length("text").cast("long").alias("cleaned_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("cleaned_sha256"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations: faults, the cheapest repair, and what it leaves."""
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_conversations(rows)


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes which an earlier document has."""
    found = passages.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    index = ranking.build_index(table(spark, sf_dir, "documents"))
    return ranking.search(index, table(spark, sf_dir, "benchmark"), top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_exact_dedup, op3_simhash, op4_licences, op5_line_quality, op6_bpe,
        op7_mixing, op8_pii, op9_language, op10_line_templates, op11_conversations,
        op12_passages, op13_ranking,
    )
}
