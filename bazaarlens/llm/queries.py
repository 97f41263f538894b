"""The registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import (
    bpe,
    chat,
    decontamination,
    html_pages,
    infill,
    language,
    ngram_join,
    quality,
    relative_parse,
    secrets,
    sharding,
    spotsigs,
    whitening,
)
from bazaarlens.llm.common import fold, in_fold, read_table

SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to one of eight equal shards, and to one of nine."""
    documents = read_table(spark, sf_dir, "documents")
    return sharding.assign_shards(documents, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1), "text")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three folds."""
    documents = read_table(spark, sf_dir, "documents")
    learn_from = fold("doc_id", 3) != 1
    found = language.identify_languages(documents, "doc_id", "text", "lang", learn_from)
    return found.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text, and how alike they are."""
    linked = spotsigs.edited_by_next(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    both = spotsigs.with_signatures(linked, "edited", "edited_found")
    return both.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text(F.col("found")).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_found")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        spotsigs.likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of every document by five-word shingles."""
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four of five folds of the labels."""
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learn_from = fold("doc_id", 5) != 0
    rated = quality.rate_quality(documents, "doc_id", "text", labels, "doc_id", "quality", learn_from)
    return rated.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_texts(read_table(spark, sf_dir, "documents"), "doc_id", "text", path)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of the benchmark, with the item."""
    documents, tests = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontamination.find_leaks(documents, "doc_id", "text", tests, "item_id", "text")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_pages.extract_text(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation in canonical form."""
    return chat.format_chats(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the eight leading components."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, as digests."""
    made = infill.fill_in_middle(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    text = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"),
    )


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that earlier ones have, as digests."""
    kept = relative_parse.drop_repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language": op2_language,
    "op3_spotsigs": op3_spotsigs,
    "op4_secrets": op4_secrets,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_html": op9_html,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_infill": op12_infill,
    "op13_repeats": op13_repeats,
}
