"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor kept and returns documents with the same columns;
the last one returns token ids. Between stages the documents are stored, so a lost executor costs a
re-read. No statement says what comes out, as tokens and trees are not SQL; ``tests/llm`` compares
every stage, and all of them together, with a plain version.

A row travels as one struct, so further columns may have any names. Null and empty texts are texts
without words: they are scored, hold no leak and no secret, and have no tokens. Repeated rows are told
apart only where a stage says so. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import bpe, decontamination, ngram_join, quality, secrets
from bazaarlens.llm.common import fold, map_texts, read_table
from bazaarlens.workspace import materialize

#: Documents with a lower probability of good quality go.
LEAST_QUALITY = 0.3
#: Labelled documents that the classifier learns from, at most.
MOST_LABELLED = 6000
MASK = "[SECRET]"
TOKENIZER = "word_bpe_49k.json"


def _packed(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns, beside ``doc_id`` and ``text``."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(row.alias("row"), "doc_id", "text")


def _unpacked(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from ``row``."""
    return [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are scored as empty.

    Equal rows are kept or dropped alike.
    """
    labels = read_table(spark, sf_dir, "labels")
    learn_from = fold("doc_id", 5) != 0
    forest = spark.sparkContext.broadcast(
        quality.learn(docs, "doc_id", "text", labels, "doc_id", "quality", learn_from, MOST_LABELLED)
    )

    def score(texts: list[str]) -> dict:
        return {"score": quality.probabilities(forest.value, texts)}

    scored = map_texts(_packed(docs), ["row"], score, {"score": "double"})
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(*_unpacked(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the row of the smallest id; among rows of that id, or without any, one of them.

    Rows are told apart by a stored key if ids repeat or are missing, so a different text under a
    repeated id stays. Texts without words are copies only under the same id, or without one.
    """
    ids = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        found = ngram_join.near_duplicates(docs, "doc_id", "text")
        dropped = found.filter("component_id <> doc_id").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    keyed = materialize(_packed(docs).withColumn("key", F.monotonically_increasing_id()), "keyed")
    found = ngram_join.near_duplicates(keyed, "key", "text").withColumnRenamed("doc_id", "key")
    rows = keyed.select("key", "doc_id", F.xxhash64("text").alias("digest")).join(found, "key")
    bare = F.col("n_shingles") == 0
    first = rows.groupBy(
        F.when(~bare, F.col("component_id")).alias("component"),
        F.when(bare, F.struct("doc_id", "digest")).alias("copies"),
    ).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    return keyed.join(first.select("first.key"), "key", "left_semi").select(*_unpacked(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Rows are told apart by id and text, so equal rows go together."""
    keyed = _packed(docs).withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    leaks = decontamination.find_leaks(keyed, "key", "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text")
    return keyed.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*_unpacked(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each row by itself, with every secret replaced by a mask and the number of characters brought up to date."""
    found = secrets.find_secrets(_packed(docs).select("row", "text"), "text")
    masked = F.when(F.size("spans") > 0, secrets.masked(F.col("text"), F.col("spans"), MASK))
    changed = found.select(masked.alias("_masked"), *_unpacked(docs))
    length = F.coalesce(F.length("_masked").cast("bigint"), F.col("n_chars"))
    given = {"text": F.coalesce("_masked", "text"), "n_chars": length}
    return changed.withColumns(given).select(*[f"`{c}`" for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256`` of every row; a null text has no ids."""
    path = public_tokenizers.path(TOKENIZER)
    encoded = bpe.encode_texts(docs, "doc_id", "text", path, kept=("lang", "source"), whole=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("tokens", encode_tokens),
]

#: Trees, shingle components and token ids are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
