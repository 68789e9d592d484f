"""Registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from ..staging import new_path, stage
from . import bpe, chat, collocations, conversation_trie, fingerprint, line_dedup, minhash, packing, quality_classifier, quality_rules, token_rollup, url_filter
from .exact_dedup import ORACLE as EXACT_DEDUP_SQL
from .exact_dedup import exact_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_exact_dedup", EXACT_DEDUP_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs.select("doc_id", "text"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, vocabulary_path(), keep=["doc_id"])
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages).drop("url")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    measured = stage(quality_rules.measure(docs).drop("text"), "measured")
    cutoffs = quality_rules.certify(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(measured, cutoffs).drop("lang")


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels.filter(quality_classifier.remainder() != 2))
    held_out = (quality_classifier.remainder() == 2).alias("held_out")
    return quality_classifier.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query("op8_chat_prefix_tree")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    tree = chat.build(given.unionByName(extra), vocabulary_path())
    back = chat.read_back(tree, vocabulary_path())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary_path())
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = minhash.near_classes(docs)
    return found.withColumnRenamed("class_key", "class_id")


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = line_dedup.fuzzy_lines(docs)
    return found.withColumnRenamed("keep_key", "keep_doc_id")


@query("op5_token_rollup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional counts of all documents (twice, as after a retry), then the real
    counts as revisions, then deletions of the texts that turned out empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("tokenizer", F.lit("byte_bpe_50k"))
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    guess = F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4)
    loaded = docs.withColumns({"n_tokens": guess, "action": F.lit("insert")}).drop("text")
    rollup.apply(loaded, "load")
    rollup.apply(loaded, "load")
    counted = stage(token_rollup.count_tokens(docs, vocabulary_path()), "counted")
    rollup.apply(counted.withColumn("action", F.lit("revise")), "count")
    rollup.apply(counted.filter("n_tokens = 0").withColumn("action", F.lit("delete")), "drop-empty")
    return rollup.totals()


@query("op13_document_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint.compare_with_next(docs)


@query("op12_conversation_trie")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_trie.build(conversation_trie.rebuilt(conversations))


@query("op11_phrase_collocations", collocations.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
