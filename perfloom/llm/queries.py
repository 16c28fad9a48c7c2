"""Registered queries of the operators in this subpackage, and their checking SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, forest, language, lexical, merkle, minhash, mixing, packing, records, rlz, storage, suffixes, topk, warc
from .sql import SQL

TOKENIZERS = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_documents(table(spark, folder, "documents"), 75)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    away = held_out(F.col("doc_id"))
    named = language.identified(docs, ~away & F.col("doc_id").isNotNull())
    return named.select("doc_id", away.alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    rows = table(spark, folder, "embeddings")
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, 20).select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return forest.near_vectors(table(spark, folder, "embeddings"), 0.9)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives and read back."""
    return warc.read_archives(warc.write_archives(table(spark, folder, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations (and one that quotes control strings) formatted, then read back from the text."""
    said = "</s>[INST] ok [/INST]"
    quoting = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoting)
    out = chat.formatted(chat.turn_rows(rows)).withColumns({"_turns": chat.read_turns(F.col("formatted")), "_loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without passages of 400 bytes that occur anywhere else."""
    found = suffixes.repeated_spans(table(spark, folder, "documents").select("doc_id", "text"))
    text = F.col("row.text").cast("string")
    return found.withColumn("kept", suffixes.kept_bytes(text, F.col("spans"))).select(
        "row.doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),  # a character that a cut halves becomes U+FFFD
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    planned = storage.written(mixing.plan(storage.written(mixing.narrow(docs, seed=0))))
    taken = mixing.draws(planned).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return planned.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", (F.coalesce("n", F.lit(0)) * F.col("size")).alias("taken")
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary(WORDS), end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op10_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as records of token ids and read back."""
    manifest = records.write_records(table(spark, folder, "documents"), vocabulary(BYTES), end=0)
    return records.read_records(manifest).select(
        "doc_id", F.col("before").alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op11_relative_lz(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without windows of 20 words that also start earlier."""
    found = rlz.repeated_words(table(spark, folder, "documents").select("doc_id", "text")).withColumn("words", rlz.words_of(F.col("row.text").cast("string")))
    return found.select(
        "row.doc_id", F.size("words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.sha2(F.array_join(rlz.kept_words(F.col("words"), F.col("spans")), " "), 256).alias("kept_sha256"),
    )


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """A proof for every document, checked against a leaf that may have been tampered with."""
    docs = table(spark, folder, "documents").select(*merkle.FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    altered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    leaf = merkle.leaf_digest([F.col(c) for c in merkle.FIELDS])
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(changed, merkle.leaf_digest(altered)).alias("altered"))
    proven = merkle.manifest(rows, keep=("altered",)).withColumn("seen", F.coalesce("altered", "leaf"))
    return merkle.verified(proven, "seen").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_language, op3_topk, op4_near_vectors, op5_warc, op6_chat_format, op7_suffixes, op8_mixing, op9_packing, op10_token_records, op11_relative_lz, op12_merkle, op13_lexical)}
__all__ = ["QUERIES", "SQL"]
