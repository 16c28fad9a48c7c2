"""A training corpus from raw documents: languages, near-duplicates, repeated passages, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a
DataFrame; all but the last return the columns of documents. `run` writes each stage's result as
Parquet to the shared scratch folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions.session import removed, scratch_job
from perfloom.llm import language, minhash, mixing, packing, suffixes
from perfloom.llm.queries import WORDS, vocabulary
from perfloom.llm.storage import free_names, written

#: Least share of a text's n-grams that its language must know; prose has over 0.9, noise next to none.
LEAST_SCORE = 0.2
SEED = 0
#: A passage of so many words that occurs elsewhere is cut out; so many one-letter words and blanks fill a window.
PASSAGE_WORDS = 51
PASSAGE_WINDOW = 100
#: Scripts written without blanks: each character counts as a word.
UNSPACED = "".join(rf"\p{{{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
WORD = rf"[{UNSPACED}]|[^\s{UNSPACED}]+"


#: Folder of the tables that the stage before wrote on its way to its result.
_BEFORE: dict[str, str] = {}


def stage(function):
    """A stage whose own tables are removed when the next one begins; by then its result has been written and reread.

    Texts go to Python workers in small batches: what a worker holds at once is bounded by rows and bytes.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        job = spark.sparkContext.applicationId
        before = _BEFORE.pop(job, None)
        if before and not any(before.rpartition("/")[2] in f for f in docs.inputFiles()):
            removed(spark, before)
        with scratch_job(spark) as _BEFORE[job]:
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of no known language; a missing lang is filled in."""
    (name,) = free_names(docs, "_language")
    found = F.col(name)
    known = language.identified(docs, F.col("lang").isNotNull(), name).filter((found["lang"] != language.UNKNOWN) & (found["score"] >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", found["lang"])).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.survivors(docs, 75)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that occur elsewhere are cut out; documents of nothing else go.

    Candidates are ranges of repeated 100-byte windows, from the suffix order of all texts; in them, passages of 51 words
    are counted, so that ranges which only join shorter repeats stay.
    """
    cut = suffixes.repeated_passages(written(suffixes.repeated_spans(docs, PASSAGE_WINDOW)), PASSAGE_WORDS, WORD)
    text = F.col("row.text").cast("string")
    left = F.make_valid_utf8(suffixes.kept_bytes(text, F.col("spans")).cast("string"))
    some = F.size("spans") > 0
    kept = cut.withColumn("left", F.when(some, left)).filter(~some | (F.length(F.trim("left")) > 0))
    own = {"text": F.when(some, F.col("left")).otherwise(text), "n_chars": F.when(some, F.length("left").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[(own[c] if c in own else F.col("row")[c]).alias(c) for c in docs.columns])


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; documents taken twice or more are repeated rows."""
    return mixing.mix(docs, SEED, *free_names(docs, "_shard", "_place")).select(*docs.columns)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as packed sequences of token ids, a row per piece."""
    return packing.pack(docs, vocabulary(WORDS), end=2)


STAGES = [
    ("language_id", languages), ("minhash_dedup", near_duplicates), ("suffix_dedup", repeated_passages),
    ("mixing", mixture), ("packing", sequences),
]
ORACLE_SQL = None  # trained filters, MinHash groups and tokenizers cannot be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = written(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
