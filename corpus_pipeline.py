"""From raw documents to token ids: the stages of a training-corpus run.

Each stage works on all that the one before it kept, as a table written and read again. All but the last return
the columns of ``documents``; the mixing stage repeats a row for every copy.

Defined cases, for all stages: a null text counts as empty. It has no language and goes in the first; rows without an
identifier or source go on like others (for sizes, null sources are one source). Rows that repeat an identifier are
one document to near deduplication and mixing. Ties go to the least identifier. An empty table passes through. Columns
that the input has beside those of ``documents`` are carried to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banstream.llm.byte_bpe import encode_documents
from banstream.llm.exact_dedup import drop_exact_copies
from banstream.llm.language_id import held_out, keep_identified, train
from banstream.llm.mixing import mix_sources
from banstream.llm.near_dedup import near_duplicates
from banstream.llm.shared import materialize, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or a score under 0.5) go."""
    return keep_identified(docs, train(docs.where(~held_out("doc_id"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ at most in the case of A-Z the document with the least identifier stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on runs of five words the one with the least identifier stays."""
    gone = near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows that share an identifier are taken equally often."""
    taken = mix_sources(docs).groupBy(F.col("doc_id").alias("_taken")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    # rows travel as one column each, so that none of their names can meet those of the mix
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = rows.join(taken, F.col("_id").eqNullSafe(F.col("_taken")))
    return joined.select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row")).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the checksums of ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs, path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL can't express the classifier, the signatures or the tokenizer; tests/llm/test_pipeline.py follows the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
