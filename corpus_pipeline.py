"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all documents that its
predecessor kept; every stage but the last returns the columns of ``documents``. ``run`` keeps each
stage's result as a table in the shared folder, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm import byte_bpe, decontaminate, quality, simhash, suffix_dedup
from strataquery.llm.common import stash, stashes, sweep, table

#: Bytes from which a passage that repeats is removed: about fifty words.
PASSAGE_BYTES = 256


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.where("quality_pred = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start anywhere else too; n_chars follows the text."""
    out = suffix_dedup.dedup(docs, length=PASSAGE_BYTES, outputs=("n_removed", "kept_text"))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens and the digest of what the ids decode to."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("token_ids", "n_tokens", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

#: No SQL: the classifier is trained, and the passages' and tokens' stages aren't SQL's.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), stashes()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{name.replace(' ', '-')}")
            # what the stage has kept for itself, and the stage's input, aren't needed any more
            sweep(spark, before | {docs._stash_path})
    return docs
