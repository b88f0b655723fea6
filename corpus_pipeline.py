"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before kept, and returns a DataFrame;
``run`` writes it as Parquet in the shared folder and rereads it as the next stage's documents. All stages but the
last return the columns of ``documents``. Tables that a stage writes for itself last until the next stage begins.

Null texts: language ID passes what has no letters, the quality rules drop it. Rows without an id pass near
deduplication unjudged. An empty table passes all stages. Columns beyond those of ``documents`` pass all but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common, jaccard, langid, packing, quality, secrets, tokens

#: Near copies share four fifths of their five-word shingles.
SHINGLE_WORDS = 5
SIMILARITY = (4, 5)

#: What the last stage wrote for itself.
_left: set[str] = set()


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that removes what the one before wrote for itself: its rows have been written and reread by then."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bound_batches(spark)
        common.release_paths(_left)
        before = common.settled()
        rows = function(spark, docs, sf_dir)
        _left.clear()
        _left.update(common.settled() - before)
        return rows

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject."""
    model = langid.fit(docs.select("doc_id", "lang", "text"))
    return common.unpacked(langid.identify(common.packed(docs), model).where("not langid_rejected"), docs)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are more likely bad than good."""
    return quality.keep(docs)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies."""
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; ``n_chars`` follows the new text."""
    rows = common.settle(secrets.scan(common.packed(docs)), "scanned")  # texts are scanned once
    text = secrets.redacted(F.col("text"), secrets.all_spans(secrets.thresholds(rows)))
    return common.unpacked(rows.withColumn("text", text), docs, n_chars=F.length("text").cast("bigint"))


@_stage
def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokens.public_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("harmonic_packing", harmonic_packing),
]

#: Most stages are not expressible in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch() as keep:  # what a stage wrote for itself goes with it
            done = keep(common.settle(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        common.release(docs)
        docs = done
    return docs
