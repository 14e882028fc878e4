"""A training corpus from documents: five stages, each over all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet and reads them
again for the next, and deletes the ones before the last. All stages but the last return the columns of documents, and none
reads other columns.

Contract of the cases: a null text counts as empty, and an empty text is judged by the classifier like any other; what it
keeps has no words, so it is one text for exact dedup, has no near-duplicates, takes no part in the mix and ends there. Any
other column may be null. Rows that share a doc_id, null ids among them, are told apart by their texts: a row goes only if
its own text stands in another row that stays, and of repeated rows one stays. A null source is a source; ties go to the
smallest doc_id. Texts of any length are read whole. Empty tables give empty tables; without labels the classifier scores
0.5 and rejects everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import bpe, curriculum, exact, near, quality
from quizloom.llm.queries import word_tokenizer
from quizloom.session import delete_path, read_table, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents among docs, does not reject."""
    forest = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, forest, keep=COLUMNS).where(F.col("score") >= quality.GOOD).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts: one with the smallest id."""
    return exact.keepers(docs, COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: one with the smallest id."""
    return near.keepers(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in the order of the curriculum's positions."""
    return curriculum.sequence(docs, COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in tokens: doc_id, n_tokens and the digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, word_tokenizer())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: The classifier's trees cannot be stated in SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    place = scratch_path(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            delete_path(spark, f"{place}/{k - 1}")
    return docs
