"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. run() applies them in order, each stage's result written to
the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, pieces, quality, set_join, suffix_dedup
from tidelog.llm.common import nested, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, learned from all of the corpus's labels, scores 0.3 or more."""
    machine = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, machine).where("_score >= 0.3").select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five words, 0.8) the document of smallest id.

    Rows of one id and equal texts are copies: one stays. Rows without an id are linked with nothing and stay.
    """
    return set_join.representatives(docs, 5, (80, 100))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what stands in an earlier place; a character cut in part goes whole. n_chars follows the text."""
    found = suffix_dedup.cut_rows(docs, whole=True)
    kept = F.col("_kept").cast("string")
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    own["text"] = F.when(F.col("_removed") == 0, own["text"]).otherwise(kept)
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_removed") == 0, own["n_chars"]).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return found.select(*[column.alias(name) for name, column in own.items()])


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, within its edit budget; rows that only share an id with them stay."""
    sha = F.sha2("text", 256)
    found = decontaminate.contamination(docs.select("doc_id", "text", sha.alias("_sha")), table(spark, sf_dir, "benchmark"), "_sha")
    leaks = found.select(F.col("doc_id").alias("_leak"), F.col("_sha").alias("_leak_sha")).distinct()
    own = docs.select(nested(docs), F.col("doc_id").cast("long").alias("_id"), sha.alias("_sha"))
    return own.join(leaks, F.col("_id").eqNullSafe(F.col("_leak")) & (F.col("_sha") == F.col("_leak_sha")), "left_anti").select("_row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of what is left."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", unleaked),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The stages learn, align and segment: SQL can't express them. Each is tested against a version of its own in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
