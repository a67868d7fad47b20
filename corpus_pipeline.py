"""Corpus pipeline: documents to token shards in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return the
columns of documents; the last writes the shards and returns what it reads back.
Null, empty and repeated rows are treated as each operator's module states; a
document that the mix takes more than once stands in its output that often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import common, decontaminate, mixing, ngram_join, quality, tokenout


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(common.Scratch(spark, "p-quality"), docs, common.table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_of_each(common.Scratch(spark, "p-ngram-join"), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(common.Scratch(spark, "p-decontaminate"), docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(common.Scratch(spark, "p-mixing"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokenout.encode_to_files(spark, docs)


STAGES = [
    ("quality", good_quality),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: The classifier's fit can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
