"""A corpus pipeline over documents, in stages that call the operators one by one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import near_dups, packing, quality, suffix_dedup, toxicity
from quarry.session import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the measures and their language's perplexity band keep."""
    return quality.assessed(docs).where("kept").select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.7."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("score < 0.7").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, and of rows alike in id and text one."""
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = cut(docs.dropDuplicates(["doc_id", "text"]))
    gone = cut(near_dups.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    maybe, no = suffix_dedup.parted(docs, gone, "doc_id")
    return no.union(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier place also holds."""
    return suffix_dedup.deduplicated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    pieces = cut(packing.tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return packing.pack(pieces, ["doc_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("near-duplicates", near_dedup),
    ("suffix-array dedup", suffix_dedup_stage),
    ("best-fit packing", best_fit_packing),
]
#: SQL can't express the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
