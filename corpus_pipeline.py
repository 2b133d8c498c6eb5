"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Language ID rejects documents whose language cannot be told (null texts and texts without a letter); exact dedup and
SimHash near-dedup keep one document of each group, the one with the smallest id; decontamination drops documents of
which one word in twenty or more lies in benchmark windows; SentencePiece gives ids and the decoded text.
"""

from pyspark.sql import DataFrame, SparkSession

from lendgrain.llm.decontaminate import clean
from lendgrain.llm.exact_dedup import drop_exact_copies
from lendgrain.llm.language_id import with_language
from lendgrain.llm.queries import tokenizer_path
from lendgrain.llm.sentencepiece_bpe import encoded
from lendgrain.llm.shared import MADE, drop_folder, drop_made_since, new_folder, staged
from lendgrain.llm.simhash import keep_one_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded."""
    return encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminate), ("SentencePiece", tokens)]

ORACLE_SQL = None  # language ID, SimHash and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages. What a stage wrote for itself, and the stage before it, go once its result is written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        made = len(MADE)
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{i}")
        drop_made_since(spark, made)
        if i:
            drop_folder(spark, f"{folder}/{i - 1}")
    return docs


QUERIES, ORACLES = {"pipeline": run}, {}
