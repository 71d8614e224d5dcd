"""Documents to token ids: five stages, each one operator of ``logspark.llm`` over all that the last one kept.

Toxic documents go; lines that repeat earlier runs go from the texts; of each group of near duplicates the
document with the smallest id stays; sources are brought to their target weights, a document coming once for each
pass that takes from it; what is left is encoded. Columns and the treatment of nulls are those of the operators;
a label table without rows leaves every document. Stages with Python in tasks set their session to small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspark.llm import bpe, linededup, mixing, neardup, toxicity
from logspark.llm.words import read
from logspark.session import in_small_batches, materialise


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on their labelled part does not call toxic."""
    in_small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that an earlier document or line has."""
    return linededup.delete_repeats(docs, every=True).drop("n_lines_deleted")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    in_small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    import public_tokenizers

    in_small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_report(docs, path, public_tokenizers.PATTERN, words=True)


STAGES = [
    ("toxicity", clean), ("line dedup", without_repeats), ("near dedup", one_of_each), ("mixing", mixed), ("encoding", encoded),
]

#: Hashes, a fitted classifier and tokens: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the input of the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
