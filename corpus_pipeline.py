"""Five stages over documents, each by one operator of ``llm``: toxic
documents go, one of each group of near duplicates stays, documents with
benchmark passages go, sources are mixed to their target weights, and the mix
is sharded. Every stage reads all that the one before it wrote, with every
column of documents, further ones too; only ``shard`` and ``slot`` are replaced
by the last stage where documents bring columns so named.

Nulls: a null text has no words. The first three stages keep it, like an empty
one, and every such row; the mix is made of words, so it holds neither. Rows
without doc_id are documents like others, in near-duplicate groups the last to
be chosen. Equal rows are one document from the second stage on. Ties fall to
the smaller doc_id, then the smaller hash of the text. Texts of any length are
read whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import common, decontaminate, mixing, near_dedup, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the clause grammar, fitted on labels."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.kept_documents(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row per epoch and unbroken run of a
    document's words. Documents without words, or not drawn, are not in it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard (0 to 7, near-equal bytes) and slot."""
    return sharding.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark),
          ("mixing", mix_sources), ("sharding", shard)]

#: SQL cannot express the fitted score of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again: the
    sharded corpus, texts included. What the stages leave behind goes; the last
    one's files stay."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scope(spark):
        for i, (name, stage) in enumerate(STAGES, 1):
            docs = common.stage(stage(spark, docs, sf_dir), name, keep=i == len(STAGES))
    return docs
