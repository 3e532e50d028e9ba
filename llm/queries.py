"""One thin query per operator, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", "source", common.word_count(F.col("text")).alias("size"))
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", sharding.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    out = sharding.shard(docs, F.col("text_hash"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup
    return line_dedup.line_digests(common.table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann
    return ann.search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scores(docs, common.table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan
    return secret_scan.secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_dedup.near_duplicates(docs, width=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The piece model and the limit of op9.
TOKENIZER, TOKEN_LIMIT = "piece_bpe_32k.model", 4096


def op9_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from . import token_counts
    if model is None:
        import public_tokenizers
        model = public_tokenizers.path(TOKENIZER)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.token_counts(docs, token_counts.pieces(model), common.stage)
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = common.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The word vocabulary of op11.
WORD_TOKENIZER = "word_bpe_49k.json"


def _vocabulary(path: str | None) -> str:
    """A tokenizers vocabulary, read on the driver from where it is installed."""
    import public_tokenizers
    with open(path or public_tokenizers.path(WORD_TOKENIZER), encoding="utf-8") as f:
        return f.read()


def op11_packing(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from . import packing
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, _vocabulary(model)))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence
    return divergence.audit(common.table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import conversation_trie
    return conversation_trie.trie(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}
