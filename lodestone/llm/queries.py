"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, collocation, decontam, lm, media, packing, quality, sharding, simhash, tokenfile, toxicity
from .common import crc_of_id


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")).drop("ids")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(_table(spark, sf_dir, "documents")))


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.fit(documents, _trusted(spark, sf_dir)))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = _vocabulary("byte_bpe_50k.tiktoken"), _pattern()
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, pattern), vocabulary, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    classifier = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score(documents, classifier).withColumn("held_out", crc_of_id("doc_id") % 4 == 2)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack, op2_simhash, op3_sharding, op4_media, op5_quality, op6_lm, op7_bpe, op8_toxicity, op9_chat, op10_token_files,
        op11_decontaminate, op12_centroids, op13_collocations,
    )
}

ORACLE = {
    "op3_sharding": sharding.oracle("documents", "doc_id"),
    "op9_chat": chat.ORACLE,
    "op11_decontaminate": decontam.ORACLE,
    "op12_centroids": centroids.oracle(),
    "op13_collocations": collocation.oracle(),
}
