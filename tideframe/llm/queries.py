"""The thirteen queries over whole tables, and their SQL where SQL can express them. Each digests what its operator returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, gif, language, merkle, minhash, mixing, oracle, packing, quality, sharding, tokens, toxicity, urls, warc
from .shared import text_batches, written

CAPACITY = 2048
#: (verdict, host, path)
URL_RULES: list[urls.Rule] = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def language_model(docs: DataFrame) -> language.Model:
    return language.fit(docs.where(id_remainder("doc_id", 4) != 2), "text", "lang", ["doc_id"])


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    own = labels.where(id_remainder("doc_id", 3) != 1).select("doc_id", "toxic")
    return toxicity.fit(docs.select("doc_id", "text"), own, "doc_id", "text", "toxic")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify_language(docs.select("doc_id", "text"), "text", language_model(docs), "lang_pred", "score")
    return out.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), "text", toxicity_model(docs, table(spark, sf_dir, "labels")), "score")
    return out.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.md5("text").alias("text_md5"))
    out = sharding.shard_groups(sized, "text_md5", "size", 24, ["doc_id", "text_md5"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words("text").alias("size"))
    out = mixing.mix_sources(written(docs), "source", "size", ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), CAPACITY)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gif.text_media(table(spark, sf_dir, "documents"), "doc_id", "text", with_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.filter_urls(table(spark, sf_dir, "pages"), "url", "html", URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergences(table(spark, sf_dir, "documents"), "text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = lambda n_chars: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", fields(F.col("n_chars")).alias("leaf"), F.when(id_remainder("doc_id", 7) == 0, fields(F.col("n_chars") + 1)).alias("other"))
    out = merkle.merkle_proofs(docs, "lang", ["doc_id"], "leaf", ["doc_id", "other"])
    steps, own = F.col("steps"), F.coalesce("other", "leaf")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(steps), 256).alias("proof_sha256"), merkle.fold(own, steps).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return tokens.count_tokens(docs, "text", tokenizer_path("word_bpe_49k.json"), "n_tokens", CAPACITY, ["doc_id", "n_bytes"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language, op2_toxicity, op3_sharding, op4_quality, op5_minhash, op6_warc, op7_mixing, op8_packing, op9_gif, op10_urls, op11_divergence, op12_merkle, op13_tokens, pipeline)}

ORACLE_SQL = {"op4_quality": oracle.QUALITY, "op5_minhash": oracle.NEAR_DUPLICATES, "op6_warc": oracle.RECORDS, "op10_urls": oracle.url_verdicts(URL_RULES), "op11_divergence": oracle.DIVERGENCES, "op12_merkle": oracle.MANIFEST}
