"""Queries of the training-data operators: name -> f(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, hard_negatives, langid, licences, mixing, multiindex, pieces, pseudonyms, sharding, simhash, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark, sf_dir):
    found = pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), key="the key of this query")
    return found.select("doc_id", "text", "private_kinds", "n_private")


def op4_multiindex(spark, sf_dir):
    return multiindex.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_urlfilter(spark, sf_dir):
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op6_langid(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs.drop("lang"), prototypes).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_licences(spark, sf_dir):
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), "licence")


def op8_decontaminate(spark, sf_dir):
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_shard(spark, sf_dir):
    sent = sharding.shard(_table(spark, sf_dir, "documents"))
    return sent.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_mix(spark, sf_dir):
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Where the machine has a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_pieces(spark, sf_dir):
    model = tokenizer_file("piece_bpe_32k.model")
    ids = pieces.encode(_table(spark, sf_dir, "documents"), model)
    decoded = ids.select("doc_id", "piece_ids", pieces.decode(F.col("piece_ids"), model).alias("text"))
    digest = F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256)
    return decoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_alignment(spark, sf_dir):
    return alignment.link_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("v"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_pseudonyms, op4_multiindex, op5_urlfilter, op6_langid, op7_licences, op8_decontaminate, op9_shard, op10_mix, op11_pieces, op12_alignment, op13_hard_negatives)}

ORACLE_SQL = {"op7_licences": licences.oracle_sql(), "op8_decontaminate": decontaminate.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
