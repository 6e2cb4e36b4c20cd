"""One query for each operator of this folder, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm.common import documents, shared_dir

#: Folder of the public tokenizers; None takes the installed package's.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.token_binary import read_token_files, write_token_files

    manifest = write_token_files(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), shared_dir(spark, "tokens"))
    return read_token_files(spark, manifest)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tracefold.llm.toxicity import fit, held_out, score_documents

    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.piece_codec import piece_digests

    return piece_digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.secret_scan import scan_documents

    return scan_documents(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "scan.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.quality_rules import judge_quality

    return judge_quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.source_mix import mix_sources

    return mix_sources(documents(spark, sf_dir))[0]


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.token_count import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.llm.pii import find_personal_data

    return find_personal_data(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_binary": op1_token_binary,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_piece_codec": op5_piece_codec,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mix": op8_source_mix,
    "op9_token_count": op9_token_count,
    "op10_pii": op10_pii,
}

ORACLE: dict[str, str] = {}
