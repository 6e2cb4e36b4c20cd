"""A corpus pipeline of five operators: toxic documents go, one of each group of near duplicates stays,
secrets are masked, sources are mixed to their targets, and what is left is encoded and decoded.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns one row for
each row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import documents, materialise, unused
from tracefold.llm.jaccard_join import without_near_duplicates
from tracefold.llm.piece_codec import piece_digests
from tracefold.llm.queries import tokenizer
from tracefold.llm.secret_scan import mask_secrets
from tracefold.llm.source_mix import mixed_documents
from tracefold.llm.toxicity import fit, held_out, score_documents

TOXIC_AT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    score = unused(docs, "score")
    return score_documents(docs, model, score).where(F.col(score) < TOXIC_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_digests(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", drop_secrets),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: A trained score and a hash-seeded choice of documents are not SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
