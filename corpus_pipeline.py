"""A corpus pipeline: five operators over documents, each stage on what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from chronopanel.llm import bpe, decontaminate, exact, language, simhash
from chronopanel.llm.common import identical_once, small_batches, stage, table
from chronopanel.llm.queries import digests

OUT = ("__lang", "__score", "__accepted")


def identify(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence; null and letterless texts go."""
    docs = small_batches(docs)
    return language.identify(docs, language.fit(docs), out=OUT).where(F.col(OUT[2])).drop(*OUT)


def exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id; of its repeated rows one."""
    return identical_once(docs, exact.groups(docs).where("kept").select("doc_id", "row_hash"))


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; of its repeated rows one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first")
    docs = small_batches(docs)
    return identical_once(docs, simhash.groups(docs).groupBy("component").agg(first).select("first.doc_id", "first.row_hash"))


def benchmark_free(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows stay each."""
    docs = small_batches(docs)
    for index in decontaminate.fit(docs, table(spark, sf_dir, "benchmark")):
        docs = decontaminate.clean(docs, index)
    return docs


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text has no tokens,
    repeated rows have a row each."""
    docs = small_batches(docs)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(bpe.round_trip(docs, path, pattern))


STAGES = [
    ("language", identify),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("decontaminate", benchmark_free),
    ("bpe", tokens),
]

#: SQL can't express a trained model, fingerprint components, retrieval or an encoding.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
