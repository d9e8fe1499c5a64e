"""One query per operator over its whole table, and the pipeline; SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from chronopanel.llm import bpe, decontaminate, exact, extract, language, mixing, quality, ranking, shards, simhash, urls, warc, whitening
from chronopanel.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
  list_reduce(list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(0, 4),
    lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31 AS INT) + 1, 1)),
    lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


@query("op1_warc", OP1)
def op1(spark, sf):
    return warc.read(warc.archive(table(spark, sf, "pages")), payloads=False).drop("payload")


@query("op2_quality")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.classify(docs, quality.fit(docs))


@query("op3_url_filter", urls.SQL)
def op3(spark, sf):
    return urls.judge(table(spark, sf, "pages")).drop("score")


@query("op4_simhash")
def op4(spark, sf):
    return simhash.groups(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op5_decontaminate")
def op5(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP6 = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY t)
"""


@query("op6_exact_dedup", OP6)
def op6(spark, sf):
    return exact.groups(table(spark, sf, "documents")).drop("row_hash")


@query("op7_shards")
def op7(spark, sf):
    return shards.shard(table(spark, sf, "documents"))


@query("op8_language")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    said = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    held = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    return said.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def digests(encoded):
    """Of ids and decoded bytes: counts and SHA-256 of the ids and the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_bpe")
def op9(spark, sf):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(bpe.round_trip(table(spark, sf, "documents"), path, pattern))


@query("op10_main_text")
def op10(spark, sf):
    return extract.extract(table(spark, sf, "pages"))


@query("op11_whitening")
def op11(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op12_mixing", mixing.SQL)
def op12(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op13_ranking", ranking.SQL)
def op13(spark, sf):
    return ranking.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
