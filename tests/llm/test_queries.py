"""The registered queries: SQL twins, brute force, held-out accuracy, the pipeline."""

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from chronopanel.llm import bpe, language
from chronopanel.llm.queries import ORACLES, QUERIES
from compare import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], sf) is None


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_decontaminate_finds_whole_items(spark, sf, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(i, b.item_id) for i, t in texts.items() for b in items if b.text in t}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op5_decontaminate"](spark, sf).collect()} == want


def test_shards(spark, sf, texts):
    got = QUERIES["op7_shards"](spark, sf).collect()
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    sums = np.bincount([r.shard for r in got], [r.size for r in got], 16)
    assert len(got) == len(texts) and sums.max() - sums.min() <= 0.02 * sums.mean()


def test_language_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in QUERIES["op8_language"](spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97


def test_quality_against_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.keep for r in QUERIES["op2_quality"](spark, sf).collect()}
    assert np.mean([got[i] == (q == 1) for i, q in label.items()]) > 0.95
    assert np.mean([got[i] for i, q in label.items() if q == 1]) > 0.99


def test_bpe(spark, sf, texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in QUERIES["op9_bpe"](spark, sf).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_main_text_is_the_article(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op10_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>)", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pipeline(spark, sf, texts):
    """The stages' decisions by brute force on what each was given."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, fn in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.stage(fn(spark, kept, sf), name)
        assert kept.columns == docs.columns
        given, left = {r.doc_id: r.text for r in before.collect()}, {r.doc_id for r in kept.collect()}
        if name == "language":
            m = language.fit(before)
            assert left == {i for i, t in given.items() if m.predict(t)[2]}
        if name == "exact_dedup":
            first: dict = {}
            for i, t in sorted(given.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            assert left == set(first.values())
        if name == "simhash_dedup":
            from chronopanel.llm.simhash import fingerprint

            fps = {i: fingerprint((t or "").encode()) for i, t in given.items()}
            parent = {i: i for i in fps}

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            ids = sorted(fps)
            for k, a in enumerate(ids):
                for b in ids[:k]:
                    if (fps[a] ^ fps[b]).bit_count() <= 3:
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
            assert left == {find(i) for i in ids}
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert left == {i for i, t in given.items() if not any(x in (t or "") for x in items)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left
