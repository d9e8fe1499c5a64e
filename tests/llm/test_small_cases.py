"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from chronopanel.llm import bpe, decontaminate, exact, extract, language, quality, shards, simhash, urls, warc
from chronopanel.llm.common import identical_once, row_hash, scratch, stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, run int, sha string, ids string, block long"
BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
LONG = "word and other things " * 60_000


def rows(*given):
    """(doc_id, text) with the other columns filled."""
    return [(i, t, "en", "s", 1, 7, 7, "x", "y", 3) for i, t in given]


@pytest.fixture(scope="module")
def docs(spark):
    given = rows((1, "a b  c d"), (2, "a b\tc d"), (2, "a b\tc d"), (None, "a b c d"), (4, None), (5, ""), (6, LONG), (7, "ZZ"), (None, None), (3, " \n "))
    return spark.createDataFrame(given, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs):
    got = exact.groups(docs).collect()
    assert len(got) == 10
    words = [r for r in got if r.group_size == 4]
    assert {r.keep_id for r in words} == {1} and sum(r.kept for r in words) == 1
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {4} and len(empty) == 3
    assert [r.keep_id for r in got if r.doc_id == 3] == [3]


def test_exact_repeated_row_stays_once(spark):
    d = spark.createDataFrame(rows((5, "x y"), (5, "x y"), (9, "x  y")), SCHEMA)
    got = exact.groups(d).collect()
    assert sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {5}
    assert identical_once(d, exact.groups(d).where("kept").select("doc_id", "row_hash")).count() == 1


def test_named_rows_move_once(spark):
    """Whole rows are shuffled once, for the join; its partitions also serve the aggregation."""
    given = [(1, "a", "n"), (1, "a", "n"), (None, "b", "n"), (None, "b", "n"), (None, "b", "m"), (2, "c", None)]
    d = spark.createDataFrame(given, "doc_id long, text string, lang string")
    # staged names may be null by their schema
    keep = stage(d.select("doc_id", row_hash(d).alias("row_hash")).where("doc_id is null or doc_id = 1"))
    join, auto = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    was = {k: spark.conf.get(k) for k in (join, auto)}
    try:
        spark.conf.set(join, "-1")
        spark.conf.set(auto, "false")
        once = identical_once(d, keep)
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
        assert len(re.findall(r"\bSort \[", plan)) == 2
        got = sorted(once.collect(), key=str)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in got] == [(1, "a", "n"), (None, "b", "m"), (None, "b", "n")]


def test_exact_one_text_everywhere(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "'same' AS text")
    got = exact.groups(d, runs=16, fan=2).agg({"keep_id": "max", "group_size": "min", "kept": "count"}).first()
    assert (got[0], got[1], got[2]) == (0, 3000, 3000) or set(got) == {0, 3000}


def test_simhash(docs):
    got = simhash.groups(docs).collect()
    assert len(got) == 10
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}


def test_simhash_links_match_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(20):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    parent = {f: f for f, in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(signed[i][0]), find(signed[j][0])
                parent[max(x, y)] = min(x, y)
    for block in (4, 1024):
        found = dict(simhash.components(simhash.links(nodes, 3, block)).collect())
        assert all(found.get(f, f) == find(f) for f, in signed)


def test_language(spark, docs):
    de, en = "der und die nicht ist ein", "the and that with of this"
    made = [(i, f"{de if i % 2 else en} {i % 7}", "de" if i % 2 else "en") for i in range(400)]
    m = language.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.identify(docs, m).collect()}
    assert got[4].lang_pred == got[5].lang_pred == "und" and not got[4].accepted and got[4].score == 0
    assert language.identify(docs, m).columns[:10] == docs.columns
    assert m.predict(en * 3)[0] == "en" and m.predict(de)[0] == "de" and 0 <= m.predict("Z")[1] <= 1
    assert m.predict("123 ...")[0] == "und"


def test_language_without_labels(docs, none):
    m = language.fit(none)
    assert {r.lang_pred for r in language.identify(docs, m).collect()} == {"und"}


def test_decontaminate(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron. Answer pi rho sigma tau"
    near = item.replace("gamma", "changed").replace("nu", "other").upper()
    noise = " ".join(f"w{k}" for k in range(400))
    d = spark.createDataFrame(
        rows((1, f"{noise} {item} {noise}"), (2, f"{noise} {near}"), (3, noise), (4, None), (5, ""), (6, f"{LONG} {item}"), (7, "alpha beta gamma"), (7, f"{noise} {item}")), SCHEMA
    )
    b = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "..."), (4, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(i, k) for i in (1, 2, 6, 7) for k in (0, 4)}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    index = decontaminate.fit(d, b)[0]
    assert sorted(r.text or "" for r in decontaminate.clean(d, index).collect()) == sorted(["", "", noise, "alpha beta gamma"])


def test_decontaminate_blocks(spark):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(7)]
    d = spark.createDataFrame(rows(*[(k, f"before {t} after") for k, t in items]), SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (3, 5000):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, block=block).collect()} == {(k, k) for k in range(7)}


def test_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common(a, b) == t[-1, -1]


def test_bpe(spark, docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=bpe.load_ranks(BPE[0]), special_tokens={})
    given = rows((1, None), (2, ""), (3, LONG), (4, "a" * 3000), (5, "it's 12 été <|endoftext|>\n\n  x\x1c!\x1c🙂"), (5, "tie"), (6, " " * 999 + "z"))
    d = spark.createDataFrame(given, SCHEMA)
    want = sorted((r[0], bpe.array("I", enc.encode_ordinary(r[1] or "")).tobytes(), (r[1] or "").encode()) for r in given)
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.round_trip(d, *BPE).collect()) == want
    two = bpe.decode(bpe.encode(d, *BPE), *BPE).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in two) == want


def test_bpe_of_long_runs():
    """Runs of one or a few bytes, alone and in context: the library's ids, in linear time."""
    import random
    import time

    import tiktoken

    ranks = bpe.load_ranks(BPE[0])
    enc = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, BPE[1]), random.Random(1)
    began = time.time()
    given = ["=" * 300_000, "a" * 300_000, "x  " + "=" * 100_001 + "!?", "ab" * 50_000, "abcdefg" * 20_000, " " * 100_000 + "x", "1234567890" * 10_000, "é" * 50_000, "世界" * 30_000]
    given.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)))
    parts = lambda: rng.choice(["a" * rng.randint(1, 200), "=" * rng.randint(1, 150), " ", "ab" * rng.randint(1, 90), "the", "\n" * rng.randint(1, 9), "é" * rng.randint(1, 99)])
    given += ["".join(parts() for _ in range(rng.randint(1, 12))) for _ in range(200)]
    for text in given:
        ids = codec.encode(text)
        assert ids == bpe.array("I", enc.encode_ordinary(text)).tobytes() and codec.decode(ids) == text.encode()
    assert time.time() - began < 60


def test_bpe_of_a_pattern_that_matches_across_white_space():
    import tiktoken

    ranks, pattern = bpe.load_ranks(BPE[0]), r"\w+\s\w+|\s+|\S+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = "one two three  four. five six"
    assert bpe.Codec(ranks, pattern).encode(text) == bpe.array("I", enc.encode_ordinary(text)).tobytes()


def test_shards(docs):
    got = shards.shard(docs).collect()
    assert len(got) == 10 and {r.law for r in got} == {"bytes"}
    assert len({r.shard for r in got if r.doc_id in (4, 5)}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_bundled_like_at_once(spark):
    loads = spark.range(20000).selectExpr("CAST(id AS string) AS item", "id * id % 977 + CASE WHEN id < 3 THEN 500000 ELSE 1 END AS load")
    for last in (1 << 15, 2000):
        got = shards.assign(loads, 16, last=last).join(loads, "item").groupBy("shard").sum("load").collect()
        sums = [r[1] for r in got]
        assert len(sums) == 16 and max(sums) - min(sums) <= 0.01 * max(sums)


def test_differencing_is_tight():
    loads = [(k * 7919) % 1000 + 1 for k in range(500)]
    of = shards.differencing(loads, 16)
    sums = [sum(x for x, s in zip(loads, of) if s == k) for k in range(16)]
    assert sum(sums) == sum(loads) and max(sums) - min(sums) <= 2


def test_quality(docs):
    s = quality.fit(docs)
    got = quality.classify(docs, s).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert not any(r.keep for r in got if r.doc_id in (4, 5))


def test_warc(spark):
    given = [(3, "http://a/b c", "<p>é"), (1, None, "<p>é"), (2, "u", None), (4, "u", ""), (5, "u", LONG), (5, "u", LONG), (None, "u\r\nX: y", "<p>é")]
    p = spark.createDataFrame([(*g, "x", 1) for g in given], "page_id long, url string, html string, file string, offset int")
    folder = "file://" + scratch(spark, "warc")
    index = warc.archive(p, folder)
    got = warc.read(index).collect()
    assert len(got) == 7
    of = {(r.page_id, r.record_type): r for r in got}
    assert of[(3, "revisit")].refers_to == 1 and of[(None, "revisit")].refers_to == 1 and of[(4, "revisit")].refers_to == 2
    assert bytes(of[(1, "response")].payload) == "<p>é".encode() and of[(3, "revisit")].payload_bytes == 5
    assert sum(r.page_id == 5 and r.record_type == "response" for r in got) == 2
    key = lambda r: (r.file.rsplit("/", 1)[-1], r.offset, r.length, r.payload_digest, r.record_type)
    assert sorted(map(key, warc.index_archives(spark, folder).collect())) == sorted(map(key, index.collect()))
    assert {r.record_type for r in warc.read(warc.archive(p, least=1 << 30)).collect()} == {"response"}
    assert [r.page_id for r in warc.read(index.where("page_id = 4"), gap=0, span=1).collect()] == [4]


def test_ranges():
    assert list(warc.ranges([(0, 10), (12, 5), (100, 5), (105, 50)], 2, 40)) == [[(0, 10), (12, 5)], [(100, 5)], [(105, 50)]]


def test_urls_are_read_whole(spark):
    """URLs that differ only in query, fragment or scheme are told apart; ids may be text."""
    good = [(f"g{k}", f"http://a{k}.com/x{k % 7}?topic=plants&n={k}", "h") for k in range(300)]
    bad = [(f"b{k}", f"http://a{k}.net/es/x{k % 7}?clickid=zzqq{k}#zzqq", "h") for k in range(300)]
    probe = [("p1", "http://q.org/x1?topic=plants&n=5", "h"), ("p2", "http://q.org/x1?clickid=zzqq5#zzqq", "h"), ("p3", "topic=plants", "h"), ("p4", "clickid=zzqq#zzqq", "h"), (None, "q.org", "h")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(good + bad + probe, "page_id string, url string, html string")).collect()}
    assert [got[k].rule for k in ("p1", "p2", "p3", "p4")] == [None] * 4 and got["p3"].host == got["p4"].path == ""
    assert [got[k].verdict for k in ("p2", "p3", "p4")] == ["block", "allow", "block"]
    assert got["p1"].score > 0 > got["p2"].score and len(got) == 605


def test_urls(spark):
    given = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.com/en/x?q#f"), (4, "http://example.com/en/1"), (5, "x://a.net/fr/é"), (6, "x://net/es/"), (7, "x://b.org"), (8, "x://c.com"), (8, "x://c.com")]
    p = spark.createDataFrame([(*g, "h", "p") for g in given], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in urls.judge(p).collect()}
    assert (got[1].host, got[1].path, got[2].host) == ("", "", "") and got[1].verdict in ("allow", "block")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("example.com/en/", "block")
    assert got[5].rule == "net/fr/" and got[6].rule == "net/es/" and got[7].rule is None and got[8].rule is None


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies for many good reasons on all of our pages.</div>
    <article><h1>Head &amp; line</h1><script>var t="</p>";</script><p><b>First   words<br>go on<p>Short.<!-- no --><form><input><label>Mail</label></form>
    <div class="ad">Buy now</div><p>Last &#233;.</article><aside>Side</aside><section id="comments"><p>Reader words</section><footer>End</footer></body></html>"""
    assert extract.main_text(page) == "Head & line\n\nFirst words go on\n\nShort.\n\nLast é."
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>x</nav>") == ""
    assert extract.main_text("plain words") == "plain words"
    assert len(extract.main_text("<p>" + LONG)) == len(LONG.strip())


def test_main_text_among_articles():
    """Teasers and comments are articles too; titles, formulas and legal paragraphs belong to the text."""
    say = "This is a sentence of the story that is long enough to count as text in any page. " * 3
    of = lambda body: extract.main_text(f"<body>{body}</body>").replace(say.strip(), "S").split("\n\n")
    story = f"<article><h1>T</h1><p>{say}</p><p>{say}</p></article>"
    reader = f"<article><p>Reader one says {say}</p></article>"
    for more in (f'<div class="comments">{reader}</div>', f'<ol class="commentlist"><li>{reader}</li></ol>', '<section id="user-feedback"><article><p>Few words.</p></article></section>',
                 "<article><h2>More</h2><p>Teaser words.</p></article>"):
        assert of(story + more) == ["T", "S", "S"]
    assert of(f"<article><p>{say}</p><p>{say}</p><section>{reader}</section></article>") == ["S", "S"]
    assert of(f"<article><h1>A</h1><p>{say}</p></article><article><h1>B</h1><p>{say}</p></article>") == ["A", "S", "B", "S"]
    assert of(f"<article><p>{say}</p><p><math><mi>x</mi></math> The law is here.</p><p hidden>More.</p></article>") == ["S", "x The law is here.", "More."]
    assert of(f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>{say}</p></article>") == ["Title", "S"]
    assert of(f'<div><p>{say}</p><p class="legal">{say}</p><p>{say}</p></div>') == ["S"] * 3
    assert of(f'<div class="has-comments"><article><p>{say}</p></article></div>') == ["S"]


def test_empty_tables(spark, none):
    m = language.fit(none)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        exact.groups(none), simhash.groups(none), shards.shard(none), bpe.round_trip(none, *BPE), language.identify(none, m),
        quality.classify(none, quality.fit(none)), extract.extract(pages), urls.judge(pages), warc.read(warc.archive(pages)),
    ):
        assert df.count() == 0


def test_decontaminate_null_item_ids_and_several_texts_of_one(spark):
    texts = [" ".join(f"{name}{k}" for k in range(20)) for name in ("ant", "bee", "cat", "dog", "eel")]
    items = list(zip((None, 7, 7, 7, None), texts))
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, "nothing of it here")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b, block=2).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(k, i or 0) for k, (i, _) in enumerate(items)]


def test_main_text_keeps_what_stands_beside_a_long_block():
    said = lambda n, c: (c * 9 + " ") * (n // 10)
    intro, quote, end = said(120, "a"), said(1500, "b"), said(200, "c")
    whole = "\n\n".join(x.strip() for x in ("T", intro, quote, end))
    assert extract.main_text(f"<body><h1>T</h1><p>{intro}</p><blockquote><p>{quote}</p></blockquote><p>{end}</p></body>") == whole
    # paragraphs that are <div>s, one of them long, and two articles of which one is long
    page = f"<nav><a>x</a></nav><div><h1>T</h1><div>{intro}</div><div>{quote}</div><div>{end}</div></div>"
    assert extract.main_text(page) == whole
    page = f"<body><a>x</a><article><p>{quote}</p></article><article><p>{end}</p></article></body>"
    assert extract.main_text(page) == "\n\n".join((quote.strip(), end.strip()))
    # one long line alone in the upper cluster
    short = "".join(f"<p>word {k}</p>" for k in range(9))
    assert extract.main_text(f"<div>{short}<section><p>{quote}</p><p>so</p></section>{short}</div>").count("word") == 18


def test_main_text_names_are_evidence_only():
    p = f"<p>{LONG}</p>"
    words, menu = LONG.strip(), "<ul><li><a>x</a></li><li><a>y</a></li></ul>"
    for open_, close in (("<article>", "</article>"), ("", "")):
        for name in ("layout has-sidebar", "content-with-sidebar"):
            assert extract.main_text(f'<div class="{name}">{open_}{p}{p}{close}</div><nav>{menu}</nav>') == f"{words}\n\n{words}"
    assert extract.main_text(f'<form id="aspnetForm"><main>{p}</main></form>') == words
    page = f'<article><h2 id="related-work">Work</h2>{p}<section id="legal-history">{p}</section><p id="comment-on-method">{LONG}</p></article>'
    assert extract.main_text(page) == "\n\n".join(["Work"] + [words] * 3)
    # a head without its end tag
    for body in ("<body>", ""):
        assert extract.main_text(f"<html><head><title>T</title>{body}{p}<p>End") == f"{words}\n\nEnd"
    # parts that are only named so, and comments that are articles, stay out
    page = f'<article>{p}<div class="ad">Buy</div></article><div class="related-posts">{menu}</div><div id="comments"><article class="comment">{p}</article></div>'
    assert extract.main_text(page) == words


def prose(seed: int, n: int, kinds: int = 4000) -> list[str]:
    """Words by Zipf's law."""
    return [f"v{k}" for k in np.random.default_rng(seed).zipf(1.15, 4 * n) if k < kinds][:n]


def test_decontaminate_finds_short_items_in_prose(spark):
    """Verbatim copies of items of 4 to 14 words in prose of the same words, against a plain search."""
    source = prose(1, 24_000)
    sizes = [4, 6, 7, 8, 9, 10, 12, 14] * 250
    items = [(k, " ".join(source[12 * k : 12 * k + n])) for k, n in enumerate(sizes[:2000])]
    texts = [" ".join(prose(100 + d, 150) + ["zz"] + items[d * 37][1].split() + ["zz"] + prose(900 + d, 150)) for d in range(50)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows(*enumerate(texts)), SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, k) for d, t in enumerate(texts) for k, x in items if f" {x} " in f" {t} "} <= got


def test_decontaminate_compares_pieces_together(spark, monkeypatch):
    """Pieces found by their rare words are compared many at once, to the same end as one by one."""
    source = prose(3, 9_000)
    items = [(k, " ".join(source[30 * k : 30 * k + 30])) for k in range(300)]
    texts = [" ".join(prose(200 + d, 300) + items[7 * d][1].split() + prose(700 + d, 300)) for d in range(40)] + ["", None]
    index = decontaminate.fit(spark.createDataFrame(rows(*enumerate(texts)), SCHEMA), spark.createDataFrame(items, "item_id long, text string"))[0]
    hashed, edges = decontaminate.words(pa.array(texts))
    place = index.vocabulary.find(hashed)
    near, one = index.rare.find(place, edges, index.stride), []
    for t, p, at in near:
        item, (lo, hi) = index.items[index.rare.of[p]][1], index.rare.parts[p]
        own = place[edges[t] + at : min(edges[t] + at + 2 * index.stride, edges[t + 1])]
        if decontaminate.common(item[lo:hi], own) >= index.lcs * (hi - lo) - 1e-9:
            one.append((t, p, at))
    assert len(near) > 10 * len(one) > 0 and index.there(near, place, edges) == one
    calls, plain = [], decontaminate.common
    monkeypatch.setattr(decontaminate, "common", lambda *x: calls.append(1) or plain(*x))
    monkeypatch.setattr(decontaminate, "TOGETHER", 100)
    got = index.hits(pa.array(texts))
    assert len(calls) < len(near) and {(d, 7 * d) for d in range(40)} <= {(t, h[0]) for t, found in got.items() for h in found}


def test_common_subsequences_of_many_rows():
    rng = np.random.default_rng(1)
    for _ in range(30):
        place = rng.integers(0, 7, 60).astype(np.int32)
        items = rng.integers(0, 6, (40, 12))
        for own, n in zip(items, rng.integers(0, 13, 40)):
            own[n:] = -1
        start = rng.integers(0, 61, 40)
        end = np.minimum(start + rng.integers(0, 49, 40), 60)
        want = [decontaminate.common(own[own >= 0], place[a:b]) for own, a, b in zip(items, start, end)]
        assert decontaminate.common_each(items, place, start, end).tolist() == want
        assert decontaminate.distinct(place[: start[0]]).tolist() == np.unique(place[: start[0]]).tolist()


def test_decontaminate_postings_over_slices(monkeypatch):
    items = [(0, np.arange(10), np.arange(0)), (1, np.arange(20, 60), np.arange(0))]
    place = np.r_[np.full(700, 99), np.arange(10), np.full(37, 99), np.arange(20, 60), np.full(9, 99)]
    rare = decontaminate.Rare(items, np.ones(99), 0.65, 8)
    whole = sorted(rare.find(place, np.array([0, 300, len(place)]), 24))
    assert {rare.of[p] for _, p, _ in whole} == {0, 1} and {t for t, _, _ in whole} == {1}
    monkeypatch.setattr(decontaminate, "POSTINGS", 3)
    assert sorted(set(rare.find(place, np.array([0, 300, len(place)]), 24))) == whole


def test_decontaminate_partial_and_reordered_items(spark):
    long, mid = [f"q{k}" for k in range(300)], [f"m{k}" for k in range(59)]
    turn = [f"t{k}" for k in range(40)]
    noise = [f"w{k}" for k in range(400)]
    turned = [x if k % 7 else "other" for k, x in enumerate(turn)]
    texts = [long[60:240], mid[:38], turn[20:] + turn[:20], turned[20:] + turned[:20], long[5:17], []]
    d = spark.createDataFrame(rows(*[(k, " ".join(noise + t + noise)) for k, t in enumerate(texts)]), SCHEMA)
    b = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(mid)), (2, " ".join(turn[:32]) + ". " + " ".join(turn[32:]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(0, 0), (1, 1), (2, 2), (3, 2)}
