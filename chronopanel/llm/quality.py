"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Votes of all documents are
counted by pattern, at most 3 ** labellers rows, and expectation-maximisation estimates on
these counts how often each labeller gives each vote on good and on bad documents. The
posterior of a document's pattern is its label. A linear scorer over hashed byte triples is
trained on the posteriors of a bounded sample (`rows` documents, drawn by a hash) and
scores every whole document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chronopanel.llm.common import columns
from chronopanel.llm.decontaminate import words

GOOD, BAD, NONE = 2, 0, 1
BUCKETS = 1 << 16
#: Bytes hashed at once.
PIECE = 1 << 20

#: Classes of bytes that the labellers count.
CLASSES = {"symbol": b"#$%&*|~^<>{}[]\\=+@_`", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "bang": b"!", "digit": b"0123456789", "stop": b"."}


#: Each labeller: its name, when it votes good, when it votes bad (which wins), given signals s.
LABELLERS = (
    ("symbols", lambda s: s["bytes"] < 0, lambda s: s["symbol"] > 0.015 * s["bytes"]),
    ("symbol_words", lambda s: s["symbol"] * 50 < s["words"], lambda s: s["symbol"] > 0.15 * s["words"]),
    ("capitals", lambda s: s["bytes"] < 0, lambda s: s["upper"] > 0.4 * (s["upper"] + s["lower"])),
    ("shouting", lambda s: s["bytes"] < 0, lambda s: s["bang"] > 0.1 * s["words"]),
    ("variety", lambda s: s["bytes"] < 0, lambda s: (s["words"] >= 30) & (s["distinct"] < 0.2 * s["words"])),
    ("repetition", lambda s: s["distinct"] > 0.4 * s["words"], lambda s: (s["words"] >= 30) & (s["distinct"] < 0.1 * s["words"])),
    ("length", lambda s: s["bytes"] < 0, lambda s: s["words"] < 3),
    ("word_length", lambda s: s["bytes"] < 0, lambda s: (s["bytes"] > 20 * s["words"]) | (s["bytes"] < 3 * s["words"])),
    ("letters", lambda s: s["lower"] > 0.6 * s["bytes"], lambda s: s["upper"] + s["lower"] < 0.4 * s["bytes"]),
    ("digits", lambda s: s["bytes"] < 0, lambda s: s["digit"] > 0.2 * s["bytes"]),
)


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is empty."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8)[edges[0] : edges[-1]] if len(t) and edges[-1] > edges[0] else np.empty(0, np.uint8)
    return data, edges - edges[0]


def votes(texts: pa.Array) -> np.ndarray:
    """The labellers' votes, a row per text."""
    data, edges = _raw(texts)
    signals = {"bytes": np.diff(edges)}
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        at = np.flatnonzero(table[data]) if len(data) else np.empty(0, np.int64)
        signals[name] = np.diff(np.searchsorted(at, edges))
    hashed, begin = words(texts)
    signals["words"] = np.diff(begin)
    signals["distinct"] = np.array([len(np.unique(hashed[a:b])) for a, b in zip(begin, begin[1:])], np.int64)
    return np.stack([np.where(bad(signals), BAD, np.where(good(signals), GOOD, NONE)) for _, good, bad in LABELLERS], axis=1)


def pattern(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1]))


@dataclass
class Labels:
    """P(good) and, by labeller and class (bad, good), the share of each vote."""

    prior: float
    shares: np.ndarray  # labellers x 2 x 3

    def posterior(self, v: np.ndarray) -> np.ndarray:
        k = np.arange(v.shape[1])
        logs = np.log(self.shares)
        good = np.log(self.prior) + logs[k, 1, v].sum(axis=1)
        bad = np.log(1 - self.prior) + logs[k, 0, v].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, trust: float = 0.05) -> Labels:
    """Expectation-maximisation over vote patterns (rows of votes) and how often each occurs.

    The start, that bad votes are frequent on bad and rare on good documents, also counts
    as a prior worth `trust` of the documents.
    """
    n = patterns.shape[1]
    start = np.array([[0.5, 0.45, 0.05], [0.01, 0.5, 0.49]])
    worth = 1 + trust * counts.sum()
    m = Labels(0.8, np.repeat(start[None], n, axis=0))
    for _ in range(rounds):
        good = m.posterior(patterns)
        shares = np.empty_like(m.shares)
        for c, w in ((1, counts * good), (0, counts * (1 - good))):
            for vote in (BAD, NONE, GOOD):
                shares[:, c, vote] = (w[:, None] * (patterns == vote)).sum(axis=0) + worth * start[c, vote]
        shares /= shares.sum(axis=2, keepdims=True)
        prior = float(np.clip((counts * good).sum() / max(counts.sum(), 1), 0.001, 0.999))
        done = np.abs(shares - m.shares).max() < 1e-9
        m = Labels(prior, shares)
        if done:
            break
    return m


def weak_labels(docs: DataFrame, text: str = "text") -> Labels:
    """Accuracies from the votes on all documents."""

    def run(batches):
        for b in batches:
            p, n = np.unique(pattern(votes(b.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], ["pattern", "n"])

    rows = columns(docs, text=text).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    found = rows.orderBy("pattern").collect()
    p = np.array([r["pattern"] for r in found], np.int64)
    split = p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    return estimate(split.astype(int), np.array([r["n"] for r in found], float))


def triples(data: np.ndarray) -> np.ndarray:
    """The bucket of each byte and the two after it."""
    d = data.astype(np.uint32)
    return ((d[:-2] * np.uint32(2654435761) ^ d[1:-1] * np.uint32(2246822519) ^ d[2:] * np.uint32(3266489917)) * np.uint32(668265263)) >> np.uint32(16)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their shares."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 2), PIECE):
        counts += np.bincount(triples(data[at : at + PIECE + 2]), minlength=BUCKETS)
    idx = np.flatnonzero(counts)
    return idx.astype(np.int32), (counts[idx] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Scorer:
    labels: Labels
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """P(good) of every whole text by the linear scorer."""
        data, edges = _raw(texts)
        total = np.zeros(len(edges) - 1)
        number = np.maximum(0, np.diff(edges) - 2)
        for at in range(0, max(0, len(data) - 2), PIECE):
            w = self.weights[triples(data[at : at + PIECE + 2])].astype(np.float64)
            run = np.r_[0.0, np.cumsum(w)]
            # a text's triples begin before its last two bytes
            lo, hi = np.clip(edges[:-1] - at, 0, len(w)), np.clip(edges[:-1] + number - at, 0, len(w))
            total += run[np.maximum(hi, lo)] - run[lo]
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(number, 1), -500, 500)))


def train(rows, epochs: int = 6, rate: float = 1.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on (buckets, shares, posterior) rows by AdaGrad."""
    w, g, bias, gb = np.zeros(BUCKETS, np.float32), np.full(BUCKETS, 1e-8, np.float32), 0.0, 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, share, y = rows[i]
            wrong = 1 / (1 + np.exp(-np.clip(bias + share @ w[idx], -50, 50))) - y
            step = np.float32(wrong) * share
            g[idx] += step * step
            w[idx] -= rate * step / np.sqrt(g[idx])
            gb += wrong * wrong
            bias -= 0.1 * wrong / np.sqrt(gb)
    return w, float(bias)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", rows: int = 6000) -> Scorer:
    """Estimate the labellers on all documents and train the scorer on about `rows` of them."""
    labels = weak_labels(docs, text)
    given = columns(docs, doc_id=id, text=text)
    n = given.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.octet_length("text")), F.lit(1 << 30)) / float(1 << 30)
    drawn = given.select("text", draw.alias("draw")).where(F.col("draw") < rows / max(n, 1))

    def made(batches):
        for b in batches:
            good = labels.posterior(votes(b.column(0)))
            out = [features(t.as_py()) for t in b.column(0)]
            cols = [b.column(1), pa.array([i.tobytes() for i, _ in out], pa.binary()), pa.array([s.tobytes() for _, s in out], pa.binary()), pa.array(good)]
            yield pa.RecordBatch.from_arrays(cols, ["draw", "idx", "share", "good"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "idx"])
        w, b = train([(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32), y) for i, s, y in zip(pdf["idx"], pdf["share"], pdf["good"])])
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [b]})

    sample = drawn.mapInArrow(made, "draw double, idx binary, share binary, good double").withColumn("sample", F.lit(0))
    found = sample.groupBy("sample").applyInPandas(learn, "weights binary, bias double").collect()
    if not found:
        return Scorer(labels, np.zeros(BUCKETS, np.float32), 0.0)
    return Scorer(labels, np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"])


def classify(docs: DataFrame, scorer: Scorer, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score and keep (score of at least `least`).

    Null and empty texts have no triples: they score by the bias alone and are not kept.
    Repeated rows are scored each, an empty table gives an empty table, very long texts are
    read in pieces, other columns play no part.
    """
    rows = columns(docs, doc_id=id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        s = shared.value
        for b in batches:
            t = b.column(1)
            score = s.score(t)
            there = np.array(pc.fill_null(pc.binary_length(t.cast(pa.binary())), 0)) > 0
            cols = [b.column(0), pa.array(s.labels.posterior(votes(t))), pa.array(score), pa.array((score >= least) & there)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "weak_label", "score", "keep"])

    return rows.mapInArrow(run, f"doc_id {kind}, weak_label double, score double, keep boolean")
