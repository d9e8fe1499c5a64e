"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its letter pairs and triples, hashed into a
fixed number of buckets. Embeddings and softmax are trained by stochastic gradient descent
in numpy on a sample of labelled rows, `per_language` of each language; that bound is the
only one, everything else covers all rows and whole texts. A fifth of the sample is kept
back to fit the temperature of the probabilities and the confidence under which a
prediction is rejected. For prediction embeddings and softmax fold into one table of
bucket times language, whose size does not depend on the data; it is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronopanel.llm.common import columns

BUCKETS, WIDTH = 1 << 15, 16
#: Characters of a text that are hashed at once.
PIECE = 1 << 20
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, as a table."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    counts, table, low = np.zeros(BUCKETS, np.int64), letters(), (text or "").lower()
    for at in range(0, len(low), PIECE):
        # two characters of the piece before, so no triple is lost
        piece = " " * max(0, 2 - at) + low[max(0, at - 2) : at + PIECE] + (" " if at + PIECE >= len(low) else "")
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(table[c], c, np.uint32(0))
        mixed = c * np.uint32(2654435761)
        pair = mixed[1:-1] ^ (c[2:] * np.uint32(2246822519))
        triple = (pair ^ (c[:-2] * np.uint32(3266489917))) * np.uint32(668265263)
        middle = c[1:-1] != 0
        counts += np.bincount(triple[middle] >> np.uint32(17), minlength=BUCKETS)
        counts += np.bincount((pair[middle] * np.uint32(374761393)) >> np.uint32(17), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = grams(text)
        total = counts.sum()
        if not total or not self.languages:
            return UNKNOWN, 0.0, False
        z = (counts.astype(np.float32) @ self.table).astype(np.float64) / total / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        return self.languages[best], score, score >= self.threshold


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows, epochs: int = 5, rate: float = 0.5, reject: float = 0.001, ceiling: float = 0.6, seed: int = 7) -> Model:
    """Fit on (language, buckets, shares) rows, every fifth of which calibrates.

    Under the threshold lies the share `reject` of the right predictions among the rows
    kept back; it is at most `ceiling`, so a confident prediction is never rejected
    because the sample was easy.
    """
    names = sorted({r[0] for r in rows})
    of = {n: k for k, n in enumerate(names)}
    fit = [r for i, r in enumerate(rows) if i % 5]
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(names)), np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(len(fit)):
            name, idx, share = fit[i]
            h = share @ emb[idx]
            wrong = _softmax(h @ out)
            wrong[of[name]] -= 1
            back = out @ wrong
            out -= step * np.outer(h, wrong)
            # a share is small where a text is long: the step is scaled to the text's norm
            emb[idx] -= step * np.outer(share / np.float32(share @ share + 1e-9) * np.float32(0.05), back)
    table = emb @ out
    z = np.array([share @ table[idx] for _, idx, share in held], np.float64).reshape(len(held), len(names))
    y = np.array([of[r[0]] for r in held], int)
    grid = np.geomspace(0.5, 20, 121)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() if len(y) else 0 for t in grid]
    best = float(grid[int(np.argmin(loss))])
    p = _softmax(z / best) if len(y) else np.ones((0, 1))
    right = p.max(axis=1)[p.argmax(axis=1) == y] if len(y) else np.ones(0)
    return Model(names, table, best, min(ceiling, float(np.quantile(right, reject))) if len(right) else 0.0)


def held_out(id: Column) -> Column:
    """Whether the id's fold is kept out of training; a null id has no fold and is not learned from."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold.

    About `per_language` rows of each language are drawn by a hash of their id. Features
    are made in tasks, of bounded size whatever the text; one task trains on them. Rows
    without language, id or letters are not learned from. Without any labelled row the
    model knows no language and answers `und`.
    """
    rows = columns(docs, doc_id=id, text=text, lang=lang).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, per_language / n)])
    draw = (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    drawn = rows.select("lang", "text", draw, "doc_id").where(F.col("draw") < share[F.col("lang")])

    def features(batches):
        for b in batches:
            out = []
            for lang, text, draw in zip(b.column(0), b.column(1), b.column(2)):
                counts = grams(text.as_py())
                idx = np.flatnonzero(counts).astype(np.int32)
                if len(idx):
                    of = (counts[idx] / counts.sum()).astype(np.float32)
                    out.append((lang.as_py(), draw.as_py(), idx.tobytes(), of.tobytes()))
            kinds = (pa.string(), pa.float64(), pa.binary(), pa.binary())
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "draw", "idx", "share"])

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["draw", "lang", "idx"])
        parts = zip(pdf["lang"], pdf["idx"], pdf["share"])
        m = train([(n, np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for n, i, s in parts])
        return pd.DataFrame(
            {"languages": [m.languages], "model": [m.table.tobytes()], "temperature": [m.temperature], "threshold": [m.threshold]}
        )

    made = drawn.select("lang", "text", "draw").mapInArrow(features, "lang string, draw double, idx binary, share binary")
    found = made.withColumn("sample", F.lit(0)).groupBy("sample").applyInPandas(learn, "languages array<string>, model binary, temperature double, threshold double").collect()
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    m = found[0]
    names = list(m["languages"])
    table = np.frombuffer(m["model"], np.float32).reshape(BUCKETS, len(names))
    return Model(names, table, m["temperature"], m["threshold"])


def identify(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """`docs`, all columns kept, with predicted language, calibrated score and acceptance.

    Null texts and texts without letters get `und`, score 0 and are rejected; a score
    under the model's threshold rejects too. No shuffle: rows stay where they are. An
    empty table gives an empty table. Existing columns of these names are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for b in batches:
            said = [m.predict(t.as_py()) for t in b.column(at)]
            made = [pa.array([s[k] for s in said], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out[0]}` string, `{out[1]}` double, `{out[2]}` boolean")
