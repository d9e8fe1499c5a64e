"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. Their TF-IDF matrix, with document frequencies
counted over all documents, is decomposed by a distributed randomised SVD: tasks multiply
their rows with a random matrix and send back partial products, which are summed by term
block; the driver only holds matrices of terms times `rank`. Every document is read as
overlapping passages, folded into the latent space as sums of word vectors and compared
with all benchmark passages in one matrix product. Candidates are those above the cosine
threshold that hold enough of the passage's weight, and those an inverted index finds: an item
is cut into pieces of at most `PIECE_WORDS` words, of which one holds the least share of its
words if the item does, so some of the piece's rarest words must stand there. Candidates are decided on
words: longest common subsequence with the item and a check that the item's answer, its last
sentence unless a column names it, is there too; or nearly all of the item in another
order; or nearly all of a passage of two pieces.

The benchmark is the stated query set. It is handled in blocks of `block` items, each of
which bounds what is broadcast: the block's words, word vectors and passages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chronopanel.llm.common import columns

#: Bytes whose words are hashed at once; passages that are compared at once.
PIECE, COMPARED = 1 << 19, 1 << 12
#: The most words of a piece of an item; postings that are counted at once; pieces that are compared at once.
PIECE_WORDS, POSTINGS, TOGETHER = 12, 1 << 20, 1 << 14
#: Slots of the table that finds known words.
SLOTS = 20
#: An odd base for word hashes; its powers and those of its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15

#: Bytes of words (ASCII letters and digits, all bytes of other characters), 0 for the rest.
BYTES = np.array([i if i >= 0x80 or chr(i).isalnum() else 0 for i in range(256)], np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power(name: str) -> np.ndarray:
    if name not in _powers:
        base = BASE if name == "up" else pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[name] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * PIECE, base, np.uint64)])
    return _powers[name]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the whole texts, and where each text's words begin.

    Words are runs of letters and digits in lower case; characters outside ASCII count as
    letters. Null texts have none.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    edges = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    if not len(low) or edges[-1] == edges[0]:
        return np.empty(0, np.uint64), np.zeros(len(low) + 1, np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    begins = np.zeros(len(data) + 1, bool)
    begins[edges] = True
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        # a piece ends between words; a word longer than a piece is cut
        gap = np.flatnonzero(BYTES[data[end : end + PIECE]] == 0)
        end = end + int(gap[0]) if len(gap) else min(end + PIECE, len(data))
        c = BYTES[data[at:end]]
        inside = c != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | begins[at + 1 : end]
        starts = np.flatnonzero(first)
        if len(starts):
            with np.errstate(over="ignore"):
                h = np.add.reduceat(c * _power("up")[: len(c)], starts) * _power("down")[starts]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            hashes.append(h)
            places.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), edges)


def words_of(text: str | None) -> np.ndarray:
    return words(pa.array([text], pa.string()))[0]


def answer_of(text: str) -> str:
    """The last sentence of an item."""
    said = [s for s in re.split(r"[.?!\n]+", text) if any(ch.isalnum() for ch in s)]
    return said[-1] if said else ""


class Vocabulary:
    """Places of known words, found by the upper bits of the hash and then compared whole."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def __len__(self):
        return len(self.hashes)

    def __getstate__(self):
        return self.hashes

    def __setstate__(self, hashes):
        self.hashes = hashes

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each word, or the number of words for an unknown one."""
        n, shift = len(self.hashes), np.uint64(64 - SLOTS)
        if not hasattr(self, "slots"):
            own = self.hashes >> shift
            self.slots = np.full(1 << SLOTS, n, np.int32)
            self.slots[own] = np.arange(n)
            self.shared = set(own[1:][own[1:] == own[:-1]].tolist())
            self.padded = np.r_[self.hashes, np.uint64(0)]
        slot = h >> shift
        out = self.slots[slot]
        wrong = np.flatnonzero((out < n) & (self.padded[out] != h))
        out[wrong] = n
        # words that share a slot are looked up by search
        if self.shared and len(wrong):
            place = np.minimum(np.searchsorted(self.hashes, h[wrong]), n - 1)
            right = self.hashes[place] == h[wrong]
            out[wrong[right]] = place[right]
        return out


def common(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by one big number per row of the table."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, row = (1 << len(item)) - 1, (1 << len(item)) - 1
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by one sort: of millions, `np.unique` hashes each first."""
    out = np.sort(numbers)
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    return out[first]


def common_each(items: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each row of `items` the length of the longest common subsequence with its words `place[start:end]`.

    As `common`, a step of all rows at once. A row has at most 62 words, -1 after its end.
    """
    full = (np.int64(1) << (items >= 0).sum(axis=1)) - 1
    row, words = full.copy(), [np.ascontiguousarray(w) for w in items.T.astype(place.dtype)]
    for k in range(int((end - start).max(initial=0))):
        there = start + k < end
        w = np.where(there, place[np.where(there, start + k, 0)], -2)
        m = np.zeros(len(row), np.int64)
        for j, own in enumerate(words):
            m |= (own == w).astype(np.int64) << j
        u = row & m
        row = ((row + u) | (row - u)) & full
    return np.bitwise_count(full) - np.bitwise_count(row).astype(np.int64)


def pieces(length: int, most: int = PIECE_WORDS) -> list[tuple[int, int]]:
    """Begin and end of the nearly equal pieces of an item."""
    n = max(1, -(-length // most))
    return [(length * k // n, length * (k + 1) // n) for k in range(n)]


class Rare:
    """An inverted index on the rarest words of every piece of every item.

    At most (1 - lcs) of a piece's words may be missing, so of that many and `need` more
    at least `need` are there. Items of fewer than `least` words miss none.
    """

    def __init__(self, items: list, df: np.ndarray, lcs: float, least: int):
        self.of, self.parts, need, posts = [], [], [], []
        for k, (_, item, _) in enumerate(items):
            for lo, hi in pieces(len(item)):
                own = item[lo:hi]
                miss = 0 if len(item) < least else len(own) - int(np.ceil(lcs * len(own) - 1e-9))
                must = min(3, len(own) - miss)
                # the word of every position; one that comes twice counts twice
                kept = own[np.lexsort((own, df[own]))[: miss + must]]
                posts += [(int(w), len(self.of), int(c)) for w, c in zip(*np.unique(kept, return_counts=True))]
                self.of.append(k)
                self.parts.append((lo, hi))
                need.append(must)
        self.need = np.array(need)
        # the words of every piece, -1 after its end
        self.words = np.full((len(self.of), PIECE_WORDS), -1, np.int64)
        for own, k, (lo, hi) in zip(self.words, self.of, self.parts):
            own[: hi - lo] = items[k][1][lo:hi]
        post = np.array(posts, np.int64).reshape(-1, 3)
        self.owner, self.weight = post[:, 1], post[:, 2]
        # postings are numbered by piece; of each word, where its numbers are in `numbers`
        self.numbers = np.argsort(post[:, 0], kind="stable")
        self.edges = np.searchsorted(post[self.numbers, 0], np.arange(len(df) + 2))

    def find(self, place: np.ndarray, edges: np.ndarray, stride: int) -> list[tuple[int, int, int]]:
        """(text, piece, first word) wherever enough of a piece's words stand in two blocks of `stride` words."""
        sizes = np.diff(self.edges)
        hit = np.flatnonzero(sizes[place])
        if not len(hit):
            return []
        # as in `candidates`: blocks of words, with an empty block between texts
        blocks = -(-np.diff(edges) // stride) + 1
        begin = np.r_[0, np.cumsum(blocks)]
        text = np.searchsorted(edges, hit, side="right") - 1
        cell = begin[text] + (hit - edges[text]) // stride
        posted, out, total, at, before = np.r_[0, np.cumsum(sizes[place[hit]])], [], len(self.numbers), 0, -2
        while at < len(hit):
            # whole blocks, and the next one for the last pair
            end = min(len(hit), max(at + 1, int(np.searchsorted(posted, posted[at] + POSTINGS))))
            last = int(cell[end - 1])
            end, reach = np.searchsorted(cell, (last + 1, last + 2))
            n = sizes[place[hit[at:reach]]]
            where = np.repeat(cell[at:reach], n)
            shift = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
            number = self.numbers[np.repeat(self.edges[place[hit[at:reach]]], n) + shift]
            # a pair of blocks is named by its first; each posting counts once in it
            keys = distinct(where * total + number)
            keys = distinct(np.r_[keys - total, keys])
            pair, number = keys // total, keys % total
            own = (pair > before) & (pair <= last)
            pair, number = pair[own], number[own]
            run = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (self.owner[number[1:]] != self.owner[number[:-1]])]) if len(pair) else []
            if len(run):
                there = np.add.reduceat(self.weight[number], run)
                piece = self.owner[number[run]]
                w, piece = pair[run][good := there >= self.need[piece]], piece[good]
                t = np.maximum(0, np.searchsorted(begin, w, side="right") - 1)
                own = w < begin[t + 1] - 1
                out += zip(t[own].tolist(), piece[own].tolist(), (np.maximum(0, w - begin[t])[own] * stride).tolist())
            at, before = int(end), last
        return out


@dataclass
class Index:
    """What a task needs to search a block of the benchmark."""

    items: list[tuple[int, np.ndarray, np.ndarray]]  # id, words, words of the answer
    vocabulary: Vocabulary
    weighted: np.ndarray  # the words that count in the latent space
    vectors: np.ndarray  # of each word, weighted
    passages: np.ndarray  # latent, of length one
    of: np.ndarray  # the item of each passage
    window: int
    stride: int
    cosine: float
    held: np.ndarray  # the least share of each passage's weight that a candidate holds, as a product
    lcs: float
    sure: float
    answer: float
    least: int
    rare: Rare

    def candidates(self, place: np.ndarray, edges: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By text, the (item, first word) of its passages above the thresholds."""
        found: dict[int, list[tuple[int, int]]] = {}
        s, per = self.stride, self.window // self.stride
        hit = np.flatnonzero(self.weighted[place])
        if not len(hit) or not len(self.passages):
            return found
        # texts are laid out in blocks of `stride` words, with empty blocks between them
        blocks = -(-np.diff(edges) // s) + per - 1
        begin = np.r_[0, np.cumsum(blocks)]
        text = np.searchsorted(edges, hit, side="right") - 1
        cell = begin[text] + (hit - edges[text]) // s
        for at in range(0, int(begin[-1]), COMPARED):
            end = min(at + COMPARED + per - 1, int(begin[-1]))
            lo, hi = np.searchsorted(cell, (at, end))
            if lo == hi:
                continue
            own = cell[lo:hi] - at
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sums = np.zeros((end - at + per - 1, self.vectors.shape[1]), np.float32)
            sums[own[starts]] = np.add.reduceat(self.vectors[place[hit[lo:hi]]], starts, axis=0)
            wide = sum(sums[k : k + min(COMPARED, end - at)] for k in range(per))
            dot = wide @ self.passages.T
            rows, cols = np.nonzero(dot >= self.held)
            near = dot[rows, cols] >= self.cosine * np.linalg.norm(wide[rows], axis=1)
            for w, p in zip((rows[near] + at).tolist(), cols[near].tolist()):
                t = int(np.searchsorted(begin, w, side="right")) - 1
                found.setdefault(t, []).append((int(self.of[p]), (w - int(begin[t])) * s))
        return found

    def hits(self, texts: pa.Array) -> dict[int, list[tuple[int, float, float, int]]]:
        """By text, the (item, LCS share, answer share, first word) of every item it holds."""
        hashed, edges = words(texts)
        place = self.vocabulary.find(hashed)
        found = {t: set(near) for t, near in self.candidates(place, edges).items()}
        near = self.rare.find(place, edges, self.stride)
        for at in range(0, len(near), TOGETHER):
            for t, p, first in self.there(near[at : at + TOGETHER], place, edges):
                found.setdefault(t, set()).add((self.rare.of[p], first))
        out = {}
        for t, near in sorted(found.items()):
            own, best = place[edges[t] : edges[t + 1]], {}
            for k, at in sorted(near):
                made = self.compare(k, own, at)
                if made and (k not in best or made[0] > best[k][0]):
                    best[k] = made
            if best:
                out[t] = [(self.items[k][0], *v) for k, v in sorted(best.items())]
        return out

    def there(self, near: list[tuple[int, int, int]], place: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """The (text, piece, first word) whose piece is there, by `lcs`, in the two blocks."""
        t, p, at = np.array(near, np.int64).reshape(-1, 3).T
        start = edges[t] + at
        n = common_each(self.rare.words[p], place, start, np.minimum(start + 2 * self.stride, edges[t + 1]))
        good = n >= self.lcs * (self.rare.words[p] >= 0).sum(axis=1) - 1e-9
        return [near[k] for k in np.flatnonzero(good).tolist()]

    def compare(self, k: int, text: np.ndarray, at: int) -> tuple[float, float, int] | None:
        """The shares of an item and of its answer around a passage, if they suffice.

        They do if the item is there, by `lcs` with its answer or by `sure`; if it is there in
        another order, its quarters or halves counted one by one, by `sure`, or by `lcs` with an
        answer of four words or more by `sure`; or if two neighbouring pieces of it are, by `sure`.
        """
        _, item, answer = self.items[k]
        lo = max(0, at - len(item))
        region = text[lo : at + self.window + len(item)]
        n = common(item, region)
        share = n / len(item)
        if len(item) < self.least:
            if share < 1 or not any(np.array_equal(region[i : i + len(item)], item) for i in range(len(region))):
                return None
            return (share, common(answer, region) / len(answer) if len(answer) else 1.0, lo)
        there = common(answer, region) / len(answer) if len(answer) else 1.0
        if share >= self.sure or share >= self.lcs and there >= self.answer:
            return (share, there, lo)
        parts = min(4, len(item) // self.least)
        if parts > 1 and share >= self.lcs / parts:
            turned = sum(common(item[a:b], region) for a, b in pieces(len(item), -(-len(item) // parts))) / len(item)
            if turned >= self.sure or turned >= self.lcs and there >= self.sure and len(answer) >= 4:
                return (share, there, lo)
        cut = pieces(len(item))
        if len(cut) > 2:
            near = text[max(0, at - self.stride) : at + self.window + self.stride]
            for (a, _), (_, b) in zip(cut, cut[1:]):
                if n >= self.sure * (b - a) and common(item[a:b], near) >= self.sure * (b - a):
                    return (share, there, lo)
        return None


def _sparse(place: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx, n = np.unique(place[place < len(idf)], return_counts=True)
    x = n * idf[idx]
    return idx, x / max(np.linalg.norm(x), 1e-12)


def _common(cut: list[tuple[int, np.ndarray]], frequent: np.ndarray) -> np.ndarray:
    """The frequent words that carry no weight."""
    out = frequent.copy()
    for _, place in cut:
        if (~frequent[place]).sum() < 5:
            out[place] = False
    return np.flatnonzero(out)


def right_vectors(rows: DataFrame, terms: int, rank: int, extra: int = 10, power: int = 2, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the sparse rows (idx, val binary).

    Randomised range finding with `power` further rounds. In each round tasks form their
    part of A'(AQ), sums meet by block of 1,024 terms, and the driver orthonormalises a
    matrix of terms x (rank + extra).
    """
    width = max(1, min(rank + extra, terms))
    q = np.random.default_rng(seed).standard_normal((terms, width))
    for _ in range(power + 1):
        q, _ = np.linalg.qr(q)
        width = q.shape[1]
        shared = rows.sparkSession.sparkContext.broadcast(q)

        def part(batches):
            z = np.zeros((terms, shared.value.shape[1]))
            for b in batches:
                for idx, val in zip(b.column(0), b.column(1)):
                    i, v = np.frombuffer(idx.as_py(), np.int64), np.frombuffer(val.as_py())
                    z[i] += np.outer(v, v @ shared.value[i])
            blocks = [(s, z[s : s + 1024].tobytes()) for s in range(0, terms, 1024)]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], ["slot", "z"])

        def add(pdf):
            total = sum(np.frombuffer(z) for z in pdf["z"])
            return pdf.head(1).assign(z=total.tobytes())

        parts = rows.mapInArrow(part, "slot int, z binary").groupBy("slot").applyInPandas(add, "slot int, z binary").collect()
        before, q = q, np.zeros((terms, width))
        for r in parts:
            block = np.frombuffer(r["z"]).reshape(-1, width)
            q[r["slot"] : r["slot"] + len(block)] = block
        shared.unpersist()
    # before' (A'A before) is small; its eigenvectors turn the basis to singular vectors
    size, turn = np.linalg.eigh(before.T @ q)
    keep = np.argsort(-size)[: min(rank, int((size > 1e-9 * max(size.max(), 1e-300)).sum()))]
    return before @ turn[:, keep]


def frequencies(docs: DataFrame, text: str, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each word occurs: over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v, rows = shared.value, 0
        n = np.zeros(len(v) + 1, np.int64)
        for b in batches:
            hashed, edges = words(b.column(0))
            # of every text, each known word once
            place = v.find(hashed)
            known = np.flatnonzero(place < len(v))
            text = np.searchsorted(edges, known, side="right") - 1
            n += np.bincount(distinct(text * (len(v) + 1) + place[known]) % (len(v) + 1), minlength=len(v) + 1)
            rows += b.num_rows
        n[-1] = rows
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], ["word", "n"])

    parts = columns(docs, text=text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in parts.collect():
        df[r["word"]] = r["n"]
    return int(df[-1]), df[:-1]


def fit(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
    rank: int = 96,
    window: int = 48,
    stride: int = 24,
    cosine: float = 0.5,
    held: float = 0.35,
    lcs: float = 0.65,
    sure: float = 0.8,
    answer_share: float = 0.5,
    least: int = 8,
    common_share: float = 0.1,
    block: int = 5000,
) -> list[Index]:
    """One index for each `block` items of the benchmark, in order of their ids, null ids last.

    An item with a null id counts like any other. An id with several texts stands for each of
    them. Items without words are left out. Items of fewer than `least` words count only where
    all their words follow one another. Words in more than `common_share` of the documents
    carry no weight in the latent space (they do count in the comparison of words), unless
    a passage would be left with fewer than five words that carry weight.
    """
    given = columns(benchmark, item=item, text=item_text, **({"answer": answer} if answer else {}))
    given = given.where(F.col("text").isNotNull()).dropDuplicates()
    kind = given.schema["item"].dataType
    # null ids come last; the hash tells several texts of one id apart
    given = given.withColumn("none", F.col("item").isNull()).withColumn("said", F.sha2(F.to_json(F.struct(*given.columns)), 256))
    indexes, done = [], None
    while True:
        # the benchmark is read a block at a time: the driver never holds more of it
        left = given
        if done is not None:
            seen = F.struct(F.lit(done["none"]), F.lit(done["item"]).cast(kind), F.lit(done["said"]))
            left = given.where(F.struct("none", "item", "said") > seen)
        rows = left.orderBy("none", "item", "said").limit(block).collect()
        if not rows:
            return indexes
        done = rows[-1]
        hashed = [(r["item"], words_of(r["text"]), words_of(r["answer"] if answer else answer_of(r["text"]))) for r in rows]
        hashed = [x for x in hashed if len(x[1])]
        if not hashed:
            continue
        vocabulary = Vocabulary(np.unique(np.concatenate([x[1] for x in hashed])))
        n, df = frequencies(docs, text, vocabulary)
        idf = np.log((n + 1) / (df + 1)) + 0.01
        items = [(i, vocabulary.find(w), vocabulary.find(a)) for i, w, a in hashed]
        cut = [(k, w[s : s + window]) for k, (_, w, _) in enumerate(items) for s in range(0, max(1, len(w) - window // 2), window // 2)]
        idf[_common(cut, df > common_share * n)] = 0
        sparse = [_sparse(p, idf) for _, p in cut]
        frame = docs.sparkSession.createDataFrame([(i.astype(np.int64).tobytes(), x.tobytes()) for i, x in sparse], "idx binary, val binary")
        v = right_vectors(frame.repartition(max(1, len(sparse) // 500)), len(vocabulary), rank)
        weighted = np.r_[idf > 0, False]
        vectors = np.vstack([v * idf[:, None], np.zeros((1, v.shape[1]))]).astype(np.float32)
        latent = np.array([vectors[p].sum(axis=0) for _, p in cut])
        size = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
        latent /= size[:, None]
        indexes.append(
            Index(items, vocabulary, weighted, vectors, latent.astype(np.float32), np.array([k for k, _ in cut]), window, stride, cosine, (held * size).astype(np.float32), lcs, sure, answer_share, least, Rare(items, df, lcs, least))
        )


def search(docs: DataFrame, index: Index, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, lcs, answer, first_word) for every item found in a document.

    Null and empty texts hold nothing, an empty table gives an empty table, repeated rows
    are reported each, very long texts are read in bounded parts. Other columns play no part.
    """
    rows = columns(docs, doc_id=id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [(t, *h) for t, found in sorted(shared.value.hits(b.column(1)).items()) for h in found]
            ids = b.column(0).take(pa.array([r[0] for r in out], pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
            cols = [pa.array([r[k + 1] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "item_id", "lcs", "answer", "first_word"])

    return rows.mapInArrow(run, f"doc_id {kind}, item_id long, lcs double, answer double, first_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Every (document, item) hit, for all blocks of the benchmark."""
    found = None
    for index in fit(docs, benchmark, **how):
        hits = search(docs, index)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, lcs double, answer double, first_word long")
    return found


def clean(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, that hold no item of the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            found = shared.value.hits(b.column(at))
            yield b.filter(pa.array([t not in found for t in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
