"""Byte-level BPE as a tree reduction over halves.

A text is halved at places where no match of the split pattern can lie across, down to
leaves of bounded length; its ids are the concatenation up the tree. Inside a leaf each
match of the pattern is a piece of its own. A piece is halved down to single tokens of the
byte alphabet or short leaves; two neighbours are joined by encoding a window over their
border again, which grows on either side until the token left of it and its first token,
and its last token and the token right of it, are each the encoding of their own bytes.
A row of tokens is the encoding of its bytes if that holds for every two neighbours, so
the tokens outside the window are then final.

Where a piece repeats a few bytes over and over, its tokens follow a cycle that starts at
the head of the run, and a half that started out of step would be encoded anew as a whole.
Such runs are cut where a cycle ends, so windows stay short and long pieces take linear time.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronopanel.llm.common import columns

#: Characters of a text that are split at once; bytes of a piece that are merged at once.
LEAF_TEXT, LEAF = 1 << 16, 6
#: Entries of a generation of the memos of units, pieces and windows; longer keys are not kept.
UNITS, PIECES, WINDOWS, MEMO_KEY = 1 << 17, 1 << 16, 1 << 16, 48
#: Rows encoded before they are handed on.
ROWS = 500
#: Above every rank.
NONE = 1 << 62
#: Bytes from which a window is merged by a heap; bytes from which a piece is searched for a run,
#: the longest repeated unit, bytes looked at, and bytes and tokens in which its cycle must show.
HEAP, RUN, PERIOD, SEEN, HEAD, CYCLE = 96, 64, 16, 24, 1536, 24

#: The characters of Unicode's White_Space, which \\s means in split patterns.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A white space after something else starts a match, whatever follows.
BORDER = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
#: The units between such borders.
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Memo(dict):
    """Results for the keys met last; the older of two generations goes when the younger is full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key) or self.make(key)
        if len(key) <= MEMO_KEY:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        # in other patterns a match may lie across white space: the whole text is one unit then
        self.bordered = pattern == public_tokenizers.PATTERN
        self.cycles: dict[bytes, tuple[int, int]] = {}
        self.units, self.pieces, self.windows = Memo(self.unit, UNITS), Memo(self.piece, PIECES), Memo(self.merged, WINDOWS)

    # -- pieces ----------------------------------------------------------------------

    def merged(self, data: bytes) -> list[bytes]:
        """The direct encoding of a window: lowest rank first, leftmost of equals."""
        if len(data) > HEAP:
            return self.heaped(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        pairs = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NONE)
        # the vocabulary's own objects, so that memos hold no copies
        return [self.bytes[self.ranks[t]] for t in parts]

    def heaped(self, data: bytes) -> list[bytes]:
        """The same for a long window, by a heap of pairs over linked parts."""
        n, get = len(data), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part from i to ends[i]; 0 once it is gone
        heap = [(r, i) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = ends[i]
            # an entry holds if both parts are still those it was made of
            if not j or j >= n or get(data[i : ends[j]]) != rank:
                continue
            end = ends[i] = ends[j]
            ends[j] = 0
            if end < n:
                before[end] = i
                if (r := get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i))
            if i and (r := get(data[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i]))
        out, i = [], 0
        while i < n:
            out.append(self.bytes[self.ranks[data[i : ends[i]]]])
            i = ends[i]
        return out

    def cut(self, data: bytes) -> int:
        """Where to halve: at the end of a cycle of tokens if the middle lies in a run, else in the middle."""
        half = len(data) // 2
        if len(data) < RUN:
            return half
        near = data[half - SEEN : half + SEEN]
        period = next((p for p in range(1, PERIOD + 1) if near[p:] == near[:-p]), 0)
        if not period:
            return half
        start, step = half - SEEN, SEEN
        while step:
            if start >= step and data[start - step : start] == data[start - step + period : start + period]:
                start, step = start - step, 2 * step
            else:
                step //= 2
        lead = min(start, SEEN)
        head = data[start - lead : start + HEAD]
        # halves that begin inside a run ask for the same cycle again and again
        unit = b"" if lead else head[:period]
        if unit not in self.cycles or not unit:
            if len(self.cycles) >= UNITS:
                self.cycles.clear()
            self.cycles[unit] = self.cycle(unit * (HEAD // period) if unit else head)
        first, length = self.cycles[unit]
        at = start - lead + first
        return at + (half - at) // length * length if length and at < half else half

    def cycle(self, head: bytes) -> tuple[int, int]:
        """Where the tokens of a run begin to repeat, and the bytes of one cycle (0: no cycle seen)."""
        tokens = self.heaped(head)
        tokens = tokens[: max(0, len(tokens) - 4)]  # the last ones feel the end
        for first in range(min(CYCLE, len(tokens))):
            for k in range(1, CYCLE):
                row = tokens[first : first + max(3 * k, 4)]
                if len(row) == max(3 * k, 4) and row[k:] == row[:-k]:
                    return len(b"".join(tokens[:first])), len(b"".join(row[:k]))
        return 0, 0

    def final(self, left: bytes, right: bytes) -> bool:
        return self.windows[left + right] == [left, right]

    def tree(self, data: bytes) -> list[bytes]:
        """The encoding of a piece by halves."""
        if len(data) <= LEAF:
            return self.windows[data]
        half = self.cut(data) or len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        a = b = 1
        while True:
            tokens = self.windows[b"".join(left[-a:] + right[:b])]
            # an outermost token that came out as it was is still next to its old neighbour
            left_done = a == len(left) or tokens[0] == left[-a] or self.final(left[-a - 1], tokens[0])
            right_done = b == len(right) or tokens[-1] == right[b - 1] or self.final(tokens[-1], right[b])
            if left_done and right_done:
                return left[:-a] + tokens + right[b:]
            if not left_done:
                a = min(2 * a, len(left))
            if not right_done:
                b = min(2 * b, len(right))

    def piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as bytes; a piece that is a token is that token."""
        data = piece.encode()
        whole = self.ranks.get(data)
        return array("I", [whole] if whole is not None else [self.ranks[t] for t in self.tree(data)]).tobytes()

    def unit(self, unit: str) -> bytes:
        """The ids of a text between two borders, as bytes."""
        return b"".join([self.pieces[match] for match in self.pattern.findall(unit)])

    # -- texts -----------------------------------------------------------------------

    def leaves(self, text: str, lo: int, hi: int) -> Iterable[str]:
        """The text in order, halved at borders of pieces."""
        stack = [(lo, hi)]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= LEAF_TEXT:
                yield text[lo:hi]
                continue
            half = (lo + hi) // 2
            cut = BORDER.search(text, half, hi) or BORDER.search(text, lo + 1, half)
            if cut is None:
                yield text[lo:hi]
            else:
                stack += [(cut.start(), hi), (lo, cut.start())]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not self.bordered:
            return self.unit(text)
        of = self.units.__getitem__
        return b"".join([b"".join(map(of, UNIT.findall(leaf))) for leaf in self.leaves(text, 0, len(text))])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an unknown id is an error."""
        if len(ids) <= 4 * LEAF_TEXT:
            return b"".join([self.bytes[i] for i in memoryview(ids).cast("I")])
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


CODECS: dict[tuple[str, str], Codec] = {}


def _mapped(df: DataFrame, ranks_path: str, pattern: str, source: str, steps: tuple[tuple[str, str], ...]) -> DataFrame:
    """`df` with a binary column for each (step, name), made from `source` and then from the last one.

    The vocabulary, of fixed size, is read here and broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    at, key = df.columns.index(source), (ranks_path, pattern)

    def run(batches):
        # a worker keeps its codec, with what it remembers, from task to task
        codec = CODECS.get(key) or CODECS.setdefault(key, Codec(ranks.value, pattern))
        for batch in batches:
            for b in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
                made, last = [], b.column(at)
                for step, _ in steps:
                    if step == "encode":
                        last = pa.array([codec.encode(t.as_py() or "") for t in last], pa.binary())
                    else:
                        last = pa.array([codec.decode(t.as_py() or b"") for t in last], pa.binary())
                    made.append(last)
                yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *(n for _, n in steps)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, ", ".join([schema, *(f"`{n}` binary" for _, n in steps)]))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids (little-endian unsigned 32-bit numbers) of every whole text.

    The same ids as the public library gives without special tokens: their strings are
    ordinary text. Null and empty texts have no ids. Repeated rows each get a row, an empty
    table gives an empty table, other columns play no part.
    """
    rows = columns(docs, doc_id=id, text=text)
    return _mapped(rows, ranks_path, pattern, "text", (("encode", "ids"),)).select("doc_id", "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`encoded` (any columns with `ids`) and `decoded`, the bytes the ids stand for.

    Bytes, since an encoding may be cut inside a character. Null ids give no bytes; an
    unknown id is an error.
    """
    return _mapped(encoded, ranks_path, pattern, "ids", (("decode", "decoded"),))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and decoded: `encode` and then `decode` in one pass of the same workers."""
    rows = columns(docs, doc_id=id, text=text)
    return _mapped(rows, ranks_path, pattern, "text", (("encode", "ids"), ("decode", "decoded"))).select("doc_id", "ids", "decoded")
