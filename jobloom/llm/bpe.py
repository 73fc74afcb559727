"""Byte-level BPE encoding and decoding without a regex.

Pre-tokenisation is vectorised.  Every code point gets a class (letter,
number, white space, other), refined by a look at its neighbours; the classes
drive a small automaton whose transition functions compose associatively, so
a block of text is scanned as many rows side by side: each row composes its
functions, the row totals are scanned, and a second pass marks the places
where a token starts.  The slices between the marks feed a cached pair
merging that handles all new slices of a batch in one set of arrays.

Edge cases: a null text counts as empty and gives no ids; lone very long
slices are merged with a heap in n log n; ids decode to the input bytes.
"""

import base64
import functools
import heapq
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from jobloom.llm.common import small_batches

OTHER, LETTER, NUMBER, SPACE, BLANK, SHORT, LONG, LAST_SPACE, LAST_BLANK = range(9)
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, OPEN_SPACE, CLOSED_BLANK, ONE_MORE, TWO_MORE, FRESH = range(9)
STATES, SYMBOLS = 9, 18
BLOCK = 1 << 20
CACHE_ENTRIES = 200_000
HEAP_BYTES = 96

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts before this one", by symbol and state."""
    go, starts = np.zeros((SYMBOLS, STATES), np.uint8), np.zeros((SYMBOLS, STATES), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for symbol in range(SYMBOLS):
        kind = symbol % 9
        for state in range(STATES):
            was = FRESH if symbol >= 9 else state
            if kind in runs:
                to, start = runs[kind], was not in (runs[kind], OPEN_SPACE)
                if kind == LETTER and was in (ONE_MORE, TWO_MORE):
                    to, start = (FRESH if was == ONE_MORE else ONE_MORE), False
            elif kind in (SHORT, LONG):
                inside = was in (IN_OTHERS, OPEN_SPACE)
                to, start = (IN_OTHERS if inside else ONE_MORE if kind == SHORT else TWO_MORE), not inside
            elif kind in (SPACE, BLANK):
                to, start = IN_BLANKS, was != IN_BLANKS
            else:
                to, start = (OPEN_SPACE if kind == LAST_SPACE else CLOSED_BLANK), True
            go[symbol, state], starts[symbol, state] = to, start
    return go, starts


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``first`` marks where texts start."""
    n = len(points)
    kind = class_table()[points]
    after = np.zeros(n + 2, np.uint32)
    after[:n] = points
    ends = np.ones(n + 2, bool)
    ends[:n] = first
    one, two = np.where(ends[1:n + 1], 0, after[1:n + 1]), after[2:n + 2]
    two = np.where(ends[1:n + 1] | ends[2:n + 2], 0, two)
    quote = points == 0x27
    short = quote & np.isin(one, [ord(c) for c in "stmd"])
    longer = quote & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    blank = (kind == SPACE) | (kind == BLANK)
    blank_next = np.ones(n, bool)
    blank_next[:-1] = blank[1:] | first[1:]
    last = blank & ~blank_next
    out = np.where(short, SHORT, np.where(longer, LONG, kind))
    out = np.where(last, np.where(kind == SPACE, LAST_SPACE, LAST_BLANK), out)
    return (out + 9 * first).astype(np.uint8)


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start: an associative scan over transition functions."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    go, starts = automaton()
    flat = go.ravel()
    width = max(1, int(n ** 0.5))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = symbols(points, first)
    columns = np.ascontiguousarray(grid.reshape(rows, width).T).astype(np.intp) * STATES
    whole = np.tile(np.arange(STATES, dtype=np.intp), (rows, 1))
    for column in columns:
        whole = flat[column[:, None] + whole].astype(np.intp)
    step = 1
    while step < rows:  # inclusive scan of the row functions by doubling
        later = whole.copy()
        later[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        whole, step = later, step * 2
    state = np.full(rows, FRESH, np.intp)
    state[1:] = whole[:-1, FRESH]
    marks, where = np.empty((width, rows), bool), starts.ravel()
    for j, column in enumerate(columns):
        at = column + state
        marks[j] = where[at]
        state = flat[at].astype(np.intp)
    return marks.T.ravel()[:n]


class Merger:
    """Pair merging by the ranks of a vocabulary file, with a bounded cache."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = {v: k for k, v in self.rank.items()}
        pairs = {}
        for word, rank in self.rank.items():
            for cut in range(1, len(word)):
                a, b = self.rank.get(word[:cut]), self.rank.get(word[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.none = np.int64(1 << 40)
        self.cache: dict[bytes, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.none)

    def learn(self, pieces: list[bytes]) -> None:
        """Put the ids of new pieces into the cache."""
        many = []
        for piece in pieces:
            whole = self.rank.get(piece)
            if whole is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(piece) > HEAP_BYTES:
                self.cache[piece] = np.array(self.merge_long(piece), "<u4").tobytes()
            else:
                many.append(piece)
        if many:
            ids, owner = self.merge_many(many)
            packed = ids.astype("<u4").tobytes()
            ends = np.searchsorted(owner, np.arange(len(many) + 1)) * 4
            for piece, a, b in zip(many, ends.tolist(), ends[1:].tolist()):
                self.cache[piece] = packed[a:b]

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and the piece each belongs to.

        Each round merges, in every unfinished piece, the leftmost pair of least rank.
        """
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done_ids, done_owner = [], []
        rank = np.full(len(ids), self.none)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self.pair_ranks(ids[same], ids[same + 1])
        while len(ids):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[begin, len(ids)])
            least = np.minimum.reduceat(rank, begin)
            active = np.repeat(least < self.none, size)
            if not active.all():
                done_ids.append(ids[~active])
                done_owner.append(owner[~active])
                ids, owner, rank, best = ids[active], owner[active], rank[active], np.repeat(least, size)[active]
            else:
                best = np.repeat(least, size)
            hit = np.flatnonzero((rank == best) & (best < self.none))
            if not len(hit):
                continue
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for side in (at, at[at > 0] - 1):
                rank[side] = self.none
                inner = side[side + 1 < len(ids)]
                inner = inner[owner[inner] == owner[inner + 1]]
                rank[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece, with a heap of pairs over a linked list."""
        part = [bytes([b]) for b in piece]
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (rank := self.rank.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (rank, i, part[i], part[j]))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] == a else -1
            if j < 0 or part[j] != b:
                continue
            part[i], part[j], right[i] = a + b, None, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [self.rank[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids and token offsets (bytes, then the length) of each text."""
        out, block, held = [], [], 0
        for text in texts:
            block.append(text)
            held += len(text)
            if held >= BLOCK:
                out += self.encode_block(block)
                block, held = [], 0
        return out + (self.encode_block(block) if block else [])

    def encode_block(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(len(points), bool)
        first[begins[sizes > 0]] = True
        starts = np.flatnonzero(token_starts(points, first))
        width = np.ones(len(points) + 1, np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width[1:] += points >= limit
        width[0] = 0
        place = np.cumsum(width)
        data, cut = whole.encode(), [*place[starts].tolist(), int(place[-1])]
        pieces = [data[a:b] for a, b in zip(cut, cut[1:])]
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = {p for p in pieces if p not in cache}
        if new:
            self.learn(list(new))
        span = np.searchsorted(starts, np.r_[begins, len(points)]).tolist()
        out = []
        for a, b in zip(span, span[1:]):
            ids = b"".join(map(cache.__getitem__, pieces[a:b]))
            out.append((ids, self.offsets(ids)))
        return out

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        sizes = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            sizes[i] = len(b)
        return sizes

    def offsets(self, ids: bytes) -> bytes:
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        return np.r_[0, ends].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Add the packed ids (32-bit, little-endian) and token byte offsets of every text.

    All columns stay; columns of the two names given are replaced.  ``path``
    names the rank file on every machine.  Texts pass in bounded batches.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, offsets binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(merger(path).encode(texts.fillna("").tolist()), columns=["ids", "offsets"])

    made = docs.withColumn("_encoded", run(F.col(text)))
    return made.withColumns({ids: F.col("_encoded.ids"), offsets: F.col("_encoded.offsets")}).drop("_encoded")


def decoded(ids: Column, path: str) -> Column:
    """The bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def run(packed: pd.Series) -> pd.Series:
        return packed.map(merger(path).decode)

    return run(ids)


def id_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
