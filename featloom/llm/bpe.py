"""Byte-level BPE encoding and decoding.

Pre-tokenisation without regular expressions: every code point becomes a small class code (with one code point of
look-ahead folded in), classes become elements of the monoid of a small automaton's transition functions, and an
associative scan of those elements gives the automaton's state before each code point. A table over (state, class)
then says where pieces begin. The slices go to a cached pair merging; decoding uses the ids alone.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

# Class codes of a code point: letters that may end a contraction, other letters, numbers, other, apostrophe,
# the plain space and other white space, the last two split by whether a code point that isn't white space follows.
LETTER, ONE, PAIR, SECOND, NUMBER, OTHER, QUOTE, SPACE_LAST, SPACE, WHITE_LAST, WHITE = range(11)
CLASSES = 11
# States: what was read last.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, FRESH_QUOTE, PAIR_OPEN, DONE, AFTER_SPACE, AFTER_WHITE = range(9)
STATES = 9
#: Unicode's White_Space. Fixed values of the property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[state, class] and begins[state, class]: whether a piece begins at a code point of that class."""
    step = np.zeros((STATES, CLASSES), np.int8)
    begins = np.zeros((STATES, CLASSES), bool)
    for s in range(STATES):
        for c in range(CLASSES):
            if c <= SECOND:
                step[s, c] = IN_LETTERS
                begins[s, c] = s not in (IN_LETTERS, AFTER_SPACE)
                if s == FRESH_QUOTE and c == ONE:
                    step[s, c], begins[s, c] = DONE, False
                elif s == FRESH_QUOTE and c == PAIR:
                    step[s, c], begins[s, c] = PAIR_OPEN, False
                elif s == PAIR_OPEN:
                    step[s, c], begins[s, c] = DONE, False
            elif c == NUMBER:
                step[s, c], begins[s, c] = IN_NUMBERS, s not in (IN_NUMBERS, AFTER_SPACE)
            elif c == OTHER:
                step[s, c], begins[s, c] = IN_OTHER, s not in (IN_OTHER, FRESH_QUOTE, AFTER_SPACE)
            elif c == QUOTE:
                fresh = s not in (IN_OTHER, FRESH_QUOTE, AFTER_SPACE)
                step[s, c], begins[s, c] = FRESH_QUOTE if fresh else IN_OTHER, fresh
            elif c in (SPACE_LAST, WHITE_LAST):
                step[s, c], begins[s, c] = AFTER_SPACE if c == SPACE_LAST else AFTER_WHITE, True
            else:
                step[s, c], begins[s, c] = AFTER_WHITE, s != AFTER_WHITE
    return step, begins


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that products of classes give: of each class, products, value at START, constancy."""
    step, begins = _automaton()
    found: dict[tuple[int, ...], int] = {}
    order: list[tuple[int, ...]] = []

    def of(f: tuple[int, ...]) -> int:
        if f not in found:
            found[f] = len(order)
            order.append(f)
        return found[f]

    one = [of(tuple(int(x) for x in step[:, c])) for c in range(CLASSES)]
    done = 0
    while done < len(order):  # closed under one more class on the right
        for c in range(CLASSES):
            of(tuple(int(step[x, c]) for x in order[done]))
        done += 1
    product = np.array([[found[tuple(g[x] for x in f)] if tuple(g[x] for x in f) in found else -1 for g in order] for f in order], np.int16)
    assert (product >= 0).all()
    return np.array(one, np.int16), product, np.array([f[START] for f in order], np.int8), np.array([len(set(f)) == 1 for f in order]), begins


@lru_cache(1)
def _class_of() -> np.ndarray:
    """Class of every code point, before look-ahead."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    out[ord("'")] = QUOTE
    for x in "stmd":
        out[ord(x)] = ONE
    return out


def piece_starts(text: str) -> np.ndarray:
    """Code-point offsets at which pieces begin."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.empty(0, np.int64)
    one, product, at_start, constant, begins = _monoid()
    kind = _class_of()[cp]
    white = kind >= SPACE_LAST
    last = white[:-1] & ~white[1:]
    kind[:-1][last] -= 1
    nxt = cp[1:]
    for a, b in (("r", "e"), ("v", "e"), ("l", "l")):
        kind[:-1][(cp[:-1] == ord(a)) & (nxt == ord(b))] = PAIR
    # inclusive scan by doubling; it ends as soon as every product is a constant function or reaches the beginning
    f = one[kind]
    reach = 1
    while True:
        open_ = np.flatnonzero(~constant[f[reach:]])
        if not len(open_):
            break
        g = f.copy()
        at = open_ + reach
        g[at] = product[f[at - reach], f[at]]
        f, reach = g, 2 * reach
    state = np.empty(len(cp), np.int8)
    state[0], state[1:] = START, at_start[f[:-1]]
    return np.flatnonzero(begins[state, kind])


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of lowest rank is joined, the leftmost of equals first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n > 400:
        return _merge_long([piece[i : i + 1] for i in range(n)], ranks)
    none, get = 1 << 60, ranks.get
    at = list(range(n + 1))  # where the parts begin, and the end
    scores = [get(piece[i : i + 2], none) for i in range(n - 1)]
    while scores:
        low = min(scores)
        if low == none:
            break
        i = scores.index(low)
        del at[i + 1], scores[i]
        if i:
            scores[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
        if i < len(scores):
            scores[i] = get(piece[at[i] : at[i + 2]], none)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pieces whose length would make the plain loop quadratic."""
    import heapq

    n = len(parts)
    left, right, text = list(range(-1, n - 1)), [*range(1, n), -1], list(parts)
    heap = [(r, i, text[i] + text[i + 1]) for i in range(n - 1) if (r := ranks.get(text[i] + text[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if text[i] is None or (j := right[i]) < 0 or text[i] + text[j] != joined:
            continue
        text[i], text[j] = joined, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] >= 0 and (r := ranks.get(text[a] + text[right[a]])) is not None:
                heapq.heappush(heap, (r, a, text[a] + text[right[a]]))
    return [ranks[x] for x in text if x is not None]


class Codec:
    """Encoder and decoder over a rank file. Pieces are cached in two generations of cache_size each: when the young one
    is full it becomes the old one, so pieces that keep coming stay."""

    def __init__(self, path: str, cache_size: int = 250_000):
        self.ranks, self.young, self.old, self.cache_size = load_ranks(path), {}, {}, cache_size
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys()))

    def pieces(self, text: str) -> list[str]:
        at = piece_starts(text).tolist()
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]

    def _missing(self, piece: str) -> list[int]:
        ids = self.old.get(piece)
        if ids is None:
            ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) < 64:
            if len(self.young) >= self.cache_size:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        found = list(map(self.young.get, pieces))
        if None in found:
            found = [self._missing(x) if ids is None else ids for x, ids in zip(pieces, found)]
        return list(chain.from_iterable(found))

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and the byte offset in the UTF-8 text at which each begins."""
        ids = self.encode(text)
        ends = np.cumsum([0, *(len(self.bytes_of[x]) for x in ids)])
        return ids, ends[:-1].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, ranks_path: str, keep_ids: bool = True, keep_offsets: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and offsets (byte offsets), arrays of int.

    ranks_path must be readable on every executor (an installed package's file). Null and empty texts have no ids and
    the hashes of the empty string; a null doc_id stays; repeated rows give repeated results; no table is shuffled."""
    more = ["ids"] * keep_ids + ["offsets"] * keep_offsets
    kind = ", ".join(["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *(f"{x} array<int>" for x in more)])
    types = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * len(more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and a collection walks through the whole cache
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        digits = [str(i) for i in range(max(c.bytes_of, default=-1) + 1)]
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                rows = []
                for text in b.column("text").to_pylist():
                    ids = c.encode(text)
                    row = [len(ids), hashlib.sha256(" ".join([digits[x] for x in ids]).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()]
                    if keep_ids:
                        row.append(np.array(ids, np.int32))
                    if keep_offsets:
                        row.append(np.cumsum([0, *(len(c.bytes_of[x]) for x in ids)])[:-1].astype(np.int32))
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more])

    return documents(docs).mapInArrow(run, kind)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of rows with ids; bytes that aren't UTF-8 become U+FFFD; null ids give ""."""

    def run(batches):
        c = codec(ranks_path)
        for batch in batches:
            texts = [c.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
