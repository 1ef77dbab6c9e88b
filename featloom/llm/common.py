"""What the operators of this subpackage share: cutting lineage, reading tables, word hashes over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of the array code takes; a longer document is a pass of its own.
PASS_BYTES = 1 << 18
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long, text as string with "" for null, and the columns asked for; other columns go."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


@lru_cache(None)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.empty(size + 1, U64)
        p[0], n = 1, 1
        while n <= size:
            m = min(n, size + 1 - n)
            p[n : n + m] = p[:m] * U64(pow(b, n, 1 << 64))
            n += m
        both.append(p)
    return both[0], both[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _tables(PASS_BYTES) if size <= PASS_BYTES else _tables.__wrapped__(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A finishing bijection on 64-bit hashes."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space that ends a word: space and \t \n \v \f \r.
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))


def passes(batch_text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about PASS_BYTES, without copying the batch."""
    text = batch_text.cast(pa.large_string()) if not pa.types.is_large_string(batch_text.type) else batch_text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PASS_BYTES, "right")) - 1)
        end = min(end, len(text))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for every row the index of its first word (one more at the end)."""
    inside = is_word[raw]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin = inside & ~before
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = True, ~inside[1:] | begin[1:]
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lut: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of every word, its bytes mapped by lut."""
    p, inverse = powers(len(raw))
    total = np.empty(len(raw) + 1, U64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[lut][raw] * p[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


_STEP = mix(np.arange(101, 165, dtype=U64)) | U64(1)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = words[:m] * _STEP[0]
    for k in range(1, n):
        out += words[k : k + m] * _STEP[k % 64]
    return mix(out)


def hashed_words(batch_text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes of its lower-cased words) for every row of the batch."""
    for at, end, raw, offsets in passes(batch_text):
        starts, ends, row = word_spans(raw, offsets)
        words = word_hashes(raw, starts, ends) if len(starts) else np.empty(0, U64)
        for i in range(end - at):
            yield at + i, words[row[i] : row[i + 1]]


