"""Language-model scores by stupid backoff.

The count tables of all n-grams (n up to 3) are partitioned by the top bits of the n-grams' hashes. Documents travel in
chunks, and a chunk sends each partition one block with its distinct n-grams in ascending order, so that an n-gram that
is everywhere is one entry per chunk and not a row per occurrence. Two rounds keep the blocks small: at first short
fingerprints, which tell what no other chunk has (its count is the chunk's own); then, of the rest only, whole hashes and
counts, which come back as the corpus counts in the same order. The chunk's n-grams are then exploded again, joined to
their counts by position, and summed per document.

score of w3 after w1 w2: c(w1 w2 w3) / c(w1 w2) if the trigram's count is at least min_count, else 0.4 times
c(w2 w3) / c(w2) if the bigram's is, else 0.16 c(w3) / N. The first word of a text has only the last, without the
factor of the levels it can't have; the second word begins with the bigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, documents, hashed_words, windows

ORDER = 3
BACKOFF = 0.4
CHUNK_BYTES = 8 << 20
#: Bytes of text that a partition of the count tables stands for, at most about: a task holds its n-grams.
PARTITION_BYTES = 16 << 20


def _pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values: the first, then differences of a fixed number of bytes."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, U64)
    width = data[0]
    cols = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(cols), 8), np.uint8)
    out[:, :width] = cols
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    return np.cumsum(out.view("<u8").ravel(), dtype=U64)


def _pack_counts(c: np.ndarray) -> bytes:
    """One byte for each count; 255 stands for the next of the 8-byte counts at the end."""
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<i8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(data, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(data, "<i8", offset=n)
    return c


def _ngrams(text: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n the hashes of all texts' n-grams, the low two bits of which say n, and words per text."""
    grams: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
    n = []
    for _, words in hashed_words(text):
        n.append(len(words))
        for k in range(ORDER):
            grams[k].append(windows(words, k + 1))
    tag = lambda g, k: (np.concatenate(g) if g else np.empty(0, U64)) & ~U64(3) | U64(k + 1)
    return [tag(g, k) for k, g in enumerate(grams)], np.array(n, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """chunk long, docs binary: (doc_id, text) of the chunk as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        seq = 0

        def close() -> pa.RecordBatch:
            nonlocal seq
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(kept)
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

        size = 0
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                b = batch.slice(part, 500)
                text = b.column("text")
                if size >= CHUNK_BYTES:
                    yield close()
                    kept, size = [], 0
                kept.append(b)
                size += sum(x.as_py() or 0 for x in pa.compute.binary_length(text))
        if kept:
            yield close()

    return documents(docs).mapInArrow(run, "chunk long, docs binary")


def _texts(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


@dataclass
class Chunk:
    """A chunk's distinct n-grams (u, ascending) and how often it has each (c)."""

    u: np.ndarray
    c: np.ndarray
    n_words: int

    @staticmethod
    def of(data: bytes) -> Chunk:
        grams, n = _ngrams(_column(_texts(data), "text"))
        return Chunk(*Chunk.distinct(np.concatenate(grams)), int(n.sum()))

    @staticmethod
    def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct values and their counts; values is sorted in place."""
        values.sort()
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
        return values[first], np.diff(np.append(first, len(values)))

    def split(self, values: np.ndarray, bits: int) -> list[tuple[int, int]]:
        """Ranges of ascending hashes by partition."""
        at = np.searchsorted(values >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
        return list(zip(at[:-1].tolist(), at[1:].tolist()))

    def shared(self, answers: list, width: int, bits: int) -> np.ndarray:
        """Which n-grams may occur elsewhere or do occur here again. answers: of the first round, by partition."""
        f, _ = Chunk.distinct(self.u >> U64(64 - width))
        flags = np.concatenate([np.unpackbits(np.frombuffer(a["data"], np.uint8), count=a["n"]) for a in sorted(answers, key=lambda a: a["part"])]).astype(bool)
        return flags[np.searchsorted(f, self.u >> U64(64 - width))] | (self.c > 1)

    def scores(self, data: bytes, count: np.ndarray, total: int, min_count: int) -> pa.Table:
        """Of the chunk's texts, the n-grams of which are looked up one order after the other."""
        table = _texts(data)
        grams, n = _ngrams(_column(table, "text"))
        ends = np.cumsum([len(g) for g in grams])
        c = np.concatenate([count[np.searchsorted(self.u, g)] for g in grams])
        del grams
        c1, c2, c3 = c[: ends[0]], c[ends[0] : ends[1]], c[ends[1] :]
        row = np.concatenate(([0], np.cumsum(n)))
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(doc)) - row[doc]
        second, third = place >= 1, place >= 2
        first2, first3 = (np.concatenate(([0], np.cumsum(np.maximum(n - k, 0)))) for k in (1, 2))
        # the n-gram that ends at a word, and the bigram before it
        big, tri, context = (np.zeros(len(doc), np.int64) for _ in range(3))
        big[second], tri[third] = c2[(first2[doc] + place - 1)[second]], c3[(first3[doc] + place - 2)[third]]
        context[third] = c2[(first2[doc] + place - 2)[third]]
        before = np.concatenate(([0], c1[:-1])) if len(c1) else c1
        by3 = third & (tri >= min_count)
        by2 = second & ~by3 & (big >= min_count)
        value = np.log(np.maximum(c1, 1)) - np.log(max(total, 1)) + np.log(BACKOFF) * np.minimum(place, 2)
        value[by2] = np.log(big[by2]) - np.log(before[by2]) + np.log(BACKOFF) * third[by2]
        value[by3] = np.log(tri[by3]) - np.log(context[by3])
        sums = lambda v: np.bincount(doc, weights=v, minlength=len(n))
        out = [_column(table, "doc_id"), pa.array(n), *(pa.array(sums(x).astype(np.int64)) for x in (by3, by2, ~by3 & ~by2)), pa.array(np.round(sums(value), 4) + 0.0)]
        return pa.Table.from_arrays(out, names=["doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", "score"])


def count_table(docs: DataFrame, least: int = 1) -> DataFrame:
    """order int, gram long, count long: how often each n-gram (by its hash) occurs in all texts, of those that occur least
    times. A chunk counts its own before anything is shuffled. For other queries; scores has the same counts in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("docs"):
                x = Chunk.of(data.as_buffer())
                for at in range(0, len(x.u), 100_000):
                    u, c = x.u[at : at + 100_000], x.c[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array((u & U64(3)).astype(np.int32)), pa.array(u.view(np.int64)), pa.array(c, pa.int64())], names=["order", "gram", "n"])

    rows = chunks(docs).select("docs").mapInArrow(run, "order int, gram long, n long")
    return rows.groupBy("order", "gram").agg(F.sum("n").alias("count")).where(F.col("count") >= least)


def _by_part(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one partition of the count tables, which come one after the other."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in columns)):
            if row[0] != current:
                if rows:
                    yield current, rows
                current, rows = row[0], []
            rows.append(row)
    if rows:
        yield current, rows


def _batch(kinds: str, *columns: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def scores(docs: DataFrame, min_count: int = 2, partitions: int | None = None) -> DataFrame:
    """doc_id, n_words, n_trigram, n_bigram, n_unigram (positions scored by each level), score (natural logarithm,
    summed over the words, rounded to 4 places).

    Words are those of [^\\x20\\x09-\\x0D]+, A-Z lower-cased; counts are over all texts, the scored one included, and
    bigrams and trigrams seen fewer than min_count times count as unseen. Null and empty texts have no words and score
    0; a null doc_id stays; repeated rows count and are returned as often as they stand there; an empty table gives no rows;
    other columns, whatever their names, go. partitions: of the count tables, by default as many as the texts' size asks for
    (PARTITION_BYTES), so that what a task holds at a time doesn't grow with the input. The chunks are shuffled once, and all
    three passes over them read that shuffle."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    dealt_to = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as the joins on chunks want it, so that they shuffle no more
    p = partitions or max(dealt_to, -(-int(size) // PARTITION_BYTES))
    bits = max(1, (p - 1).bit_length())
    width = min(62, max(bits + 8, 30, int(size).bit_length() + 2))  # of fingerprints: few n-grams share one by chance
    # the filter, which joins would add, makes the shuffle the same for all that read it, so that it is made once
    held = chunks(docs).where("chunk is not null").repartition(dealt_to, "chunk")

    ask_kinds = "part int, chunk long, n_words long, data binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("docs")):
                x = Chunk.of(data.as_buffer())
                f, _ = Chunk.distinct(x.u >> U64(64 - width))
                for part, (a, b) in enumerate(x.split(f << U64(64 - width), bits)):
                    yield _batch(ask_kinds, [part], [chunk], [x.n_words], [_pack(f[a:b])])

    answer_kinds = "chunk long, part int, total long, n long, data binary"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches, ["part", "chunk", "n_words", "data"]):
            total = sum(r[2] for r in rows)  # every chunk has a row here
            prints = [_unpack(r[3]) for r in rows]
            u, c = Chunk.distinct(np.concatenate(prints))
            for r, f in zip(rows, prints):
                yield _batch(answer_kinds, [r[1]], [part], [total], [len(f)], [np.packbits(c[np.searchsorted(u, f)] > 1).tobytes()])

    count_kinds = "part int, chunk long, data binary, counts binary"

    def ask_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, answers in zip(batch.column("chunk").to_pylist(), batch.column("docs"), batch.column("answers").to_pylist()):
                x = Chunk.of(data.as_buffer())
                some = x.shared(answers, width, bits)
                u, c = x.u[some], x.c[some]
                for part, (a, b) in enumerate(x.split(u, bits)):
                    if a < b:
                        yield _batch(count_kinds, [part], [chunk], [_pack(u[a:b])], [_pack_counts(c[a:b])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches, ["part", "chunk", "data", "counts"]):
            grams = [_unpack(r[2]) for r in rows]
            u, _ = Chunk.distinct(np.concatenate(grams))
            n = np.zeros(len(u), np.int64)
            for r, g in zip(rows, grams):  # a chunk has each n-gram once
                n[np.searchsorted(u, g)] += _unpack_counts(r[3], len(g))
            for r, g in zip(rows, grams):
                yield _batch(answer_kinds, [r[1]], [part], [0], [len(g)], [_pack_counts(n[np.searchsorted(u, g)])])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, answers, counts in zip(batch.column("docs"), batch.column("answers").to_pylist(), batch.column("counts").to_pylist()):
                x = Chunk.of(data.as_buffer())
                n = np.ones(len(x.u), np.int64)  # what no other chunk has, and this one has once
                if counts:
                    n[x.shared(answers, width, bits)] = np.concatenate([_unpack_counts(a["data"], a["n"]) for a in sorted(counts, key=lambda a: a["part"])])
                yield from x.scores(data.as_buffer(), n, answers[0]["total"], min_count).to_batches(max_chunksize=10_000)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(1 << bits, "part").sortWithinPartitions("part", "chunk")

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("chunk").agg(F.collect_list(F.struct("part", "total", "n", "data")).alias(name))

    answers = gathered(dealt(held.mapInArrow(ask, ask_kinds)).mapInArrow(answer, answer_kinds), "answers")
    known = held.join(answers, "chunk")
    counted = dealt(known.select("chunk", "docs", "answers").mapInArrow(ask_counts, count_kinds)).mapInArrow(count, answer_kinds)
    ready = known.join(gathered(counted, "counts"), "chunk", "left").select("docs", "answers", "counts")
    return ready.mapInArrow(score, "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, score double")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS a, ws[i - 1] AS b, ws[i - 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
n1 AS (SELECT a, count(*) AS n FROM t GROUP BY a),
n2 AS (SELECT b, a, count(*) AS n FROM t WHERE i > 1 GROUP BY b, a),
n3 AS (SELECT c, b, a, count(*) AS n FROM t WHERE i > 2 GROUP BY c, b, a HAVING count(*) >= 2),
s AS (SELECT t.doc_id, CASE WHEN n3.n IS NOT NULL THEN 3 WHEN x2.n >= 2 THEN 2 ELSE 1 END AS level,
             CASE WHEN n3.n IS NOT NULL THEN ln(n3.n) - ln(y2.n)
                  WHEN x2.n >= 2 THEN ln(x2.n) - ln(y1.n) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                  ELSE ln(x1.n) - ln((SELECT count(*) FROM t)) + ln(0.4) * least(i - 1, 2) END AS v
      FROM t LEFT JOIN n3 ON i > 2 AND n3.c = t.c AND n3.b = t.b AND n3.a = t.a
      LEFT JOIN n2 x2 ON i > 1 AND x2.b = t.b AND x2.a = t.a LEFT JOIN n2 y2 ON i > 2 AND y2.b = t.c AND y2.a = t.b
      LEFT JOIN n1 x1 ON x1.a = t.a LEFT JOIN n1 y1 ON i > 1 AND y1.a = t.b)
SELECT w.doc_id, len(any_value(ws))::BIGINT AS n_words, count(*) FILTER (level = 3) AS n_trigram, count(*) FILTER (level = 2) AS n_bigram,
       count(*) FILTER (level = 1) AS n_unigram, round(coalesce(sum(v), 0), 4) AS score
FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""
