"""Line dedup by prefix doubling over line-ID sequences.

Suffixes of the documents' line sequences are named level by level: at level 0 a suffix bears the first place of its
first line, at level k+1 the first place that has its two level-k names 2**k lines apart. Suffixes of one name are the
longest-common-prefix interval of a suffix array for 2**k lines; those that have a name of their own leave, so the table
shrinks from level to level. A prefix of n lines, 2**k <= n < 2**(k+1), is told by its length and two names, at its first
line and 2**k lines before its end; equal ones are the interval for n lines. Names are first places, not ranks: what is
asked of a suffix array here (which prefixes are equal, how often, which copy is first) needs no order of the others.

A run of lines that occurs earlier is deleted if it has enough words. As such a run holds, from each of its lines on and
up to each of its lines, a shortest run with enough words, it is enough to look up those: of them the later copies are
deleted, and together they make up all runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import FEW, cut, frame_bytes, small_side
from .common import documents, passes, word_hashes, word_spans

_BREAK = np.ones(256, bool)
_BREAK[10] = False
_SAME = np.arange(256, dtype=np.uint8)
PLACE = ["doc_id", "h", "j"]
NAME = pa.struct([("doc_id", pa.int64()), ("h", pa.int64()), ("j", pa.int32())])
NAME_SQL = "struct<doc_id:bigint,h:bigint,j:int>"


def shortest(words: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, of documents given by row, the lengths n1 to n2 (in lines) of the runs from it on that have at least
    least words and none without their last, or none without their first line; 0 and 0 if there are none."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(n)
    end = np.repeat(row[1:], np.diff(row))
    stop = np.maximum(np.searchsorted(total, total[:-1] + least), at + 1)
    some = stop <= end
    n1 = np.where(some, stop - at, 0)
    after = np.where((at + 1 < end) & np.append(some[1:], False), np.append(stop[1:], 0) - 1, end)
    return n1.astype(np.int32), np.where(some, np.maximum(n1, after - at), 0).astype(np.int32)


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, h (hash of the text), j (number among the lines that aren't empty), i (number among all lines),
    line (hash), size (bytes), n1, n2 (as of shortest): a row for each line that isn't empty."""
    kinds = "doc_id long, h long, j int, i int, line long, size int, n1 int, n2 int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "h"))
            for at, end, raw, offsets in passes(batch.column("text")):
                starts, ends, row = word_spans(raw, offsets, _BREAK)
                if not len(starts):
                    continue
                ids_of = word_hashes(raw, starts, ends, _SAME)
                words, _, _ = word_spans(raw, offsets)
                n = np.searchsorted(words, ends) - np.searchsorted(words, starts)
                breaks = np.flatnonzero(raw == 10)
                count = np.diff(row)
                doc = np.repeat(np.arange(end - at), count)
                i = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[doc]
                cols = [ids[at:end][doc], h[at:end][doc], (np.arange(len(doc)) - row[doc]).astype(np.int32), i.astype(np.int32), ids_of.view(np.int64), (ends - starts).astype(np.int32), *shortest(n, row, min_words)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in kinds.split(", ")])

    return documents(docs).where("doc_id is not null").withColumn("h", F.xxhash64("text")).mapInArrow(run, kinds)


@dataclass
class Named:
    """rows whose key occurs more than once, with name (the first place of it) and copies (how many there are); in_place:
    the rows of a document still come one after the other, in order."""

    rows: DataFrame
    in_place: bool


#: Bytes of repeated keys up to which they go to every task, and rows up to which a level is one task's.
KEY_BYTES, ONE_TASK = 1 << 20, 1 << 20


def _named(rows: DataFrame, key: list[str], *keep: str) -> Named:
    """Keys are counted with partial sums before they are shuffled; the rows themselves are only where the table of repeated
    keys is too large to be broadcast, in a join whose large partitions Spark splits."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*PLACE)).alias("name"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = cut(first.withColumnsRenamed({k: f"{k}_" for k in key}))
    in_place = frame_bytes(first) <= KEY_BYTES
    n = first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    side = F.broadcast(first.coalesce(FEW)) if in_place else first
    out = cut(rows.join(side, [rows[k] == F.col(f"{k}_") for k in key]).select(*PLACE, *keep, "name", "copies"))
    if n <= ONE_TASK:
        out = out.coalesce(FEW) if in_place else out.coalesce(1).dropDuplicates([*PLACE, *keep]).sortWithinPartitions(*PLACE)
    return Named(out, in_place or n <= ONE_TASK)


def _starts(ids: np.ndarray, h: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each row but the first begins a document; a repeated one begins where the places don't go on."""
    return (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]) | (j[1:] <= j[:-1])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents, whose rows come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cols = [batch.column(x).to_numpy() for x in PLACE]
        if not len(cols[0]):
            continue
        starts = np.flatnonzero(_starts(*cols)) + 1
        if held:
            last = [np.append(held[-1].column(x)[-1].as_py(), c[:1]) for x, c in zip(PLACE, cols)]
            if _starts(*last)[0]:
                yield pa.Table.from_batches(held)
                held = []
        if len(starts):
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held = []
        held.append(batch.slice(starts[-1] if len(starts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _keys(level: Named, k: int) -> DataFrame:
    """Of level-k names by two: doc_id, h, j, n1, n2, n, a, b. n = 0: the two that make a level-(k+1) name; n > 0: the two
    that tell the run of n lines."""
    step = 1 << k
    kinds = f"doc_id long, h long, j int, n1 int, n2 int, n int, a {NAME_SQL}, b {NAME_SQL}"
    names = ["doc_id", "h", "j", "n1", "n2", "n", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _documents(batches):
            t = table.combine_chunks()
            ids, h, j, n1, n2 = (t.column(x).to_numpy() for x in ("doc_id", "h", "j", "n1", "n2"))
            place = (np.cumsum(np.concatenate(([0], _starts(ids, h, j).astype(np.int64)))) << 32) + j

            def at(wanted: np.ndarray) -> np.ndarray:
                x = np.minimum(np.searchsorted(place, wanted), len(place) - 1)  # noqa: B023
                return np.where(place[x] == wanted, x, -1)  # noqa: B023

            low, high = np.maximum(n1, step), np.minimum(n2, 2 * step - 1)
            count = np.where(n1 > 0, np.maximum(high - low + 1, 0), 0)
            s = np.repeat(np.arange(len(j)), count)
            n = low[s] + np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
            tail = at(place[s] + n - step)
            pair = at(place + step)
            some, both = tail >= 0, pair >= 0
            x = np.concatenate([s[some], np.flatnonzero(both)])
            y = np.concatenate([tail[some], pair[both]])
            n = np.concatenate([n[some], np.zeros(int(both.sum()), np.int64)]).astype(np.int32)
            name = t.column("name").combine_chunks()
            name = name.chunk(0) if isinstance(name, pa.ChunkedArray) else name
            for part in range(0, len(x), 50_000):
                p, q = x[part : part + 50_000], y[part : part + 50_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[p]) for c in (ids, h, j, n1, n2)), pa.array(n[part : part + 50_000]), name.take(pa.array(p)), name.take(pa.array(q))], names=names)

    rows = level.rows.select(*PLACE, "n1", "n2", "name")
    if not level.in_place:
        rows = rows.dropDuplicates(PLACE).repartition("doc_id", "h").sortWithinPartitions(*PLACE)
    return rows.mapInArrow(run, kinds)


def _levels(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The repeated lines, and the repeated shortest runs: doc_id, h, j (first line), n (lines), name, copies."""
    rows = cut(lines(docs, min_words))
    level = _named(rows, ["line", "size"], "i", "n1", "n2")
    first, runs = level.rows, None
    longest = first.agg(F.max("n2")).first()[0] or 0
    k = 0
    while k == 0 or 1 << k <= longest:
        found = _named(_keys(level, k), ["n", "a", "b"], "n1", "n2", "n")
        here = found.rows.where("n > 0").select(*PLACE, "n", "name", "copies")
        runs = here if runs is None else runs.unionByName(here)
        level, k = Named(found.rows.where("n = 0"), found.in_place), k + 1
    return first.select(*PLACE, "i").dropDuplicates(PLACE), runs


def intervals(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, h, j (first place: document, hash of its text, number among its lines that aren't empty), n_lines, copies:
    the longest-common-prefix intervals of the shortest runs of at least min_words words, as of repeated_runs. Repeated rows
    count as copies."""
    _, runs = _levels(docs, min_words)
    return runs.where(F.col("name") == F.struct(*PLACE)).select(*PLACE, F.col("n").alias("n_lines"), "copies").distinct()


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, h, spans array<struct<first, last>>: line numbers (from 0, of all lines) of what is to be deleted.

    A run of neighbouring lines is deleted if it has at least min_words words and an equal run begins at an earlier line (of
    a smaller doc_id, or earlier in the text; the two may overlap). Each run has to have the words by itself; spans are
    what such runs cover, those that overlap or touch being one. Lines are equal if their bytes are; empty lines don't
    count and go with what is around them. Null and empty texts have no lines. Rows that repeat a doc_id and its text are
    one document, those that repeat it with another text another; a null doc_id neither loses lines nor lends any."""
    repeated, runs = _levels(docs, min_words)
    copies = runs.where(F.col("name") != F.struct(*PLACE)).groupBy("doc_id", "h", F.col("j").alias("s")).agg((F.col("s") + F.max("n")).alias("e"))
    order = Window.partitionBy("doc_id", "h").orderBy("s")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = copies.withColumn("fresh", F.when(F.col("s") <= before, 0).otherwise(1))
    covered = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "h", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    ends = covered.select("doc_id", "h", "run", F.explode(F.array(F.col("s"), F.col("e") - 1)).alias("j"))
    spans = ends.join(repeated.select(*PLACE, "i"), PLACE).groupBy("doc_id", "h", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _joined(docs: DataFrame, min_words: int) -> DataFrame:
    """row (a struct of docs' columns, whose names thus clash with none), rest (the text left), spans."""
    found = small_side(cut(repeated_runs(docs, min_words).select(F.col("doc_id").alias("found_id"), F.col("h").alias("found_h"), "spans")))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    same = (F.col("row.doc_id").cast("long") == F.col("found_id")) & (F.xxhash64(text) == F.col("found_h"))
    rows = docs.select(F.struct("*").alias("row")).join(found, same, "left")
    left = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.exists("spans", lambda s: (i >= s["first"]) & (i <= s["last"])))
    return rows.select("row", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("rest"), "spans")


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with the column text less its repeated runs, and spans (null where nothing goes; a column of docs by that
    name is replaced); all other columns stay. A null text stays null. The texts are shuffled once, or not at all if the
    table of spans is small."""
    columns = [F.col("rest").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "spans"]
    return _joined(docs, min_words).select(*columns, "spans")


def cleaned(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs less their repeated runs, with the columns they have; n_chars, if there, follows. A document that loses
    lines and has nothing but white space left goes."""
    words = F.length(F.translate("rest", " \t\n\x0b\f\r", "")) > 0
    kinds = dict(docs.dtypes)
    new = lambda c: F.col("rest") if c == "text" else F.length("rest").cast(kinds[c])
    columns = [F.when(F.col("spans").isNull(), F.col("row")[c]).otherwise(new(c)).alias(c) if c in ("text", "n_chars") else F.col("row")[c].alias(c) for c in docs.columns]
    return _joined(docs, min_words).where(F.col("spans").isNull() | words).select(*columns)


#: The same without levels: the shortest runs by their whole content.
ORACLE = r"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM r)),
l AS (SELECT doc_id, i, line, row_number() OVER w AS j, sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) OVER w AS c
      FROM a WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY j), 0) AS c0 FROM l),
w AS (SELECT x.doc_id, x.j AS s, min(y.j) AS e FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.j >= x.j AND y.c - x.c0 >= 50 GROUP BY ALL
      UNION SELECT y.doc_id, max(x.j), y.j FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.j >= x.j AND y.c - x.c0 >= 50 GROUP BY y.doc_id, y.j),
k AS (SELECT w.doc_id, s, e, string_agg(line, chr(10) ORDER BY j) AS content FROM w JOIN p ON p.doc_id = w.doc_id AND p.j BETWEEN s AND e GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS n FROM k),
gone AS (SELECT DISTINCT p.doc_id, p.j FROM f JOIN p ON p.doc_id = f.doc_id AND p.j BETWEEN f.s AND f.e WHERE n > 1),
g AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run FROM gone),
spans AS (SELECT g.doc_id, run, min(p.i) AS first, max(p.i) AS last FROM g JOIN p ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY ALL),
d AS (SELECT doc_id, sum(last - first + 1) AS n, string_agg(first || '-' || last, ',' ORDER BY first) AS spans FROM spans GROUP BY 1),
k2 AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM a WHERE NOT EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = a.doc_id AND i BETWEEN x.first AND x.last) GROUP BY 1)
SELECT r.doc_id, coalesce(d.n, 0)::BIGINT AS n_deleted_lines, length(coalesce(k2.t, ''))::BIGINT AS n_chars_left, sha256(coalesce(k2.t, '')) AS text_sha256, coalesce(spans, '') AS spans
FROM r LEFT JOIN d USING (doc_id) LEFT JOIN k2 USING (doc_id)
"""
