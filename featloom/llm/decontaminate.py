"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

Items (split where they are long) are documents of an inverted index; every passage of every training text is a query. An
entry's impacts are divided by the score it gives itself, so that one threshold serves all. Items are dealt into aligned
blocks; each term has postings of the blocks that have it, with its largest impact there, and its largest impact of all.

A passage's terms are ordered by that largest impact. Those before the pivot, whose impacts add up to less than the
threshold, can't lift any item over it by themselves; so only the blocks of the terms from the pivot on are looked at, and
of these only the ones whose maxima, with all that lies before the pivot, reach the threshold are opened and scored
exactly. Everything at or above the threshold is retrieved and then verified: the five-word shingles of the item's
question and of its answer must lie in the text around the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side
from .common import U64, documents, passes, windows, word_hashes, word_spans

#: Bytes that make up a word here: ASCII letters and digits, and all of a code point beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
BLOCK = 8
K1, B = 1.2, 0.75
#: Share of the threshold that the terms before the pivot stay under: less makes bounds tighter and postings more.
PIVOT = 0.1
#: Bytes of an index, which each Python worker holds; more items are taken in several passes over the texts.
INDEX_BYTES = 128 << 20
LONGEST = 256


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
    return word_hashes(raw, starts, ends) if len(starts) else np.empty(0, U64)


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence or line; an item of one sentence is both."""
    found = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text.strip())]
    text = text.strip()
    return (text[: found[-1]], text[found[-1] :]) if found else (text, text)


def _shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    return np.unique(windows(words, min(n, len(words)))) if len(words) else words


def _entries(text: str) -> list[np.ndarray]:
    words = _hashes(text)
    return [words[at : at + LONGEST] for at in range(0, len(words), LONGEST)]


class Statistics:
    """Of all entries, before the items are dealt to indexes: df of terms, number, mean and largest length."""

    def __init__(self) -> None:
        self.terms, self.df = np.empty(0, U64), np.empty(0, np.int64)
        self.n = self.words = 0
        self.longest = 32

    def add(self, texts: list[str]) -> None:
        entries = [e for t in texts for e in _entries(t)]
        if entries:
            terms = np.concatenate([self.terms, *(np.unique(e) for e in entries)])
            weight = np.concatenate([self.df, np.ones(len(terms) - len(self.terms), np.int64)])
            self.terms, place = np.unique(terms, return_inverse=True)
            self.df = np.bincount(place, weights=weight).astype(np.int64)
            self.n += len(entries)
            self.words += sum(map(len, entries))
            self.longest = max(self.longest, *map(len, entries))

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


class Index:
    """entries: (item_id, text) of items that have a word; their scores don't depend on which others are here."""

    def __init__(self, entries: list[tuple[int, str]], threshold: float, known: Statistics | None = None):
        if known is None:
            known = Statistics()
            known.add([t for _, t in entries])
        self.threshold, self.half = threshold, known.longest
        self.items = []
        docs, self.owner = [], []
        for item, text in entries:
            words = _hashes(text)
            if not len(words):
                continue
            q, a = (_hashes(x) for x in question_and_answer(text))
            if not len(q) or not len(a):
                q = a = words
            self.items.append((item, len(words), min(5, len(q)), _shingles(q), min(5, len(a)), _shingles(a)))
            for d in _entries(text):
                docs.append(d)
                self.owner.append(len(self.items) - 1)
        terms = np.unique(np.concatenate(docs)) if docs else np.empty(0, U64)
        v = len(terms)
        self.n_blocks = max(1, -(-len(docs) // BLOCK))
        idf, mean = known.idf(terms) if docs else np.empty(0), known.words / max(known.n, 1)
        term, block, slot, weight = ([np.empty(0, t)] for t in (np.int64, np.int64, np.int64, np.float32))
        for i, d in enumerate(docs):
            t, c = np.unique(np.searchsorted(terms, d), return_counts=True)
            w = idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(d) / mean))
            term.append(t)
            block.append(np.full(len(t), i // BLOCK))
            slot.append(np.full(len(t), i % BLOCK))
            weight.append((w / w.sum()).astype(np.float32))
        term, block, slot, weight = map(np.concatenate, (term, block, slot, weight))
        # terms are numbered by their largest impact, the least first
        self.top = np.zeros(v, np.float32)
        np.maximum.at(self.top, term, weight)
        order = np.argsort(self.top, kind="stable")
        self.top, self.terms = self.top[order], terms[order]
        number = np.empty(v, np.int64)
        number[order] = np.arange(v)
        # postings by (term, block): the impacts of the block's entries and the largest of them
        self.keys, at = np.unique(number[term] * self.n_blocks + block, return_inverse=True)
        self.weights = np.zeros((len(self.keys) + 1, BLOCK), np.float32)
        self.weights[at, slot] = weight
        self.most = self.weights[:-1].max(axis=1) if len(self.keys) else np.empty(0, np.float32)
        self.first = np.searchsorted(self.keys, np.arange(v + 1) * self.n_blocks)
        self.places = None
        if v * self.n_blocks <= 1 << 22:  # a table of all, where it is small
            self.places = np.full(v * self.n_blocks, len(self.keys), np.int32)
            self.places[self.keys] = np.arange(len(self.keys))
        # terms by an address of 16 bits of their hash; those that share one go to a next level with other bits
        self.levels, left = [], np.arange(v)
        while len(left) and len(self.levels) < 6:
            place = np.full(1 << 16, -1, np.int32)
            place[self._address(self.terms[left], len(self.levels))] = left
            self.levels.append(place)
            left = left[place[self._address(self.terms[left], len(self.levels) - 1)] != left]
        self.by_hash = np.argsort(self.terms) if len(left) else None  # for a crowd that shares all addresses

    @staticmethod
    def _address(words: np.ndarray, level: int) -> np.ndarray:
        return ((words >> U64(8 * level)) & U64(0xFFFF)).astype(np.int64)

    def term_of(self, words: np.ndarray) -> np.ndarray:
        """Term number of every word, -1 for words in no item."""
        out = np.full(len(words), -1)
        if not len(self.terms):
            return out
        if self.by_hash is not None:
            t = self.by_hash[np.minimum(np.searchsorted(self.terms, words, sorter=self.by_hash), len(self.terms) - 1)]
            return np.where(self.terms[t] == words, t, -1)
        left = np.arange(len(words))
        for level, place in enumerate(self.levels):
            t = place[self._address(words[left], level)]
            same = self.terms[t] == words[left]
            same &= t >= 0
            out[left[same]] = t[same]
            left = left[~same & (t >= 0)]
        return out

    def posting_of(self, keys: np.ndarray) -> np.ndarray:
        """Places of (term, block) among the postings, the last (of zeros) for those that aren't there."""
        if self.places is not None:
            return self.places[keys]
        x = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[x] == keys, x, len(self.keys))

    def retrieve(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, entry, first word of the passage, score) for each passage and entry that reach the threshold.

        A passage is two neighbouring halves of self.half words of one text (or its only half)."""
        t = self.term_of(words)
        count = np.diff(row)
        halves = -(-count // self.half)
        passages = np.where(halves > 0, np.maximum(halves - 1, 1), 0)
        base = np.concatenate(([0], np.cumsum(passages)))
        known = np.flatnonzero(t >= 0)
        if not len(known):
            return
        v, least = len(self.terms), self.threshold - 1e-4
        text = np.searchsorted(row, known, "right") - 1
        half = (known - row[text]) // self.half
        t = t[known]
        before, here = half >= 1, half < passages[text]
        key = (base[text] + half) * v + t
        # by passage, and in it by largest impact; the pivot is where the sum so far could reach the threshold
        p, t = np.divmod(np.unique(np.concatenate([key[here], key[before] - v])), v)
        at = np.searchsorted(p, np.arange(base[-1] + 1))
        total = np.concatenate(([0.0], np.cumsum(self.top[t], dtype=np.float64)))
        essential = total[1:] - total[at[p]] >= PIVOT * least
        if not essential.any():
            return
        under = np.bincount(p[~essential], weights=self.top[t[~essential]], minlength=base[-1])
        e = np.flatnonzero(essential)
        n = self.first[t[e] + 1] - self.first[t[e]]
        posting = np.repeat(self.first[t[e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(p[e], n) * self.n_blocks + self.keys[posting] % self.n_blocks
        if base[-1] * self.n_blocks <= 1 << 22:
            bound = np.bincount(place, weights=self.most[posting])
            found = np.flatnonzero(bound)
            bound = bound[found]
        else:  # the same without a place for each passage and block
            found, place = np.unique(place, return_inverse=True)
            bound = np.bincount(place, weights=self.most[posting])
        fp, block = np.divmod(found, self.n_blocks)
        some = np.flatnonzero(bound + under[fp] >= least)
        owner = np.repeat(np.arange(len(count)), passages)
        for part in range(0, len(some), 4096):
            c = some[part : part + 4096]
            q, b = fp[c], block[c]
            n = at[q + 1] - at[q]
            ends = np.cumsum(n)
            terms = t[np.repeat(at[q] - (ends - n), n) + np.arange(ends[-1])]
            x = self.posting_of(terms * self.n_blocks + np.repeat(b, n))
            score = np.round(np.add.reduceat(self.weights[x], ends - n, axis=0, dtype=np.float64), 6)
            for i, slot in zip(*(z.tolist() for z in np.nonzero(score >= self.threshold))):
                d = int(owner[q[i]])
                yield d, int(b[i]) * BLOCK + slot, int((q[i] - base[d]) * self.half), float(score[i, slot])

    def verified(self, words: np.ndarray, item: int, first: int) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles that lie around the passage at first."""
        _, n, qn, q, an, a = self.items[item]
        near = words[max(0, first - n) : first + 2 * self.half + n]
        share = lambda want, k: float(np.isin(want, windows(near, k)).mean()) if len(near) >= k else 0.0
        return share(q, qn), share(a, an)


def _rows(benchmark: DataFrame) -> Iterator[tuple[int, str]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct().orderBy("item_id", "text")
    return ((r.item_id, r.text) for r in rows.toLocalIterator())


def _indexes(benchmark: DataFrame, threshold: float, most: int) -> Iterator[Index]:
    """Indexes of at most about most bytes each (a word has a posting of 64 bytes at most, and 24 bytes of shingles)."""
    known, texts, size = Statistics(), [], 0
    for _, text in _rows(benchmark):
        texts.append(text)
        if len(texts) >= 1000:
            known.add(texts)
            texts = []
    known.add(texts)
    shard: list[tuple[int, str]] = []
    for item, text in _rows(benchmark):
        n = 88 * len(_hashes(text))
        if shard and size + n > most:
            yield Index(shard, threshold, known)
            shard, size = [], 0
        shard.append((item, text))
        size += n
    yield Index(shard, threshold, known)


def _hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, index_bytes: int | None = None) -> DataFrame:
    """hits with h, the hash of the text."""
    kinds = "doc_id long, h long, item_id long, score double, question_overlap double, answer_overlap double"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    texts = documents(docs).withColumn("h", F.xxhash64("text"))
    out = None
    for index in _indexes(benchmark, threshold, INDEX_BYTES if index_bytes is None else index_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found: list[tuple] = []
                ids, hashes = batch.column("doc_id"), batch.column("h")
                for start, _, raw, offsets in passes(batch.column("text")):
                    starts, ends, row = word_spans(raw, offsets, ALNUM)
                    if not len(starts):
                        continue
                    words = word_hashes(raw, starts, ends)
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for text, entry, first, score in index.retrieve(words, row):
                        item = index.owner[entry]
                        q, a = index.verified(words[row[text] : row[text + 1]], item, first)
                        if q >= overlap and a >= overlap:
                            best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (score, q, a))
                    found += [(ids[start + text].as_py(), hashes[start + text].as_py(), index.items[item][0], *x) for (text, item), x in sorted(best.items())]
                cols = list(zip(*found)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in kinds.split(", ")])

        one = texts.mapInArrow(run, kinds)
        out = one if out is None else out.unionByName(one)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, index_bytes: int | None = None) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each document and item found in it.

    score is the best passage's BM25 score as a share of the item's own, by document frequencies and lengths over all
    items. The driver reads the items twice and holds their document frequencies; an index of them goes to each executor
    once, as a broadcast, and holds so many items as index_bytes (INDEX_BYTES) allow, about 30,000 of 50 words. More items
    are more passes over the texts, with the same scores. Null and empty texts, items without a word, and an empty table
    of either kind give no rows; rows with a null doc_id or item_id do; a repeated document row gives repeated rows; equal
    items count once; other columns, whatever their names, go."""
    return _hits(docs, benchmark, threshold, overlap, index_bytes).drop("h")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no item is found; all columns stay, whatever their names. Each row goes by its own text,
    also where a doc_id repeats or is null."""
    bad = small_side(cut(_hits(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id"), F.col("h").alias("bad_h")).distinct()))
    row = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(text) == F.col("bad_h"))
    return row.join(bad, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
