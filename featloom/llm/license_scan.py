"""Licence scans by winnowed fingerprints and banded alignment.

Templates are cut into words; hashes of word k-grams are winnowed (the least of each window is kept) into an inverted
index of template and place. A template of n words of which m may be missing or changed has an unbroken run of at least
(n - m) / (m + 1) words left; k and the window are chosen by template so that each such run has a fingerprint (words put in
between break runs without counting, so for these nothing is guaranteed). Every k-gram of a text is looked up. Hits of one template whose places lie near one
diagonal are a candidate, and a banded local alignment of the template's words with the text's gives the matched words,
the share of the template they cover, and the span. The best alignment of all candidates is taken first, its words are
masked and its candidate is aligned again, until none reaches the coverage.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, documents, passes, windows, word_hashes, word_spans
from .decontaminate import ALNUM
from .license_texts import TEMPLATES

GRAM, COVERAGE, BAND = 3, 0.8, 12
MATCH, MISS, GAP = 2, -1, -1


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
    return word_hashes(raw, starts, ends) if len(starts) else np.empty(0, U64)


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """Places of the least hash (the last of equals) of each window; of all if there are fewer than a window."""
    if len(grams) <= window:
        return [len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else []
    v = np.lib.stride_tricks.sliding_window_view(grams, window)
    return sorted(set((np.arange(len(v)) + window - 1 - np.argmin(v[:, ::-1], axis=1)).tolist()))


class Index:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names, self.words = list(templates), [words_of(t) for t in templates.values()]
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by k
        for t, w in enumerate(self.words):
            least = max(1, math.ceil(coverage * len(w)))
            if least > len(w):
                continue
            run = -(-least // (len(w) - least + 1))
            k = min(GRAM, run)
            grams = windows(w, k)
            for p in winnow(grams, run - k + 1):
                self.places.setdefault(k, {}).setdefault(int(grams[p]), []).append((t, p))
        self.known = {k: np.array(sorted(x), U64) for k, x in self.places.items()}
        self.filters = {k: np.zeros(1 << 20, bool) for k in self.known}
        for k, x in self.known.items():
            self.filters[k][(x & U64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, hashes) of the words' k-grams that are in the index."""
        for k, known in self.known.items():
            grams = windows(words, k)
            at = np.flatnonzero(self.filters[k][(grams & U64(0xFFFFF)).astype(np.int64)])
            at = at[np.isin(grams[at], known)] if len(at) else at
            yield k, at, grams[at]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment whose path stays within band of the diagonal (text place
    minus template place). Of equal scores the one with the most matched words, then the one that ends first in the template,
    then in the text."""
    return _align(template, text, diagonal, band, np.zeros(len(text), bool))[1:]


def _align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int, used: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matched words, first, end) as of align, of a path without used words of the text."""
    n, width = len(template), 2 * band + 1
    unit = n + 1  # of the score; each matched word adds one more, which decides between equal scores
    hit, miss, gap = MATCH * unit + 1, MISS * unit, GAP * unit
    h = np.zeros((n + 1, width + 1), np.int64)  # h[i, k]: ends at template word i - 1 and text word i - 1 + diagonal - band + k
    steps = np.arange(width) * gap
    for i in range(1, n + 1):
        j = i - 1 + diagonal - band + np.arange(width)
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        inside[inside] = ~used[j[inside]]
        same[inside] = text[j[inside]] == template[i - 1]
        best = np.maximum(np.maximum(h[i - 1, :width] + np.where(same, hit, miss), h[i - 1, 1:] + gap), 0)
        best = np.maximum.accumulate(best - steps) + steps
        h[i, :width] = np.where(inside, np.maximum(best, 0), 0)
    i, k = np.unravel_index(int(np.argmax(h[:, :width])), (n + 1, width))
    i, k = int(i), int(k)
    score, end, matched, first = int(h[i, k]), i - 1 + diagonal - band + k + 1, 0, 0
    while i > 0 and k >= 0 and h[i, k] > 0:
        j = i - 1 + diagonal - band + k
        same = 0 <= j < len(text) and text[j] == template[i - 1]
        if h[i, k] == h[i - 1, k] + (hit if same else miss):
            matched += same
            first = j
            i -= 1
        elif h[i, k] == h[i - 1, k + 1] + gap:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return score, matched, first, end


def _most(template: np.ndarray, text: np.ndarray, diagonal: int, band: int, used: np.ndarray) -> int:
    """A bound of the words an alignment can match: those of the template with an equal, unused word in the band."""
    found = np.zeros(len(template), bool)
    for d in range(diagonal - band, diagonal + band + 1):
        a, b = max(0, -d), min(len(template), len(text) - d)
        if a < b:
            found[a:b] |= (template[a:b] == text[a + d : b + d]) & ~used[a + d : b + d]
    return int(found.sum())


def _found(index: Index, words: np.ndarray, coverage: float, band: int) -> Iterator[tuple[int, int, int, int]]:
    """(template, matched, first word, end word) of a text, for all places of a template, which don't overlap."""
    by: dict[int, list[tuple[int, int]]] = {}
    for k, at, grams in index.hits(words):
        for p, gram in zip(at.tolist(), grams.tolist()):
            for t, q in index.places[k][gram]:
                by.setdefault(t, []).append((p - q, p))
    for t, marks in sorted(by.items()):
        least = coverage * len(index.words[t])
        if len(words) < least or np.isin(index.words[t], words).sum() < least:
            continue
        marks.sort()
        wide = max(band, len(index.words[t]) // 20)
        groups = [[marks[0]]]
        for m in marks[1:]:
            if m[0] - groups[-1][0][0] > wide:
                groups.append([])
            groups[-1].append(m)
        template, used = index.words[t], np.zeros(len(words), bool)
        best: list[tuple[int, int, int, int, int]] = []

        def push(diagonal: int) -> None:
            if _most(template, words, diagonal, 2 * wide, used) >= least:  # noqa: B023
                score, matched, first, end = _align(template, words, diagonal, 2 * wide, used)  # noqa: B023
                if matched and matched >= least:  # noqa: B023
                    heapq.heappush(best, (-score, first, end, matched, diagonal))  # noqa: B023

        for g in groups:
            push((g[0][0] + g[-1][0]) // 2)
        places = []
        while best:
            _, first, end, matched, diagonal = heapq.heappop(best)
            if not used[first:end].any():
                used[first:end] = True
                places.append((first, end, matched))
            push(diagonal)
        for first, end, matched in sorted(places):
            yield t, matched, first, end


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """doc_id, license, matched, template_words, coverage, first_char, end_char: one row for each place where the words
    of a template lie to the given coverage. Offsets are in code points of the text, end exclusive.

    The templates are those of license_texts, which says what they cover; one text may give rows of several of them. Paths
    may stray by two bands, of a twentieth of the template's words where that is more than band.

    Null and empty texts and templates give no rows; a null doc_id stays; repeated rows give
    repeated results. Texts are taken whole, each for itself, without a shuffle."""
    index = Index(TEMPLATES if templates is None else templates, coverage)
    kinds = "doc_id long, license string, matched long, template_words long, coverage double, first_char long, end_char long"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc_id"), []
            for at, end, raw, offsets in passes(batch.column("text")):
                starts, ends, row = word_spans(raw, offsets, ALNUM)
                if not len(starts):
                    continue
                words = word_hashes(raw, starts, ends)
                if not index.known:
                    continue
                hit = np.concatenate([at for _, at, _ in index.hits(words)])
                for d in np.unique(np.searchsorted(row, hit, "right") - 1).tolist():
                    chars = None
                    for t, matched, first, last in _found(index, words[row[d] : row[d + 1]], coverage, band):
                        if chars is None:  # code points before each byte of the text
                            chars = np.concatenate(([0], np.cumsum((raw[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)))
                        a, b = starts[row[d] + first] - offsets[d], ends[row[d] + last - 1] - offsets[d]
                        n = len(index.words[t])
                        found.append((ids[at + d].as_py(), index.names[t], matched, n, matched / n, int(chars[a]), int(chars[b])))
            cols = list(zip(*found)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in kinds.split(", ")])

    return documents(docs).mapInArrow(run, kinds)
