"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are counts over the line itself and over its neighbours; the chain adds what
labels of neighbouring lines say about each other. Forward-backward gives each line's marginal; a document's score is
their mean weighted by length, calibrated on the training documents. Lines learn from their document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, documents, mix, passes, windows, word_hashes, word_spans

_LINE = np.ones(256, bool)
_LINE[10] = False
_SAME = np.arange(256, dtype=np.uint8)
SYMBOLS = b"#*$%&<>@^~=_{}\\"
#: Each counted set of bytes.
SETS = [SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), b"|", b"!", b"0123456789", bytes(range(128, 256))]
OWN = 13
NEAR = range(2, 10)  # features that neighbours lend
WIDTH = OWN + 2 * len(NEAR) + 2


@dataclass
class Lines:
    """Lines of several texts: features, lengths in bytes, and for each text the first of its lines."""

    x: np.ndarray
    size: np.ndarray
    row: np.ndarray


def features(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    starts, ends, row = word_spans(raw, offsets, _LINE)
    n = len(starts)
    if not n:
        return Lines(np.zeros((0, WIDTH), np.float32), np.zeros(0), row)
    doc = np.repeat(np.arange(len(row) - 1), np.diff(row))

    def count(chars: bytes) -> np.ndarray:
        has = np.zeros(256, np.int32)
        has[list(chars)] = 1
        total = np.concatenate(([0], np.cumsum(has[raw])))
        return (total[ends] - total[starts]).astype(np.float32)

    symbols, upper, lower, pipes, bangs, digits, wide = map(count, SETS)
    size = (ends - starts).astype(np.float32)
    ws, we, wrow = word_spans(raw, offsets)
    first, last = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = np.maximum(last - first, 1).astype(np.float32)
    chars = np.concatenate(([0], np.cumsum(we - ws)))
    hashes = word_hashes(raw, ws, we) if len(ws) else np.empty(0, U64)
    wdoc = np.repeat(np.arange(len(wrow) - 1), np.diff(wrow))
    # words in windows of three that their text has more than once, and words that their line has more than once
    repeated = np.zeros(len(ws) + 1)
    if len(ws) >= 3:
        w = windows(hashes, 3)
        inside = wdoc[:-2] == wdoc[2:]
        _, which, times = np.unique(mix(w + wdoc[:-2].astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        twice = (times[which] > 1) & inside
        for k in range(3):
            repeated[k : len(twice) + k] = np.maximum(repeated[k : len(twice) + k], twice)
    line = np.searchsorted(starts, ws, "right") - 1
    _, again = np.unique(mix(hashes + line.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), return_index=True)
    distinct = np.bincount(line[again], minlength=n) if len(ws) else np.zeros(n)
    sums = np.concatenate(([0], np.cumsum(repeated[:-1])))
    _, which, times = np.unique(mix(word_hashes(raw, starts, ends, _SAME) + doc.astype(U64) * U64(0x165667B19E3779F9)), return_inverse=True, return_counts=True)
    own = np.stack([
        np.ones(n), np.log1p(words) / 4, np.minimum(symbols / words, 3), upper / np.maximum(upper + lower, 1),
        np.minimum(pipes / words, 1), np.minimum(bangs / words, 2), (sums[last] - sums[first]) / words,
        times[which] > 1, distinct / words, np.minimum((chars[last] - chars[first]) / words, 30) / 10,
        np.isin(raw[ends - 1], list(b".?!")), np.minimum(digits / size, 1), wide / size,
    ], axis=1).astype(np.float32)
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :OWN] = own
    near = own[:, list(NEAR)]
    k = len(NEAR)
    joined = doc[1:] == doc[:-1]
    x[1:, OWN : OWN + k] = near[:-1] * joined[:, None]
    x[:-1, OWN + k : OWN + 2 * k] = near[1:] * joined[:, None]
    x[1:, -2], x[:-1, -1] = joined, joined
    return Lines(x, size, row)


def marginals(score: np.ndarray, row: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of chains given by row: each line's probability of good, the sum of pair probabilities, and the log of the
    normalisers. score: log potential of good (bad has 0). All chains step together, the longest first."""
    length = np.diff(row)
    order = np.argsort(-length, kind="stable")
    begin, length = row[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # chains longer than t
    emit = np.stack([np.zeros_like(score), score], axis=1).astype(np.float64)
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    pairs = np.zeros((2, 2))
    for t in range(steps):
        at = begin[: active[t]] + t
        if t:
            p = a[at - 1]
            a[at] = emit[at] + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
        else:
            a[at] = emit[at]
    some = length > 0
    z = np.zeros(len(length))
    end = begin + length - 1
    z[some] = np.logaddexp(a[end[some], 0], a[end[some], 1])
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        at = begin[:n] + t
        q = b[at + 1] + emit[at + 1]
        b[at] = np.logaddexp(q[:, :1] + trans[:, 0], q[:, 1:] + trans[:, 1])
        pairs += np.exp(a[at][:, :, None] + trans[None] + q[:, None, :] - z[:n, None, None]).sum(axis=0)
    per_line = np.repeat(z[np.argsort(order, kind="stable")], np.diff(row))
    return np.exp(a[:, 1] + b[:, 1] - per_line), pairs, float(z.sum())


@dataclass
class Model:
    w: np.ndarray
    trans: np.ndarray
    scale: float
    shift: float
    base: float

    def raw(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal of each text; nan where there is no line."""
        good, _, _ = marginals(lines.x @ self.w, lines.row, self.trans)
        sums = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[lines.row])
        with np.errstate(invalid="ignore"):
            return sums(good * lines.size) / sums(lines.size)

    def scores(self, lines: Lines) -> np.ndarray:
        p = np.clip(self.raw(lines), 1e-6, 1 - 1e-6)
        return np.where(np.isnan(p), self.base, 1 / (1 + np.exp(-(self.scale * np.log(p / (1 - p)) + self.shift))))


def train(lines: Lines, labels: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> Model:
    """Full-batch Adam on the mean log-likelihood per line, then a logistic calibration of the documents' means."""
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    base = float(labels.mean()) if len(labels) else 0.5
    model = Model(w, trans, 1.0, 0.0, base)
    if not len(lines.x) or len(set(labels.tolist())) < 2:
        return model
    y = np.repeat(labels, np.diff(lines.row)).astype(np.float64)
    n = len(y)
    doc = np.repeat(np.arange(len(labels)), np.diff(lines.row))
    inside = y[:-1][doc[1:] == doc[:-1]].sum()
    seen = np.diag([(doc[1:] == doc[:-1]).sum() - inside, inside])
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for k in range(1, rounds + 1):
        good, pairs, _ = marginals(lines.x @ w, lines.row, trans)
        g = np.concatenate([lines.x.T @ (y - good) / n - l2 * w, ((seen - pairs) / n - l2 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, trans = w + step[:WIDTH], trans + step[WIDTH:].reshape(2, 2)
    model = Model(w.astype(np.float32), trans, 1.0, 0.0, base)
    p = model.raw(lines)
    has = ~np.isnan(p)
    z, t = np.log(np.clip(p[has], 1e-6, 1 - 1e-6) / (1 - np.clip(p[has], 1e-6, 1 - 1e-6))), labels[has]
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * z + b)))
        h = q * (1 - q) + 1e-9
        grad = np.array([((t - q) * z).sum() - (a - 1), (t - q).sum() - b])
        hess = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]])
        da, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a + da, b + db
    return Model(model.w, trans, float(max(a, 0.05)), float(b), base)


def remainder():
    """crc32 of the doc_id's digits modulo 5; 0 is held out."""
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, sample_bytes: int = 64 << 20) -> Model:
    """A model from labelled documents that aren't held out, in the order of a hash of their doc_id: at most sample, and only
    so many that their texts have at most sample_bytes. Their lines' features (not their texts) come to the driver. Null
    labels, ids and unlabelled documents are left out; a doc_id with several texts counts with the least; without labels of
    both kinds all scores are equal."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(remainder() != 0)
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality"))  # of at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = [], []
            for _, _, raw, offsets in passes(batch.column("text")):
                lines = features(raw, offsets)
                for a, b in zip(lines.row[:-1], lines.row[1:]):
                    x.append(lines.x[a:b].astype(np.float32).tobytes())
                    size.append(lines.size[a:b].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary()), pa.array(size, pa.binary())], names=["doc_id", "quality", "x", "size"])

    found = rows.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary, size binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.quality))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in found]
    size = [np.frombuffer(r["size"], np.float32) for r in found]
    lines = Lines(np.concatenate([np.zeros((0, WIDTH), np.float32), *x]), np.concatenate([np.zeros(0), *size]), np.cumsum([0, *map(len, x)]))
    return train(lines, np.array([r.quality for r in found], float))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. A text without lines (null, empty) scores the share of good training
    documents. Rows are scored each for itself, whole, without a shuffle; a null doc_id has a null held_out."""
    kinds = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.scores(features(raw, offsets)) for _, _, raw, offsets in passes(batch.column("text"))]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[x.split()[0] for x in kinds.split(", ")])

    return documents(docs, (remainder() == 0).alias("held_out")).mapInArrow(run, kinds)
