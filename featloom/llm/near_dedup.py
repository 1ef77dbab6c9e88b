"""MinHash near-dedup with odd sketches.

One pass over the texts gives each document the size and a signature of its shingle set, MinHash band keys, and an odd
sketch: its MinHash samples folded into a parity bitmap. Documents with equal sets form a class that one document
represents. Representatives that share a band are compared with the smallest and the largest of the band's bucket;
buckets that still hold several components after that have their remaining pairs compared inside a task, blocks of a
large bucket against each other. A candidate pair first passes its odd sketches (population count of the XOR, which is
precise at high similarity), then the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side
from .common import U64, documents, hashed_words, mix, windows

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 512
_A = (mix(np.arange(1, SAMPLES + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, SAMPLES + 1001, dtype=U64)) >> U64(32)).astype(np.uint32)
_ROW = mix(np.arange(2001, ROWS + 2001, dtype=U64)) | U64(1)
_BAND = mix(np.arange(3001, BANDS + 3001, dtype=U64))
_PLACE = mix(np.arange(4001, SAMPLES + 4001, dtype=U64))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    if len(words) < WORDS:
        return windows(words, len(words)) + U64(len(words))
    s = windows(words, WORDS)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples (uint32) of a set that isn't empty."""
    h = (s >> U64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 2048):
        x = np.multiply.outer(_A, h[at : at + 2048])
        x += _B[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    return mix((m.reshape(BANDS, ROWS).astype(U64) * _ROW).sum(axis=1) + _BAND).view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    places = mix(m.astype(U64) + _PLACE) % U64(BITS)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def estimate(different: Column) -> Column:
    """Similarity by the number of places where two odd sketches differ."""
    return 1 + F.lit(BITS / (4 * SAMPLES)) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * different / F.lit(float(BITS))))


def least_estimate(percent: int) -> float:
    """Pairs estimated below this are dropped without a look at their sets: 6.5 standard deviations of the samples below
    the threshold, so that a link is lost with odds under 1e-9."""
    t = percent / 100
    return t - 6.5 * (t * (1 - t) / SAMPLES) ** 0.5


#: Members of a bucket that meet in one task, at most about twice; larger buckets are compared block against block.
MEMBERS = 1024


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig (binary, of the whole set), bands, odd (both null without shingles)."""
    kinds = "doc_id long, n_shingles long, sig binary, bands array<long>, odd array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                b = batch.slice(part, 2000)
                n, sig, bands, odd = [], [], [], []
                for _, words in hashed_words(b.column("text")):
                    s = shingle_set(words)
                    m = samples(s) if len(s) else None
                    n.append(len(s))
                    sig.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(None if m is None else band_keys(m))
                    odd.append(None if m is None else odd_sketch(m))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sig", "bands", "odd"])

    return documents(docs).mapInArrow(run, kinds)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those of which some texts' full sets have 100 * intersection >= percent * union. Only texts that
    stand in a pair are shuffled."""
    texts = documents(docs)
    a = texts.join(small_side(cut(pairs.select(F.col("a").alias("doc_id")).distinct())), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.join(small_side(cut(pairs.select(F.col("b").alias("doc_id")).distinct())), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, None  # pairs of one b come one after the other
        for batch in batches:
            at_a, at_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            sets_b = hashed_words(batch.column("text_b"))
            for (i, words), (_, other) in zip(hashed_words(batch.column("text_a")), sets_b):
                s = shingle_set(words)
                if last is None or not np.array_equal(last, other):
                    last, t = other.copy(), shingle_set(other)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([at_a[i] for i in keep], pa.int64()), pa.array([at_b[i] for i in keep], pa.int64())], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """Rows of one task key, which come one after the other."""
    current, rows = None, {c: [] for c in columns}
    for batch in batches:
        got = {c: batch.column(c).to_pylist() for c in columns}
        for k, key in enumerate(zip(got["key"], got["i"], got["j"])):
            if key != current:
                if rows["key"]:
                    yield rows
                current, rows = key, {c: [] for c in columns}
            for c in columns:
                rows[c].append(got[c][k])
    if rows["key"]:
        yield rows


def _candidates(g: dict[str, list], least: float) -> list[tuple[float, int, int]]:
    """(estimate, x, y) of a group's rows in different components whose first common band is this one and whose
    sketches are alike."""
    odd, bands = np.array(g["odd"], np.int64).view(U64), np.array(g["bands"], np.int64)
    root, block, band = np.array(g["root"]), np.array(g["block"]), g["band"][0]
    across = g["i"][0] != g["j"][0]
    most = BITS / 2 * (1 - np.exp((least - 1) * 4 * SAMPLES / BITS))
    out = []
    for x in range(len(root) - 1):
        y = x + 1 + np.flatnonzero(root[x + 1 :] != root[x])
        if across:
            y = y[block[y] != block[x]]
        different = np.bitwise_count(odd[y] ^ odd[x]).sum(axis=1)
        y, different = y[different <= most], different[different <= most]
        if band and len(y):
            first = ~(bands[y, :band] == bands[x, :band]).any(axis=1)
            y, different = y[first], different[first]
        out += [(float(d), x, int(z)) for d, z in zip(different, y)]
    return sorted(out)


def rest_links(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of the same bucket, enough of them to join what is linked.

    members: key, i, j, block, band, doc_id, root, bands, odd; the rows of one (key, i, j) meet in one task, and no
    pair becomes a row. The sketches say which rows have a candidate at all; only those fetch their texts."""
    columns = ["key", "i", "j", "block", "band", "doc_id", "root", "bands", "odd"]
    least = least_estimate(percent)
    kinds = "key long, i int, j int, block int, band int, doc_id long, root long, bands array<long>, odd array<long>"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def with_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, columns):
            if some := sorted({z for _, x, y in _candidates(g, least) for z in (x, y)}):
                yield pa.RecordBatch.from_arrays([pa.array([g[c][z] for z in some], t) for c, t in zip(columns, types)], names=columns)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, [*columns, "text"]):
            sets = [shingle_set(words) for _, words in hashed_words(pa.array(g["text"], pa.string()))]
            at = {r: r for r in g["root"]}

            def find(r, at=at):
                while at[r] != r:
                    at[r] = at[at[r]]
                    r = at[r]
                return r

            found = []
            for _, x, y in _candidates(g, least):
                a, b = find(g["root"][x]), find(g["root"][y])
                if a != b:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        at[max(a, b)] = min(a, b)
                        found.append((g["doc_id"][x], g["doc_id"][y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    task = ["key", "i", "j"]
    some = cut(members.repartition(*task).sortWithinPartitions(*task).mapInArrow(with_candidates, kinds))
    texts = documents(docs).join(small_side(cut(some.select("doc_id").distinct())), "doc_id", "left_semi")
    return some.join(texts, "doc_id").select(*columns, "text").repartition(*task).sortWithinPartitions(*task).mapInArrow(confirmed, "a long, b long").distinct()


#: Edges up to which one task works out the components of a graph (16 bytes each).
SMALL_EDGES = 1 << 19


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, root of a whole graph of bounded size: each vertex takes the least root among its neighbours, roots hook to
    roots and paths are halved, until nothing changes."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    n = [len(p[0]) for p in parts]
    starts = np.cumsum([0, *[2 * x for x in n]])
    a = np.concatenate([ends[s : s + x] for s, x in zip(starts, n)])
    b = np.concatenate([ends[s + x : s + 2 * x] for s, x in zip(starts, n)])
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    for at in range(0, len(ids), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000], pa.int64()), pa.array(ids[root[at : at + 10_000]], pa.int64())], names=["id", "root"])


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """id, root (smallest id reachable) for every id on an edge (a, b).

    Vertices hook to a neighbour and the graph is contracted; every second round goes by random ranks, so the number of
    rounds is logarithmic whatever the ids. Once at most small edges are left, by count, one task ends it. Nothing is
    collected."""
    left = cut(edges.where("a <> b").distinct())
    n = left.count()
    if n <= small:
        return cut(left.coalesce(1).mapInArrow(_solved, "id long, root long"))
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    where = cut(ids.select("id", F.col("id").alias("at")))
    turn = 0
    while n > small:
        both = left.union(left.select("b", "a"))
        rank = (lambda c: c) if turn % 2 == 0 else (lambda c: F.xxhash64(c, F.lit(turn)))
        near = both.groupBy(F.col("a").alias("at")).agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("to"))).alias("m"))
        to = small_side(cut(near.select("at", F.when(F.struct(rank(F.col("at")).alias("r"), F.col("at").alias("to")) < F.col("m"), F.col("at")).otherwise(F.col("m.to")).alias("to"))))
        where = cut(where.join(to, "at", "left").select("id", F.coalesce("to", "at").alias("at")))
        left = left.join(to.withColumnsRenamed({"at": "a", "to": "x"}), "a").join(to.withColumnsRenamed({"at": "b", "to": "y"}), "b")
        left = cut(left.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        n = left.count()
        turn += 1
    ends = small_side(cut(left.coalesce(1).mapInArrow(_solved, "id long, root long").withColumnsRenamed({"id": "at", "root": "end"})))
    where = where.join(ends, "at", "left").select("id", F.coalesce("end", "at").alias("at"))
    smallest = where.groupBy("at").agg(F.min("id").alias("root"))
    return cut(where.join(smallest, "at").select("id", "root"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, dealt into blocks that meet in tasks.

    placed: key, band, doc_id, root. A bucket's members of its most frequent component don't meet each other; the others
    (stragglers) make blocks of their own, each of which meets itself, every other of them and every block of the frequent
    component. So what is copied are the stragglers, by the number of blocks, and the rest by that of straggler blocks. A
    bucket of at most MEMBERS rows is one block."""
    by_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    keys = by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("m"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda c: F.ceil(c / F.lit(MEMBERS)).cast("int")
    one = F.col("n") <= MEMBERS
    own = placed.join(cut(keys), "key").withColumn("bs", F.when(one, 1).otherwise(blocks(F.col("n") - F.col("m")))).withColumn("bl", F.when(one, 0).otherwise(blocks(F.col("m"))))
    frequent = ~one & (F.col("root") == F.col("main"))
    own = own.withColumn("block", F.when(frequent, F.col("bs") + F.pmod(F.xxhash64("doc_id"), F.col("bl"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("bs"))).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(frequent, F.col("bs")).otherwise(F.col("bs") + F.col("bl")) - 1)))
    return own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "doc_id", "root")


def clusters(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    Documents link if 100 * intersection >= percent * union of their sets of five-word shingles (words of anything but
    ASCII white space, A-Z lower-cased). Null and empty texts have no set and are linked with nothing. A doc_id is one
    vertex: rows that repeat it are returned as often, and where their texts differ it is linked with what any of them is
    linked with. A null doc_id is linked with nothing and has a null component, and is kept. An empty table gives no rows;
    other columns, whatever their names, go."""
    all_rows = cut(sketch(docs))
    rows = all_rows.where("doc_id is not null and sig is not null")
    classes = cut(rows.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", "rep"))
    classes = small_side(classes)
    # a class of one is its own representative; of others the smallest doc_id stands for all, once
    placed = rows.join(classes, "sig", "left")
    alone = placed.where("rep is null").select("doc_id", "bands", "odd")
    shown = placed.where("rep = doc_id").groupBy("sig", "doc_id").agg(F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    reps = cut(alone.unionByName(shown.select("doc_id", "bands", "odd")))
    several = rows.groupBy("doc_id").agg(F.min("sig").alias("s0"), F.max("sig").alias("s1")).where("s0 <> s1").select("doc_id")
    same = placed.select("doc_id", "rep").where("rep <> doc_id").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    buckets = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    shared = cut(buckets.join(hubs, "key").select("key", "band", "doc_id", "lo", "hi"))
    odd = reps.select("doc_id", "odd")
    # at first each member of a bucket against the bucket's smallest and largest, so many pairs as memberships at most
    ends = shared.select(F.col("doc_id").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
    pairs = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = pairs.join(odd.select(F.col("doc_id").alias("a"), F.col("odd").alias("odd_a")), "a").join(odd.select(F.col("doc_id").alias("b"), F.col("odd").alias("odd_b")), "b")
    different = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    links = cut(confirm(cut(pairs.where(estimate(different) >= least_estimate(percent)).select("a", "b").distinct()), docs, percent).union(same))
    roots = small_side(components(links))
    # then all that still stand in different components of one bucket
    placed = shared.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    more = cut(rest_links(_mixed(placed).join(reps, "doc_id").select("key", "i", "j", "block", "band", "doc_id", "root", "bands", "odd"), docs, percent))
    if not more.isEmpty():
        roots = small_side(components(links.union(more)))
    out = all_rows.select("doc_id", "n_shingles", "sig").join(classes, "sig", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = out.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component, that of its smallest doc_id; all columns stay, whatever their names.

    Of rows that repeat that doc_id the one with the least text stays (null is least). Texts without words are components
    of their own; rows with a null doc_id all stay. An empty table stays empty."""
    found = cut(clusters(docs, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("found_id")).agg(F.min("kept").alias("one"), F.count(F.lit(1)).alias("n")).where("not one or n > 1"))
    row = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").cast("long") == F.col("found_id")
    rest = row.join(small_side(found.select("found_id")), same, "left_anti")
    again = row.join(small_side(found.where("one")), same).groupBy("found_id").agg(F.min_by("row", F.coalesce(F.concat(F.lit("1"), F.col("row.text").cast("string")), F.lit("0"))).alias("row"))
    return rest.unionByName(again.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


#: The same by joining whole sets, at 85 percent.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT y, root FROM r JOIN e ON x = id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
