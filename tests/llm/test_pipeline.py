import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
import test_operators as t


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, x, "en", "s", len(x or "")) for i, x in t.corpus(5) if i != 7]
    item = " ".join(f"q{i}" for i in range(30)) + ". The answer is here."
    run = "\n".join(" ".join(rng.choice(t.VOCAB) for _ in range(30)) for _ in range(3))
    for k in range(3):
        own = " ".join(rng.choice(t.VOCAB) for _ in range(90))
        rows.append((600 + k, f"{own}\n{run}", "en", "s", 0))
        rows.append((700 + k, f"{own[::-1]} {item if k else ''}", "en", "s", 0))
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [(i, x) for i, x, *_ in rows if (m := t.brute_rules(x)) and all(not bad(dict(zip(t.quality_rules.MEASURES, m))) for _, _, bad in t.quality_rules.RULES)]
    gone = t.brute_lines(want, 50)
    cut = lambda i, x: "\n".join(y for k, y in enumerate(x.split("\n")) if not any(a <= k <= b for a, b in gone.get(i, [])))
    want = [(i, cut(i, x)) for i, x in want]
    want = [(i, x) for i, x in want if t.WORD.search(x)]
    assert any(gone)
    keep = {i for i, _, _, k in t.brute_clusters(want, 80) if k}
    want = [(i, x) for i, x in want if i in keep]
    clean = [(i, x) for i, x in want if " ".join(item.split()) not in " ".join(x.split())]
    assert len(clean) < len(want)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = None
    for _, stage in corpus_pipeline.STAGES:
        assert out is None or out.columns == docs.columns
        out = stage(spark, docs if out is None else out, str(tmp_path))
        out.write.mode("overwrite").parquet(str(tmp_path / f"stage{corpus_pipeline.STAGES.index((_, stage))}"))
        out = spark.read.parquet(str(tmp_path / f"stage{corpus_pipeline.STAGES.index((_, stage))}"))
    import hashlib

    got = sorted((r.doc_id, r.decoded_sha256) for r in out.collect())
    assert got == sorted((i, hashlib.sha256(x.encode()).hexdigest()) for i, x in clean)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.decoded_sha256) for r in again.collect()) == got


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, path, rows, items):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("gone_id", "found_id", "bad_id", "bad_h", "row", "spans", "h", "j", "name", "rep", "one", "key", "ids", "rest", "m"):
        df = df.withColumn(c, t.F.lit(1))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_of_nothing(spark, tmp_path):
    """Empty documents, and no benchmark."""
    docs = put(spark, str(tmp_path), [], [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        docs = out if name != "encoding" else docs
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, ties, columns whose names clash, benchmark items without a word."""
    rng = random.Random(2)
    good = [" ".join(rng.choice(t.VOCAB) + str(rng.randrange(50)) for _ in range(120)) for _ in range(6)]
    item = " ".join(f"z{i}" for i in range(20)) + ". An answer."
    rows = [(1, good[0], None, None, None), (1, good[0], "en", "s", 3), (2, good[0], "en", "s", 3), (3, good[1], "en", "s", 3), (3, good[2], "en", "s", 3), (None, good[3], "en", "s", 3), (None, None, None, None, None),
            (5, None, "en", "s", 0), (6, "", "en", "s", 0), (7, f"{good[4]} {item}", "en", "s", 3), (None, f"{good[5]} {item}", "en", "s", 3)]
    docs = put(spark, str(tmp_path), rows, [(1, item), (None, item), (2, None), (3, ""), (4, "...")])
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stages[name](spark, df, str(tmp_path))
    kept = run("quality rules", docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 1 2 3 3 None 7 None".split())
    lines = run("line dedup", kept)
    assert lines.columns == docs.columns and sorted(str(r.doc_id) for r in lines.collect()) == sorted("1 1 3 3 None 7 None".split())
    near = run("near dedup", kept)  # one row of each group and id; all without an id
    assert near.columns == docs.columns and sorted(str(r.doc_id) for r in near.collect()) == sorted("1 3 7 None None".split())
    assert {r.text for r in near.where("doc_id = 3").collect()} == {min(good[1:3])}
    clean = run("benchmark decontamination", kept)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted("1 1 2 3 3 None".split())
    encoded = run("encoding", docs)
    assert encoded.count() == len(rows) and sorted(r.n_tokens for r in encoded.where("doc_id in (5, 6)").collect()) == [0, 0]
