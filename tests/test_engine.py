import json
import math
import random

import pytest
from pyspark.sql import functions as F

from featloom import functions, plans, sinks, sources, streaming
from featloom.catalog import Catalog, NotFound
from featloom.config import ConfigBuilder, parse_config, settings
from featloom.operators import learn, rows, stats, tokens
from featloom.schema import FeatureError, SchemaSpec
from featloom.selectors import Single

TOY = [
    "0 3:1 11:1 14:1 19:1 39:1 42:1 55:1 64:1 67:1 73:1 75:1 76:1 80:1 83:1 ",
    "0 3:1 6:1 17:1 27:1 35:1 40:1 57:1 63:1 69:1 73:1 74:1 76:1 81:1 103:1 ",
    "0 4:1 6:1 15:1 21:1 35:1 40:1 57:1 63:1 67:1 73:1 74:1 77:1 80:1 83:1 ",
    "1 5:1 6:1 15:1 22:1 36:1 41:1 47:1 66:1 67:1 72:1 74:1 76:1 80:1 83:1 ",
    "0 2:1 6:1 16:1 22:1 36:1 40:1 54:1 63:1 67:1 73:1 75:1 76:1 80:1 83:1 ",
]
CONFIG = """
transform_configs { base_config { input_features: "*:" } select_transform { } }
transform_configs { base_config { input_features: ":3" output_family: "bucketize1" }
  bucketize_transform { buckets: -inf buckets: 0 buckets: 1 buckets: 2 buckets: inf } }
"""


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("toy") / "a.txt"
    path.write_text("\n".join(TOY) + "\n")
    return str(path)


def vectors(session):
    return [dict(zip(r.indices, r["values"])) for r in session.to_df().orderBy("datum_id").collect()]


def test_golden(spark, toy):
    df = sources.read(spark, toy, "libsvm")
    sizes = sources.sizes(df)
    assert sizes == {"default": 104} and df.count() == 5
    s = plans.FeatureSession(df, parse_config(CONFIG), sizes=sizes)
    assert s.dim == 108 and s.output_schema.name(106) == ("bucketize1", "3[1,2)")
    for line, got, extra in zip(TOY, vectors(s), [106, 106, 105, 105, 105]):
        assert got == {int(x.split(":")[0]): 1.0 for x in line.split()[1:]} | {extra: 1.0}
    assert [r.label for r in s.to_df().orderBy("datum_id").collect()] == [0, 0, 0, 1, 0]
    text = [r.value for r in sinks.to_libsvm(s.to_df()).orderBy("datum_id").collect()]
    assert text[0] == TOY[0].strip() + " 106:1"
    assert sinks.to_text(s.to_df(0, 1)).first().value.startswith("sparse dim: 108 label: 0 weight: 1 | 3:1 ")
    assert [r.datum_id for r in s.rows(1, 3)] == [1, 2]


def small(spark, values, weight=1.0):
    data = [(i, 1.0, weight, [float(x) for x in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "datum_id long, label float, weight float, fam_d array<float>")


def test_bucketize_edges(spark):
    s = plans.FeatureSession(small(spark, [[0], [1], [2], [math.nan], [-1], [math.inf]]), [plans.Bucketize("d:0", [0, 1, 2])], sizes={"d": 1})
    assert vectors(s) == [{0: 1.0}, {1: 1.0}, {}, {}, {}, {}]
    many = plans.FeatureSession(small(spark, [[0.5], [19.5], [20]]), [plans.Bucketize("d:0", range(21))], sizes={"d": 1})
    assert vectors(many) == [{0: 1.0}, {19: 1.0}, {}]
    with pytest.raises(ValueError):
        plans.Bucketize("d:0", [1, 1])
    assert [s.output_schema.name(i)[1] for i in range(2)] == ["0[0,1)", "0[1,2)"]
    wide = plans.FeatureSession(small(spark, [[12.5, 100]]), [plans.Bucketize("d:0-1", [12.5, 100, 1000])], sizes={"d": 2})
    assert vectors(wide) == [{0: 1.0, 3: 1.0}] and wide.output_schema.name(1)[1] == "0[1e+02,1e+03)"


def test_one_hot_by_first_sight_and_zero(spark):
    s = plans.FeatureSession(small(spark, [[5], [3], [5], [0], [7]]), [plans.OneHot("d:0")], sizes={"d": 1})
    assert s.dim == 4 and vectors(s) == [{1: 1.0}, {2: 1.0}, {1: 1.0}, {0: 1.0}, {3: 1.0}]
    with pytest.raises(Exception, match="dictionary"):
        s.on(small(spark, [[9]])).collect()
    skip = plans.FeatureSession(small(spark, [[5]]), [plans.OneHot("d:0", unknown="skip")], sizes={"d": 1})
    assert skip.on(small(spark, [[9]])).first().indices == []


def test_one_hot_of_a_large_dictionary(spark):
    df = spark.range(2500).select(F.col("id").alias("datum_id"), F.array((F.col("id") % 1200).cast("float")).alias("fam_d"))
    s = plans.FeatureSession(df, [plans.OneHot("d:0")], sizes={"d": 1})
    assert s.dim == 1200
    got = {r.datum_id: r.indices for r in s.to_df().collect()}
    assert got[0] == [0] and got[1] == [1] and got[1199] == [1199] and got[1201] == [1] and len(got) == 2500


def test_products_normalize_and_kmeans(spark):
    df = small(spark, [[3, 4], [0, 0]])
    s = plans.FeatureSession(df, [plans.Ngram("d:0-1,d:0-1")], sizes={"d": 2})
    assert vectors(s) == [{0: 9.0, 1: 12.0, 2: 12.0, 3: 16.0}, {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0}]
    n = vectors(plans.FeatureSession(df, [plans.Normalize("d:")], sizes={"d": 2}))
    assert n[0] == pytest.approx({0: 0.12, 1: 0.16}) and all(math.isnan(x) for x in n[1].values())
    assert vectors(plans.FeatureSession(df.limit(1), [plans.Normalize("d:", "l1")], sizes={"d": 2}))[0] == pytest.approx({0: 3 / 7, 1: 4 / 7})
    k = plans.FeatureSession(df, [plans.KMeansAssign("d:", [[3, 4], [0, 0], [0, 0]])], sizes={"d": 2})
    assert vectors(k) == [{0: 1.0, 1: 0.0, 2: 0.0}, {0: 0.0, 1: 1.0, 2: 0.0}]
    with pytest.raises(FeatureError):
        plans.FeatureSession(df, [plans.KMeansAssign("d:", [[1, 2, 3]])], sizes={"d": 2})
    sparse = sources.parse_libsvm(spark.createDataFrame([(0, "1 "), (1, "1 0:2")], "datum_id long, value string"))
    assert vectors(plans.FeatureSession(sparse, [plans.Normalize("default:")], sizes={"default": 3})) == [{}, {0: 0.5}]


def test_logit_hash_model_and_weights(spark):
    s = plans.FeatureSession(small(spark, [[0.5, 0.999]], weight=0.0), [plans.Logit("d:", -2, 2)], sizes={"d": 2})
    assert vectors(s) == [{0: 0.0, 1: 2.0}] and s.to_df().first().weight == 1.0
    with pytest.raises(Exception, match="not between"):
        plans.FeatureSession(small(spark, [[1.0]]), [plans.Logit("d:", -2, 2)], sizes={"d": 1}).to_df().collect()
    h = plans.FeatureSession(small(spark, [[1, 2, 3, 4]]), [plans.HashTrick("d:", 2)], sizes={"d": 4})
    assert sum(vectors(h)[0].values()) == 10 and list(vectors(h)[0]) == sorted(vectors(h)[0])
    model = plans.transforms.mlp([([[1.0], [1.0]], [0.5], "linear")])
    assert vectors(plans.FeatureSession(small(spark, [[1, 2]]), [plans.ModelInference("d:", model, 1)], sizes={"d": 2})) == [{0: 3.5}]


def test_intermediate_dense_output_and_sessions(spark):
    df = small(spark, [[1, 2, 0]])
    t = [plans.Select("d:1+2", output_family="a", intermediate=True), plans.Select("a:"), plans.Constant(3.15)]
    s = plans.FeatureSession(df, t, "dense", {"d": 3})
    assert s.to_df().first().dense == pytest.approx([2.0, 0.0, 3.15]) and s.output_schema.name(2)[1] == "constant3.2"
    pool = plans.Sessions()
    assert pool.open("x", df, t, sizes={"d": 3}) is pool.open("x", df, t, sizes={"d": 3})
    with pytest.raises(ValueError):
        pool.open("x", df, t[1:], sizes={"d": 3})
    pool.close("x")
    pool.close("x")
    with pytest.raises(KeyError):
        pool.close("x")
    with pytest.raises(FeatureError):
        plans.FeatureSession(df, t[:1], sizes={"d": 3})

    @plans.register_transform("twice")
    class Twice(plans.Transform):
        def plan(self, ctx):
            return plans.transforms.Plan(1, ["twice"], lambda offset: F.array(F.struct(F.lit(offset).cast("long").alias("i"), (F.get("fam_d", F.lit(0)) * 2).cast("float").alias("v"))))

    built = ConfigBuilder().select("d:1").twice("d:0").build()
    assert vectors(plans.FeatureSession(df, built, sizes={"d": 3})) == [{0: 2.0, 1: 2.0}]


def test_pipeline_model(spark):
    from pyspark.ml.clustering import KMeansModel

    df = small(spark, [[0, 0], [9, 9], [0, 1]])
    table = learn.ml_table(plans.FeatureSession(df, [plans.Select("d:")], sizes={"d": 2}).to_df(), 2)
    model = learn.kmeans(table, 2, 5)
    assert isinstance(model, KMeansModel)
    t = plans.PipelineModelTransform("d:", model, 1, output_col="prediction")
    got = [v[0] for v in vectors(plans.FeatureSession(df, [t], sizes={"d": 2}))]
    assert got[0] == got[2] != got[1] and len(learn.polynomial(table).first().expanded) == 5


def test_family_format(spark, tmp_path):
    (tmp_path / "f.txt").write_text("# |user 5 |ad 4\n0 1 | user 0:3.4 1:4 | ad 3:5.3\n1 2.5 |ad 0:1\n1 |0:3 1:4\n")
    df = sources.read(spark, str(tmp_path / "f.txt"), "family")
    e = stats.long_form(df, SchemaSpec.of(df, {"user": 5, "ad": 4, "default": 2})).join(df.select("datum_id", "label", "weight"), "datum_id")
    got = sorted((r.label, r.weight, r.family, r.feature, round(r.value, 4)) for r in e.collect())
    assert got == sorted([(0, 1, "user", 0, 3.4), (0, 1, "user", 1, 4), (0, 1, "ad", 3, 5.3), (1, 2.5, "ad", 0, 1), (1, 1, "default", 0, 3), (1, 1, "default", 1, 4)])
    with pytest.raises(Exception, match="no header"):
        sources.parse_family(spark.createDataFrame([(0, "1 |odd 1:2")], "datum_id long, value string"), families={"user": 1}).collect()


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("y,x,z\n1,2,0.5\n0,3,\n")
    df = sources.read(spark, str(tmp_path / "a.csv"), "csv", label="y")
    assert vectors(plans.FeatureSession(df, [plans.Select("default:x+z")])) == [{0: 2.0, 1: 0.5}, {0: 3.0}]
    (tmp_path / "c.tsv").write_text("\t".join(["1"] + ["5"] + [""] * 12 + ["ff"] + [""] * 25) + "\n")
    r = sources.read(spark, str(tmp_path / "c.tsv"), "criteo").first()
    assert (r.label, r.i1, r.i2, r.c1, r.c2) == (1, 5, None, "ff", None)
    import numpy as np

    (tmp_path / "b.bin").write_bytes(np.array([[1, 2, 3], [0, 4, 5]], "<f4").tobytes())
    b = sources.read(spark, str(tmp_path / "b.bin"), "bin", dim=2)
    assert sorted((r.label, tuple(r.fam_default)) for r in b.collect()) == [(0.0, (4.0, 5.0)), (1.0, (2.0, 3.0))]
    with pytest.raises(KeyError):
        sources.read(spark, "x", "odd")
    lines = sources.read_lines(spark, str(tmp_path / "a.csv"), header=1)
    assert [(r.datum_id, r.value) for r in lines.orderBy("datum_id").collect()] == [(0, "1,2,0.5"), (1, "0,3,")]


def test_catalog(spark, toy, tmp_path):
    c = Catalog(spark, str(tmp_path / "db"))
    assert c.create("t") and not c.create("t") and c.names() == ["t"]
    report = c.ingest("t", toy, "libsvm")
    assert report["rows"] == 5 and report["sizes"] == {"default": 104}
    assert c.ingest("t", toy, "libsvm")["total_rows"] == 10
    assert sorted(r.datum_id for r in c.get("t").select("datum_id").collect()) == list(range(10))
    s = plans.FeatureSession(c.get("t"), [plans.Select("default:")], schema=c.schema("t"))
    assert s.dim == 104 and "datum_id" in s.to_df(2, 4)._jdf.queryExecution().executedPlan().toString()
    st = {r.feature: r for r in c.stats("t").collect()}
    assert st[3].sum == 4 and st[3].min == 0 and st[3].max == 1 and st[3].n_rows == 10
    (tmp_path / "x.txt").write_text("1 1:5\n")
    (tmp_path / "x.txt.meta.json").write_text(json.dumps({"feature_dim": 7, "feature_one_based": True}))
    c.create("m")
    assert c.ingest("m", str(tmp_path / "x.txt"), "libsvm")["sizes"] == {"default": 7}
    assert c.get("m").first().fam_default.indices == [0]
    with pytest.raises(NotFound):
        c.get("none")
    c.drop("m")
    assert c.names() == ["t"]


def test_rows_and_stats(spark):
    assert rows.shares(10, 3) == [(0, 3), (3, 6), (6, 10)]
    df = spark.range(100).withColumnRenamed("id", "datum_id")
    assert rows.row_range(df, 5, -1).count() == 95 and rows.subsample(df, 0.0).count() == 0 and rows.subsample(df, 1.0).count() == 100
    assert rows.exclude_outliers(df.withColumn("x", F.col("datum_id").cast("double")), ["x"], 0.1, 0.9).count() == 81
    with pytest.raises(ValueError):
        rows.time_range(df, "t", "yesterday")
    numbers = stats.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), "x")
    assert numbers.where("x <> pos").count() == 0
    assert stats.numbered(spark.range(0).toDF("x"), "x").count() == 0
    d = small(spark, [[5], [3], [0], [5]])
    feature = Single(SchemaSpec.of(d, {"d": 1}).family("d"), 0)
    assert [(r.value, r.pos) for r in stats.positions(d, feature).orderBy("pos").collect()] == [(0.0, 0), (5.0, 1), (3.0, 2)]
    assert stats.is_factor(d, feature)


def test_tokens_and_learning(spark, tmp_path):
    df = spark.createDataFrame([(0, "B~a a"), (1, None), (2, "c")], "id long, t string")
    d = tokens.token_dictionary(df, "t")
    assert {r.token: r.id for r in d.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.datum_id: r.indices for r in tokens.binarize(df, "id", "t", d).collect()} == {0: [0, 1], 1: [], 2: [2]}
    assert tokens.split_column(df.withColumn("p", F.lit("x, y")), "p", ["u", "v", "w"]).select("u", "v", "w").first() == ("x", "y", None)
    ids = tokens.category_ids(df, "id", ["t"])
    assert sorted(r.id for r in ids.collect()) == [13, 14]
    assert {r.datum_id: r.indices for r in tokens.categories(df, "id", ["t"], ids).collect()} == {0: [13], 2: [14]}
    data = [(i, float(i % 2), 1.0, [float(i % 2), 1.0]) for i in range(40)]
    v = plans.FeatureSession(spark.createDataFrame(data, "datum_id long, label float, weight float, fam_d array<float>"), [plans.Select("d:")], sizes={"d": 2}).to_df()
    w = learn.sgd(v, rate=1.0, epochs=3)
    learn.save_weights(w, str(tmp_path / "w"))
    found = {(r.feature_id, r["class"]): r.weight for r in learn.load_weights(spark, str(tmp_path / "w")).collect()}
    assert found[0, 1] > 0.2 and set(found) == {(0, 1), (1, 1)}
    assert learn.logistic(learn.ml_table(v, 2)).coefficients[0] > 1
    made = learn.synthetic(spark, 200, 50, 5)
    assert made.count() == 200 and made.agg(F.sum(F.size("fam_default.indices"))).first()[0] > 50


def test_learning_at_a_large_width(spark):
    """Sparse rows stay sparse, and no plan holds the weights."""
    dim, rng = 1_000_000, random.Random(1)
    rows = [(i, float(i % 2), 1.0, dim, sorted(rng.sample(range(dim), 5) + [dim + 1 + i % 2]), [1.0] * 6) for i in range(60)]
    v = spark.createDataFrame(rows, "datum_id long, label float, weight float, dim long, indices array<long>, values array<float>")
    first = learn.ml_table(v, dim + 4).where("datum_id = 0").first().features
    assert first.size == dim + 4 and list(first.indices) == rows[0][4]
    assert learn.ml_table(v, dim + 4).schema["features"].dataType.typeName() == "vectorudt"
    w = learn.sgd(v, rate=0.5, epochs=2)
    by = {r.feature_id: r.weight for r in w.collect()}
    assert len(by) <= 302 and by[dim + 2] > 0.2 > -0.2 > by[dim + 1]
    three = v.withColumn("label", F.col("datum_id") % 3)
    sums = learn.sgd(three, classes=3, rate=0.5, epochs=2).groupBy("feature_id").agg(F.sum("weight").alias("w"))
    assert sums.where("abs(w) > 1e-9").count() == 0


def test_one_scan_for_all_dictionaries_and_families(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("datum_id"), *[F.struct((F.col("id") % (k + 2)).cast("float").alias("x")).alias(f"fam_{k}") for k in range(6)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    schema = SchemaSpec.of(df)
    plan = stats.long_form(df, schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    s = plans.FeatureSession(df, [plans.OneHot([f"{k}:x" for k in range(6)])])
    assert s.dim == sum(range(2, 8)) and all(len(v) == 6 for v in vectors(s))


def test_hash_trick_of_wide_rows(spark):
    values = [float(k % 7) for k in range(5000)]
    s = plans.FeatureSession(small(spark, [values]), [plans.HashTrick("d:", 50)], sizes={"d": 5000})
    got = vectors(s)[0]

    def mix(x):
        x %= 2147483647
        for factor, shift in functions.STEPS:
            x = (x + 1) * factor % functions.MODULUS
            x ^= x >> shift
        return x

    want = [0.0] * 50
    for k, x in enumerate(values):
        want[mix(k) % 50] += x
    assert got == pytest.approx(dict(enumerate(want)))


def test_failed_ingest_leaves_the_table_as_it_was(spark, toy, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path / "db"))
    c.create("t")
    c.ingest("t", toy, "libsvm")

    def fails(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(stats, "partial_stats", fails)
        with pytest.raises(OSError):
            c.ingest("t", toy, "libsvm")
    assert c.meta("t")["rows"] == 5 and c.get("t").count() == 5
    c.ingest("t", toy, "libsvm", collect_stats=False)
    assert sorted(r.datum_id for r in c.get("t").collect()) == list(range(10))
    assert {r.n_rows for r in c.stats("t").collect()} == {10} and {r.feature: r.sum for r in c.stats("t").collect()}[3] == 4
    with pytest.raises(ValueError):
        c.create("_values")
    other = Catalog(spark, str(tmp_path / "db"))
    other._version = lambda name: 1  # has not seen the last commit
    monkeypatch.setattr(other, "_put", fails)
    with pytest.raises(OSError):
        other.ingest("t", toy, "libsvm")
    assert c.meta("t")["rows"] == 10


def test_sides_of_joins_are_measured(spark):
    from featloom import session

    df = spark.createDataFrame([(1, "é" * 100, [1, 2], [("a", 1)], {"k": "v"}), (None, None, None, None, None)], "a long, b string, c array<int>, d array<struct<x:string,y:int>>, e map<string,string>")
    assert 300 < session.frame_bytes(df) < 700 and session.frame_bytes(df.limit(0)) == 0
    small = session.small_side(df)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small.lower()


def test_streams(spark, toy, tmp_path):
    table = sources.read(spark, toy, "libsvm")
    table.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    t = [plans.Select("default:"), plans.OneHot("default:3")]
    stream = streaming.transform_stream(streaming.stream_table(spark, str(tmp_path / "in"), stored), stored, t, sizes={"default": 104})
    streaming.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c1"))
    want = plans.FeatureSession(stored, t, sizes={"default": 104}).to_df()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))
    words = tmp_path / "words"
    words.mkdir()
    (words / "1.txt").write_text("b\na\nb\n")
    merge = streaming.dictionary_merge(spark, str(tmp_path / "dict"), "value")
    streaming.each_batch(spark.readStream.text(str(words)), merge, str(tmp_path / "c2"))
    (words / "2.txt").write_text("a\nc\n")
    streaming.each_batch(spark.readStream.text(str(words)), merge, str(tmp_path / "c2"))
    assert {r.value: r.id for r in spark.read.parquet(str(tmp_path / "dict/version=1")).collect()} == {"a": 0, "b": 1, "c": 2}


def test_config(spark):
    t = parse_config('transform_configs { base_config { input_features: "a:" output_store_type: SPARSE_NUM output_family: "x:" } kmeans_transform { model_path: "/m" num_cluster_centers: 2 feature_dim: 3 } }')[0]
    assert t.intermediate and t.output_family == "x" and (t.model_path, t.k, t.dim) == ("/m", 2, 3)
    assert parse_config("transform_configs { constant_transform { constant: -1.5 } }")[0].value == -1.5
    for bad in ("transform_configs { dnn_transform { } }", "transform_configs { } }", "transform_configs { base_config { } }"):
        with pytest.raises((KeyError, ValueError)):
            parse_config(bad)
    assert settings('# c\nport: 5\nname: "x" # d\nrate: 0.5') == {"port": 5, "name": "x", "rate": 0.5}
