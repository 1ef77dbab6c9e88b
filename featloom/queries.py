"""Queries over the driver's tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import plans, sinks, sources, streaming
from .catalog import Catalog
from .config import ConfigBuilder, parse_config, settings
from .operators import learn, rows, stats, tokens
from .schema import SchemaSpec
from .selectors import Single
from .session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf):
    df = _t(spark, sf, "events").withColumn("user_mod", (F.col("user_id") % 7).cast("int")).withColumn("hour", F.hour("ts"))
    return sources.from_table(df, {"e": ["value", "user_mod", "hour"]}, "event_id")


def lines(spark, sf):
    df = _t(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return sources.from_table(df, {"price": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"]}, "id", label="l_linenumber", weight="l_tax")


def vectors(spark, sf):
    return sources.from_table(_t(spark, sf, "embeddings"), {"v": "embedding"}, "vec_id", label="label")


def _long(df: DataFrame, transforms, output: str = "sparse", sizes=None) -> DataFrame:
    return plans.FeatureSession(df, transforms, output, sizes).long().withColumn("value", F.col("value").cast("double"))


V = {"v": 64}
EVENTS = "SELECT event_id AS datum_id, value::FLOAT AS v, (user_id % 7)::FLOAT AS u, hour(ts)::FLOAT AS h FROM events"
BUCKETS = [0.0, 10.0, 50.0, 100.0, 200.0]


def _bucket_sql(column: str, bounds: list[float], offset: int, source: str) -> str:
    cases = " ".join(f"WHEN {column} >= {a}::FLOAT AND {column} < {b}::FLOAT THEN {offset + j}" for j, (a, b) in enumerate(zip(bounds, bounds[1:])))
    return f"SELECT * FROM (SELECT datum_id, (CASE {cases} END)::BIGINT AS feature_id, 1.0::DOUBLE AS value FROM {source}) WHERE feature_id IS NOT NULL"


def _onehot_sql(column: str, offset: int, source: str) -> str:
    return f"""SELECT datum_id, ({offset} + CASE WHEN x = 0 THEN 0 ELSE pos END)::BIGINT AS feature_id, 1.0::DOUBLE AS value FROM (SELECT datum_id, {column} AS x FROM {source}) LEFT JOIN
      (SELECT x, row_number() OVER (ORDER BY first, x) AS pos FROM (SELECT {column} AS x, min(datum_id) AS first FROM {source} WHERE {column} <> 0 GROUP BY 1)) USING (x)"""


@query(f"""WITH e AS ({EVENTS})
SELECT datum_id, 0::BIGINT AS feature_id, v::DOUBLE AS value FROM e WHERE v <> 0 UNION ALL {_bucket_sql("v", BUCKETS, 1, "e")}
UNION ALL {_onehot_sql("u", 5, "e")} UNION ALL SELECT datum_id, (SELECT 5 + 1 + count(DISTINCT u) FILTER (u <> 0) FROM e)::BIGINT, 3.15::FLOAT::DOUBLE FROM e""")
def flagship(spark, sf):
    return _long(events(spark, sf), [plans.Select("e:value"), plans.Bucketize("e:value", BUCKETS), plans.OneHot("e:user_mod"), plans.Constant(3.15)])


@query("""SELECT datum_id, 0::BIGINT AS feature_id, p::DOUBLE AS value FROM (SELECT l_orderkey * 8 + l_linenumber AS datum_id, l_extendedprice::FLOAT AS p, l_discount::FLOAT AS d, l_tax::FLOAT AS t FROM lineitem) WHERE p <> 0
UNION ALL SELECT l_orderkey * 8 + l_linenumber, 1, l_discount::FLOAT::DOUBLE FROM lineitem UNION ALL SELECT l_orderkey * 8 + l_linenumber, 2, l_tax::FLOAT::DOUBLE FROM lineitem""")
def t1_select(spark, sf):
    return _long(lines(spark, sf), [plans.Select(["price:l_extendedprice", "rate:"])])


@query("SELECT vec_id AS datum_id, i::BIGINT AS feature_id, embedding[3 + i]::FLOAT::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(0, 6)) AS i FROM embeddings)")
def p6_range(spark, sf):
    return _long(vectors(spark, sf), [plans.Select("v:2-7")], sizes=V)


@query("SELECT vec_id AS datum_id, i::BIGINT AS feature_id, embedding[i + 1]::FLOAT::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)")
def p8_all_families(spark, sf):
    return _long(vectors(spark, sf), [plans.Select("*:")], sizes=V)


@query("SELECT vec_id AS datum_id, k::BIGINT AS feature_id, embedding[[2, 6][k + 1]]::FLOAT::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest([0, 1]) AS k FROM embeddings) WHERE embedding[[2, 6][k + 1]]::FLOAT <> 0")
def p7_several(spark, sf):
    return _long(vectors(spark, sf), [plans.Select("v:1+5")], sizes=V)


ACCT = "SELECT c_custkey AS datum_id, c_acctbal::FLOAT AS b FROM customer"


@query(f"""WITH e AS ({ACCT}) {_bucket_sql("b", [-1000.0, 0.0, 12.5, 5000.0], 0, "e")}""")
def t2_bucketize(spark, sf):
    df = sources.from_table(_t(spark, sf, "customer"), {"c": ["c_acctbal"]}, "c_custkey")
    return _long(df, [plans.Bucketize("c:c_acctbal", [-1000, 0, 12.5, 5000])])


@query(f"WITH e AS (SELECT p_partkey AS datum_id, p_size::FLOAT AS s FROM part) {_onehot_sql('s', 0, 'e')}")
def t3_one_hot(spark, sf):
    return _long(sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey"), [plans.OneHot("p:p_size")])


@query(f"WITH e AS (SELECT p_partkey AS datum_id, p_retailprice::FLOAT AS s FROM part) {_onehot_sql('s', 0, 'e')}")
def t3_one_hot_joined(spark, sf):
    """A dictionary that may be larger than what is looked up in a literal."""
    return _long(sources.from_table(_t(spark, sf, "part"), {"p": ["p_retailprice"]}, "p_partkey"), [plans.OneHot("p:p_retailprice")])


@query("""SELECT vec_id AS datum_id, (i * 4 + j)::BIGINT AS feature_id, (embedding[i + 1]::FLOAT * embedding[j + 9]::FLOAT)::FLOAT::DOUBLE AS value
FROM (SELECT vec_id, embedding, i, unnest(range(0, 4)) AS j FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS i FROM embeddings))""")
def t4_ngram(spark, sf):
    return _long(vectors(spark, sf), [plans.Ngram(["v:0-3", "v:8-11"])], sizes=V)


@query("SELECT o_orderkey AS datum_id, 0::BIGINT AS feature_id, 3.15::FLOAT::DOUBLE AS value FROM orders")
def t5_constant(spark, sf):
    return _long(sources.from_table(_t(spark, sf, "orders"), {"o": ["o_totalprice"]}, "o_orderkey"), [plans.Constant(3.15)])


CENTERS = [[0.1] * 4, [-0.1] * 4, [0.1, -0.1, 0.1, -0.1]]
_DISTANCE = ", ".join("(" + " + ".join(f"(embedding[{i + 1}]::FLOAT::DOUBLE - {x}::FLOAT::DOUBLE) * (embedding[{i + 1}]::FLOAT::DOUBLE - {x}::FLOAT::DOUBLE)" for i, x in enumerate(c)) + ")" for c in CENTERS)


@query(f"""SELECT datum_id, k::BIGINT AS feature_id, CASE WHEN list_position(d, list_min(d)) = k + 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS value
FROM (SELECT vec_id AS datum_id, [{_DISTANCE}] AS d, unnest(range(0, 3)) AS k FROM embeddings)""")
def t6_kmeans(spark, sf):
    return _long(vectors(spark, sf), [plans.KMeansAssign("v:0-3", CENTERS, k=3, dim=4)], sizes=V)


def _normalize_sql(total: str) -> str:
    return f"""SELECT vec_id AS datum_id, i::BIGINT AS feature_id, round((x[i + 1] / {total})::FLOAT::DOUBLE, 5) + 0.0 AS value
FROM (SELECT vec_id, x, unnest(range(0, 8)) AS i FROM (SELECT vec_id, [y::FLOAT::DOUBLE FOR y IN embedding[1:8]] AS x FROM embeddings))"""


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.withColumn("value", F.round("value", digits) + F.lit(0.0))


@query(_normalize_sql("list_sum([y * y FOR y IN x])"))
def t7_normalize(spark, sf):
    return _rounded(_long(vectors(spark, sf), [plans.Normalize("v:0-7")], sizes=V))


@query(_normalize_sql("sqrt(list_sum([y * y FOR y IN x]))"))
def t7_normalize_l2(spark, sf):
    return _rounded(_long(vectors(spark, sf), [plans.Normalize("v:0-7", "l2")], sizes=V))


@query("""SELECT vec_id AS datum_id, k::BIGINT AS feature_id, round(greatest(s[k + 1], 0)::FLOAT::DOUBLE, 4) + 0.0 AS value FROM (SELECT vec_id, unnest([0, 1]) AS k,
[embedding[1]::DOUBLE + embedding[2]::DOUBLE + 0.5, embedding[1]::DOUBLE - embedding[2]::DOUBLE] AS s FROM embeddings)""")
def t8_model(spark, sf):
    model = plans.transforms.mlp([([[1.0, 1.0], [1.0, -1.0]], [0.5, 0.0], "relu")])
    return _rounded(_long(vectors(spark, sf), [plans.ModelInference("v:0-1", model, 2)], sizes=V), 4)


@query("""SELECT event_id AS datum_id, 0::BIGINT AS feature_id, round(greatest(-3.0, least(3.0, ln(p / (1 - p))))::FLOAT::DOUBLE, 5) + 0.0 AS value
FROM (SELECT event_id, ((value + 1) / 1000)::FLOAT::DOUBLE AS p FROM events)""")
def t9_logit(spark, sf):
    df = _t(spark, sf, "events").withColumn("p", (F.col("value") + 1) / 1000)
    return _rounded(_long(sources.from_table(df, {"e": ["p"]}, "event_id"), [plans.Logit("e:p", -3.0, 3.0)]))


@query(f"""SELECT datum_id, ({fn.mix31_sql('i')} % 16)::BIGINT AS feature_id, round(sum(x)::FLOAT::DOUBLE, 4) + 0.0 AS value
FROM (SELECT vec_id AS datum_id, i, embedding[i + 1]::FLOAT::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)) GROUP BY 1, 2""")
def t10_hash(spark, sf):
    return _rounded(_long(vectors(spark, sf), [plans.HashTrick("v:", 16)], sizes=V), 4)


@query("""WITH t AS (SELECT vec_id, embedding[2]::FLOAT AS a, embedding[3]::FLOAT AS b, embedding[11]::FLOAT AS c, embedding[12]::FLOAT AS d FROM embeddings),
e AS (SELECT vec_id AS datum_id, unnest([[0, a], [1, b]]) AS x, [[0, c], [1, d]] AS ys FROM t WHERE a <> 0 AND b <> 0 AND c <> 0 AND d <> 0)
SELECT datum_id, x[1]::BIGINT AS feature_id, x[2]::FLOAT::DOUBLE AS value FROM e
UNION ALL SELECT datum_id, (2 + x[1] * 2 + y[1])::BIGINT, (x[2]::FLOAT * y[2]::FLOAT)::FLOAT::DOUBLE FROM (SELECT datum_id, x, unnest(ys) AS y FROM e)""")
def t14_intermediate(spark, sf):
    config = """
    transform_configs { base_config { input_features: "v:1+2" output_family: "a" output_store_type: SPARSE_NUM } select_transform {} }
    transform_configs { base_config { input_features: "v:10+11" output_family: "b" output_store_type: SPARSE_NUM } select_transform {} }
    transform_configs { base_config { input_features: "a:*" } select_transform {} }
    transform_configs { base_config { input_features: "a:*,b:*" } ngram_transform {} }"""
    return _long(vectors(spark, sf), parse_config(config), sizes=V)


@query("SELECT vec_id AS datum_id, i::BIGINT AS feature_id, CASE WHEN i = 4 THEN 2.5 ELSE embedding[i + 1]::FLOAT::DOUBLE END AS value FROM (SELECT vec_id, embedding, unnest(range(0, 5)) AS i FROM embeddings)")
def x9_dense(spark, sf):
    return _long(vectors(spark, sf), [plans.Select("v:0-3"), plans.Constant(2.5)], "dense", V)


# sources, sinks and row selectors


@query("SELECT o_orderkey AS datum_id, o_custkey::FLOAT::DOUBLE AS label, i::BIGINT AS feature, CASE i WHEN 3 THEN o_totalprice::FLOAT ELSE 7::FLOAT END::DOUBLE AS value FROM (SELECT *, unnest([3, 9]) AS i FROM orders)")
def s1_libsvm(spark, sf):
    text = F.format_string("%d 10:7 4:%s", "o_custkey", F.col("o_totalprice").cast("float").cast("string"))
    df = sources.parse_libsvm(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("datum_id"), text.alias("value")), feature_one_based=True)
    return df.select("datum_id", F.col("label").cast("double").alias("label"), F.explode(F.arrays_zip("fam_default.indices", "fam_default.values")).alias("p")).select("datum_id", "label", F.col("p.indices").cast("long").alias("feature"), F.col("p.values").cast("double").alias("value"))


@query("""SELECT o_orderkey AS datum_id, o_custkey::FLOAT::DOUBLE AS label, 2.5::DOUBLE AS weight, f AS family, CASE f WHEN 'user' THEN 1 ELSE 0 END::BIGINT AS feature, CASE f WHEN 'user' THEN o_totalprice::FLOAT ELSE 4::FLOAT END::DOUBLE AS value
FROM (SELECT *, unnest(['user', 'default']) AS f FROM orders)""")
def s2_family(spark, sf):
    text = F.format_string("%d 2.5 |user 1:%s | 0:4", "o_custkey", F.col("o_totalprice").cast("float").cast("string"))
    df = sources.parse_family(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("datum_id"), text.alias("value")), families={"user": 5})
    e = stats.long_form(df, SchemaSpec.of(df, {"user": 5, "default": 1}))
    return e.join(df.select("datum_id", "label", "weight"), "datum_id").select("datum_id", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), "family", "feature", F.col("value").cast("double").alias("value"))


@query(f"WITH e AS ({EVENTS}) SELECT datum_id, 0::BIGINT AS feature_id, v::DOUBLE AS value FROM e WHERE datum_id >= 100 AND datum_id < 600 AND v <> 0")
def s10_range(spark, sf):
    return plans.FeatureSession(events(spark, sf), [plans.Select("e:value")]).long(100, 600).withColumn("value", F.col("value").cast("double"))


@query("SELECT least(event_id // greatest(n // 3, 1), 2)::INTEGER AS worker, count(*) AS n_rows, min(event_id) AS first_row, max(event_id) AS last_row FROM events, (SELECT count(*) AS n FROM events) GROUP BY 1")
def s11_worker_split(spark, sf):
    df = _t(spark, sf, "events")
    n = df.count()
    return df.groupBy(rows.worker_of(F.col("event_id"), n, 3).alias("worker")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_row"), F.max("event_id").alias("last_row"))


@query("""SELECT p_partkey AS datum_id, concat('0 0:', p_size, CASE WHEN p_size >= 1 AND p_size < 10 THEN ' 1:1' WHEN p_size >= 10 AND p_size < 100 THEN ' 2:1' ELSE '' END) AS value FROM part""")
def k4_libsvm(spark, sf):
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey")
    return sinks.to_libsvm(plans.FeatureSession(df, [plans.Select("p:p_size"), plans.Bucketize("p:p_size", [1, 10, 100])]).to_df())


@query("SELECT p_partkey AS datum_id, concat('sparse dim: 2 label: ', p_size, ' weight: 1 | 0:', p_size, ' 1:2') AS value FROM part")
def k5_text(spark, sf):
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey", label="p_size")
    return sinks.to_text(plans.FeatureSession(df, [plans.Select("p:p_size"), plans.Constant(2)]).to_df())


@query("SELECT p_partkey % 5 AS partition_key, p_partkey AS datum_id, concat('0 1:', p_size) AS content FROM part")
def k11_keyed_lines(spark, sf):
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey")
    return sinks.partitioned_lines(plans.FeatureSession(df, [plans.Select("p:p_size")]).to_df(), 5, one_based=True)


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00' AND ts < TIMESTAMP '2024-02-01 12:00'")
def l3_time_range(spark, sf):
    return rows.time_range(_t(spark, sf, "events"), "ts", "2024-01-10", "2024-02-01 12:00").select("event_id", "value")


@query("""WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events)
SELECT event_id, value FROM events, s WHERE value >= v[ceil(0.05 * n)::INT] AND value <= v[ceil(0.95 * n)::INT]""")
def l1_outliers(spark, sf):
    """With an accuracy beyond the number of rows, so that the quantiles are exact."""
    return rows.exclude_outliers(_t(spark, sf, "events"), ["value"], 0.05, 0.95, accuracy=10_000_000).select("event_id", "value")


@query(f"SELECT event_id FROM events WHERE {fn.mix31_sql(fn.mix31_sql('event_id') + ' + 7')} % 1000000 < 100000")
def l2_subsample(spark, sf):
    return rows.subsample(_t(spark, sf, "events"), 0.1, 7, "event_id").select("event_id")


@query("SELECT event_id AS datum_id FROM events ORDER BY event_id LIMIT 50")
def l5_first_rows(spark, sf):
    """The feature is a bound on the rows of a session."""
    return rows.first_rows(events(spark, sf).select("datum_id"), 50)


# statistics


@query("""SELECT x AS value, min(id) AS first FROM (SELECT l_discount::FLOAT::DOUBLE AS x, l_orderkey * 8 + l_linenumber AS id FROM lineitem) WHERE x <> 0 GROUP BY x""")
def a1_dictionary(spark, sf):
    df = lines(spark, sf)
    return stats.dictionary(df, Single(SchemaSpec.of(df).family("rate"), 0)).select(F.col("value").cast("double").alias("value"), "first")


_CELLS = " UNION ALL ".join(f"SELECT '{f}' AS family, {k} AS feature, {c}::FLOAT::DOUBLE AS x FROM lineitem" for f, k, c in (("price", 0, "l_quantity"), ("price", 1, "l_extendedprice"), ("rate", 0, "l_discount"), ("rate", 1, "l_tax")))


@query(f"""SELECT family, feature::BIGINT AS feature, least(0, min(x))::DOUBLE AS min, greatest(0, max(x))::DOUBLE AS max, round(sum(x), 2) AS sum, count(*) AS n_stored, count(*) AS n_rows,
round(avg(x), 4) AS mean, round(var_pop(x), 2) AS var FROM ({_CELLS}) GROUP BY 1, 2""")
def a2_stats(spark, sf):
    df = lines(spark, sf)
    s = stats.compute_stats(df, SchemaSpec.of(df))
    return s.select("family", "feature", "min", "max", F.round("sum", 2).alias("sum"), "n_stored", "n_rows", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


@query("SELECT f AS feature, p, true AS within FROM (SELECT unnest(['l_quantity', 'l_extendedprice']) AS f), (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p)")
def a5_quantiles(spark, sf):
    """Whether the quantiles lie where they should, by the shares of rows below and up to them."""
    df, ps = _t(spark, sf, "lineitem"), [0.25, 0.5, 0.75]
    q = stats.quantiles(df, ["l_quantity", "l_extendedprice"], ps).select("feature", F.posexplode("quantiles").alias("k", "q"))
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("l_quantity", "l_extendedprice")])).alias("c")).select("c.*")
    share = cells.join(F.broadcast(q), "feature").groupBy("feature", "k").agg(F.avg((F.col("x") < F.col("q")).cast("double")).alias("a"), F.avg((F.col("x") <= F.col("q")).cast("double")).alias("b"))
    p = F.get(F.array(*map(F.lit, ps)), F.col("k"))
    return share.select("feature", p.alias("p"), ((F.col("a") <= p + 0.001) & (F.col("b") >= p - 0.001)).alias("within"))


@query("SELECT i::BIGINT AS feature_id, round(avg(x), 5) AS mean, round(var_samp(x), 5) AS var FROM (SELECT i, embedding[i + 1]::FLOAT::DOUBLE AS x FROM (SELECT embedding, unnest(range(0, 64)) AS i FROM embeddings)) GROUP BY i")
def a9_moments(spark, sf):
    s = plans.FeatureSession(vectors(spark, sf), [plans.Select("v:")], sizes=V)
    return stats.moments(s.to_df(), s.dim).select("feature_id", F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"))


@query("""WITH e AS (SELECT vec_id AS datum_id, i::BIGINT AS feature_id, embedding[i + 1]::FLOAT::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS i FROM embeddings)),
m AS (SELECT feature_id, avg(x) AS a, var_samp(x) AS v FROM e GROUP BY 1) SELECT datum_id, feature_id, round((x - a) / v, 3) + 0.0 AS value FROM e JOIN m USING (feature_id)""")
def a10_standardize(spark, sf):
    s = plans.FeatureSession(vectors(spark, sf), [plans.Select("v:0-3")], sizes=V)
    return _rounded(stats.standardize(s.to_df(), stats.moments(s.to_df(), s.dim)), 3)


@query("SELECT (SELECT count(*) FROM events WHERE value::FLOAT <> 0) + (SELECT count(*) FROM events) AS nnz")
def a11_nnz(spark, sf):
    return stats.nnz(plans.FeatureSession(events(spark, sf), [plans.Select("e:value"), plans.Constant(1)]).to_df())


@query("SELECT 'v' AS family, 63::BIGINT AS max_feature, 64 * count(*) AS n_entries FROM embeddings")
def a14_family_report(spark, sf):
    df = vectors(spark, sf)
    return stats.family_report(df, SchemaSpec.of(df, V))


# scalar functions and experiments


@query("SELECT o_orderkey AS id, o_custkey::INTEGER AS i, o_totalprice::FLOAT::DOUBLE AS f, o_custkey AS h, o_totalprice::FLOAT = ceil(o_totalprice::FLOAT) AS whole FROM orders")
def f_scalars(spark, sf):
    df = _t(spark, sf, "orders")
    f = F.col("o_totalprice").cast("float")
    return df.select(F.col("o_orderkey").alias("id"), fn.parse_int(F.concat(F.col("o_custkey").cast("string"), F.lit("abc"))).alias("i"), fn.parse_float(F.concat(f.cast("string"), F.lit(" x"))).cast("double").alias("f"), fn.hex_id(F.hex("o_custkey")).alias("h"), fn.is_categorical(f).alias("whole"))


@query("SELECT vec_id AS id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS s, round(list_sum([x::FLOAT::DOUBLE * x::FLOAT::DOUBLE FOR x IN embedding]), 4) AS d FROM embeddings")
def f9_math(spark, sf):
    v = F.col("embedding").cast("array<float>")
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(fn.sigmoid(F.get("embedding", F.lit(0)).cast("double")), 6).alias("s"), F.round(fn.dot(v, v), 4).alias("d"))


PARTS = "lower(replace(p_name, '~', ' '))"


@query(f"SELECT token, row_number() OVER (ORDER BY token COLLATE \"C\") - 1 AS id FROM (SELECT DISTINCT unnest(regexp_split_to_array({PARTS}, '\\s+')) AS token FROM part) WHERE token <> ''".replace(' COLLATE "C"', ""))
def e1_token_dictionary(spark, sf):
    return tokens.token_dictionary(_t(spark, sf, "part"), "p_name")


@query(f"""WITH t AS (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array({PARTS}, '\\s+')) AS token FROM part), d AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM t WHERE token <> ''))
SELECT p_partkey AS datum_id, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM t JOIN d USING (token) GROUP BY 1""")
def e2_binarize(spark, sf):
    df = _t(spark, sf, "part")
    out = tokens.binarize(df, "p_partkey", "p_name", tokens.token_dictionary(df, "p_name"))
    return out.select("datum_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT c_mktsegment AS value, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS id FROM customer GROUP BY 1")
def e4_labels(spark, sf):
    return tokens.encode_labels(_t(spark, sf, "customer"), "c_mktsegment", "c_custkey")


@query("""SELECT k AS "column", v AS value, 12 + row_number() OVER (ORDER BY first, k) AS id FROM (SELECT k, v, min(p_partkey) AS first FROM (
SELECT p_partkey, 0 AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part) GROUP BY 1, 2)""")
def e8_category_ids(spark, sf):
    return tokens.category_ids(_t(spark, sf, "part"), "p_partkey", ["p_brand", "p_type"])


@query("SELECT c_custkey AS datum_id, i::BIGINT AS feature, CASE i WHEN 0 THEN c_nationkey ELSE c_acctbal END::FLOAT::DOUBLE AS value FROM (SELECT *, unnest([0, 1]) AS i FROM customer) WHERE CASE i WHEN 0 THEN c_nationkey ELSE c_acctbal END::FLOAT <> 0")
def e6_table_to_sparse(spark, sf):
    df = tokens.to_sparse(_t(spark, sf, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])
    return stats.long_form(df, SchemaSpec.of(df, {"default": 2})).select("datum_id", "feature", F.col("value").cast("double").alias("value"))


@query("SELECT round(avg((CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END <> l.quality)::INT), 6) AS loss, round(-avg(ln(CASE WHEN l.quality = 1 THEN 0.8 ELSE 0.2 END)), 6) AS entropy FROM documents d JOIN labels l USING (doc_id)")
def e12_losses(spark, sf):
    df = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").select((F.col("n_chars") > 2000).cast("int").alias("p"), "quality")
    return df.agg(F.round(learn.zero_one_loss(F.col("p"), F.col("quality")), 6).alias("loss"), F.round(learn.cross_entropy(F.when(F.col("quality") == 1, 0.8).otherwise(0.2)), 6).alias("entropy"))


# learning

SAMPLE = "SELECT o_orderkey AS id, (o_totalprice > 200000)::INT AS x, (o_custkey % 5 < 2)::INT AS y, (o_orderkey % 10 / 10)::FLOAT::DOUBLE AS t, (o_custkey % 3)::INT AS c FROM orders"


def _sample(spark, sf, label: str = "y"):
    df = _t(spark, sf, "orders").withColumns({"x": (F.col("o_totalprice") > 200000).cast("int"), "t": F.col("o_orderkey") % 10 / 10, "y": (F.col("o_custkey") % 5 < 2).cast("int"), "c": (F.col("o_custkey") % 3).cast("int")})
    return sources.from_table(df, {"p": ["x", "t"]}, "o_orderkey", label=label)


@query(f"""WITH s AS ({SAMPLE}), p AS (SELECT avg(y) FILTER (x = 0) AS p0, avg(y) FILTER (x = 1) AS p1 FROM s)
SELECT unnest([0, 1]) AS place, round(unnest([ln(p0 / (1 - p0)), ln(p1 / (1 - p1)) - ln(p0 / (1 - p0))]), 2) AS weight FROM p""")
def e9_logistic(spark, sf):
    """Intercept and weight of one feature of 0 and 1, which are known in closed form."""
    s = plans.FeatureSession(_sample(spark, sf), [plans.Select("p:x")])
    model = learn.logistic(learn.ml_table(s.to_df(), s.dim))
    return spark.createDataFrame([(0, float(round(model.intercept, 2))), (1, float(round(model.coefficients[0], 2)))], "place int, weight double")


@query(f"""WITH s AS ({SAMPLE}), g1 AS (SELECT avg((0.5 - y) * x) AS a, avg((0.5 - y) * t) AS b FROM s), z AS (SELECT s.*, 1 / (1 + exp(a * x + b * t)) - y AS e, a, b FROM s, g1),
g2 AS (SELECT any_value(a) AS a, any_value(b) AS b, avg(e * x) AS c, avg(e * t) AS d FROM z) SELECT unnest([0, 1])::BIGINT AS feature_id, 1 AS class, round(unnest([-a - c, -b - d]), 6) AS weight FROM g2""")
def e10_sgd(spark, sf):
    """Two steps over all rows."""
    s = plans.FeatureSession(_sample(spark, sf), [plans.Select("p:x+t")])
    return learn.sgd(s.to_df(), rate=1.0, epochs=2).select("feature_id", "class", F.round("weight", 6).alias("weight"))


@query(f"""WITH s AS ({SAMPLE}) SELECT x, k AS class, round(avg((c = k)::INT), 2) AS p FROM s, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2""")
def e11_multinomial(spark, sf):
    """Probabilities of three classes by one feature of 0 and 1, which are the shares seen."""
    from pyspark.ml.functions import vector_to_array

    s = plans.FeatureSession(_sample(spark, sf, "c"), [plans.Select("p:x")])
    table = learn.ml_table(s.to_df(), s.dim)
    seen = learn.logistic(table, classes=3).transform(table).select(F.get(vector_to_array("features"), F.lit(0)).cast("int").alias("x"), F.posexplode(vector_to_array("probability")).alias("class", "p"))
    return seen.groupBy("x", "class").agg(F.round(F.max("p"), 2).alias("p"))


@query(f"""WITH s AS ({SAMPLE}) SELECT f::BIGINT AS feature_id, k AS class, round(avg(((c = k)::INT - 1 / 3) * CASE f WHEN 0 THEN x ELSE t END), 6) AS weight
FROM s, (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest([0, 1]) AS f) GROUP BY 1, 2""")
def e11_multinomial_sgd(spark, sf):
    """One step over all rows."""
    s = plans.FeatureSession(_sample(spark, sf, "c"), [plans.Select("p:x+t")])
    return learn.sgd(s.to_df(), classes=3, rate=1.0, epochs=1).select("feature_id", "class", F.round("weight", 6).alias("weight"))


@query("SELECT unnest([0, 5])::BIGINT AS feature_id, 1 AS class, unnest([0.5, -2.0])::DOUBLE AS weight")
def e13_weights(spark, sf):
    path = _scratch(spark)
    learn.save_weights(spark.createDataFrame([(0, 1, 0.5), (5, 1, -2.0)], "feature_id long, class int, weight double"), path)
    return learn.load_weights(spark, path)


def _draw(i: str, salt: int) -> str:
    return f"({fn.mix31_sql(fn.mix31_sql(f'd + {1000 * salt}') + f' + {i}')} / 2147483648.0)"


@query(f"""SELECT d AS datum_id, count(*) FILTER ({_draw('i', 1)} < 0.025 * (1 - 0.9) OR ({_draw('i - 1', 1)} < 0.025 AND {_draw('i', 2)} < 0.9))::INTEGER AS n
FROM (SELECT unnest(range(0, 1000)) AS d), (SELECT unnest(range(0, 200)) AS i) GROUP BY d""")
def e14_synthetic(spark, sf):
    return learn.synthetic(spark, 1000, 200, 25).select("datum_id", F.size("fam_default.indices").alias("n"))


CENTERED = "SELECT event_id % 2 AS g, value::FLOAT::DOUBLE + 100000 * (event_id % 2) AS x FROM events"


@query(f"SELECT g::INTEGER AS cluster, round(avg(x), 1) AS center FROM ({CENTERED}) GROUP BY 1")
def e3_kmeans(spark, sf):
    """Two groups that lie far apart."""
    df = _t(spark, sf, "events").withColumn("x", F.col("value").cast("float") + 100000.0 * (F.col("event_id") % 2))
    s = plans.FeatureSession(sources.from_table(df, {"e": ["x"]}, "event_id"), [plans.Select("e:x")])
    model = learn.kmeans(learn.ml_table(s.to_df(), s.dim), 2, 20, seed=3)
    centers = sorted(float(c[0]) for c in model.clusterCenters())
    return spark.createDataFrame([(k, round(c, 1)) for k, c in enumerate(centers)], "cluster int, center double")


@query("SELECT vec_id AS datum_id, k::INTEGER AS place, round([a, a * a, b, a * b, b * b][k + 1], 6) AS value FROM (SELECT vec_id, embedding[1]::FLOAT::DOUBLE AS a, embedding[2]::FLOAT::DOUBLE AS b, unnest(range(0, 5)) AS k FROM embeddings)")
def e7_polynomial(spark, sf):
    from pyspark.ml.functions import vector_to_array

    s = plans.FeatureSession(vectors(spark, sf), [plans.Select("v:0-1")], sizes=V)
    return learn.polynomial(learn.ml_table(s.to_df(), s.dim)).select("datum_id", F.posexplode(vector_to_array("expanded")).alias("place", "v")).select("datum_id", "place", F.round("v", 6).alias("value"))


@query("""SELECT vec_id AS datum_id, k::BIGINT AS feature_id, round(tanh(CASE k WHEN 0 THEN embedding[1]::DOUBLE + 2 * embedding[3]::DOUBLE ELSE embedding[2]::DOUBLE - embedding[3]::DOUBLE END)::FLOAT::DOUBLE, 4) + 0.0 AS value
FROM (SELECT vec_id, embedding, unnest([0, 1]) AS k FROM embeddings)""")
def e15_activations(spark, sf):
    """A hidden layer's output as features."""
    hidden = plans.transforms.mlp([([[1.0, 0.0], [0.0, 1.0], [2.0, -1.0]], [0.0, 0.0], "tanh")])
    return _rounded(_long(vectors(spark, sf), [plans.ModelInference("v:0-2", hidden, 2)], sizes=V), 4)


@query(f"WITH s AS ({SAMPLE}) SELECT count(*) AS n, sum(y)::BIGINT AS n_ones, round(sum(x + t), 2) AS total FROM s")
def e16_training_rows(spark, sf):
    """What a trainer that iterates over a session's rows sees."""
    s = plans.FeatureSession(_sample(spark, sf), [plans.Select("p:x+t")])
    n = ones = 0
    total = 0.0
    for r in s.rows():
        n, ones, total = n + 1, ones + int(r.label), total + sum(r["values"])
    return spark.createDataFrame([(n, ones, round(total, 2))], "n long, n_ones long, total double")


@query("SELECT c_custkey AS id, trim(split_part(c_name, '#', 1)) AS a, trim(split_part(c_name, '#', 2)) AS b, NULL::VARCHAR AS c FROM customer")
def e5_split_column(spark, sf):
    return tokens.split_column(_t(spark, sf, "customer"), "c_name", ["a", "b", "c"], "#").select(F.col("c_custkey").alias("id"), "a", "b", "c")


# files


def _scratch(spark) -> str:
    """A new place in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


def _lines_file(df: DataFrame, order: str, line, path: str | None = None) -> str:
    """The rows as one text file."""
    path = path or _scratch(df.sparkSession)
    df.select(line.alias("value"), F.col(order).alias("o")).repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path)
    return path


SUPPLIERS = "(SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier)"


@query(f"SELECT k AS datum_id, s_nationkey::DOUBLE AS label, f::BIGINT AS feature_id, CASE f WHEN 0 THEN s_suppkey ELSE s_acctbal END::FLOAT::DOUBLE AS value FROM {SUPPLIERS}, (SELECT unnest([0, 1]) AS f) WHERE CASE f WHEN 0 THEN s_suppkey ELSE s_acctbal END <> 0")
def s3_csv(spark, sf):
    path = _scratch(spark)
    _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").repartitionByRange(1, "s_suppkey").sortWithinPartitions("s_suppkey").write.option("header", "true").csv(path)
    s = plans.FeatureSession(sources.read(spark, path, "csv", label="s_nationkey"), [plans.Select("s_suppkey,s_acctbal")])
    labels = s.to_df().select("datum_id", F.col("label").cast("double").alias("label"))
    return s.long().join(labels, "datum_id").select("datum_id", "label", "feature_id", F.col("value").cast("double").alias("value"))


@query(f"SELECT k - 2 AS datum_id, s_suppkey::VARCHAR AS value FROM {SUPPLIERS} WHERE k >= 2")
def s4_header(spark, sf):
    return sources.read_lines(spark, _lines_file(_t(spark, sf, "supplier"), "s_suppkey", F.col("s_suppkey").cast("string")), header=2)


@query(f"SELECT k AS datum_id, s_nationkey::DOUBLE AS label, s_suppkey AS feature FROM {SUPPLIERS}")
def s5_own_format(spark, sf):
    """A format registered by its user."""

    def pipes(spark, paths, **_):
        p = F.split("value", r"\|")
        return sources.read_lines(spark, paths).select("datum_id", p[0].cast("float").alias("label"), F.lit(1.0).cast("float").alias("weight"), F.struct(p[1].cast("int").alias("n")).alias("fam_default"))

    sources.register_format("pipes", pipes)
    path = _lines_file(_t(spark, sf, "supplier"), "s_suppkey", F.concat_ws("|", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")))
    return sources.read(spark, path, "pipes").select("datum_id", F.col("label").cast("double").alias("label"), F.col("fam_default.n").cast("long").alias("feature"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey % 3, s_suppkey) - 1 AS datum_id, s_suppkey::VARCHAR AS value FROM supplier")
def s6_directories(spark, sf):
    """Files of several folders below one, numbered by file and place."""
    df, root = _t(spark, sf, "supplier"), _scratch(spark)
    for k in range(3):
        _lines_file(df.where(F.col("s_suppkey") % 3 == k), "s_suppkey", F.col("s_suppkey").cast("string"), f"{root}/part={k}")
    return sources.read_lines(spark, root, recursive=True)


@query(f"SELECT k AS datum_id, 40 AS size, s_nationkey::INTEGER AS feature, s_suppkey::FLOAT::DOUBLE AS value FROM {SUPPLIERS}")
def s7_sidecar(spark, sf):
    """A file whose <file>.meta.json says how many features there are and that they count from 1."""
    path = _lines_file(_t(spark, sf, "supplier"), "s_suppkey", F.format_string("0 %d:%d", F.col("s_nationkey").cast("long") + 1, F.col("s_suppkey")))
    Catalog(spark, path.rsplit("/", 1)[0])._put(f"{path}.meta.json", {"feature_dim": 40, "feature_one_based": True})
    c = Catalog(spark, _scratch(spark))
    c.create("t")
    c.ingest("t", path, "libsvm")
    size = c.schema("t").family("default").size
    return c.get("t").select("datum_id", F.lit(size).alias("size"), F.explode(F.arrays_zip("fam_default.indices", "fam_default.values")).alias("p")).select("datum_id", "size", F.col("p.indices").alias("feature"), F.col("p.values").cast("double").alias("value"))


@query("SELECT w AS worker, count(event_id) AS n_rows FROM (SELECT count(*) AS n FROM events) c, (SELECT unnest(range(0, 7))::INTEGER AS w) LEFT JOIN events ON event_id >= w * (n // 7) AND event_id < CASE w WHEN 6 THEN n ELSE (w + 1) * (n // 7) END GROUP BY 1")
def s12_shares(spark, sf):
    """Even shares of 7 workers, the remainder to the last."""
    df = _t(spark, sf, "events").select(F.col("event_id").alias("datum_id"))
    parts = [rows.row_range(df, a, b).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(w).alias("worker"), "n_rows") for w, (a, b) in enumerate(rows.shares(df.count(), 7))]
    return reduce(DataFrame.unionByName, parts)


KEYED = "SELECT p_partkey AS datum_id, 0::DOUBLE AS label, 0 AS feature, p_size::FLOAT::DOUBLE AS value FROM part"


def _keyed(spark, sf):
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey")
    return sinks.partitioned_lines(plans.FeatureSession(df, [plans.Select("p:p_size")]).to_df(), 5)


def _one_feature(df: DataFrame) -> DataFrame:
    return df.select("datum_id", F.col("label").cast("double").alias("label"), F.explode(F.arrays_zip("fam_default.indices", "fam_default.values")).alias("p")).select("datum_id", "label", F.col("p.indices").alias("feature"), F.col("p.values").cast("double").alias("value"))


@query(KEYED)
def s13_keyed_store(spark, sf):
    """Lines of a keyed store by the store's own source."""
    path = _scratch(spark)
    _keyed(spark, sf).write.partitionBy("partition_key").parquet(path)
    return _one_feature(sources.read_stored(spark, "parquet", {"path": path}))


@query(KEYED)
def s14_catalog_table(spark, sf):
    """Lines in a column of a table that the session knows by name."""
    _keyed(spark, sf).createOrReplaceTempView("featloom_keyed_lines")
    return _one_feature(sources.read(spark, "featloom_keyed_lines", "table"))


@query(f"SELECT k AS datum_id, (s_suppkey % 2)::INTEGER AS label, s_nationkey::INTEGER AS i1, NULL::INTEGER AS i2, lower(hex(s_suppkey)) AS c1, NULL::VARCHAR AS c2 FROM {SUPPLIERS}")
def s15_criteo(spark, sf):
    cells = [(F.col("s_suppkey") % 2).cast("string"), F.col("s_nationkey").cast("string"), *[F.lit("")] * 12, F.lower(F.hex("s_suppkey")), *[F.lit("")] * 25]
    path = _lines_file(_t(spark, sf, "supplier"), "s_suppkey", F.concat_ws("\t", *cells))
    return sources.read(spark, path, "criteo").select("datum_id", "label", "i1", "i2", "c1", "c2")


@query('SELECT s_suppkey::INTEGER AS "Row", (s_suppkey % 2)::INTEGER AS label, s_name AS step FROM supplier')
def s16_kdd(spark, sf):
    path = _scratch(spark)
    df = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("Row"), (F.col("s_suppkey") % 2).alias("Correct First Attempt"), F.col("s_name").alias("Step Name"))
    df.write.option("sep", "\t").option("header", "true").csv(path)
    return sources.read(spark, path, "kdd").select(F.col("Row").cast("int").alias("Row"), F.col("Correct First Attempt").cast("int").alias("label"), F.col("Step Name").alias("step"))


@query("SELECT k AS datum_id, label::DOUBLE AS label, i::INTEGER AS feature, embedding[i + 1]::FLOAT::DOUBLE AS value FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings), (SELECT unnest(range(0, 4)) AS i)")
def s17_binary(spark, sf):
    """Two files of records."""
    import struct

    found = _t(spark, sf, "embeddings").orderBy("vec_id").select("label", F.slice("embedding", 1, 4).alias("x")).collect()  # to write the files that are read
    root = _scratch(spark)
    for k, part in enumerate((found[: len(found) // 2], found[len(found) // 2 :])):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{k}.bin")
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(b"".join(struct.pack("<5f", r.label, *r.x) for r in part)))
        out.close()
    df = sources.read(spark, [f"{root}/0.bin", f"{root}/1.bin"], "bin", dim=4)
    return df.select("datum_id", F.col("label").cast("double").alias("label"), F.posexplode("fam_default").alias("feature", "v")).select("datum_id", "label", "feature", F.col("v").cast("double").alias("value"))


@query("SELECT codec, count(*) AS n_rows, sum(p_size) AS total FROM part, (SELECT unnest(['gzip', 'snappy', 'zstd']) AS codec) GROUP BY 1")
def k1_tables_by_codec(spark, sf):
    out = []
    for codec in ("gzip", "snappy", "zstd"):
        path = _scratch(spark)
        sinks.write_table(_t(spark, sf, "part"), path, codec=codec)
        out.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("p_size").alias("total")).select(F.lit(codec).alias("codec"), "n_rows", "total"))
    return reduce(DataFrame.unionByName, out)


@query("SELECT count(*) AS n_rows, ceil(count(*) / 64)::BIGINT AS n_files FROM part")
def k12_rolling_files(spark, sf):
    path = _scratch(spark)
    sinks.write_table(_t(spark, sf, "part").coalesce(1), path, rows_per_file=64)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.col("_metadata.file_path")).alias("n_files"))


@query("SELECT n_nationkey::BIGINT AS place, n_regionkey::FLOAT::DOUBLE AS label, n_nationkey::BIGINT AS feature, 1::DOUBLE AS value FROM nation")
def k9_columns(spark, sf):
    """What a session hands over as columns."""
    df = tokens.to_sparse(_t(spark, sf, "nation").withColumn("one", F.lit(1)), "n_nationkey", ["one"], label="n_regionkey")
    s = plans.FeatureSession(df, [plans.Select("default:0"), plans.Constant(7)], sizes={"default": 1})
    got = sinks.to_columns(s.to_df().orderBy("datum_id"))
    return spark.createDataFrame([(k, float(y), k, x[0]) for k, (y, x) in enumerate(zip(got["labels"], got["sparse"]))], "place long, label double, feature long, value double")


@query("SELECT concat(p_partkey, ',', p_size, ',1,0:', p_size, ' 1:2') AS value FROM part")
def k13_feature_csv(spark, sf):
    path = _scratch(spark)
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey", label="p_size")
    sinks.write_csv(plans.FeatureSession(df, [plans.Select("p:p_size"), plans.Constant(2)]).to_df(), path)
    return spark.read.text(path).where("value not like 'datum_id%'").select(F.regexp_replace("value", r"(?<=\d)\.0(?=,)", "").alias("value"))


@query("SELECT p_partkey AS datum_id, concat('dense dim: 2 label: ', p_size, ' weight: 1 | ', p_size, ' 2') AS value FROM part")
def k5_text_dense(spark, sf):
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey", label="p_size")
    return sinks.to_text(plans.FeatureSession(df, [plans.Select("p:p_size"), plans.Constant(2)], "dense").to_df())


@query("SELECT count(*) AS num_rows, 2::BIGINT AS feature_dim, count(DISTINCT p_size) AS num_labels FROM part")
def k2_meta(spark, sf):
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey", label="p_size")
    return sinks.meta(plans.FeatureSession(df, [plans.Select("p:p_size"), plans.Constant(2)]).to_df())


# selectors and transforms of other kinds


@query("SELECT vec_id AS datum_id, 0::BIGINT AS feature_id, embedding[8]::FLOAT::DOUBLE AS value FROM embeddings WHERE embedding[8]::FLOAT <> 0")
def p3_number(spark, sf):
    return _long(vectors(spark, sf), [plans.Select("v:7")], sizes=V)


@query("SELECT c_custkey AS datum_id, k::BIGINT AS feature_id, CASE k WHEN 0 THEN c_acctbal ELSE c_nationkey END::FLOAT::DOUBLE AS value FROM customer, (SELECT unnest([0, 1]) AS k) WHERE CASE k WHEN 0 THEN c_acctbal ELSE c_nationkey END::FLOAT <> 0")
def p4_default_family(spark, sf):
    df = sources.from_table(_t(spark, sf, "customer"), {"default": ["c_nationkey", "c_acctbal"]}, "c_custkey")
    return _long(df, [plans.Select("c_acctbal,:c_nationkey")])


@query("""SELECT l_orderkey * 8 + l_linenumber AS datum_id, k::BIGINT AS feature_id, [l_quantity, l_extendedprice, l_discount, l_tax][k + 1]::FLOAT::DOUBLE AS value FROM lineitem, (SELECT unnest(range(0, 4)) AS k)""")
def p8_two_families(spark, sf):
    return _long(lines(spark, sf), [plans.Select("*:")])


def _failure(f) -> str | None:
    try:
        f()
    except Exception as e:  # its kind is the result
        return type(e).__name__
    return None


@query("""SELECT unnest(['a:1+2-3', ',', 'v:7-2', 'v:99', 'none:', 'v:x', 'table', 'format', 'transform', 'bounds', 'session']) AS input,
unnest(['FeatureError', 'FeatureError', 'FeatureError', 'FeatureError', 'FeatureError', 'FeatureError', 'NotFound', 'KeyError', 'KeyError', 'ValueError', 'KeyError']) AS error""")
def p9_errors(spark, sf):
    """Selectors and names that are refused, and how."""
    df = vectors(spark, sf)
    out = [(x, _failure(lambda x=x: plans.FeatureSession(df, [plans.Select(x)], sizes=V))) for x in ("a:1+2-3", ",", "v:7-2", "v:99", "none:", "v:x")]
    out.append(("table", _failure(lambda: Catalog(spark, _scratch(spark)).get("none"))))
    out.append(("format", _failure(lambda: sources.read(spark, "x", "odd"))))
    out.append(("transform", _failure(lambda: plans.transforms.transform("odd"))))
    out.append(("bounds", _failure(lambda: plans.Bucketize("v:0", [1, 0]))))
    out.append(("session", _failure(lambda: plans.Sessions().close("none"))))
    return spark.createDataFrame(out, "input string, error string")


@query("SELECT p_partkey AS datum_id, 0::BIGINT AS feature_id, (2 * p_size)::FLOAT::DOUBLE AS value FROM part")
def t11_custom(spark, sf):
    """A transform of the user's own, by its name."""

    @plans.register_transform("doubled")
    class Doubled(plans.Transform):
        def plan(self, ctx):
            s = stats.select_singles(self.inputs, ctx.schema)
            return plans.transforms.Plan(len(s), [x.name for x in s], lambda offset: F.array(*[fn.pair(F.lit(offset + k), fn.single(x) * 2) for k, x in enumerate(s)]))

    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey")
    return _long(df, [plans.transforms.transform("doubled", "p:p_size")])


@query("SELECT vec_id AS datum_id, k::BIGINT AS feature_id, round((embedding[k + 1]::FLOAT::DOUBLE * [2, -3][k + 1])::FLOAT::DOUBLE, 5) + 0.0 AS value FROM embeddings, (SELECT unnest([0, 1]) AS k)")
def t12_pipeline_model(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    df = vectors(spark, sf)
    stage = ElementwiseProduct(scalingVec=Vectors.dense(2.0, -3.0), inputCol="features", outputCol="scaled")
    model = Pipeline(stages=[stage]).fit(learn.ml_table(plans.FeatureSession(df, [plans.Select("v:0-1")], "dense", V).to_df(), 2))
    return _rounded(_long(df, [plans.PipelineModelTransform("v:0-1", model, 2, output_col="scaled")], sizes=V))


@query("""WITH e AS (SELECT vec_id AS datum_id, i::BIGINT AS feature_id, embedding[i + 1]::FLOAT::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS i FROM embeddings)),
m AS (SELECT feature_id, avg(x) AS a, stddev_samp(x) AS v FROM e GROUP BY 1) SELECT datum_id, feature_id, round((x - a) / v, 3) + 0.0 AS value FROM e JOIN m USING (feature_id)""")
def a10_standardize_std(spark, sf):
    s = plans.FeatureSession(vectors(spark, sf), [plans.Select("v:0-3")], sizes=V)
    return _rounded(stats.standardize(s.to_df(), stats.moments(s.to_df(), s.dim), "std"), 3)


@query("SELECT 'l_discount' AS feature, true AS factor UNION ALL SELECT 'l_extendedprice', false")
def a12_factors(spark, sf):
    df = lines(spark, sf)
    schema = SchemaSpec.of(df)
    found = [(name, stats.is_factor(df, Single(schema.family(f), k))) for name, f, k in (("l_discount", "rate", 0), ("l_extendedprice", "price", 1))]
    return spark.createDataFrame(found, "feature string, factor boolean")


@query(f"SELECT k AS datum_id, s_suppkey::DOUBLE AS label FROM {SUPPLIERS} WHERE k <> 0")
def l4_comments(spark, sf):
    """Comment lines and empty ones give no rows, but keep their numbers."""
    key = F.col("s_suppkey").cast("string")
    path = _lines_file(_t(spark, sf, "supplier"), "s_suppkey", F.when(F.col("s_suppkey") == _t(spark, sf, "supplier").agg(F.min("s_suppkey")).first()[0], F.lit("# |a 3")).otherwise(F.concat(key, F.lit(" |a 1:2"))))
    return sources.read(spark, path, "family").select("datum_id", F.col("label").cast("double").alias("label"))


# catalog and sessions


def _table(spark, sf, twice: bool = False, collect_stats: bool = True):
    """A catalog with the table t of one or two ingests, and the last report."""
    path = _lines_file(_t(spark, sf, "supplier"), "s_suppkey", F.format_string("%d 0:%d 3:2", F.col("s_nationkey").cast("long"), F.col("s_suppkey")))
    c = Catalog(spark, _scratch(spark))
    c.create("t", "suppliers")
    report = c.ingest("t", path, "libsvm", collect_stats=collect_stats)
    return (c, c.ingest("t", path, "libsvm", collect_stats=collect_stats)) if twice else (c, report)


@query("SELECT 'a' AS name, true AS first, false AS again UNION ALL SELECT 'b', true, false")
def x1_create(spark, sf):
    c = Catalog(spark, _scratch(spark))
    made = {n: (c.create(n), c.create(n)) for n in ("b", "a")}
    return spark.createDataFrame([(n, *made[n]) for n in c.names()], "name string, first boolean, again boolean")


@query(f"SELECT k + j * n AS datum_id, s_nationkey::DOUBLE AS label, s_suppkey::DOUBLE AS value FROM {SUPPLIERS}, (SELECT count(*) AS n FROM supplier), (SELECT unnest([0, 1]) AS j)")
def x3_ingest(spark, sf):
    """Rows of two ingests, numbered on."""
    c, _ = _table(spark, sf, twice=True)
    return c.get("t").select("datum_id", F.col("label").cast("double").alias("label"), F.get("fam_default.values", F.lit(0)).cast("double").alias("value"))


@query("SELECT count(*) AS rows, 2 * count(*) AS total_rows, 4 AS size FROM supplier")
def k10_report(spark, sf):
    _, r = _table(spark, sf, twice=True)
    return spark.createDataFrame([(r["rows"], r["total_rows"], r["sizes"]["default"])], "rows long, total_rows long, size int")


@query("SELECT 0::BIGINT AS feature, 0::DOUBLE AS min, max(s_suppkey)::DOUBLE AS max, 2 * sum(s_suppkey)::DOUBLE AS sum, 2 * count(*) AS n_stored, 2 * count(*) AS n_rows FROM supplier UNION ALL SELECT 3, 0, 2, 4 * count(*), 2 * count(*), 2 * count(*) FROM supplier")
def a8_kept_stats(spark, sf):
    """Statistics of two ingests, added up from what each left."""
    c, _ = _table(spark, sf, twice=True)
    return c.stats("t").select("feature", "min", "max", "sum", "n_stored", "n_rows")


@query("SELECT 0::BIGINT AS feature, sum(s_suppkey)::DOUBLE AS sum, count(*) AS n_rows FROM supplier UNION ALL SELECT 3, 2 * count(*), count(*) FROM supplier")
def a8_stats_off(spark, sf):
    """Statistics of a table that was ingested without, by a scan."""
    c, _ = _table(spark, sf, collect_stats=False)
    return c.stats("t").select("feature", "sum", "n_rows")


@query("SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS feature_id, unnest(['SelectTransform0', 'SelectTransform0', 'SelectTransform0', 'SelectTransform0', 'b']) AS family, unnest(['0', '1', '2', '3', '3[0,5)']) AS name")
def x7_output_schema(spark, sf):
    c, _ = _table(spark, sf)
    s = plans.FeatureSession(c.get("t"), [plans.Select("default:"), plans.Bucketize(":3", [0, 5], output_family="b")], schema=c.schema("t"))
    return spark.createDataFrame([(i, *s.output_schema.name(i)) for i in range(s.dim)], "feature_id long, family string, name string")


@query("SELECT count(*) AS n, true AS shared, true AS closed FROM supplier")
def x4_sessions(spark, sf):
    """A session that two have opened is there until both have closed it."""
    c, _ = _table(spark, sf)
    pool, t = plans.Sessions(), [plans.Select("default:0")]
    schema = c.schema("t")
    a, b = (pool.open("s", c.get("t"), t, schema=schema) for _ in range(2))
    pool.close("s")
    pool.close("s")
    return spark.createDataFrame([(a.count(), a is b, _failure(lambda: pool.close("s")) == "KeyError")], "n long, shared boolean, closed boolean")


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS total, sum(p_size) FILTER (p_partkey BETWEEN 10 AND 19)::BIGINT AS part_total FROM part")
def x12_iterators(spark, sf):
    """A session's rows, iterated over twice, and a range of them."""
    s = plans.FeatureSession(sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey"), [plans.Select("p:p_size")])
    first, again = (sorted((r.datum_id, int(sum(r["values"]))) for r in s.rows()) for _ in range(2))
    part = sum(int(sum(r["values"])) for r in s.rows(10, 20))
    return spark.createDataFrame([(len(first), sum(v for _, v in again), part)], "n long, total long, part_total long")


@query("SELECT p_partkey AS datum_id, k::BIGINT AS feature_id, CASE k WHEN 0 THEN p_size ELSE 3.15::FLOAT END::FLOAT::DOUBLE AS value FROM part, (SELECT unnest([0, 1]) AS k)")
def x11_builder(spark, sf):
    df = sources.from_table(_t(spark, sf, "part"), {"p": ["p_size"]}, "p_partkey")
    return _long(df, ConfigBuilder().select("p:p_size").constant(3.15).build())


@query("SELECT unnest(['db_dir', 'num_io_ingest', 'server_port']) AS key, unnest(['/data', '4', '5555']) AS value")
def x16_settings(spark, sf):
    found = settings('server_port: 5555\n# a comment\ndb_dir: "/data"\nnum_io_ingest: 4  # threads')
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(found.items())], "key string, value string")


@query("SELECT unnest(['a', 'b']) AS key, unnest([2, 7]) AS n")
def g1_values(spark, sf):
    """Small values by key; a later one takes the place of the one before."""
    c = Catalog(spark, _scratch(spark))
    for k, v in (("b", 7), ("a", 1), ("a", 2)):
        c.put_value(k, {"n": v})
    return spark.createDataFrame([(k, c.value(k)["n"]) for k in c.keys()], "key string, n int")


# scalar functions


@query("SELECT vec_id AS id, k AS class, round(exp(x) / s, 6) AS p, round(ln(greatest(x, 1e-10)), 6) AS l FROM (SELECT vec_id, k, embedding[k + 1]::FLOAT::DOUBLE AS x, exp(embedding[1]::FLOAT::DOUBLE) + exp(embedding[2]::FLOAT::DOUBLE) + exp(embedding[3]::FLOAT::DOUBLE) AS s FROM embeddings, (SELECT unnest([0, 1, 2]) AS k))")
def f9_softmax(spark, sf):
    v = F.slice(F.col("embedding").cast("array<float>").cast("array<double>"), 1, 3)
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.arrays_zip(fn.softmax(v).alias("p"), F.transform(v, lambda x: fn.safe_log(x)).alias("l"))).alias("class", "x")).select("id", "class", F.round("x.p", 6).alias("p"), F.round("x.l", 6).alias("l"))


@query("SELECT unnest(['3.15', '1000', '0.001234']) AS input, unnest(['3.2', '1e+03', '0.0012']) AS short, unnest(['3.15 B', '1000.00 B', '0.00 B']) AS size, unnest(['3_15', '1000', '0_001234']) AS name")
def f4_text(spark, sf):
    return spark.createDataFrame([(x, fn.short(float(x)), fn.size_text(float(x)), fn.name_of(x)) for x in ("3.15", "1000", "0.001234")], "input string, short string, size string, name string")


@query("SELECT unnest(['dense', 'named', 'sparse']) AS family, unnest(['dense', 'named', 'sparse']) AS kind, unnest([64, 2, 9]) AS size")
def f7_kinds(spark, sf):
    """What a family's column says about it."""
    df = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("datum_id"), F.col("embedding").cast("array<float>").alias("fam_dense"), F.struct(F.lit(1).alias("a"), F.lit(2.0).alias("b")).alias("fam_named"), F.struct(F.array(F.lit(1)).alias("indices"), F.array(F.lit(1.0)).alias("values")).alias("fam_sparse"))
    s = SchemaSpec.from_json(SchemaSpec.of(df, {"dense": 64, "sparse": 9}).to_json())
    return spark.createDataFrame([(f.name, f.kind, f.size) for f in sorted(s.families.values(), key=lambda f: f.name)], "family string, kind string, size int")


@query("SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(replace(p_name, '~', ' ')), '\\s+'), lambda x: x <> '')))[1] AS first FROM part")
def f3_tokens(spark, sf):
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_min(tokens.tokens(F.col("p_name"))).alias("first"))


# streams


def _parts_stream(spark, sf, files: int):
    """Part rows as files that a stream finds, and the table."""
    path = _scratch(spark)
    sources.from_table(_t(spark, sf, "part"), {"p": ["p_size", "p_retailprice"]}, "p_partkey").repartition(files).write.parquet(path)
    return path, spark.read.parquet(path)


@query(f"""WITH e AS (SELECT p_partkey AS datum_id, p_size::FLOAT AS s FROM part) {_onehot_sql('s', 0, 'e')}""")
def w1_stream(spark, sf):
    """The session's projection over a stream of files, its dictionary from the table."""
    path, table = _parts_stream(spark, sf, 3)
    out = streaming.transform_stream(streaming.stream_table(spark, path, table), table, [plans.OneHot("p:p_size")])
    to = _scratch(spark)
    streaming.run_available(out, to, _scratch(spark))
    return spark.read.parquet(to).select("datum_id", F.explode(F.arrays_zip("indices", "values")).alias("p")).select("datum_id", F.col("p.indices").alias("feature_id"), F.col("p.values").cast("double").alias("value"))


@query("SELECT 3::BIGINT AS n_batches, count(*) AS n_rows FROM part")
def w2_paging(spark, sf):
    """A stream that takes one file at a time."""
    path, table = _parts_stream(spark, sf, 3)
    to = _scratch(spark)

    def write(batch, k):
        batch.groupBy().agg(F.count(F.lit(1)).alias("n"), F.lit(k).alias("k")).write.mode("overwrite").parquet(f"{to}/batch={k}")

    streaming.each_batch(streaming.stream_table(spark, path, table, files_per_trigger=1), write, _scratch(spark))
    return spark.read.parquet(to).agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_rows"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS v, 0 AS b FROM part WHERE p_size <= 10 UNION ALL SELECT DISTINCT p_brand, 1 FROM part WHERE p_size > 10 UNION ALL SELECT DISTINCT p_type, 1 FROM part WHERE p_size > 10)
SELECT v AS value, row_number() OVER (ORDER BY min(b), v) - 1 AS id FROM a GROUP BY v""")
def w3_dictionary(spark, sf):
    """A dictionary that grows with the batches of a stream."""
    df, path, to, log = _t(spark, sf, "part"), _scratch(spark), _scratch(spark), _scratch(spark)
    merge = streaming.dictionary_merge(spark, to, "value")
    parts = [df.where("p_size <= 10").select(F.col("p_brand").alias("value")), df.where("p_size > 10").select(F.explode(F.array("p_brand", "p_type")).alias("value"))]
    for part in parts:
        part.coalesce(1).write.mode("append").text(path)
        streaming.each_batch(spark.readStream.text(path), merge, log)
    return spark.read.parquet(f"{to}/version={len(parts) - 1}").select("value", "id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def w4_windows(spark, sf):
    """Counts by hour of a stream; the watermark is wider than the data."""
    path, to = _scratch(spark), _scratch(spark)
    _t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(path)
    stream = streaming.windowed_counts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "ts", "event_type", "1 hour", "3650 days")

    def write(batch, k):
        batch.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n").write.mode("overwrite").parquet(to)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", _scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to)
