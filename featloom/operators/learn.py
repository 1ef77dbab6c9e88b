"""Training and losses over output vectors, and synthetic data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mix31, softmax
from ..schema import DEFAULT, PREFIX
from ..session import cut, small_side


def ml_table(vectors: DataFrame, dim: int) -> DataFrame:
    """datum_id, label, weight, features (pyspark.ml vector, sparse or dense as the output is)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    rows = vectors.withColumns({"label": F.col("label").cast("double"), "weight": F.col("weight").cast("double")})
    if "dense" in vectors.columns:
        return rows.select("datum_id", "label", "weight", array_to_vector(F.col("dense").cast("array<double>")).alias("features"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            parts = [pa.array([0] * n, pa.int8()), pa.array([dim] * n, pa.int32()), b.column("i"), b.column("v")]
            features = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column("datum_id"), b.column("label"), b.column("weight"), features], names=["datum_id", "label", "weight", "features"])

    kinds = T.StructType([T.StructField("datum_id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("features", VectorUDT())])
    return rows.select("datum_id", "label", "weight", F.col("indices").cast("array<int>").alias("i"), F.col("values").cast("array<double>").alias("v")).mapInArrow(run, kinds)


def kmeans(table: DataFrame, k: int, iterations: int = 100, seed: int = 0):
    """Centers by random start."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, maxIter=iterations, seed=seed, initMode="random", featuresCol="features").fit(table)


def polynomial(table: DataFrame, degree: int = 2) -> DataFrame:
    from pyspark.ml.feature import PolynomialExpansion

    return PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded").transform(table)


def logistic(table: DataFrame, classes: int = 2, reg: float = 0.0, iterations: int = 100):
    """Binary or multinomial logistic regression; reg is the squared-norm penalty."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=iterations, regParam=reg, elasticNetParam=0.0, family="binomial" if classes == 2 else "multinomial", weightCol="weight").fit(table)


def gradient(vectors: DataFrame, weights: DataFrame, classes: int = 2) -> DataFrame:
    """feature_id, class, gradient: of the mean log loss over sparse vectors, for the weights (feature_id, class, weight) that
    aren't 0. Of two classes only class 1 has weights (label 0 or 1); of more, each has its own (softmax).

    Nothing is collected: entries meet their weights in a join (a broadcast if the weights are small), products are summed by
    row, errors go back to the entries, and sums by feature are partial first."""
    n = max(vectors.count(), 1)
    e = vectors.select("datum_id", "label", F.explode(F.arrays_zip("indices", "values")).alias("p")).select("datum_id", "label", F.col("p.indices").alias("feature_id"), F.col("p.values").cast("double").alias("x"))
    dots = e.join(small_side(weights), "feature_id").groupBy("datum_id", "class").agg(F.sum(F.col("x") * F.col("weight")).alias("z"))
    ids = vectors.select("datum_id", "label")
    if classes == 2:
        z = F.coalesce("z", F.lit(0.0))
        errors = ids.join(dots, "datum_id", "left").select("datum_id", F.array(F.struct(F.lit(1).alias("class"), (1 / (1 + F.exp(-z)) - F.col("label")).alias("e"))).alias("errors"))
    else:
        by_row = dots.groupBy("datum_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "z"))).alias("z"))
        zs = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce(F.try_element_at("z", c), F.lit(0.0)))
        rows = ids.join(by_row, "datum_id", "left").withColumn("z", F.coalesce("z", F.create_map().cast("map<int,double>"))).withColumn("z", zs).withColumn("p", softmax(F.col("z")))
        errors = rows.select("datum_id", F.transform("p", lambda p, c: F.struct(c.alias("class"), (p - (F.col("label") == c).cast("double")).alias("e"))).alias("errors"))
    both = e.select("datum_id", "feature_id", "x").join(errors, "datum_id").select("feature_id", "x", F.explode("errors").alias("c"))
    return both.groupBy("feature_id", F.col("c.class").alias("class")).agg((F.sum(F.col("c.e") * F.col("x")) / n).alias("gradient"))


def sgd(vectors: DataFrame, classes: int = 2, rate: float = 0.1, epochs: int = 5, decay: float = 0.0, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """feature_id, class, weight of a logistic (two classes: class 1 alone) or softmax regression without intercept, by
    gradient steps over samples of the rows, with an optional squared-norm decay. Features that aren't there have weight 0."""
    w = vectors.sparkSession.createDataFrame([], "feature_id long, class int, weight double")
    for k in range(epochs):
        part = vectors if fraction >= 1 else vectors.sample(False, fraction, seed + k)
        g = gradient(part, w, classes)
        step = w.join(g, ["feature_id", "class"], "full").select("feature_id", "class", (F.coalesce("weight", F.lit(0.0)) * (1 - rate * decay) - rate * F.coalesce("gradient", F.lit(0.0))).alias("weight"))
        w = cut(step)
    return w


def zero_one_loss(predicted: Column, label: Column) -> Column:
    return F.avg((predicted != label).cast("double"))


def cross_entropy(probability: Column, least: float = 1e-10) -> Column:
    """Of the probability given to the right label."""
    return -F.avg(F.ln(F.greatest(probability, F.lit(least))))


def save_weights(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def synthetic(spark: SparkSession, rows: int = 10_000, features: int = 2_000, per_column: int = 25, correlation: float = 0.9, noise: float = 0.1, labels: int = 2, seed: int = 0) -> DataFrame:
    """Rows with about per_column entries in each feature; a feature repeats the one before it with probability
    correlation in a row where that one stands; labels are the quantiles of a hidden linear score, some of them redrawn."""
    rate = per_column / rows
    u = lambda i, salt: mix31(mix31(F.col("datum_id") + 1000 * salt + seed) + i) / F.lit(float(1 << 31))
    # an entry stands by its own draw, or follows from its neighbour's draw
    entry = lambda i: (u(i, 1) < rate * (1 - correlation)) | ((u(i - 1, 1) < rate) & (u(i, 2) < correlation))
    ids = F.filter(F.sequence(F.lit(0), F.lit(features - 1)), entry)
    base = spark.range(rows).withColumnRenamed("id", "datum_id").withColumn("indices", ids).withColumn("values", F.transform("indices", lambda i: u(i, 3).cast("float")))
    hidden = F.aggregate(F.zip_with("indices", "values", lambda i, v: v * (F.pmod(mix31(i + seed), F.lit(2001)) / 1000.0 - 1)), F.lit(0.0), lambda n, x: n + x)
    scored = base.withColumn("score", hidden + u(F.lit(-7), 4) * 1e-6)
    cuts = scored.stat.approxQuantile("score", [k / labels for k in range(1, labels)], 0.001)
    label = sum(((F.col("score") > c).cast("int") for c in cuts), F.lit(0))
    label = F.when(u(F.lit(-8), 5) < noise, F.floor(u(F.lit(-9), 6) * labels)).otherwise(label)
    return scored.select("datum_id", label.cast("float").alias("label"), F.lit(1.0).cast("float").alias("weight"), F.struct(F.transform("indices", lambda i: i.cast("int")).alias("indices"), F.col("values")).alias(PREFIX + DEFAULT))
