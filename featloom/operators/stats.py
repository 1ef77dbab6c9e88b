"""Statistics over the features of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import Family, SchemaSpec
from ..selectors import Single, Wide, resolve
from ..session import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """df with consecutive numbers from 0 in the given order: range partitions are numbered each for itself, and only
    their sizes meet on the driver."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted(parts.groupBy("_part").count().collect())
    if not sizes:
        return parts.withColumn(name, F.lit(0).cast("long")).drop("_part")
    start = parts.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, _running([n for _, n in sizes]))], "_part int, _start long")
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_row", row).join(F.broadcast(start), "_part").withColumn(name, F.col("_row") - 1 + F.col("_start")).drop("_part", "_row", "_start")


def _running(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for n in sizes:
        out.append(total)
        total += n
    return out


def _entry(family: str):
    return lambda x: F.struct(F.lit(family).alias("family"), x["i"].alias("feature"), x["v"].alias("value"))


def long_form(df: DataFrame, schema: SchemaSpec, families: list[str] | None = None) -> DataFrame:
    """datum_id, family, feature (number), value: a row for each stored entry, by one scan for all families."""
    parts = []
    for name in sorted(families or schema.families):
        f = schema.family(name)
        # a sparse family's entries need no size; 2**31 - 1 stands for all of them
        size = f.size if f.size is not None else 2**31 - 1
        whole = fn.pairs(Wide(Family(f.name, f.kind, size, f.features), 0, size))
        parts.append(F.transform(whole, _entry(name)))
    return df.select("datum_id", F.explode(F.concat(*parts)).alias("p")).select("datum_id", "p.*")


def partial_stats(df: DataFrame, schema: SchemaSpec, families: list[str] | None = None) -> DataFrame:
    """family, feature, min, max (0 counts as a value of every feature, as absent entries are 0), sum, squares, n_stored: what
    the statistics of several parts of a table add up from. Sums are in double."""
    v = F.col("value").cast("double")
    return (
        long_form(df, schema, families)
        .groupBy("family", "feature")
        .agg(F.least(F.min("value"), F.lit(0.0)).cast("double").alias("min"), F.greatest(F.max("value"), F.lit(0.0)).cast("double").alias("max"), F.sum(v).alias("sum"), F.sum(v * v).alias("squares"), F.count(F.lit(1)).alias("n_stored"))
    )


def merged_stats(parts: DataFrame) -> DataFrame:
    """The partial statistics of all parts together."""
    return parts.groupBy("family", "feature").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"), F.sum("n_stored").alias("n_stored"))


def final_stats(partial: DataFrame, rows: int) -> DataFrame:
    """family, feature, min, max, sum, n_stored, mean and var (population, absent entries 0), n_rows."""
    mean = F.col("sum") / F.lit(float(max(rows, 1)))
    return partial.select("family", "feature", "min", "max", "sum", "n_stored", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("squares") / F.lit(float(max(rows, 1))) - mean * mean).alias("var"), F.lit(rows).cast("long").alias("n_rows"))


def compute_stats(df: DataFrame, schema: SchemaSpec, families: list[str] | None = None) -> DataFrame:
    """The statistics of a table: one scan and one aggregation with partial sums; a row for each feature that occurs."""
    return final_stats(partial_stats(df, schema, families), df.count())


def dictionaries(df: DataFrame, features: list[Single]) -> DataFrame:
    """feature (its place in the list), value (float), first: the dictionaries of several features without 0, which always
    has position 0, by one scan and one aggregation. Cut, as it is read several times."""
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), fn.single(s).alias("value")) for k, s in enumerate(features)])
    rows = df.select("datum_id", F.explode(F.filter(cells, lambda x: x["value"] != 0)).alias("c"))
    return cut(rows.groupBy("c.feature", "c.value").agg(F.min("datum_id").alias("first")))


def dictionary(df: DataFrame, feature: Single, zero_first: bool = True) -> DataFrame:
    """value (float), first: the distinct values of a feature with the first datum_id that has each; with zero_first
    without 0, which always has position 0. Positions are by (first, value)."""
    v = df.select(fn.single(feature).alias("value"), "datum_id")
    return (v.where("value <> 0") if zero_first else v).groupBy("value").agg(F.min("datum_id").alias("first"))


def positions(df: DataFrame, feature: Single, zero_first: bool = True) -> DataFrame:
    """value, pos of the dictionary, for dictionaries of any size."""
    d = numbered(dictionary(df, feature, zero_first), "first", "value").select("value", (F.col("pos") + F.lit(int(zero_first))).alias("pos"))
    zero = df.sparkSession.range(1).select(F.lit(0.0).cast("float").alias("value"), F.lit(0).cast("long").alias("pos"))
    return zero.unionByName(d) if zero_first else d


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10_000) -> DataFrame:
    """A row for each column: feature, quantiles (array)."""
    aggs = df.agg(*[F.percentile_approx(c, probabilities, accuracy).alias(c) for c in columns])
    return aggs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("array<double>").alias("quantiles")) for c in columns])).alias("x")).select("x.*")


def is_factor(df: DataFrame, feature: Single, threshold: int = 1000) -> bool:
    """Whether a feature has fewer distinct values than the threshold, by an approximate count."""
    return df.select(F.approx_count_distinct(fn.single(feature)).alias("n")).first()["n"] < threshold


def moments(vectors: DataFrame, dim: int) -> DataFrame:
    """feature_id, mean, var (n - 1; 0 becomes 1) over the output vectors, absent entries 0."""
    n = vectors.count()
    e = vectors.select(F.explode(F.arrays_zip("indices", "values")).alias("p")).select(F.col("p.indices").alias("feature_id"), F.col("p.values").cast("double").alias("v"))
    s = e.groupBy("feature_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    ids = vectors.sparkSession.range(dim).withColumnRenamed("id", "feature_id")
    s = ids.join(s, "feature_id", "left").na.fill(0.0, ["s", "q"])
    var = F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.lit(float(max(n, 1)))) / F.lit(float(max(n - 1, 1))))
    return s.select("feature_id", (F.col("s") / F.lit(float(max(n, 1)))).alias("mean"), F.when(var == 0, 1.0).otherwise(var).alias("var"))


def standardize(vectors: DataFrame, stats: DataFrame, divide_by: str = "var") -> DataFrame:
    """datum_id, feature_id, value: (x - mean) / var of the stored entries, or by the standard deviation."""
    if divide_by not in ("var", "std"):
        raise ValueError("divide_by is var or std")
    e = vectors.select("datum_id", F.explode(F.arrays_zip("indices", "values")).alias("p")).select("datum_id", F.col("p.indices").alias("feature_id"), F.col("p.values").cast("double").alias("v"))
    scale = F.col("var") if divide_by == "var" else F.sqrt("var")
    return e.join(stats, "feature_id").select("datum_id", "feature_id", ((F.col("v") - F.col("mean")) / scale).alias("value"))


def nnz(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0)).cast("long").alias("nnz"))


def family_report(df: DataFrame, schema: SchemaSpec) -> DataFrame:
    """family, max_feature (null if nothing is stored), n_entries."""
    return long_form(df, schema).groupBy("family").agg(F.max("feature").alias("max_feature"), F.count(F.lit(1)).alias("n_entries"))


def select_singles(inputs: str | list[str], schema: SchemaSpec) -> list[Single]:
    """Singles, with ranges and families taken apart."""
    singles, wide = resolve(inputs, schema)
    return singles + [Single(w.family, w.first + k) for w in wide for k in range(w.width)]
