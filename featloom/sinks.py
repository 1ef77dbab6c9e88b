"""Output vectors as text, files and Arrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_text(c: Column) -> Column:
    """A float without a needless .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _items(one_based: bool) -> Column:
    e = F.zip_with("indices", "values", lambda i, v: F.concat((i + int(one_based)).cast("string"), F.lit(":"), number_text(v)))
    return F.array_join(e, " ")


def to_libsvm(vectors: DataFrame, one_based: bool = False) -> DataFrame:
    """datum_id and value: "label id:value ..."."""
    return vectors.select("datum_id", F.rtrim(F.concat(number_text(F.col("label")), F.lit(" "), _items(one_based))).alias("value"))


def to_text(vectors: DataFrame) -> DataFrame:
    """datum_id and value: "sparse dim: d label: l weight: w | id:value ..." or "dense dim: ... | value ..."."""
    head = lambda kind: F.concat(F.lit(f"{kind} dim: "), F.col("dim").cast("string"), F.lit(" label: "), number_text(F.col("label")), F.lit(" weight: "), number_text(F.col("weight")), F.lit(" | "))
    if "dense" in vectors.columns:
        return vectors.select("datum_id", F.concat(head("dense"), F.array_join(F.transform("dense", number_text), " ")).alias("value"))
    return vectors.select("datum_id", F.rtrim(F.concat(head("sparse"), _items(False))).alias("value"))


def write_libsvm(vectors: DataFrame, path: str, one_based: bool = False, mode: str = "errorifexists") -> None:
    to_libsvm(vectors, one_based).select("value").write.mode(mode).text(path)


def write_csv(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """label, weight and the vector's values (dense, or sparse as id:value) separated by blanks."""
    body = F.array_join(F.transform("dense", number_text), " ") if "dense" in vectors.columns else _items(False)
    vectors.select("datum_id", "label", "weight", body.alias("features")).write.mode(mode).option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "errorifexists", codec: str = "snappy") -> None:
    """Parquet in files of at most rows_per_file rows (0: no bound)."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", codec).parquet(path)


def to_columns(vectors: DataFrame) -> dict[str, list]:
    """labels, and dense lists or sparse dicts, on the driver: for ranges that fit there."""
    t = vectors.toArrow()
    if "dense" in vectors.columns:
        return {"labels": t.column("label").to_pylist(), "dense": t.column("dense").to_pylist()}
    return {"labels": t.column("label").to_pylist(), "sparse": [dict(zip(i, v)) for i, v in zip(t.column("indices").to_pylist(), t.column("values").to_pylist())]}


def partitioned_lines(vectors: DataFrame, n: int, one_based: bool = False) -> DataFrame:
    """partition_key (datum_id modulo n) and content: LIBSVM lines for a keyed store."""
    return to_libsvm(vectors, one_based).select(F.pmod("datum_id", F.lit(n)).alias("partition_key"), "datum_id", F.col("value").alias("content"))


def meta(vectors: DataFrame) -> DataFrame:
    """num_rows, feature_dim (largest id and one) and num_labels of vectors."""
    return vectors.agg(F.count(F.lit(1)).alias("num_rows"), (F.coalesce(F.max(F.array_max("indices")), F.lit(-1)) + 1).cast("long").alias("feature_dim"), F.countDistinct("label").alias("num_labels"))
