"""Token and category features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT, PREFIX
from .stats import numbered


def tokens(text: Column) -> Column:
    """Lower case, ~ as a blank, split at white space; without empty ones."""
    return F.filter(F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), "~", " ")), r"\s+"), lambda x: x != "")


def token_dictionary(df: DataFrame, column: str) -> DataFrame:
    """token, id: distinct tokens in their order, from 0."""
    return numbered(df.select(F.explode(F.array_distinct(tokens(F.col(column)))).alias("token")).distinct(), "token", name="id").select("token", "id")


def binarize(df: DataFrame, id_column: str, column: str, dictionary: DataFrame) -> DataFrame:
    """datum_id and indices: ascending ids of the distinct tokens that the dictionary has; rows without any have []."""
    own = df.select(F.col(id_column).alias("datum_id"), F.explode(F.array_distinct(tokens(F.col(column)))).alias("token"))
    found = own.join(dictionary, "token").groupBy("datum_id").agg(F.sort_array(F.collect_set("id")).alias("indices"))
    return df.select(F.col(id_column).alias("datum_id")).join(found, "datum_id", "left").select("datum_id", F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"))


def encode_labels(df: DataFrame, column: str, order: str) -> DataFrame:
    """value, id: distinct values by the first row that has each, from 0. Null is no value."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return numbered(first, "first", "value", name="id").select("value", "id")


def split_column(df: DataFrame, column: str, names: list[str], sep: str = ",") -> DataFrame:
    """The parts of a column as columns; parts that aren't there are null."""
    parts = F.split(F.col(column), f"\\Q{sep}\\E")
    return df.select("*", *[F.trim(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)])


def to_sparse(df: DataFrame, id_column: str, columns: list[str], label: str | None = None) -> DataFrame:
    """A table's columns as a sparse default family; nulls are left out, zeros too."""
    e = F.filter(F.array(*[F.struct(F.lit(k).alias("i"), F.col(f"`{c}`").cast("float").alias("v")) for k, c in enumerate(columns)]), lambda x: x["v"].isNotNull() & (x["v"] != 0))
    rows = df.select(F.col(id_column).cast("long").alias("datum_id"), (F.col(label) if label else F.lit(0)).cast("float").alias("label"), F.lit(1.0).cast("float").alias("weight"), e.alias("e"))
    return rows.select("datum_id", "label", "weight", F.struct(F.transform("e", lambda x: x["i"]).alias("indices"), F.transform("e", lambda x: x["v"]).alias("values")).alias(PREFIX + DEFAULT))


def category_ids(df: DataFrame, id_column: str, columns: list[str], start: int = 13) -> DataFrame:
    """column, value, id: one counter over all columns, from start, in the order of row and column of first sight."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(columns)])
    rows = df.select(F.col(id_column).alias("row"), F.explode(cells).alias("c")).where("c.value is not null and c.value <> ''")
    first = rows.groupBy(F.col("c.k").alias("column"), F.col("c.value").alias("value")).agg(F.min("row").alias("row"))
    return numbered(first, "row", "column", name="id").select("column", "value", (F.col("id") + F.lit(start)).cast("long").alias("id"))


def categories(df: DataFrame, id_column: str, columns: list[str], ids: DataFrame) -> DataFrame:
    """datum_id and ascending indices of a row's categories."""
    cells = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(columns)])
    rows = df.select(F.col(id_column).alias("datum_id"), F.explode(cells).alias("c")).select("datum_id", "c.*")
    return rows.join(ids, ["column", "value"]).groupBy("datum_id").agg(F.sort_array(F.collect_list("id")).alias("indices"))
