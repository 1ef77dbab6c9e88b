"""Which rows: ranges, worker shares, samples, times, outliers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn


def row_range(df: DataFrame, begin: int = 0, end: int | None = None) -> DataFrame:
    """Rows begin <= datum_id < end; end None or -1 is to the last."""
    df = df.where(F.col("datum_id") >= begin)
    return df if end is None or end < 0 else df.where(F.col("datum_id") < end)


def shares(n_rows: int, workers: int) -> list[tuple[int, int]]:
    """Even ranges for workers; the last takes what is left."""
    if workers < 1:
        raise ValueError("workers must be positive")
    each = n_rows // workers
    return [(k * each, n_rows if k == workers - 1 else (k + 1) * each) for k in range(workers)]


def worker_of(datum_id: Column, n_rows: int, workers: int) -> Column:
    """The worker whose share holds a row."""
    each = max(n_rows // workers, 1)
    return F.least(F.floor(datum_id / F.lit(each)), F.lit(workers - 1)).cast("int")


def subsample(df: DataFrame, rate: float, seed: int = 0, key: str = "datum_id") -> DataFrame:
    """Rows whose hash of key (a whole number, or else its text) and seed falls under the rate: the same on every run."""
    if not 0 <= rate <= 1:
        raise ValueError("rate is from 0 to 1")
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(key).cast("long") if whole else F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 31).cast("long"))
    return df.where(F.pmod(fn.mix31(fn.mix31(number) + seed), F.lit(1_000_000)) < int(rate * 1_000_000))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """At most n rows, by datum_id."""
    return df.orderBy("datum_id").limit(n)


_TIME = re.compile(r"\d{4}-\d{2}-\d{2}( \d{2}:\d{2})?")


def time_range(df: DataFrame, column: str, begin: str = "", end: str = "") -> DataFrame:
    """Rows with begin <= column < end, each YYYY-MM-DD [HH:MI] or empty for an open end."""
    for text, keep in ((begin, lambda t: F.col(column) >= t), (end, lambda t: F.col(column) < t)):
        if text:
            if not _TIME.fullmatch(text):
                raise ValueError(f"{text!r} is not YYYY-MM-DD [HH:MI]")
            df = df.where(keep(F.lit(text if " " in text else f"{text} 00:00").cast("timestamp")))
    return df


def exclude_outliers(df: DataFrame, columns: list[str], low: float, high: float, accuracy: int = 10_000) -> DataFrame:
    """Rows in which every column lies within its quantiles [low, high]; one pass for the quantiles, one for the rows.

    Null passes, having no value that could lie outside."""
    row = df.agg(*[F.percentile_approx(c, [low, high], accuracy).alias(f"q{k}") for k, c in enumerate(columns)]).first()
    if any(row[f"q{k}"] is None for k in range(len(columns))):
        columns = [c for k, c in enumerate(columns) if row[f"q{k}"] is not None]
    keep = [F.col(c).isNull() | F.col(c).between(*row[f"q{k}"]) for k, c in enumerate(columns)]
    return df.where(reduce(lambda a, b: a & b, keep)) if keep else df
