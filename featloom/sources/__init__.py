"""Readers: text and tables into datum_id, label, weight and one column per family."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import DEFAULT, PREFIX, Family, SchemaSpec

SPARSE = "struct<indices:array<int>,values:array<float>>"


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _placed(df: DataFrame) -> DataFrame:
    """df with _file, _block and _row: the file, the start of the split that read the row, and an order inside it."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())


def _number(placed: DataFrame, header: int = 0) -> DataFrame:
    """Placed rows with datum_id, consecutive by file and place, less the first header rows of each file.

    Rows aren't moved: one pass counts each split's rows, the driver adds the counts up (a number per split), and a
    second pass adds a split's start to the row's place in it. Should the second pass be split otherwise than the first
    (a setting was changed meanwhile), it fails rather than number wrongly."""
    spark = placed.sparkSession
    counts = placed.groupBy("_file", "_block").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: (r["_file"], r["_block"])):
        skip = min(header, r.n) if r["_block"] == 0 else 0
        starts.append((r["_file"], r["_block"], r.first, total - skip, skip))
        total += r.n - skip
    table = spark.createDataFrame(starts, "_file string, _block long, _first long, _start long, _skip int")
    rows = placed.join(table, ["_file", "_block"], "left").where(F.col("_first").isNull() | (F.col("_row") - F.col("_first") >= F.col("_skip")))
    place = F.when(F.col("_first").isNull(), F.raise_error(F.lit("the input was split otherwise while it was numbered")).cast("long")).otherwise(F.col("_start") + F.col("_row") - F.col("_first"))
    return rows.withColumn("datum_id", place).drop("_file", "_block", "_row", "_first", "_start", "_skip")


def read_lines(spark: SparkSession, paths: str | Sequence[str], header: int = 0, recursive: bool = False) -> DataFrame:
    """datum_id and value: the lines of files and directories, numbered by file and place, the first header lines of
    each file left out."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(_paths(paths))
    return _number(_placed(lines), header).select("datum_id", "value")


def _entries(items: Column, one_based: bool) -> Column:
    """i:v texts as ascending (i, v)."""
    one = lambda x: F.struct((F.coalesce(F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0)) - int(one_based)).alias("i"), fn.parse_float(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v"))
    return F.array_sort(F.transform(F.filter(items, lambda x: F.contains(x, F.lit(":"))), one))


def _sparse(entries: Column) -> Column:
    return F.struct(F.transform(entries, lambda x: x["i"]).alias("indices"), F.transform(entries, lambda x: x["v"]).alias("values"))


def parse_libsvm(lines: DataFrame, column: str = "value", feature_one_based: bool = False, label_one_based: bool = False) -> DataFrame:
    """Lines of "label id:value ..." in a column to datum_id, label, weight 1 and fam_default.

    Ids are put in order; empty and null lines give no row; numbers are read up to the first odd character, and are 0
    where there are none. Zero-based ids unless told otherwise (a built-in reader takes one-based ones only)."""
    words = F.split(F.trim(F.col(column)), r"\s+")
    rows = lines.where(F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) > 0).withColumn("_w", words)
    label = fn.parse_float(F.get("_w", F.lit(0))) - int(label_one_based)
    e = _entries(F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), feature_one_based)
    return rows.select("datum_id", label.cast("float").alias("label"), F.lit(1.0).cast("float").alias("weight"), fn.let(e, _sparse).alias(PREFIX + DEFAULT))


def read_libsvm(spark: SparkSession, paths: str | Sequence[str], feature_one_based: bool = False, label_one_based: bool = False, header: int = 0, **_) -> DataFrame:
    return parse_libsvm(read_lines(spark, paths, header), "value", feature_one_based, label_one_based)


def parse_family(lines: DataFrame, column: str = "value", families: dict[str, int] | None = None) -> DataFrame:
    """Lines of "label [weight] |fam i:v ... |fam i:v" to datum_id, label, weight and a column per family.

    families: names and sizes; without them the lines that start with # ("# |fam n |fam n") tell. A group without a
    name is of the default family, which is always there. Lines that start with # and empty lines give no row."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    if families is None:
        families = family_sizes(lines, column)
    names = sorted({*families, DEFAULT})
    groups = F.split(text, r"\|")
    head = F.split(F.trim(F.get("_g", F.lit(0))), r"\s+")
    rows = lines.where((F.length(text) > 0) & ~F.startswith(text, F.lit("#"))).withColumn("_g", groups).withColumn("_h", head)

    def named(x: Column) -> Column:
        words = F.split(F.trim(x), r"\s+")
        bare = F.contains(F.get(words, F.lit(0)), F.lit(":"))
        return F.struct(F.when(bare | (F.trim(x) == ""), F.lit(DEFAULT)).otherwise(F.get(words, F.lit(0))).alias("name"), words.alias("items"))

    rows = rows.withColumn("_f", F.transform(F.slice("_g", 2, F.greatest(F.size("_g") - 1, F.lit(0))), named))
    known = F.forall("_f", lambda x: x["name"].isin(names))
    rows = rows.withColumn("_f", F.when(known, F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("a family that no header names: "), F.col(column))).cast("array<struct<name:string,items:array<string>>>")))
    of = lambda n: fn.let(_entries(F.flatten(F.transform(F.filter("_f", lambda x: x["name"] == n), lambda x: x["items"])), False), _sparse)
    weight = F.when(F.size("_h") > 1, fn.parse_float(F.get("_h", F.lit(1)))).otherwise(F.lit(1.0))
    return rows.select("datum_id", fn.parse_float(F.get("_h", F.lit(0))).alias("label"), weight.cast("float").alias("weight"), *[of(n).alias(PREFIX + n) for n in names])


def family_sizes(lines: DataFrame, column: str = "value") -> dict[str, int]:
    """Sizes that the header lines declare, the largest of several."""
    out: dict[str, int] = {}
    for r in lines.where(F.startswith(F.ltrim(F.col(column)), F.lit("#"))).select(column).distinct().toLocalIterator():
        for group in r[0].split("|")[1:]:
            words = group.split()
            if len(words) == 2:
                out[words[0]] = max(out.get(words[0], 0), int(words[1]))
    return out


def read_family(spark: SparkSession, paths: str | Sequence[str], families: dict[str, int] | None = None, header: int = 0, **_) -> DataFrame:
    return parse_family(read_lines(spark, paths, header), "value", families)


def from_table(df: DataFrame, families: dict[str, Sequence[str] | str], id_column: str, label: str | None = None, weight: str | None = None) -> DataFrame:
    """A table's columns as families: a list of columns is a named family, one column's name a dense one (array).

    Whole-number columns stay int, the others become float32; nulls are 0 when read as features."""
    kinds = dict(df.dtypes)
    number = lambda c: F.col(f"`{c}`").cast("int" if kinds[c] in ("int", "smallint", "tinyint") else "float").alias(c)
    columns = [F.col(f"`{cs}`").cast("array<float>").alias(PREFIX + n) if isinstance(cs, str) else F.struct(*map(number, cs)).alias(PREFIX + n) for n, cs in families.items()]
    return df.select(
        F.col(f"`{id_column}`").cast("long").alias("datum_id"),
        (F.col(f"`{label}`") if label else F.lit(0)).cast("float").alias("label"),
        (F.col(f"`{weight}`") if weight else F.lit(1)).cast("float").alias("weight"),
        *columns,
    )


def read_csv(spark: SparkSession, paths: str | Sequence[str], families: dict[str, Sequence[str]] | None = None, label: str | None = None, weight: str | None = None, header: int = 1, sep: str = ",", schema: str | None = None, **_) -> DataFrame:
    """CSV columns as named families (without families all but label and weight are of the default one)."""
    reader = spark.read.option("sep", sep).option("header", str(header > 0).lower())
    df = reader.schema(schema).csv(_paths(paths)) if schema else reader.option("inferSchema", "true").csv(_paths(paths))
    rows = _number(_placed(df))
    families = families or {DEFAULT: [c for c in df.columns if c not in (label, weight)]}
    return from_table(rows, families, "datum_id", label, weight)


CRITEO = ", ".join(["label int", *(f"i{k} int" for k in range(1, 14)), *(f"c{k} string" for k in range(1, 27))])


def read_criteo(spark: SparkSession, paths: str | Sequence[str], **_) -> DataFrame:
    """datum_id, label, i1..i13 and c1..c26 of tab-separated rows; an empty cell is null."""
    df = spark.read.schema(CRITEO).option("sep", "\t").csv(_paths(paths))
    return _number(_placed(df)).select("datum_id", *df.columns)


def read_kdd(spark: SparkSession, paths: str | Sequence[str], **_) -> DataFrame:
    """Tab-separated rows with a header and inferred types."""
    return spark.read.option("sep", "\t").option("header", "true").option("inferSchema", "true").csv(_paths(paths))


def read_dense_binary(spark: SparkSession, paths: str | Sequence[str], dim: int, **_) -> DataFrame:
    """Files of little-endian float32 rows of a label and dim values to datum_id, label, weight and a dense family.

    Files are split between records, however large they are, and rows are numbered where they lie: by file and offset."""
    records = spark.sparkContext.union([spark.sparkContext.binaryRecords(p, 4 * (dim + 1)) for p in _paths(paths)])
    rows = records.zipWithIndex().map(lambda x: (x[1], x[0])).toDF("datum_id long, record binary")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            part = np.frombuffer(b"".join(batch.column("record").to_pylist()), "<f4").reshape(-1, dim + 1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dim), pa.array(part[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("datum_id"), pa.array(part[:, 0]), values], names=["datum_id", "label", "values"])

    return rows.mapInArrow(run, "datum_id long, label float, values array<float>").select("datum_id", "label", F.lit(1.0).cast("float").alias("weight"), F.col("values").alias(PREFIX + DEFAULT))


def read_stored(spark: SparkSession, source: str, options: dict[str, str] | None = None, column: str = "content", id_column: str = "datum_id", feature_one_based: bool = False, label_one_based: bool = False, **_) -> DataFrame:
    """LIBSVM lines that a store's table keeps in a column, each with its id. source: a data source's name, with its
    options, or "table" with the option name for a table of the session's catalog (Hive's among them)."""
    options = options or {}
    rows = spark.table(options["name"]) if source == "table" else spark.read.format(source).options(**options).load()
    return parse_libsvm(rows.select(F.col(id_column).cast("long").alias("datum_id"), F.col(column).alias("value")), "value", feature_one_based, label_one_based)


def read_table(spark: SparkSession, paths: str, **options) -> DataFrame:
    """Lines in a column of a catalog table."""
    return read_stored(spark, "table", {"name": paths}, **options)


def read_cassandra(spark: SparkSession, paths: str, source: str = "org.apache.spark.sql.cassandra", **options) -> DataFrame:
    """Lines in a column of the table "keyspace.table", by the connector, which has to be on Spark's class path."""
    keyspace, table = paths.split(".", 1)
    return read_stored(spark, source, {"keyspace": keyspace, "table": table}, **options)


FORMATS: dict[str, Callable[..., DataFrame]] = {"libsvm": read_libsvm, "family": read_family, "csv": read_csv, "criteo": read_criteo, "kdd": read_kdd, "bin": read_dense_binary, "table": read_table, "cassandra": read_cassandra}


def register_format(name: str, reader: Callable[..., DataFrame]) -> None:
    """reader(spark, paths, **options) gives a table of datum_id, label, weight and families."""
    FORMATS[name] = reader


def read(spark: SparkSession, paths: str | Sequence[str], format: str, **options) -> DataFrame:
    if format not in FORMATS:
        raise KeyError(f"no format {format!r}; there are {sorted(FORMATS)}")
    return FORMATS[format](spark, paths, **options)


def sidecar(spark: SparkSession, paths: str | Sequence[str]) -> dict:
    """feature_dim (the largest) and feature_one_based of the <file>.meta.json beside the files; {} without any."""
    found = []
    for p in _paths(paths):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{p}.meta.json")
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            found.append(json.loads("\n".join(r.value for r in spark.read.text(f"{p}.meta.json").collect())))
    if not found:
        return {}
    return {"feature_dim": max(int(x.get("feature_dim", 0)) for x in found), "feature_one_based": any(x.get("feature_one_based") for x in found)}


def sizes(df: DataFrame, known: dict[str, int] | None = None) -> dict[str, int]:
    """Size of each family: as known, or one more than the largest index stored (one aggregation)."""
    schema, known = SchemaSpec.of(df), dict(known or {})
    ask: list[Family] = [f for f in schema.families.values() if f.name not in known and f.kind != "named"]
    for f in schema.families.values():
        if f.kind == "named":
            known[f.name] = f.size
    if ask:
        most = lambda f: F.max(F.array_max(F.col(f"`{f.column}`.indices")) + 1) if f.kind == "sparse" else F.max(F.size(f"`{f.column}`"))
        row = df.agg(*[F.coalesce(most(f), F.lit(0)).alias(f.name) for f in ask]).first()
        known |= {f.name: int(row[f.name]) for f in ask}
    return known
