"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package from where the driver has it; an installed package needs no such help."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in known and HOME not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in [HOME, *known] if x)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir, or the context, names. Without a setting, one of this machine's own is
    made in local mode, where driver and executors are one process, and anything else is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="featloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame without its lineage, kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written as a compressed table into the shared checkpoint folder, and reread: for wide rows."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a frame of narrow rows needs few tasks, and bytes up to which a frame may go to every executor whole.
SMALL_ROWS, FEW, SMALL_BYTES = 100_000, 8, 16 << 20


def _size(kind: T.DataType, c: Column) -> Column:
    """Bytes of a value, about; 16 stand for what a row or an entry costs besides."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        one = kind.elementType
        if isinstance(one, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + _size(one, x)), F.lit(16).cast("long"))
        return F.greatest(F.size(c), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, T.MapType):
        return _size(T.ArrayType(kind.keyType), F.map_keys(c)) + _size(T.ArrayType(kind.valueType), F.map_values(c))
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_size(f.dataType, c[f.name]) for f in kind.fields], F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def frame_bytes(df: DataFrame) -> int:
    """The frame's size in memory, about, by one aggregation."""
    row = reduce(lambda a, b: a + b, [_size(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields], F.lit(16).cast("long"))
    return int(df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0])


def small_side(df: DataFrame) -> DataFrame:
    """A frame marked for broadcast if its measured size is at most SMALL_BYTES; a larger one stays as it is, and the join
    shuffles. Measure frames that are cut or read from a table, not ones that are dear to work out."""
    return F.broadcast(df.coalesce(FEW)) if frame_bytes(df) <= SMALL_BYTES else df
