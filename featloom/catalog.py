"""Named tables in a warehouse folder: Parquet, with the schema and figures of the last ingest beside it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators import stats
from .schema import SchemaSpec


class NotFound(KeyError):
    """No table of that name."""


class Conflict(RuntimeError):
    """Another wrote the same version of a table first."""


class Catalog:
    """root: a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _put(self, path: str, value: dict) -> None:
        """Whole or not at all: written beside and renamed."""
        p, fs = self._fs(path)
        beside, _ = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        if not fs.rename(beside, p):
            fs.delete(beside, False)
            raise Conflict(f"{path} was written by another")

    def _get(self, path: str) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))

    def _list(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _version(self, name: str) -> int:
        """The last version committed, -1 without any."""
        return max((int(x[5:-5]) for x in self._list(f"{self.root}/{name}") if x.startswith("meta-") and x.endswith(".json")), default=-1)

    def names(self) -> list[str]:
        return [x for x in self._list(self.root) if not x.startswith("_") and self._version(x) >= 0]

    def create(self, name: str, description: str = "", int_label: bool = True, dense_weight: bool = True) -> bool:
        """Whether the table is new; an existing one stays as it is."""
        if name.startswith("_") or "/" in name or not name:
            raise ValueError(f"{name!r} is no name of a table")
        if self._version(name) >= 0:
            return False
        self._put(f"{self.root}/{name}/meta-0.json", {"description": description, "int_label": int_label, "dense_weight": dense_weight, "sizes": {}, "rows": 0, "version": 0, "parts": [], "stats": []})
        return True

    def meta(self, name: str) -> dict:
        version = self._version(name)
        if version < 0:
            raise NotFound(name)
        return self._get(f"{self.root}/{name}/meta-{version}.json")

    def ingest(self, name: str, paths: str | Sequence[str], format: str = "csv", header: int = 0, num_features: int | None = None, collect_stats: bool = True, rows_per_file: int = 0, **options) -> dict:
        """Read files, number their rows after those that are there, add them, and return the report.

        The new rows go to a folder of their own, and so do their partial statistics; only the commit of the next version of the
        metadata makes them part of the table. What a failed ingest left behind belongs to no version and is never read. Only
        the new rows are scanned."""
        meta, began = self.meta(name), time.time()
        beside = sources.sidecar(self.spark, paths) if format == "libsvm" else {}
        if "feature_one_based" in beside:
            options.setdefault("feature_one_based", beside["feature_one_based"])
        df = sources.read(self.spark, paths, format, header=header, **options)
        if meta["int_label"]:
            df = df.withColumn("label", F.col("label").cast("int").cast("float"))
        part = f"rows-{meta['version'] + 1}-{uuid.uuid4().hex}"
        df.withColumn("datum_id", F.col("datum_id") + F.lit(meta["rows"])).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.root}/{name}/{part}")
        added = self.spark.read.parquet(f"{self.root}/{name}/{part}")
        dim = num_features or beside.get("feature_dim")
        known = dict(options.get("families") or {}) if format == "family" else {}
        if format == "family" and not known:
            known = sources.family_sizes(sources.read_lines(self.spark, paths))
        sizes = sources.sizes(added, {n: s for n, s in known.items() if isinstance(s, int)} | ({"default": dim} if dim else {}))
        sizes = {k: max(sizes.get(k, 0), meta["sizes"].get(k, 0)) for k in {*sizes, *meta["sizes"]}}
        rows = added.count()
        new = {**meta, "sizes": sizes, "rows": meta["rows"] + rows, "version": meta["version"] + 1, "parts": [*meta["parts"], part]}
        if collect_stats:
            stats.partial_stats(added, SchemaSpec.of(added, sizes)).write.parquet(f"{self.root}/{name}/stats-{part}")
            new["stats"] = [*meta["stats"], part]
        if self._version(name) != meta["version"]:
            raise Conflict(f"{name} was written by another")
        self._put(f"{self.root}/{name}/meta-{new['version']}.json", new)
        return {"rows": rows, "total_rows": new["rows"], "seconds": time.time() - began, "sizes": sizes}

    def get(self, name: str) -> DataFrame:
        meta = self.meta(name)
        if not meta["parts"]:
            raise NotFound(f"{name} has no rows")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{name}/{p}" for p in meta["parts"]])

    def schema(self, name: str) -> SchemaSpec:
        return SchemaSpec.of(self.get(name), self.meta(name)["sizes"])

    def stats(self, name: str) -> DataFrame:
        """The statistics of the parts, added up; parts that were ingested without are scanned."""
        meta = self.meta(name)
        kept = [self.spark.read.parquet(f"{self.root}/{name}/stats-{p}") for p in meta["stats"]]
        schema = self.schema(name)
        scanned = [stats.partial_stats(self.spark.read.parquet(f"{self.root}/{name}/{p}"), schema) for p in meta["parts"] if p not in meta["stats"]]
        return stats.final_stats(stats.merged_stats(reduce(DataFrame.unionByName, kept + scanned)), meta["rows"])

    def put_value(self, key: str, value: dict) -> None:
        """Keep a small value by key, in the place of one that is there."""
        p, fs = self._fs(f"{self.root}/_values/{key}.json")
        if fs.exists(p):
            fs.delete(p, False)
        self._put(f"{self.root}/_values/{key}.json", value)

    def value(self, key: str) -> dict:
        if not self._exists(f"{self.root}/_values/{key}.json"):
            raise NotFound(key)
        return self._get(f"{self.root}/_values/{key}.json")

    def keys(self) -> list[str]:
        return [x.removesuffix(".json") for x in self._list(f"{self.root}/_values")]

    def drop(self, name: str) -> None:
        p, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            raise NotFound(name)
        fs.delete(p, True)
