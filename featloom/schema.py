"""Families of features, and the schema of a session's output."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PREFIX = "fam_"
DEFAULT = "default"
META = ("datum_id", "label", "weight")


class FeatureError(ValueError):
    """A selector, family or feature that the schema doesn't have."""


@dataclass
class Family:
    """kind: sparse (struct of indices and values, absent is 0), dense (array) or named (struct of columns).

    size: number of features, None if unknown (then only single features can be selected by name or number)."""

    name: str
    kind: str
    size: int | None = None
    features: tuple[str, ...] = ()

    @property
    def column(self) -> str:
        return PREFIX + self.name

    def index(self, feature: str | int) -> int:
        if isinstance(feature, int):
            if feature < 0 or self.size is not None and feature >= self.size:
                raise FeatureError(f"family {self.name} has no feature {feature}")
            return feature
        if feature not in self.features:
            raise FeatureError(f"family {self.name} has no feature {feature!r}")
        return self.features.index(feature)

    def feature_name(self, i: int) -> str:
        return self.features[i] if self.features else str(i)


@dataclass
class SchemaSpec:
    """Families by name; travels beside a stored table as JSON."""

    families: dict[str, Family] = field(default_factory=dict)

    def family(self, name: str) -> Family:
        if name not in self.families:
            raise FeatureError(f"no family {name!r}; there are {sorted(self.families)}")
        return self.families[name]

    def copy(self) -> SchemaSpec:
        return SchemaSpec(dict(self.families))

    def to_json(self) -> str:
        return json.dumps([[f.name, f.kind, f.size, list(f.features)] for f in self.families.values()])

    @staticmethod
    def from_json(text: str) -> SchemaSpec:
        return SchemaSpec({n: Family(n, k, s, tuple(x)) for n, k, s, x in json.loads(text)})

    @staticmethod
    def of(df: DataFrame, sizes: dict[str, int] | None = None) -> SchemaSpec:
        """The families of a table's columns. sizes: of sparse and dense families, which columns don't tell."""
        out, sizes = {}, sizes or {}
        for f in df.schema.fields:
            if not f.name.startswith(PREFIX):
                continue
            name = f.name[len(PREFIX) :]
            size = sizes.get(name, (f.metadata or {}).get("size"))
            if isinstance(f.dataType, T.ArrayType):
                out[name] = Family(name, "dense", size)
            elif isinstance(f.dataType, T.StructType) and f.dataType.names == ["indices", "values"] and isinstance(f.dataType["indices"].dataType, T.ArrayType):
                out[name] = Family(name, "sparse", size)
            elif isinstance(f.dataType, T.StructType):
                out[name] = Family(name, "named", len(f.dataType.names), tuple(f.dataType.names))
        return SchemaSpec(out)


@dataclass
class Segment:
    family: str
    offset: int
    first: int  # index inside the family
    width: int
    name_of: Callable[[int], str]


class OutputSchema:
    """Output ids to family and name. Ids are dealt out in the order of the transforms, without gaps."""

    def __init__(self) -> None:
        self.segments: list[Segment] = []
        self.dim = 0

    def add(self, family: str, width: int, names: Sequence[str] | Callable[[int], str]) -> int:
        first = sum(s.width for s in self.segments if s.family == family)
        self.segments.append(Segment(family, self.dim, first, width, names if callable(names) else list(names).__getitem__))
        self.dim += width
        return self.dim - width

    def name(self, feature_id: int) -> tuple[str, str]:
        if not 0 <= feature_id < self.dim:
            raise FeatureError(f"no output feature {feature_id}; the dimension is {self.dim}")
        s = self.segments[bisect_right([x.offset for x in self.segments], feature_id) - 1]
        while s.width == 0:
            s = self.segments[self.segments.index(s) - 1]
        return s.family, s.name_of(feature_id - s.offset)

    def __str__(self) -> str:
        return f"dim {self.dim}: " + ", ".join(f"{s.family}[{s.offset}, {s.offset + s.width})" for s in self.segments)
