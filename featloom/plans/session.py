"""A session: transforms resolved against a table's families, as one lazy projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators.rows import row_range
from ..schema import Family, FeatureError, OutputSchema, SchemaSpec
from .transforms import Context, Transform

#: Features up to which an intermediate family keeps its names.
NAMED = 10_000


class FeatureSession:
    """df: a table of datum_id, label, weight and families (columns fam_*). output: sparse or dense.

    Dictionaries that one-hot transforms need are worked out here; everything else waits for an action. A label that
    isn't there is 0; a weight that isn't there, null or 0 is 1."""

    def __init__(self, df: DataFrame, transforms: Sequence[Transform], output: str = "sparse", sizes: dict[str, int] | None = None, schema: SchemaSpec | None = None):
        if output not in ("sparse", "dense"):
            raise ValueError("output is sparse or dense")
        self.source, self.transforms, self.output = df, list(transforms), output
        ctx = Context(df, (schema or SchemaSpec.of(df, sizes)).copy())
        self.output_schema = OutputSchema()
        parts = []
        for ctx.number, t in enumerate(self.transforms):
            plan = t.plan(ctx)
            family = t.output_family or t.default_family(ctx.number)
            if t.intermediate:
                if family in ctx.schema.families:
                    raise FeatureError(f"there is a family {family!r} already")
                names = plan.names if callable(plan.names) else plan.names.__getitem__
                ctx.schema.families[family] = Family(family, "sparse", plan.width, tuple(names(i) for i in range(plan.width)) if plan.width <= NAMED else ())
                column = fn.family_struct(plan.pairs(0))
                ctx.add(lambda df, family=family, column=column: df.withColumn(f"fam_{family}", column))
            else:
                parts.append(plan.pairs(self.output_schema.add(family, plan.width, plan.names)))
        if not parts:
            raise FeatureError("no transform has output")
        self.schema, self._replay = ctx.schema, ctx.steps
        self._all = parts[0] if len(parts) == 1 else F.concat(*parts)
        self._df = self._vectors(ctx.df)

    def _vectors(self, df: DataFrame) -> DataFrame:
        zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
        label = F.coalesce(F.col("label").cast("float"), zero) if "label" in df.columns else zero
        weight = F.coalesce(F.nullif(F.col("weight").cast("float"), zero), one) if "weight" in df.columns else one
        rows = df.select("datum_id", label.alias("label"), weight.alias("weight"), F.lit(self.dim).cast("long").alias("dim"), self._all.alias("p"))
        if self.output == "dense":
            return rows.select("datum_id", "label", "weight", "dim", fn.densify(F.col("p"), self.dim).alias("dense"))
        return rows.select("datum_id", "label", "weight", "dim", F.transform("p", lambda x: x["i"]).alias("indices"), F.transform("p", lambda x: x["v"]).alias("values"))

    def on(self, rows: DataFrame) -> DataFrame:
        """The same projection over other rows with these families, a stream among them. Steps that joined or added
        columns to the session's own table (large dictionaries, models) are repeated on them; see Transform.plan."""
        for step in self._replay:
            rows = step(rows)
        return self._vectors(rows)

    @property
    def dim(self) -> int:
        return self.output_schema.dim

    def to_df(self, begin: int = 0, end: int | None = None) -> DataFrame:
        """Rows of the range; its bounds reach the scan of the table."""
        return row_range(self._df, begin, end) if begin or end is not None else self._df

    def long(self, begin: int = 0, end: int | None = None) -> DataFrame:
        """datum_id, feature_id, value."""
        df = self.to_df(begin, end)
        if self.output == "dense":
            return df.select("datum_id", F.posexplode("dense").alias("feature_id", "value")).withColumn("feature_id", F.col("feature_id").cast("long"))
        return df.select("datum_id", F.explode(F.arrays_zip("indices", "values")).alias("p")).select("datum_id", F.col("p.indices").alias("feature_id"), F.col("p.values").alias("value"))

    def rows(self, begin: int = 0, end: int | None = None) -> Iterator:
        """Rows on the driver, partition by partition, the next one fetched ahead. Call again to start over."""
        return self.to_df(begin, end).toLocalIterator(prefetchPartitions=True)

    def count(self) -> int:
        return self.source.count()

    def __enter__(self) -> FeatureSession:
        return self

    def __exit__(self, *_) -> None:
        return None


class Sessions:
    """Sessions shared by id; they last until as many have closed as have opened."""

    def __init__(self) -> None:
        self._open: dict[str, tuple[FeatureSession, list, int]] = {}

    def open(self, session_id: str, df: DataFrame, transforms: Sequence[Transform], **options) -> FeatureSession:
        config = [t.config() for t in transforms] + [sorted((k, repr(v)) for k, v in options.items())]
        if session_id in self._open:
            session, known, n = self._open[session_id]
            if known != config:
                raise ValueError(f"session {session_id!r} is open with other transforms")
        else:
            session, n = FeatureSession(df, transforms, **options), 0
        self._open[session_id] = (session, config, n + 1)
        return session

    def close(self, session_id: str) -> None:
        session, config, n = self._open[session_id]
        if n > 1:
            self._open[session_id] = (session, config, n - 1)
        else:
            del self._open[session_id]
