"""The transforms. Each declares its output width and names, and gives one column of (id, value) pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import stats
from ..schema import FeatureError, SchemaSpec
from ..selectors import Single, Wide, resolve
from ..session import small_side


@dataclass
class Context:
    """What a transform is planned against; df may gain columns that its pairs read."""

    df: DataFrame
    schema: SchemaSpec
    number: int = 0
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def add(self, step: Callable[[DataFrame], DataFrame]) -> None:
        """Add columns to the table by a function that can be repeated on other rows."""
        self.df = step(self.df)
        self.steps.append(step)


@dataclass
class Plan:
    width: int
    names: Sequence[str] | Callable[[int], str]
    pairs: Callable[[int], Column]  # of the first output id


class Transform:
    """inputs: selectors. output_family: name in the output schema (default: the kind and its place among the
    transforms). intermediate: the result is a sparse family that later transforms read, and not part of the output."""

    def __init__(self, inputs: str | list[str] = (), output_family: str | None = None, intermediate: bool = False):
        self.inputs, self.output_family, self.intermediate = [inputs] if isinstance(inputs, str) else list(inputs), output_family, intermediate

    def plan(self, ctx: Context) -> Plan:
        raise NotImplementedError

    def default_family(self, number: int) -> str:
        return f"{type(self).__name__}Transform{number}"

    def config(self) -> dict[str, Any]:
        """What tells two transforms apart."""
        return {"kind": type(self).__name__} | {k: repr(v) for k, v in vars(self).items()}


KINDS: dict[str, type[Transform]] = {}


def register_transform(name: str, kind: type[Transform] | None = None):
    """Make a kind of transform known by name; also a class decorator."""

    def add(k: type[Transform]) -> type[Transform]:
        KINDS[name] = k
        return k

    return add if kind is None else add(kind)


def transform(name: str, *args, **options) -> Transform:
    if name not in KINDS:
        raise KeyError(f"no transform {name!r}; there are {sorted(KINDS)}")
    return KINDS[name](*args, **options)


def _empty() -> Column:
    return F.array().cast(fn.NO_PAIRS)


def _nonzero(singles: list[Single], offset: int) -> Column:
    if not singles:
        return _empty()
    return F.filter(F.array(*[fn.pair(F.lit(offset + k), fn.single(s)) for k, s in enumerate(singles)]), lambda x: x["v"] != 0)


def _names(singles: list[Single], wide: list[Wide]) -> Callable[[int], str]:
    def name(i: int) -> str:
        if i < len(singles):
            return singles[i].name
        i -= len(singles)
        for w in wide:
            if i < w.width:
                return w.family.feature_name(w.first + i)
            i -= w.width
        raise IndexError(i)

    return name


def _concat(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def selected(singles: list[Single], wide: list[Wide], offset: int) -> Column:
    """Singles that aren't 0, then the stored entries of wide selections, each after the other."""
    parts, at = ([_nonzero(singles, offset)] if singles else []), offset + len(singles)
    for w in wide:
        parts.append(fn.pairs(w, at))
        at += w.width
    return _concat(parts) if parts else _empty()


@register_transform("select")
class Select(Transform):
    """Copies features: singles by family name and then as written, without zeros; then whole families and ranges by
    family name, with the entries they store (dense families all, zeros included). Ids don't overlap."""

    def plan(self, ctx: Context) -> Plan:
        singles, wide = resolve(self.inputs, ctx.schema)
        return Plan(len(singles) + sum(w.width for w in wide), _names(singles, wide), lambda offset: selected(singles, wide, offset))


@register_transform("bucketize")
class Bucketize(Transform):
    """One output for each bucket [b, next b) of each feature: 1 in the first bucket that holds the value, nothing if
    none does. Absent is 0, NaN is in no bucket. Bounds are compared as float32. Ranges are taken feature by feature."""

    def __init__(self, inputs: str | list[str], buckets: Sequence[float], **options):
        super().__init__(inputs, **options)
        self.buckets = [fn.float32(b) for b in buckets]
        if len(self.buckets) < 2 or any(b <= a for a, b in zip(self.buckets, self.buckets[1:])):
            raise ValueError("bounds must ascend, two at least")

    def plan(self, ctx: Context) -> Plan:
        singles = stats.select_singles(self.inputs, ctx.schema)
        bounds, n = self.buckets, len(self.buckets) - 1
        if not singles:
            raise FeatureError("nothing to bucketize")

        def one(s: Single, offset: int) -> Column:
            def hit(v: Column) -> Column:
                below = F.size(F.filter(F.array(*[F.lit(b).cast("float") for b in bounds]), lambda b: b <= v)) - 1
                inside = (v >= F.lit(bounds[0]).cast("float")) & (v < F.lit(bounds[-1]).cast("float")) & ~F.isnan(v)
                return F.when(inside, F.array(fn.pair(F.lit(offset) + below, F.lit(1.0)))).otherwise(_empty())

            if n > 16:
                return fn.let(fn.single(s), hit)
            v, out = fn.single(s), _empty()
            for j in reversed(range(n)):  # a chain of comparisons stays inside generated code
                out = F.when((v >= F.lit(bounds[j]).cast("float")) & (v < F.lit(bounds[j + 1]).cast("float")) & ~F.isnan(v), F.array(fn.pair(F.lit(offset + j), F.lit(1.0)))).otherwise(out)
            return out

        name = lambda i: f"{singles[i // n].name}[{fn.short(bounds[i % n])},{fn.short(bounds[i % n + 1])})"
        return Plan(len(singles) * n, name, lambda offset: _concat([one(s, offset + k * n) for k, s in enumerate(singles)]))


#: Dictionary entries up to which positions are looked up in a literal; larger ones are joined.
LITERAL = 1000


@register_transform("one_hot")
class OneHot(Transform):
    """1 at the position of each feature's value in its dictionary: 0 first, then values by the first row that has
    them. Dictionaries come from the session's table, intermediate families included. A value outside them (a session
    applied to other rows) is an error, or nothing with unknown="skip"."""

    def __init__(self, inputs: str | list[str], unknown: str = "error", **options):
        super().__init__(inputs, **options)
        if unknown not in ("error", "skip"):
            raise ValueError("unknown is error or skip")
        self.unknown = unknown

    def plan(self, ctx: Context) -> Plan:
        singles = stats.select_singles(self.inputs, ctx.schema)
        if not singles:
            raise FeatureError("nothing to encode")
        table = stats.dictionaries(ctx.df, singles)
        sizes = {r.feature: r.n for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        small = [k for k in range(len(singles)) if sizes.get(k, 0) < LITERAL]
        values: dict[int, list[float]] = {k: [0.0] for k in small}
        if few := [k for k in small if k in sizes]:
            for r in table.where(F.col("feature").isin(few)).orderBy("feature", "first", "value").toLocalIterator():
                values[r.feature].append(r.value)
        widths, names, places = [], [], []
        for k, s in enumerate(singles):
            widths.append(sizes.get(k, 0) + 1)
            if k in values:
                names.append(lambda i, s=s, known=values[k]: f"{s.name}={known[i]:g}")
                places.append((F.array_position(F.array(*[F.lit(v).cast("float") for v in values[k]]), fn.single(s)) - 1).cast("long"))
                continue
            column, value = f"_pos_{ctx.number}_{k}", f"_value_{ctx.number}_{k}"
            names.append(lambda i, s=s: f"{s.name}#{i}")
            known = stats.numbered(table.where(F.col("feature") == k), "first", "value").select(F.col("value").alias(value), (F.col("pos") + 1).alias(column))
            known = small_side(known)
            # 0 is often the commonest value and needs no look-up
            key = F.when(fn.single(s) != 0, fn.single(s))
            ctx.add(lambda df, key=key, value=value, known=known: df.withColumn(value, key).join(known, value, "left").drop(value))
            places.append(F.when(fn.single(s) == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.col(column), F.lit(-1))))
        starts = [sum(widths[:k]) for k in range(len(widths))]

        def name(i: int) -> str:
            k = max(x for x in range(len(starts)) if starts[x] <= i)
            return names[k](i - starts[k])

        def one(place: Column, s: Single, offset: int) -> Column:
            missing = _empty() if self.unknown == "skip" else F.raise_error(F.concat(F.lit(f"{s.family.name}:{s.name} isn't in its dictionary: "), fn.single(s).cast("string"))).cast(fn.NO_PAIRS)
            return F.when(place >= 0, F.array(fn.pair(place + F.lit(offset), F.lit(1.0)))).otherwise(missing)

        return Plan(sum(widths), name, lambda offset: _concat([one(p, s, offset + at) for p, s, at in zip(places, singles, starts)]))


@register_transform("ngram")
class Ngram(Transform):
    """Products of two families' entries: v1 * v2 (float32) at i * n2 + j. The operands are the selections of two
    families, the one of the lesser name first, or a selection with itself, which gives the full square."""

    def plan(self, ctx: Context) -> Plan:
        operands = [resolve(x, ctx.schema) for x in self._operands()]
        if len(operands) == 1:
            singles, wide = operands[0]
            by: dict[str, tuple[list, list]] = {}
            for s in singles:
                by.setdefault(s.family.name, ([], []))[0].append(s)
            for w in wide:
                by.setdefault(w.family.name, ([], []))[1].append(w)
            operands = [by[n] for n in sorted(by)]
        operands.sort(key=lambda o: min(x.family.name for x in [*o[0], *o[1]]))
        if len(operands) != 2:
            raise FeatureError("products are of two families")
        (s1, w1), (s2, w2) = operands
        n1, n2 = (len(s) + sum(x.width for x in w) for s, w in operands)
        name1, name2 = _names(s1, w1), _names(s2, w2)

        def build(offset: int) -> Column:
            a, b = selected(s1, w1, 0), selected(s2, w2, 0)
            product = lambda x, y: fn.pair(x["i"] * n2 + y["i"] + offset, x["v"] * y["v"])
            return fn.let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.flatten(F.transform(p["a"], lambda x: F.transform(p["b"], lambda y: product(x, y)))))

        return Plan(n1 * n2, lambda i: f"{name1(i // n2)}*{name2(i % n2)}", build)

    def _operands(self) -> list[str]:
        """Two inputs, or the halves of one that repeats a selection (a:0-9,a:0-9)."""
        if len(self.inputs) == 2:
            return list(self.inputs)
        items = [x.strip() for x in ",".join(self.inputs).strip(" ,").split(",")]
        half = len(items) // 2
        if len(items) % 2 == 0 and items[:half] == items[half:]:
            return [",".join(items[:half])] * 2
        return [",".join(items)]


@register_transform("constant")
class Constant(Transform):
    """The same value on every row."""

    def __init__(self, value: float, **options):
        super().__init__(**options)
        self.value = fn.float32(value)

    def plan(self, ctx: Context) -> Plan:
        return Plan(1, [f"constant{fn.short(self.value)}"], lambda offset: F.array(fn.pair(F.lit(offset), F.lit(self.value))))


def _one_wide(inputs: list[str], schema: SchemaSpec) -> Wide:
    singles, wide = resolve(inputs, schema)
    if singles or len(wide) != 1:
        raise FeatureError("one family or range is wanted")
    return wide[0]


@register_transform("kmeans")
class KMeansAssign(Transform):
    """1 at the nearest center (squared distance in double, the first of equals), 0 at every other, all written.

    centers: rows of floats, or model_path: a text file of them; k and dim, if given, must fit."""

    def __init__(self, inputs: str | list[str], centers: Sequence[Sequence[float]] | None = None, model_path: str | None = None, k: int | None = None, dim: int | None = None, **options):
        super().__init__(inputs, **options)
        self.centers, self.model_path, self.k, self.dim = centers, model_path, k, dim

    def _rows(self, ctx: Context) -> list[list[float]]:
        if self.centers is not None:
            return [list(map(fn.float32, c)) for c in self.centers]
        return [[fn.float32(float(x)) for x in r.value.split()] for r in ctx.df.sparkSession.read.text(self.model_path).collect() if r.value.strip()]

    def plan(self, ctx: Context) -> Plan:
        w, rows = _one_wide(self.inputs, ctx.schema), self._rows(ctx)
        if not rows or any(len(c) != w.width for c in rows) or self.k not in (None, len(rows)) or self.dim not in (None, w.width):
            raise FeatureError(f"{len(rows)} centers don't fit {w.width} features")

        def build(offset: int) -> Column:
            centers = F.array(*[F.array(*[F.lit(x).cast("float") for x in c]) for c in rows])
            near = lambda x: F.transform(centers, lambda c: fn.squared_distance(x, c))
            best = fn.let(fn.let(fn.dense(w), near), lambda d: F.array_position(d, F.array_min(d)) - 1)
            return fn.let(best, lambda b: F.transform(F.sequence(F.lit(0), F.lit(len(rows) - 1)), lambda i: fn.pair(i + offset, F.when(i == b, 1.0).otherwise(0.0))))

        return Plan(len(rows), lambda i: f"center{i}", build)


@register_transform("normalize")
class Normalize(Transform):
    """Entries of a family divided by the sum of their squares (sumsq), by its root (l2), or by the sum of their
    absolute values (l1), all in double. A dense row of zeros gives NaN; a sparse one without entries gives nothing."""

    def __init__(self, inputs: str | list[str], mode: str = "sumsq", **options):
        super().__init__(inputs, **options)
        if mode not in ("sumsq", "l2", "l1"):
            raise ValueError("mode is sumsq, l2 or l1")
        self.mode = mode

    def plan(self, ctx: Context) -> Plan:
        w = _one_wide(self.inputs, ctx.schema)

        def build(offset: int) -> Column:
            term = (lambda v: F.abs(v)) if self.mode == "l1" else (lambda v: v * v)
            total = lambda p: F.aggregate(p, F.lit(0.0), lambda n, x: n + term(x["v"].cast("double")))
            size = (lambda p: F.sqrt(total(p))) if self.mode == "l2" else total
            divided = lambda x, s: F.coalesce(F.try_divide(x["v"].cast("double"), s), F.lit(float("nan")))
            return fn.let(fn.pairs(w, offset), lambda p: fn.let(size(p), lambda s: F.transform(p, lambda x: fn.pair(x["i"], divided(x, s)))))

        return Plan(w.width, lambda i: w.family.feature_name(w.first + i), build)


@register_transform("logit")
class Logit(Transform):
    """ln(p / (1 - p)) of every selected entry, held between lower and upper; an error outside 0 < p < 1."""

    def __init__(self, inputs: str | list[str], lower: float, upper: float, **options):
        super().__init__(inputs, **options)
        self.lower, self.upper = lower, upper

    def plan(self, ctx: Context) -> Plan:
        singles, wide = resolve(self.inputs, ctx.schema)

        def one(v: Column) -> Column:
            p = v.cast("double")
            value = F.greatest(F.lit(float(self.lower)), F.least(F.lit(float(self.upper)), F.ln(p / (1 - p))))
            return F.when((p > 0) & (p < 1), value).otherwise(F.raise_error(F.concat(F.lit("not between 0 and 1: "), p.cast("string"))).cast("double"))

        return Plan(len(singles) + sum(w.width for w in wide), _names(singles, wide), lambda offset: F.transform(self._entries(singles, wide, offset), lambda x: fn.pair(x["i"], one(x["v"]))))

    @staticmethod
    def _entries(singles: list[Single], wide: list[Wide], offset: int) -> Column:
        alone = [F.array(*[fn.pair(F.lit(offset + k), fn.single(s)) for k, s in enumerate(singles)])] if singles else []
        return _concat(alone + ([selected([], wide, offset + len(singles))] if wide else []))


@register_transform("hash")
class HashTrick(Transform):
    """Sums of entries by slot, the slot being a hash of the entry's place in the selection modulo num_buckets."""

    def __init__(self, inputs: str | list[str], num_buckets: int, **options):
        super().__init__(inputs, **options)
        if num_buckets < 1:
            raise ValueError("num_buckets must be positive")
        self.num_buckets = num_buckets

    def plan(self, ctx: Context) -> Plan:
        singles, wide = resolve(self.inputs, ctx.schema)

        def build(offset: int) -> Column:
            hashed = F.transform(selected(singles, wide, 0), lambda x: F.struct(F.pmod(fn.mix31(x["i"]), F.lit(self.num_buckets)).alias("s"), x["i"].alias("i"), x["v"].cast("double").alias("v")))

            def summed(e: Column) -> Column:
                changes = lambda x, k: F.when((k == 0) | (F.get(e, k - 1)["s"] != x["s"]), k)
                starts = F.filter(F.transform(e, changes), lambda k: k.isNotNull())
                end = lambda a, k: F.coalesce(F.get(a, k + 1), F.size(e))
                total = lambda x, upto: F.aggregate(F.slice(e, x + 1, upto - x), F.lit(0.0), lambda n, y: n + y["v"])
                return fn.let(starts, lambda a: F.transform(a, lambda x, k: fn.pair(F.get(e, x)["s"] + offset, total(x, end(a, k)))))

            return fn.let(F.array_sort(hashed), summed)

        return Plan(self.num_buckets, lambda i: f"slot{i}", build)


@register_transform("model")
class ModelInference(Transform):
    """Outputs of a model over a family: predict_factory() is called once in each worker and gives a function from a
    float32 array (rows, width) to (rows, output_dim). Batches travel by Arrow."""

    def __init__(self, inputs: str | list[str], predict_factory: Callable[[], Callable], output_dim: int, batch_size: int = 1024, **options):
        super().__init__(inputs, **options)
        self.predict_factory, self.output_dim, self.batch_size = predict_factory, output_dim, batch_size

    def plan(self, ctx: Context) -> Plan:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, FloatType

        w = _one_wide(self.inputs, ctx.schema)
        predict = predict_batch_udf(self.predict_factory, return_type=ArrayType(FloatType()), batch_size=self.batch_size, input_tensor_shapes=[[w.width]])
        column = f"_model_{ctx.number}"
        ctx.add(lambda df: df.withColumn(column, predict(fn.dense(w))))
        return Plan(self.output_dim, lambda i: f"output{i}", lambda offset: F.transform(F.col(column), lambda v, i: fn.pair(i + offset, v)))


def mlp(layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float], str]]) -> Callable[[], Callable]:
    """A predict_factory: layers of (weights, bias, activation: relu, sigmoid, tanh, softmax or linear)."""

    def factory():
        import numpy as np

        parts = [(np.asarray(w, np.float32), np.asarray(b, np.float32), a) for w, b, a in layers]

        def predict(x):
            for w, b, activation in parts:
                x = x @ w + b
                if activation == "relu":
                    x = np.maximum(x, 0)
                elif activation == "sigmoid":
                    x = 1 / (1 + np.exp(-x))
                elif activation == "tanh":
                    x = np.tanh(x)
                elif activation == "softmax":
                    e = np.exp(x - x.max(axis=1, keepdims=True))
                    x = e / e.sum(axis=1, keepdims=True)
                elif activation != "linear":
                    raise ValueError(activation)
            return x

        return predict

    return factory


@register_transform("pipeline_model")
class PipelineModelTransform(Transform):
    """A fitted pyspark.ml model over a family's vector; its output column holds a vector of output_dim values."""

    def __init__(self, inputs: str | list[str], model, output_dim: int, features_col: str = "features", output_col: str = "prediction", **options):
        super().__init__(inputs, **options)
        self.model, self.output_dim, self.features_col, self.output_col = model, output_dim, features_col, output_col

    def plan(self, ctx: Context) -> Plan:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.linalg import VectorUDT

        w, column = _one_wide(self.inputs, ctx.schema), f"_pipeline_{ctx.number}"

        def step(df: DataFrame) -> DataFrame:
            out = self.model.transform(df.withColumn(self.features_col, array_to_vector(fn.dense(w).cast("array<double>"))))
            scalar = not isinstance(out.schema[self.output_col].dataType, VectorUDT)
            value = F.array(F.col(self.output_col)) if scalar else vector_to_array(F.col(self.output_col))
            return out.withColumn(column, value).select(*df.columns, column)

        ctx.add(step)
        return Plan(self.output_dim, lambda i: f"output{i}", lambda offset: F.transform(F.col(column), lambda v, i: fn.pair(i + offset, v)))

