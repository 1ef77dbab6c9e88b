"""Column functions over families, and the scalar helpers."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..selectors import Single, Wide

#: Selected features up to which a dense selection is unrolled into plain columns.
UNROLL = 64


def let(value: Column, body) -> Column:
    """body over a variable that holds value, which is then worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair(i: Column, v: Column) -> Column:
    return F.struct(i.cast("long").alias("i"), v.cast("float").alias("v"))


NO_PAIRS = "array<struct<i:bigint,v:float>>"


def single(s: Single) -> Column:
    """A feature's value as float; what isn't stored, or null, is 0."""
    c = F.col(f"`{s.family.column}`")
    if s.family.kind == "named":
        v = c[s.name]
    elif s.family.kind == "dense":
        v = F.get(c, F.lit(s.index))
    else:
        v = F.get(c["values"], (F.array_position(c["indices"], F.lit(s.index).cast("int")) - 1).cast("int"))
    return F.coalesce(v.cast("float"), F.lit(0.0).cast("float"))


def pairs(w: Wide, offset: int = 0) -> Column:
    """(offset + index inside the selection, value) of a wide selection's stored entries; dense and named families
    store all, zeros included."""
    c, f = F.col(f"`{w.family.column}`"), w.family
    shift = offset - w.first
    if f.kind == "named":
        return F.array(*[pair(F.lit(offset + k), single(Single(f, w.first + k))) for k in range(w.width)]) if w.width else F.array().cast(NO_PAIRS)
    if f.kind == "dense":
        part = c if w.width == f.size else F.slice(c, w.first + 1, w.width)
        return F.coalesce(F.transform(part, lambda v, i: pair(i + F.lit(offset), F.coalesce(v, F.lit(0.0)))), F.array().cast(NO_PAIRS))
    both = F.arrays_zip(c["indices"].alias("i"), c["values"].alias("v"))
    if w.width != f.size:
        both = F.filter(both, lambda x: (x["i"] >= w.first) & (x["i"] < w.first + w.width))
    return F.coalesce(F.transform(both, lambda x: pair(x["i"].cast("long") + F.lit(shift), x["v"])), F.array().cast(NO_PAIRS))


def dense(w: Wide) -> Column:
    """A wide selection as an array of float, absent entries 0."""
    c, f = F.col(f"`{w.family.column}`"), w.family
    if f.kind == "named":
        return F.array(*[single(Single(f, w.first + k)) for k in range(w.width)])
    if f.kind == "dense":
        return F.transform(F.slice(c, w.first + 1, w.width), lambda v: F.coalesce(v.cast("float"), F.lit(0.0).cast("float")))
    return densify(pairs(w), w.width)


def densify(p: Column, width: int) -> Column:
    """Ascending pairs as an array of width values: gaps are filled, so the work is width plus entries."""
    zero = F.lit(0.0).cast("float")

    def fill(x: Column) -> Column:
        at = lambda k: F.coalesce(F.get(x, k)["i"], F.lit(-1).cast("long"))
        runs = F.transform(x, lambda e, k: F.concat(F.array_repeat(zero, (e["i"] - at(k - 1) - 1).cast("int")), F.array(e["v"])))
        last = at(F.size(x) - 1)
        return F.concat(F.flatten(runs), F.array_repeat(zero, (F.lit(width) - 1 - last).cast("int")))

    return let(p, fill)


def family_struct(p: Column) -> Column:
    """Pairs as the column of a sparse family."""
    return let(p, lambda x: F.struct(F.transform(x, lambda e: e["i"].cast("int")).alias("indices"), F.transform(x, lambda e: e["v"]).alias("values")))


# scalar helpers


def parse_int(c: Column) -> Column:
    """[+-]digits at the start of the text; 0 if there are none."""
    return F.coalesce(F.regexp_extract(c, r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def parse_float(c: Column) -> Column:
    """A float at the start of the text (also 1E3, inf and nan); 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(c), r"^([+-]?(?:inf(?:inity)?|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?))", 1).try_cast("float"), F.lit(0.0).cast("float"))


def hex_id(c: Column) -> Column:
    """The number that hexadecimal digits spell; null for an empty cell."""
    return F.when(F.length(F.trim(c)) > 0, F.conv(F.trim(c), 16, 10).cast("long"))


def is_categorical(c: Column) -> Column:
    """Whether a value is a whole number, so that its feature is inferred to be categorical."""
    return F.ceil(c) == c


#: Of the hash by plain arithmetic.
MODULUS, STEPS = 1 << 31, ((1103515245, 15), (1664525, 13), (1013904223, 16))


def mix31(c: Column) -> Column:
    """A hash of a whole number from 0 to 2**31 - 1, by multiplications modulo 2**31 and shifts, which any SQL can repeat."""
    x = F.pmod(c.cast("long"), F.lit(2147483647).cast("long"))
    for factor, shift in STEPS:
        x = F.pmod((x + 1) * F.lit(factor).cast("long"), F.lit(MODULUS).cast("long"))
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def mix31_sql(value: str) -> str:
    """The same in SQL."""
    x = f"((({value}) % 2147483647 + 2147483647) % 2147483647)"
    for factor, shift in STEPS:
        x = f"[xor(y, y >> {shift}) FOR y IN [(({x}) + 1) * {factor} % {MODULUS}]][1]"
    return x


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda n, x: n + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax(c: Column) -> Column:
    e = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda n, x: n + x), lambda s: F.transform(v, lambda x: x / s)))


def safe_log(c: Column, least: float = 1e-10) -> Column:
    return F.ln(F.greatest(c, F.lit(least)))


def float32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def short(x: float) -> str:
    """Two significant digits of the float32 value."""
    return "%.2g" % float32(x)


def size_text(n: float, digits: int = 2) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.{digits}f} {unit}"
        n /= 1024
    raise AssertionError


def name_of(text: str) -> str:
    return re.sub(r"\W+", "_", text).strip("_").lower()

