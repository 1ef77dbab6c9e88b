"""The selector language: which features a transform reads.

A comma separates items: fam:feat (by name), fam:7 (by number), feat, :feat or 7 (default family), fam: or fam:* (the
whole family), fam:a-b (numbers a to b), fam:x+y+z (several), *: (every family). A family stands for its own item
only: in c:1,2 the 2 is of the default family.
"""

from __future__ import annotations

from dataclasses import dataclass

from .schema import DEFAULT, Family, FeatureError, SchemaSpec


@dataclass(frozen=True)
class Finder:
    """One feature (feature set), a range [first, last], or a whole family (neither)."""

    family: str
    feature: str | int | None = None
    first: int | None = None
    last: int | None = None

    @property
    def whole(self) -> bool:
        return self.feature is None and self.first is None


def _feature(text: str) -> str | int:
    text = text.strip()
    if not text:
        raise FeatureError("an empty feature")
    if text[0].isdigit():
        if not text.isdigit():
            raise FeatureError(f"{text!r} is no feature number")
        return int(text)
    return text


def parse_selector(text: str) -> list[Finder]:
    """Finders in written order. Commas and white space around the whole are dropped; an empty item is an error."""
    text = text.strip(" \t\r\n,")
    if not text:
        raise FeatureError("an empty selector")
    out: list[Finder] = []
    for item in text.split(","):
        item = item.strip()
        if not item:
            raise FeatureError(f"an empty item in {text!r}")
        family, colon, rest = item.partition(":")
        family, rest = (family.strip() or DEFAULT, rest.strip()) if colon else (DEFAULT, item)
        if colon and rest in ("", "*"):
            out.append(Finder(family))
        elif "+" in rest and "-" in rest:
            raise FeatureError(f"+ and - don't mix: {item!r}")
        elif "+" in rest:
            out += [Finder(family, _feature(x)) for x in rest.split("+")]
        elif "-" in rest and rest[0].isdigit():
            a, b = (_feature(x) for x in rest.split("-", 1))
            if not isinstance(a, int) or not isinstance(b, int) or b < a:
                raise FeatureError(f"not a range: {item!r}")
            out.append(Finder(family, None, a, b))
        else:
            out.append(Finder(family, _feature(rest)))
    return out


@dataclass(frozen=True)
class Single:
    family: Family
    index: int

    @property
    def name(self) -> str:
        return self.family.feature_name(self.index)


@dataclass(frozen=True)
class Wide:
    """Features [first, first + width) of a family."""

    family: Family
    first: int
    width: int


def resolve(inputs: str | list[str], schema: SchemaSpec) -> tuple[list[Single], list[Wide]]:
    """Singles and wide selections (families and ranges), each by family name and then as written.

    A whole family beside single features or ranges of the same family, and a family twice, are errors."""
    finders = [f for x in ([inputs] if isinstance(inputs, str) else inputs) for f in parse_selector(x)]
    if any(f.family == "*" for f in finders):
        if any(f.family == "*" and not f.whole for f in finders):
            raise FeatureError("*: takes whole families only")
        finders = [g for f in finders for g in ([Finder(n) for n in sorted(schema.families)] if f.family == "*" else [f])]
    whole = [f.family for f in finders if f.whole]
    if len(set(whole)) < len(whole) or any(not f.whole and f.family in whole for f in finders):
        raise FeatureError("a whole family is selected beside other features of it")
    singles, wide = [], []
    for f in sorted(finders, key=lambda f: f.family):
        family = schema.family(f.family)
        if f.feature is not None:
            singles.append(Single(family, family.index(f.feature)))
            continue
        if family.size is None:
            raise FeatureError(f"the size of family {family.name} isn't known")
        if f.whole:
            wide.append(Wide(family, 0, family.size))
        else:
            if f.last >= family.size:
                raise FeatureError(f"{f.first}-{f.last} is beyond family {family.name} of {family.size}")
            wide.append(Wide(family, f.first, f.last - f.first + 1))
    return singles, wide
