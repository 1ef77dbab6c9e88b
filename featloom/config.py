"""Transform lists as text, by a builder, and flat settings."""

from __future__ import annotations

import re
from typing import Any

from . import plans

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<name>[A-Za-z_]\w*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>[-+]?(?:inf(?:inity)?|nan|\d*\.?\d+(?:[eE][-+]?\d+)?)f?)|(?P<mark>[{}:;,\[\]<>]|-)""")


def parse_text(text: str) -> dict[str, list[Any]]:
    """Fields of a message in text form: name to its values, messages as such dicts."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"odd text at {text[at:at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    out, rest = _fields(tokens, 0)
    if rest != len(tokens):
        raise ValueError("an unmatched brace")
    return out


def _fields(tokens: list[tuple[str, str]], at: int) -> tuple[dict[str, list[Any]], int]:
    out: dict[str, list[Any]] = {}
    while at < len(tokens) and tokens[at][1] != "}":
        kind, name = tokens[at]
        if kind == "mark" and name in ",;":
            at += 1
            continue
        if kind != "name":
            raise ValueError(f"a field name is wanted, not {name!r}")
        at += 1
        if at < len(tokens) and tokens[at][1] == ":":
            at += 1
        if at >= len(tokens):
            raise ValueError(f"{name} has no value")
        if tokens[at][1] == "{":
            value, at = _fields(tokens, at + 1)
            if at >= len(tokens):
                raise ValueError("an unmatched brace")
            at += 1
        elif tokens[at][1] == "-":
            value, at = -_scalar(*tokens[at + 1]), at + 2
        else:
            value, at = _scalar(*tokens[at]), at + 1
        out.setdefault(name, []).append(value)
    return out, at


def _scalar(kind: str, text: str) -> Any:
    if kind == "string":
        return bytes(text[1:-1], "utf-8").decode("unicode_escape")
    if text.lower() in ("inf", "infinity", "nan", "-inf", "+inf"):
        return float(text)
    if kind == "number":
        return float(text.rstrip("f")) if re.search(r"[.eEfn]", text) else int(text)
    return {"true": True, "false": False}.get(text, text)


def parse_config(text: str, models: dict[str, Any] | None = None) -> list[plans.Transform]:
    """The transforms of a text of transform_configs. models: graph_path to (predict_factory, output_dim), for tf_transform."""
    out = []
    for c in parse_text(text).get("transform_configs", []):
        base = (c.get("base_config") or [{}])[0]
        store = (base.get("output_store_type") or ["OUTPUT"])[0]
        options = {"output_family": (base.get("output_family") or [None])[0], "intermediate": store != "OUTPUT"}
        if options["output_family"]:
            options["output_family"] = options["output_family"].rstrip(":")
        inputs = base.get("input_features", [])
        kinds = [k for k in c if k != "base_config"]
        if len(kinds) != 1:
            raise ValueError(f"one transform is wanted, not {kinds}")
        kind, body = kinds[0], c[kinds[0]][0]
        get = lambda n, default=None, body=body: body.get(n, [default])[0]
        if kind == "select_transform":
            t = plans.Select(inputs, **options)
        elif kind == "bucketize_transform":
            t = plans.Bucketize(inputs, body.get("buckets", []), **options)
        elif kind == "one_hot_transform":
            t = plans.OneHot(inputs, **options)
        elif kind == "ngram_transform":
            t = plans.Ngram(inputs, **options)
        elif kind == "constant_transform":
            t = plans.Constant(get("constant", 0.0), **options)
        elif kind == "kmeans_transform":
            t = plans.KMeansAssign(inputs, model_path=get("model_path"), k=get("num_cluster_centers"), dim=get("feature_dim"), **options)
        elif kind == "normalize_transform":
            t = plans.Normalize(inputs, get("norm", "sumsq") or "sumsq", **options)
        elif kind == "logit_transform":
            t = plans.Logit(inputs, get("lower_bound"), get("upper_bound"), **options)
        elif kind == "hash_transform":
            t = plans.HashTrick(inputs, get("num_buckets"), **options)
        elif kind == "tf_transform":
            if get("graph_path") not in (models or {}):
                raise KeyError(f"no model is given for {get('graph_path')!r}")
            factory, width = models[get("graph_path")]
            t = plans.ModelInference(inputs, factory, width, **options)
        else:
            raise KeyError(f"no transform {kind!r}")
        out.append(t)
    return out


class ConfigBuilder:
    """Transforms one after the other: ConfigBuilder().select("*:").bucketize(":3", [0, 1]).build()."""

    def __init__(self) -> None:
        self._transforms: list[plans.Transform] = []

    def add(self, kind: str, *args, **options) -> ConfigBuilder:
        self._transforms.append(plans.transform(kind, *args, **options))
        return self

    def __getattr__(self, kind: str):
        if kind.startswith("_"):
            raise AttributeError(kind)
        return lambda *args, **options: self.add(kind.removeprefix("add_"), *args, **options)

    def build(self) -> list[plans.Transform]:
        return list(self._transforms)


def settings(text: str) -> dict[str, Any]:
    """key: value lines; # starts a comment."""
    out: dict[str, Any] = {}
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if not line or line.startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not key: value: {line!r}")
        value = value.strip().strip("\"'")
        out[key.strip()] = int(value) if re.fullmatch(r"[-+]?\d+", value) else float(value) if re.fullmatch(r"[-+]?\d*\.\d+", value) else value
    return out
