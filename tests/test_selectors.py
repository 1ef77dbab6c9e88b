import pytest

from featloom.schema import Family, FeatureError, OutputSchema, SchemaSpec
from featloom.selectors import Finder, parse_selector, resolve


def test_names_and_default_family():
    got = parse_selector("feat1, feat2,fam1:feat3, feat4,:feat5")
    assert got == [Finder("default", "feat1"), Finder("default", "feat2"), Finder("fam1", "feat3"), Finder("default", "feat4"), Finder("default", "feat5")]


def test_whole_families_several_features_and_trimming():
    got = parse_selector(" , fam2:, fam3:feat1 + feat2, fam4:1+2")
    assert got == [Finder("fam2"), Finder("fam3", "feat1"), Finder("fam3", "feat2"), Finder("fam4", 1), Finder("fam4", 2)]


def test_a_family_stands_for_its_own_item_only():
    assert parse_selector("c:80,83") == [Finder("c", 80), Finder("default", 83)]
    assert parse_selector("fam:1-10") == [Finder("fam", None, 1, 10)]
    assert parse_selector("*:") == [Finder("*")]


@pytest.mark.parametrize("text", [",", "", "a,,b", "a:1+2-3", "a:5-4", "a:1+", "a:7x"])
def test_errors(text):
    with pytest.raises(FeatureError):
        parse_selector(text)


def test_resolution_goes_by_family_name():
    schema = SchemaSpec({"b": Family("b", "dense", 4), "a": Family("a", "named", 2, ("x", "y")), "default": Family("default", "sparse", 9)})
    singles, wide = resolve(["b:1", "a:y+x", "7"], schema)
    assert [(s.family.name, s.index, s.name) for s in singles] == [("a", 1, "y"), ("a", 0, "x"), ("b", 1, "1"), ("default", 7, "7")]
    singles, wide = resolve("*:", schema)
    assert [(w.family.name, w.first, w.width) for w in wide] == [("a", 0, 2), ("b", 0, 4), ("default", 0, 9)]
    for bad in ("b:,b:1", "b:2-4", "b:4", "c:1", "a:z", "*:1"):
        with pytest.raises(FeatureError):
            resolve(bad, schema)
    assert SchemaSpec.from_json(schema.to_json()) == schema


def test_output_schema():
    out = OutputSchema()
    assert out.add("f", 3, ["x", "y", "z"]) == 0 and out.add("e", 0, []) == 3 and out.add("g", 2, lambda i: f"g{i}") == 3
    assert out.dim == 5 and out.name(0) == ("f", "x") and out.name(2) == ("f", "z") and out.name(3) == ("g", "g0")
    with pytest.raises(FeatureError):
        out.name(5)
    assert "dim 5" in str(out)
