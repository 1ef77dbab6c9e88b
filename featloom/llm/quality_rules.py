"""Quality rules kept as a ledger of bits.

Every rule is evaluated once per document; the ledger holds the measurements and one failure bit for each rule.
Policies (a name and version, and the rules they enforce) are masks over those bits, so that a new policy or an
ablation is bit arithmetic over the ledger and never a second pass over texts. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

#: Name, condition of failure over the measurements as SQL and as a column; the position is the bit. Append only: bits
#: are stored.
RULES: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("few_words", "n_words < 50", lambda m: m["n_words"] < 50),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", "100 * n_symbols > 10 * n_words", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    ("short_words", "word_chars < 2 * n_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", "word_chars > 15 * n_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    ("dup_lines", "100 * n_dup_lines > 60 * n_lines", lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"]),
    ("upper_case", "100 * n_upper > 40 * word_chars", lambda m: 100 * m["n_upper"] > 40 * m["word_chars"]),
]
BIT = {name: 1 << i for i, (name, _, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[x] for x in set(self.rules))


POLICIES = {
    "base": Policy("base", 1, BASE),
    "default": Policy("default", 1, tuple(BIT)),
}


def _let(value: Column, body) -> Column:
    """body over a variable that holds value, so that value is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words inside windows of three whose hash is found twice or more. windows: hash of the window at each word."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda t: F.filter(t, lambda x, k: F.coalesce(F.get(t, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(t, k + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(_let(placed, twice), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"))
    return F.aggregate(places, start, add, lambda acc: acc["n"])


def measurements(text: Column) -> Column:
    """A struct of the measurements (long) of a whole text, as one expression in which nothing is worked out twice."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(t: Column, ws: Column, ls: Column) -> Column:
        n = F.size(ws)
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        repeated = _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), _covered(hs)).otherwise(F.lit(0)))
        values = [
            n,
            F.length(F.translate(t, " \t\n\x0b\f\r", "")),
            F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            F.size(ls) - F.size(F.array_distinct(ls)),
            F.when(n < 4, F.lit(0)).otherwise(repeated),
            F.size(ls),
            F.length(t) - F.length(F.translate(t, UPPER, "")),
        ]
        return F.struct(*(v.cast("long").alias(x) for x, v in zip(MEASURES, values)))

    words = lambda t: F.filter(F.split(t, WHITE), lambda x: x != "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    return _let(text, lambda t: _let(F.struct(words(t).alias("ws"), lines(t).alias("ls")), lambda p: of_words(t, p["ws"], p["ls"])))


def fail_bits(measured: Column) -> Column:
    """The rules' bits over a struct of measurements."""

    def bits(m: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(fails(m), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, _, fails in RULES])

    return _let(measured, bits)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements (long) of the whole text.

    Null and empty texts measure 0 everywhere; repeated rows are measured each; a null doc_id stays."""
    return documents(docs).select("doc_id", measurements(F.col("text")).alias("m")).select("doc_id", "m.*")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and fail_bits (long), bit i set if rule i fails."""
    rows = documents(docs).select("doc_id", measurements(F.col("text")).alias("m"))
    return rows.select("doc_id", "m.*", fail_bits(F.col("m")).alias("fail_bits"))


def failed(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def _named(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.withColumns({"policy": F.lit(policy.name), "policy_version": F.lit(policy.version)})


def verdicts(docs: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    """Ledger with base_failed, kept (false if base_failed or a rule of the policy fails), and the policy's name and version."""
    return _named(ledger(docs).withColumn("base_failed", failed(POLICIES["base"])).withColumn("kept", ~(F.col("base_failed") | failed(policy))), policy)


def accepted(docs: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    """The rows of docs that the policy and the base rules keep, with all their columns. One pass, no shuffle."""
    wrong = policy.mask | POLICIES["base"].mask
    return docs.where(fail_bits(measurements(F.col("text"))).bitwiseAND(F.lit(wrong).cast("long")) == 0)


def ablations(ledger_rows: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (rows that would be kept without it), and the policy's name and
    version.

    One count for each combination of bits (at most 2**rules rows, whatever the input) carries all of it; a rule that
    fails nowhere has zeros."""
    combos = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(BIT[x]).cast("long").alias("bit")) for x in BIT if x in policy.rules])
    none = ledger_rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("n"))
    one = combos.unionByName(none).select("bits", "n", F.explode(rules).alias("r"))
    counts = one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
    return _named(counts, policy)


def compare(ledger_rows: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """Counts of rows by verdict under two policies: old_kept, new_kept, n."""
    combos = ledger_rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    return combos.groupBy((~failed(old)).alias("old_kept"), (~failed(new)).alias("new_kept")).agg(F.sum("n").alias("n"))


ORACLE_MEASURES = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN cov USING (doc_id)),
led AS (SELECT *, (""" + " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule, _ in RULES) + r""")::BIGINT AS fail_bits FROM m)
"""
ORACLE = ORACLE_MEASURES + "SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 'default' AS policy, 1 AS policy_version FROM led"
ABLATIONS_ORACLE = ORACLE_MEASURES + f"""SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only, 'default' AS policy, 1 AS policy_version
FROM led, (SELECT unnest({list(BIT)}) AS rule, unnest({list(BIT.values())}) AS bit) GROUP BY rule"""
