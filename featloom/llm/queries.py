"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_extract, license_scan, line_dedup, lm_score, near_dedup, quality_crf, quality_rules
from .common import table

#: A parameter: the rank file must lie at this path on every executor.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    template = chat.BracketTemplate()
    return chat.digests(chat.format_turns(rows.unionByName(more), template), template)


def op2_near_dedup(spark, sf_dir):
    return near_dedup.clusters(table(spark, sf_dir, "documents"), percent=85)


def op3_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_lm_score(spark, sf_dir):
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, keep_ids=False, keep_offsets=False)


def op6_line_dedup(spark, sf_dir):
    """Per document what is left when later copies of runs of 50 words and more are deleted, and which lines (from 0) go."""
    rest = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    deleted = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1), F.lit(0))
    text = F.coalesce("text", F.lit(""))
    spans = F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ","), F.lit(""))
    return rest.select("doc_id", deleted.cast("long").alias("n_deleted_lines"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"), spans.alias("spans"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def quality_ablations(spark, sf_dir):
    """What each rule of the default policy does by itself, from the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op8_quality_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_crf.classify(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_chat_formatting": op1_chat_formatting, "op2_near_dedup": op2_near_dedup, "op3_html_extraction": op3_html_extraction, "op4_lm_score": op4_lm_score, "op5_bpe": op5_bpe, "op6_line_dedup": op6_line_dedup, "op7_quality_rules": op7_quality_rules, "quality_ablations": quality_ablations, "op8_quality_crf": op8_quality_crf, "op9_license_scan": op9_license_scan, "op10_decontamination": op10_decontamination}
OP1_ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\]|LF\])', '\1\\\2\3', 'g') AS e FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(e) + CASE WHEN role = 'assistant' THEN 7 ELSE 16 + length(role) END)::BIGINT AS formatted_chars, false AS rewrites
FROM f GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_ORACLE, "op2_near_dedup": near_dedup.ORACLE, "op4_lm_score": lm_score.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "quality_ablations": quality_rules.ABLATIONS_ORACLE}
