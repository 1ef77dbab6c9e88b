"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from featloom.llm.common import table
from featloom.llm.queries import RANKS
from featloom.session import cut, reach

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the default policy of the quality rules keeps.

    Each row goes by its own text, repeated ones too; a null or empty text has too few words and goes; a null doc_id stays;
    an empty table stays empty; other columns, whatever their names, stay."""
    return quality_rules.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs of 50 words and more; n_chars follows. A document of which
    nothing but white space is left goes, if it had more before.

    The copy of the smallest doc_id, and in it the first, stays. Rows that repeat a doc_id and its text are one document
    and keep or lose the same; with a null doc_id rows stay as they are, as do null and empty texts; an empty table stays
    empty; other columns, whatever their names, stay."""
    reach(spark)
    return line_dedup.cleaned(docs, min_words=50)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked at a similarity of 0.8 or more: that of the smallest doc_id.

    Of rows that repeat that doc_id the one with the least text stays; rows with a null doc_id all stay; texts without
    words are groups of their own; an empty table stays empty; other columns, whatever their names, stay."""
    reach(spark)
    return near_dedup.deduplicated(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item is found.

    Each row goes by its own text, also with a repeated or null doc_id; null and empty texts stay; items without a word
    are in no text, and an empty benchmark or table changes nothing; other columns, whatever their names, stay."""
    return decontaminate.clean(docs, table(reach(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded bytes, and ids: a row for each row.

    Null and empty texts have no tokens; a null doc_id stays; an empty table gives none; other columns go."""
    reach(spark)
    return bpe.encode_documents(docs, RANKS, keep_ids=True, keep_offsets=False)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(reach(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # each stage reads its input several times
            docs = cut(docs)
    return docs
