"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage reads doc_id and text alone, so other columns may bear any names; all but the
last return them as they came.  An empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seine.llm import lines, near_texts, packing, pii, quality_model
from seine.store import durable, read_table, release, release_since, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model rejects go.

    Null and empty texts have no words and are judged by the scorer like others.  Repeated
    rows have one text and one score: they stay or go together.
    """
    return quality_model.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters in 3 documents or more stay in one of them, that of the largest doc_id.

    Null texts stay null; repeated rows count once and lose the same lines; a row without
    doc_id keeps all its lines.
    """
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays, that of the smallest doc_id.

    Texts without words, null ones too, are one group.  Rows repeated with their text are
    one document and stay or go together; a row without doc_id stays.
    """
    return near_texts.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced, in every document.

    Null texts stay null; repeated rows are one document as evidence and change alike.
    """
    return pii.sanitise(docs, everywhere=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2,048 tokens.

    A null text is packed like an empty one, as its end id; repeated rows and rows without
    doc_id are packed like others.
    """
    return packing.report(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("PII", sanitise),
    ("best-fit packing", pack),
]

#: Fingerprints, information measures and token ids are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written()
        done = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_since(spark, mark, done)  # the stage's own tables
        release(docs)  # what the stage before wrote; the source table is not ours and stays
        docs = done
    return docs
