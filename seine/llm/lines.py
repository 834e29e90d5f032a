"""Line dedup across documents, with DataFrame functions only.

Lines are exploded with their position, normalised and hashed (128 bits); the distinct
documents of each hash are counted, and the surviving lines are put together by position.

Scale.  The exploded table holds hashes, not text, and is written once.  Distinct (hash,
document) pairs are formed before the count, so a line of a third of all documents is
spread over all tasks and then combined before its second shuffle.  The repeated hashes are
written, so that their join with the lines is one of two plain shuffles, which AQE splits.  The text is shuffled once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.llm.tables import line_key, texts, unused
from seine.store import durable


def hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a line key."""
    return F.xxhash64(key), F.xxhash64(F.lit("line"), key)


def _line_table(docs: DataFrame, least_chars: int) -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = hashes(F.col("key"))
    return keys.where(F.char_length("key") >= least_chars).select("doc_id", "th", "pos", h1.alias("h1"), h2.alias("h2"))


def lost_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, th, lost): positions of the lines that each text of `docs` (see tables.texts) loses."""
    lines = durable(_line_table(docs, least_chars), "lines")
    often = durable(
        lines.where("doc_id is not null")
        .select("h1", "h2", "doc_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= least_docs)
        .drop("n"),
        "often",
    )
    return (
        lines.join(often, ["h1", "h2"])
        .where("doc_id < keeper")
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("lost"))  # at most the lines of one text
    )


def _kept(lines: Column, lost: Column) -> Column:
    """The lines at positions not in `lost`; array_except hashes, so this is linear.

    The one-element transform binds the split lines to a lambda variable: they are computed
    once, not for each position.
    """
    whole = F.struct(lines.alias("lines"), lost.alias("lost"))
    return F.transform(
        F.array(whole),
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["lost"]),
                lambda i: x["lines"][i],
            ),
            "\n",
        ),
    )[0]


def _joined(docs: DataFrame, id_col: str, text_col: str, lost: DataFrame) -> tuple[DataFrame, Column]:
    """`docs` beside the lines that each text loses (null: none); the small side is built, so texts are not sorted."""
    key, hashed, own_id, own_hash, gone = unused(docs, "key", "hash", "id", "th", "lost")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select("*", F.col(id_col).cast("long").alias(key), F.xxhash64(text).alias(hashed))
    lost = lost.select(F.col("doc_id").alias(own_id), F.col("th").alias(own_hash), F.col("lost").alias(gone))
    on = (F.col(key) == F.col(own_id)) & (F.col(hashed) == F.col(own_hash))
    return keyed.join(lost.hint("shuffle_hash"), on, "left"), F.col(gone)


def dedup_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` with `text_col` less its repeated lines; columns and rows stay.

    A line's key is the line stripped of white space, A-Z lower-cased.  A key of at least
    `least_chars` code points in at least `least_docs` distinct documents loses all its
    lines except in the largest doc_id that holds it.  A null or empty text is one empty
    line and stays as it is; a row without doc_id is not counted and keeps its lines;
    repeated rows count once and are treated alike.
    """
    joined, gone = _joined(docs, id_col, text_col, lost_lines(texts(docs, id_col, text_col), least_chars, least_docs))
    new = F.when(gone.isNull(), F.col(text_col)).otherwise(_kept(F.split(F.col(text_col), "\n", -1), gone))
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of `docs`."""
    own = texts(docs)
    joined, gone = _joined(own, "doc_id", "text", lost_lines(own, least_chars, least_docs))
    kept = F.when(gone.isNull(), F.col("text")).otherwise(_kept(F.split("text", "\n", -1), gone))
    breaks = F.char_length("text") - F.char_length(F.translate("text", "\n", ""))
    return joined.select(
        "doc_id",
        (breaks + 1).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )
