"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string never null): all that an operator reads, so other columns cannot clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names for working columns beside those of `docs`, whatever these are called."""
    prefix, taken = "_seine", {c.lower() for c in docs.columns}
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [f"{prefix}_{n}" for n in names]


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; plain lower() where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def words_of(text: str) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+`; bytes.split() splits at exactly these characters."""
    return [w.decode() for w in text.encode().split()]


def rows(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
