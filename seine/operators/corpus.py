"""Files, chunks and sections of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text as X

LINES_PER_CHUNK = 37  # 1500 characters at 40 a line


def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files: path source/lang/doc_<id>.txt."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(path.alias("file_path"), F.col("text").alias("content"), "source", "lang", "doc_id")


def line_chunks(files: DataFrame, per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Groups of lines, cut inside each row: no shuffle.  line_end is exclusive."""
    lines = F.split("content", "\n", -1)
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(per_chunk))
    found = files.select("file_path", lines.alias("lines")).select("file_path", "lines", F.explode(starts).alias("line_start"))
    return found.select(
        F.md5(F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"))).alias("chunk_id"),
        "file_path",
        "line_start",
        F.least(F.col("line_start") + per_chunk, F.size("lines")).alias("line_end"),
        F.array_join(F.slice("lines", F.col("line_start") + 1, per_chunk), "\n").alias("content"),
    )


def bridge_chunks(chunks: DataFrame, ratio: float = 0.25, least: int = 200, most: int = 1500) -> DataFrame:
    """Chunks over the border of two neighbours: half of (|A| + |B|) / 2 * ratio from either side."""
    w = Window.partitionBy("file_path").orderBy("line_start")
    after = F.lead("content").over(w)
    half = F.floor((F.char_length("content") + F.char_length("next")) / 2 * min(ratio, 0.5) / 2).cast("int")
    found = chunks.select("file_path", "line_start", "content", after.alias("next")).where("next is not null")
    joined = F.concat(F.expr("right(content, half)"), F.lit("\n"), F.expr("left(next, half)"))
    return (
        found.withColumn("half", half)
        .select("file_path", "line_start", joined.alias("bridge"))
        .where(X.ink(F.col("bridge")).between(least, most))
    )


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes by language, by extension and in all."""
    found = files.select(
        F.coalesce(X.language_of(F.col("file_path")), F.lit("unknown")).alias("language"),
        F.regexp_extract("file_path", r"\.([^./]+)$", 1).alias("extension"),
        F.octet_length("content").cast("long").alias("bytes"),
    )
    both = found.groupingSets([["language"], ["extension"], []], "language", "extension")
    return both.agg(F.count("*").alias("file_count"), F.sum("bytes").alias("total_bytes"))


def file_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last (inclusive, from 0) of each file."""
    cut = F.slice(F.split("content", "\n", -1), first + 1, last - first + 1)
    return files.select("file_path", F.array_join(cut, "\n").alias("content"))


def plain_sections(files: DataFrame, most: int = 2000) -> DataFrame:
    """Blank-line paragraphs; heading is the first line, cut to 80 characters."""
    parts = F.filter(F.split("content", r"\n[ \t]*\n", -1), lambda p: F.trim(p) != "")
    found = files.select("file_path", F.posexplode(parts).alias("section", "content"))
    first = F.split("content", "\n")[0]
    heading = F.when(F.char_length(first) > 80, F.concat(F.substring(first, 1, 80), F.lit("…"))).otherwise(first)
    return found.select("file_path", "section", heading.alias("heading"), F.char_length("content").cast("long").alias("chars"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Flat sections of Markdown with their breadcrumb; text before the first heading is level 0."""
    line = files.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    level = F.char_length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    marked = line.withColumn("level", level)
    so_far = Window.partitionBy("file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(so_far))
    title = F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))
    grouped = (
        marked.groupBy("file_path", "section")
        .agg(
            F.max("level").alias("level"),
            F.min("pos").alias("line_start"),
            F.max(F.when(F.col("level") > 0, title)).alias("heading"),
            F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"),
        )
        .withColumn("content", F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
        .drop("l")
    )
    by = Window.partitionBy("file_path").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)

    def at(depth: int) -> Column:
        """The open heading of a level: the last one of that level, unless a higher one came after it."""
        return F.last(F.when(F.col("level") == depth, F.col("heading")).when(F.col("level").between(1, depth - 1), F.lit("")), True).over(by)

    crumbs = F.filter(F.array(*[F.when(F.col("level") >= d, at(d)) for d in range(1, 7)]), lambda x: x.isNotNull() & (x != ""))
    return grouped.select("file_path", "section", "level", "line_start", "heading", crumbs.alias("path"), "content").where(
        (F.col("level") > 0) | (F.trim("content") != "")
    )


def embed_text(chunks: DataFrame) -> DataFrame:
    """The text that is embedded for a chunk: file, language, then the body."""
    head = F.concat(F.lit("File: "), "file_path", F.lit(" | Language: "), F.coalesce(X.language_of(F.col("file_path")), F.lit("unknown")), F.lit("\n"))
    return chunks.select("chunk_id", F.concat(head, "content").alias("embed_text"))


def notebook_cells(files: DataFrame) -> DataFrame:
    """(file_path, cell, cell_type, source) of notebooks."""
    schema = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    found = files.select("file_path", F.posexplode(F.from_json("content", schema)["cells"]).alias("cell", "c"))
    return found.select("file_path", "cell", "c.cell_type", F.array_join("c.source", "").alias("source"))


def doc_references(sections: DataFrame) -> DataFrame:
    """Distinct identifiers in backticks of a text: two characters or more, no space, and of the shape of code."""
    found = sections.select("file_path", F.explode(F.regexp_extract_all("content", F.lit("`([^`\n]+)`"), F.lit(1))).alias("raw"))
    ok = (
        (F.char_length("raw") >= 2)
        & ~F.col("raw").contains(" ")
        & ~F.lower("raw").isin("true", "false", "null", "none", "int", "string", "bool", "float")
        & (F.col("raw").contains("::") | F.col("raw").contains("_") | F.col("raw").endswith("()") | F.col("raw").rlike("^[A-Z][a-z0-9]+[A-Z]|[a-z][A-Z]"))
    )
    return found.where(ok).select("file_path", F.regexp_replace("raw", r"\(\)$", "").alias("name")).distinct()


def html_code_references(pages: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("<code[^>]*>([^<]+)</code>"), F.lit(1))
    return pages.select("url", F.explode(found).alias("name")).distinct()
