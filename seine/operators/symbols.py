"""Symbol tables (name, kind, file_path, line, visibility)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find(symbols: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Symbols whose name holds a text (any case) and whose path holds another."""
    found = symbols.where(F.lower("name").contains(name.lower()))
    return found.where(F.col("file_path").contains(path)) if path else found


def exact(symbols: DataFrame, name: str, ignore_case: bool = False) -> DataFrame:
    return symbols.where(F.lower("name") == name.lower() if ignore_case else F.col("name") == name)


def prefix(symbols: DataFrame, start: str) -> DataFrame:
    return symbols.where(F.lower("name").startswith(start.lower()))


def api_surface(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where((F.col("visibility") == "public") & (F.col("file_path") == path))


def outline(symbols: DataFrame, path: str) -> DataFrame:
    own = symbols.where(F.col("file_path") == path)
    return own.withColumn("position", F.row_number().over(Window.partitionBy("file_path").orderBy("line")) - 1)


def overlay(base: DataFrame, gone: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """An immutable table with tombstones and additions."""
    return base.join(gone.select(*key).distinct(), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def kind_rank(kind):
    return (
        F.when(kind.isin("struct", "class", "trait", "enum", "interface", "type"), 0)
        .when(kind.isin("function", "method", "impl"), 1)
        .when(kind.isin("const", "static", "variable"), 2)
        .when(kind.isin("module", "namespace"), 3)
        .otherwise(9)
    )


def definitions(symbols: DataFrame) -> DataFrame:
    """(name, file_path, line): the best definition of each name: types, then functions, then values; imports are none."""
    own = symbols.where("kind <> 'import'").withColumn("name", F.lower("name"))
    order = F.struct(kind_rank(F.col("kind")).alias("k"), "file_path", "line")
    return own.groupBy("name").agg(F.min(order).alias("x")).select("name", "x.file_path", "x.line")


def unique_targets(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (src, dst, name) from (file_path, name) to the one other file that defines the name; none if several do."""
    where = symbols.where("kind <> 'import'").groupBy("name").agg(F.countDistinct("file_path").alias("n"), F.min("file_path").alias("dst")).where("n = 1")
    found = names.join(where, "name").where("file_path <> dst")
    return found.select(F.col("file_path").alias("src"), "dst", "name").groupBy("src", "dst").agg(F.min("name").alias("name"))


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call (file_path, line, callee) with the last function that begins at or before it: an as-of join by a window over both."""
    both = calls.select("file_path", "line", F.lit(1).alias("o"), "callee", F.lit(None).cast("string").alias("fn")).unionByName(
        symbols.where("kind in ('function', 'method')").select("file_path", "line", F.lit(0).alias("o"), F.lit(None).cast("string").alias("callee"), F.col("name").alias("fn"))
    )
    w = Window.partitionBy("file_path").orderBy("line", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("caller", F.last("fn", True).over(w)).where("o = 1").select("file_path", "line", "caller", "callee")


def rename_hazards(files: DataFrame, symbols: DataFrame, old: str, new: str) -> DataFrame:
    """(file_path, occurrences, hazard) of files that hold `old`: collision if the file defines `new`, shadowing if it mentions it."""
    count = F.regexp_count("content", F.lit(rf"\b{old}\b"))
    clash = symbols.where(F.col("name") == new).select("file_path", F.lit(True).alias("defines")).distinct()
    found = files.select("file_path", "content", count.alias("occurrences")).where("occurrences > 0").join(clash, "file_path", "left")
    hazard = F.when(F.col("defines"), "collision").when(F.col("content").rlike(rf"\b{new}\b"), "shadowing").otherwise("none")
    return found.select("file_path", "occurrences", hazard.alias("hazard"))


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    return files.withColumn("content", F.regexp_replace("content", rf"\b{old}\b", new))


def map_tests(files: DataFrame, is_test, imports: DataFrame) -> DataFrame:
    """(test, source, confidence): imports .95, same stem in the same folder .9, same stem elsewhere .7 and .05 a shared folder, up to .85; the best of a pair."""
    name = F.element_at(F.split("file_path", "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"^test_|_test$|\.test$|\.spec$|_spec$|Test$", "")
    own = files.select("file_path", stem.alias("stem"), F.regexp_replace("file_path", "/?[^/]*$", "").alias("dir"), is_test.alias("t"))
    tests = own.where("t").select(F.col("file_path").alias("test"), "stem", F.col("dir").alias("td"))
    sources = own.where("not t").select(F.col("file_path").alias("source"), "stem", F.col("dir").alias("sd"))
    shared = F.size(F.array_intersect(F.split("td", "/"), F.split("sd", "/")))
    named = tests.join(sources, "stem").select(
        "test", "source", F.when(F.col("td") == F.col("sd"), 0.9).otherwise(F.least(0.7 + 0.05 * shared, F.lit(0.85))).alias("confidence")
    )
    direct = imports.join(tests.select(F.col("test").alias("src")), "src").join(sources.select(F.col("source").alias("dst")), "dst")
    every = named.unionByName(direct.select(F.col("src").alias("test"), F.col("dst").alias("source"), F.lit(0.95).alias("confidence")))
    return every.groupBy("test", "source").agg(F.max("confidence").alias("confidence"))
