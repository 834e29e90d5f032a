"""Vocabulary learnt from names: clusters, co-occurrence, bridges, mined sessions, semantic search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text as X

SYMBOLS_A_CLUSTER, TERMS_A_FILE, EXPANSIONS, NAMES_A_TERM = 32, 32, 12, 20


def _terms(symbols: DataFrame) -> DataFrame:
    return symbols.select("name", "file_path", F.explode(F.array_distinct(X.identifier_parts(F.col("name")))).alias("term"))


def clusters(symbols: DataFrame) -> DataFrame:
    """(term, names, size, score): parts that two names or more share; the first 32 names of each; equal sets once, under the least term.

    The cap of names is the feature; it is a rank, so a part that a third of all names hold
    is counted in parts before one task sees its first 32.
    """
    pairs = _terms(symbols).select("term", "name").distinct()
    ranked = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy("name")))
    sets = ranked.where(F.col("rn") <= SYMBOLS_A_CLUSTER).groupBy("term").agg(F.sort_array(F.collect_list("name")).alias("names")).where(F.size("names") >= 2)
    once = sets.groupBy("names").agg(F.min("term").alias("term"))
    total = symbols.agg(F.countDistinct("name").alias("total"))
    return once.join(F.broadcast(total), F.lit(True)).select("term", "names", F.size("names").alias("size"), (F.size("names") / F.col("total")).alias("score"))


def cooccurrence(symbols: DataFrame) -> DataFrame:
    """(term, expansion, n, rank): terms that share files; 32 terms a file bound its pairs, 12 expansions a term."""
    per = _terms(symbols).where(F.char_length("term") >= 3).groupBy("file_path", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file_path").orderBy(F.desc("n"), F.desc(F.char_length("term")), "term")
    top = per.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= TERMS_A_FILE).select("file_path", "term")
    pairs = top.join(top.withColumnRenamed("term", "expansion"), "file_path").where("term <> expansion").groupBy("term", "expansion").agg(F.count("*").alias("n"))
    order = Window.partitionBy("term").orderBy(F.desc("n"), F.desc(F.char_length("expansion")), "expansion")
    return pairs.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < EXPANSIONS)


def bridge(symbols: DataFrame) -> DataFrame:
    """(term, names): up to 8 names for each term of at most 20 names."""
    pairs = _terms(symbols).select("term", "name").distinct()
    few = pairs.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") <= NAMES_A_TERM)
    sets = pairs.join(few, "term").groupBy("term").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return sets.select("term", F.slice("names", 1, 8).alias("names"))


def mine_sessions(asked: DataFrame, seen: DataFrame, least: int = 3, sessions: int = 2, most: int = EXPANSIONS) -> DataFrame:
    """(term, word, n, sessions, rank) of query terms and path words that meet in sessions (conv_id)."""
    pairs = asked.join(seen, "conv_id").where("term <> word").groupBy("term", "word")
    found = pairs.agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("sessions")).where((F.col("n") >= least) & (F.col("sessions") >= sessions))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "word")) - 1).where(F.col("rank") < most)


def expansions(term: str, learned: list[DataFrame]) -> DataFrame:
    """Expansions of a term out of several (term, expansion, rank) tables, earlier tables first, each once."""
    parts = [t.where(F.col("term") == term).select("expansion", F.lit(i).alias("source"), "rank") for i, t in enumerate(learned)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("expansion").agg(F.min(F.struct("source", "rank")).alias("first")).orderBy("first", "expansion")


def semantic(symbols: DataFrame, words: list[str]) -> DataFrame:
    """(name, score): Jaccard similarity of a name's parts with query words, above 0."""
    asked = F.array(*[F.lit(w) for w in words])
    parts = F.array_distinct(F.split(F.lower("name"), "_"))
    return symbols.select("name", X.jaccard(parts, asked).alias("score")).where("score > 0")
