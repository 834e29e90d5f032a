"""Fusion, score stages and selection over ranked results.

Results are (chunk_id, file_path, line_start, line_end, content, score).  Every stage takes
and returns such a DataFrame; `pipeline` applies a list of them.  Stages that multiply
scores are joins with small per-file tables or plain columns; those that depend on what
was kept before are folds per query or file, whose size is the result's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators.graph import nodes_of, pagerank, real
from seine.store import durable


def by_score(*more: str) -> list[Column]:
    return [F.desc("score"), *[F.asc(c) for c in more or ("file_path", "line_start")]]


def pipeline(results: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda df, stage: df.transform(stage), stages, results)


def ranked(results: DataFrame, within: str | None = None, *ties: str) -> DataFrame:
    """`results` with rank from 0."""
    w = Window.partitionBy(within) if within else Window.partitionBy()
    return results.withColumn("rank", F.row_number().over(w.orderBy(*by_score(*ties))) - 1)


def rrf(lists: list[DataFrame], key: str, k: list[float] | float = 60.0) -> DataFrame:
    """(key, score) by reciprocal rank fusion of (key, rank from 0): the sum of 1 / (k + rank + 1)."""
    ks = k if isinstance(k, list) else [k] * len(lists)
    parts = [x.select(key, (1 / (F.lit(float(c)) + F.col("rank") + 1)).alias("score")) for x, c in zip(lists, ks)]
    return reduce(DataFrame.unionAll, parts).groupBy(key).agg(F.sum("score").alias("score"))


def hybrid_constants(identifier_query: bool, k: float = 60.0) -> list[float]:
    """Lexical and vector constants: identifiers trust the lexical list."""
    return [k / 3, 1.5 * k] if identifier_query else [1.5 * k, k / 3]


def progressive_rrf(lists: list[DataFrame], key: str, k: float = 60.0) -> DataFrame:
    """Lists are folded one by one: each result is ranked again before the next is fused."""
    now = lists[0]
    for other in lists[1:]:
        now = ranked(rrf([now, other], key, k), None, key)
    return now


def graph_boost(results: DataFrame, ranks: DataFrame, weight: float = 0.3) -> DataFrame:
    """x (1 + weight * rank of the file)."""
    own = ranks.select(F.col("node").alias("file_path"), F.col("rank").alias("_rank"))
    return results.join(own, "file_path", "left").withColumn("score", F.col("score") * (1 + weight * F.coalesce("_rank", F.lit(0.0)))).drop("_rank")


def personalized_boost(results: DataFrame, edges: DataFrame, seeds: int = 5, weight: float = 0.3, **options) -> DataFrame:
    """x (1 + weight * rank of the file), ranks personalised to the files of the `seeds` best results, by their summed scores.

    Without a seed in the graph the results stay as they are.  `options` go to `pagerank`.
    """
    asked = results.orderBy(*by_score()).limit(seeds).groupBy(F.col("file_path").alias("node")).agg(F.sum("score").alias("weight"))
    asked = durable(asked.join(nodes_of(real(edges)), "node", "left_semi").where("weight > 0"), "seeds")
    return results if asked.isEmpty() else graph_boost(results, pagerank(edges, asked, **options), weight)


def popularity_boost(results: DataFrame, edges: DataFrame) -> DataFrame:
    """x (1 + .05 ln c) for c > 3 distinct callers of the file."""
    callers = real(edges).groupBy(F.col("dst").alias("file_path")).agg(F.count("*").alias("_c"))
    factor = F.when(F.col("_c") > 3, 1 + 0.05 * F.log("_c")).otherwise(1.0)
    return results.join(callers, "file_path", "left").withColumn("score", F.col("score") * factor).drop("_c")


def recency_boost(results: DataFrame, changed: DataFrame, now: Column, weight: float = 0.1, days: int = 180) -> DataFrame:
    """x (1 + weight * max(0, 1 - age / days)), age in whole days, from (file_path, ts)."""
    last = changed.groupBy("file_path").agg(F.max("ts").alias("_ts"))
    age = F.datediff(now, F.col("_ts"))
    factor = 1 + weight * F.greatest(F.lit(0.0), 1 - age / days)
    return results.join(last, "file_path", "left").withColumn("score", F.col("score") * F.coalesce(factor, F.lit(1.0))).drop("_ts")


def path_match_boost(results: DataFrame, paths: list[str], words: list[str]) -> DataFrame:
    """x 2.5 if a path of the query is in the file's path, else x 2 if a query word (or its first five letters) is in a path segment."""
    path = F.col("file_path")
    explicit = reduce(lambda a, b: a | b, [path.contains(p) for p in paths], F.lit(False))
    long = [w.lower() for w in words if len(w) >= 4]
    in_path = reduce(lambda a, b: a | b, [F.lower(path).contains(w) for w in long], F.lit(False))
    stems = [w[:5] for w in long if len(w) >= 5]
    stem = F.exists(X.path_segments(path), lambda s: reduce(lambda a, b: a | b, [s.startswith(x) for x in stems], F.lit(False)))
    return results.withColumn("score", F.col("score") * F.when(explicit, 2.5).when(in_path | stem, 2.0).otherwise(1.0))


def test_demotion(results: DataFrame) -> DataFrame:
    return results.withColumn("score", F.col("score") * F.when(X.ranks_as_test(F.col("file_path")), 0.5).otherwise(1.0))


def definition_boost(results: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks that hold a definition of a term: x 12 primary (types, functions), x 6 others; other chunks of a file with a primary x .35."""
    lower = [t.lower() for t in terms]
    own = symbols.where(F.lower("name").isin(lower) & (F.col("kind") != "import")).select(
        F.col("file_path").alias("_f"),
        F.col("line").alias("_l"),
        F.col("kind").isin("function", "method", "class", "struct", "trait", "enum", "interface", "type").alias("_p"),
    )
    inside = (F.col("file_path") == F.col("_f")) & (F.col("_l") >= F.col("line_start")) & (F.col("_l") < F.col("line_end"))
    level = results.join(own, inside).groupBy("chunk_id").agg(F.max(F.when(F.col("_p"), 2).otherwise(1)).alias("_level"))
    primary = own.where("_p").select(F.col("_f").alias("file_path"), F.lit(True).alias("_has")).distinct()
    found = results.join(level, "chunk_id", "left").join(primary, "file_path", "left")
    factor = F.when(F.col("_level") == 2, 12.0).when(F.col("_level") == 1, 6.0).when(F.col("_has"), 0.35).otherwise(1.0)
    return found.withColumn("score", F.col("score") * factor).drop("_level", "_has")


def defining_files_boost(results: DataFrame, symbols: DataFrame, terms: list[str], factor: float = 3.5) -> DataFrame:
    """x 3.5 for every result of a file that defines a term; the boost of the first pass, by file."""
    lower = [t.lower() for t in terms]
    own = symbols.where(F.lower("name").isin(lower) & (F.col("kind") != "import")).select("file_path", F.lit(True).alias("_def")).distinct()
    return results.join(own, "file_path", "left").withColumn("score", F.col("score") * F.when(F.col("_def"), factor).otherwise(1.0)).drop("_def")


def visibility_boost(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """x 1.5 if a public symbol begins in the chunk."""
    own = symbols.where("visibility = 'public'").select(F.col("file_path").alias("_f"), F.col("line").alias("_l"))
    inside = (F.col("file_path") == F.col("_f")) & (F.col("_l") >= F.col("line_start")) & (F.col("_l") < F.col("line_end"))
    seen = results.join(own, inside, "left_semi").select("chunk_id", F.lit(True).alias("_v"))
    return results.join(seen, "chunk_id", "left").withColumn("score", F.col("score") * F.when(F.col("_v"), 1.5).otherwise(1.0)).drop("_v")


def concept_boost(results: DataFrame, clusters: DataFrame, terms: list[str]) -> DataFrame:
    """x min(1 + b, 2.5): b is the best of the file's clusters (term, file_path, score), min(.3 * score * min(hits, 5), 1.5)."""
    hits = clusters.where(F.col("term").isin(terms)).groupBy("file_path", "cluster").agg(F.count("*").alias("h"), F.max("score").alias("s"))
    best = hits.groupBy("file_path").agg(F.max(F.least(0.3 * F.col("s") * F.least("h", F.lit(5)), F.lit(1.5))).alias("_b"))
    factor = F.least(1 + F.coalesce("_b", F.lit(0.0)), F.lit(2.5))
    return results.join(best, "file_path", "left").withColumn("score", F.col("score") * factor).drop("_b")


def session_boost(results: DataFrame, agent: DataFrame, shared: DataFrame) -> DataFrame:
    """x (1 + min(.3, agent + .2 * shared)) from (file_path, boost) tables."""
    a = agent.select("file_path", F.col("boost").alias("_a"))
    s = shared.select("file_path", F.col("boost").alias("_s"))
    zero = F.lit(0.0)
    factor = 1 + F.least(F.lit(0.3), F.coalesce("_a", zero) + 0.2 * F.coalesce("_s", zero))
    return results.join(a, "file_path", "left").join(s, "file_path", "left").withColumn("score", F.col("score") * factor).drop("_a", "_s")


def usage_rank(results: DataFrame, name: str) -> DataFrame:
    """Best chunk of each file by how it uses a name: imports 2.4, calls 1.6, re-exports .7, definitions .02, documents .01, tests .25."""
    lines = F.split("content", "\n", -1)

    def line(pattern: str) -> Column:
        return F.exists(lines, lambda x: x.contains(name) & F.lower(x).rlike(pattern))

    factor = (
        F.when(line(rf"^\s*(pub\s+)?(fn|def|class|struct|func|function)\s+{name.lower()}"), 0.02)
        .when(line(r"^\s*pub use"), 0.7)
        .when(line(r"^\s*(use|import|from|#include|require)"), 2.4)
        .when(F.col("content").contains(name + "("), 1.6)
        .otherwise(1.0)
    )
    factor = factor * F.when(X.doc_file(F.col("file_path")), 0.01).otherwise(1.0) * F.when(X.ranks_as_test(F.col("file_path")), 0.25).otherwise(1.0)
    found = results.withColumn("score", F.col("score") * factor)
    return ranked(found, "file_path", "line_start").where("rank = 0").drop("rank")


def propagate(results: DataFrame, chunks: DataFrame, edges: DataFrame, seeds: int = 5, most: int = 3) -> DataFrame:
    """Adds the first chunk of up to `most` files next to the `seeds` best: callees .25, callers .15 of the score, the largest of each file."""
    best = results.orderBy(*by_score()).limit(seeds).groupBy("file_path").agg(F.max("score").alias("s"))
    own = real(edges)
    down = best.join(own, best["file_path"] == own["src"]).select(F.col("dst").alias("f"), (0.25 * F.col("s")).alias("score"))
    up = best.join(own, best["file_path"] == own["dst"]).select(F.col("src").alias("f"), (0.15 * F.col("s")).alias("score"))
    new = down.unionAll(up).groupBy("f").agg(F.max("score").alias("score")).join(results.select(F.col("file_path").alias("f")), "f", "left_anti")
    new = new.orderBy(F.desc("score"), "f").limit(most)
    columns = [c for c in results.columns if c != "score"]
    first = chunks.join(F.broadcast(new.select("f")), chunks["file_path"] == F.col("f"), "left_semi")  # at most `most` rows
    first = first.groupBy("file_path").agg(F.min_by(F.struct(*columns), F.struct("line_start", "chunk_id")).alias("c")).select("c.*")
    added = first.join(new, first["file_path"] == new["f"]).select(*columns, "score")
    return results.select(*columns, "score").unionByName(added)


def truncate_at_cliff(results: DataFrame, least: int = 3, drop: float = 0.35) -> DataFrame:
    """Cuts at the first place from `least` on where the score falls by more than `drop` of the best; for one result list.

    Scores are not negative.  A fall of that size leaves a bucket of half of it empty, or
    spans two, so at most 2 / drop + 1 counts of buckets decide, however many results there are.
    """
    best = results.agg(F.max("score")).first()[0]
    if best is None or best <= 0:
        return results
    bucket = F.floor(F.col("score") / F.lit(best * drop / 2))
    counts = results.groupBy(bucket.alias("b")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))
    above, before = 0, None
    for r in sorted(counts.collect(), key=lambda r: -r["b"]):  # at most 2 / drop + 1 rows
        if before is not None and above >= least and (before - r["high"]) / best > drop:
            return results.where(F.col("score") >= before)
        above, before = above + r["n"], r["low"]
    return results


def _fold(results: DataFrame, keep: Callable) -> DataFrame:
    """Per file, in order of score, line and chunk, keep(row, kept rows) decides; a task folds its sorted files one after another."""

    def run(batches):
        path, held = None, []
        for batch in batches:
            stays = []
            for own, *row in zip(*[batch.column(c).to_pylist() for c in ("file_path", "score", "line_start", "line_end")]):
                if own != path:
                    path, held = own, []
                row = _Result(*row)
                ok = keep(row, held)
                if ok:
                    held.append(row)
                stays.append(ok)
            yield batch.filter(pa.array(stays, pa.bool_()))

    dealt = results.repartition("file_path").sortWithinPartitions("file_path", F.desc("score"), "line_start", "chunk_id")
    return dealt.mapInArrow(run, results.schema)


class _Result(NamedTuple):
    score: float
    line_start: int
    line_end: int


def overlap_dedup(results: DataFrame) -> DataFrame:
    """Drops results that overlap a better one that was kept."""
    return _fold(results, lambda r, kept: all(r.line_start >= k.line_end or k.line_start >= r.line_end for k in kept))


def file_dedup(results: DataFrame, share: float = 0.7, apart: int = 50) -> DataFrame:
    """The best result of a file, and others of at least `share` of its score that begin `apart` lines from all kept."""
    return _fold(results, lambda r, kept: not kept or (r.score >= share * kept[0].score and all(abs(r.line_start - k.line_start) >= apart for k in kept)))


def band_merge(results: DataFrame, gap: int = 3) -> DataFrame:
    """Results of one file that lie within `gap` lines of each other become one, with the best score."""
    w = Window.partitionBy("file_path").orderBy("line_start", "line_end")
    before = F.max("line_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = results.withColumn("_new", F.when(F.col("line_start") <= before + gap, 0).otherwise(1))
    island = island.withColumn("_band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("file_path", "_band").agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max("score").alias("score"), F.count("*").alias("merged")
    ).drop("_band")


def within_budget(results: DataFrame, cost: str, budget: int) -> DataFrame:
    """Results in score order while their costs stay within the budget; skips none: the first too large one ends the list."""
    w = Window.partitionBy().orderBy(*by_score()).rowsBetween(Window.unboundedPreceding, 0)
    best = results.orderBy(*by_score()).limit(budget + 1)  # a result costs one at least, so no more can fit
    return best.withColumn("used", F.sum(F.greatest(F.col(cost), F.lit(1))).over(w)).where(F.col("used") <= budget)


def render(results: DataFrame) -> DataFrame:
    """One Markdown block a result."""
    head = F.concat(F.lit("### "), "file_path", F.lit(":"), (F.col("line_start") + 1).cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    return results.select("chunk_id", F.concat(head, F.lit("\n```\n"), "content", F.lit("\n```\n")).alias("block"))


def mmr(candidates: DataFrame, k: int, trade: float = 0.7, group: str = "query_id") -> DataFrame:
    """(query, key, step) picked by maximal marginal relevance from (query, key, relevance, vector).

    A group is one query's candidates (a few times k).  Ties go to the last candidate by
    relevance order, as in a fold that keeps the last maximum.
    """
    kind = dict(candidates.select(group, "key").dtypes)

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["relevance", "key"], ascending=[False, True])
        v = np.stack([np.asarray(x, float) for x in pdf["vector"]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rel, near, left, out = pdf["relevance"].to_numpy(), np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(out) < k:
            value = [round(trade * rel[i] - (1 - trade) * near[i], 12) for i in left]
            best = max(value)
            pick = [i for i, x in zip(left, value) if x == best][-1]
            out.append(pick)
            left.remove(pick)
            near = np.maximum(near, v @ v[pick])
        return pd.DataFrame({group: pdf[group].iloc[0], "key": pdf["key"].iloc[out].to_numpy(), "step": range(len(out))})

    return candidates.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, key {kind['key']}, step long")


def precision_recall(found: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr, hit) at k from (query_id, key, rank from 0) and (query_id, key)."""
    best = found.where(F.col("rank") < k).join(wanted.withColumn("good", F.lit(1)), ["query_id", "key"], "left")
    per = best.groupBy("query_id").agg(F.sum("good").alias("hits"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    gold = wanted.groupBy("query_id").agg(F.countDistinct("key").alias("gold"))
    hits = F.coalesce("hits", F.lit(0))
    return gold.join(per, "query_id", "left").select(
        "query_id",
        (hits / k).alias("precision"),
        (hits / F.col("gold")).alias("recall"),
        F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("rr"),
        (hits > 0).alias("hit"),
    )
