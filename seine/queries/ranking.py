"""Score stages, fusion and selection over BM25 results of line chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators import rank
from seine.queries import query
from seine.queries.graphs import rank_ctes
from seine.queries.retrieval import bm25_sql, scores
from seine.queries.text import CHUNKS, chunks, files
from seine.store import read_table

LIST_A, LIST_B, LIST_C = ["ention"], ["onthe", "threre"], ["eaux", "ouai"]


def _sql(terms: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def _best(terms: list[str], n: int = 40) -> str:
    return f"(WITH {bm25_sql(_sql(terms))} SELECT doc_id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS INT) AS rank FROM s ORDER BY rank LIMIT {n})"


def best(spark, sf_dir, terms, n=40):
    found = scores(spark, sf_dir, terms).withColumn("score", F.round("score", 9))
    return rank.ranked(found.orderBy(F.desc("score"), "doc_id").limit(n), None, "doc_id").select("doc_id", "rank")


@query(f"SELECT doc_id, round(sum(1.0 / (60 + rank + 1)), 6) AS score FROM (FROM {_best(LIST_A)} UNION ALL FROM {_best(LIST_B)}) GROUP BY doc_id")
def rrf_fusion(spark, sf_dir):
    found = rank.rrf([best(spark, sf_dir, LIST_A), best(spark, sf_dir, LIST_B)], "doc_id")
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, 1.0 / (20 + rank + 1) AS s FROM {_best(LIST_A)} UNION ALL SELECT doc_id, 1.0 / (90 + rank + 1) FROM {_best(LIST_B)}) GROUP BY doc_id")
def hybrid_asymmetric_rrf(spark, sf_dir):
    """An identifier query trusts its first list."""
    found = rank.rrf([best(spark, sf_dir, LIST_A), best(spark, sf_dir, LIST_B)], "doc_id", rank.hybrid_constants(True))
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""WITH a AS MATERIALIZED (FROM {_best(LIST_A)}), b AS MATERIALIZED (FROM {_best(LIST_B)}), c AS MATERIALIZED (FROM {_best(LIST_C)}),
ab AS (SELECT doc_id, sum(1.0 / (60 + rank + 1)) AS score FROM (FROM a UNION ALL FROM b) GROUP BY doc_id), abr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM ab),
abc AS (SELECT doc_id, sum(1.0 / (60 + rank + 1)) AS score FROM (FROM abr UNION ALL FROM c) GROUP BY doc_id)
SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS INT) AS rank, round(score, 6) AS score FROM abc"""
)
def multi_query_progressive_rrf(spark, sf_dir):
    found = rank.progressive_rrf([best(spark, sf_dir, t) for t in (LIST_A, LIST_B, LIST_C)], "doc_id")
    return found.select("doc_id", "rank", F.round("score", 6).alias("score"))


#: Exact hits of a literal in line chunks, the results that the stages below work on.
RES = CHUNKS + ", res AS (SELECT chunk_id, file_path, line_start, line_end, content, CAST((length(content) - length(replace(content, 'the', ''))) / 3 AS DOUBLE) AS score FROM chunks WHERE contains(content, 'the'))"


def results(spark, sf_dir):
    found = chunks(spark, sf_dir).where(F.col("content").contains("the"))
    return found.select("chunk_id", "file_path", "line_start", "line_end", "content", X.occurrences(F.col("content"), "the").cast("double").alias("score"))


def edges(spark, sf_dir):
    """Each document calls the next three of its source, and every tenth."""
    own = files(spark, sf_dir).select("file_path", "doc_id", "source")
    n = own.select(F.col("doc_id").alias("n_id"), F.col("file_path").alias("dst"))
    hop = own.select(F.col("file_path").alias("src"), F.explode(F.array(*[F.col("doc_id") + d for d in (20, 40, 60)], F.floor(F.col("doc_id") / 10))).alias("n_id"))
    return hop.join(n, "n_id").where("src <> dst").select("src", "dst", F.lit("Calls").alias("kind"))


EDGES = """hop AS (SELECT file_path AS src, unnest([doc_id + 20, doc_id + 40, doc_id + 60, CAST(floor(doc_id / 10) AS BIGINT)]) AS n FROM files),
edges AS (SELECT DISTINCT src, f.file_path AS dst FROM hop JOIN files f ON f.doc_id = n WHERE src <> f.file_path)"""


def _out(df):
    return df.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {RES}, {EDGES}, c AS (SELECT dst, count(*) AS c FROM edges GROUP BY dst) SELECT chunk_id, round(score * CASE WHEN c > 3 THEN 1 + 0.05 * ln(c) ELSE 1 END, 6) AS score FROM res LEFT JOIN c ON dst = file_path")
def popularity_boost(spark, sf_dir):
    return _out(rank.popularity_boost(results(spark, sf_dir), edges(spark, sf_dir)))


@query(
    f"""WITH {RES}, {EDGES}, re AS (SELECT src, dst FROM edges), rn AS (SELECT src AS node FROM re UNION SELECT dst FROM re),
sd AS MATERIALIZED (SELECT file_path AS node, sum(score) AS w FROM (SELECT * FROM res ORDER BY score DESC, file_path, line_start LIMIT 5) WHERE file_path IN (FROM rn) GROUP BY file_path),
{rank_ctes(6, "coalesce((SELECT w FROM sd WHERE sd.node = rn.node), 0) / (SELECT sum(w) FROM sd)")}
SELECT chunk_id, round(score * (1 + 0.3 * coalesce(rank / (SELECT max(rank) FROM r6), 0)), 6) AS score FROM res LEFT JOIN r6 ON node = file_path"""
)
def personalized_graph_boost(spark, sf_dir):
    """Ranks personalised to the files of the five best results; six rounds."""
    return _out(rank.personalized_boost(results(spark, sf_dir), edges(spark, sf_dir), rounds=6, tolerance=0.0))


@query(f"WITH {RES}, {EDGES}, c AS (SELECT dst, count(*) / 10.0 AS c FROM edges GROUP BY dst) SELECT chunk_id, round(score * (1 + 0.3 * coalesce(c, 0)), 6) AS score FROM res LEFT JOIN c ON dst = file_path")
def graph_boost(spark, sf_dir):
    ranks = edges(spark, sf_dir).distinct().groupBy(F.col("dst").alias("node")).agg((F.count("*") / 10).alias("rank"))
    return _out(rank.graph_boost(results(spark, sf_dir), ranks))


@query(
    f"""WITH {RES}, e AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id), l AS (SELECT file_path, ts FROM files JOIN e ON user_id = doc_id)
SELECT chunk_id, round(score * coalesce(1 + 0.1 * greatest(0, 1 - date_diff('day', CAST(ts AS DATE), DATE '2024-06-01') / 180.0), 1), 6) AS score FROM res LEFT JOIN l USING (file_path)"""
)
def recency_boost(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "ts")
    own = files(spark, sf_dir)
    changed = own.join(e, own["doc_id"] == e["user_id"]).select("file_path", "ts")
    return _out(rank.recency_boost(results(spark, sf_dir), changed, F.lit("2024-06-01").cast("date")))


@query(
    f"""WITH {RES} SELECT chunk_id, round(score * CASE WHEN contains(file_path, 'src1/en') THEN 2.5 WHEN contains(lower(file_path), 'src15') OR len(list_filter(list_filter(regexp_split_to_array(lower(regexp_replace(file_path, '\\.[^./]*$', '')), '[/_-]+'), lambda x: x <> ''), lambda s: starts_with(s, 'src15'))) > 0 THEN 2 ELSE 1 END, 6) AS score FROM res"""
)
def path_match_boost(spark, sf_dir):
    return _out(rank.path_match_boost(results(spark, sf_dir), ["src1/en"], ["src15", "is"]))


@query(f"WITH {RES} SELECT chunk_id, round(score * CASE WHEN contains(file_path, '/de/') OR file_path LIKE '%/fr/%7.txt' THEN 0.5 ELSE 1 END, 6) AS score FROM res")
def conditional_demotion(spark, sf_dir):
    """Results of tests are halved; German files stand for those in a test folder, some French ones for those of a test's name."""
    path = F.regexp_replace(F.replace("file_path", F.lit("/de/"), F.lit("/tests/")), r"(/fr/.*7)\.txt$", "$1_test.txt")
    return _out(rank.test_demotion(results(spark, sf_dir).withColumn("file_path", path)))


@query(
    f"""WITH {RES}, o AS (SELECT *, lag(score) OVER w AS was, row_number() OVER w - 1 AS i, first(score) OVER w AS best FROM res WINDOW w AS (ORDER BY score DESC, file_path, line_start)),
c AS (SELECT min(i) AS cut FROM o WHERE i >= 3 AND (was - score) / best > 0.02) SELECT chunk_id, round(score, 6) AS score FROM o, c WHERE cut IS NULL OR i < cut"""
)
def adaptive_truncation(spark, sf_dir):
    return _out(rank.truncate_at_cliff(results(spark, sf_dir), 3, 0.02))


@query(
    f"""WITH {RES}, {EDGES}, b AS (SELECT file_path, max(score) AS s FROM (SELECT * FROM res ORDER BY score DESC, file_path, line_start LIMIT 5) GROUP BY file_path),
n AS (SELECT dst AS f, 0.25 * s AS score FROM b JOIN edges ON src = file_path UNION ALL SELECT src, 0.15 * s FROM b JOIN edges ON dst = file_path),
m AS (SELECT f, max(score) AS score FROM n WHERE f NOT IN (SELECT file_path FROM res) GROUP BY f ORDER BY score DESC, f LIMIT 3),
a AS (SELECT c.chunk_id, m.score FROM m JOIN chunks c ON c.file_path = f WHERE c.line_start = 0)
SELECT chunk_id, round(score, 6) AS score FROM (SELECT chunk_id, score FROM res UNION ALL FROM a)"""
)
def graph_propagation(spark, sf_dir):
    return _out(rank.propagate(results(spark, sf_dir), chunks(spark, sf_dir), edges(spark, sf_dir)))


SYMS = "sy AS (SELECT file_path, CAST(doc_id % 40 AS INT) AS line, CASE WHEN doc_id % 3 = 0 THEN 'function' ELSE 'const' END AS kind, 'n' || (doc_id % 5) AS name, CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM files)"


def symbols(spark, sf_dir):
    d = F.col("doc_id")
    return files(spark, sf_dir).select(
        "file_path", (d % 40).cast("int").alias("line"), F.when(d % 3 == 0, "function").otherwise("const").alias("kind"),
        F.concat(F.lit("n"), (d % 5).cast("string")).alias("name"), F.when(d % 2 == 0, "public").otherwise("private").alias("visibility"),
    )


@query(
    f"""WITH {RES}, {SYMS}, o AS (SELECT * FROM sy WHERE name IN ('n1', 'n2')), l AS (SELECT chunk_id, max(CASE WHEN kind = 'function' THEN 2 ELSE 1 END) AS lv FROM res JOIN o ON o.file_path = res.file_path AND line >= line_start AND line < line_end GROUP BY chunk_id),
p AS (SELECT DISTINCT file_path FROM o WHERE kind = 'function')
SELECT chunk_id, round(score * CASE WHEN lv = 2 THEN 12 WHEN lv = 1 THEN 6 WHEN file_path IN (FROM p) THEN 0.35 ELSE 1 END, 6) AS score FROM res LEFT JOIN l USING (chunk_id)"""
)
def definition_boost(spark, sf_dir):
    return _out(rank.definition_boost(results(spark, sf_dir), symbols(spark, sf_dir), ["N1", "n2"]))


@query(f"WITH {RES}, {SYMS} SELECT chunk_id, round(score * CASE WHEN file_path IN (SELECT file_path FROM sy WHERE name IN ('n1', 'n2')) THEN 3.5 ELSE 1 END, 6) AS score FROM res")
def first_pass_definition_boost(spark, sf_dir):
    return _out(rank.defining_files_boost(results(spark, sf_dir), symbols(spark, sf_dir), ["N1", "n2"]))


@query(
    f"WITH {RES}, {SYMS} SELECT chunk_id, round(score * CASE WHEN EXISTS (SELECT 1 FROM sy WHERE sy.file_path = res.file_path AND visibility = 'public' AND line >= line_start AND line < line_end) THEN 1.5 ELSE 1 END, 6) AS score FROM res"
)
def visibility_boost(spark, sf_dir):
    return _out(rank.visibility_boost(results(spark, sf_dir), symbols(spark, sf_dir)))


@query(
    f"""WITH {RES}, {SYMS}, h AS (SELECT file_path, kind AS cluster, count(*) AS h, max(line / 20.0) AS s FROM sy WHERE name IN ('n1', 'n2', 'n4') GROUP BY ALL),
b AS (SELECT file_path, max(least(0.3 * s * least(h, 5), 1.5)) AS b FROM h GROUP BY file_path) SELECT chunk_id, round(score * least(1 + coalesce(b, 0), 2.5), 6) AS score FROM res LEFT JOIN b USING (file_path)"""
)
def concept_boost(spark, sf_dir):
    clusters = symbols(spark, sf_dir).select("file_path", F.col("name").alias("term"), F.col("kind").alias("cluster"), (F.col("line") / 20).alias("score"))
    return _out(rank.concept_boost(results(spark, sf_dir), clusters, ["n1", "n2", "n4"]))


@query(
    f"""WITH {RES}, a AS (SELECT file_path, (doc_id % 4) / 10.0 AS x FROM files WHERE lang = 'en'), s AS (SELECT file_path, (doc_id % 3) / 2.0 AS y FROM files WHERE source <> 'src0')
SELECT chunk_id, round(score * (1 + least(0.3, coalesce(x, 0) + 0.2 * coalesce(y, 0))), 6) AS score FROM res LEFT JOIN a USING (file_path) LEFT JOIN s USING (file_path)"""
)
def session_boost(spark, sf_dir):
    own = files(spark, sf_dir)
    agent = own.where("lang = 'en'").select("file_path", (F.col("doc_id") % 4 / 10).alias("boost"))
    shared = own.where("source <> 'src0'").select("file_path", (F.col("doc_id") % 3 / 2).alias("boost"))
    return _out(rank.session_boost(results(spark, sf_dir), agent, shared))


@query(
    f"""WITH {RES}, g AS (SELECT *, CASE WHEN line_start <= max(line_end) OVER (PARTITION BY file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM res),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY line_start, line_end ROWS UNBOUNDED PRECEDING) AS band FROM g)
SELECT file_path, CAST(min(line_start) AS INT) AS line_start, CAST(max(line_end) AS INT) AS line_end, max(score) AS score, count(*) AS merged FROM b GROUP BY file_path, band"""
)
def band_merge(spark, sf_dir):
    return rank.band_merge(results(spark, sf_dir))


#: Each chunk of RES, and the same again shifted half-way down with a lower score: results that overlap.
TWICE = RES + """, tw AS (SELECT chunk_id, file_path, line_start, line_end, score FROM res UNION ALL SELECT chunk_id || '+', file_path, line_start + 18, line_end + 18, score - 0.5 FROM res),
q AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, line_start, chunk_id) AS n FROM tw)"""


def _fold_sql(keep: str) -> str:
    """A fold over the results of each file in rank order; kept is a list of what was kept, `keep` says whether q joins it."""
    return f"""WITH RECURSIVE {TWICE}, fold AS (
SELECT file_path, n, chunk_id, score, [{{'a': line_start, 'b': line_end, 's': score}}] AS kept, true AS stays FROM q WHERE n = 1
UNION ALL SELECT q.file_path, q.n, q.chunk_id, q.score, CASE WHEN {keep} THEN list_append(kept, {{'a': q.line_start, 'b': q.line_end, 's': q.score}}) ELSE kept END, {keep}
FROM fold JOIN q ON q.file_path = fold.file_path AND q.n = fold.n + 1) SELECT chunk_id, score FROM fold WHERE stays"""


def _twice(spark, sf_dir):
    own = results(spark, sf_dir).drop("content")
    moved = own.select(F.concat("chunk_id", F.lit("+")).alias("chunk_id"), "file_path", (F.col("line_start") + 18).alias("line_start"), (F.col("line_end") + 18).alias("line_end"), (F.col("score") - 0.5).alias("score"))
    return own.select(*moved.columns).unionByName(moved)


@query(_fold_sql("len(list_filter(kept, lambda k: q.line_start < k.b AND k.a < q.line_end)) = 0"))
def overlap_dedup(spark, sf_dir):
    return rank.overlap_dedup(_twice(spark, sf_dir)).select("chunk_id", "score")


@query(_fold_sql("(q.score >= 0.7 * kept[1].s AND len(list_filter(kept, lambda k: abs(q.line_start - k.a) < 50)) = 0)"))
def file_dedup(spark, sf_dir):
    return rank.file_dedup(_twice(spark, sf_dir)).select("chunk_id", "score")


@query(f"WITH {RES} SELECT chunk_id, md5('### ' || file_path || ':' || (line_start + 1) || '-' || line_end || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10)) AS digest FROM res")
def result_rendering(spark, sf_dir):
    return rank.render(results(spark, sf_dir)).select("chunk_id", F.md5("block").alias("digest"))


@query(
    f"""WITH {RES}, u AS (SELECT chunk_id, CAST(sum(ceil(strlen(content) / 4.0)) OVER (ORDER BY score DESC, file_path, line_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM res) SELECT * FROM u WHERE used <= 50000"""
)
def budget_packing(spark, sf_dir):
    found = results(spark, sf_dir).withColumn("cost", X.approx_tokens(F.col("content")))
    return rank.within_budget(found, "cost", 50000).select("chunk_id", "used")


@query(
    f"""WITH {CHUNKS}, r AS (SELECT source AS q, doc_id AS k, row_number() OVER (PARTITION BY source ORDER BY length(content) DESC, doc_id) - 1 AS rank FROM files),
w AS (SELECT source AS q, doc_id AS k FROM files JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT q, count(w.k) AS hits, min(rank) FILTER (w.k IS NOT NULL) AS first FROM (SELECT * FROM r WHERE rank < 10) r LEFT JOIN w USING (q, k) GROUP BY q), g AS (SELECT q, count(DISTINCT k) AS gold FROM w GROUP BY q)
SELECT q AS query_id, round(coalesce(hits, 0) / 10.0, 6) AS precision, round(coalesce(hits, 0) / gold, 6) AS recall, round(coalesce(1.0 / (first + 1), 0), 6) AS rr, coalesce(hits, 0) > 0 AS hit FROM g LEFT JOIN p USING (q)"""
)
def retrieval_metrics(spark, sf_dir):
    """Precision, recall, reciprocal rank and hit at 10, a query a source."""
    own = files(spark, sf_dir).select(F.col("source").alias("query_id"), F.col("doc_id").alias("key"), F.char_length("content").alias("score"))
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("key"))
    found = rank.precision_recall(rank.ranked(own, "query_id", "key"), own.join(good, "key").select("query_id", "key"), 10)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr")], "hit")
