"""Vector search over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators import rank, vectors
from seine.queries import query
from seine.store import read_table

DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"


def base(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


_COS = f"{DOT.format('a.embedding', 'b.embedding')} / (sqrt({DOT.format('a.embedding', 'a.embedding')}) * sqrt({DOT.format('b.embedding', 'b.embedding')}))"


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS INT) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank < 10"""
)
def batch_vector_search(spark, sf_dir):
    """Every vector whose id is divisible by 50 against all vectors."""
    own = base(spark, sf_dir)
    return vectors.top_k(own, own.where("vec_id % 50 = 0"), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 AND b.label = 1 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def filtered_vector_search(spark, sf_dir):
    """Top 10 among one label."""
    own = base(spark, sf_dir)
    found = vectors.top_k(own.where("label = 1"), own.where("vec_id = 7"), 10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""SELECT b.vec_id, round({DOT.format('a.embedding', 'b.embedding')}, 6) AS dot, round({_COS}, 6) AS cosine,
round(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]))), 6) AS l2 FROM embeddings a, embeddings b WHERE a.vec_id = 3"""
)
def distances(spark, sf_dir):
    own = base(spark, sf_dir)
    one = own.where("vec_id = 3").select(F.col("vector").alias("q")).limit(1)
    v, q = F.col("vector"), F.col("q")
    return own.join(F.broadcast(one), F.lit(True)).select(
        "vec_id", F.round(X.dot(q, v), 6).alias("dot"), F.round(X.cosine(q, v), 6).alias("cosine"), F.round(X.squared_distance(q, v), 6).alias("l2")
    )


def _mmr_sql(steps: int) -> str:
    """A CTE a step: n<i> has the candidates left with their nearness to what was picked, p<i> the pick."""
    sql = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, {_COS} AS rel FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
n0 AS MATERIALIZED (SELECT query_id, key, rel, o, 0.0::DOUBLE AS near FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, key) AS o FROM s) WHERE o <= 30)"""
    for i in range(steps):
        sql += f""", p{i} AS MATERIALIZED (SELECT query_id, key FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * near, 12) DESC, o DESC) AS r FROM n{i}) WHERE r = 1),
n{i + 1} AS MATERIALIZED (SELECT n.query_id, n.key, n.rel, n.o, greatest(near, {_COS}) AS near FROM n{i} n JOIN p{i} p ON n.query_id = p.query_id AND n.key <> p.key JOIN embeddings a ON a.vec_id = n.key JOIN embeddings b ON b.vec_id = p.key)"""
    return sql + " " + " UNION ALL ".join(f"SELECT query_id, key, CAST({i} AS BIGINT) AS step FROM p{i}" for i in range(steps))


@query(_mmr_sql(5))
def mmr_selection(spark, sf_dir):
    """Five diverse neighbours of thirty candidates a query."""
    own = base(spark, sf_dir)
    near = vectors.top_k(own, own.where("vec_id % 50 = 0"), 30)
    found = near.join(own.select("vec_id", "vector"), "vec_id")
    return rank.mmr(found.select("query_id", F.col("vec_id").alias("key"), F.col("score").alias("relevance"), "vector"), 5)


@query()
def product_quantization(spark, sf_dir):
    codes, _ = vectors.product_codes(base(spark, sf_dir))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"))


_L2 = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])))"


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_L2} AS far FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY far, vec_id) - 1 AS INT) AS rank FROM s) SELECT query_id, vec_id, rank FROM r WHERE rank < 10"""
)
def quantized_search(spark, sf_dir):
    """Ten nearest by codes, verified to be exact, for each vector divisible by 50."""
    own = base(spark, sf_dir)
    codes, book = vectors.product_codes(own)
    return vectors.quantized_top_k(codes, book, own, own.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "rank")


@query()
def approximate_vector_search(spark, sf_dir):
    """Ten nearest by cosine among the probed cells, for each vector divisible by 50."""
    own = base(spark, sf_dir)
    index, centres = vectors.cell_index(own)
    found = vectors.approximate_top_k(index, centres, own.where("vec_id % 50 = 0"), 10)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_SIGNS = "list_reduce(list_transform(embedding[1:12], lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), lambda x, y: x || y)"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding, {_SIGNS} AS bucket FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b USING (bucket) WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.82),
w AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT w.x, l.y FROM w JOIN l ON l.x = w.y) SELECT x AS vec_id, min(y) AS cluster FROM w GROUP BY x"""
)
def embedding_cluster_merge(spark, sf_dir):
    return vectors.sign_bucket_merge(base(spark, sf_dir))


@query(
    """WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS w FROM benchmark),
h AS (SELECT item_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM w), p AS (SELECT item_id, (h // 2) % 64 AS place, sum(1 - 2 * (h % 2)) AS v FROM h GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM p GROUP BY item_id) SELECT item_id, CAST(place AS INT) AS place, round(v / n, 6) AS value FROM p JOIN n USING (item_id) WHERE v <> 0"""
)
def hashed_embeddings(spark, sf_dir):
    """The default embedder over the benchmark items: the places that are not zero."""
    found = vectors.embed(read_table(spark, sf_dir, "benchmark"), "item_id", "text", lambda t: vectors.hashed_embedding(t, 64))
    return found.select("item_id", F.posexplode("vector").alias("place", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query(
    """WITH c AS (SELECT doc_id, md5(text) AS digest FROM documents), d AS (SELECT DISTINCT md5(text) AS digest FROM documents WHERE doc_id < 100)
SELECT doc_id, CASE WHEN digest IN (FROM d) THEN 'reused' ELSE 'pending' END AS state FROM c"""
)
def embed_queue(spark, sf_dir):
    """What is to be embedded, and what reuses the vector of an equal text among the first hundred documents."""
    chunks = read_table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.col("text").alias("content"))
    done = vectors.embed(chunks.where("doc_id < 100"), "digest", "content").dropDuplicates(["digest"])
    todo, known = vectors.pending(chunks, done, "doc_id")
    return todo.select("doc_id", F.lit("pending").alias("state")).unionByName(known.select("doc_id", F.lit("reused").alias("state")))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def unembedded_chunks(spark, sf_dir):
    """Ids of one table without an entry in another: the queue of what is still to be embedded."""
    done = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return base(spark, sf_dir).join(done, "vec_id", "left_anti").select("vec_id")
