"""Graph operators: suppliers call the parts they supply, parts the brands that they belong to; customers hang on nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import graph
from seine.queries import query
from seine.store import read_table

EDGES = """edges AS (
SELECT DISTINCT 's/' || l_suppkey AS src, 'p/' || l_partkey AS dst, 'Calls' AS kind FROM lineitem
UNION ALL SELECT 'p/' || p_partkey, 'b/' || p_brand, 'Resolved' FROM part
UNION ALL SELECT 'b/' || p_brand, 's/' || min(s_suppkey), 'DocumentedBy' FROM part, supplier GROUP BY p_brand
UNION ALL SELECT 's/' || s_suppkey, 'n/' || s_nationkey, 'Resolved' FROM supplier
UNION ALL SELECT 'n/' || n_nationkey, 'r/' || n_regionkey, 'Resolved' FROM nation
UNION ALL SELECT 'p/' || p_partkey, '__ext__:' || p_type, 'External' FROM part WHERE p_size < 5)"""
REAL = EDGES + ", re AS (SELECT DISTINCT src, dst FROM edges WHERE dst NOT LIKE '\\_\\_ext%' ESCAPE '\\'), rn AS (SELECT src AS node FROM re UNION SELECT dst FROM re)"


def edges(spark, sf_dir):
    t = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "nation")}
    s = lambda c: F.col(c).cast("string")
    pair = lambda df, a, b, k: df.select(a.alias("src"), b.alias("dst"), F.lit(k).alias("kind"))
    j = lambda p, c: F.concat(F.lit(p), s(c))
    first = t["supplier"].agg(F.min("s_suppkey").alias("s_suppkey"))
    used = t["lineitem"].select("l_suppkey", "l_partkey").distinct()
    brands = t["part"].select("p_brand").distinct().join(F.broadcast(first), F.lit(True))
    parts = [
        pair(used, j("s/", "l_suppkey"), j("p/", "l_partkey"), "Calls"),
        pair(t["part"], j("p/", "p_partkey"), j("b/", "p_brand"), "Resolved"),
        pair(brands, j("b/", "p_brand"), j("s/", "s_suppkey"), "DocumentedBy"),
        pair(t["supplier"], j("s/", "s_suppkey"), j("n/", "s_nationkey"), "Resolved"),
        pair(t["nation"], j("n/", "n_nationkey"), j("r/", "n_regionkey"), "Resolved"),
        pair(t["part"].where("p_size < 5"), j("p/", "p_partkey"), j("__ext__:", "p_type"), "External"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""WITH {EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT *, CASE kind WHEN 'Resolved' THEN 'Verified' WHEN 'Calls' THEN 'High' WHEN 'DocumentedBy' THEN 'Medium' ELSE 'Low' END AS conf FROM edges)
SELECT count(*) AS edges, count(*) FILTER (kind = 'Resolved') AS resolved_edges, count(*) FILTER (kind = 'Calls') AS calls_edges, count(*) FILTER (kind = 'DocumentedBy') AS documentedby_edges,
count(*) FILTER (kind = 'External') AS external_edges, count(*) FILTER (conf = 'Verified') AS verified_edges, count(*) FILTER (conf = 'High') AS high_edges, count(*) FILTER (conf = 'Medium') AS medium_edges,
count(*) FILTER (conf = 'Low') AS low_edges, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE starts_with(node, '__ext__:')) AS external_nodes FROM c"""
)
def graph_statistics(spark, sf_dir):
    return graph.statistics(edges(spark, sf_dir))


@query(
    f"""WITH {REAL} SELECT node, CAST(count(DISTINCT a.src) AS BIGINT) AS callers, CAST(count(DISTINCT b.dst) AS BIGINT) AS callees
FROM rn LEFT JOIN re a ON a.dst = node LEFT JOIN re b ON b.src = node GROUP BY node"""
)
def graph_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(f"WITH {REAL} SELECT DISTINCT src AS caller FROM re WHERE dst = 'n/3'")
def callers_of_file(spark, sf_dir):
    return graph.real(edges(spark, sf_dir)).where("dst = 'n/3'").select(F.col("src").alias("caller"))


@query(
    f"""WITH RECURSIVE {REAL}, walk AS (SELECT dst AS node, 1 AS depth FROM re WHERE src = 's/5' UNION SELECT re.dst, depth + 1 FROM walk JOIN re ON re.src = walk.node WHERE depth < 4)
SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node"""
)
def transitive_callees(spark, sf_dir):
    start = spark.createDataFrame([("s/5",)], "node string")
    return graph.reachable(edges(spark, sf_dir), start, 4)


@query(
    f"""WITH RECURSIVE {REAL}, walk AS (SELECT src AS node, 1 AS depth FROM re WHERE dst = 'n/3' UNION SELECT re.src, depth + 1 FROM walk JOIN re ON re.dst = walk.node WHERE depth < 3)
SELECT node, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS relation, CAST(min(depth) AS INT) AS depth FROM walk WHERE node <> 'n/3' GROUP BY node"""
)
def change_impact(spark, sf_dir):
    return graph.impact(edges(spark, sf_dir), "n/3", 3)


@query(
    f"""WITH RECURSIVE {REAL}, nb AS (SELECT src AS a, dst AS b FROM re UNION SELECT dst, src FROM re), walk AS (SELECT 'r/1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN nb ON a = node WHERE depth < 5)
SELECT node, CAST(min(depth) AS INT) AS steps FROM walk GROUP BY node"""
)
def shortest_path_lengths(spark, sf_dir):
    return graph.shortest_paths(edges(spark, sf_dir), "r/1", 5).select("node", (F.size("path") - 1).alias("steps"))


def rank_ctes(rounds: int, jump: str) -> str:
    """PageRank over re(src, dst) and rn(node) as one materialised CTE a round, ending in r<rounds>(node, rank)."""
    sql = f"""o AS MATERIALIZED (SELECT src, count(*) AS n FROM re GROUP BY src), lk AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / n AS share FROM re JOIN o USING (src)),
b AS MATERIALIZED (SELECT node, node NOT IN (SELECT src FROM o) AS dangling, CAST({jump} AS DOUBLE) AS jump FROM rn), r0 AS MATERIALIZED (SELECT node, jump AS rank FROM b)"""
    for i in range(rounds):
        sql += f""", f{i} AS MATERIALIZED (SELECT dst AS node, sum(rank * share) AS flow FROM r{i} JOIN lk ON src = node GROUP BY dst),
r{i + 1} AS MATERIALIZED (SELECT b.node, jump * (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} JOIN b USING (node) WHERE dangling)) + 0.85 * coalesce(flow, 0) AS rank FROM b LEFT JOIN f{i} USING (node))"""
    return sql


def pagerank_sql(rounds: int, seeds: str | None, tail: str) -> str:
    jump = "1.0 / (SELECT count(*) FROM rn)" if seeds is None else f"CASE WHEN node IN ({seeds}) THEN 1.0 / {seeds.count(',') + 1} ELSE 0 END"
    return f"WITH {REAL}, {rank_ctes(rounds, jump)}" + tail.format(r=f"r{rounds}")


@query(pagerank_sql(10, None, " SELECT node, round(rank / (SELECT max(rank) FROM {r}), 6) AS rank FROM {r}"))
def pagerank(spark, sf_dir):
    """Ten rounds, divided by the largest."""
    found = graph.pagerank(edges(spark, sf_dir), rounds=10, tolerance=0.0)
    return found.select("node", F.round("rank", 6).alias("rank"))


@query(pagerank_sql(8, "'s/5', 'n/3'", " SELECT node, round(rank, 6) AS rank FROM {r}"))
def personalized_pagerank(spark, sf_dir):
    seeds = spark.createDataFrame([("s/5", 1.0), ("n/3", 1.0)], "node string, weight double")
    found = graph.pagerank(edges(spark, sf_dir), seeds, rounds=8, tolerance=0.0, relative=False)
    return found.select("node", F.round("rank", 6).alias("rank"))


@query(
    f"""WITH {REAL}, c AS (SELECT node, node[1:1] AS community FROM rn), nb AS (SELECT src AS a, dst AS b FROM re UNION SELECT dst, src FROM re),
g AS (SELECT x.community AS ca, count(*) FILTER (x.community = y.community) AS i, count(*) AS d FROM nb JOIN c x ON x.node = a JOIN c y ON y.node = b GROUP BY ca)
SELECT round(sum(i) / sum(d) - sum(d::DOUBLE * d) / (sum(d)::DOUBLE * sum(d)), 6) AS modularity FROM g"""
)
def modularity_by_layer(spark, sf_dir):
    own = edges(spark, sf_dir)
    groups = graph.nodes_of(graph.real(own)).select("node", F.substring("node", 1, 1).alias("community"))
    return graph.modularity(own, groups).select(F.round("modularity", 6).alias("modularity"))


@query()
def louvain_communities(spark, sf_dir):
    """Sequential moves are beyond SQL; tests compare with a plain version."""
    return graph.louvain(edges(spark, sf_dir))


@query(
    f"""WITH {REAL}, d AS (SELECT node, count(*)::DOUBLE AS rank FROM (SELECT src AS node FROM re UNION ALL SELECT dst FROM re) GROUP BY node),
x AS (SELECT DISTINCT e.src, e.dst, e.kind, abs(ln(a.rank / b.rank)) AS ratio FROM edges e JOIN d a ON a.node = e.src JOIN d b ON b.node = e.dst WHERE NOT starts_with(e.dst, '__ext__:')),
y AS (SELECT src, dst, 0.3 * ratio / (SELECT max(ratio) FROM x) AS share, kind FROM x)
SELECT src, dst, round(CASE WHEN src[1:1] <> dst[1:1] THEN 0.3 ELSE 0 END + CASE WHEN share > 0.05 THEN share ELSE 0 END + CASE WHEN src[1:1] <> dst[1:1] THEN 0.2 ELSE 0 END + CASE kind WHEN 'DocumentedBy' THEN 0.1 ELSE 0 END, 6) AS score
FROM y ORDER BY score DESC, src, dst LIMIT 25"""
)
def surprising_edges(spark, sf_dir):
    own = edges(spark, sf_dir)
    ends = graph.real(own).select(F.explode(F.array("src", "dst")).alias("node"))
    ranks = ends.groupBy("node").agg(F.count("*").cast("double").alias("rank"))
    groups = ranks.select("node", F.substring("node", 1, 1).alias("community"))
    found = graph.surprise(own, ranks, groups).withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("score"), "src", "dst").limit(25)


@query(
    f"""WITH {EDGES}, d AS (SELECT dst AS node, count(*) / 100.0 AS rank FROM edges GROUP BY dst)
SELECT src, count(*) AS imports, round(sum(greatest(rank, 0.001)), 6) AS score, min(dst) AS first FROM edges JOIN d ON node = dst WHERE starts_with(src, 's/') AND starts_with(dst, 'n/') AND kind IN ('Resolved', 'External') GROUP BY src"""
)
def cross_imports(spark, sf_dir):
    own = edges(spark, sf_dir)
    ranks = own.groupBy(F.col("dst").alias("node")).agg((F.count("*") / 100).alias("rank"))
    found = graph.cross_imports(own, ranks, "s/", "n/")
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {EDGES} SELECT kind, count(*) AS n FROM edges WHERE src NOT LIKE 's/%' AND dst NOT LIKE 's/%' GROUP BY kind")
def node_removal(spark, sf_dir):
    own = edges(spark, sf_dir)
    gone = graph.nodes_of(own).where(F.col("node").startswith("s/"))
    return graph.without(own, gone).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {EDGES}, re AS (SELECT DISTINCT src, dst FROM edges WHERE kind <> 'DocumentedBy' AND NOT starts_with(dst, '__ext__:')), rn AS (SELECT src AS node FROM re UNION SELECT dst FROM re),
walk AS (SELECT node, 0 AS layer FROM rn WHERE node NOT IN (SELECT dst FROM re) UNION SELECT re.dst, layer + 1 FROM walk JOIN re ON re.src = walk.node)
SELECT node, CAST(max(layer) AS INT) AS layer FROM walk GROUP BY node"""
)
def topological_layers(spark, sf_dir):
    own = edges(spark, sf_dir)
    return graph.layers(own.where("kind <> 'DocumentedBy'"))


@query(
    f"""WITH {REAL}, changed AS (SELECT DISTINCT src AS node FROM re WHERE starts_with(src, 'n/')), d AS (SELECT * FROM re WHERE dst IN (FROM changed)), a AS (SELECT DISTINCT src FROM re WHERE dst IN (SELECT src FROM d)),
h AS (SELECT src AS node FROM d UNION ALL (SELECT src FROM d UNION SELECT src FROM a)) SELECT node, count(*) AS score FROM h WHERE node NOT IN (FROM changed) GROUP BY node"""
)
def predicted_impact(spark, sf_dir):
    own = edges(spark, sf_dir)
    changed = graph.real(own).where(F.col("src").startswith("n/")).select(F.col("src").alias("node")).distinct()
    return graph.predicted_impact(own, changed)


@query(
    f"""WITH {EDGES}, d AS (SELECT node, count(*)::DOUBLE AS rank FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)
SELECT 0 AS section, 'MERGE (n:File {{path: ''' || node || '''}}) SET n.pagerank = ' || format('{{:,.4f}}', rank) || ';' AS line FROM d
UNION ALL SELECT 1, 'MATCH (a:File {{path: ''' || src || '''}}), (b:File {{path: ''' || dst || '''}}) MERGE (a)-[:' || CASE kind WHEN 'Resolved' THEN 'IMPORTS' WHEN 'Calls' THEN 'CALLS' WHEN 'DocumentedBy' THEN 'DOCUMENTED_BY' ELSE 'EXTERNAL_DEP' END || ']->(b);' FROM edges"""
)
def cypher_export(spark, sf_dir):
    own = edges(spark, sf_dir)
    ranks = own.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").cast("double").alias("rank"))
    return graph.cypher(own, ranks)


@query(
    f"""WITH {EDGES} SELECT 0 AS section, '<node id="' || node || '"/>' AS line FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
UNION ALL SELECT 1, '<edge source="' || src || '" target="' || dst || '"><data key="kind">' || kind || '</data></edge>' FROM edges"""
)
def graphml_export(spark, sf_dir):
    return graph.graphml(edges(spark, sf_dir))


@query(
    f"""WITH {REAL}, d AS (SELECT node, count(*) AS rank FROM (SELECT src AS node FROM re UNION ALL SELECT dst FROM re) GROUP BY node), best AS (SELECT node FROM d ORDER BY rank DESC, node LIMIT 20),
t AS (SELECT src AS node, list_sort(list(dst)) AS targets FROM re WHERE src IN (FROM best) AND dst IN (FROM best) GROUP BY src)
SELECT node, CAST(coalesce(len(targets), 0) AS INT) AS targets FROM best LEFT JOIN t USING (node)"""
)
def graph_snapshot(spark, sf_dir):
    own = edges(spark, sf_dir)
    ranks = graph.real(own).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("rank"))
    found = graph.snapshot(own, ranks, 20)
    return found.select("node", F.size(F.from_json("json", "node string, targets array<string>")["targets"]).alias("targets"))


@query(
    f"""WITH {REAL}, d AS (SELECT node, count(*) AS rank FROM (SELECT src AS node FROM re UNION ALL SELECT dst FROM re) GROUP BY node),
u AS (SELECT node, CAST(sum(length(node) * 10) OVER (ORDER BY rank DESC, node ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM d) SELECT * FROM u WHERE used <= 1000"""
)
def repo_map(spark, sf_dir):
    own = edges(spark, sf_dir)
    ranks = graph.real(own).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("rank"))
    return graph.repo_map(ranks, ranks.select("node", (10 * F.char_length("node")).alias("tokens")), 1000).select("node", "used")


@query(f"WITH {REAL}, nb AS (SELECT src AS a, dst AS b FROM re WHERE src <> dst UNION SELECT dst, src FROM re WHERE src <> dst) SELECT a AS node, count(*) AS n, min(b) AS first FROM nb GROUP BY a")
def file_neighbours(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("first"))


@query(
    """WITH l AS (SELECT page_id, url AS src, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS raw FROM pages), k AS (SELECT url FROM pages)
SELECT src, CASE WHEN raw IN (FROM k) THEN raw ELSE '__ext__:' || raw END AS dst, CASE WHEN raw IN (FROM k) THEN 'Resolved' ELSE 'External' END AS kind FROM l"""
)
def link_graph(spark, sf_dir):
    """Links between pages; targets that are no page become external nodes."""
    pages = read_table(spark, sf_dir, "pages")
    links = pages.select(F.col("url").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("raw"))
    known = pages.select(F.col("url").alias("raw"), F.lit(True).alias("known")).distinct()
    ok = F.col("known").isNotNull()
    return links.join(known, "raw", "left").select(
        "src", F.when(ok, F.col("raw")).otherwise(F.concat(F.lit(graph.EXTERNAL), "raw")).alias("dst"), F.when(ok, "Resolved").otherwise("External").alias("kind")
    )
