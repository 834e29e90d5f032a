"""Commits (orders), sessions (events), snapshots, symbols and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import concepts, history, symbols
from seine.queries import query
from seine.queries.ranking import EDGES as DOC_EDGES
from seine.queries.ranking import edges as doc_edges
from seine.queries.text import FILES, files
from seine.store import read_table

COMMITS = """commits AS (SELECT o_orderkey AS commit, o_custkey % 50 AS author, o_orderdate AS ts, o_orderpriority || ' order ' || o_orderstatus AS subject, 'p/' || l_partkey % 300 AS file_path FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def commits(spark, sf_dir):
    o, li = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(
        F.col("o_orderkey").alias("commit"), (F.col("o_custkey") % 50).alias("author"), F.col("o_orderdate").alias("ts"),
        F.concat("o_orderpriority", F.lit(" order "), "o_orderstatus").alias("subject"), F.concat(F.lit("p/"), (F.col("l_partkey") % 300).cast("string")).alias("file_path"),
    )


@query(f"WITH {COMMITS} SELECT file_path, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, round(count(DISTINCT commit) / (SELECT count(DISTINCT commit) FROM commits) + 0.1 * ln(count(DISTINCT author)), 6) AS score FROM commits GROUP BY file_path")
def hotspots(spark, sf_dir):
    return history.hotspots(commits(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {COMMITS} SELECT file_path, count(DISTINCT commit) AS commits, array_to_string(list_sort(list(DISTINCT author)), ' ') AS authors FROM commits GROUP BY file_path")
def change_frequency(spark, sf_dir):
    return history.change_frequency(commits(spark, sf_dir)).withColumn("authors", F.array_join("authors", " "))


@query(f"WITH {COMMITS}, b AS (SELECT DISTINCT commit, ts, author, subject FROM commits WHERE contains(lower(subject), 'urgent') ORDER BY ts DESC, commit LIMIT 20) SELECT b.commit, b.author, b.subject, array_to_string(list_sort(list(DISTINCT file_path)), ' ') AS files FROM b JOIN commits USING (commit) GROUP BY ALL")
def change_search(spark, sf_dir):
    found = history.search_changes(commits(spark, sf_dir), "URGENT", 20)
    return found.select("commit", "author", "subject", F.array_join("files", " ").alias("files"))


@query(f"WITH {COMMITS} SELECT DISTINCT ON (file_path) file_path, author FROM commits ORDER BY file_path, ts DESC, commit DESC")
def blame_last_author(spark, sf_dir):
    return history.last_authors(commits(spark, sf_dir)).select("file_path", "author")


@query(
    f"""WITH {COMMITS}, fl AS (SELECT DISTINCT file_path FROM commits), n AS (SELECT CAST(max(ts) AS DATE) AS now FROM commits), l AS (SELECT file_path, max(ts) AS ts FROM commits GROUP BY file_path),
a AS (SELECT fl.file_path, coalesce(CASE WHEN date_diff('day', CAST(ts AS DATE), now) <= 180 THEN date_diff('day', CAST(ts AS DATE), now) END, 0) AS age, CAST(fl.file_path[3:] AS INT) % 3 AS callers FROM fl JOIN l USING (file_path), n)
SELECT file_path, CAST(age AS INT) AS age, CASE WHEN callers = 0 AND age >= 21 THEN 'critical' WHEN age >= 21 THEN 'warning' WHEN callers = 0 THEN 'info' ELSE 'fresh' END AS level FROM a"""
)
def freshness_audit(spark, sf_dir):
    own = commits(spark, sf_dir)
    fl = own.select("file_path").distinct()
    now = F.lit(own.agg(F.max("ts").cast("date")).first()[0])
    callers = fl.select("file_path", (F.substring("file_path", 3, 9).cast("int") % 3).alias("callers"))
    return history.freshness(fl, own, callers, now)


@query(f"WITH {FILES}, {DOC_EDGES}, w AS (SELECT DISTINCT 'doc_' || (doc_id * 3) AS word FROM documents) SELECT file_path, CASE WHEN regexp_replace(split_part(file_path, '/', 3), '\\.[^.]*$', '') IN (FROM w) THEN 'high' ELSE 'certain' END AS confidence FROM files WHERE file_path NOT IN (SELECT dst FROM edges)")
def orphan_files(spark, sf_dir):
    usage = files(spark, sf_dir).select(F.concat(F.lit("doc_"), (F.col("doc_id") * 3).cast("string")).alias("word"))
    return history.orphans(files(spark, sf_dir), doc_edges(spark, sf_dir), usage)


#: Two snapshots of the documents: in between, German files went, Spanish ones came, and some sources were changed or touched.
_NOW = "now AS (SELECT doc_id AS file_path, n_chars AS size, length(source) AS mtime, md5(text) AS hash FROM documents WHERE lang <> 'es'), old AS (SELECT doc_id AS file_path, n_chars + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS size, length(source) + CASE WHEN source IN ('src6', 'src7') THEN 1 ELSE 0 END AS mtime, md5(text || CASE WHEN source = 'src7' THEN 'x' ELSE '' END) AS hash FROM documents WHERE lang <> 'de')"


def _snapshots(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    source = F.col("source")
    now = d.where("lang <> 'es'").select(F.col("doc_id").alias("file_path"), F.col("n_chars").alias("size"), F.char_length(source).cast("long").alias("mtime"), F.md5("text").alias("hash"))
    old = d.where("lang <> 'de'").select(
        F.col("doc_id").alias("file_path"), (F.col("n_chars") + F.when(source == "src5", 1).otherwise(0)).alias("size"),
        (F.char_length(source) + F.when(source.isin("src6", "src7"), 1).otherwise(0)).cast("long").alias("mtime"), F.md5(F.concat("text", F.when(source == "src7", "x").otherwise(""))).alias("hash"),
    )
    return now, old


@query(f"WITH {_NOW} SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM now n FULL JOIN old o ON n.file_path = o.file_path WHERE o.file_path IS NULL OR n.file_path IS NULL OR n.mtime <> o.mtime OR n.size <> o.size")
def staleness_check(spark, sf_dir):
    return history.staleness(*_snapshots(spark, sf_dir))


_SYNC = f"{_NOW}, ch AS (SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed' WHEN n.mtime = o.mtime AND n.size = o.size THEN 'unchanged' WHEN n.hash = o.hash THEN 'touched' ELSE 'modified' END AS change FROM now n FULL JOIN old o ON n.file_path = o.file_path)"


@query(f"WITH {_SYNC} FROM ch")
def sync_changes(spark, sf_dir):
    return history.sync(*_snapshots(spark, sf_dir))


@query(f"WITH {_SYNC} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM ch WHERE change <> 'unchanged') UNION ALL SELECT * FROM now WHERE file_path IN (SELECT file_path FROM ch WHERE change IN ('added', 'modified'))")
def apply_changes(spark, sf_dir):
    now, old = _snapshots(spark, sf_dir)
    return history.apply_changes(old, history.sync(now, old), now)


KINDS = "CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'lookup' WHEN 'click' THEN 'navigate' ELSE 'search' END"
EV = f"ev AS (SELECT ts, {KINDS} AS kind, 'd' || user_id % 7 || '/u' || user_id AS file_path, event_id AS seq, user_id % 10 AS agent_id FROM events), clock AS (SELECT max(ts) AS now FROM events)"


def events(spark, sf_dir):
    kind = F.expr(KINDS)
    u = F.col("user_id")
    return read_table(spark, sf_dir, "events").select(
        "ts", kind.alias("kind"), F.concat(F.lit("d"), (u % 7).cast("string"), F.lit("/u"), u.cast("string")).alias("file_path"), F.col("event_id").alias("seq"), (u % 10).alias("agent_id")
    )


def _clock(spark, sf_dir):
    return F.lit(read_table(spark, sf_dir, "events").agg(F.max("ts")).first()[0])


_AGE = "date_diff('microsecond', ts, now) / 60e6"


@query(f"WITH {EV}, l AS (SELECT *, {_AGE} AS age FROM (SELECT * FROM ev ORDER BY ts DESC, seq DESC LIMIT 1000), clock) SELECT file_path, round(sum(CASE kind WHEN 'search' THEN 0.08 WHEN 'read' THEN 0.12 WHEN 'write' THEN 0.2 WHEN 'lookup' THEN 0.1 ELSE 0.06 END * exp(-age / 15)), 6) AS boost FROM l WHERE age BETWEEN 0 AND 45 GROUP BY file_path")
def shared_session_boosts(spark, sf_dir):
    found = history.shared_boosts(events(spark, sf_dir), _clock(spark, sf_dir))
    return found.withColumn("boost", F.round("boost", 6))


@query(f"WITH {EV} SELECT agent_id, count(*) AS events FROM ev, clock WHERE {_AGE} BETWEEN 0 AND 600 GROUP BY agent_id")
def active_agents(spark, sf_dir):
    return history.active_agents(events(spark, sf_dir), _clock(spark, sf_dir), 600).select("agent_id", "events")


@query(f"WITH {EV}, a AS (SELECT *, {_AGE} * 60 AS age FROM ev, clock), w AS (SELECT file_path, greatest(0, 1 - age / 600) * CASE WHEN kind = 'read' AND age <= 300 THEN 0.15 WHEN kind = 'write' AND age <= 300 THEN 0.25 WHEN kind = 'lookup' AND age <= 600 THEN 0.1 END AS w FROM a WHERE age >= 0) SELECT file_path, round(sum(w), 6) AS boost FROM w WHERE w > 0 GROUP BY file_path")
def session_boosts(spark, sf_dir):
    return history.session_boosts(events(spark, sf_dir), _clock(spark, sf_dir)).withColumn("boost", F.round("boost", 6))


@query(f"WITH {EV} SELECT regexp_replace(file_path, '/[^/]*$', '') AS folder, count(*) AS events, count(DISTINCT CASE WHEN kind = 'read' THEN file_path END) AS read, count(DISTINCT CASE WHEN kind = 'write' THEN file_path END) AS edited FROM ev GROUP BY folder")
def session_summary(spark, sf_dir):
    return history.session_summary(events(spark, sf_dir)).drop("last")


@query(f"WITH {EV}, n AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY file_path ORDER BY ts, seq)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS burst FROM n) SELECT DISTINCT ON (file_path, burst) file_path AS path, kind FROM b ORDER BY file_path, burst, ts DESC, seq DESC")
def watch_debounce(spark, sf_dir):
    return history.debounce(events(spark, sf_dir).withColumnRenamed("file_path", "path"), 3600).select("path", "kind")


@query(f"WITH {EV}, s AS (SELECT file_path AS key, kind AS value, ts, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, kind DESC) AS rn FROM ev) SELECT key, value FROM s WHERE rn = 1 AND contains(value, 'ea')")
def memory_store(spark, sf_dir):
    """Keyed upserts of two halves, then recall by word."""
    rows = events(spark, sf_dir).select(F.col("file_path").alias("key"), F.col("kind").alias("value"), F.array(F.lit("t")).alias("tags"), "ts", "seq")
    store = history.upsert_memory(rows.where("value = 'read'"), rows.where("value <> 'read'"))
    return history.recall_memory(store, "EA", ["t"]).select("key", "value")


SY = """sy AS (SELECT replace(replace(p_name, ' ', '_'), '-', '_') AS name, CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'const' ELSE 'import' END AS kind, 'src/' || p_brand || '.rs' AS file_path, p_partkey AS line, CASE WHEN p_partkey % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM part)"""


def syms(spark, sf_dir):
    k = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        F.replace(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")).alias("name"),
        F.when(k % 4 == 0, "function").when(k % 4 == 1, "struct").when(k % 4 == 2, "const").otherwise("import").alias("kind"),
        F.concat(F.lit("src/"), "p_brand", F.lit(".rs")).alias("file_path"), k.alias("line"), F.when(k % 2 == 0, "public").otherwise("private").alias("visibility"),
    )


@query(f"WITH {SY} SELECT * FROM sy WHERE contains(lower(name), 'part') AND contains(file_path, '#1')")
def symbol_filter(spark, sf_dir):
    return symbols.find(syms(spark, sf_dir), "PART", "#1")


@query(f"WITH {SY} SELECT * FROM sy WHERE starts_with(lower(name), 'pa')")
def symbol_prefix(spark, sf_dir):
    return symbols.prefix(syms(spark, sf_dir), "Pa")


@query(f"WITH {SY} SELECT file_path, name, line FROM sy WHERE visibility = 'public' AND file_path = 'src/Brand#11.rs'")
def api_surface(spark, sf_dir):
    return symbols.api_surface(syms(spark, sf_dir), "src/Brand#11.rs").select("file_path", "name", "line")


@query(f"WITH {SY} SELECT name, kind, line, CAST(row_number() OVER (ORDER BY line) - 1 AS INT) AS position FROM sy WHERE file_path = 'src/Brand#11.rs'")
def outline(spark, sf_dir):
    return symbols.outline(syms(spark, sf_dir), "src/Brand#11.rs").select("name", "kind", "line", "position")


@query(f"WITH {SY} SELECT * FROM sy WHERE kind <> 'import' UNION ALL SELECT name, kind, 'new/' || file_path, line, visibility FROM sy WHERE kind = 'import' AND visibility = 'private'")
def symbol_overlay(spark, sf_dir):
    own = syms(spark, sf_dir)
    gone = own.where("kind = 'import'").select("file_path", "line")
    new = own.where("kind = 'import' and visibility = 'private'").withColumn("file_path", F.concat(F.lit("new/"), "file_path"))
    return symbols.overlay(own, gone, new, ["file_path", "line"])


@query(f"WITH {SY}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY CASE kind WHEN 'struct' THEN 0 WHEN 'function' THEN 1 WHEN 'const' THEN 2 ELSE 9 END, file_path, line) AS rn FROM sy WHERE kind <> 'import') SELECT lower(name) AS name, file_path, line FROM r WHERE rn = 1")
def goto_definition(spark, sf_dir):
    return symbols.definitions(syms(spark, sf_dir))


PARTS = "pt AS (SELECT name, file_path, unnest(list_distinct(list_filter(string_split(lower(name), '_'), lambda x: length(x) >= 2))) AS term FROM sy)"


@query(
    f"""WITH {SY}, {PARTS}, c AS (SELECT term, name, row_number() OVER (PARTITION BY term ORDER BY name) AS rn FROM (SELECT DISTINCT term, name FROM pt)),
g AS (SELECT term, string_agg(name, ' ' ORDER BY name) FILTER (rn <= 32) AS names, least(count(*), 32) AS size FROM c GROUP BY term HAVING count(*) >= 2),
d AS (SELECT min(term) AS term, names, max(size) AS size FROM g GROUP BY names) SELECT term, md5(names) AS names, CAST(size AS BIGINT) AS size, round(size / (SELECT count(DISTINCT name) FROM sy), 6) AS score FROM d"""
)
def concept_index(spark, sf_dir):
    found = concepts.clusters(syms(spark, sf_dir))
    return found.select("term", F.md5(F.array_join("names", " ")).alias("names"), F.col("size").cast("long").alias("size"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {SY}, {PARTS}, n AS (SELECT file_path, term, count(*) AS n FROM pt WHERE length(term) >= 3 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, length(term) DESC, term) AS rn FROM n),
p AS (SELECT a.term, b.term AS expansion, count(*) AS n FROM t a JOIN t b ON a.file_path = b.file_path AND a.term <> b.term WHERE a.rn <= 32 AND b.rn <= 32 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY term ORDER BY n DESC, length(expansion) DESC, expansion) - 1 AS INT) AS rank FROM p) SELECT term, expansion, n, rank FROM r WHERE rank < 12"""
)
def term_cooccurrence(spark, sf_dir):
    return concepts.cooccurrence(syms(spark, sf_dir))


@query(f"WITH {SY}, {PARTS}, g AS (SELECT term, list_sort(list(DISTINCT name)) AS names FROM pt GROUP BY term) SELECT term, array_to_string(names[1:8], ' ') AS names FROM g WHERE len(names) <= 20")
def doc_to_code_bridge(spark, sf_dir):
    return concepts.bridge(syms(spark, sf_dir)).select("term", F.array_join("names", " ").alias("names"))


@query(
    """WITH c AS (SELECT conv_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS term, role FROM conversations), q AS (SELECT conv_id, term FROM c WHERE role = 'user' AND length(term) >= 3), v AS (SELECT conv_id, term AS word FROM c WHERE role = 'system' AND length(term) >= 3),
p AS (SELECT term, word, count(*) AS n, count(DISTINCT conv_id) AS sessions FROM q JOIN v USING (conv_id) WHERE term <> word GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT conv_id) >= 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY term ORDER BY n DESC, word) - 1 AS INT) AS rank FROM p) SELECT * FROM r WHERE rank < 12"""
)
def session_mining(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("term")).where(F.char_length("term") >= 3)
    return concepts.mine_sessions(c.where("role = 'user'").select("conv_id", "term"), c.where("role = 'system'").select("conv_id", F.col("term").alias("word")))


@query(
    f"""WITH {SY}, s AS (SELECT name, list_distinct(string_split(lower(name), '_')) AS w FROM sy WHERE kind = 'function'), q AS (SELECT ['part', 'blue', 'red'] AS q)
SELECT name, round(len(list_intersect(w, q)) / len(list_distinct(list_concat(w, q))), 6) AS score FROM s, q WHERE len(list_intersect(w, q)) > 0"""
)
def semantic_search(spark, sf_dir):
    found = concepts.semantic(syms(spark, sf_dir).where("kind = 'function'"), ["part", "blue", "red"])
    return found.select("name", F.round("score", 6).alias("score"))
