"""Text functions, corpus tables and line transforms over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators import corpus, retrieve
from seine.queries import query
from seine.store import read_table

FILES = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path, text AS content, source, lang, doc_id FROM documents)"
CHUNKS = (
    FILES
    + """, fl AS (SELECT file_path, string_split(content, chr(10)) AS lines FROM files),
fs AS (SELECT file_path, lines, unnest(range(0, len(lines), 37)) AS line_start FROM fl),
chunks AS (SELECT md5(file_path || ':' || line_start) AS chunk_id, file_path, line_start, least(line_start + 37, len(lines)) AS line_end,
           array_to_string(lines[line_start + 1:line_start + 37], chr(10)) AS content FROM fs)"""
)
TOKENS = r"""list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_.]+'), lambda w: true)"""


def camel_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(\p{{Ll}}|\p{{N}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"


def parts_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({camel_sql(x)}), '[ ._]+'), lambda x: x <> '')"


#: SQL that lists the code tokens of table t(id, body) as toks(id, token).
def tokens_sql(table: str, key: str, body: str) -> str:
    return rf"""w_{table} AS (SELECT {key}, unnest(regexp_extract_all({body}, '[\p{{L}}\p{{N}}_.]+')) AS word FROM {table}),
p_{table} AS (SELECT {key}, word, {parts_sql('word')} AS parts FROM w_{table}),
t_{table} AS (SELECT {key}, unnest(CASE WHEN len(parts) > 1 THEN list_distinct(list_append(parts, lower(word))) ELSE parts END) AS token FROM p_{table})"""


def files(spark, sf_dir):
    return corpus.files_of(read_table(spark, sf_dir, "documents"))


def chunks(spark, sf_dir):
    return corpus.line_chunks(files(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT chunk_id, file_path, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, md5(content) AS digest FROM chunks")
def line_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "file_path", "line_start", "line_end", F.md5("content").alias("digest"))


@query(
    f"""WITH {CHUNKS}, n AS (SELECT file_path, line_start, content, lead(content) OVER (PARTITION BY file_path ORDER BY line_start) AS nxt FROM chunks),
h AS (SELECT *, CAST(floor((length(content) + length(nxt)) / 2.0 * 0.25 / 2) AS INT) AS half FROM n WHERE nxt IS NOT NULL),
b AS (SELECT file_path, line_start, right(content, half) || chr(10) || left(nxt, half) AS bridge FROM h)
SELECT file_path, CAST(line_start AS INT) AS line_start, md5(bridge) AS digest FROM b
WHERE strlen(regexp_replace(bridge, '[ \\t\\n\\r\\f]', '', 'g')) BETWEEN 200 AND 1500"""
)
def bridge_chunks(spark, sf_dir):
    return corpus.bridge_chunks(chunks(spark, sf_dir)).select("file_path", "line_start", F.md5("bridge").alias("digest"))


@query(
    f"""WITH {FILES}, x AS (SELECT 'plaintext' AS language, regexp_extract(file_path, '\\.([^./]+)$', 1) AS extension, strlen(content) AS bytes FROM files)
SELECT language, extension, count(*) AS file_count, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM x GROUP BY GROUPING SETS ((language), (extension), ())"""
)
def source_inventory(spark, sf_dir):
    return corpus.inventory(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT file_path, md5(array_to_string(string_split(content, chr(10))[3:6], chr(10))) AS digest FROM files")
def read_file_range(spark, sf_dir):
    return corpus.file_range(files(spark, sf_dir), 2, 5).select("file_path", F.md5("content").alias("digest"))


@query(f"WITH {CHUNKS} SELECT file_path, count(*) AS chunk_count FROM chunks GROUP BY file_path")
def list_indexed_files(spark, sf_dir):
    return retrieve.indexed_files(chunks(spark, sf_dir))


@query(f"WITH {FILES} SELECT file_path, CAST(strlen(regexp_replace(content, '[ \\t\\n\\r\\f]', '', 'g')) AS BIGINT) AS ink, CAST(ceil(strlen(content) / 4.0) AS BIGINT) AS tokens FROM files")
def text_sizes(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", X.ink(F.col("content")).alias("ink"), X.approx_tokens(F.col("content")).alias("tokens"))


@query(f"WITH {FILES} SELECT file_path FROM files WHERE file_path LIKE '%/en/%' AND regexp_matches(file_path, '^src1[^/]*/en/[^/]*[05]\\.txt$') ORDER BY file_path LIMIT 100")
def list_files_by_glob(spark, sf_dir):
    """A listing of 100 is the feature."""
    return retrieve.list_files(files(spark, sf_dir), "src1*/en/*[05].txt", 100)


@query(f"WITH {FILES}, {tokens_sql('files', 'doc_id', 'content')} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t_files GROUP BY token")
def code_tokenizer(spark, sf_dir):
    """How often and in how many documents each token stands, counted in runs of whole documents."""
    found = retrieve.term_counts(files(spark, sf_dir), "doc_id", {"content": X.code_words(F.col("content"))}, X.word_tokens)
    return found.select(F.col("term").alias("token"), F.col("cf").alias("n"), F.col("df").alias("docs"))


NAMES = "names AS (SELECT p_partkey, p_type || '_' || p_name AS name FROM part)"
NAMES_CAMEL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"


def _names(spark, sf_dir):
    """Identifiers out of parts: type_Name Words."""
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")
    return read_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("_"), camel).alias("name"))


_NAMES_SQL = f"names AS (SELECT p_partkey, replace(lower(p_type), ' ', '_') || '_' || {NAMES_CAMEL} AS name FROM part)"


@query(f"WITH {_NAMES_SQL} SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append({parts_sql('name')}, lower(name)))), ' ') AS words FROM names")
def identifier_words(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.array_join(F.sort_array(X.identifier_words(F.col("name"))), " ").alias("words"))


@query(
    rf"""WITH {_NAMES_SQL}, s AS (SELECT p_partkey, regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g') AS step FROM names)
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(step), '_+'), lambda x: length(x) >= 2), ' ') AS parts FROM s"""
)
def decompose_identifier(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.array_join(X.identifier_parts(F.col("name")), " ").alias("parts"))


@query(f"WITH {FILES} SELECT file_path, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(file_path, '\\.[^./]*$', '')), '[/_-]+'), lambda x: x <> ''), ' ') AS segments FROM files")
def path_segments(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", F.array_join(X.path_segments(F.col("file_path")), " ").alias("segments"))


_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP)


@query(
    f"""WITH w AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP_SQL})))) AS w FROM benchmark),
r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS rn FROM w)
SELECT item_id, string_agg(w, ' ' ORDER BY rn) AS words FROM r WHERE rn <= 8 GROUP BY item_id"""
)
def concept_words(spark, sf_dir):
    found = read_table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.ranked_concept_words(F.col("text")), " ").alias("words"))
    return found.where("words <> ''")


_CC_SQL = " + ".join(f"CAST((length(content) - length(replace(content, '{w}', ''))) / {len(w)} AS BIGINT)" for w in X.BRANCHES)


@query(
    f"""WITH {FILES}, c AS (SELECT file_path, 1 + {_CC_SQL} AS cc,
regexp_matches(content, '(^|[^A-Za-z0-9_])(if|match|switch|case)[^A-Za-z0-9_]') AS b, regexp_matches(content, '(^|[^A-Za-z0-9_])(for|while|loop)[^A-Za-z0-9_]') AS l FROM files)
SELECT file_path, CAST(cc AS BIGINT) AS cc, CASE WHEN cc <= 5 THEN 'low' WHEN cc <= 10 THEN 'moderate' WHEN cc <= 25 THEN 'high' ELSE 'very_high' END AS band,
CASE WHEN b AND l THEN 'mixed' WHEN b THEN 'branching' WHEN l THEN 'looping' ELSE 'linear' END AS flow FROM c"""
)
def complexity_report(spark, sf_dir):
    cc = X.complexity(F.col("content"))
    own = files(spark, sf_dir).repartition("doc_id")  # a file of one row group would be one task
    return own.select("file_path", cc.alias("cc"), X.control_flow(F.col("content")).alias("flow")).withColumn("band", X.complexity_band(F.col("cc")))


@query(
    """SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]')), chr(10))) AS kept,
md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[0-9]')), chr(10))) AS stripped,
md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')), chr(10))) AS replaced,
md5(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS head, md5(array_to_string(string_split(text, chr(10))[-2:], chr(10))) AS tail,
md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: x[1:40]), chr(10))) AS cut,
md5(CASE WHEN len(string_split(text, chr(10))) <= 6 THEN text ELSE array_to_string(string_split(text, chr(10))[1:4], chr(10)) || chr(10) || '... (' || (len(string_split(text, chr(10))) - 6) || ' lines omitted)' || chr(10) || array_to_string(string_split(text, chr(10))[-2:], chr(10)) END) AS limited
FROM documents"""
)
def filter_pipeline_stages(spark, sf_dir):
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(X.keep_lines(t, "[0-9]")).alias("kept"),
        F.md5(X.strip_lines(t, "[0-9]")).alias("stripped"),
        F.md5(X.replace_each(t, "[0-9]+", "#")).alias("replaced"),
        F.md5(X.head(t, 3)).alias("head"),
        F.md5(X.tail(t, 2)).alias("tail"),
        F.md5(X.truncate_each(t, 40)).alias("cut"),
        F.md5(X.max_lines(t, 6)).alias("limited"),
    )


@query(
    """WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, line, min(pos) AS pos FROM u GROUP BY ALL) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM f GROUP BY doc_id"""
)
def dedup_output_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(X.dedup_lines(F.col("text"))).alias("digest"))


_RULES = [(1, "src1", "[0-9]{6}", 2), (2, "*", "@", 1), (3, "*", ".", 3)]


@query(
    """WITH r(ord, tool, pat, least) AS (VALUES (1, 'src1', '[0-9]{6}', 2), (2, '*', '@', 1), (3, '*', '.', 3))
SELECT doc_id, CAST(min(ord) AS INT) AS rule FROM documents JOIN r ON (tool = '*' OR tool = source) AND regexp_matches(text, pat) AND len(string_split(text, chr(10))) >= least GROUP BY doc_id"""
)
def filter_rule_matching(spark, sf_dir):
    """The first matching rule of a fixed list wins; rules are tested in the row, not joined."""
    rule = X.first_rule(_RULES, F.col("source"), F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", rule.alias("rule")).where("rule is not null")


@query(
    r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))), ' ') AS links,
regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages"""
)
def html_headings_and_links(spark, sf_dir):
    links = F.sort_array(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    return read_table(spark, sf_dir, "pages").select("page_id", F.array_join(links, " ").alias("links"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("heading"))


@query(
    f"""WITH {CHUNKS} SELECT chunk_id, md5('File: ' || file_path || ' | Language: plaintext' || chr(10) || content) AS digest FROM chunks"""
)
def embed_text(spark, sf_dir):
    return corpus.embed_text(chunks(spark, sf_dir)).select("chunk_id", F.md5("embed_text").alias("digest"))


_BEFORE, _AFTER = ["src/", "tests/", "lib/spec/", "docs/", "bin/", "x/test_", "Fixtures/", "a/__init__.py/", ""], [".py", "_test.go", ".md", ".test.ts", ".png", ".rs", "_spec.rb"]
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(
    rf"""WITH p AS (SELECT {_LIST(_BEFORE)}[doc_id % {len(_BEFORE)} + 1] || CASE WHEN doc_id % 11 = 0 THEN 'main' ELSE 'f' || doc_id END || {_LIST(_AFTER)}[doc_id % {len(_AFTER)} + 1] AS path FROM documents),
m AS (SELECT DISTINCT path, lower(path) AS low, regexp_extract(path, '[^/]*$') AS name FROM p)
SELECT path, regexp_matches(low, '(^|/)(tests?|__tests__|spec|specs|testing|fixtures)/') OR regexp_matches(low, '(_test|_spec|\.test|\.spec)\.[a-z]+$') OR starts_with(name, 'test_') AS test,
regexp_matches(name, '^test_|_test\.|\.test\.|\.spec\.|_spec\.|Test\.java$|Tests?\.cs$') OR regexp_matches(path, '(^|/)(tests|__tests__|spec)/') AS maps,
contains(path, '/test') OR starts_with(path, 'test') OR regexp_matches(name, '_test\.|\.test\.|\.spec\.|^test_') AS orphan,
name IN ('main.py', 'main.rs', 'main.go') OR regexp_matches(name, '^main[._]') OR regexp_matches(path, '(^|/)(bin|scripts|examples|benches)/') AS entry,
regexp_matches(lower(name), '\.(md|markdown|rst|adoc|txt|html?|pdf)$') AS doc, regexp_matches(low, '\.(png|jpe?g|gif|svg|ico|css|scss|woff2?|ttf|json|lock|map)$') AS asset,
NOT regexp_matches(low, '\.png$') AS indexable FROM m"""
)
def path_predicates(spark, sf_dir):
    """Every predicate on paths made of usual folders, names and endings."""
    d = F.col("doc_id")
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (d % len(names)).cast("int"))
    made = F.concat(pick(_BEFORE), F.when(d % 11 == 0, "main").otherwise(F.concat(F.lit("f"), d.cast("string"))), pick(_AFTER))
    p = F.col("path")
    return read_table(spark, sf_dir, "documents").select(made.alias("path")).distinct().select(
        "path", X.ranks_as_test(p).alias("test"), X.maps_as_test(p).alias("maps"), X.orphan_test(p).alias("orphan"),
        X.entry_point(p).alias("entry"), X.doc_file(p).alias("doc"), X.asset_file(p).alias("asset"), X.indexable(p).alias("indexable"),
    )
