"""A small source tree: parsers, import and call graphs, tests, renames, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators import corpus, engine, graph, retrieve, symbols
from seine.queries import query
from seine.queries.graphs import rank_ctes
from seine.queries.text import CHUNKS, FILES, chunks, files
from seine.sources import code, docs
from seine.store import read_table

REPO = {
    "src/main.rs": "mod engine;\nuse crate::parser::parse_data;\n\nfn main() {\n    let x = parse_data();\n    run_engine(x);\n}\n",
    "src/engine.rs": "use crate::parser::Parser;\n\n/// Runs all.\npub fn run_engine(n: u32) -> u32 {\n    let p = Parser::new();\n    helper(n)\n}\n\nfn helper(n: u32) -> u32 {\n    n + 1\n}\n",
    "src/parser.rs": "/// A parser.\npub struct Parser {\n    n: u32,\n}\n\nimpl Parser {\n    pub fn new() -> Self {\n        Parser { n: 0 }\n    }\n}\n\npub fn parse_data() -> u32 {\n    0\n}\n\nfn unused_func() {}\n",
    "web/index.ts": "import { foo } from './foo';\nimport * as ext from 'react';\n\nexport class App {\n  run() { return foo(1); }\n}\n",
    "web/foo.ts": "export function foo(n: number) {\n  return n;\n}\n",
    "py/utils.py": "from helpers import slug\nimport os\n\n\ndef title(s):\n    \"\"\"Upper case.\"\"\"\n    return slug(s).upper()\n\n\nclass Box:\n    def _hide(self):\n        return title('x')\n",
    "py/helpers.py": "def slug(s):\n    return s.replace(' ', '-')\n",
    "tests/test_utils.py": "from py.utils import title\n\n\ndef test_title():\n    assert title('a b') == 'A-B'\n",
    "go/server.go": "package main\n\nimport \"net/http\"\n\ntype Server struct {\n}\n\nfunc (s *Server) Start() {\n\thttp.ListenAndServe()\n}\n",
    "README.md": "Intro text.\n\n# Guide\n\nUse `parse_data()` and `Parser::new`.\n\n## Setup\n\nRun it, not `plain words`.\n\n# Notes\n\nSee `run_engine`.\n",
}


def repo(spark):
    return spark.createDataFrame(sorted(REPO.items()), "file_path string, content string").repartition(2)


def _values(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) t({names})"


#: (file, name, kind, first line, signature, visibility, doc) by reading the tree.
_SYMBOLS = """('go/server.go', 'Server', 'struct', 4, 'type Server struct {', 'public', NULL),
('go/server.go', 'Start', 'function', 7, 'func (s *Server) Start() {', 'public', NULL),
('py/helpers.py', 'slug', 'function', 0, 'def slug(s):', 'public', NULL),
('py/utils.py', 'Box', 'class', 9, 'class Box:', 'public', NULL),
('py/utils.py', '_hide', 'method', 10, 'def _hide(self):', 'private', NULL),
('py/utils.py', 'title', 'function', 4, 'def title(s):', 'public', 'Upper case.'),
('src/engine.rs', 'helper', 'function', 8, 'fn helper(n: u32) -> u32 {', 'private', NULL),
('src/engine.rs', 'run_engine', 'function', 3, 'pub fn run_engine(n: u32) -> u32 {', 'public', 'Runs all.'),
('src/main.rs', 'engine', 'module', 0, 'mod engine;', 'private', NULL),
('src/main.rs', 'main', 'function', 3, 'fn main() {', 'private', NULL),
('src/parser.rs', 'Parser', 'impl', 5, 'impl Parser {', 'private', NULL),
('src/parser.rs', 'Parser', 'struct', 1, 'pub struct Parser {', 'public', 'A parser.'),
('src/parser.rs', 'new', 'function', 6, 'pub fn new() -> Self {', 'public', NULL),
('src/parser.rs', 'parse_data', 'function', 11, 'pub fn parse_data() -> u32 {', 'public', NULL),
('src/parser.rs', 'unused_func', 'function', 15, 'fn unused_func() {}', 'private', NULL),
('tests/test_utils.py', 'test_title', 'function', 3, 'def test_title():', 'public', NULL),
('web/foo.ts', 'foo', 'function', 0, 'export function foo(n: number) {', 'public', NULL),
('web/index.ts', 'App', 'class', 3, 'export class App {', 'public', NULL)"""


@query(_values(_SYMBOLS, "file_path, name, kind, line, signature, visibility, doc"))
def symbol_extraction(spark, sf_dir):
    return code.symbols(repo(spark)).drop("line_end")


@query(
    _values(
        "('src/main.rs', 'src/engine.rs', 'Resolved'), ('src/main.rs', 'src/parser.rs', 'Resolved'), ('src/engine.rs', 'src/parser.rs', 'Resolved'), ('web/index.ts', 'web/foo.ts', 'Resolved'), "
        "('web/index.ts', '__ext__:react', 'External'), ('py/utils.py', 'py/helpers.py', 'Resolved'), ('py/utils.py', '__ext__:os', 'External'), ('tests/test_utils.py', 'py/utils.py', 'Resolved'), ('go/server.go', '__ext__:net/http', 'External')",
        "src, dst, kind",
    )
)
def import_resolution(spark, sf_dir):
    """Expected edges are derived by hand from the tree."""
    return code.import_edges(repo(spark)).select("src", "dst", "kind").distinct()


@query(
    _values(
        "('src/main.rs', 'src/parser.rs', 'parse_data'), ('src/main.rs', 'src/engine.rs', 'run_engine'), ('src/engine.rs', 'src/parser.rs', 'new'), ('web/index.ts', 'web/foo.ts', 'foo'), ('py/utils.py', 'py/helpers.py', 'slug'), ('tests/test_utils.py', 'py/utils.py', 'title')",
        "src, dst, name",
    )
)
def call_edges(spark, sf_dir):
    return code.call_edges(repo(spark))


@query(_values("('README.md', 'src/parser.rs', 'parse_data'), ('README.md', 'src/engine.rs', 'run_engine')", "src, dst, name"))
def doc_edges(spark, sf_dir):
    own = repo(spark)
    names = corpus.doc_references(own.where("file_path = 'README.md'"))
    return symbols.unique_targets(names, code.symbols(own))


@query(
    _values(
        """('foo', 'web/index.ts', 4, NULL, 'web/foo.ts'),
('helper', 'src/engine.rs', 5, 'run_engine', 'src/engine.rs'),
('new', 'src/engine.rs', 4, 'run_engine', 'src/parser.rs'),
('parse_data', 'src/main.rs', 4, 'main', 'src/parser.rs'),
('run_engine', 'src/main.rs', 5, 'main', 'src/engine.rs'),
('slug', 'py/utils.py', 6, 'title', 'py/helpers.py'),
('title', 'py/utils.py', 11, '_hide', 'py/utils.py'),
('title', 'tests/test_utils.py', 4, 'test_title', 'py/utils.py')""",
        "callee, file_path, line, caller, target",
    )
)
def symbol_graph(spark, sf_dir):
    return code.symbol_edges(repo(spark))


@query(_values("('README.md', 0, 0, ''), ('README.md', 1, 1, 'Guide'), ('README.md', 2, 2, 'Guide/Setup'), ('README.md', 3, 1, 'Notes')", "file_path, section, level, path"))
def markdown_sections(spark, sf_dir):
    found = corpus.markdown_sections(repo(spark).where("file_path = 'README.md'"))
    return found.select("file_path", F.col("section").cast("int").alias("section"), F.col("level").cast("int").alias("level"), F.array_join("path", "/").alias("path"))


#: More tests, one for each rule: same folder, elsewhere with no and with two shared folders, and an import of another stem.
TESTED = {"a/one.go": "", "a/one_test.go": "", "lib/two.rb": "", "spec/two_spec.rb": "", "p/q/three.ts": "", "p/q/__tests__/three.test.ts": "", "py/four.py": "", "tests/test_five.py": "from py.four import x\n"}


@query(
    _values(
        "('tests/test_utils.py', 'py/utils.py', 0.95), ('a/one_test.go', 'a/one.go', 0.9), ('spec/two_spec.rb', 'lib/two.rb', 0.7), ('p/q/__tests__/three.test.ts', 'p/q/three.ts', 0.8), ('tests/test_five.py', 'py/four.py', 0.95)",
        "test, source, confidence",
    )
)
def test_mapping(spark, sf_dir):
    own = spark.createDataFrame(sorted((REPO | TESTED).items()), "file_path string, content string").where("file_path not like '%.md'")
    found = symbols.map_tests(own, X.maps_as_test(F.col("file_path")), code.import_edges(own).where("kind = 'Resolved'").select("src", "dst"))
    return found.withColumn("confidence", F.round("confidence", 6))


@query(_values("('src/engine.rs', 1, 'none'), ('src/main.rs', 1, 'none'), ('src/a.rs', 2, 'collision'), ('src/b.rs', 1, 'shadowing')", "file_path, occurrences, hazard"))
def rename_validation(spark, sf_dir):
    """One file of the new name's definition, one that mentions it, and two without."""
    more = {"src/a.rs": "fn start_engine() {\n    run_engine(run_engine(1));\n}\n", "src/b.rs": "fn go(start_engine: u32) {\n    run_engine(start_engine);\n}\n", "src/c.rs": "fn other() {\n    run_engine_twice();\n}\n"}
    own = spark.createDataFrame(sorted((REPO | more).items()), "file_path string, content string").where("file_path like '%.rs'")
    return symbols.rename_hazards(own, code.symbols(own), "run_engine", "start_engine")


@query(f"WITH {FILES} SELECT file_path, md5(regexp_replace(content, '\\bthe\\b', 'THE_NEW', 'g')) AS digest FROM files")
def rename_apply(spark, sf_dir):
    return symbols.rename(files(spark, sf_dir), "the", "THE_NEW").select("file_path", F.md5("content").alias("digest"))


_TREE = """re AS (SELECT * FROM (VALUES ('src/main.rs', 'src/engine.rs'), ('src/main.rs', 'src/parser.rs'), ('src/engine.rs', 'src/parser.rs'), ('web/index.ts', 'web/foo.ts'), ('py/utils.py', 'py/helpers.py'), ('tests/test_utils.py', 'py/utils.py')) t(src, dst)), rn AS (SELECT src AS node FROM re UNION SELECT dst FROM re UNION SELECT 'go/server.go')"""


@query(f"WITH {_TREE}, {rank_ctes(20, '1.0 / (SELECT count(*) FROM rn)')} SELECT node, round(rank / (SELECT max(rank) FROM r20), 6) AS rank FROM r20")
def import_graph_pagerank(spark, sf_dir):
    return graph.pagerank(code.import_edges(repo(spark)), tolerance=0.0).withColumn("rank", F.round("rank", 6))


@query()
def html_sections(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(F.col("url").alias("file_path"), F.col("html").alias("content"))
    return docs.sections(pages, "html")


@query()
def stemmed_tokens(spark, sf_dir):
    """Distinct tokens with their stems; the rules are those of English, so the English files are the input."""
    found = files(spark, sf_dir).where("lang = 'en'").select(F.explode(X.code_tokens(F.col("content"))).alias("token")).distinct()
    return docs.stems(found)


@query(
    """WITH n AS (SELECT conv_id, list({'cell_type': CASE role WHEN 'user' THEN 'code' ELSE 'markdown' END, 'source': text} ORDER BY turn) AS cells FROM conversations GROUP BY conv_id)
SELECT conv_id AS nb, CAST(i - 1 AS INT) AS cell, cells[i].cell_type AS cell_type, md5(cells[i].source) AS digest FROM (SELECT conv_id, cells, unnest(range(1, len(cells) + 1)) AS i FROM n)"""
)
def notebook_cells(spark, sf_dir):
    """Conversations written as notebooks and read back cell by cell."""
    c = read_table(spark, sf_dir, "conversations")
    cell = F.struct("turn", F.when(F.col("role") == "user", "code").otherwise("markdown").alias("cell_type"), F.array("text").alias("source"))
    cells = F.transform(F.sort_array(F.collect_list(cell)), lambda x: F.struct(x["cell_type"].alias("cell_type"), x["source"].alias("source")))
    books = c.groupBy("conv_id").agg(F.to_json(F.struct(cells.alias("cells"))).alias("content")).withColumnRenamed("conv_id", "file_path")
    return corpus.notebook_cells(books).select(F.col("file_path").alias("nb"), "cell", "cell_type", F.md5("source").alias("digest"))


@query(
    f"""WITH {CHUNKS}, n AS (SELECT count(*) AS t, sum(strlen(content)) AS b, sum(ceil(strlen(content) / 4.0)) AS k FROM files WHERE contains(content, 'the er')),
h AS (SELECT content, CAST((length(content) - length(replace(content, 'the er', ''))) / 6 AS BIGINT) AS score, file_path, line_start FROM chunks WHERE contains(content, 'the er') ORDER BY score DESC, file_path, line_start LIMIT 20),
s AS (SELECT count(*) AS t, sum(strlen(content)) AS b, sum(ceil(strlen(content) / 4.0)) AS k FROM h)
SELECT n.t AS naive_texts, CAST(n.b AS BIGINT) AS naive_bytes, CAST(n.k AS BIGINT) AS naive_tokens, s.t AS search_texts, CAST(s.b AS BIGINT) AS search_bytes, CAST(s.k AS BIGINT) AS search_tokens, round(1 - s.k / n.k, 6) AS saved FROM n, s"""
)
def token_savings(spark, sf_dir):
    """Reading every file that holds a literal against the twenty best chunks."""
    hits = retrieve.exact(chunks(spark, sf_dir), "the er").orderBy(F.desc("score"), "file_path", "line_start").limit(20)
    found = chunks(spark, sf_dir).join(hits.select("chunk_id"), "chunk_id", "left_semi")
    return engine.token_savings(files(spark, sf_dir), found, "the er")


# Compositions.


@query("SELECT 'parse_data' AS name, 'src/parser.rs' AS file_path, 'pub fn parse_data() -> u32 {' || chr(10) || '    0' || chr(10) || '}' || chr(10) AS source")
def read_symbol_source(spark, sf_dir):
    return engine.symbol_source(repo(spark), code.symbols(repo(spark)), "parse_d")


@query(_values("('add', '_external/github/issue-7.md'), ('keep', 'README.md')", "k, file_path"))
def external_import(spark, sf_dir):
    old = spark.createDataFrame([("README.md", "x"), ("_external/github/issue-1.md", "old")], "file_path string, content string")
    new = spark.createDataFrame([(7, "T", "B", "open", "ann", ["bug"], "u")], "number long, title string, body string, state string, author string, labels array<string>, url string")
    found = engine.import_external(old, new, "github")
    return found.select(F.when(F.col("file_path") == "README.md", "keep").otherwise("add").alias("k"), "file_path")


@query(_values("('a', 'removed'), ('b', 'added'), ('c', 'added'), ('d', 'modified'), ('e', 'removed'), ('g', 'added')", "file_path, change"))
def git_sync(spark, sf_dir):
    rows = [("R100", "a", "b"), ("A", "c", None), ("M", "d", None), ("D", "e", None), ("C75", "f", "g")]
    return engine.git_changes(spark.createDataFrame(rows, "status string, old string, new string"))


def _tests(own):
    """(test, source) by the mapping's rules."""
    return symbols.map_tests(own, X.maps_as_test(F.col("file_path")), code.import_edges(own).where("kind = 'Resolved'").select("src", "dst")).select("test", "source")


@query(_values("('src/engine.rs', 'core'), ('src/parser.rs', 'callee'), ('src/main.rs', 'caller'), ('py/utils.py', 'core'), ('py/helpers.py', 'callee'), ('tests/test_utils.py', 'caller'), ('py/test_utils.py', 'test')", "file_path, role"))
def feature_hub(spark, sf_dir):
    """Every role; a test that imports a core file is its caller first."""
    own = spark.createDataFrame(sorted((REPO | {"py/test_utils.py": ""}).items()), "file_path string, content string")
    return engine.feature_hub(own.where("file_path in ('src/engine.rs', 'py/utils.py')"), code.import_edges(own), _tests(own.where("file_path not like '%.md'")))


@query(_values("('src/parser.rs', 'changed', 'Parser, new, parse_data'), ('py/utils.py', 'changed', 'Box, title'), ('tests/test_utils.py', 'test', 'test_title'), ('src/main.rs', 'caller', ''), ('src/engine.rs', 'caller', 'run_engine')", "file_path, role, symbols"))
def review_context(spark, sf_dir):
    own = repo(spark)
    changed = own.where("file_path in ('src/parser.rs', 'py/utils.py')")
    return engine.review_context(changed, code.import_edges(own), _tests(own.where("file_path not like '%.md'")), code.symbols(own))


@query(_values("('py/utils.py', 'classify', 0, 10, 8, 'moderate'), ('py/utils.py', 'plain', 12, 13, 1, 'low')", "file_path, name, line, line_end, cc, band"))
def function_complexity(spark, sf_dir):
    """Branch words of each function: three ifs, two of them after an else, a for, a while, a case and an or."""
    text = "def classify(x):\n    if x:\n        return 1\n    else if y:\n        pass\n    for i in x:\n        while x || y:\n            pass\n    case x:\n        pass\n    return 0\n\ndef plain(x):\n    return x\n"
    files_ = spark.createDataFrame([("py/utils.py", text)], "file_path string, content string")
    rows = [("py/utils.py", "classify", "function", 0, 10), ("py/utils.py", "plain", "function", 12, 13), ("py/utils.py", "Box", "class", 0, 13)]
    return engine.function_complexity(files_, spark.createDataFrame(rows, "file_path string, name string, kind string, line int, line_end int"))


@query(_values("('one', 'parse_data', 'function', 'src/parser.rs', 11), ('one', 'Parser', 'struct', 'src/parser.rs', 1), ('one', 'Parser', 'impl', 'src/parser.rs', 5), ('two', 'Parser', 'struct', 'src/parser.rs', 1), ('two', 'Parser', 'impl', 'src/parser.rs', 5), ('two', 'parse_data', 'function', 'src/parser.rs', 11), ('two', 'sparse', 'function', 'x.py', 0)", "project, name, kind, file_path, line"))
def federated_symbols(spark, sf_dir):
    """The same name looked up in two projects."""
    two = spark.createDataFrame(sorted((REPO | {"x.py": "def sparse():\n    pass\n"}).items()), "file_path string, content string")
    return engine.symbols_of_projects({"one": code.symbols(repo(spark)), "two": code.symbols(two)}, "parse")


@query(_values("('py/utils.py', 'py/helpers.py', 'helpers', 0, 'from helpers import slug'), ('tests/test_utils.py', 'py/utils.py', 'py.utils', 0, 'from py.utils import title')", "src, dst, raw, line, text"))
def cross_import_evidence(spark, sf_dir):
    own = repo(spark)
    return graph.import_evidence(code.import_edges(own), own, "", "py/")


@query(_values("('callers', 'Who calls a function.', 0), ('impact', 'What a change may break.', 1)", "name, description, hit"))
def tool_search(spark, sf_dir):
    tools = spark.createDataFrame([("callers", "Who calls a function."), ("impact", "What a change may break."), ("grep", "Lines that match.")], "name string, description string")
    return engine.search_tools(tools, {"callers": ["who uses", "usages of"], "grep": ["find text"]}, "Who uses what may change")


@query(_values("('test', 'tests/test_utils.py'), ('test', 'tests/test_utils.py'), ('call', 'py/utils.py')", "kind, file_path").replace("('test', 'tests/test_utils.py'), ('test', 'tests/test_utils.py')", "('test', 'tests/test_utils.py')"))
def usage_examples(spark, sf_dir):
    return engine.usage_examples(repo(spark), "title").select("kind", "file_path")


@query(
    f"""WITH {_TREE}, {rank_ctes(20, "CASE node WHEN 'src/engine.rs' THEN 1 / 1.7 WHEN 'py/utils.py' THEN 0.7 / 1.7 ELSE 0 END")}
SELECT node, round(rank / (SELECT max(rank) FROM r20), 5) AS rank, CASE WHEN node IN ('src/engine.rs', 'py/utils.py') THEN 'seed' WHEN node IN ('src/main.rs', 'tests/test_utils.py') THEN 'caller'
WHEN node IN ('src/parser.rs', 'py/helpers.py') THEN 'callee' ELSE 'related' END AS relation FROM r20"""
)
def focus_map(spark, sf_dir):
    return engine.focus_map(code.import_edges(repo(spark)), ["src/engine.rs", "py/utils.py"]).withColumn("rank", F.round("rank", 5))


@query(_values("('D', 'extends', 'Base'), ('P', 'implements', 'Shape'), ('X', 'extends', 'Y'), ('X', 'implements', 'Z')", "name, relation, target"))
def type_relations(spark, sf_dir):
    rows = [("P", "impl Shape for P"), ("D", "class D(Base)"), ("X", "class X extends Y implements Z"), ("f", "fn f()")]
    return engine.type_relations(spark.createDataFrame(rows, "name string, signature string"))


@query(f"WITH {FILES}, p AS (SELECT file_path, unnest(string_split(replace(content, chr(10), chr(12)), chr(12))) AS page, generate_subscripts(string_split(replace(content, chr(10), chr(12)), chr(12)), 1) AS n FROM files) SELECT file_path, CAST(n AS INT) AS page, md5(page) AS digest FROM p WHERE trim(page) <> ''")
def pdf_pages(spark, sf_dir):
    """Lines stand for the pages of extracted text."""
    paged = files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\f")))
    return engine.pdf_pages(paged).select("file_path", "page", F.md5("content").alias("digest"))


@query(
    f"""WITH {FILES}, b AS (SELECT file_path, '```x' || chr(10) || content || '```' AS content FROM files) SELECT file_path, md5(regexp_extract(content, '(?s)```[^\\n]*\\n(.*?)```', 1)) AS digest FROM b"""
)
def code_blocks(spark, sf_dir):
    fenced = files(spark, sf_dir).withColumn("content", F.concat(F.lit("```x\n"), "content", F.lit("```")))
    return engine.code_blocks(fenced).select("file_path", F.md5("code").alias("digest"))


def _search(spark, sf_dir):
    """search(text, n) over line chunks: occurrences of the text's words."""
    own = chunks(spark, sf_dir)

    def search(text, n):
        score = sum((X.occurrences(F.col("content"), w) for w in text.split()), F.lit(0)).cast("double")
        found = own.withColumn("score", score).where("score > 0").select(*engine.COLUMNS, "score")
        return found.orderBy(F.desc("score"), "file_path", "line_start").limit(n)

    return search


def _occurrences(words: str) -> str:
    """SQL of `_search`'s score."""
    return "CAST(" + " + ".join(f"(length(content) - length(replace(content, '{w}', ''))) / {len(w)}" for w in words.split()) + " AS DOUBLE)"


def _list_sql(words: str) -> str:
    """SQL of one list of `deep`: the 30 best chunks for the words, ranked by score and chunk."""
    found = f"SELECT chunk_id, file_path, line_start, content, {_occurrences(words)} AS score FROM chunks"
    return f"(SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM (SELECT * FROM ({found}) WHERE score > 0 ORDER BY score DESC, file_path, line_start LIMIT 30))"


@query(
    f"""WITH {CHUNKS}, l AS MATERIALIZED (FROM {_list_sql('theand of tion')} UNION ALL FROM {_list_sql('theand tion')} UNION ALL FROM {_list_sql('TheandTion')} UNION ALL FROM {_list_sql('theand_tion')}),
f AS (SELECT chunk_id FROM l GROUP BY chunk_id ORDER BY sum(1.0::DOUBLE / (60 + rank + 1)) DESC, chunk_id LIMIT 30),
b AS (SELECT DISTINCT chunk_id, file_path, line_start, content FROM l WHERE chunk_id IN (FROM f)),
s AS (SELECT *, len(list_filter(['theand', 'of', 'tion'], lambda w: list_contains(regexp_split_to_array(lower(content), '\\s+'), w))) / 3.0 AS score FROM b)
SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, file_path, line_start LIMIT 10"""
)
def deep_search(spark, sf_dir):
    """Four reformulations fused, then scored by the share of the query's words; the SQL lists the reformulations."""
    return engine.deep("theand of tion", _search(spark, sf_dir), 10).select("chunk_id", F.round("score", 6).alias("score"))


#: As in queries.ranking: each document calls the next three of its source, and every tenth.
_CALLS = """hop AS (SELECT file_path AS src, unnest([doc_id + 20, doc_id + 40, doc_id + 60, CAST(floor(doc_id / 10) AS BIGINT)]) AS n FROM files),
edges AS (SELECT DISTINCT src, f.file_path AS dst FROM hop JOIN files f ON f.doc_id = n WHERE src <> f.file_path)"""


@query(
    f"""WITH {CHUNKS}, {_CALLS}, r AS (SELECT dst, count(*) / 10.0::DOUBLE AS rank FROM edges GROUP BY dst),
hit AS MATERIALIZED (SELECT * FROM (SELECT *, {_occurrences('theand of')} AS score FROM chunks) WHERE score > 0 ORDER BY score DESC, file_path, line_start LIMIT 12),
b AS MATERIALIZED (SELECT chunk_id, file_path, line_start, score * (1 + 0.3 * coalesce(rank, 0)) AS score FROM hit LEFT JOIN r ON dst = file_path),
a AS (SELECT file_path, max(score) AS s FROM b GROUP BY file_path), n AS (SELECT src AS f, s FROM a JOIN edges ON dst = file_path UNION ALL SELECT dst, s FROM a JOIN edges ON src = file_path),
m AS (SELECT f, max(s) AS s FROM n WHERE f NOT IN (SELECT file_path FROM b) GROUP BY f ORDER BY s DESC, f LIMIT 8),
x AS (SELECT c.chunk_id, c.file_path, c.line_start, s * (0.6 + 0.6 * coalesce(rank, 0)) AS score FROM m JOIN chunks c ON c.file_path = f AND c.line_start = 0 LEFT JOIN r ON dst = f)
SELECT chunk_id, round(score, 6) AS score FROM (FROM b UNION ALL FROM x) u ORDER BY u.score DESC, file_path, line_start LIMIT 10"""
)
def explore_search(spark, sf_dir):
    from seine.queries.ranking import edges

    own = edges(spark, sf_dir)
    ranks = own.groupBy(F.col("dst").alias("node")).agg((F.count("*") / 10).alias("rank"))
    hits = _search(spark, sf_dir)("theand of", 12)
    return engine.explore(hits, chunks(spark, sf_dir), ranks, own, 10).select("chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {CHUNKS}, one AS (SELECT regexp_extract_all(array_to_string(string_split(content, chr(10))[1:10], chr(10)), '[A-Za-z_][\\p{{L}}\\p{{N}}_]{{2,}}') AS words FROM files WHERE doc_id = 2),
u AS (SELECT unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM one), w AS (SELECT word, min(pos) AS pos FROM u GROUP BY word ORDER BY pos LIMIT 20),
s AS (SELECT chunk_id, file_path, line_start, CAST(sum((length(content) - length(replace(content, word, ''))) / length(word)) AS DOUBLE) AS score FROM chunks, w GROUP BY ALL)
SELECT chunk_id, score FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, file_path, line_start LIMIT 11) WHERE NOT ends_with(file_path, '/doc_2.txt')"""
)
def find_similar(spark, sf_dir):
    """Chunks like the first chunk of one file, itself left out."""
    search = _search(spark, sf_dir)
    one = files(spark, sf_dir).where("doc_id = 2").select("content").first()[0]
    return search(engine.similar_query(one), 11).where(~F.col("file_path").endswith("/doc_2.txt")).select("chunk_id", "score")


@query(
    f"""WITH {_TREE}, {rank_ctes(20, '1.0 / (SELECT count(*) FROM rn)')}, l AS (SELECT * FROM re UNION ALL SELECT * FROM (VALUES ('web/index.ts', '__ext__:react'), ('py/utils.py', '__ext__:os'), ('go/server.go', '__ext__:net/http')) t(src, dst))
SELECT node AS file_path, '# ' || node || chr(10) || chr(10) || 'pagerank: ' || format('{{:.4f}}', rank / (SELECT max(rank) FROM r20)) || chr(10) || chr(10) || coalesce((SELECT string_agg('- [[' || dst || ']]', chr(10) ORDER BY dst) FROM l WHERE src = node), '') AS note FROM r20"""
)
def obsidian_notes(spark, sf_dir):
    from seine.operators import assemble

    own = code.import_edges(repo(spark))
    return assemble.notes(graph.pagerank(own, tolerance=0.0), own)


@query(
    _values(
        """('README.md', 0, 8), ('README.md', 8, 14),
('go/server.go', 0, 4),
('go/server.go', 4, 7),
('go/server.go', 7, 11), ('py/helpers.py', 0, 3), ('py/utils.py', 0, 4), ('py/utils.py', 4, 10), ('py/utils.py', 10, 13), ('src/engine.rs', 0, 3), ('src/engine.rs', 3, 8), ('src/engine.rs', 8, 12),
('src/main.rs', 0, 3),
('src/main.rs', 3, 8), ('src/parser.rs', 0, 6), ('src/parser.rs', 6, 11), ('src/parser.rs', 11, 15), ('src/parser.rs', 15, 17), ('tests/test_utils.py', 0, 3), ('tests/test_utils.py', 3, 6), ('web/foo.ts', 0, 4), ('web/index.ts', 0, 3), ('web/index.ts', 3, 7)""",
        "file_path, line_start, line_end",
    )
)
def code_chunks(spark, sf_dir):
    """Line ranges of each file of the tree, cut at its definitions."""
    small = 60

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                language = {"rs": "rust", "py": "python", "ts": "typescript", "go": "go"}.get(path.rsplit(".", 1)[-1], "")
                spans = [(s[2], s[3]) for s in code.symbols_of(text, language)]
                out += [(path, a, b) for a, b in docs.code_chunks(text, spans, small // 4, small)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file_path", "line_start", "line_end"]) if out else batch.slice(0, 0)

    return repo(spark).mapInArrow(run, "file_path string, line_start long, line_end long")
