"""Operators on fixtures whose results are derived by hand: rewriting, sections, filters, assembly, stored trees."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from seine.operators import assemble, concepts, corpus, engine, rank, symbols
from seine.plans import rewrite
from seine.queries import query
from seine.queries.code import repo
from seine.sources import code, docs
from seine.sources.tree import Generations, scan
from seine.store import scratch_folder


def _is(rows: list[tuple], names: str) -> str:
    """SQL of a small table; None, numbers, booleans and texts."""

    def word(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool | int | float):
            return str(v)
        return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)}) t({names})"


# Rewriting.

_QUERIES = [
    ("parseData", "goto", "code", 0.3, "parseData parse data parse_data"),
    ("how to write a guide", "thorough", "docs", 0.3, "how to write a guide"),
    ('"exact phrase"', "exact", "hybrid", 1.0, '"exact phrase"'),
    ("who wraps get_user", "fast", "code", 0.3, "who wraps get_user get user GetUser"),
    ("token", "instant", "hybrid", 1.0, "token"),
    ("callers of render", "explore", "hybrid", 1.0, "callers of render"),
    ("explain fn new", "fast", "hybrid", 1.0, "explain fn new"),
]


@query(_is(_QUERIES, "query, strategy, target, factor, expanded"))
def query_routing(spark, sf_dir):
    """Strategy, route and identifier expansion of queries of every kind."""
    rows = [(q, rewrite.strategy_of(q), *rewrite.route(q), rewrite.expand(q)) for q, *_ in _QUERIES]
    return spark.createDataFrame(rows, "query string, strategy string, target string, factor double, expanded string")


@query(
    _is(
        [
            (0, "how to fetch config retry"), (1, "fetch config retry"), (2, "FetchConfigRetry"), (3, "fetch_config_retry"),
            (4, "fetch config retry settings options get load"), (5, "backoff"), (6, "max_retries"), (7, "pull"),
        ],
        "position, text",
    )
)
def query_reformulations(spark, sf_dir):
    """The query, its keywords, both spellings, synonyms, code patterns and a learned word."""
    found = rewrite.reformulations("how to fetch config retry", {"fetch": ["pull"]})
    return spark.createDataFrame(list(enumerate(found)), "position int, text string")


@query(_is([("verb", "parse"), ("verb", "validate"), ("type", "Config"), ("noun", "token"), ("path", "src/a.rs"), ("path", "a b"), ("path", "x/y/z"), ("quoted", '"a\\"b"'), ("identifier", "get_user"), ("identifier", "a::b"), ("identifier", "fooBar")], "part, word"))
def query_intent(spark, sf_dir):
    """Verbs, types and nouns of a query; paths that one names; a literal's quoting; which words look like identifiers."""
    own = rewrite.intent("parse and validate the Config token")
    rows = [(k[:-1], w) for k, words in own.items() for w in words]
    rows += [("path", p) for p in rewrite.path_references("see `a b` and src/a.rs or x.y.z")]
    rows += [("quoted", rewrite.quoted('a"b'))] + [("identifier", w) for w in ("get_user", "a::b", "fooBar", "plain", "ab", "9x_y") if rewrite.identifier_like(w)]
    return spark.createDataFrame(rows, "part string, word string")


# Parts of documents.


@query(
    _is(
        [
            ("a.rst", 0, 1, "Top", "Top", "x"), ("a.rst", 1, 2, "Sub", "Top/Sub", "y"), ("a.rst", 2, 1, "Next", "Next", "z"),
            ("b.adoc", 0, 0, "", "", "pre"), ("b.adoc", 1, 1, "A", "A", "x"), ("b.adoc", 2, 2, "B", "A/B", "y"),
            ("openapi.json", 0, 1, "T", "T", "d"), ("openapi.json", 1, 2, "GET /a", "T/GET /a", ""), ("openapi.json", 2, 2, "POST /a", "T/POST /a", "s"),
            ("c.html", 0, 0, "", "", "pre"), ("c.html", 1, 1, "A", "A", "x y"), ("c.html", 2, 2, "B", "A/B", "z"), ("c.html", 3, 1, "C", "C", ""),
        ],
        "file_path, section, level, heading, path, content",
    )
)
def document_sections(spark, sf_dir):
    """Sections with breadcrumbs of reStructuredText, AsciiDoc, OpenAPI and HTML."""
    texts = {
        "rst": ("a.rst", "Top\n===\nx\n\nSub\n---\ny\n\nNext\n====\nz"),
        "asciidoc": ("b.adoc", "pre\n= A\nx\n== B\ny"),
        "openapi": ("openapi.json", json.dumps({"info": {"title": "T", "description": "d"}, "paths": {"/a": {"post": {"summary": "s"}, "get": {}}}})),
        "html": ("c.html", "<body>pre<h1>A</h1>x<script>no</script> y<div><h2>B</h2>z</div><h1>C</h1></body>"),
    }
    found = None
    for kind, row in texts.items():
        own = docs.sections(spark.createDataFrame([row], "file_path string, content string"), kind)
        found = own if found is None else found.unionByName(own)
    return found.withColumn("path", F.array_join("path", "/"))


@query(
    _is([("CHANGELOG.md", "1.2.0", "## 1.2.0\n- a"), ("CHANGELOG.md", "0.9.1-rc1", "## [0.9.1-rc1] x\n- b"), ("docs/HISTORY.md", "3.0", "## v3.0\nz")], "file_path, version, content")
)
def changelog_sections(spark, sf_dir):
    rows = [("CHANGELOG.md", "# Log\n\n## 1.2.0\n- a\n\n## [0.9.1-rc1] x\n- b\n\n## Unreleased\n- c\n"), ("docs/HISTORY.md", "## v3.0\nz\n"), ("notes.md", "## 9.9.9\nno")]
    return engine.changelog_sections(spark.createDataFrame(rows, "file_path string, content string")).drop("section")


@query(_is([("p1", "parse_data"), ("p1", "Parser::new"), ("p2", "x")], "url, name"))
def html_code_references(spark, sf_dir):
    rows = [("p1", "<p>Use <code>parse_data</code>, <code class='r'>Parser::new</code> and <code>parse_data</code>.</p>"), ("p2", "<code>x</code>"), ("p3", "none")]
    return corpus.html_code_references(spark.createDataFrame(rows, "url string, html string"))


@query(_is([("a.txt", 0, "one", 7), ("a.txt", 1, "three", 5), ("b.txt", 0, "x" * 80 + "…", 90)], "file_path, section, heading, chars"))
def plain_sections(spark, sf_dir):
    rows = [("a.txt", "one\ntwo\n \t\nthree\n\n"), ("b.txt", "x" * 90), ("c.txt", " \n\n ")]
    return corpus.plain_sections(spark.createDataFrame(rows, "file_path string, content string"))


@query(_is([("fn a(x: Config, y: &Token) -> Result<User>", "Config,Token", "Result,User"), ("fn b()", "", ""), ("fn c(n: u32) -> Self", "", "Self")], "signature, takes, gives"))
def signature_io_types(spark, sf_dir):
    rows = [(s,) for s in ("fn a(x: Config, y: &Token) -> Result<User>", "fn b()", "fn c(n: u32) -> Self")]
    takes, gives = engine.signature_types(F.col("signature"))
    return spark.createDataFrame(rows, "signature string").select("signature", F.array_join(takes, ",").alias("takes"), F.array_join(gives, ",").alias("gives"))


@query(_is([("body", True), ("signature", False), ("struct", False)], "change, same"))
def signature_fingerprints(spark, sf_dir):
    """Whether a source keeps its fingerprint when a body, a signature or a struct changes."""
    base = "pub struct A {\n    n: u32,\n}\n\npub fn f(x: u32) -> u32 {\n    if x > 1 {\n        1\n    } else {\n        2\n    }\n}\n"
    changed = {"body": base.replace("        2", "        3"), "signature": base.replace("x: u32", "x: u64"), "struct": base.replace("n: u32", "n: u8")}
    rows = [(k, code.signature_fingerprint(base) == code.signature_fingerprint(v)) for k, v in changed.items()]
    return spark.createDataFrame(rows, "change string, same boolean")


# Filters and stages over results.

_RESULTS = [
    ("1", "src/a.h", 0, 5, "int f();", 1.0), ("2", "src/a.c", 0, 5, "int f() {\n  return g();\n}", 1.0), ("3", "src/b.h", 0, 5, "int h();", 1.0), ("4", "_external/gh/issue-1.md", 0, 5, "# f fails", 1.0),
    ("5", "src/m.rs", 0, 5, "pub fn parse(x: u32) {\n}", 1.0), ("6", "src/n.rs", 0, 5, "use crate::m::parse;\nparse(1)", 1.0), ("7", "tests/t.rs", 0, 5, "    parse(2)", 1.0), ("8", "_external/jira/x.md", 0, 5, "parse", 1.0),
]


def _results(spark):
    return spark.createDataFrame(_RESULTS, "chunk_id string, file_path string, line_start int, line_end int, content string, score double")


@query(_is([(f, i) for f, ids in {"docs": "48", "code": "123567", "internal": "123567", "external": "48", "gh": "4", "function": "5"}.items() for i in ids], "filter, chunk_id"))
def result_filters(spark, sf_dir):
    """Documents or code, inside or outside sources, and kinds of definitions."""
    own = _results(spark)
    kept = {"docs": engine.filter_docs(own, "docs"), "code": engine.filter_docs(own, "code"), "function": engine.filter_kind(own, "function")}
    kept |= {s: engine.filter_source(own, s) for s in ("internal", "external", "gh")}
    found = None
    for name, df in kept.items():
        df = df.select(F.lit(name).alias("filter"), "chunk_id")
        found = df if found is None else found.unionByName(df)
    return found


@query(_is([("1", 0.6), ("2", 1.0), ("3", 0.85), ("4", 1.0), ("5", 1.0), ("6", 1.0), ("7", 1.0), ("8", 1.0)], "chunk_id, score"))
def header_demotion(spark, sf_dir):
    return engine.demote_headers(_results(spark)).select("chunk_id", "score")


@query(_is([("5", 0.02), ("6", 2.4), ("7", 0.4), ("8", 0.01)], "chunk_id, score"))
def usage_search(spark, sf_dir):
    """How each file uses a name: defines it, imports it, calls it in a test, mentions it in a document."""
    own = _results(spark).where(F.col("content").contains("parse"))
    return rank.usage_rank(own, "parse").select("chunk_id", F.round("score", 6).alias("score"))


@query(_is([("5", 0.5), ("7", 0.0), ("2", 0.0)], "chunk_id, score"))
def default_rerank(spark, sf_dir):
    """The share of the query's words that a text holds as words."""
    own = _results(spark).where("chunk_id in ('2', '5', '7')")
    return engine.rerank("pub parse", own).select("chunk_id", "score")


@query(_is([("", "cargo"), ("web", "npm"), ("svc/go", "go"), ("py", "python")], "root, kind"))
def project_discovery(spark, sf_dir):
    paths = ["Cargo.toml", "web/package.json", "svc/go/go.mod", "py/pyproject.toml", "src/main.rs", "web/src/index.ts"]
    return engine.discover_projects(spark.createDataFrame([(p,) for p in paths], "file_path string"))


# Lookups.


@query(_is([("exact", "Parser", 1), ("exact", "Parser", 5), ("any case", "Parser", 1), ("any case", "Parser", 5), ("find", "Parser", 1), ("find", "Parser", 5), ("find", "parse_data", 11)], "how, name, line"))
def symbol_lookup(spark, sf_dir):
    """By exact name, by name in any case, and by a part of the name within a path."""
    own = code.symbols(repo(spark))
    one = lambda how, df: df.select(F.lit(how).alias("how"), "name", "line")
    return one("exact", symbols.exact(own, "Parser")).unionByName(one("any case", symbols.exact(own, "pARSER", True))).unionByName(one("find", symbols.find(own, "pars", "parser.rs")))


@query(_is([("lexer", 0, 0), ("reader", 0, 1), ("token", 1, 0)], "expansion, source, rank"))
def expansion_lookup(spark, sf_dir):
    """Expansions out of two learned tables, the first one's first, each once."""
    kind = "term string, expansion string, rank int"
    tables = [spark.createDataFrame(rows, kind) for rows in ([("parse", "lexer", 0), ("parse", "reader", 1), ("other", "x", 0)], [("parse", "token", 0), ("parse", "lexer", 1)])]
    return concepts.expansions("parse", tables).select("expansion", "first.source", "first.rank")


# Assembly.


@query(_is([("window", "2-5"), ("all", "abcd"), ("cut", "abcdefgh\n... (truncated)"), ("snippet", "0\n1\n    ... (2 lines)\n4")], "what, text"))
def truncation(spark, sf_dir):
    """A window of lines within a budget, texts cut to tokens, a snippet cut to lines."""
    lines = "\n".join(["long line of many words"] * 2 + ["ab", "cd", "ef"] + ["long line of many words"] * 2)
    a, b = assemble.strict_window(lines, 3, 5)
    rows = [("window", f"{a}-{b}"), ("all", assemble.truncate_to_budget("abcd", 1)), ("cut", assemble.truncate_to_budget("abcdefgh" * 9, 6)), ("snippet", assemble.truncate_snippet("0\n1\n2\n3\n4", 4))]
    return spark.createDataFrame(rows, "what string, text string")


@query(_is([("imports", "i1", 30), ("imports", "i3", 5), ("callees", "c1", 30), ("examples", "e2", 20)], "section, file_path, tokens"))
def cross_file_context(spark, sf_dir):
    """100 of 200 tokens are left: 40 for imports, 30 for callees, 30 for examples; what does not fit is passed over."""
    kind = "file_path string, rank int, tokens int"
    table = lambda rows: spark.createDataFrame(rows, kind)
    main = spark.createDataFrame([(60,), (40,)], "tokens int")
    found = assemble.cross_file_context(main, table([("i1", 0, 30), ("i2", 1, 20), ("i3", 2, 5)]), table([("c1", 0, 30), ("c2", 1, 1)]), table([("e1", 0, 31), ("e2", 1, 20)]), 200)
    return found.select("section", "file_path", "tokens")


@query(
    _is(
        [
            ("must_read", "src/n.rs", 1.0), ("must_read", "src/m.rs", 1.0), ("must_read", "tests/t.rs", 0.55), ("must_read", "_external/jira/x.md", 1.0),
            ("symbols", "src/parser.rs:parse_data", None), ("tests", "tests/t.rs", None), ("docs", "_external/jira/x.md", None),
        ],
        "part, item, score",
    )
)
def agent_pack(spark, sf_dir):
    """The pack of a task: results with tests demoted, pinned definitions, tests and documents."""
    own = _results(spark).where("content like '%parse%'")
    pack = json.loads(assemble.agent_pack("parse_data", own, code.symbols(repo(spark)), own.where("file_path like 'tests/%'"), own.where("file_path like '%.md'"), 4000))
    rows = [("must_read", x["file"], x["score"]) for x in pack["must_read"]] + [("symbols", f"{x['file']}:{x['name']}", None) for x in pack["symbols"]]
    rows += [(part, x, None) for part in ("tests", "docs") for x in pack[part]]
    return spark.createDataFrame(rows, "part string, item string, score double")


@query(_is([("full", 3, 2, 2), ("small", 0, 0, 2)], "budget, docs, symbols, must_read"))
def pack_budget(spark, sf_dir):
    """Documents go first, then symbols; what must be read stays longest."""
    pack = {"docs": ["d" * 90] * 3, "symbols": ["s" * 90] * 2, "tests": [], "orientation": [], "must_read": ["m", "n"]}
    kept = {"full": assemble.enforce_budget(pack, 1000), "small": assemble.enforce_budget(pack, 40)}
    return spark.createDataFrame([(k, len(p["docs"]), len(p["symbols"]), len(p["must_read"])) for k, p in kept.items()], "budget string, docs int, symbols int, must_read int")


@query(_is([("# Onboarding\n\n3 files in 2 languages.\n\nRead first:\n- b\n- a", "b,a")], "text, page"))
def onboarding(spark, sf_dir):
    """The onboarding text, and the files of the dashboard's page in order."""
    ranks = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 0.1)], "node string, rank double")
    files = spark.createDataFrame([("a", "rust"), ("b", "rust"), ("c", "go")], "file_path string, lang string")
    edges = spark.createDataFrame([("a", "b", "Calls"), ("c", "a", "Calls")], "src string, dst string, kind string")
    page = assemble.dashboard(ranks, edges, 2)
    data = json.loads(page.split("type=application/json>")[1].split("</script>")[0])
    return spark.createDataFrame([(assemble.onboarding(files, ranks, 2), ",".join(n["id"] for n in data["nodes"]))], "text string, page string")


# Stored trees.


@query(_is([("src/main.rs", 12), ("docs/a.md", 3)], "file_path, size"))
def source_tree_scan(spark, sf_dir):
    """A folder's indexable files: hidden, excluded, ignored, unknown and too large ones are left out."""
    root = scratch_folder(spark, "tree")
    files = {"src/main.rs": "fn main() {}", "docs/a.md": "abc", ".git/x.rs": "no", "node_modules/y.js": "no", "build.log.txt": "no", "data.bin": "no", "big.rs": "x" * 60}
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, text in files.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}"))
        out.write(bytearray(text.encode()))
        out.close()
    return scan(spark, root, ["*.log.txt"], 50).select("file_path", "size")


@query(_is([(1, "a"), (2, "a"), (2, "b")], "generation, file_path"))
def index_generations(spark, sf_dir):
    """What readers of a stored index see before and after the second generation is published."""
    store = Generations(spark, scratch_folder(spark, "generations"))
    table = lambda *paths: {"files": spark.createDataFrame([(p,) for p in paths], "file_path string")}
    first = store.publish(table("a"))
    before = store.read("files").select(F.lit(first).alias("generation"), "file_path")
    second = store.publish(table("a", "b"))
    return before.unionByName(store.read("files").select(F.lit(second).alias("generation"), "file_path"))
