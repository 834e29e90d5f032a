"""Semantics that SQL cannot say, on small fixtures with results derived by hand."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators import assemble, concepts, corpus, graph, history, rank, retrieve, symbols, vectors
from seine.operators.components import connected_components
from seine.plans import rewrite, trigrams
from seine.sources import code, docs
from seine.sources.tree import Generations, scan
from seine.streaming import feeds


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (100, 101)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    found = connected_components(spark.createDataFrame(chain + star, "src long, dst long"))
    want = [(i, 0) for i in range(41)] + [(i, 100) for i in (100, 101, 102)] + [(1000 + i, 1000) for i in range(200)]
    assert values(found, "node", "component") == sorted(want)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_code_tokens(spark):
    df = spark.createDataFrame([("fooBar HTTPServer2 snake_case.attr x", "getHTTPResponse_v2")], "a string, b string")
    row = df.select(X.code_tokens(F.col("a")).alias("a"), X.identifier_words(F.col("b")).alias("b"), X.identifier_parts(F.col("b")).alias("c")).first()
    assert row["a"] == ["foo", "bar", "foobar", "http", "server2", "httpserver2", "snake", "case", "attr", "snake_case.attr", "x"]
    assert row["b"] == ["get", "http", "response", "v2", "gethttpresponse_v2"] and row["c"] == ["get", "http", "response", "v2"]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("src/a.rs", "tests/test_a.py", "node_modules/x.js", "Dockerfile.dev", "api/openapi.json", "a.unknown", "bin/main.go")], "file_path string")
    p = F.col("file_path")
    got = {r[0]: tuple(r)[1:] for r in df.select(p, X.language_of(p), X.indexable(p), X.ranks_as_test(p), X.entry_point(p)).collect()}
    assert got["src/a.rs"] == ("rust", True, False, False) and got["tests/test_a.py"] == ("python", True, True, False)
    assert got["node_modules/x.js"][1] is False and got["Dockerfile.dev"][0] == "dockerfile" and got["api/openapi.json"][0] == "openapi"
    assert got["a.unknown"][:2] == (None, False) and got["bin/main.go"][3]


@pytest.mark.parametrize("pattern", ["needle", "foo.*barn", "(abcd|wxyz)[0-9]+", "a+bcdef", "x?yz", "(?i)Needle", "nee(dle)?s", "^start.{2,5}"])
def test_trigram_plan_is_sound(spark, pattern):
    texts = ["a needle here", "foo and barn", "abcd9", "wxyz12 q", "aaabcdef", "yz", "NEEDLE", "nees", "needles", "start of", "nothing at all", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    kept = {r["id"] for r in trigrams.execute(trigrams.of_regex(pattern), retrieve.trigrams(df, "id", "text"), df, "id").collect()}
    assert kept >= {i for i, t in enumerate(texts) if re.search(pattern, t)}


def test_trigram_plan_shapes():
    assert trigrams.of_regex("ab") == trigrams.ALL and trigrams.of_regex("abc|x") == trigrams.ALL
    assert trigrams.of_regex("abcd") == ("and", ("tri", "abc"), ("tri", "bcd")) and trigrams.of_regex("abc|xyz") == ("or", ("tri", "abc"), ("tri", "xyz"))


def test_glob():
    assert re.match(retrieve.glob_regex("src/**/*.{rs,py}"), "src/a/b.rs") and re.match(retrieve.glob_regex("src/**/*.rs"), "src/b.rs") and not re.match(retrieve.glob_regex("*.rs"), "src/b.rs")


def test_exact_falls_back_only_when_few(spark):
    chunks = spark.createDataFrame([("c1", "a", 0, "x needle"), ("c2", "b", 0, "y"), ("c3", "c", 0, "needle needle")], "chunk_id string, file_path string, line_start int, content string")
    other = spark.createDataFrame([("c2", "b", 0, 9.0), ("c1", "a", 0, 8.0)], "chunk_id string, file_path string, line_start int, score double")
    assert [r["chunk_id"] for r in retrieve.exact_with_fallback(chunks, "needle", other, 10).collect()] == ["c3", "c1", "c2"]
    many = chunks.withColumn("content", F.lit("needle"))
    assert retrieve.exact_with_fallback(many, "needle", other, 10).count() == 3


RESULTS = [("a1", "a", 0, 40, "t", 10.0), ("a2", "a", 30, 60, "t", 9.0), ("a3", "a", 60, 90, "t", 8.0), ("a4", "a", 120, 150, "t", 2.0), ("b1", "b", 0, 9, "t", 5.0)]
SCHEMA = "chunk_id string, file_path string, line_start int, line_end int, content string, score double"


def test_dedup(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    assert values(rank.overlap_dedup(df), "chunk_id") == [("a1",), ("a3",), ("a4",), ("b1",)]
    assert values(rank.file_dedup(df), "chunk_id") == [("a1",), ("a3",), ("b1",)]
    assert values(rank.truncate_at_cliff(df, 3, 0.2), "chunk_id") == [("a1",), ("a2",), ("a3",)]
    staged = rank.pipeline(df, [rank.test_demotion, rank.overlap_dedup])
    assert staged.count() == 4


def test_usage_and_path(spark):
    rows = [("u1", "src/x.rs", 0, 3, "use crate::parse;", 1.0), ("u2", "src/y.rs", 0, 3, "parse(1)", 1.0), ("u3", "src/p.rs", 0, 3, "fn parse() {}", 1.0), ("u4", "README.md", 0, 3, "parse(2)", 1.0), ("u5", "tests/z.rs", 0, 3, "parse(3)", 1.0)]
    got = {r["file_path"]: round(r["score"], 4) for r in rank.usage_rank(spark.createDataFrame(rows, SCHEMA), "parse").collect()}
    assert got == {"src/x.rs": 2.4, "src/y.rs": 1.6, "src/p.rs": 0.02, "README.md": 0.016, "tests/z.rs": 0.4}


def test_mmr(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.01]), (1, 3, 0.7, [0.0, 1.0])]
    got = rank.mmr(spark.createDataFrame(rows, "query_id long, key long, relevance double, vector array<double>"), 3)
    assert values(got, "step", "key") == [(0, 1), (1, 3), (2, 2)]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "Resolved") for a, b in pairs], "src string, dst string, kind string")


def test_graph(spark):
    e = edges_of(spark, [("main", "engine"), ("main", "parser"), ("engine", "parser"), ("parser", "__ext__:std")])
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(e).collect()}
    assert max(ranks, key=ranks.get) == "parser" and ranks["parser"] == 1 and "__ext__:std" not in ranks
    cycle = edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    start = spark.createDataFrame([("a",)], "node string")
    assert values(graph.reachable(cycle, start, 5), "node", "depth") == [("a", 2), ("b", 1), ("c", 2)]
    paths = {r["node"]: r["path"] for r in graph.shortest_paths(edges_of(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d")]), "a").collect()}
    assert paths["d"] == ["a", "b", "d"]
    assert values(graph.layers(edges_of(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")])), "node", "layer") == [("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None)]


def test_pagerank_against_numpy(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 12, (40, 2)) if a != b})
    names = sorted({x for p in pairs for x in p})
    m = np.zeros((len(names), len(names)))
    for a, b in pairs:
        m[names.index(b), names.index(a)] = 1
    out = m.sum(0)
    r = np.full(len(names), 1 / len(names))
    for _ in range(20):
        r = 0.15 / len(names) + 0.85 * (m / np.maximum(out, 1) @ r + r[out == 0].sum() / len(names))
    seeds = spark.createDataFrame([(names[0], 1.0), (names[3], 3.0), ("nowhere", 9.0)], "node string, weight double")
    got = {x["node"]: x["rank"] for x in graph.pagerank(edges_of(spark, pairs), tolerance=0.0).collect()}
    assert np.allclose([got[n] for n in names], r / r.max(), atol=1e-9)
    alone = edges_of(spark, [("a", "b"), ("c", "__ext__:x")])  # c has no real edge, yet is a node
    assert values(graph.pagerank(alone), "node") == [("a",), ("b",), ("c",)]
    jump = np.zeros(len(names))
    jump[0], jump[3] = 0.25, 0.75
    r = jump.copy()
    for _ in range(5):
        r = jump * (0.15 + 0.85 * r[out == 0].sum()) + 0.85 * (m / np.maximum(out, 1) @ r)
    got = {x["node"]: x["rank"] for x in graph.pagerank(edges_of(spark, pairs), seeds, rounds=5, tolerance=0.0, relative=False).collect()}
    assert np.allclose([got[n] for n in names], r, atol=1e-9)


def test_layers_have_no_bound(spark):
    chain = edges_of(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(52)])
    assert values(graph.layers(chain), "node", "layer") == [(f"n{i:02}", i) for i in range(53)]


def test_louvain_finds_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    e = edges_of(spark, [*clique("a"), *clique("b"), ("a0", "b0")])
    got = {r["node"]: r["community"] for r in graph.louvain(e).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 == len({got[f"b{i}"] for i in range(4)}) and got["a1"] != got["b1"]
    q = graph.modularity(e, graph.louvain(e)).first()[0]
    assert q == pytest.approx(24 / 26 - 2 * 13 * 13 / 26 / 26)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got = vectors.top_k(base, base.where("vec_id < 5"), 7).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        want = [int(i) for i in np.argsort(-(u @ u[q])) if i != q][:7]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    codes, book = vectors.product_codes(base, 4, 8)
    assert codes.count() == 200 and book.shape == (4, 8, 4)


def test_vectors_answer_any_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(y) for y in rng.integers(-1, 2, 3)]) for i in range(120)]  # few values: many ties
    base = spark.createDataFrame(rows + [(500, None), (501, [1.0, None, 1.0]), (502, [1.0, 2.0]), (503, [])], "vec_id long, vector array<double>").repartition(3)
    whole = values(vectors.top_k(base, base, 4), "query_id", "rank", "vec_id")
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 30)
    assert values(vectors.top_k(base, base, 4), "query_id", "rank", "vec_id") == whole
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in rows}
    want = []
    for q in unit:
        best = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i in unit if i != q)[:4]
        want += [(q, r, i) for r, (_, i) in enumerate(best)]
    assert [x for x in whole if x[0] < 500] == want
    assert [x[0] for x in whole if x[0] >= 500] == []  # 502 has no other vector of its length


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_approximate_searches_reach_nine_of_ten(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32)) + (6 * rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)] if kind == "clusters" else 0)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>").cache()
    asked = base.where("vec_id % 50 = 0")
    exact = {(r[0], r[1]) for r in vectors.top_k(base, asked, 10).select("query_id", "vec_id").collect()}
    index, centres = vectors.cell_index(base)
    found = {(r[0], r[1]) for r in vectors.approximate_top_k(index, centres, asked, 10).select("query_id", "vec_id").collect()}
    assert index.count() == 3000 and len(found & exact) >= 0.9 * len(exact)
    nearest = {(int(q), int(i)) for q in range(0, 3000, 50) for i in ((x - x[q]) ** 2).sum(1).argsort()[:10]}
    codes, book = vectors.product_codes(base)
    found = {(r[0], r[1]) for r in vectors.quantized_top_k(codes, book, base, asked, 10).select("query_id", "vec_id").collect()}
    assert len(found & nearest) >= 0.9 * len(nearest)


def test_vectors_of_an_empty_table(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, vector array<float>")
    assert vectors.top_k(none, none, 3).count() == 0
    codes, book = vectors.product_codes(none)
    assert codes.count() == 0 and vectors.quantized_top_k(codes, book, none, none, 3).count() == 0
    index, centres = vectors.cell_index(none)
    assert index.count() == 0 and vectors.approximate_top_k(index, centres, none, 3).count() == 0


def test_stored_index_and_parsed_queries(spark):
    docs = spark.createDataFrame(
        [(1, ["parseData"], ["fn", "parseData"]), (2, ["other"], ["uses", "parse", "and", "data"]), (3, ["Other"], ["nothing", "here"]), (4, [], ["data", "x.parse"])],
        "id long, entity array<string>, content array<string>",
    )
    fields = {"entity": F.col("entity"), "content": F.col("content")}
    index = retrieve.clustered(retrieve.postings(docs, "id", fields, X.word_tokens), "id").cache()
    terms = {(r["field"], r["term"], r["id"]): (r["tf"], r["dl"]) for r in index.collect()}
    assert terms["content", "parsedata", 1] == (1, 4) and terms["entity", "parse", 1] == (1, 3) and terms["content", "x.parse", 4] == (1, 4)
    assert retrieve.parse('+parseData entity:other -"a b" x:y') == [
        ("+", None, ["parse", "data", "parsedata"]), ("", "entity", ["other"]), ("-", None, ["a", "b"]), ("", None, ["x"]), ("", None, ["y"]),
    ]
    found = lambda q: [r["id"] for r in retrieve.search(index, "id", q).orderBy(F.desc("score"), "id").collect()]
    assert found("parse data") == [1, 4, 2] or set(found("parse data")) == {1, 2, 4}
    assert found("parseData")[0] == 1 and set(found("+parse -uses")) == {1, 4} and found("entity:other") == [2, 3] and found('"parse and"') == [2]
    assert found('"nothing data"') == [] and found("") == [] and found("zzz") == []
    plain = {r["id"]: r["score"] for r in retrieve.bm25(index, "id", ["parse", "data"], retrieve.BOOSTS).collect()}
    assert {r["id"]: round(r["score"], 9) for r in retrieve.search(index, "id", "parse data").collect()} == {i: round(x, 9) for i, x in plain.items()}


def test_rewrite():
    assert rewrite.strategy_of("parseData") == "goto" and rewrite.strategy_of("parse") == "instant" and rewrite.strategy_of('"a b"') == "exact"
    assert rewrite.expand("getUserName") == "getUserName get user name get_user_name"
    got = rewrite.reformulations("how to parse config files")
    assert got[:4] == ["how to parse config files", "parse config files", "ParseConfigFiles", "parse_config_files"] and any("settings" in x for x in got)
    assert rewrite.intent("parse the Config token") == {"verbs": ["parse"], "types": ["Config"], "nouns": ["token"]}
    assert rewrite.route("how to write a guide")[0] == "docs" and rewrite.route("fn parse_data")[0] == "code" and rewrite.route("x y")[0] == "hybrid"
    assert rewrite.path_references("see `a b` and src/x.rs or a.b.c") == ["a b", "src/x.rs", "a/b/c"] and rewrite.quoted('a"b') == '"a\\"b"'


def test_sections():
    assert docs.html("<body>pre<h1>A</h1>x<script>no</script><div><h2>B</h2>y z</div></body>") == [(0, "", "pre"), (1, "A", "x"), (2, "B", "y z")]
    assert docs.rst("Top\n===\nx\n\nSub\n---\ny\n\nNext\n====\nz") == [(1, "Top", "x"), (2, "Sub", "y"), (1, "Next", "z")]
    assert docs.asciidoc("= A\nx\n== B\ny") == [(1, "A", "x"), (2, "B", "y")]
    assert docs.openapi('{"info": {"title": "T"}, "paths": {"/a": {"post": {"summary": "s"}, "get": {}}}}') == [(1, "T", ""), (2, "GET /a", ""), (2, "POST /a", "s")]
    assert docs.fold_sections(["a" * 50, "b" * 50, "c" * 300]) == ["a" * 50 + "\n\n" + "b" * 50, "c" * 300]
    assert docs.code_chunks("x\n" * 5, []) == [(0, 6)]
    cut = docs.code_chunks("\n".join(["y" * 100] * 40), [(0, 19), (20, 39)])
    assert cut[0][0] == 0 and cut[-1][1] == 40 and all(a[1] == b[0] for a, b in zip(cut, cut[1:])) and max(b - a for a, b in cut) <= 15


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("generously", "generous"), ("national", "nation"), ("skies", "sky"), ("agreed", "agre"), ("conflated", "conflat"), ("by", "by"), ("say", "say"), ("controlling", "control")])
def test_stem(word, want):
    assert docs.stem(word) == want


def test_python_symbols_and_fingerprint():
    got = list(code.symbols_of("class A:\n    def f(self):\n        '''Doc.'''\n\ndef _g(): pass\n", "python"))
    assert [(g[0], g[1], g[2], g[5], g[6]) for g in got] == [("A", "class", 0, "public", None), ("f", "method", 1, "public", "Doc."), ("_g", "function", 4, "private", None)]
    a, b, c = "pub fn f() {\n  1\n}\n", "pub fn f() {\n  2\n}\n", "pub fn g() {\n  1\n}\n"
    assert code.signature_fingerprint(a) == code.signature_fingerprint(b) != code.signature_fingerprint(c)


def test_assembly(spark):
    text = "\n".join(["aaaa"] * 10)
    a, b = assemble.strict_window(text, 5, 5)
    assert a <= 5 < b and b - a == 4
    assert assemble.truncate_to_budget("abcd" * 10, 100) == "abcd" * 10 and len(assemble.truncate_to_budget("é" * 100, 10).encode()) <= 40
    assert assemble.truncate_snippet("\n".join(map(str, range(50)))).count("\n") == 19
    pack = assemble.enforce_budget({"docs": ["d" * 100] * 5, "symbols": [], "tests": [], "orientation": [], "must_read": ["m"]}, 60)
    assert pack["must_read"] == ["m"] and len(pack["docs"]) < 5
    parts = spark.createDataFrame([("a", 0, 5), ("b", 1, 100), ("c", 2, 4)], "file_path string, rank int, tokens int")
    got = assemble.cross_file_context(spark.createDataFrame([(75,)], "tokens int"), parts, parts.limit(0), parts.limit(0), 100)
    assert values(got, "file_path") == [("a",), ("c",)]


def test_history(spark):
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 1, 1)], "file_path string, mtime long, size long")
    then = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("d", 1, 1)], "file_path string, mtime long, size long")
    assert values(history.staleness(now, then), "file_path", "change") == [("b", "modified"), ("c", "added"), ("d", "removed")]


def test_expansions(spark):
    a = spark.createDataFrame([("x", "one", 0), ("x", "two", 1)], "term string, expansion string, rank int")
    b = spark.createDataFrame([("x", "two", 0), ("x", "three", 1), ("y", "no", 0)], "term string, expansion string, rank int")
    assert [r["expansion"] for r in concepts.expansions("x", [a, b]).collect()] == ["one", "two", "three"]


def test_scan_and_generations(spark, tmp_path):
    (tmp_path / "src/.hidden").mkdir(parents=True)
    (tmp_path / "target").mkdir()
    for name, text in {"src/a.py": "def f(): pass", "src/b.log.txt": "x", "target/c.py": "no", "src/.hidden/d.py": "no", "src/big.py": "x" * 100, "src/e.bin": "no"}.items():
        (tmp_path / name).write_text(text)
    found = scan(spark, str(tmp_path), ["*.log.txt"], 50)
    assert values(found, "file_path", "content") == [("src/a.py", "def f(): pass")]
    store = Generations(spark, str(tmp_path / "index"))
    assert store.active() is None
    store.publish({"files": found})
    store.publish({"files": found.limit(0)})
    assert store.active() == 2 and store.read("files").count() == 0
    store.prune(1)
    assert not (tmp_path / "index/gen=1").exists()


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


EVENTS = "ts timestamp, kind string, file_path string, agent_id long, seq long"


def test_streams(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [(at(0), "read", "a", 1, 0), (at(5), "write", "a", 1, 1), (at(20), "read", "b", 2, 2), (at(300), "read", "z", 3, 3)]
    feed = stream(spark, tmp_path, rows, EVENTS)
    run = feeds.windowed_activity(feed).writeStream.format("memory").queryName("act").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert values(spark.sql("select file_path, events from act"), "file_path", "events") == [("a", 2), ("b", 1)]
    run = feeds.running_boosts(feed).writeStream.format("memory").queryName("boost").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["file_path"]: r["boost"] for r in spark.sql("select * from boost").collect()}
    assert got["a"] == pytest.approx(0.12 * np.exp(-5 / 15) + 0.2) and got["b"] == pytest.approx(0.12)
    seen = []
    changes = feed.select("file_path", F.col("kind").alias("change"), "seq")
    feeds.upsert_into(changes, lambda df: seen.extend(values(df, "file_path", "change")), str(tmp_path / "c3")).awaitTermination()
    assert seen == [("a", "write"), ("b", "read"), ("z", "read")]


def test_engine_parts(spark):
    from seine.operators import engine

    log = spark.createDataFrame([("CHANGELOG.md", "# Log\n\n## 1.2.0\n- a\n\n## [0.9.1-rc1] x\n- b\n"), ("other.md", "## 1.0")], "file_path string, content string")
    assert values(engine.changelog_sections(log), "version", "content") == [("0.9.1-rc1", "## [0.9.1-rc1] x\n- b"), ("1.2.0", "## 1.2.0\n- a")]
    sign = spark.createDataFrame([("fn f(a: Config, b: Vec<Item>) -> Result<Out, Err>",)], "s string")
    row = sign.select(*engine.signature_types(F.col("s"))).first()
    assert row[0] == ["Config", "Vec", "Item"] and row[1] == ["Result", "Out", "Err"]
    rows = [("1", "a.h", 0, 1, "", 1.0), ("2", "a.c", 0, 1, "fn x", 1.0), ("3", "b.h", 0, 1, "", 1.0), ("4", "_external/gh/i.md", 0, 1, "", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert values(engine.demote_headers(df), "chunk_id", "score") == [("1", 0.6), ("2", 1.0), ("3", 0.85), ("4", 1.0)]
    assert values(engine.filter_docs(df, "docs"), "chunk_id") == [("4",)] == values(engine.filter_source(df, "gh"), "chunk_id")
    assert engine.filter_source(df, "internal").count() == 3 and values(engine.filter_kind(df, "function"), "chunk_id") == [("2",)]
    assert values(engine.rerank("fn y", df), "chunk_id", "score")[1] == ("2", 0.5)
    tree = spark.createDataFrame([("Cargo.toml",), ("web/package.json",), ("x/y.rs",)], "file_path string")
    assert values(engine.discover_projects(tree), "root", "kind") == [("", "cargo"), ("web", "npm")]


def test_progressive(spark):
    from seine.operators import engine

    df = spark.createDataFrame(RESULTS, SCHEMA)
    steps = dict(engine.progressive("t config", lambda q, n: df, 3))
    assert list(steps) == ["bm25", "fused", "reranked"] and steps["fused"].count() == 3 == steps["reranked"].count()


def test_rename_and_tests(spark):
    rows = [("a.rs", "foo(foo_bar) foo"), ("b.rs", "bar"), ("c.rs", "foo bar")]
    own = spark.createDataFrame(rows, "file_path string, content string")
    table = spark.createDataFrame([("bar", "b.rs"), ("bar", "a.rs")], "name string, file_path string")
    assert values(symbols.rename_hazards(own, table, "foo", "bar"), "file_path", "occurrences", "hazard") == [("a.rs", 2, "collision"), ("c.rs", 1, "shadowing")]
    assert values(symbols.rename(own, "foo", "x"), "content")[2] == ("x(foo_bar) x",)


def test_concept_and_session_boost_caps(spark):
    df = spark.createDataFrame(RESULTS[:1], SCHEMA)
    clusters = spark.createDataFrame([("t", "a", "c", 100.0)], "term string, file_path string, cluster string, score double")
    assert rank.concept_boost(df, clusters, ["t"]).first()["score"] == 25.0
    boosts = spark.createDataFrame([("a", 0.25)], "file_path string, boost double")
    assert rank.session_boost(df, boosts, boosts).first()["score"] == pytest.approx(13.0)


def _plain_louvain(around):
    order = sorted(around)
    degree = {v: len(around[v]) for v in order}
    double = sum(degree.values())
    of, held = {v: i for i, v in enumerate(order)}, {i: degree[v] for i, v in enumerate(order)}
    moved = True
    while moved:
        moved = False
        for v in order:
            own, into = of[v], {}
            for u in around[v]:
                into[of[u]] = into.get(of[u], 0) + 1
            held[own] -= degree[v]
            best, gain = own, into.get(own, 0) - held[own] * degree[v] / double
            for c in sorted(into):
                g = into[c] - held[c] * degree[v] / double
                if g > gain + 1e-10:
                    best, gain = c, g
            held[best] += degree[v]
            of[v], moved = best, moved or best != own
    return [of[v] for v in order]


@pytest.mark.parametrize("most, links", [(4096, 1_000_000), (3, 20)])
def test_louvain_moves_equal_a_plain_fold(most, links):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n, m = int(rng.integers(2, 90)), int(rng.integers(1, 400))
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        if seed % 2:  # two sides without a link among themselves: long runs
            x, y = x % (n // 2), n // 2 + y % (n - n // 2)
        pairs = sorted({(min(p), max(p)) for p in zip(x.tolist(), y.tolist()) if p[0] != p[1]}) or [(0, 1)]
        place = {v: i for i, v in enumerate(sorted({v for p in pairs for v in p}))}
        a, b = (np.array([place[p[i]] for p in pairs], np.int32) for i in (0, 1))
        around = {}
        for u, v in zip(a.tolist(), b.tolist()):
            around.setdefault(u, set()).add(v)
            around.setdefault(v, set()).add(u)
        ptr, adj = graph._adjacency(a, b, block=7)
        assert all(set(adj[ptr[v] : ptr[v + 1]].tolist()) == around[v] for v in around)
        assert graph.local_moves(ptr, adj, 100, most, links).tolist() == _plain_louvain(around)


def test_quantized_search_is_exact_beyond_its_shortlist(spark):
    rng = np.random.default_rng(3)
    x = np.round(8 * rng.normal(size=(900, 8))) / 8  # sums are exact
    x[600:] = x[rng.integers(0, 40, 300)]  # copies: ties at the k-th place
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>").repartition(3).cache()
    asked = base.where("vec_id % 30 = 0")
    codes, book = vectors.product_codes(base, 2, 4)  # coarse: its shortlist of ten misses many
    got = values(vectors.quantized_top_k(codes, book, base, asked, 10, shortlist=10), "query_id", "rank", "vec_id")
    want = []
    for q in range(0, 900, 30):
        far = [(sum((float(a) - float(b)) * (float(a) - float(b)) for a, b in zip(x[q], v)), i) for i, v in enumerate(x)]
        want += [(q, r, i) for r, (_, i) in enumerate(sorted(far)[:10])]
    assert got == sorted(want)


def _exchanges(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_postings_are_segments_of_whole_documents(spark):
    docs = spark.createDataFrame([(i, f"fooBar of w{i % 7} the the x_{i}") for i in range(60)], "id long, text string")
    index = retrieve.clustered(retrieve.postings(docs, "id", {"content": X.code_words(F.col("text"))}, X.word_tokens), "id")
    found = _exchanges(index)
    assert len(found) == 1 and "hashpartitioning(id" in found[0]  # texts, dealt before they are split
    parts = index.select("id", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 60  # every document in one segment
    assert values(retrieve.field_statistics(index, "id"), "field", "n", "avgdl") == [("content", 60, 10.0)]


def _plain_postings(docs, splits):
    """Postings by counting: rows of one key are one document."""
    tf = Counter((f, t, r[0]) for r in docs for f, words in zip(splits, r[1:]) for w in words or [] for t in (X.tokens_of_word(w) if splits[f] and w is not None else [w]))
    dl = Counter()
    for (f, _, k), n in tf.items():
        dl[f, k] += n
    return Counter({(f, t, k, n, dl[f, k]): 1 for (f, t, k), n in tf.items()})


@pytest.mark.parametrize("most", [1, 5, 40, 4_000_000])
def test_postings_are_counted_in_runs(spark, monkeypatch, most):
    docs = [(i % 23, [f"fooBar{i % 3}", "the", "the.", "x_Y", None, "..."][: i % 7], ["The", f"a{i}"]) for i in range(80)]
    docs += [(None, ["nul", "Key"], None), (None, ["nul"], []), (99, None, None), (100, [], ["z"]), *[(101, [f"w{j % 9}"], None) for j in range(60)]]
    monkeypatch.setattr(retrieve, "RUN", most)
    monkeypatch.setattr(retrieve, "POSTINGS_AT_ONCE", 7)
    df = spark.createDataFrame(docs, "id long, a array<string>, b array<string>")
    fields = {"a": F.col("a"), "b": F.col("b")}
    for tokens, splits in ((X.word_tokens, {"a": 1, "b": 1}), ({"a": X.word_tokens}, {"a": 1, "b": 0}), ({"a": lambda w: X.word_tokens(w)}, {"a": 1, "b": 0}), (None, {"a": 0, "b": 0})):
        found = retrieve.postings(df, "id", fields, tokens)
        want = _plain_postings(docs, splits)
        assert Counter(map(tuple, found.collect())) == want
        counts = retrieve.term_counts(df, "id", fields, tokens)
        assert sorted(map(str, counts.collect())) == sorted(map(str, retrieve.term_statistics(found).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "[term" not in "".join(x for x in plan.splitlines() if "Sort" in x)
    assert retrieve.postings(df.limit(0), "id", fields).count() == 0 == retrieve.term_counts(df.limit(0), "id", fields).count()


def test_one_word_splits_in_python_as_in_spark(spark):
    cased = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Nd", "Nl", "No")]
    forms = [f for c in cased for f in (c, f"a{c}b", f"A{c}b", f"x.{c}Q_{c}{c}z", f"A{c}")] + ["...", "_a__B.", "HTTPServer2Go", "ΟΔΟΣ", "ΣAΣ.ΑΣ"]
    df = spark.createDataFrame([(f,) for f in forms], "w string").where(F.col("w").rlike(r"^[\p{L}\p{N}_.]+$"))  # what the text's splitter gives
    found = df.select("w", X.word_tokens(F.col("w")).alias("t")).collect()
    assert len(found) > 20_000 and [r for r in found if r["t"] != X.tokens_of_word(r["w"])] == []
    plain = regex.compile(X.word_tokens.plain.replace("$", r"\Z"))
    assert all(r["t"] == [r["w"]] for r in found if plain.match(r["w"]))


def test_trigrams_leave_in_bounded_batches(spark, monkeypatch):
    texts = ["abcabcabd", None, "", "ab", "é\U0001f600x\U0001f600é", "z" * 50, "".join(map(chr, range(0x4E00, 0x4E40))), "the\nend of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    want = sorted({(t[k : k + 3], i) for i, t in enumerate(texts) if t for k in range(len(t) - 2)})
    for most in (200_000, 9):
        monkeypatch.setattr(retrieve, "TRIGRAMS_AT_ONCE", most)
        found = retrieve.trigrams(docs, "id", "text")
        assert values(found, "trigram", "id") == want and found.count() == len(want)
    index = retrieve.clustered_trigrams(found, "id")
    assert len(_exchanges(index)) == 1 and values(index, "trigram", "id") == want


def test_changed_trigrams_leave_the_base_where_it_is(spark, monkeypatch):
    texts = [(i, f"text {i} of some words") for i in range(40)]
    base = retrieve.trigrams(spark.createDataFrame(texts, "id long, text string"), "id", "text").localCheckpoint()
    changed = [(3, "other"), (5, None), (41, "new text")]
    want = sorted({(t[k : k + 3], i) for i, t in (dict(texts) | dict(changed)).items() if t for k in range(len(t) - 2)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = retrieve.changed_trigrams(base, spark.createDataFrame(changed, "id long, text string"), "id", "text")
        plan = now._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert values(now, "trigram", "id") == want
        monkeypatch.setattr(retrieve, "MOST_SENT", 1)
        monkeypatch.setattr(retrieve, "MOST_CHANGED", 1)
        assert values(retrieve.changed_trigrams(base, spark.createDataFrame(changed, "id long, text string"), "id", "text"), "trigram", "id") == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_surprising_edges_keep_no_list_before_the_best(spark, data):
    from seine.queries import graphs

    plan = _plan(graphs.surprising_edges(spark, data))
    assert "TakeOrderedAndProject(limit=25" in plan and "GlobalLimit" not in plan and "limit=1000000" not in plan


def test_dedup_folds_stream_over_files_in_small_batches(spark):
    rng = np.random.default_rng(5)
    lines = [(f"c{i}", f"f{i % 4}", int(rng.integers(0, 200)), float(rng.integers(1, 6))) for i in range(150)]
    df = spark.createDataFrame([(c, f, a, a + 37, s) for c, f, a, s in lines], "chunk_id string, file_path string, line_start int, line_end int, score double").repartition(3)
    want = []
    for f in sorted({x[1] for x in lines}):
        kept = []
        for c, _, a, s in sorted((x for x in lines if x[1] == f), key=lambda x: (-x[3], x[2], x[0])):
            if not kept or (s >= 0.7 * kept[0][1] and all(abs(a - k) >= 50 for k, _ in kept)):
                kept.append((a, s))
                want.append((c, s))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert values(rank.file_dedup(df), "chunk_id", "score") == sorted(want)
        assert all("FlatMapGroups" not in _plan(f(df)) for f in (rank.file_dedup, rank.overlap_dedup))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_least_shortest_paths_by_places(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = {(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, 40, (70, 2)).tolist() if a != b}
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    start = min(around)
    want, front = {start: [start]}, {start: [start]}
    for _ in range(6):
        new = {}
        for v, path in front.items():
            for u in around[v] - set(want):
                new[u] = min(new.get(u, [*path, u]), [*path, u])
        want |= new
        front = new
    joined = []
    numbered = graph._numbered
    monkeypatch.setattr(graph, "_numbered", lambda df, *a: joined.append(_plan(df)) or numbered(df, *a))
    got = {r["node"]: list(r["path"]) for r in graph.shortest_paths(edges_of(spark, sorted(pairs)), start, 6).collect()}
    assert got == want and joined and all("SortAggregate" not in p and "array" not in p for p in joined)  # no paths along the links


def test_ranks_deal_nodes_with_lists_of_targets(spark, monkeypatch):
    hub = [("hub", f"n{i}") for i in range(50)] + [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n3", "hub")]
    whole = values(graph.pagerank(edges_of(spark, hub)).selectExpr("node", "round(rank, 9) AS rank"), "node", "rank")
    seen = []
    durable = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name: seen.append((name, durable(df, name))) or seen[-1][1])
    monkeypatch.setattr(graph, "LINKS_AT_ONCE", 10)
    assert values(graph.pagerank(edges_of(spark, hub)).selectExpr("node", "round(rank, 9) AS rank"), "node", "rank") == whole
    links = dict(seen)["links"].selectExpr("size(to) AS n").collect()
    assert sum(r["n"] for r in links) == 60 and max(r["n"] for r in links) < 50


def test_modularity_counts_each_link_once(spark):
    e = edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d")])
    groups = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "node string, community long")
    found = graph.modularity(e, groups)
    assert found.first()[0] == pytest.approx(4 / 6 - 2 * 9 / 36)
    assert sorted((r["x"], r["y"]) for r in graph.pairs_of(e).collect()) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert _plan(found).count("Union") == 0
