"""Whole operations composed of the other operators: searches by strategy, filters, hubs, imports of outside documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators import graph, rank
from seine.plans import rewrite

COLUMNS = ("chunk_id", "file_path", "line_start", "line_end", "content")


# Parts of documents and code.


def symbol_source(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """(name, file_path, source): the best symbol whose name holds a text, and its lines."""
    from seine.operators.symbols import kind_rank

    found = symbols.where(F.lower("name").contains(name.lower()))
    best = found.groupBy().agg(F.min_by(F.struct("name", "file_path", "line", "line_end"), F.struct(kind_rank(F.col("kind")), F.col("file_path"), F.col("line"))).alias("s")).select("s.*")
    cut = F.array_join(F.slice(F.split("content", "\n", -1), F.col("line") + 1, F.col("line_end") - F.col("line") + 1), "\n")
    return files.join(F.broadcast(best.where("name is not null")), "file_path").select("name", "file_path", cut.alias("source"))  # one row


def changelog_sections(files: DataFrame) -> DataFrame:
    """(file_path, section, version, content) of changelogs: one a `## version` heading."""
    own = files.where(F.lower(X.basename(F.col("file_path"))).rlike(r"^(changelog|history|releases)(\.|$)"))
    parts = own.select("file_path", F.posexplode(F.split("content", r"(?m)^(?=## )", -1)).alias("section", "content"))
    version = F.regexp_extract("content", r"^## \[?v?(\d+(?:\.\d+)+[^\]\s]*)", 1)
    return parts.select("file_path", "section", version.alias("version"), F.regexp_replace("content", r"\s+$", "").alias("content")).where("version <> ''")


def pdf_pages(texts: DataFrame) -> DataFrame:
    """(file_path, page, content): extracted text split at form feeds, pages from 1, empty ones left out."""
    found = texts.select("file_path", F.posexplode(F.split("content", "\f", -1)).alias("page", "content"))
    return found.where(F.trim("content") != "").withColumn("page", F.col("page") + 1)


def code_blocks(files: DataFrame) -> DataFrame:
    """(file_path, block, code): text between fences."""
    found = F.regexp_extract_all("content", F.lit("(?s)`{3}[^\n]*\n(.*?)`{3}"), F.lit(1))
    return files.select("file_path", F.posexplode(found).alias("block", "code"))


def signature_types(signature: Column) -> tuple[Column, Column]:
    """Capitalised type names among the parameters and after the arrow."""
    inside = F.regexp_extract(signature, r"\((.*)\)", 1)
    after = F.regexp_extract(signature, r"->\s*(.*)$", 1)
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z]\w*)"), F.lit(1)))
    return names(inside), names(after)


def type_relations(symbols: DataFrame) -> DataFrame:
    """(name, relation, target) out of signatures: implements and extends."""
    rules = [("implements", r"^impl(?:<[^>]*>)?\s+(\w+)\s+for\s+\w+"), ("extends", r"^class\s+\w+\s*\(\s*(\w+)"), ("extends", r"\bextends\s+(\w+)"), ("implements", r"\bimplements\s+(\w+)")]
    each = F.array(*[F.struct(F.lit(kind).alias("relation"), F.regexp_extract("signature", rule, 1).alias("target")) for kind, rule in rules])
    return symbols.select("name", F.explode(each).alias("r")).select("name", "r.*").where("target <> ''").distinct()


def function_complexity(files: DataFrame, symbols: DataFrame, least: int = 1) -> DataFrame:
    """(file_path, name, line, line_end, cc, band) of every function and method, by the branch words of its lines."""
    own = symbols.where("kind in ('function', 'method')").select("file_path", "name", "line", "line_end")
    cut = F.array_join(F.slice(F.split("content", "\n", -1), F.col("line") + 1, F.col("line_end") - F.col("line") + 1), "\n")
    found = own.join(files.select("file_path", "content"), "file_path").withColumn("cc", X.complexity(cut)).where(F.col("cc") >= least)
    return found.select("file_path", "name", "line", "line_end", "cc", X.complexity_band(F.col("cc")).alias("band"))


# Filters over results.

DOC_LANGUAGES = ("markdown", "html", "rst", "asciidoc", "plaintext")


def filter_docs(results: DataFrame, which: str) -> DataFrame:
    """`code`, `docs` or `all`; applied after ranking and limits, so fewer rows may come back."""
    doc = F.coalesce(X.language_of(F.col("file_path")).isin(*DOC_LANGUAGES), F.lit(False))
    return results if which == "all" else results.where(doc if which == "docs" else ~doc)


def filter_source(results: DataFrame, source: str) -> DataFrame:
    """`internal`, `external`, or the name of an outside source (`_external/<name>/`)."""
    path = F.col("file_path")
    if source == "internal":
        return results.where(~path.startswith("_external/"))
    return results.where(path.startswith("_external/" if source == "external" else f"_external/{source}/"))


KINDS = {"function": r"^\s*(pub\s+)?(async\s+)?(fn|def|func|function)\b", "struct": r"^\s*(pub\s+)?struct\b", "class": r"^\s*(export\s+)?class\b", "trait": r"^\s*(pub\s+)?trait\b", "enum": r"^\s*(pub\s+)?enum\b"}


def filter_kind(results: DataFrame, kind: str) -> DataFrame:
    return results.where(F.exists(F.split("content", "\n"), lambda x: x.rlike(KINDS[kind])))


def demote_headers(results: DataFrame) -> DataFrame:
    """Headers x .6 if a file of the same stem with an implementation is among the results, x .85 if any implementation is."""
    path = F.col("file_path")
    stem = F.regexp_replace(path, r"\.[^.]*$", "")
    header, body = path.rlike(r"\.(h|hpp)$"), path.rlike(r"\.(c|cc|cpp|m)$")
    marked = results.withColumn("_stem", stem).withColumn("_any", F.max(body).over(Window.partitionBy()))
    twin = results.where(body).select(stem.alias("_stem"), F.lit(True).alias("_twin")).distinct()
    factor = F.when(header & F.col("_twin"), 0.6).when(header & F.col("_any"), 0.85).otherwise(1.0)
    return marked.join(twin, "_stem", "left").withColumn("score", F.col("score") * factor).drop("_stem", "_any", "_twin")


# Searches.


def rerank(query: str, results: DataFrame, scorer=None) -> DataFrame:
    """New scores of (query, content) pairs from scorer(query, list of texts); by default the share of query words a text holds."""

    def shared(asked: str, texts: list[str]) -> list[float]:
        words = set(asked.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]

    use = scorer or shared

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(use(query, texts.fillna("").tolist()))

    return results.withColumn("score", score("content"))


def explore(hits: DataFrame, chunks: DataFrame, ranks: DataFrame, edges: DataFrame, limit: int, most: int = 8) -> DataFrame:
    """Hits with the graph's boost, and the best chunk of up to `most` files next to them (.6 + .6 rank of the best hit's score)."""
    best = rank.graph_boost(hits, ranks).orderBy(*rank.by_score()).limit(3 * limit)
    own = graph.real(edges)
    anchors = best.groupBy("file_path").agg(F.max("score").alias("s"))
    near = anchors.join(own, anchors["file_path"] == own["dst"]).select(F.col("src").alias("f"), "s").unionByName(anchors.join(own, anchors["file_path"] == own["src"]).select(F.col("dst").alias("f"), "s"))
    new = near.groupBy("f").agg(F.max("s").alias("s")).join(best.select(F.col("file_path").alias("f")), "f", "left_anti").orderBy(F.desc("s"), "f").limit(most)
    first = chunks.join(F.broadcast(new), chunks["file_path"] == F.col("f")).groupBy("f", "s").agg(F.min_by(F.struct(*COLUMNS), "line_start").alias("c"))  # at most `most` rows
    r = ranks.select(F.col("node").alias("f"), "rank")
    added = first.join(r, "f", "left").select("c.*", (F.col("s") * (0.6 + 0.6 * F.coalesce("rank", F.lit(0.0)))).alias("score"))
    return rank.test_demotion(best.select(*COLUMNS, "score").unionByName(added)).orderBy(*rank.by_score()).limit(limit)


def deep(query: str, search, limit: int, scorer=None) -> DataFrame:
    """Reformulations are searched one by one (search(text, n)), fused by rank, and scored again against the query."""
    n = max(3 * limit, 30)
    lists = [rank.ranked(search(q, n), None, "chunk_id") for q in rewrite.reformulations(query)]
    fused = rank.rrf(lists, "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(n).select("chunk_id")
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    bodies = every.select(*COLUMNS).dropDuplicates(["chunk_id"]).join(F.broadcast(fused), "chunk_id")  # n rows
    return rank.test_demotion(rerank(query, bodies, scorer)).orderBy(*rank.by_score()).limit(limit)


def progressive(query: str, search, limit: int, scorer=None) -> Iterator[tuple[str, DataFrame]]:
    """("bm25", results), ("fused", results), ("reranked", results): each as soon as its plan is known."""
    yield "bm25", search(query, limit)
    lists = [rank.ranked(search(q, 3 * limit), None, "chunk_id") for q in rewrite.reformulations(query)]
    yield "fused", rank.rrf(lists, "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(limit)
    yield "reranked", deep(query, search, limit, scorer)


def similar_query(content: str, most: int = 20) -> str:
    """The identifiers of the first ten lines of a chunk, as a query for its like."""
    import re

    return " ".join(list(dict.fromkeys(re.findall(r"[A-Za-z_]\w{2,}", "\n".join(content.split("\n")[:10]))))[:most])


def focus_map(edges: DataFrame, seeds: list[str], limit: int = 20) -> DataFrame:
    """(node, rank, relation) around seed files of weight .7^i: seed, caller, callee or related."""
    spark = edges.sparkSession
    weights = spark.createDataFrame([(s, 0.7**i) for i, s in enumerate(seeds)], "node string, weight double")
    ranks = graph.pagerank(edges, weights)
    own = graph.real(edges)
    callers = own.where(F.col("dst").isin(seeds)).select(F.col("src").alias("node"), F.lit(True).alias("caller")).distinct()
    callees = own.where(F.col("src").isin(seeds)).select(F.col("dst").alias("node"), F.lit(True).alias("callee")).distinct()
    best = ranks.orderBy(F.desc("rank"), "node").limit(limit).join(callers, "node", "left").join(callees, "node", "left")
    relation = F.when(F.col("node").isin(seeds), "seed").when(F.col("caller"), "caller").when(F.col("callee"), "callee").otherwise("related")
    return best.select("node", "rank", relation.alias("relation"))


def usage_examples(files: DataFrame, name: str, around: int = 5) -> DataFrame:
    """(kind, file_path, line, snippet): first hit of each test file with its lines around, call sites, and fenced blocks of documents."""
    lines = files.select("file_path", F.split("content", "\n", -1).alias("lines"))
    hits = lines.select("file_path", "lines", F.posexplode("lines").alias("line", "text")).where(F.col("text").contains(name))
    start = F.greatest(F.col("line") - around, F.lit(0))
    cut = F.array_join(F.slice("lines", start + 1, F.lit(2 * around + 1)), "\n")
    test = X.ranks_as_test(F.col("file_path"))
    first = hits.where(test).groupBy("file_path").agg(F.min(F.struct("line", cut.alias("snippet"))).alias("s")).select(F.lit("test").alias("kind"), "file_path", "s.line", "s.snippet")
    calls = hits.where(~test & F.col("text").contains(name + "(") & ~F.col("text").rlike(rf"(fn|def|func|function)\s+{name}\b")).select(F.lit("call").alias("kind"), "file_path", "line", F.trim("text").alias("snippet"))
    blocks = code_blocks(files).where(F.col("code").contains(name)).select(F.lit("doc").alias("kind"), "file_path", F.col("block").alias("line"), F.col("code").alias("snippet"))
    return first.unionByName(calls).unionByName(blocks)


def feature_hub(core: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(file_path, role) around core files (file_path): core, callee, caller, test; the first role that fits."""
    own = graph.real(edges)
    c = core.select("file_path").distinct()
    roles = [
        (0, "core", c),
        (1, "callee", own.join(c, own["src"] == c["file_path"]).select(F.col("dst").alias("file_path"))),
        (2, "caller", own.join(c, own["dst"] == c["file_path"]).select(F.col("src").alias("file_path"))),
        (3, "test", tests.join(c, tests["source"] == c["file_path"]).select(F.col("test").alias("file_path"))),
    ]
    every = None
    for n, role, df in roles:
        df = df.select("file_path", F.struct(F.lit(n).alias("n"), F.lit(role).alias("role")).alias("r"))
        every = df if every is None else every.unionByName(df)
    return every.groupBy("file_path").agg(F.min("r").alias("r")).select("file_path", "r.role")


def review_context(changed: DataFrame, edges: DataFrame, tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, role, symbols) for a review: changed files, their direct callers and their tests, with the public names that each defines.

    A file has the first role that fits; `changed` has file_path, `tests` (test, source).
    """
    c = changed.select("file_path").distinct()
    own = graph.real(edges)
    callers = own.join(c, own["dst"] == c["file_path"]).select(F.col("src").alias("file_path"))
    covering = tests.join(c, tests["source"] == c["file_path"]).select(F.col("test").alias("file_path"))
    every = reduce(
        DataFrame.unionByName,
        [df.select("file_path", F.struct(F.lit(n).alias("n"), F.lit(role).alias("role")).alias("r")) for n, role, df in ((0, "changed", c), (1, "test", covering), (2, "caller", callers))],
    )
    names = symbols.where("visibility = 'public' and kind <> 'import'").groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("symbols"))
    found = every.groupBy("file_path").agg(F.min("r").alias("r")).join(names, "file_path", "left")
    return found.select("file_path", "r.role", F.coalesce("symbols", F.lit("")).alias("symbols"))


def symbols_of_projects(projects: dict[str, DataFrame], name: str) -> DataFrame:
    """(project, name, kind, file_path, line): the symbols of every project whose name holds a text, any case."""
    found = [s.where(F.lower("name").contains(name.lower())).select(F.lit(p).alias("project"), "name", "kind", "file_path", "line") for p, s in projects.items()]
    return reduce(DataFrame.unionByName, found)


def search_tools(tools: DataFrame, aliases: dict[str, list[str]], query: str) -> DataFrame:
    """(name, description, hit) of tools: those with an alias in the query first (hit 0), then those that hold a word of it (hit 1)."""
    asked = query.lower()
    words = [w for w in asked.split() if len(w) > 2]
    long = {w for w in words if len(w) > 3}
    named = [t for t, phrases in aliases.items() if any(p in asked or long & set(p.split()) for p in phrases)]
    text = F.concat_ws("\n", F.lower("name"), F.lower("description"))
    holds = reduce(lambda a, b: a | b, [text.contains(w) for w in [*words, asked]])
    return tools.select("name", "description", F.when(F.col("name").isin(named), 0).when(holds, 1).alias("hit")).where("hit is not null")


def token_savings(files: DataFrame, results: DataFrame, literal: str) -> DataFrame:
    """One row: bytes and tokens of reading every file that holds a literal whole, of the search's results, and what is saved.

    The naive way greps and reads; tokens are bytes / 4, rounded up a text.
    """
    size = lambda df, kind: df.agg(
        F.count("*").alias(f"{kind}_texts"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias(f"{kind}_bytes"), F.coalesce(F.sum(X.approx_tokens(F.col("content"))), F.lit(0)).alias(f"{kind}_tokens")
    )
    both = size(files.where(F.col("content").contains(literal)), "naive").join(F.broadcast(size(results, "search")), F.lit(True))  # one row each
    return both.withColumn("saved", F.when(F.col("naive_tokens") > 0, F.round(1 - F.col("search_tokens") / F.col("naive_tokens"), 6)))


# Outside documents and changes.


def import_external(current: DataFrame, issues: DataFrame, source: str) -> DataFrame:
    """Files after the documents of an outside source (number, title, body, state, author, labels, url) replace all of its earlier ones."""
    front = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("State: "), "state"), F.concat(F.lit("Author: "), "author"), F.concat(F.lit("Labels: "), F.array_join("labels", ", ")), F.concat(F.lit("URL: "), "url"))
    new = issues.select(F.concat(F.lit(f"_external/{source}/issue-"), F.col("number").cast("string"), F.lit(".md")).alias("file_path"), F.concat(front, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("content"))
    return current.where(~F.col("file_path").startswith(f"_external/{source}/")).select("file_path", "content").unionByName(new)


def git_changes(diff: DataFrame) -> DataFrame:
    """(file_path, change) of name-status rows (status, old, new): renames and copies delete the old path (renames) and add the new."""
    kind = F.substring("status", 1, 1)
    moved = F.array(F.struct(F.col("old").alias("file_path"), F.lit("removed").alias("change")), F.struct(F.col("new").alias("file_path"), F.lit("added").alias("change")))
    copied = F.array(F.struct(F.col("new").alias("file_path"), F.lit("added").alias("change")))
    one = F.when(kind == "A", "added").when(kind == "D", "removed").otherwise("modified")
    plain = F.array(F.struct(F.col("old").alias("file_path"), one.alias("change")))
    return diff.select(F.explode(F.when(kind == "R", moved).when(kind == "C", copied).otherwise(plain)).alias("c")).select("c.*").distinct()


def discover_projects(files: DataFrame) -> DataFrame:
    """(root, kind): folders with the manifest of a workspace or package."""
    name = X.basename(F.col("file_path"))
    kind = F.when(name == "Cargo.toml", "cargo").when(name == "package.json", "npm").when(name == "pnpm-workspace.yaml", "pnpm").when(name.isin("go.mod", "go.work"), "go").when(name == "pyproject.toml", "python")
    root = F.regexp_replace("file_path", "/?[^/]*$", "")
    return files.select(root.alias("root"), kind.alias("kind")).where("kind is not null").distinct()
