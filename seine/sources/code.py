"""Symbols, imports and calls of source files.

Python files go through `ast`; other languages through line grammars.  Parsing is local to
a row and runs in Arrow batches; resolution and graph building are joins.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.functions import text as X

_GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+(\w+)", "struct"),
        (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+(\w+)", "enum"), (r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+(\w+)", "trait"),
        (r"^\s*impl(?:<[^>]*>)?\s+(?:\w+\s+for\s+)?(\w+)", "impl"), (r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)", "const"), (r"^\s*(?:pub\s+)?mod\s+(\w+)", "module"),
    ],
    "typescript": [
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class"),
        (r"^\s*(?:export\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:export\s+)?type\s+(\w+)", "type"), (r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\(", "function"),
    ],
    "go": [(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"^type\s+(\w+)\s+struct", "struct"), (r"^type\s+(\w+)\s+interface", "interface"), (r"^(?:const|var)\s+(\w+)", "const")],
    "java": [(r"^\s*(?:public|private|protected)?\s*(?:abstract\s+|final\s+)*class\s+(\w+)", "class"), (r"^\s*(?:public\s+)?interface\s+(\w+)", "interface"), (r"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\]]+\s+(\w+)\s*\(", "method")],
    "c": [(r"^[A-Za-z_][\w\s\*]*\b(\w+)\s*\([^;]*$", "function"), (r"^\s*struct\s+(\w+)", "struct"), (r"^#define\s+(\w+)", "const")],
    "ruby": [(r"^\s*def\s+(?:self\.)?(\w+)", "function"), (r"^\s*class\s+(\w+)", "class"), (r"^\s*module\s+(\w+)", "module")],
    "bash": [(r"^\s*(?:function\s+)?(\w+)\s*\(\)", "function")],
    "php": [(r"^\s*(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)", "function"), (r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)", "class")],
    "kotlin": [(r"^\s*(?:\w+\s+)*fun\s+(\w+)", "function"), (r"^\s*(?:\w+\s+)*class\s+(\w+)", "class")],
    "swift": [(r"^\s*(?:\w+\s+)*func\s+(\w+)", "function"), (r"^\s*(?:\w+\s+)*(?:class|struct)\s+(\w+)", "class")],
    "scala": [(r"^\s*(?:\w+\s+)*def\s+(\w+)", "function"), (r"^\s*(?:\w+\s+)*(?:class|object|trait)\s+(\w+)", "class")],
    "zig": [(r"^\s*(?:pub\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*struct", "struct")],
    "csharp": [(r"^\s*(?:\w+\s+)*(?:class|interface|struct)\s+(\w+)", "class"), (r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+)*[\w<>\[\]]+\s+(\w+)\s*\(", "method")],
    "matlab": [(r"^\s*function\s+(?:[\w\[\],\s]+=\s*)?(\w+)", "function")],
    "makefile": [(r"^([\w.-]+)\s*:(?!=)", "target")], "toml": [(r"^\[+([^\]]+)\]+", "table"), (r"^([\w.-]+)\s*=", "key")],
    "yaml": [(r"^([\w.-]+)\s*:", "key")], "dockerfile": [(r"(?i)^FROM\s+\S+\s+AS\s+(\w+)", "stage")], "assembly": [(r"^([A-Za-z_.$][\w.$]*):", "label")], "mermaid": [(r"^\s*(\w+)\s*[\[({]", "node")],
}
_GRAMMARS["javascript"], _GRAMMARS["cpp"] = _GRAMMARS["typescript"], [*_GRAMMARS["c"], (r"^\s*class\s+(\w+)", "class")]

_IMPORTS = {
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)|^\s*(?:pub\s+)?mod\s+(\w+)\s*;", "python": r"^\s*from\s+([\w.]+)\s+import|^\s*import\s+([\w.]+)", "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"',
    "typescript": r"""(?:from|require\(|import)\s*['"]([^'"]+)['"]""", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "c": r'^\s*#include\s+"([^"]+)"', "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)""",
    "php": r"^\s*use\s+([\w\\]+)", "kotlin": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import\s+(\w+)", "scala": r"^\s*import\s+([\w.]+)", "zig": r'@import\("([^"]+)"\)', "csharp": r"^\s*using\s+([\w.]+)\s*;", "bash": r"^\s*(?:source|\.)\s+(\S+)",
}
_IMPORTS["javascript"], _IMPORTS["cpp"] = _IMPORTS["typescript"], _IMPORTS["c"]
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(|[.:]([A-Za-z_]\w*)\s*\(")
_NO_CALL = set("if for while match switch return fn def function func class catch loop print elif with and or not in sizeof await".split())

SYMBOLS = "file_path string, name string, kind string, line int, line_end int, signature string, visibility string, doc string"
_SYMBOLS = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.strip().split(" ") for x in SYMBOLS.split(","))])


def _python(text: str):
    lines = text.split("\n")

    def walk(node, inside):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if inside else "function"
                yield x.name, kind, x.lineno - 1, (x.end_lineno or x.lineno) - 1, lines[x.lineno - 1].strip(), "private" if x.name.startswith("_") else "public", ast.get_docstring(x)
                yield from walk(x, kind == "class")

    yield from walk(ast.parse(text), False)


def symbols_of(text: str, language: str):
    """(name, kind, line, line_end, signature, visibility, doc) from 0; a Python file with an error falls back to lines."""
    if language == "python":
        try:
            yield from _python(text)
            return
        except (SyntaxError, ValueError):
            rules = [(r"^\s*(?:async\s+)?def\s+(\w+)", "function"), (r"^\s*class\s+(\w+)", "class")]
    else:
        rules = _GRAMMARS.get(language, [])
    found, doc = [], []
    for n, line in enumerate(text.split("\n")):
        for rule, kind in rules:
            m = re.match(rule, line)
            if m:
                public = bool(re.match(r"\s*(pub|export|public)\b", line)) or (language == "go" and m[1][0].isupper())
                found.append((m[1], kind, n, line.strip(), "public" if public else "private", " ".join(doc) or None))
                break
        m = re.match(r"\s*(?:///|//!?|#(?!!)|--|;)\s?(.*)", line)
        doc = [*doc, m[1]] if m else []
    last = text.count("\n")
    for i, (name, kind, n, sign, seen, doc) in enumerate(found):
        yield name, kind, n, found[i + 1][2] - 1 if i + 1 < len(found) else last, sign, seen, doc


def _each(files: DataFrame, of, ddl: str, schema: pa.Schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            out: list = []
            for path, text, language in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(path, *row) for row in of(text or "", language)]
            columns = list(zip(*out)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.select("file_path", "content", X.language_of(F.col("file_path")).alias("language")).mapInArrow(run, ddl)


def symbols(files: DataFrame) -> DataFrame:
    return _each(files, symbols_of, SYMBOLS, _SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    """(file_path, raw): imports as written."""

    def of(text, language):
        rule = _IMPORTS.get(language)
        found = dict.fromkeys(next(g for g in m.groups() if g) for m in re.finditer(rule, text, re.M)) if rule else {}
        return [(x,) for x in found]

    return _each(files, of, "file_path string, raw string", pa.schema([("file_path", pa.string()), ("raw", pa.string())]))


def calls(files: DataFrame) -> DataFrame:
    """(file_path, callee, line): names followed by an opening bracket, without definitions and keywords."""

    def of(text, language):
        if language not in _GRAMMARS and language != "python":
            return
        for n, line in enumerate(text.split("\n")):
            if re.match(r"\s*(pub\s+|export\s+)?(default\s+)?(async\s+)?(fn|def|func|function|class)\b", line):
                line = line.split("{", 1)[1] if "{" in line else ""
            for m in _CALL.finditer(line):
                name = m[1] or m[2]
                if name not in _NO_CALL:
                    yield name, n

    schema = pa.schema([("file_path", pa.string()), ("callee", pa.string()), ("line", pa.int32())])
    return _each(files, of, "file_path string, callee string, line int", schema)


def _candidates(path, raw):
    """Paths that an import may mean, best first, as an array Column."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    dotted = F.replace(F.replace(F.regexp_replace(raw, r"^(crate|self|super)::", ""), F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))
    parent = F.regexp_replace(dotted, "/[^/]*$", "")
    bare = F.regexp_replace(raw, r"^\./", "")
    stem = F.regexp_replace(bare, r"\.(js|ts|jsx|tsx)$", "")
    shapes = [
        F.concat(folder, bare), F.concat(folder, stem, F.lit(".ts")), F.concat(folder, stem, F.lit(".tsx")), F.concat(folder, stem, F.lit(".js")), F.concat(folder, stem, F.lit("/index.ts")),
        F.concat(folder, dotted, F.lit(".py")), F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), F.concat(parent, F.lit(".py")),
        *[F.concat(base, part, F.lit(end)) for part in (dotted, parent) for base in (folder, F.lit("src/"), F.lit("")) for end in (".rs", "/mod.rs")],
        F.concat(dotted, F.lit(".go")), F.concat(dotted, F.lit(".java")), bare,
    ]
    return F.array(*shapes)


def import_edges(files: DataFrame) -> DataFrame:
    """(src, dst, kind, raw): imports resolved to files by candidate paths, the rest to external nodes."""
    raw = imports(files)
    tried = raw.select("file_path", "raw", F.posexplode(_candidates(F.col("file_path"), F.col("raw"))).alias("order", "candidate"))
    known = files.select(F.col("file_path").alias("candidate"))
    hit = tried.join(known, "candidate").groupBy("file_path", "raw").agg(F.min_by("candidate", "order").alias("dst"))
    found = raw.join(hit, ["file_path", "raw"], "left")
    return found.where("dst is null or dst <> file_path").select(
        F.col("file_path").alias("src"), F.coalesce("dst", F.concat(F.lit("__ext__:"), "raw")).alias("dst"), F.when(F.col("dst").isNull(), "External").otherwise("Resolved").alias("kind"), "raw"
    )


def call_edges(files: DataFrame) -> DataFrame:
    """(src, dst, name): a call whose name exactly one other file defines."""
    from seine.operators.symbols import unique_targets

    return unique_targets(calls(files).select("file_path", F.col("callee").alias("name")).distinct(), symbols(files))


def symbol_edges(files: DataFrame) -> DataFrame:
    """(file_path, caller, callee, line, target): calls with their enclosing function, to every file that defines the name."""
    from seine.operators.symbols import enclosing

    own = symbols(files)
    where = own.where("kind <> 'module'").select(F.col("name").alias("callee"), F.col("file_path").alias("target")).distinct()
    return enclosing(calls(files), own).join(where, "callee")


def signature_fingerprint(text: str) -> str:
    """Digest of a Rust source with function bodies left out: equal when only bodies changed."""
    import hashlib

    out, depth, body = [], 0, False
    for line in text.split("\n"):
        if not body:
            out.append(line.split("{")[0].rstrip() if re.match(r"\s*(pub\s+)?(async\s+)?fn\b", line) else line.rstrip())
        if re.match(r"\s*(pub\s+)?(async\s+)?fn\b", line) and not body:
            body, depth = "{" in line, 0
        if body:
            depth += line.count("{") - line.count("}")
            body = depth > 0
    return hashlib.md5("\n".join(out).encode()).hexdigest()
