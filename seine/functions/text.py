"""Text functions as Columns: tokenisers, identifier and path rules, line transforms, measures."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_.]+"


def camel_spaced(word: Column) -> Column:
    """A space before each capital that begins a part: fooBar -> foo Bar, HTTPServer -> HTTP Server."""
    step = F.regexp_replace(word, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    return F.regexp_replace(step, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")


def _parts(word: Column, gap: str) -> Column:
    return F.filter(F.split(F.lower(camel_spaced(word)), gap), lambda x: x != "")


def code_words(text: Column) -> Column:
    """Words with their dots and underscores, as they stand."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def word_tokens(word: Column) -> Column:
    """Lower-case parts of a dotted, snake or camel word, each once, and the whole word if it has parts.

    Words of small letters and digits, nearly all, have no parts and skip the splitting.
    """
    split = F.transform(
        F.array(_parts(word, "[ ._]+")),
        lambda p: F.when(F.size(p) > 1, F.array_distinct(F.concat(p, F.array(F.lower(word))))).otherwise(p),
    )[0]
    return F.when(word.rlike(r"[^\p{Ll}\p{Nd}]"), split).otherwise(F.array(word))


def code_tokens(text: Column) -> Column:
    """The `word_tokens` of all words of a text, in order."""
    return F.flatten(F.transform(code_words(text), word_tokens))


@cache
def _camel():
    import regex

    small = r"\p{Ll}\u0295"  # U+0295 is a small letter up to Unicode 15, so in Java
    return (
        regex.compile(rf"[{small}\p{{N}}]\p{{Lu}}|\p{{Lu}}\p{{Lu}}[{small}]").search,
        regex.compile(rf"([{small}\p{{N}}])(\p{{Lu}})").sub,
        regex.compile(rf"(\p{{Lu}})(\p{{Lu}}[{small}])").sub,
    )


def tokens_of_word(word: str) -> list[str]:
    """The `word_tokens` of one word, in Python."""
    has, small, great = _camel()
    spaced = great(r"\1 \2", small(r"\1 \2", word)) if has(word) else word
    parts = [p for p in spaced.lower().replace(".", " ").replace("_", " ").split(" ") if p]
    return list(dict.fromkeys([*parts, word.lower()])) if len(parts) > 1 else parts


#: What postings use instead, once for each distinct word that has other characters than these.
word_tokens.of_word, word_tokens.plain = tokens_of_word, r"^[\p{Ll}\p{Nd}]*$"


def query_tokens(text: str) -> list[str]:
    """`code_tokens` of a query, on the driver."""
    import regex

    return [t for word in regex.findall(_WORD, text) for t in tokens_of_word(word)]


def identifier_words(name: Column) -> Column:
    """Parts of a name split at _ . and camel case, then the whole name, lower case."""
    return F.array_distinct(F.concat(_parts(name, "[ ._]+"), F.array(F.lower(name))))


def path_segments(path: Column) -> Column:
    """Words of a path: split at / - _, the last extension dropped."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.filter(F.split(F.lower(bare), "[/_-]+"), lambda x: x != "")


def identifier_parts(name: Column) -> Column:
    """Snake parts, then ASCII camel parts, lower case, of two characters or more."""
    step = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(step), "_+"), lambda x: F.char_length(x) >= 2)


STOP = ("the", "and", "for", "with", "from", "that", "this", "are", "was", "not", "you", "all", "can", "has", "have", "its", "into")


def concept_words(text: Column) -> Column:
    """Words of three letters or more without stop words, lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (F.char_length(x) >= 3) & ~x.isin(*STOP))


def ranked_concept_words(text: Column, most: int = 8) -> Column:
    """Distinct concept words, longest first, then alphabetical; at most `most`."""
    order = F.transform(F.array_distinct(concept_words(text)), lambda w: F.struct(-F.char_length(w), w.alias("w")))
    return F.slice(F.transform(F.sort_array(order), lambda x: x["w"]), 1, most)


def ink(text: Column) -> Column:
    """Bytes that are not ASCII white space."""
    return F.octet_length(F.regexp_replace(text, r"[ \t\n\r\f]", "")).cast("long")


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


EXTENSIONS = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby",
    "swift": "swift", "kt": "kotlin", "scala": "scala", "zig": "zig", "php": "php", "sh": "bash", "bash": "bash", "m": "matlab",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "mmd": "mermaid", "asm": "assembly", "s": "assembly", "md": "markdown",
    "markdown": "markdown", "html": "html", "htm": "html", "rst": "rst", "adoc": "asciidoc", "txt": "plaintext", "pdf": "pdf", "ipynb": "notebook",
}


def language_of(path: Column) -> Column:
    """Language by file name, then by extension; null if unknown."""
    name = F.lower(basename(path))
    rule = (
        F.when(name.startswith("dockerfile"), "dockerfile")
        .when(name.isin("makefile", "gnumakefile"), "makefile")
        .when(name.rlike(r"^(openapi|swagger)\.(json|ya?ml)$"), "openapi")
        .when(name.isin("readme", "license", "changelog"), "plaintext")
    )
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(rule, F.try_element_at(table, F.regexp_extract(name, r"\.([^.]+)$", 1)))


EXCLUDED = (".git", "target", "node_modules", ".venv", "venv", "__pycache__", "vendor", "dist", "build", ".tox", ".mypy_cache")


def indexable(path: Column) -> Column:
    """No excluded folder in the path, and a known language."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in EXCLUDED])) & language_of(path).isNotNull()


def ranks_as_test(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"(^|/)(tests?|__tests__|spec|specs|testing|fixtures)/") | p.rlike(r"(_test|_spec|\.test|\.spec)\.[a-z]+$") | basename(p).startswith("test_")


def maps_as_test(path: Column) -> Column:
    name = basename(path)
    return name.rlike(r"^test_|_test\.|\.test\.|\.spec\.|_spec\.|Test\.java$|Tests?\.cs$") | path.rlike(r"(^|/)(tests|__tests__|spec)/")


def orphan_test(path: Column) -> Column:
    return path.contains("/test") | path.startswith("test") | basename(path).rlike(r"_test\.|\.test\.|\.spec\.|^test_")


def entry_point(path: Column) -> Column:
    name = basename(path)
    return name.isin("__init__.py", "__main__.py", "build.rs", "index.js", "index.ts", "lib.rs", "main.go", "main.py", "main.rs", "mod.rs", "setup.py") | name.rlike(
        r"^main[._]"
    ) | path.rlike(r"(^|/)(bin|scripts|examples|benches)/")


def doc_file(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.rlike(r"\.(md|markdown|rst|adoc|txt|html?|pdf)$") | name.isin("readme", "license", "changelog")


def asset_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(png|jpe?g|gif|svg|ico|css|scss|woff2?|ttf|json|lock|map)$")


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


BRANCHES = ("if ", "else if ", "for ", "while ", "loop ", "match ", "=>", "&&", "||", "catch ", "case ")


def complexity(text: Column) -> Column:
    """1 and the number of branch words."""
    return sum((occurrences(text, w) for w in BRANCHES), F.lit(1)).cast("long")


def complexity_band(n: Column) -> Column:
    return F.when(n <= 5, "low").when(n <= 10, "moderate").when(n <= 25, "high").otherwise("very_high")


def control_flow(text: Column) -> Column:
    branch = text.rlike(r"(?<![A-Za-z0-9_])(?:if|match|switch|case)[^A-Za-z0-9_]")
    loop = text.rlike(r"(?<![A-Za-z0-9_])(?:for|while|loop)[^A-Za-z0-9_]")
    return F.when(branch & loop, "mixed").when(branch, "branching").when(loop, "looping").otherwise("linear")


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct members; 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    def square(x, y):
        return (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


# The ten line transforms of output filters; each takes and returns a text Column.


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def keep_lines(text: Column, pattern: str) -> Column:
    return _joined(F.filter(_lines(text), lambda x: x.rlike(pattern)))


def strip_lines(text: Column, pattern: str) -> Column:
    return _joined(F.filter(_lines(text), lambda x: ~x.rlike(pattern)))


def replace_each(text: Column, pattern: str, new: str) -> Column:
    return _joined(F.transform(_lines(text), lambda x: F.regexp_replace(x, pattern, new)))


def head(text: Column, n: int) -> Column:
    return _joined(F.slice(_lines(text), 1, n))


def tail(text: Column, n: int) -> Column:
    return _joined(F.reverse(F.slice(F.reverse(_lines(text)), 1, n)))


def max_lines(text: Column, n: int) -> Column:
    """Two thirds from the head and the rest from the tail, with a mark between, if there are more."""
    first = 2 * n // 3
    size = F.size(_lines(text))
    mark = F.concat(F.lit("... ("), (size - n).cast("string"), F.lit(" lines omitted)"))
    return F.when(size <= n, text).otherwise(F.concat_ws("\n", head(text, first), mark, tail(text, n - first)))


def dedup_lines(text: Column) -> Column:
    return _joined(F.array_distinct(_lines(text)))


def on_empty(text: Column, other: str) -> Column:
    return F.when(F.trim(text) == "", other).otherwise(text)


def truncate_each(text: Column, chars: int) -> Column:
    return _joined(F.transform(_lines(text), lambda x: F.substring(x, 1, chars)))


def first_rule(rules: list[tuple[int, str, str, int]], tool: Column, text: Column) -> Column:
    """The first of (number, tool or *, pattern, least lines) that fits an output; null if none does."""
    lines = F.size(_lines(text))
    fits = lambda t, p, n: ((tool == t) | F.lit(t == "*")) & text.rlike(p) & (lines >= n)
    return F.coalesce(*[F.when(fits(t, p, n), k) for k, t, p, n in rules])
