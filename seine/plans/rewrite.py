"""What happens to a query before any table is read: strategy, rewriting, routing, references."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

STOP = set("a an the is are was were be of in on at to for from by with and or not how what where when why which who does do did can could should would i we it this that find show get me my".split())
SYNONYMS = {
    "auth": ["login", "token", "credential"], "config": ["settings", "options"], "error": ["failure", "exception"], "delete": ["remove", "drop"], "create": ["new", "build"], "fetch": ["get", "load"],
    "store": ["save", "persist"], "parse": ["tokenize", "lexer"], "cache": ["memo", "lru"], "test": ["spec", "assert"], "search": ["find", "query", "lookup"], "rate limit": ["throttle", "quota"],
}
PATTERNS = {"retry": ["backoff", "max_retries"], "webhook": ["signature", "verify_signature"], "checksum": ["sha256", "digest"], "timeout": ["deadline", "Duration"], "security header": ["csp", "hsts"]}
VERBS = set("parse read write load save fetch send build create delete remove update validate check compute search find index open close start stop merge split convert render".split())


@dataclass
class Query:
    text: str
    limit: int = 10
    strategy: str | None = None
    queries: list[str] = field(default_factory=list)
    file_filter: str | None = None
    doc_filter: str | None = None


def identifier_like(word: str) -> bool:
    """snake_case, camelCase, path::like or dotted, of at least 3 and at most 80 characters."""
    return 3 <= len(word) <= 80 and bool(re.fullmatch(r"[A-Za-z_][\w:.]*", word)) and bool(re.search(r"_|::|\.|[a-z][A-Z]|[A-Z][a-z]+[A-Z]", word))


def strategy_of(query: str, graph: bool = True, vectors: bool = False) -> str:
    """instant, exact, goto, explore, semantic, fast or thorough, by words and what the index has."""
    words = query.split()
    if re.search(r'^".*"$', query.strip()):
        return "exact"
    if len(words) == 1:
        return "goto" if identifier_like(words[0]) else "instant"
    if graph and re.search(r"\b(depends|callers?|uses?|related|impact)\b", query.lower()):
        return "explore"
    if any(identifier_like(w) for w in words):
        return "fast"
    return "thorough" if vectors or len(words) >= 5 else "fast"


def camel_parts(word: str) -> list[str]:
    return [p for p in re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", word)).replace("_", " ").split() if p]


def expand(query: str) -> str:
    """The query and, for words of the shape of identifiers, their parts and other spelling."""
    out = []
    for w in query.split():
        out.append(w)
        if len(w) > 3 and identifier_like(w):
            parts = camel_parts(w)
            other = "_".join(p.lower() for p in parts) if "_" not in w else "".join(p.capitalize() for p in parts)
            out += [p for p in [*(p.lower() for p in parts), other] if p != w]
    return " ".join(dict.fromkeys(out))


def keywords(query: str) -> list[str]:
    return [w for w in re.findall(r"\w+", query.lower()) if w not in STOP]


def reformulations(query: str, learned: dict[str, list[str]] | None = None) -> list[str]:
    """The query, its keywords, CamelCase and snake forms, synonyms, code patterns and up to five learned expansions."""
    words, lower = keywords(query), query.lower()
    out = [query, " ".join(words)]
    if 2 <= len(words) <= 4:
        out.append("".join(w.capitalize() for w in words))
    if len(words) >= 2:
        out.append("_".join(words))
    extra = [s for t, more in SYNONYMS.items() if t in lower for s in more]
    if extra:
        out.append(" ".join([*words, *extra]))
    out += [p for t, more in PATTERNS.items() if t in lower for p in more][:3]
    out += [x for w in words for x in (learned or {}).get(w, [])][:5]
    return list(dict.fromkeys(x for x in out if x))


def intent(query: str) -> dict[str, list[str]]:
    """Verbs, nouns and Type mentions."""
    words = re.findall(r"[A-Za-z_]\w*", query)
    types = [w for w in words if re.match("[A-Z][a-z]", w)]
    verbs = [w.lower() for w in words if w.lower() in VERBS]
    return {"verbs": verbs, "types": types, "nouns": [w.lower() for w in words if w not in types and w.lower() not in VERBS and w.lower() not in STOP]}


def route(query: str) -> tuple[str, float]:
    """(code, docs or hybrid, factor of the other kind)."""
    lower = query.lower()
    docs = bool(re.search(r"\b(how to|guide|readme|documentation|tutorial|explain|why)\b", lower))
    code = any(identifier_like(w) for w in query.split()) or bool(re.search(r"\b(fn|function|struct|class|impl|trait|method)\b", lower))
    return ("hybrid", 1.0) if docs == code else ("docs", 0.3) if docs else ("code", 0.3)


def path_references(query: str) -> list[str]:
    """Paths that a query names: in backticks, a/b.ext, a/b, and dotted names of three parts or more."""
    out = re.findall(r"`([^`]+)`", query) + re.findall(r"[\w.-]+(?:/[\w.-]+)+", query)
    out += [m.replace(".", "/") for m in re.findall(r"(?<![\w/])\w+(?:\.\w+){2,}", query)]
    return list(dict.fromkeys(out))


def quoted(literal: str) -> str:
    return '"' + literal.replace("\\", "\\\\").replace('"', '\\"') + '"'
