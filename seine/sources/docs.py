"""Sections of documents: HTML, reStructuredText, AsciiDoc, OpenAPI; section chunks; stems."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_SECTION = pa.schema([("file_path", pa.string()), ("section", pa.int32()), ("level", pa.int32()), ("heading", pa.string()), ("path", pa.list_(pa.string())), ("content", pa.string())])
_DDL = "file_path string, section int, level int, heading string, path array<string>, content string"


class _Html(HTMLParser):
    """Text by headings; scripts and styles are skipped."""

    def __init__(self):
        super().__init__()
        self.parts, self.skip, self.heading, self.level = [[0, "", []]], 0, None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.heading, self.level = [], int(tag[1])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) and self.heading is not None:
            self.parts.append([self.level, " ".join(self.heading), []])
            self.heading = None

    def handle_data(self, data):
        if not self.skip and data.strip():
            (self.parts[-1][2] if self.heading is None else self.heading).append(" ".join(data.split()))


def html(text: str):
    own = _Html()
    own.feed(text)
    own.close()
    return [(level, heading, " ".join(words)) for level, heading, words in own.parts if heading or words]


def rst(text: str):
    """Titles are lines over an adornment of at least their length; levels in order of first use."""
    lines, order, out = text.split("\n"), [], [[0, "", []]]
    n = 0
    while n < len(lines):
        mark = lines[n + 1].strip() if n + 1 < len(lines) else ""
        if lines[n].strip() and len(mark) >= max(3, len(lines[n].strip())) and re.fullmatch(r"([=\-~^\"'`#*+.:_])\1*", mark):
            if mark[0] not in order:
                order.append(mark[0])
            out.append([order.index(mark[0]) + 1, lines[n].strip(), []])
            n += 2
        else:
            out[-1][2].append(lines[n])
            n += 1
    return [(a, h, "\n".join(b).strip()) for a, h, b in out if h or "".join(b).strip()]


def asciidoc(text: str):
    out = [[0, "", []]]
    title = re.compile(r"(={1,6})\s+(\S.*)")
    for line in text.splitlines():
        m = title.match(line)
        if m:
            out.append([len(m[1]), m[2].strip(), []])
        else:
            out[-1][2].append(line)
    return [(a, h, "\n".join(b).strip()) for a, h, b in out if h or "".join(b).strip()]


def openapi(text: str):
    """A section for each path and method of a JSON document, after one with its title."""
    try:
        own = json.loads(text)
    except ValueError:
        return []
    info = own.get("info", {})
    out = [(1, info.get("title", ""), info.get("description", ""))]
    for path, methods in own.get("paths", {}).items():
        for method in ("get", "put", "post", "delete", "options", "head", "patch", "trace"):
            if method in methods:
                x = methods[method]
                out.append((2, f"{method.upper()} {path}", " ".join(filter(None, (x.get("summary"), x.get("description"))))))
    return out


KINDS = {"html": html, "rst": rst, "asciidoc": asciidoc, "openapi": openapi}


def sections(files: DataFrame, kind: str) -> DataFrame:
    """(file_path, section, level, heading, path, content) of files of one kind (file_path, content)."""
    of = KINDS[kind]

    def run(batches):
        for batch in batches:
            out: list = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                open_: list = []
                for n, (level, heading, content) in enumerate(of(text or "")):
                    open_ = [*[x for x in open_ if x[0] < level], *([(level, heading)] if level else [])]
                    out.append((path, n, level, heading, [h for _, h in open_], content))
            columns = list(zip(*out)) if out else [[]] * len(_SECTION)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SECTION)], schema=_SECTION)

    return files.select("file_path", "content").mapInArrow(run, _DDL)


def fold_sections(parts: list[str], least: int = 200, most: int = 1500) -> list[str]:
    """Sections longer than `most` are cut at blank lines; neighbours that are both shorter than `least` and fit together join."""
    ink = lambda s: len("".join(s.split()).encode())
    cut: list[str] = []
    for part in parts:
        if ink(part) <= most:
            cut.append(part)
            continue
        held = ""
        for p in re.split(r"\n[ \t]*\n", part):
            if held and ink(held) + ink(p) > most:
                cut.append(held)
                held = p
            else:
                held = f"{held}\n\n{p}" if held else p
        cut.append(held)
    out: list[str] = []
    for part in cut:
        if out and ink(out[-1]) < least and ink(part) < least and ink(out[-1]) + ink(part) <= most:
            out[-1] += "\n\n" + part
        else:
            out.append(part)
    return out


def code_chunks(text: str, spans: list[tuple[int, int]], least: int = 200, most: int = 1500) -> list[tuple[int, int]]:
    """Line ranges (end exclusive) of a file cut at its definitions: whole if it is small, else greedy runs of neighbouring parts."""
    lines = text.split("\n")
    ink = lambda a, b: len("".join("".join(lines[a:b]).split()).encode())
    if ink(0, len(lines)) <= most:
        return [(0, len(lines))]
    edges = sorted({0, len(lines), *[a for a, _ in spans if 0 < a < len(lines)]})
    pieces: list[tuple[int, int]] = []
    for a, b in zip(edges, edges[1:]):
        while ink(a, b) > most and b - a > 1:
            end = a + 1
            while end < b and ink(a, end + 1) <= most:
                end += 1
            pieces.append((a, end))
            a = end
        if a < b:
            pieces.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        if out and (ink(*out[-1]) < least or ink(a, b) < least) and ink(out[-1][0], b) <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else len(w)
    if not m:
        x = re.search(f"[{_V}][^{_V}]", w)
        r1 = x.end() if x else len(w)
    x = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + x.end() if x else len(w)


def _short(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$", w)) and _regions(w)[0] >= len(w)


def stem(word: str) -> str:
    """English stem by the published Porter2 rules."""
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    fixed = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    if w in fixed:
        return fixed[w]
    if w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"):
        return w
    w = re.sub(f"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    m = re.search("(eedly|eed)$", w)
    if m:
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_V}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short(w):
                w += "e"
    w = re.sub(f"(?<=.[^{_V}])[yY]$", "i", w)
    two = {
        "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
        "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
    }
    for end in sorted(two, key=len, reverse=True):
        if w.endswith(end):
            w = w[: -len(end)] + two[end] if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("logi") and len(w) - 3 >= r1:
            w = w[:-1]
        elif re.search("[cdeghkmnrt]li$", w) and len(w) - 2 >= r1:
            w = w[:-2]
    three = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
    for end in sorted(three, key=len, reverse=True):
        if w.endswith(end):
            w = w[: -len(end)] + three[end] if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"):
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if re.search("[st]ion$", w) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(tokens: DataFrame) -> DataFrame:
    """(token, stem) of a table of distinct tokens: each is stemmed once, however often it occurs."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(t) for t in batch.column(0).to_pylist()], pa.string())], ["token", "stem"])

    return tokens.select("token").mapInArrow(run, "token string, stem string")
