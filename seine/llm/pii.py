"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP, card, phone) are the protected entities c.  Words t of the same
documents may give them away: over the whole corpus, the information that t carries about
c is PMI(c; t) = log2(n(c,t) N / (n(c) n(t))) in documents, and the entity's own
information is IC(c) = log2(N / n(c)).  What stays hidden once t is read is
IC - PMI = -log2 P(c | t) bits.  Terms that leave at most `remove_bits` are removed, those
that leave at most `generalise_bits` are replaced by their class.  P(c | t) is taken at the
lower end of its one-sided 95 % Wilson interval, so few documents weigh less but none is
left out: a term of one document leaves 1.9 bits.  n(c,t) counts different texts and n(t)
documents, so copies of one text are no further evidence.  A disclosed term goes in the
documents of its entity, or `everywhere`, where it discloses the entity without it.

Scale.  Words travel as hashes.  Each text is counted once, and entities of exactly the same
texts share one class, so a text pairs its terms with classes and not with entities.  Pairs
are summed in the map task before they are shuffled, so a hot entity is combined early;
document frequencies likewise, and only terms of pairs are kept.  Disclosed terms are found
again in one pass over the text: a bitmap of fixed size (8 MB) passes the candidates, and a
join settles them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.llm.tables import rows, texts, unused
from seine.store import durable

KINDS = ("email", "ip", "card", "phone")
#: Words counted, and pairs and hits held, before they are sent; bits of the bitmap of terms.
COUNTED, PAIRS, HITS, BITS = 150_000, 1_000_000, 100_000, 1 << 26
#: Normal deviate of the Wilson bound, one-sided 95 %.
Z = 1.645

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = ".,;:!?()[]{}<>\"'|#$%&*+=/_-"


def _emails(text: str):
    """Leftmost matches of local@domain, found from each @: linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)


def _is_byte(digits: str) -> bool:
    own = digits.lstrip("0")  # parts may have thousands of zeros in front
    return len(own) < 4 and int(own or "0") < 256


def _luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, sorted; end is exclusive, in code points."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        # an IP match that begins later in a run of digits begins at the run too, and a match ends with its run
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_is_byte(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _term(word: str) -> str:
    return word.strip(_MARKS).lower()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _outside(text: str, spans: list[tuple[int, int, int]]):
    """(start, end) of the words that overlap no span."""
    for m in _WORD.finditer(text):
        s, e = m.span()
        if not any(s < y and x < e for x, _, y in spans_near(spans, s, e)):
            yield s, e


def _said(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Hashes of the entities of a text and of the different terms outside its spans."""
    from xxhash import xxh64_intdigest as h64

    entities = set()
    for a, kind, b in spans:
        value = text[a:b].lower() if kind < 2 else "".join(c for c in text[a:b] if c.isdigit())
        entities.add(_signed(h64(f"{KINDS[kind]}:{value}")))
    terms = {_term(text[s:e]) for s, e in _outside(text, spans)}
    return list(entities), [_signed(h64(t)) for t in terms if t]


def spans_near(spans, start: int, end: int):
    """Spans that may overlap start to end: a bisection, as spans are sorted by start."""
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        if spans[mid][0] < end:
            lo = mid + 1
        else:
            hi = mid
    return spans[max(0, lo - 5) : lo]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


_BASE_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("base", pa.string()), ("entities", pa.list_(pa.int64())), ("own", pa.list_(pa.int64()))]
)
_BASE = (
    "doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "entities array<long>, own array<long>"
)


def base(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of the base patterns for each of (doc_id, th, text), and entities and terms where there are any."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out: dict[str, list] = {n: [] for n in _BASE_ARROW.names}
                for doc_id, th, text in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    spans = base_spans(text)
                    said = _joined([(a, KINDS[k], b) for a, k, b in spans])
                    counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
                    digest = hashlib.sha256(said.encode()).hexdigest()
                    entities, own = _said(text, spans) if spans else ([], [])
                    for n, v in zip(out, (doc_id, th, *counts, digest, said, entities, own)):
                        out[n].append(v)
                yield rows(_BASE_ARROW, out)

    return docs.mapInArrow(run, _BASE)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many rows each term stands, in parts of one map task each; all words of all rows."""

    def run(batches):
        from xxhash import xxh64_intdigest as h64

        def sent(count):
            terms = np.array([h64(t) for t in count], np.uint64).view(np.int64)
            counts = np.fromiter(count.values(), np.int64, len(count))
            for at in range(0, len(terms), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + 100_000]), pa.array(counts[at : at + 100_000])], ["term", "n"])

        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update({_term(w.decode()) for w in set(text.encode().split())})
                if len(count) > COUNTED:
                    yield from sent(count)
                    count = Counter()
        yield from sent(count)

    return docs.select("text").mapInArrow(run, "term long, n long")


def once(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each (doc_id, th) of `docs` once; `found` has the same keys without texts.

    Only repeated rows are shuffled, unless Spark finds their keys too large to broadcast.
    """
    keys = [F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")]
    twice = durable(found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(*keys), "pii-twice")
    on = (F.col("th") == F.col("r_th")) & F.col("doc_id").eqNullSafe(F.col("r_id"))
    again = docs.join(twice, on, "left_semi").dropDuplicates(["doc_id", "th"])
    return docs.join(twice, on, "left_anti").unionByName(again)


def hidden_bits(together: Column, seen: Column) -> Column:
    """-log2 of the lower Wilson bound of together / seen."""
    n = F.greatest(seen, together).cast("double")
    p = together / n
    low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return -F.log2(low)


def _pairs(listed: DataFrame) -> DataFrame:
    """(class, term, n): texts of each pair, from one row (classes, own) a text, in parts of one map task each."""

    def sent(held):
        both = np.concatenate(held)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        first = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(axis=1)])
        n = np.diff(np.r_[first, len(both)])
        for at in range(0, len(first), 100_000):
            part = both[first[at : at + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(n[at : at + 100_000])], ["class", "term", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for classes, own in zip(batch.column(0), batch.column(1)):
                own = own.values.to_numpy()
                for c in classes.values.to_numpy() if len(own) else ():
                    held.append(np.stack([np.full(len(own), c), own], axis=1))
                    size += len(own)
                    if size > PAIRS:
                        yield from sent(held)
                        held, size = [], 0
        if held:
            yield from sent(held)

    return listed.select("classes", "own").mapInArrow(run, "class long, term long, n long")


def classes_of(said: DataFrame) -> DataFrame:
    """(th, class) from one row (th, entities) a text: entities of exactly the same texts are one class."""
    held = said.select("th", F.explode("entities").alias("entity"))
    where = F.xxhash64(F.count("*"), F.bit_xor("th"), F.bit_xor(F.xxhash64("th"))).alias("class")
    return held.join(durable(held.groupBy("entity").agg(where), "pii-entities"), "entity").select("th", "class").distinct()


def disclosures(docs: DataFrame, said: DataFrame, classes: DataFrame, remove_bits: float, generalise_bits: float) -> DataFrame:
    """(class, term, action) for terms that give an entity away, from (th, own) and (th, class) of the texts with entities."""
    listed = said.join(classes.groupBy("th").agg(F.collect_list("class").alias("classes")), "th")
    pairs = durable(_pairs(listed).groupBy("class", "term").agg(F.sum("n").alias("together")), "pii-pairs")
    known = pairs.select("term").distinct()
    seen = durable(term_counts(docs).join(known, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("seen")), "pii-seen")
    return (
        pairs.join(seen, "term")
        .withColumn("hidden", hidden_bits(F.col("together"), F.col("seen")))
        .where(F.col("hidden") <= generalise_bits)
        .select("class", "term", F.when(F.col("hidden") <= remove_bits, "removed").otherwise("generalised").alias("action"))
    )


def _bitmap(terms: DataFrame) -> np.ndarray:
    """One bit for each term, in BITS: the driver sees at most BITS / 64 rows."""
    word = F.shiftright(F.col("term").bitwiseAND(F.lit(BITS - 1)), 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(term & 63 as int))")
    got = terms.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def hits(docs: DataFrame, bitmap: Broadcast, everywhere: bool) -> DataFrame:
    """(doc_id, th, term, start, end) of every word outside base spans whose term may be in the bitmap."""
    names = ["doc_id", "th", "term", "start", "end"]

    def run(batches):
        from xxhash import xxh64_intdigest as h64

        known: dict = {}
        bits = bitmap.value

        def passes(word: bytes) -> bool:
            t = _term(word.decode())
            at = h64(t) & (BITS - 1)
            known[word] = hit = bool(t) and bool(int(bits[at >> 6]) >> (at & 63) & 1)
            return hit

        out: list[list] = [[] for _ in names]

        def sent():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            part = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
            for c in out:
                c.clear()
            return part

        for batch in batches:
            for doc_id, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                if len(known) > COUNTED:
                    known.clear()
                told = {w.decode() for w in set(text.encode().split()) if (known[w] if w in known else passes(w))}
                spans = base_spans(text) if told else []
                if told and (spans or everywhere):
                    for s, e in _outside(text, spans):
                        if text[s:e] in told:
                            for c, v in zip(out, (doc_id, th, _signed(h64(_term(text[s:e]))), s, e)):
                                c.append(v)
                            if len(out[0]) >= HITS:
                                yield sent()
        yield sent()

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, term long, start int, end int")


def find(docs: DataFrame, remove_bits: float = 1.0, generalise_bits: float = 3.0, everywhere: bool = False) -> DataFrame:
    """For every row of `docs` (doc_id, th, text): base columns and `terms`, the spans that the corpus discloses.

    A disclosed term counts in the documents of its entity, or, if `everywhere`, in all.
    """
    found = durable(base(docs), "pii")
    said = durable(found.where(F.size("entities") > 0).groupBy("th").agg(F.first("entities").alias("entities"), F.first("own").alias("own")), "pii-said")
    classes = durable(classes_of(said), "pii-classes")
    told = durable(disclosures(once(docs, found), said, classes, remove_bits, generalise_bits), "pii-told")
    places = hits(docs, docs.sparkSession.sparkContext.broadcast(_bitmap(told)), everywhere)
    if everywhere:
        places = places.join(durable(told.groupBy("term").agg(F.max("action").alias("action")), "pii-terms"), "term")
    else:
        places = places.join(told, "term").join(classes, ["th", "class"], "left_semi")
    terms = (
        places.groupBy("doc_id", "th", "start", "end")
        .agg(F.max("action").alias("action"))  # removed, if any entity asks for it
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("start", "action", "end")).alias("terms"))
        .select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th"), "terms")
    )
    on = (F.col("th") == F.col("t_th")) & F.col("doc_id").eqNullSafe(F.col("t_id"))
    return found.drop("entities", "own").join(terms, on, "left").drop("t_id", "t_th")


def _keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of `docs`.

    spans holds the base spans and, as term_removed or term_generalised, the disclosed
    terms.  A null text has none.  Repeated rows (doc_id and text) are one document as
    evidence and each come back, rows without doc_id too; two texts of one doc_id are two.
    Other columns are not read.  An empty table gives an empty result.
    """
    found = find(_keyed(docs), **options)
    split = F.transform(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")), lambda s: F.split(s, ":"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    bases = F.transform(split, lambda s: F.struct(s[1].cast("int").alias("a"), rank[s[0]].alias("k"), s[0].alias("kind"), s[2].cast("int").alias("b")))
    extra = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:int,action:string,end:int>>")),
        lambda s: F.struct(s["start"].alias("a"), F.lit(4).alias("k"), F.concat(F.lit("term_"), s["action"]).alias("kind"), s["end"].alias("b")),
    )
    said = F.transform(F.sort_array(F.concat(bases, extra)), lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"]))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_join(said, ",")).alias("spans")
    )


def redact(text: str, terms: list | None) -> str:
    """The text with base spans replaced by their kind and disclosed terms by their class or by nothing."""
    spans = [(a, f"[{KINDS[k].upper()}]", b) for a, k, b in base_spans(text)]
    for x in terms or ():
        word = text[x["start"] : x["end"]]
        kind = "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[TERM]"
        spans.append((x["start"], kind if x["action"] == "generalised" else "", x["end"]))
    out, at = [], 0
    for a, label, b in sorted(spans):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of `docs` with `text_col` redacted.

    Null texts stay null and empty ones empty.  Repeated rows are one document as evidence
    and are redacted alike; rows without doc_id are treated like others.  Columns of any
    other names come back as they are.  An empty table gives an empty one.
    """
    own_id, own_th, t_id, t_th, found = unused(docs, "id", "th", "t_id", "t_th", "terms")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select("*", F.col(id_col).cast("long").alias(own_id), F.xxhash64(text).alias(own_th))
    terms = (
        find(_keyed(docs, id_col, text_col), **options)
        .where("terms is not null")
        .groupBy(F.col("doc_id").alias(t_id), F.col("th").alias(t_th))
        .agg(F.first("terms").alias(found))
    )
    on = (F.col(own_th) == F.col(t_th)) & F.col(own_id).eqNullSafe(F.col(t_id))
    joined = keyed.join(terms.hint("shuffle_hash"), on, "left")

    @F.arrow_udf("string")
    def clean(text, found):
        return pa.array([None if t is None else redact(t, x) for t, x in zip(text.to_pylist(), found.to_pylist())], pa.string())

    new = clean(F.col(text_col).cast("string"), F.col(found))
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
