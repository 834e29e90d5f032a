"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into index blocks: every part of the index holds the
35-word windows that are dealt to it with their places.  A document is looked up in every
block that may hold its phrases and parsed greedily into factors (start, length, reference
document, reference start): from the first word that a match covers, the match that reaches
farthest is followed as far as its reference goes on alike; there the next factor begins.
At these boundaries the match is not cut: windows that straddle one are looked up as well,
so a factor of at least 35 words is found wherever its text stands twice, and the words of
factors are the duplicate spans.

Which windows to look up is decided by phrases: 8-word blocks chosen by content (the least
hash of each 28 consecutive ones), so that equal windows share a phrase at the same place.
Windows without a phrase that recurs have no match and stay literals.

Scale.  Both lookups (phrases, then windows) ask which values occur twice in the corpus.  A
map task first settles what it holds twice itself and sends one entry for it, so a passage
of a third of all documents costs one entry a task, not one a document.  Entries travel as
packed arrays dealt by phrase; those of the most frequent phrases, which stand in many
surroundings, by window.  A part of the index is gathered in memory and there are many parts
a task.  Replies are matches along one reference: runs of windows, not windows.  The text is
shuffled once and read for both joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.tables import rows, texts
from seine.store import durable

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Entries that a map task gathers before it sends them, and parts of the index for each shuffle partition.
GATHERED, PARTS = 4_000_000, 32
#: Places from which on a block is looked at for its frequency, and how many of the most frequent are dealt by window.
OFTEN, MOST_OFTEN = 1000, 20_000

_SENT = "part int, kind int, hash binary, more binary, copies binary, doc binary, pos binary, doc_id long, th long, ref_id long, ref_th long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SENT_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (x.strip().split(" ") for x in _SENT.split(","))])
_RUN = "doc_id long, th long, first int, n int, ref_id long, ref_th long, ref_first int"
_RUN_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.strip().split(" ") for x in _RUN.split(","))])


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were ever needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64)
                for b in (_BASE, _INVERSE)
            )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _spans(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive values."""
    up, down = _POWERS(len(words))
    total = np.r_[np.uint64(0), np.cumsum(words * up, dtype=np.uint64)]
    return _mixed((total[width:] - total[:-width]) * down[: len(words) - width + 1])


def _word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest as h64

    return np.array([h64(w) for w in text.encode().split()], np.uint64)


def _anchors(words: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the blocks, and for each window the position of its least block (the leftmost)."""
    hashed = _spans(words, block)
    view = np.lib.stride_tricks.sliding_window_view(hashed, window - block + 1)
    least = np.empty(len(view), np.int64)
    for at in range(0, len(view), 50_000):
        least[at : at + 50_000] = view[at : at + 50_000].argmin(axis=1)
    return hashed, least + np.arange(len(view))


def _runs(doc: np.ndarray, pos: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray):
    """Maximal runs (doc, first, number, ref, ref first) of places that follow one reference; repeats fall away."""
    order = np.lexsort((pos, doc))
    doc, pos, ref, ref_pos = (x[order].astype(np.int64) for x in (doc, pos, ref, ref_pos))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])][: len(doc)]
    doc, pos, ref, ref_pos = (x[new] for x in (doc, pos, ref, ref_pos))
    goes_on = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (ref[1:] == ref[:-1]) & (ref_pos[1:] == ref_pos[:-1] + 1)
    cut = np.flatnonzero(np.r_[True, ~goes_on][: len(doc)])
    return doc[cut], pos[cut], np.diff(np.r_[cut, len(doc)]), ref[cut], ref_pos[cut]


def _references(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For entries in groups (first position, size): the entry before in the group, and for the first one the second.

    Copies then follow the copy before them, and a text that repeats itself follows itself.
    """
    first = np.repeat(begin, size)
    at = np.arange(len(first))
    return np.where(at > first, at - 1, np.minimum(at + 1, first + np.repeat(size, size) - 1))


def _groups(value: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal (value, more) begin in sorted arrays, and their sizes."""
    new = np.r_[True, (value[1:] != value[:-1]) | (more[1:] != more[:-1])][: len(value)]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.r_[begin, len(value)])


def _sent(route, value, more, doc, pos, ids, ths, parts, follow):
    """Rows for the reducers.  Kind 1: packed entries; kind 0: runs that are settled here.

    An entry is (value, more), dealt by `route`; doc is an index into ids and ths.  Values
    held twice here are settled: their places leave as kind 0, and one entry of their first
    place tells the others; `copies` has how many places it stands for (0: it asks itself).
    """
    order = np.lexsort((more, value))
    route, value, more, doc, pos = (x[order] for x in (route, value, more, doc, pos))
    begin, size = _groups(value, more)
    many = np.repeat(size, size) > 1
    ref = _references(begin, size)[many] if follow else np.flatnonzero(many)
    for d, a, n, r, b in zip(*_runs(doc[many], pos[many], doc[ref], pos[ref])):
        part = (((ids[d] or 0) * _BASE + ths[d]) >> 32 & 0xFFFFFFFF) * parts >> 32  # copies share th, not doc_id
        yield part, 0, None, None, None, None, np.array([a, n, b], np.int32).tobytes(), ids[d], ths[d], ids[r], ths[r]
    copies = np.where(size > 1, size, 0).astype(np.uint32)
    route, value, more, doc, pos = (x[begin] for x in (route, value, more, doc, pos))
    part = ((route >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(part) else []
    ids, ths = np.array([x if x is not None else _NO_ID for x in ids], np.int64), np.array(ths, np.int64)
    for own in np.split(order, cuts[1:]) if len(cuts) else []:
        used, local = np.unique(doc[own], return_inverse=True)
        yield (
            int(part[own[0]]), 1, value[own].tobytes(), more[own].astype(np.uint32).tobytes(), copies[own].tobytes(),
            np.stack([ids[used], ths[used]]).tobytes() + local.astype(np.uint32).tobytes(), pos[own].astype(np.int32).tobytes(), None, None, None, None,
        )


#: Stands for a null doc_id inside packed arrays.
_NO_ID = -(1 << 63)


def _settle(batches, follow: bool):
    """Reducer: the runs of places whose (value, more) occurs twice or more among a part's entries.

    Runs `follow` one reference each, or are runs of places alone (each its own reference).
    Values of OFTEN places or more are told too, as rows of (null, value, -1, places).
    """
    part, held = None, []

    def done():
        value, more, copies, pos = (np.concatenate(x) for x in list(zip(*held))[:4])
        local, names, base = [], [], 0
        for *_, p, doc in held:
            local.append(np.frombuffer(doc[len(doc) - 4 * len(p) :], np.uint32).astype(np.int64) + base)
            names.append(np.frombuffer(doc[: len(doc) - 4 * len(p)], np.int64).reshape(2, -1))
            base += names[-1].shape[1]
        local, names = np.concatenate(local), np.concatenate(names, axis=1)
        order = np.lexsort((pos, names[1, local], names[0, local], more, value))  # a reference is the place before
        value, more, copies, pos, local = (x[order] for x in (value, more, copies, pos, local))
        begin, size = _groups(value, more)
        asks = (np.repeat(size, size) > 1) & (copies == 0)
        ref = _references(begin, size)[asks] if follow else np.flatnonzero(asks)
        doc, first, number, to, to_first = _runs(local[asks], pos[asks], local[ref], pos[ref])
        places = np.add.reduceat(np.maximum(copies, 1).astype(np.int64), begin) if len(begin) else begin
        often = np.flatnonzero(places >= OFTEN)
        none = np.full(len(often), _NO_ID)
        columns = [
            np.r_[names[0, doc], none], np.r_[names[1, doc], value[begin[often]].view(np.int64)], np.r_[first, np.full(len(often), -1)],
            np.r_[number, np.minimum(places[often], 1 << 30)], np.r_[names[0, to], none], np.r_[names[1, to], none], np.r_[to_first, np.full(len(often), -1)],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64(), mask=c == _NO_ID) if f.type == pa.int64() else pa.array(c.astype(np.int32)) for c, f in zip(columns, _RUN_ARROW)],
            schema=_RUN_ARROW,
        )

    for batch in batches:
        out: list = []
        for p, kind, value, more, copies, doc, pos, *place in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                a, n, b = np.frombuffer(pos, np.int32).tolist()
                out.append((place[0], place[1], a, n, place[2], place[3], b))
                continue
            if p != part and held:
                yield done()
                held = []
            part = p
            held.append((np.frombuffer(value, np.uint64), np.frombuffer(more, np.uint32), np.frombuffer(copies, np.uint32), np.frombuffer(pos, np.int32), doc))
        if out:
            yield rows(_RUN_ARROW, dict(zip(_RUN_ARROW.names, zip(*out))))
    if held:
        yield done()


def _sender(entries_of, parts: int, follow: bool):
    """A map function over (doc_id, th, text, ...) batches; entries_of(row) gives route, value, more, pos."""

    def run(batches):
        held, ids, ths, n = [], [], [], 0

        def flush():
            doc = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            joined = [np.concatenate(x) for x in zip(*held)]
            out: list = []
            for row in _sent(joined[0], joined[1], joined[2], doc, joined[3], ids, ths, parts, follow):
                out.append(row)
                if len(out) == 2000:
                    yield rows(_SENT_ARROW, dict(zip(_SENT_ARROW.names, zip(*out))))
                    out = []
            if out:
                yield rows(_SENT_ARROW, dict(zip(_SENT_ARROW.names, zip(*out))))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                entries = entries_of(row)
                if entries is None or not len(entries[0]):
                    continue
                held.append(entries)
                ids.append(row[0])
                ths.append(row[1])
                n += len(entries[0])
                if n >= GATHERED:
                    yield from flush()
                    held, ids, ths, n = [], [], [], 0
        if held:
            yield from flush()

    return run


def _twice(docs: DataFrame, entries_of, parts: int, follow: bool) -> DataFrame:
    """(doc_id, th, first, n, reference): runs of places whose entries occur twice or more over all of `docs`."""
    sent = docs.mapInArrow(_sender(entries_of, parts, follow), _SENT)
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _settle(batches, follow), _RUN)


def _by_text(runs: DataFrame, name: str, *more: str) -> DataFrame:
    """One row per (doc_id, th): its distinct runs, of which there are no more than its words."""
    return runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "n", *more)).alias(name))


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    names = [c for c in right.columns if c not in ("doc_id", "th")]
    right = right.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), *names)
    no = F.lit(_NO_ID)
    on = (F.col("th") == F.col("r_th")) & (F.coalesce("doc_id", no) == F.coalesce("r_id", no))
    return left.join(right.hint("merge"), on, how).drop("r_id", "r_th")


def _flags(runs: list | None, size: int) -> np.ndarray:
    """Positions in any run."""
    step = np.zeros(size + 1, np.int64)
    for x in runs or ():
        step[x["first"]] += 1
        step[min(x["first"] + x["n"], size)] -= 1
    return np.cumsum(step[:size]) > 0


def repeated_windows(docs: DataFrame, window: int = 35, block: int = 8, parts: int | None = None) -> DataFrame:
    """`docs` (see tables.texts, with th) left-joined to its runs of windows that start elsewhere too."""
    spark = docs.sparkSession
    parts = parts or PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(row):
        words = _word_hashes(row[2])
        if len(words) < window:
            return None
        hashed, at = _anchors(words, window, block)
        at = np.unique(at)
        value = hashed[at]
        return value, value, np.zeros(len(at), np.uint32), at

    def windows(row):
        words = _word_hashes(row[2])
        hashed, at = _anchors(words, window, block)
        hot = _flags(row[3], len(hashed))
        own = np.flatnonzero(hot[at])
        anchor, whole = hashed[at[own]], _spans(words, window)[own]
        often = shared.value
        known = often[np.minimum(np.searchsorted(often, anchor), len(often) - 1)] == anchor if len(often) else np.zeros(len(own), bool)
        return np.where(known, whole, anchor), whole, (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32), own

    recurring = durable(_twice(docs, blocks, parts, False), "blocks")
    # frequent blocks stand in many surroundings, so their windows are dealt one by one and not with their block
    most = recurring.where("first < 0").orderBy(F.desc("n"), "th").limit(MOST_OFTEN).select("th").toArrow()
    shared = spark.sparkContext.broadcast(np.sort(most["th"].to_numpy().view(np.uint64)))
    candidates = _by_text(recurring.where("first >= 0"), "hot")
    checked = _joined(docs, candidates, "inner").select("doc_id", "th", "text", "hot")
    return _joined(docs, _by_text(_twice(checked, windows, parts, True).where("first >= 0"), "runs", "ref_id", "ref_th", "ref_first"), "left")


def parse(runs: list | None, window: int) -> list[tuple[int, int, int | None, int, int]]:
    """Factors (start, length, ref_id, ref_th, ref_start) in words from a document's runs, by start; words between them are literals.

    Runs that go on along one reference (answers of different parts) are one match.  Greedy:
    the next factor begins at the first word past the last one that a match covers, with the
    match that reaches farthest, and ends where that match ends.
    """
    along: dict = {}
    for x in runs or ():
        along.setdefault((x["ref_id"], x["ref_th"], x["ref_first"] - x["first"]), []).append((x["first"], x["first"] + x["n"]))
    matches = []
    for (ref_id, ref_th, ahead), own in along.items():
        own.sort()
        start, end = own[0]
        for a, b in own[1:]:
            if a > end:
                matches.append((start, end + window - 1, ref_id, ref_th, ahead))
                start, end = a, b
            end = max(end, b)
        matches.append((start, end + window - 1, ref_id, ref_th, ahead))
    matches.sort(key=lambda m: (m[0], -m[1], m[4], m[3]))
    out, at, i, best = [], 0, 0, None
    while True:
        while i < len(matches) and matches[i][0] <= at:
            if best is None or matches[i][1] > best[1]:
                best = matches[i]
            i += 1
        if best is not None and best[1] > at:
            out.append((at, best[1] - at, best[2], best[3], at + best[4]))
            at = best[1]
        elif i < len(matches):
            at = matches[i][0]
        else:
            return out


def factors(docs: DataFrame, window: int = 35, block: int = 8, parts: int | None = None) -> DataFrame:
    """(doc_id, start, length, ref_doc_id, ref_start) of every row of `docs`: the factors of its parse, in words.

    The words from `start` on stand at `ref_start` of the reference document too.
    """
    found = repeated_windows(_hashed_texts(docs), window, block, parts).where("runs is not null").select("doc_id", "runs")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int32())])

    def run(batches):
        for batch in batches:
            out = [(doc_id, a, n, ref, b) for doc_id, runs in zip(*(c.to_pylist() for c in batch.columns)) for a, n, ref, _, b in parse(runs, window)]
            yield rows(schema, dict(zip(schema.names, zip(*out) if out else [[]] * len(schema))))

    return found.mapInArrow(run, "doc_id long, start int, length int, ref_doc_id long, ref_start int")


def _hashed_texts(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")


def report(docs: DataFrame, window: int = 35, block: int = 8, parts: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of `docs`; see `remove_repeats`."""
    found = repeated_windows(_hashed_texts(docs), window, block, parts).select("doc_id", "text", "runs")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                kept = words
                if runs:
                    kept, at = [], 0
                    for a, n, *_ in parse(runs, window):
                        kept += words[at:a]
                        at = a + n
                    kept += words[at:]
                for k, v in zip(out, (doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    out[k].append(v)
            yield rows(schema, out)

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 35, block: int = 8, parts: int | None = None) -> DataFrame:
    """(doc_id, text, removed) for every row of `docs`: kept words joined by a space; removed word spans.

    A word goes if a window of `window` words that covers it starts anywhere else too, in
    the same document or another; windows are judged on the input.  Null texts have no
    words.  Repeated rows are two places, so long repeated rows lose all words.  Rows
    without doc_id are treated like others.  Shorter texts than a window stay whole.
    """
    found = repeated_windows(_hashed_texts(docs), window, block, parts).select("doc_id", "text", "runs")
    kind = pa.struct([("first", pa.int32()), ("n", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed", pa.list_(kind))])

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                gone = np.zeros(len(words), bool)
                for a, n, *_ in parse(runs, window):
                    gone[a : a + n] = True
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                out["doc_id"].append(doc_id)
                out["text"].append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
                out["removed"].append([{"first": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
            yield rows(schema, out)

    return found.mapInArrow(run, "doc_id long, text string, removed array<struct<first:int,n:int>>")
