"""Order MinHash fingerprints of documents.

The k-mers of a text (k code points, numbered by occurrence so that repeats differ) are
hashed by each of m functions; the `keep` least of each are put in the order in which they
stand in the text, and the tuple of their k-mers is hashed to one value of the signature.  Two
texts agree in a value if they share the k-mers and their order, so agreement falls with
edit distance, not only with lost content.

Scale.  Hashing is local to a row and vectorised.  The query also needs each document's
successor by doc_id: documents are dealt once by ranges of (doc_id, hash of the text), with
bounds from quantiles, one range a task, sorted, and streamed with one row held back; the
first row of each range also goes to the range before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.tables import rows, texts

_RNG = np.random.default_rng(20170)
#: Odd multipliers of up to 256 hash functions, and the elements hashed at a time (L2 cache).
_A = (_RNG.integers(0, 1 << 32, 256, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_AT_ONCE = 60_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _kmers(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each k-mer; a shorter text is one k-mer, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(codes):
        return codes
    k = min(k, len(codes))
    mixed = _mixed(codes + np.uint64(1))
    n = len(codes) - k + 1
    total = mixed[:n].copy()
    for i in range(1, k):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += mixed[i : n + i]
    return _mixed(total)


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """The k-mers with their occurrence number, hashed to 32 bits.

    Equal k-mers are found by one sort of (hash, position) packed into 64 bits.
    """
    n = len(kmers)
    bits = np.uint64(n.bit_length())
    low = np.uint64((1 << n.bit_length()) - 1)
    packed = (kmers & ~low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    own = packed >> bits
    same = np.flatnonzero(own[1:] == own[:-1]) + 1  # not the first of their kind
    out = kmers.copy()
    if len(same):
        first = np.r_[True, np.diff(same) != 1]  # a run of neighbours is one kind
        start = np.maximum.accumulate(np.where(first, same, 0)) - 1
        number = (same - start).astype(np.uint64)
        at = (packed[same] & low).astype(np.int64)
        out[at] = _mixed(kmers[at] + number * np.uint64(0xD6E8FEB86659FD93))
    return (out >> np.uint64(32)).astype(np.uint32)


def signature(text: str, k: int = 8, m: int = 64, keep: int = 2) -> np.ndarray:
    """m 16-bit values; all zero for an empty text."""
    kmers = _kmers(text, k)
    n = len(kmers)
    if not n:
        return np.zeros(m, np.uint16)
    numbered = _numbered(kmers)
    keep = min(keep, n)
    step = min(m, max(1, _AT_ONCE // n))
    at = np.empty((m, keep), np.int64)
    hashed = np.empty((step, n), np.uint32)
    for a in range(0, m, step):
        use = hashed[: min(step, m - a)]
        np.multiply(numbered[None, :], _A[a : a + len(use), None], out=use)
        row = np.arange(len(use))
        for i in range(keep):
            least = use.argmin(axis=1)
            at[a : a + len(use), i] = least
            use[row, least] = 0xFFFFFFFF
    at.sort(axis=1)
    value = np.zeros(m, np.uint64)
    for i in range(keep):
        value = _mixed(value * np.uint64(31) + kmers[at[:, i]])
    return (value >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray, keep: int = 2) -> float:
    """From 0 to 1: the keep-th root of the share of equal values, which estimates shared k-mers in order."""
    return float(np.mean(a == b) ** (1 / keep))


def text_of(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = 8, m: int = 64, keep: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; null texts count as empty, repeated rows each come back."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            ids, lines = (c.to_pylist() for c in batch.columns)
            yield rows(schema, {"doc_id": ids, "fingerprint": [text_of(signature(t, k, m, keep)) for t in lines]})

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _task_keys(spark, parts: int) -> str:
    """For each of `parts` ranges an integer that Spark deals to a task of its own, comma-joined."""
    dealt = spark.range(30 * parts).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(parts)).alias("p"))
    key = {r["p"]: r["k"] for r in dealt.groupBy("p").agg(F.min("k").alias("k")).collect()}  # a row a range
    return ",".join(str(key.get(i, i)) for i in range(parts))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, doc_id, text, ghost), dealt and sorted so that each row's successor follows it.

    The order is by doc_id (rows without come last), then hash of the text, then text.  A
    doc_id that fills several ranges (or rows without one) is split by the hash.  A ghost is
    the first row of the next range that has rows; for the last range, the first row of all.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (1 << 63) - 1
    own = docs.select(F.coalesce("doc_id", F.lit(last)).alias("at"), F.xxhash64("text").alias("th"), "doc_id", "text")
    steps = [i / parts for i in range(1, parts)]
    found = sorted(min(int(b), last) for b in own.approxQuantile("at", steps, 0.2 / parts)) if steps else []
    edges, split = [], {}  # range r begins at edges[r - 1]; split: into how many it is dealt, if one value fills it
    for value in sorted(set(found)):
        often = found.count(value)
        if often > 1:
            if not edges or edges[-1] < value:
                edges.append(value)
            split[len(edges)] = often
            if value < last:
                edges.append(value + 1)
        elif not edges or edges[-1] < value:
            edges.append(value)
    width = np.array([split.get(r, 1) for r in range(len(edges) + 1)], np.int64)
    offset, edges = np.r_[0, np.cumsum(width)[:-1]], np.array(edges, np.int64)
    number = int(width.sum())

    @F.pandas_udf("int")
    def part_of(at, th):
        import pandas as pd

        r = np.searchsorted(edges, at.to_numpy(), side="right")
        place = (th.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of signed hashes
        return pd.Series(offset[r] + (place.astype(np.int64) * width[r] >> 32))

    dealt = own.withColumn("part", part_of("at", "th"))
    held = {r["part"]: tuple(r["x"]) for r in dealt.groupBy("part").agg(F.min(F.struct("at", "th")).alias("x")).collect()}  # a row a range
    used = sorted(held)
    to = [used[-1], *used[:-1]] if used else []
    firsts = spark.createDataFrame([(b, p, *held[p]) for b, p in zip(to, used)], "before int, part int, at long, th long")
    first = dealt.join(F.broadcast(firsts), ["part", "at", "th"]).groupBy("before", "part", "at", "th").agg(F.min("text").alias("text"))  # a row a range
    ghosts = first.select(F.col("before").alias("part"), "at", "th", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("ghost"))
    every = dealt.select("part", "at", "th", "doc_id", "text", F.lit(0).alias("ghost")).unionByName(ghosts)
    task = F.get(F.split(F.lit(_task_keys(spark, number)), ","), F.col("part")).cast("int")
    return (
        every.repartition(number, task)
        .sortWithinPartitions("part", "ghost", "at", "th", "text")
        .select("part", "doc_id", "text", "ghost")
    )


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def report(docs: DataFrame, k: int = 8, m: int = 64, keep: int = 2, parts: int | None = None) -> DataFrame:
    """Each document against itself edited and against the next one by doc_id.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document; after the last document comes the first.  A null
    text counts as empty.  Repeated rows follow each other, texts of one doc_id in the order
    of their hashes, rows without doc_id come last.  An empty table gives an empty result.
    """

    def run(batches):
        last = None  # (part, doc_id, text, signature) of the row that waits for its successor

        def against(text, sign):
            _, doc_id, own, mine = last
            cut = len(own) // 4
            edited = own[: len(own) - cut] + text[:cut]
            new = mine if edited == own else signature(edited, k, m, keep)
            digest = hashlib.sha256(edited.encode()).hexdigest()
            return doc_id, len(own), digest, text_of(mine), text_of(new), likeness(mine, new, keep), likeness(mine, sign, keep)

        for batch in batches:
            out: list = []
            for part, doc_id, text, ghost in zip(*(c.to_pylist() for c in batch.columns)):
                sign = signature(text, k, m, keep)
                if last is not None and last[0] == part:
                    out.append(against(text, sign))
                last = None if ghost else (part, doc_id, text, sign)
                if len(out) == 500:
                    yield rows(_SCHEMA, dict(zip(_SCHEMA.names, zip(*out))))
                    out = []
            if out:
                yield rows(_SCHEMA, dict(zip(_SCHEMA.names, zip(*out))))

    return with_next(texts(docs), parts).mapInArrow(run, _DDL)
