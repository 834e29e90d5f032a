"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenised and cut into pieces of at most `capacity` tokens.  Pieces are
sorted by range (longest first), which ranks them within their length.  Open sequences are
kept by the gap they have left.  A round takes the longest pieces without a place and
sweeps them, in rank order, over the gaps from their successor (the smallest gap that
holds them) upwards; where several pieces want one gap their rank decides; pieces that fit
nowhere open sequences; gaps are updated and the next round begins.

Scale.  Lengths and gaps are at most `capacity` (2,048), so a round works on runs: "pieces
of length l with ranks a to b go to sequences s onwards at offset o".  All that reaches
the driver is a histogram of at most `capacity` rows; ranks, sequence numbers and offsets
are found where the pieces are, so no step grows with the data but the range sort of one
small row a piece.  Best fit by runs equals best fit decreasing piece by piece.  A length
splits one interval of equal gaps at the most, so there are no more than 3 * `capacity` of
them, and the runs, which every task gets, do not grow with the data (4,055 at sf0.1).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seine.llm.tables import rows, texts
from seine.store import durable

#: Words of each of two generations that a worker remembers the ids of, and the longest that it remembers.
REMEMBERED, LONGEST = 200_000, 40
_SIMPLE = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes each byte: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer drops white space and never joins over it, so a text's ids are those of
    its white-space separated words.  Words that recur are looked up.  A new word of letters
    of _SIMPLE with marks after them is normalised here (lower case; it is composed already)
    and split as the tokenizer splits it, and its two parts go to the tokenizer's model;
    every other word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer: str):
        import re

        import public_tokenizers
        from tokenizers import Tokenizer

        at = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
        self.encoder = Tokenizer.from_file(at)
        self.model = self.encoder.model
        self.plain = re.compile(rf"([{_SIMPLE}{_SIMPLE.upper().replace('SS', '')}]*)([-.,;:!?()|#$%&*+=/_]*)")
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.encoder.get_vocab_size())]
        self.parts: dict[str, bytes] = {"": b""}
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the generation before; words still in use move on

    def forget(self) -> None:
        """Give the words' memory back; the tokenizer stays."""
        self.known, self.before, self.parts = {}, {}, {"": b""}

    def _part(self, part: str) -> bytes:
        seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        ids = b"".join([packed[t.id] for t in self.model.tokenize(seen)])
        self.parts[part] = ids
        return ids

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        if len(self.parts) > REMEMBERED:
            self.parts = {"": b""}
        plain, parts, known, before, packed = self.plain.fullmatch, self.parts, self.known, self.before, self.packed
        for w in [w for w in words if w not in known]:
            ids = before.get(w)
            if ids is None:
                if w.isalpha():  # ASCII letters only
                    a, b = w.lower().decode(), ""
                else:
                    m = plain(w.decode())
                    a, b = (m[1].lower(), m[2]) if m else (None, "")
                if a is None:
                    ids = b"".join([packed[i] for i in self.encoder.encode(w.decode(), add_special_tokens=False).ids])
                else:
                    ids = (parts[a] if a in parts else self._part(a)) + (parts[b] if b in parts else self._part(b))
            known[w] = ids

    def __call__(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [t.encode().split() for t in batch]
        held = set().union(*split)
        self.learn(held)
        known = self.known
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in held:
            if len(w) > LONGEST:
                del known[w]
        return out


@lru_cache(1)
def _word_ids(tokenizer: str) -> WordIds:
    """One tokenizer a worker process; its words are those of one task."""
    return WordIds(tokenizer)


_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
_PIECE_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every row of `docs` (see tables.texts)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        ids_of = _word_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: dict[str, list] = {n: [] for n in _PIECE_ARROW.names}
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of(part.column(1).to_pylist())):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        for n, v in zip(out, (doc_id, k, a // 4, len(own) // 4, zlib.crc32(own))):
                            out[n].append(v)
                yield rows(_PIECE_ARROW, out)
        ids_of.forget()  # a worker that waits, or serves other stages, keeps no words

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def sweep(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) of all rounds.

    The i-th piece of a run goes to sequence `first + i // each` at `offset + i % each * length`.
    A gap that holds several pieces of a length is filled with them before the next gap is
    opened, as piece-by-piece best fit does: after one piece it is the smallest that fits.
    """
    gaps: list[int] = []  # sorted sizes of gaps that exist
    held: dict[int, list[list[int]]] = {}  # gap -> intervals [first sequence, number] with that gap
    runs, opened = [], 0

    def put(gap: int, first: int, number: int) -> None:
        if gap <= 0 or number <= 0:
            return
        if gap not in held:
            held[gap] = []
            insort(gaps, gap)
        held[gap].append([first, number])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(gap: int, first: int, number: int) -> None:
            """Up to all that is left into `number` sequences from `first` with this gap."""
            nonlocal left, rank
            each = gap // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if left and number > full:  # fewer than `each` are left, for one gap
                runs.append((length, rank, left, first + full, each, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if gap < capacity:
                put(gap, first + full, number - full)

        at = bisect_left(gaps, length)
        while left and at < len(gaps):
            gap = gaps.pop(at)
            for first, number in held.pop(gap):
                if left:
                    place(gap, first, number)
                else:
                    put(gap, first, number)
            at = bisect_left(gaps, gap) if not left else max(at, bisect_left(gaps, gap))
        if left:
            each = capacity // length
            number = -(-left // each)
            first, opened = opened, opened + number
            place(capacity, first, number)
    return runs


def _ranked(found: DataFrame) -> DataFrame:
    """Pieces with their rank (from 0) within their length, in the order of one range sort."""
    by = [F.desc("length"), F.asc("doc_id"), F.asc("piece"), F.asc("ids_crc32")]
    schema = pa.schema([*_PIECE_ARROW, ("part", pa.int32()), ("local", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            length = batch.column(3).to_numpy()
            if not len(length):
                continue
            new = np.flatnonzero(np.r_[length[0] != last, length[1:] != length[:-1]])
            local = np.arange(len(length)) + (0 if length[0] != last else seen)
            if len(new):
                base = np.zeros(len(length), np.int64)
                base[new] = np.diff(np.r_[0, local[new]])
                local = local - np.cumsum(base)
            last, seen = length[-1], int(local[-1]) + 1
            extra = [pa.array(np.full(len(length), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=schema)

    sort = found.repartitionByRange(*by).sortWithinPartitions(*by)
    local = durable(sort.mapInArrow(run, _PIECE + ", part int, local long"), "ranked")
    counts = local.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return local.join(base, ["length", "part"]).select(*_PIECE_ARROW.names, (F.col("local") + F.col("base")).alias("rank"))


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all pieces of all rows.

    A null or empty text is the end id alone.  Repeated rows and rows without doc_id are
    packed like others.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = durable(pieces(texts(docs, id_col, text_col), tokenizer, capacity, end_id), "pieces")
    ranked = _ranked(found)
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = sorted(sweep(histogram, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    schema = pa.schema([*_PIECE_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        table = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 5))
            # the last run that begins at or before (length, rank)
            key = table[:, 0] * (1 << 50) + table[:, 1]
            at = np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1
            i = rank - table[at, 1]
            extra = [pa.array(table[at, 3] + i // table[at, 4]), pa.array(table[at, 5] + i % table[at, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], schema=schema)

    return ranked.mapInArrow(run, _PIECE + ", sequence_id long, offset long")


def report(docs: DataFrame) -> DataFrame:
    """`pack` with its defaults and lengths as long: null and empty texts, repeated rows, rows without doc_id and empty tables as there."""
    return pack(docs).withColumn("length", F.col("length").cast("long"))
