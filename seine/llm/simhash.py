"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most `radius` bits exactly if some value lies within
radius // 2 bits of one and radius - radius // 2 bits of the other.  So every distinct
fingerprint emits all variants within half the radius (2,081 for radius 4), variants are
shuffled, and fingerprints that meet in a variant are linked.

Scale.  Variants are never shuffled one by one.  They are dealt by their first `k` bits (the
slot), and a fingerprint goes once to every slot that holds any of its variants: 1 + k +
k(k-1)/2 small rows instead of 2,081.  The reducer of a slot expands the variants again,
splitting the slot bit by bit while they would exceed a fixed number, so memory is bounded
however dense a slot is.  Variants of even radius meet only at linked fingerprints (2 + 2
bits), and each slot returns a spanning forest, never pairs: rows stay linear in a group's
size.  Components follow from `connected_components` on stars.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.tables import texts, unused
from seine.operators.components import connected_components
from seine.store import durable

#: Variants that a reducer holds at once (16 MB), and that a slot is meant to hold.
HELD, PER_SLOT = 2_000_000, 1_000_000


def shingle_hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the lower-cased word shingles of all lines, and where each line's end."""
    from xxhash import xxh64_intdigest as h64

    hashes: list[int] = []
    ends = np.zeros(len(lines), np.int64)
    for i, text in enumerate(lines):
        words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
        if words:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            if len(words) <= width:
                hashes.append(h64(joined, 42))
            else:
                start = (end - size)[: len(words) - width + 1].tolist()
                hashes.extend([h64(joined[a:b], 42) for a, b in zip(start, end[width - 1 :].tolist())])
        ends[i] = len(hashes)
    return np.array(hashes, dtype=np.uint64), ends


def _fingerprint_batch(lines: list[str], width: int) -> np.ndarray:
    got, ends = shingle_hashes(lines, width)
    ones = np.zeros((len(lines), 64), np.int64)
    owner = np.searchsorted(ends, np.arange(len(got)), side="right")
    for at in range(0, len(got), 100_000):
        part, own = got[at : at + 100_000], owner[at : at + 100_000]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    count = np.diff(np.r_[0, ends])
    return np.packbits(ones * 2 > count[:, None], axis=1, bitorder="little").reshape(-1, 8).copy().view(np.int64)[:, 0]


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): 64 majority bits of XXH64 (seed 42) over lower-cased word shingles.

    A text of fewer words than `width` is one shingle; one without words (or null) has fp 0.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_fingerprint_batch(part.column(1).to_pylist(), width))], ["doc_id", "fp"]
                )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, most: int) -> np.ndarray:
    """All values of at most `most` set bits among the lowest `bits`."""
    return np.array(
        [sum(1 << i for i in c) for n in range(min(most, bits) + 1) for c in combinations(range(bits), n)], np.uint64
    )


class _Forest:
    """Union-find over positions, in bulk."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _meet(fp: np.ndarray, left: np.ndarray, free: int, forest: _Forest, masks: dict, held: int) -> None:
    """Link positions that share a variant; `left` has the bits each may still change among the `free` lowest."""
    stack = [(np.arange(len(fp)), left, free)]
    while stack:
        at, left, free = stack.pop()
        if len(at) < 2 or not (forest.root[at] != forest.root[at[0]]).any():
            continue
        size = np.array([sum(math.comb(free, i) for i in range(n + 1)) for n in range(int(left.max()) + 1)])
        if free == 0 or size[left].sum() <= held:
            low = fp[at] & np.uint64((1 << free) - 1)
            values, owner = [], []
            for n in np.unique(left):
                own = np.flatnonzero(left == n)
                if (free, int(n)) not in masks:
                    masks[free, int(n)] = _masks(free, int(n))
                mask = masks[free, int(n)]
                values.append((low[own][:, None] ^ mask[None, :]).ravel())
                owner.append((own, len(mask)))
            values = np.concatenate(values)
            order = np.sort(values)
            met = np.unique(order[1:][order[1:] == order[:-1]])
            if len(met):
                hit = np.flatnonzero(met[np.minimum(np.searchsorted(met, values), len(met) - 1)] == values)
                whose = np.concatenate([np.repeat(own, n) for own, n in owner])[hit]
                by = np.argsort(values[hit], kind="stable")
                value, whose = values[hit][by], at[whose[by]]
                same = value[1:] == value[:-1]
                forest.join(whose[:-1][same], whose[1:][same])
            continue
        bit = (fp[at] >> np.uint64(free - 1)) & np.uint64(1)
        for side in (0, 1):
            own = bit == side
            stay = own | (left > 0)
            stack.append((at[stay], np.where(own, left, left - 1)[stay], free - 1))


def _links(slot: int, fp: np.ndarray, node: np.ndarray, half: int, k: int, masks: dict, held: int):
    """A spanning forest, as (least node, other node), of the fingerprints whose variants share this slot."""
    order = np.argsort(node, kind="stable")
    fp, node = fp[order].view(np.uint64), node[order]
    forest = _Forest(len(fp))
    changed = np.bitwise_count((fp >> np.uint64(64 - k)) ^ np.uint64(slot)).astype(np.int64)
    _meet(fp, half - changed, 64 - k, forest, masks, held)
    other = np.flatnonzero(forest.root != np.arange(len(fp)))
    return node[forest.root[other]], node[other]


def ball_links(nodes: DataFrame, radius: int = 4, k: int = 8, held: int = HELD) -> DataFrame:
    """(src, dst) links that connect all of `nodes` (fp, node; fp unique) within an even `radius` bits."""
    if radius % 2 or not 2 <= k <= 32:
        raise ValueError("an even radius and 2 to 32 slot bits")
    half = radius // 2
    slots = F.explode(F.array(*[F.lit(int(m)) for m in _masks(k, half)])).alias("m")
    dealt = nodes.select("fp", "node", slots).select(
        F.shiftrightunsigned("fp", 64 - k).bitwiseXOR(F.col("m")).alias("slot"), "fp", "node"
    )

    def run(batches):
        masks: dict = {}
        slot, fps, ids = None, [], []

        def done():
            a, b = _links(slot, np.concatenate(fps), np.concatenate(ids), half, k, masks, held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

        for batch in batches:
            s, f, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else []
            for a, b in zip(cuts, [*cuts[1:], len(s)]):
                if slot is not None and s[a] != slot:
                    yield done()
                    fps, ids = [], []
                slot = int(s[a])
                fps.append(f[a:b])
                ids.append(n[a:b])
        if fps:
            yield done()

    return dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "src long, dst long")


def slot_bits(count: int, radius: int = 4) -> int:
    """Slot bits at which the variants of `count` fingerprints make slots of PER_SLOT, in 8 to 24."""
    variants = count * sum(math.comb(64, i) for i in range(radius // 2 + 1))
    return min(24, max(8, math.ceil(math.log2(max(1, variants / PER_SLOT)))))


def near_duplicates(
    docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable over fingerprints at most `radius` bits
    apart, the row's own included.  Repeated rows each come back; a row without a doc_id
    gets the component of its fingerprint's other rows, or null, and links nothing itself.
    Null and word-less texts share fingerprint 0.  An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, width, id_col, text_col), "simhash")
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = durable(nodes, "simhash-nodes")
    links = ball_links(nodes, radius, slot_bits(nodes.count(), radius))
    found = connected_components(links)
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `docs` whose doc_id and fingerprint name their component; rows without doc_id stay.

    A component is named by its smallest doc_id, and of that one's texts by the smallest
    fingerprint.  Rows repeated with their text all stay: they are the same document.
    """
    found = durable(near_duplicates(docs, width, radius), "simhash-found")
    named = durable(found.where("doc_id = component_id").groupBy("component_id").agg(F.min("fp").alias("own")), "simhash-own")
    lose = found.join(named, "component_id").where("doc_id <> component_id or fp <> own").select("doc_id", "fp")
    return _without(docs, lose.distinct(), width)


def _without(docs: DataFrame, lose: DataFrame, width: int) -> DataFrame:
    """`docs` less the rows of `lose` (doc_id, fp)."""
    lost, lost_fp, print_ = unused(docs, "lost", "fp", "own")
    lose = lose.select(F.col("doc_id").alias(lost), F.col("fp").alias(lost_fp))

    @F.arrow_udf("long")
    def print_of(lines):
        return pa.array(_fingerprint_batch(lines.to_pylist(), width), pa.int64())

    own = docs.withColumn(print_, print_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    on = (F.col("doc_id").cast("long") == F.col(lost)) & (F.col(print_) == F.col(lost_fp))
    return own.join(lose, on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
