"""Near copies by word shingles: SimHash blocks, balls that meet in the middle, exact verification.

Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles is at
least `least` (0.8).  Such sets differ in some 15 % of the bits of a SimHash, too many for one
ball, so a text has a sketch of `blocks` independent blocks of `bits` bits, and each block has
a ball of its own: texts that come within `radius` bits in any block meet in a variant.  At
the defaults (32 blocks of 32 bits, radius 2) a pair of similarity 0.8 is missed with
probability 0.02, one of 0.85 with 0.001.  Ties in a bit's vote go to the least shingle, so
short texts are spread like long ones.  Of sets of at most 9 shingles, near ones differ by
one shingle at the most: these are found by their sets less one, exactly.

Colliding pairs are verified by their shingles.  Not all of them: a first pass verifies up
to twelve partners of each text; a second one returns every colliding pair that the verified
links have not brought together yet.  No link is lost, and a large group of near copies
costs a few links a text and no pairs.

Scale.  Texts of the same shingles are one node, so exact copies cost nothing.  Entries
(block, value, check bits, node) are dealt by block and the value's first bits; the reducer
expands their variants and splits a slot while it would exceed a fixed number.  64 bits of
the sketch travel along and turn away 99.8 % of chance collisions before they are sent.
Shingles are read for the candidate pairs alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.simhash import HELD, _Forest, _masks, shingle_hashes
from seine.llm.tables import texts, unused
from seine.operators.components import connected_components
from seine.store import durable, release

#: Shingles sketched at a time, entries gathered by a map task, and variants that a slot is meant to hold.
AT_ONCE, GATHERED, PER_SLOT = 50_000, 1_000_000, 8_000_000
#: Bits of 64 by which the check bits of a pair may differ; at similarity 0.8 more are 1 in 3,000.
CHECK = 20
#: Shingles of sets that are also compared less one.
SHORT = 9
_ONES = np.uint64(0x0101010101010101)
_LANE = np.random.default_rng(64).integers(0, 1 << 63, 64, dtype=np.uint64)


def _lane(hashes: np.ndarray, j: int) -> np.ndarray:
    x = (hashes ^ _LANE[j]) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sketch(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """(texts, lanes) of 64 majority bits each, from the texts' distinct shingle hashes, sorted and never empty.

    Bits are counted eight at a time in the bytes of a word, over stretches of at most 255.
    """
    out = np.zeros((len(sets), lanes), np.uint64)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right")))
        hashes = np.concatenate(sets[a:b])
        first = np.r_[0, np.cumsum(size[a:b])[:-1]]
        stretches = [np.arange(s, s + n, 255) for s, n in zip(first.tolist(), size[a:b].tolist())]
        cut = np.concatenate(stretches)
        own = np.r_[0, np.cumsum([len(x) for x in stretches])[:-1]]
        for j in range(lanes):
            m = _lane(hashes, j)
            ones = np.empty((b - a, 8, 8), np.int64)  # byte, bit
            for k in range(8):
                part = np.add.reduceat((m >> np.uint64(k)) & _ONES, cut).view(np.uint8).reshape(-1, 8)
                ones[:, :, k] = np.add.reduceat(part, own, axis=0, dtype=np.int64)
            tie = np.unpackbits(m[first].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 8, 8)
            bits = 2 * ones + tie > size[a:b, None, None]
            out[a:b, j] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
        a = b
    return out


_SKETCH_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("shingles", pa.binary()), ("fewer", pa.list_(pa.int64()))]
)
_SKETCH = "doc_id long, th long, node long, n int, sketch binary, shingles binary, fewer array<long>"


def sketches(docs: DataFrame, width: int, lanes: int) -> DataFrame:
    """One row for each (doc_id, th, text): `node` names the set of its `n` distinct shingles; texts without words share one.

    `fewer` has the names of the sets less one shingle, for sets of SHORT or fewer.
    """

    def run(batches):
        from xxhash import xxh64_intdigest as h64

        def names(sets):
            return np.array([h64(s.tobytes()) for s in sets], np.uint64).view(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, ths, lines = (c.to_pylist() for c in batch.slice(at, 500).columns)
                hashes, ends = shingle_hashes(lines, width)
                sets = [np.unique(x) for x in np.split(hashes, ends[:-1])]
                some = [i for i, s in enumerate(sets) if len(s)]
                found = sketch([sets[i] for i in some], lanes) if some else np.zeros((0, lanes), np.uint64)
                bits: list = [None] * len(sets)
                for i, row in zip(some, found):
                    bits[i] = row.tobytes()
                fewer = [names([np.delete(s, i) for i in range(len(s))]).tolist() if 1 < len(s) <= SHORT else None for s in sets]
                short = [(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(names(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
                    + [pa.array(bits, pa.binary()), pa.array(short, pa.binary()), pa.array(fewer, pa.list_(pa.int64()))],
                    schema=_SKETCH_ARROW,
                )

    return docs.mapInArrow(run, _SKETCH)


_ENTRY_ARROW = pa.schema([("slot", pa.int64()), ("value", pa.int64()), ("check", pa.int64()), ("node", pa.int64()), ("label", pa.int64())])
_ENTRY = "slot long, value long, check long, node long, label long"


def _dealt(nodes: DataFrame, blocks: int, bits: int, half: int, k: int) -> DataFrame:
    """Every block of every node (node, sketch, label) to each slot that holds any variant of it; the last lane is the check."""
    masks = _masks(k, half)

    def run(batches):
        for batch in batches:
            step = max(1, 500_000 // (blocks * len(masks)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                node, label = (part.column(i).to_numpy() for i in (0, 2))
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(node), -1)
                wide = np.zeros((len(node), blocks, 8), np.uint8)
                wide[:, :, : bits // 8] = raw[:, : blocks * bits // 8].reshape(len(node), blocks, bits // 8)
                value = wide.view(np.uint64)[:, :, 0]
                check = raw[:, -8:].copy().view(np.int64)[:, 0]
                high = (value >> np.uint64(bits - k))[:, :, None] ^ masks
                slot = (np.arange(blocks, dtype=np.uint64) << np.uint64(k))[None, :, None] | high
                shape, n = slot.shape, blocks * len(masks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot.ravel().view(np.int64)),
                        pa.array(np.broadcast_to(value[:, :, None], shape).reshape(-1).view(np.int64)),
                        pa.array(np.repeat(check, n)),
                        pa.array(np.repeat(node, n)),
                        pa.array(np.repeat(label, n)),
                    ],
                    schema=_ENTRY_ARROW,
                )

    return nodes.select("node", "sketch", "label").mapInArrow(run, _ENTRY)


def _meetings(value: np.ndarray, left: np.ndarray, free: int, label: np.ndarray, masks: dict, held: int):
    """Arrays of positions in order of a shared variant, and whether the next one shares it; only variants of two labels.

    `left` has the bits each value may still change among the `free` lowest.
    """
    stack = [(np.arange(len(value)), left, free)]
    while stack:
        at, left, free = stack.pop()
        if len(at) < 2 or not (label[at] != label[at[0]]).any():
            continue
        size = np.array([sum(math.comb(free, i) for i in range(n + 1)) for n in range(int(left.max()) + 1)])
        if free == 0 or size[left].sum() <= held:
            low = value[at] & np.uint64((1 << free) - 1)
            variants, whose = [], []
            for n in np.unique(left):
                own = np.flatnonzero(left == n)
                if (free, int(n)) not in masks:
                    masks[free, int(n)] = _masks(free, int(n))
                mask = masks[free, int(n)]
                variants.append((low[own][:, None] ^ mask[None, :]).ravel())
                whose.append(np.repeat(own, len(mask)))
            variants, whose = np.concatenate(variants), np.concatenate(whose)
            order = np.argsort(variants, kind="stable")
            variants, whose = variants[order], at[whose[order]]
            same = np.r_[variants[1:] == variants[:-1], False]
            group = np.cumsum(np.r_[0, ~same[:-1]])
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[:-1][same[:-1] & (label[whose[1:]] != label[whose[:-1]])]] = True
            keep = mixed[group]
            if keep.any():
                yield whose[keep], same[keep]
            continue
        bit = (value[at] >> np.uint64(free - 1)) & np.uint64(1)
        for side in (0, 1):
            own = bit == side
            stay = own | (left > 0)
            stack.append((at[stay], np.where(own, left, left - 1)[stay], free - 1))


def slot_pairs(slot: int, value, check, node, label, half: int, bits: int, k: int, every: bool, masks: dict, held: int):
    """(a, b) nodes of a slot that share a variant, bear different labels and pass the check bits, a < b.

    `every`: all of them.  Otherwise the first of each variant with each other one, unless
    earlier pairs of this slot have joined the two.
    """
    order = np.lexsort((label, node))
    value, check, node, label = (x[order].view(np.uint64) if i < 2 else x[order] for i, x in enumerate((value, check, node, label)))
    changed = np.bitwise_count((value >> np.uint64(bits - k)) ^ np.uint64(slot & ((1 << k) - 1))).astype(np.int64)
    forest = _Forest(len(value))
    out = [np.zeros((0, 2), np.int64)]

    def sent(a, b):
        near = (label[a] != label[b]) & (np.bitwise_count(check[a] ^ check[b]) <= CHECK)
        if not every:
            near &= forest.root[a] != forest.root[b]
        pairs = np.unique(np.stack([a[near], b[near]], axis=1), axis=0)
        forest.join(pairs[:, 0], pairs[:, 1])
        out.append(pairs)

    for whose, same in _meetings(value, half - changed, bits - k, label, masks, held):
        if not every:
            first = np.r_[True, ~same[:-1]]
            hub = whose[np.maximum.accumulate(np.where(first, np.arange(len(whose)), 0))]
            sent(np.minimum(hub[~first], whose[~first]), np.maximum(hub[~first], whose[~first]))
            continue
        at = np.flatnonzero(same)
        far = 1
        while len(at):  # positions with a `far`-th next one in their variant
            sent(np.minimum(whose[at], whose[at + far]), np.maximum(whose[at], whose[at + far]))
            at = at[same[at + far]]
            far += 1
    found = np.unique(np.concatenate(out), axis=0)
    a, b = node[found[:, 0]], node[found[:, 1]]
    return np.minimum(a, b), np.maximum(a, b)


def colliding(nodes: DataFrame, blocks: int, bits: int, radius: int, k: int, every: bool, held: int = HELD) -> DataFrame:
    """(a, b) pairs of `nodes` (node, sketch, label) that meet in a block; repeats may come."""
    half = radius // 2

    def run(batches):
        masks: dict = {}
        slot, parts = None, []

        def done():
            a, b = slot_pairs(slot, *(np.concatenate(x) for x in zip(*parts)), half, bits, k, every, masks, held)
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            s = columns[0]
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]).tolist() if len(s) else []
            for x, y in zip(cuts, [*cuts[1:], len(s)]):
                if slot is not None and int(s[x]) != slot:
                    yield from done()
                    parts = []
                slot = int(s[x])
                parts.append([c[x:y] for c in columns[1:]])
        if parts:
            yield from done()

    dealt = _dealt(nodes, blocks, bits, half, k)
    return dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "a long, b long")


def slot_bits(count: int, bits: int, half: int) -> int:
    variants = count * sum(math.comb(bits, i) for i in range(half + 1))
    return min(bits - 8, max(2, math.ceil(math.log2(max(1, variants / PER_SLOT)))))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The `pairs` (a, b), each once, whose shingle sets (node, shingles) have a Jaccard similarity of `least` or more."""

    @F.arrow_udf("boolean")
    def near(left, right):
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                out.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(shared >= least * (len(both) - shared) - 1e-9)
        return pa.array(out, pa.bool_())

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.distinct().join(one, "a").join(two, "b").where(near("sa", "sb")).select("a", "b")


def _partners(pairs: DataFrame) -> DataFrame:
    """Up to twelve partners of each second node: the ends of six orders."""
    orders = [F.col("a"), *[F.xxhash64("a", F.lit(i)) for i in range(5)]]
    picks = [end("a", o) for o in orders for end in (F.min_by, F.max_by)]
    return pairs.groupBy("b").agg(F.array_distinct(F.array(*picks)).alias("a")).select(F.explode("a").alias("a"), "b")


def groups(found: DataFrame, least: float, blocks: int, bits: int, radius: int) -> DataFrame:
    """(node, component) of the nodes with links, from sketches(): the two passes of the module's text."""
    nodes = durable(found.where(F.col("n") >= math.ceil(least / (1 - least) - 1e-9)).select("node", "sketch").dropDuplicates(["node"]), "near-nodes")
    sets = found.select("node", "shingles")
    fewer = found.where("fewer is not null").select("node", "fewer").dropDuplicates(["node"]).select(F.col("node").alias("a"), F.explode("fewer").alias("b"))
    nested = fewer.join(found.select(F.col("node").alias("b")).distinct(), "b").select("a", "b")
    k = slot_bits(nodes.count(), bits, radius // 2)

    def links(labelled: DataFrame, every: bool) -> DataFrame:
        pairs = colliding(labelled, blocks, bits, radius, k, every)
        pairs = durable(pairs if every else _partners(pairs).unionByName(nested), "near-pairs")
        asked = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-asked")
        own = durable(sets.join(asked, "node", "left_semi").dropDuplicates(["node"]), "near-sets")
        out = durable(verified(pairs, own, least), "near-links")
        for df in (pairs, asked, own):
            release(df)
        return out

    one = links(nodes.withColumn("label", F.col("node")), False)
    label = durable(connected_components(one, "a", "b"), "near-labels")
    labelled = nodes.join(label, "node", "left").select("node", "sketch", F.coalesce("component", "node").alias("label"))
    two = links(labelled, True)
    whole = durable(connected_components(one.unionByName(two), "a", "b"), "near-components")
    for df in (one, two, label, nodes):
        release(df)
    return whole


def near_copies(
    docs: DataFrame, width: int = 5, least: float = 0.8, blocks: int = 32, bits: int = 32, radius: int = 2
) -> DataFrame:
    """(doc_id, th, component) for every row of `docs` (doc_id, th, text never null): rows of one component are near copies.

    Words are those of `simhash`, lower-cased; a text of fewer words than `width` is one
    shingle, and texts without words are copies of each other.
    """
    if radius % 2 or bits % 8 or not 0.5 < least < 1:
        raise ValueError("an even radius, whole bytes a block and a similarity between 0.5 and 1")
    lanes = -(-blocks * bits // 64) + 1
    found = durable(sketches(docs.select("doc_id", "th", "text"), width, lanes), "near")
    named = durable(groups(found, least, blocks, bits, radius), "near-groups")
    out = durable(found.join(named, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("component")), "near-found")
    for df in (found, named):
        release(df)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stand for their group of near copies (see `near_copies`); columns stay.

    The smallest id of a group stays, and of that one's texts the one of the smallest hash.
    Rows without id stay and let no other go; rows repeated with their text are the same
    document and stay or go together.  Null and wordless texts are one group.  An empty
    table gives an empty one.
    """
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = near_copies(texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text"), **options)
    named = found.where("doc_id is not null")
    best = durable(named.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("best")), "near-best")
    lost, lost_th = unused(docs, "lost", "th")
    lose = named.join(best, "component").where("struct(doc_id, th) <> best").select(F.col("doc_id").alias(lost), F.col("th").alias(lost_th)).distinct()
    lose = durable(lose, "near-lost")
    for df in (found, best):
        release(df)
    on = (F.col(id_col).cast("long") == F.col(lost)) & (th == F.col(lost_th))
    return docs.join(lose, on, "left_anti")
