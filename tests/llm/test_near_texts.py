"""Near copies by shingles against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest

from seine.llm import near_texts
from seine.llm.simhash import shingle_hashes
from tests.llm.test_ten_operators import hostile, SCHEMA


def sets_of(texts):
    hashes, ends = shingle_hashes(texts, 5)
    return [frozenset(x.tolist()) for x in np.split(hashes, ends[:-1])]


def kept_by_brute_force(rows):
    """(doc_id, text) of the rows that stay, by all pairs."""
    sets = dict(zip([t for _, t in rows], sets_of([t for _, t in rows])))
    group = {s: s for s in sets.values()}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    every = list(group)
    for i, a in enumerate(every):
        for b in every[:i]:
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                group[root(a)] = root(b)
    least = {}
    for i, t in rows:
        if i is not None:
            own = root(sets[t])
            least[own] = min(least.get(own, i), i)
    return [(i, t) for i, t in rows if i is None or least[root(sets[t])] == i]


def near_rows(rng):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (5, 8, 9, 10, 11, 12, 13, 30, 60, 120, 250, 400):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            rows.append(" ".join(base))
            for _ in range(2):
                copy = list(base)
                if n < 30:
                    copy = copy[: n - rng.randint(0, 1)]
                else:
                    for _ in range(rng.randint(1, max(1, n // 80))):
                        copy[rng.randrange(n)] = rng.choice(words)
                rows.append(" ".join(copy))
    base = [rng.choice(words) for _ in range(200)]  # a group whose members resemble the base more than each other
    for _ in range(40):
        copy = list(base)
        for p in rng.sample(range(0, 200, 5), 3):
            copy[p] = rng.choice(words)
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows, 1000))


@pytest.mark.parametrize("held", [500, 2_000_000])
def test_groups_equal_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr(near_texts, "PER_SLOT", 20_000)
    monkeypatch.setattr(near_texts.colliding, "__defaults__", (held,))
    near = near_rows(random.Random(11))
    rows = hostile() + [(i, t, None, "h", None, "x", 1, "y", "z", 1) for i, t in near]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = near_texts.keep_one(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    want = kept_by_brute_force([(r[0], r[1] or "") for r in rows])
    # of one doc_id with two texts in a group only one text stays; the brute force keeps both
    assert {x for x in want if x[0] != 5} == {x for x in found if x[0] != 5} and set(found) <= set(want)
    assert len(want) < len(rows) - 100


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_texts.keep_one(empty).count() == 0 and near_texts.keep_one(empty).columns == empty.columns


def test_slots_give_every_colliding_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 40, dtype=np.uint64)
    value = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 32, 40, dtype=np.uint64)) for _ in range(6)])
    node = rng.permutation(len(value)).astype(np.int64)
    label = node // 3
    check = np.zeros(len(value), np.int64)
    found = set()
    masks = near_texts._masks(4, 1)
    for slot in range(16):
        own = np.flatnonzero(np.isin((value >> np.uint64(28)) ^ np.uint64(slot), masks))
        a, b = near_texts.slot_pairs(slot, value[own].view(np.int64), check[own], node[own], label[own], 1, 32, 4, True, {}, 300)
        found |= set(zip(a.tolist(), b.tolist()))
    want = {
        (min(a, b), max(a, b))
        for i, (a, x) in enumerate(zip(node.tolist(), value.tolist()))
        for b, y in zip(node[:i].tolist(), value[:i].tolist())
        if (x ^ y).bit_count() <= 2 and a // 3 != b // 3
    }
    assert found == want


def test_borderline_pairs_meet():
    rng = random.Random(3)
    words, asked, met = [f"w{i}" for i in range(3000)], 0, 0
    while asked < 250:
        n = rng.choice([20, 40, 100, 300])
        a = [rng.choice(words) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(1, 1 + n // 40)):
            b[rng.randrange(n)] = rng.choice(words)
        x, y = sets_of([" ".join(a), " ".join(b)])
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            s = near_texts.sketch([np.array(sorted(x), np.uint64), np.array(sorted(y), np.uint64)], 17)
            blocks = s[:, :16].copy().view(np.uint32)
            asked += 1
            met += bool((np.bitwise_count(blocks[0] ^ blocks[1]) <= 2).any() and np.bitwise_count(s[0, 16] ^ s[1, 16]) <= near_texts.CHECK)
    assert met >= 0.95 * asked
