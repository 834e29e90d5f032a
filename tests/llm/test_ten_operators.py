"""The ten operators against brute force on small hostile tables, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seine.llm import chat, lines, order_minhash, packing, pieces, pii, quality_model, quality_rules, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, part long, hash string, th string, terms int"
WS = " \t\n\x0b\x0c\r"


def hostile(rng=random.Random(5)):
    """Nulls, empties, ties, repeated rows, very long texts, odd white space, shared lines and passages."""
    words = [a + b for a in ("ka", "Lo", "mi", "É", "tu.") for b in ("ra", "SE", "no", "x9", "ß")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, passage = [line(8) for _ in range(4)], line(60)
    texts = []
    for i in range(60):
        own = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            own.insert(rng.randint(0, len(own)), rng.choice((str, str.upper, lambda s: f"\t{s} "))(rng.choice(shared)))
        if i % 7 == 0:
            own.insert(0, passage)
        if i % 11 == 0:
            own.append(f"write to bob{i % 3}@mail.example.com or +1 (555) 010-9999 4111 1111 1111 1111 at 10.0.0.{i}")
        texts.append("\n".join(own))
    texts += [texts[0]] * 3 + ["", "   ", "\n\n", "one", "ab cd", " ".join([passage] * 40), "x" * 5000, "a\x0bb c d\x1ce", "ß" * 30 + "\r\n" + "ß" * 30]
    out = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None), (None, texts[1]), (None, None), (5, texts[5]), (5, "another text of id five")]
    return [(i, t, None, "h%d" % ((i or 0) % 2), None, "x", 1, "y", "z", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def same(found, wanted):
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_every_report_takes_an_empty_table(spark, empty):
    for f in (lines.report, quality_rules.judge, substrings.report, packing.report, order_minhash.report, pii.report, pieces.report, quality_model.classify, simhash.near_duplicates):
        assert f(empty).count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert lines.dedup_lines(empty).columns == empty.columns == pii.sanitise(empty).columns == simhash.keep_one(empty).columns


def test_simhash(docs):
    from xxhash import xxh64_intdigest

    def fp(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = given(docs)
    prints = {t: fp(t) for _, t in rows}
    value = list(set(prints.values()))
    group = {v: v for v in value}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    used = {prints[t] for i, t in rows if i is not None}
    for a in used:
        for b in used:
            if bin(a ^ b).count("1") <= 4:
                group[root(a)] = root(b)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root(prints[t])] = min(least.get(root(prints[t]), i), i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    same(found, [(i, signed(prints[t]), least.get(root(prints[t]))) for i, t in rows])


def test_simhash_keeps_what_resembles_nothing(spark):
    a, b = "one text of a few words that is held twice", "quite another one of the same document number"
    found = simhash.keep_one(spark.createDataFrame([(3, a), (5, a), (5, b), (None, a)], "doc_id long, text string")).collect()
    same([tuple(r) for r in found], [(3, a), (5, b), (None, a)])


@pytest.mark.parametrize("held", [10, 3000, 2_000_000])
def test_balls_link_all_neighbours_and_no_others(spark, held):
    rng = random.Random(held)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    values = set(seeds)
    for s in seeds:
        for n in (1, 3, 4, 5, 6, 8):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), n)))
    values |= {seeds[0] ^ (1 << b) for b in range(64)}  # a dense ball
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame(list(zip(signed, range(len(values)))), "fp long, node long")
    links = [(r[0], r[1]) for r in simhash.ball_links(nodes, k=4, held=held).collect()]
    near = {(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 4}

    def parts(pairs):
        group = list(range(len(values)))

        def root(i):
            while group[i] != i:
                i = group[i]
            return i

        for a, b in pairs:
            group[root(a)] = root(b)
        sets = collections.defaultdict(set)
        for i in range(len(values)):
            sets[root(i)].add(i)
        return sorted(map(sorted, sets.values()))

    assert parts(links) == parts(near)


def test_lines(docs):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(table)
    rows, holders = given(docs), collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders[key(x)].add(i)
    wanted = []
    for i, t in rows:
        own = t.split("\n")
        kept = [x for x in own if i is None or len(holders[key(x)]) < 3 or i == max(holders[key(x)])]
        wanted.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    same([tuple(r) for r in lines.report(docs).collect()], wanted)
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    digests = collections.Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept.collect())
    assert digests == collections.Counter(w[3] for w in wanted)


def test_rules(docs):
    rows, wanted = given(docs), []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        grams = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {p for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        ls = [x for x in t.split("\n") if x.strip(WS)]
        wanted.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    found = quality_rules.judge(docs).collect()
    same([tuple(r)[:7] for r in found], wanted)
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_rules_limit_does_not_grow_with_the_host(spark):
    nav = "the same navigation line of this one host"
    rows = [(i, "\n".join([nav] * 3) + f"\nown {i}", "hot") for i in range(6)] + [(100 + i, " ".join(f"w{i}x{j}" for j in range(12)), "hot") for i in range(3000)]
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(found[i] for i in range(6)) and all(found[100 + i] for i in range(3000))


def test_rules_reject_what_boilerplate_fills(spark):
    nav = "the same navigation line of this one host"
    rows = [(i, nav + "\n" + nav.upper() + "\nfew words", "a") for i in range(8)]
    rows += [(100 + i, " ".join(f"w{i}x{j}" for j in range(30)), "a") for i in range(8)] + [(200, nav + "\n" + " ".join(f"own{j}" for j in range(20)), "b")]
    found = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(found[i]["kept"] for i in range(8)) and all(found[100 + i]["kept"] for i in range(8)) and found[200]["kept"]
    assert found[0]["n_boilerplate_words"] == 16 and found[200]["n_boilerplate_words"] == 0


@pytest.mark.parametrize("window, block, gathered, often", [(35, 8, 4_000_000, 1000), (6, 3, 50, 3), (6, 6, 4_000_000, 2)])
def test_substrings(docs, window, block, gathered, often, monkeypatch):
    monkeypatch.setattr(substrings, "GATHERED", gathered)
    monkeypatch.setattr(substrings, "OFTEN", often)
    rows = given(docs)
    split = [t.encode().split() for _, t in rows]
    count = collections.Counter(tuple(w[j : j + window]) for w in split for j in range(len(w) - window + 1))
    wanted = []
    for (i, _), w in zip(rows, split):
        gone = {p for j in range(len(w) - window + 1) if count[tuple(w[j : j + window])] > 1 for p in range(j, j + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        wanted.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    same([tuple(r) for r in substrings.report(docs, window, block).collect()], wanted)
    removed = substrings.remove_repeats(docs, window, block).collect()
    texts = collections.Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in removed)
    assert texts == collections.Counter(w[3] for w in wanted)
    assert sorted(sum(x["n"] for x in r["removed"]) for r in removed) == sorted(w[2] for w in wanted)


@pytest.mark.parametrize("window, block, often", [(35, 8, 1000), (6, 3, 2)])
def test_factors_follow_their_references(docs, window, block, often, monkeypatch):
    monkeypatch.setattr(substrings, "OFTEN", often)
    rows = given(docs)
    split = [(i, t.encode().split()) for i, t in rows]
    places = collections.defaultdict(set)  # of each window: where it starts
    for k, (_, w) in enumerate(split):
        for j in range(len(w) - window + 1):
            places[tuple(w[j : j + window])].add((k, j))
    by_id = collections.defaultdict(list)
    for i, w in split:
        by_id[i].append(w)
    parsed = collections.defaultdict(list)
    for r in substrings.factors(docs, window, block).collect():
        parsed[r["doc_id"]].append((r["start"], r["length"], r["ref_doc_id"], r["ref_start"]))
    for i, texts in by_id.items():
        if len(texts) > 1:
            continue  # the factors of several texts of one id stand together
        w, own = texts[0], sorted(parsed.get(i, []))
        covered = {p for j in range(len(w) - window + 1) if len(places[tuple(w[j : j + window])]) > 1 for p in range(j, j + window)}
        assert [p for a, n, *_ in own for p in range(a, a + n)] == sorted(covered)  # disjoint, in order, nothing else
        for a, n, ref, b in own:
            assert any(x[b : b + n] == w[a : a + n] and (ref != i or a != b) for x in by_id[ref])


def test_parse_is_greedy():
    run = lambda first, n, ref, to: {"first": first, "n": n, "ref_id": ref, "ref_th": 0, "ref_first": to}
    runs = [run(0, 3, 1, 100), run(3, 2, 1, 103), run(2, 9, 2, 7), run(4, 1, 3, 0), run(40, 1, 4, 9)]
    assert substrings.parse(runs, 5) == [(0, 9, 1, 0, 100), (9, 6, 2, 0, 14), (40, 5, 4, 0, 9)]
    assert substrings.parse(None, 5) == []


def test_copies_without_id_share_their_runs(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text)] * 300, "doc_id long, text string").repartition(4)
    found = substrings.repeated_windows(substrings._hashed_texts(docs)).select("runs").collect()
    assert len(found) == 300 and all([tuple(x)[:2] for x in r["runs"]] == [(0, 26)] for r in found)


def test_packing(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows, wanted = given(docs), []
    for i, t in rows:
        ids = np.array(encoder.encode(t, add_special_tokens=False).ids + [0], "<u4")
        wanted += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    found = packing.report(docs).collect()
    same([tuple(r)[:5] for r in found], wanted)
    held = collections.defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(held) == -(-sum(w[3] for w in wanted) // 2048)


def test_sweep_is_best_fit_decreasing():
    from bisect import bisect_left, insort

    rng = random.Random(3)
    for capacity in (10, 64, 100):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
            gaps, opened = [], 0
            for n in sorted(lengths, reverse=True):
                at = bisect_left(gaps, n)
                gap = gaps.pop(at) if at < len(gaps) else capacity
                opened += gap == capacity
                if gap > n:
                    insort(gaps, gap - n)
            runs = packing.sweep(collections.Counter(lengths), capacity)
            used = collections.Counter()
            for length, _, number, first, each, offset in runs:
                for i in range(number):
                    assert used[first + i // each] == offset + i % each * length
                    used[first + i // each] += length
            assert max(used.values(), default=0) <= capacity and sum(used.values()) == sum(lengths) and len(used) == opened


def test_word_ids_equal_the_tokenizer():
    ids, rng = packing.WordIds("word_bpe_49k.json"), random.Random(1)
    letters = "aAßÉÀÿŸzZ.,'s!|$_-1²ﬁééİıſKΣσ漢µªº×÷ðÞ­  \n\t"
    for i in range(1500):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) + ("<|endoftext|>" if i % 50 == 0 else "")
        assert np.frombuffer(ids([x])[0], "<u4").tolist() == ids.encoder.encode(x, add_special_tokens=False).ids, x


def test_order_minhash(spark, docs):
    from xxhash import xxh64_intdigest

    sign = lambda t: order_minhash.text_of(order_minhash.signature(t))
    like = lambda a, b: round(float(np.mean([a[k : k + 4] == b[k : k + 4] for k in range(0, 256, 4)])) ** 0.5, 9)
    signed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxh64_intdigest(t.encode(), 42))
    hot = spark.createDataFrame([(9, f"text number {i} of one document") for i in range(40)] + [(None, f"and {i} of none") for i in range(40)], "doc_id long, text string")
    for table in (docs, docs.select("doc_id", "text").unionByName(hot)):
        order = sorted(given(table), key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]), r[1]))
        wanted = []
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            cut = len(t) // 4
            edited = t[: len(t) - cut] + after[:cut]
            near = like(sign(t), sign(edited)), like(sign(t), sign(after))
            wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sign(t), sign(edited), *near))
        for parts in (1, 5, 12):
            same([(*tuple(r)[:5], *(round(x, 9) for x in tuple(r)[5:])) for r in order_minhash.report(table, parts=parts).collect()], wanted)


def test_order_minhash_sees_order_and_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    moved = text[1500:] + text[:1500]
    blocks = [text[i : i + 30] for i in range(0, 3000, 30)]
    rng.shuffle(blocks)
    sign = order_minhash.signature
    like = lambda x: order_minhash.likeness(sign(text), sign(x))
    assert like(text) == 1 and like(text[:2900]) > 0.8 > like(moved) > like("".join(rng.choice("abcdefgh ") for _ in range(3000)))
    assert like("".join(blocks)) < like(moved) and like("") == 0


def test_order_minhash_is_the_definition():
    text, k, m, keep = "abcabcabcxabcab" * 3, 3, 16, 2
    grams, seen, items = [text[i : i + k] for i in range(len(text) - k + 1)], collections.Counter(), []
    kmers = order_minhash._kmers(text, k)
    for g, h in zip(grams, kmers.tolist()):
        number = seen[g]
        seen[g] += 1
        mixed = np.array([h], np.uint64)
        if number:
            mixed = order_minhash._mixed(mixed + np.uint64(number) * np.uint64(0xD6E8FEB86659FD93))
        items.append(int(mixed[0] >> np.uint64(32)))
    for j, value in enumerate(order_minhash.signature(text, k, m, keep)):
        least = sorted(sorted(range(len(items)), key=lambda i: (items[i] * int(order_minhash._A[j]) & 0xFFFFFFFF, i))[:keep])
        want = np.zeros(1, np.uint64)
        for i in least:
            want = order_minhash._mixed(want * np.uint64(31) + kmers[i : i + 1])
        assert int(want[0] >> np.uint64(48)) == value


_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    found = []
    for n, (kind, rule) in enumerate(_RULES.items()):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                found.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(found))


def test_pii_base(docs):
    found = pii.report(docs).collect()
    same([(r["doc_id"], r["base_sha256"]) for r in found], [(i, hashlib.sha256(brute_spans(t).encode()).hexdigest()) for i, t in given(docs)])
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice("a.@@-+ 1234567890(.%é\n") for _ in range(rng.randint(0, 40)))
        assert pii._joined([(a, pii.KINDS[k], b) for a, k, b in pii.base_spans(t)]) == brute_spans(t)
    assert len(pii.base_spans("a" * 300_000 + "@" * 50_000 + "1" * 300_000)) == 0  # linear in the text


def test_pii_terms(spark):
    rng = random.Random(6)
    filler = lambda: " ".join(f"w{rng.randint(0, 40)}" for _ in range(12))
    rows = [(i, f"{filler()} Zebulon x{rng.randint(0, 9)} ask bob@example.com {filler()}") for i in range(6)]
    rows += [(10 + i, f"{filler()} ask {filler()}") for i in range(60)] + [(90, f"{filler()} Zebulon again"), (91, "ask Carol at carol@example.com"), (92, "ask Carol at carol@example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i, t in rows[:6]:
        at = t.index("Zebulon")
        assert f"term_removed:{at}:{at + 7}" in found[i]["spans"] and "ask" not in [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in found[i]["spans"].split(",")) if k != "email"]
    assert "term" not in found[90]["spans"] and "term" not in found[91]["spans"]  # away from the entity; one text copied is one context
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[90] == rows[-3][1] and "ask" in clean[0]


def test_pii_terms_of_few_documents(spark, data):
    rows = [(1, "ask Fenwick at fenwick@example.com or wait"), (2, "ask or wait at noon"), (3, "ask at or wait"), (4, "Ostrava and dora@example.com"), (5, "call dora@example.com in Ostrava")]
    rows += [(10 + i, f"ask or wait at in and call {i}") for i in range(30)]
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == "term_generalised:4:11,email:15:34"
    assert "term_generalised:0:7" in found[4] and "term_generalised:25:32" in found[5]
    given = pii.report(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert any("term_" in r["spans"] for r in given)


def test_pii_long_parts_and_repeated_rows(spark):
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)] and not pii.base_spans("9" * 5000 + ".1.1.1")
    rows = [(1, "ask Fenwick at fenwick@example.com or wait"), (2, "ask or wait at noon"), (3, "ask at or wait"), (None, "noon")]
    once, often = (pii.report(spark.createDataFrame(rows * n, "doc_id long, text string")).collect() for n in (1, 10))
    same([tuple(r) for r in often], [tuple(r) for r in once] * 10)
    assert any("term_" in r["spans"] for r in once)


def brute_terms(rows, remove=1.0, generalise=3.0):
    """Spans of (doc_id, text) rows by the definition: lower Wilson bound of P(entity | term), applied everywhere."""
    import math

    rows_once = set(rows)
    said, seen, words = {}, collections.Counter(), {}
    for key in rows_once:
        spans = pii.base_spans(key[1])
        words[key] = [(m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", key[1]) if not any(m.start() < b and a < m.end() for a, _, b in spans)]
        seen.update({pii._term(w) for w in re.split("[\x20\x09-\x0d]+", key[1]) if w})
        value = lambda a, k, b: key[1][a:b].lower() if k < 2 else re.sub("[^0-9]", "", key[1][a:b])
        if spans:
            said[key[1]] = {(k, value(a, k, b)) for a, k, b in spans}, {pii._term(key[1][a:b]) for a, b in words[key]} - {""}
    together = collections.Counter((c, t) for cs, ts in said.values() for c in cs for t in ts)
    action = {}
    for (_, t), n in together.items():
        size = max(n, seen[t])
        p, z = n / size, pii.Z
        low = (p + z * z / (2 * size) - z * math.sqrt(p * (1 - p) / size + z * z / (4 * size * size))) / (1 + z * z / size)
        if -math.log2(low) <= generalise:
            action[t] = max(action.get(t, ""), "removed" if -math.log2(low) <= remove else "generalised")
    out = []
    for key in rows:
        spans = [(a, k, pii.KINDS[k], b) for a, k, b in pii.base_spans(key[1])]
        spans += [(a, 4, "term_" + action[pii._term(key[1][a:b])], b) for a, b in words[key] if pii._term(key[1][a:b]) in action]
        out.append((key[0], ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))))
    return out


def test_pii_terms_equal_brute_force(spark, docs):
    rows = given(docs)
    rng = random.Random(12)
    people = [("Ada", "ada@example.com"), ("Bo", "bo@example.org"), ("Cy", "10.1.2.3")]
    for i in range(80):
        name, at = rng.choice(people)
        common = " ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randint(0, 9)))
        rows.append((1000 + i % 60, f"{common} {name if rng.random() < 0.7 else 'x%d' % rng.randint(0, 30)}, {at if rng.random() < 0.6 else ''} {common}"))
    rows += [(2000 + i, f"Zed word{i} zed@example.net") for i in range(8)] + [(2000, rows[-1][1]), rows[-1]]
    found = pii.report(spark.createDataFrame(rows, "doc_id long, text string"), everywhere=True).collect()
    want = brute_terms(rows)
    assert any("term_removed" in s for _, s in want) and any("term_generalised" in s for _, s in want)
    same([(r["doc_id"], r["spans"]) for r in found], want)


def test_pii_terms_far_from_the_entity_and_without_it(spark):
    rng = random.Random(7)
    filler = lambda: " ".join(f"w{rng.randint(0, 40)}" for _ in range(12))
    rows = [(i, f"Zebulon {filler()} ask bob@example.com {filler()}") for i in range(6)]
    rows += [(10 + i, f"{filler()} ask {filler()}") for i in range(60)] + [(90, f"{filler()} Zebulon again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = rows[-1][1].index("Zebulon")
    for everywhere in (False, True):
        found = {r["doc_id"]: r["spans"] for r in pii.report(docs, everywhere=everywhere).collect()}
        assert all(found[i].startswith("term_removed:0:7,") for i in range(6))
        assert found[90] == (f"term_removed:{at}:{at + 7}" if everywhere else "")
    assert not any("Zebulon" in r["text"] for r in pii.sanitise(docs, everywhere=True).collect())


def test_pieces_equal_the_library(docs):
    from public_tokenizers import path
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    rng = random.Random(8)
    texts = [t for _, t in given(docs)] + ["  a\n b  c\t<s> é 漢字 ﬁ Ａ", "a" * 400, "the" * 300, "\u0000\x1f☃🙂", " . . ... ====", "x  "]
    texts += ["".join(rng.choice("abetho  \néß漢.=") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    encoder = pieces.Encoder()
    coded = encoder.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == own.encode(texts)
    assert [encoder.decode(c) for c in coded] == texts
    assert all(r["same"] for r in pieces.report(docs).collect())
    back = pieces.decode(pieces.encode(docs))
    same([tuple(r) for r in back.collect()], given(docs))


def test_merges_equal_their_definition_and_long_words_are_cheap():
    import time

    own, rng = pieces.Encoder().vocabulary, random.Random(10)

    def by_scanning(text):
        parts = list(text)
        while True:
            score = [own.score_of.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            if not score or max(score) == -np.inf:
                return parts
            at = score.index(max(score))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    for _ in range(600):
        text = "▁" + "".join(rng.choice("abcdeiou tehnrs"[: rng.randint(2, 15)]).replace(" ", "") for _ in range(rng.randint(0, 30)))
        assert own.merged(text) == by_scanning(text)
    start = time.time()
    own.merged("".join(rng.choice("etaoinshr") for _ in range(20_000)))
    assert time.time() - start < 5


def test_unigram_viterbi_is_the_best_path():
    rng = random.Random(9)
    vocabulary = {c: rng.uniform(-6, -2) for c in "abc"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): rng.uniform(-8, -2) for _ in range(30)}
    own = pieces.Vocabulary({p: (i, s) for i, (p, s) in enumerate(vocabulary.items())}, "unigram", None, 99)
    for n in range(1, 9):
        words = ["".join(rng.choice("abc") for _ in range(n)) for _ in range(20)]
        for word, ids in own.encode_words(list(set(words))).items():
            best = {0: 0.0}
            for end in range(1, n + 1):
                best[end] = max(best[a] + vocabulary[word[a:end]] for a in range(end) if word[a:end] in vocabulary)
            assert sum(vocabulary[own.text_of[i]] for i in np.frombuffer(ids, "<u4").tolist()) == pytest.approx(best[n])


def test_classifier(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = quality_model.classify(docs).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    right = sum(r["keep"] == bool(r["quality"]) for r in found)
    assert right >= 0.95 * len(found)  # gold labels are held out: training uses none
    kept = quality_model.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_classifier_equals_plain_em_and_scoring(docs):
    """EM, posteriors and scores of hostile rows, each by loops from the definitions."""
    rows = given(docs)
    patterns = collections.Counter(tuple(quality_model.votes(t)) for _, t in rows)
    good = {v: 0.9 ** (1 + 20 * v.count(0)) for v in patterns}
    for _ in range(200):
        table = [[[1.0, 1.0] for _ in quality_model.LABELLERS] for _ in range(2)]
        for v, n in patterns.items():
            for c in range(2):
                for k, said in enumerate(v):
                    if said < 2:
                        table[c][k][said] += n * (good[v] if c else 1 - good[v])
        table = [[[x / sum(row) for x in row] for row in one] for one in table]
        share = min(1 - 1e-6, max(1e-6, sum(n * good[v] for v, n in patterns.items()) / len(rows)))
        before = good
        good = {}
        for v in patterns:
            lean = np.log(share / (1 - share)) + sum(np.log(table[1][k][x]) - np.log(table[0][k][x]) for k, x in enumerate(v) if x < 2)
            good[v] = float(1 / (1 + np.exp(-np.clip(lean, -40, 40))))
        if max(abs(good[v] - before[v]) for v in good) < 1e-9:
            break
    model = quality_model.train(quality_model.texts(docs))
    assert np.allclose(model["table"], table, atol=1e-6) and abs(model["good"] - share) < 1e-6
    weights, found = model["weights"], collections.defaultdict(set)
    for r in quality_model.classify(docs, model=model).collect():
        found[r["doc_id"]].add((round(r["posterior"], 6), round(r["score"], 9), r["keep"]))
    wanted = collections.defaultdict(set)
    for i, t in rows:
        at, value = quality_model.features(t)
        lean = sum(float(weights[a]) * float(v) for a, v in zip(at, value)) + float(weights[-1])
        score = 1 / (1 + np.exp(-lean))
        wanted[i].add((round(good[tuple(quality_model.votes(t))], 6), round(float(score), 9), bool(score >= 0.5)))
    near = lambda x, y: len(x) == len(y) and all(abs(a[0] - b[0]) < 1e-4 and abs(a[1] - b[1]) < 1e-5 and (a[2] == b[2] or abs(a[1] - 0.5) < 1e-5) for a, b in zip(sorted(x), sorted(y)))
    assert found.keys() == wanted.keys() and all(near(found[i], wanted[i]) for i in found)
    kept = quality_model.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in quality_model.classify(docs).collect())


def test_em_recovers_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.8
    right = np.linspace(0.95, 0.7, len(quality_model.LABELLERS))
    said = np.where(rng.random((20000, len(right))) < right, truth[:, None], ~truth[:, None]).astype(int)
    said[rng.random(said.shape) < 0.2] = quality_model.NOTHING
    base = 3 ** np.arange(len(right) - 1, -1, -1)
    which, count = np.unique(said @ base, return_counts=True)
    model = quality_model.estimate(which, count.astype(float))
    assert abs(model["good"] - 0.8) < 0.03
    assert np.abs(model["table"][1, :, 1] - right).max() < 0.05


def test_chat(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hello\nann"), (1, 2, "bob", "hello\nann"), (1, 3, "cy d", None),
        (2, 0, "system", "alone"), (3, None, None, "who"), (3, None, None, "who"), (None, 5, "ann", "lost"),
    ]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = {(r["conv_id"], r["view"]): (r["dialogue"], [tuple(m) for m in r["masks"]]) for r in chat.assemble(found).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cy d"), (3, "unknown"), (None, "ann")}
    assert whole[3, "unknown"][0].count("who") == 2  # turns without a number are no repeats
    text, masks = whole[1, "bob"]
    assert text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>assistant\nhello\nann<|im_end|>\n<|im_start|>user name=cy_d\n<|im_end|>\n"
    )
    assert [text[a:b] for a, b in masks] == ["hello\nann<|im_end|>"]
    for r in found.collect():
        assert whole[r["conv_id"], r["view"]][0][r["start"] : r["end"]] == r["segment"]
