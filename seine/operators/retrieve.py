"""Lexical retrieval: postings, BM25 over fields, exact search, trigram index, grep.

Scores are ordered by score, then path, line and chunk, so results do not depend on the
plan.  Query terms are few and known when the plan is made: they are literals in a filter
on the postings (pushed to the scan of a stored index), not a join.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text as X
from seine.store import durable

K1, B = 1.2, 0.75


#: Words (and bytes of them) that a task counts and sorts at once, postings that leave Python at once.
RUN, RUN_BYTES, POSTINGS_AT_ONCE = 4_000_000, 128 << 20, 200_000


class _Run(NamedTuple):
    """Counts of whole documents: distinct `terms` in order, and `counts` at rising `at` = (place of the term * documents + document) * fields + field."""

    terms: pa.Array
    keys: pa.Array
    at: np.ndarray
    counts: np.ndarray

    def rows(self, fields: int):
        """(place of the term, document, field) of every count."""
        place, field = np.divmod(self.at, fields)
        return *np.divmod(place, len(self.keys)), field


def _split(words: pa.Array, tokens) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(whether a word is split, how many tokens it has, all tokens in order) of distinct words, nulls among them."""
    split = pc.fill_null(pc.invert(pc.match_substring_regex(words, tokens.plain)), False).to_numpy(zero_copy_only=False)
    found = [tokens.of_word(w) for w in words.filter(pa.array(split)).to_pylist()]
    n = np.zeros(len(words), np.int64)
    n[split] = [len(x) for x in found]
    return split, n, pa.array([t for x in found for t in x], pa.string())


def _counted(words: list[pa.Array], places: list[np.ndarray], keys: list[pa.Array], held: tuple[pa.Array, np.ndarray, np.ndarray], tokens: list) -> _Run:
    """The counts of the tokens of words at places (document * fields + field), and of `held`: (terms, places, counts), each once; `tokens` has a splitter or None of each field."""
    fields = len(tokens)
    every, place = pa.concat_arrays([held[0][:0], *words]).dictionary_encode(null_encoding="encode"), np.concatenate([held[1][:0], *places])
    code, known = every.indices.to_numpy(), every.dictionary
    vocabulary = [held[0], known]
    if splitter := next(filter(None, tokens), None):
        split, n_tokens, more = _split(known, splitter)
        vocabulary.append(more)
    terms = pa.concat_arrays(vocabulary).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(terms.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    rank = rank[terms.indices.to_numpy()]
    held_rank, own_rank, token_rank = np.split(rank, [len(held[0]), len(held[0]) + len(known)])
    span = sum(map(len, keys)) * fields
    if splitter:
        parted = split[code] & np.array([t is not None for t in tokens])[place % fields]
        c, whole = code[parted], ~parted
        n = n_tokens[c]
        nth = np.repeat((np.cumsum(n_tokens) - n_tokens)[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.concatenate([own_rank[code[whole]] * span + place[whole], token_rank[nth] * span + np.repeat(place[parted], n)])
    else:
        at = own_rank[code] * span + place
    before, counts = held_rank * span + held[1], held[2]
    at, n = np.unique(at, return_counts=True)
    if len(before):
        by = np.argsort(before)
        before, counts = before[by], counts[by]
        to = np.searchsorted(at, before)
        same = to < len(at)
        same[same] = at[to[same]] == before[same]
        n[to[same]] += counts[same]
        at, n = np.insert(at, to[~same], before[~same]), np.insert(n, to[~same], counts[~same])
    return _Run(terms.dictionary.take(order), pa.concat_arrays(keys), at, n)


def _runs(batches, tokens: list, most: int):
    """Runs of about `most` words out of batches (key, words of each field) in the order of keys; `tokens` has a splitter or None of each field.

    Rows of one key are one document and never in two runs; of one that is longer than a run the counts are held, not the words.
    """
    fields, none = len(tokens), (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))
    words, places, keys, held, n, n_bytes, last = [], [], [], none, 0, 0, None
    for whole in batches:
        sizes = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in whole.columns[1:]) + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // max(most // 4, 1))) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
            if begin == end:
                continue
            batch = whole.slice(begin, end - begin)
            key = batch.column(0)
            code = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[last is None or key[0].as_py() != last[0]], code[1:] != code[:-1]])
            document = sum(map(len, keys)) - 1 + np.cumsum(starts)
            keys.append(key.filter(pa.array(starts)))
            last = (key[-1].as_py(),)
            for f in range(fields):
                own = batch.column(1 + f)
                words.append(own.flatten().cast(pa.string()))
                places.append(document[pc.list_parent_indices(own).to_numpy()] * fields + f)
                n_bytes += words[-1].nbytes
            n += int(sizes[begin:end].sum())
            if n < most and n_bytes < RUN_BYTES:
                continue
            run = _counted(words, places, keys, held, tokens)
            place, doc, field = run.rows(fields)
            going = doc == len(run.keys) - 1  # the last document may go on
            held = run.terms.take(pa.array(place[going])), field[going], run.counts[going]
            if len(run.keys) > 1:
                yield _Run(run.terms, run.keys, run.at[~going], run.counts[~going])
            words, places, keys, n, n_bytes = [], [], [run.keys[-1:]], 0, 0
    if keys:
        yield _counted(words, places, keys, held, tokens)


def _dealt(docs: DataFrame, key: str, fields: dict[str, Column], tokens) -> tuple[DataFrame, list]:
    """(key, words of each field), dealt by key and in its order, with what is left to split them by in Python; texts are split where they arrive."""
    by = [tokens.get(f) if isinstance(tokens, dict) else tokens for f in fields]
    later = [t if hasattr(t, "of_word") else None for t in by]
    if len({id(t) for t in later if t}) > 1:
        raise ValueError("fields have one splitter of words, or none")
    words = [F.flatten(F.transform(w, t)) if t and not l else w for w, t, l in zip(fields.values(), by, later)]
    return docs.repartition(key).sortWithinPartitions(key).select(key, *[w.alias(f"_f{i}") for i, w in enumerate(words)]), later


def postings(docs: DataFrame, key: str, fields: dict[str, Column], tokens=None) -> DataFrame:
    """(field, term, key, tf, dl) of fields given as arrays of words; dl is the field's length in tokens.

    `tokens` makes the tokens of one word, an array that is not null (none: the word is its token); a dict names the fields whose
    words have it.  One with an `of_word` (`X.word_tokens`) runs once for each distinct word of a run.  Documents are dealt by key
    once, before their words are split, so the splitting is spread even if one file holds all of them and only whole texts are
    shuffled.  A task counts runs of about RUN words over whole documents, whatever its share of the corpus, and gives each run
    sorted by term and key: stored, a term filter skips nearly all pages of every run, and no sort of all postings is made.
    """
    names, most, at_once = pa.array(list(fields), pa.string()), RUN, POSTINGS_AT_ONCE
    dealt, later = _dealt(docs, key, fields, tokens)

    def run(batches):
        for one in _runs(batches, later, most):
            place, doc, field = one.rows(len(names))
            slot = doc * len(names) + field
            length = np.bincount(slot, one.counts, len(one.keys) * len(names)).astype(np.int32)
            for i in range(0, len(place), at_once):
                j = slice(i, i + at_once)
                columns = [names.take(pa.array(field[j])), one.terms.take(pa.array(place[j])), one.keys.take(pa.array(doc[j])), pa.array(one.counts[j]), pa.array(length[slot[j]])]
                yield pa.RecordBatch.from_arrays(columns, ["field", "term", key, "tf", "dl"])

    kind = dict(docs.select(key).dtypes)[key]
    return dealt.mapInArrow(run, f"field string, term string, {key} {kind}, tf long, dl int")


def term_counts(docs: DataFrame, key: str, fields: dict[str, Column], tokens=None) -> DataFrame:
    """`term_statistics` of the `postings` of documents, without making these: each run is summed where it is counted."""
    names, most, at_once = pa.array(list(fields), pa.string()), RUN, POSTINGS_AT_ONCE
    dealt, later = _dealt(docs, key, fields, tokens)

    def run(batches):
        for one in _runs(batches, later, most):
            place, _, field = one.rows(len(names))
            slot = place * len(names) + field
            df, cf = np.bincount(slot), np.bincount(slot, one.counts).astype(np.int64)
            found = np.flatnonzero(df)
            for i in range(0, len(found), at_once):
                place, field = np.divmod(found[i : i + at_once], len(names))
                columns = [names.take(pa.array(field)), one.terms.take(pa.array(place)), *[pa.array(c[found[i : i + at_once]]) for c in (df, cf)]]
                yield pa.RecordBatch.from_arrays(columns, ["field", "term", "df", "cf"])

    each = dealt.mapInArrow(run, "field string, term string, df long, cf long")
    return each.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def clustered(index: DataFrame, key: str) -> DataFrame:
    """An index as one segment a partition, sorted by term, for one that was not made by `postings` or to join the runs of one that was.

    There is no exchange by term: a hot term is spread like the documents, and sums by
    document or of a few terms are made where the rows are.
    """
    return index.sortWithinPartitions("term", key)


#: The fields of a chunk that a query searches by default, with their weights.
BOOSTS = {"entity": 3.0, "signature": 2.0, "scope": 1.5, "content": 1.0, "doc": 2.0, "ident_words": 2.0, "path": 1.5}

_CLAUSE = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def parse(query: str, boosts: dict[str, float] = BOOSTS) -> list[tuple[str, str | None, list[str]]]:
    """Clauses (occur, field, tokens) of a query: words are OR-ed, `+` must and `-` must not match, `field:` names a field.

    A quoted clause needs all its tokens in one field.  A prefix that is no field belongs to the word.
    """
    out = []
    for occur, field, quoted, word in _CLAUSE.findall(query):
        if field and field not in boosts:
            word, field = f"{field}:{word or quoted}", ""
        tokens = X.query_tokens(quoted or word)
        if tokens and (quoted or occur):
            out.append((occur, field or None, tokens))
        else:
            out += [(occur, field or None, [t]) for t in tokens]
    return out


def search(index: DataFrame, key: str, query: str, boosts: dict[str, float] = BOOSTS, stats: DataFrame | None = None) -> DataFrame:
    """(key, score) of a parsed query over the boosted fields; clauses that must (not) match filter, all but the excluded ones score."""
    clauses = parse(query, boosts)
    scored = [(f, t) for occur, f, tokens in clauses if occur != "-" for t in tokens]
    if not scored:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    weighted = _weighted(index, key, sorted({t for _, _, tokens in clauses for t in tokens}), boosts, stats)
    field, term = F.col("field"), F.col("term")
    asked = lambda f, t: (term == t) & (F.lit(True) if f is None else field == f)
    counts = reduce(lambda a, b: a + b, [asked(f, t).cast("int") for f, t in scored])
    holds = []
    for i, (occur, f, tokens) in enumerate(clauses):
        if occur or len(tokens) > 1:
            each = [F.collect_set(F.when(asked(f, t), field)) for t in tokens]
            whole = F.size(reduce(F.array_intersect, each)) > 0  # all tokens in one field
            holds.append((occur, whole.alias(f"_c{i}"), f, tokens, F.col(f"_c{i}")))
    found = weighted.groupBy(key).agg(F.sum(F.col("weight") * counts).alias("score"), *[c for _, c, *_ in holds])
    for occur, _, _, _, col in holds:
        if occur:
            found = found.where(~col if occur == "-" else col)
    loose = [(f, t) for occur, f, tokens in clauses if occur != "-" and (occur == "+" or len(tokens) == 1) for t in tokens]
    phrases = [col for occur, _, _, tokens, col in holds if not occur]
    if phrases and not loose:  # quoted clauses alone: one of them must match whole
        found = found.where(reduce(lambda a, b: a | b, phrases))
    return found.where("score > 0").select(key, "score")


def field_statistics(index: DataFrame, key: str) -> DataFrame:
    """(field, n, avgdl): documents that have the field, and its mean length."""
    return index.select("field", key, "dl").distinct().groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_statistics(index: DataFrame) -> DataFrame:
    """(field, term, df, cf)."""
    return index.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _weighted(index: DataFrame, key: str, terms: list[str], boosts: dict[str, float], stats: DataFrame | None) -> DataFrame:
    """(key, field, term, weight): the boosted BM25 weight of every posting of the terms; `stats` is field_statistics, if it is stored."""
    stats = field_statistics(index, key) if stats is None else stats
    hits = index.where(F.col("term").isin(sorted(set(terms))) & F.col("field").isin(sorted(boosts)))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*[F.lit(x) for p in boosts.items() for x in p])[F.col("field")]
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        hits.join(F.broadcast(df), ["field", "term"])  # a row a field and query term
        .join(F.broadcast(stats), "field")  # a row a field
        .select(key, "field", "term", (boost * idf * weight).alias("weight"))
    )


def bm25(index: DataFrame, key: str, terms: list[str], boosts: dict[str, float], stats: DataFrame | None = None) -> DataFrame:
    """(key, score): boosted field scores of any of the terms, summed; k1 1.2, b 0.75, idf ln(1 + (n - df + .5) / (df + .5))."""
    return _weighted(index, key, terms, boosts, stats).groupBy(key).agg(F.sum("weight").alias("score"))


def top(scored: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The k best rows with their rank from 0: a distributed top-k, then one small window."""
    best = scored.orderBy(F.desc(score), F.asc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))) - 1)


def exact(chunks: DataFrame, literal: str) -> DataFrame:
    """(chunk_id, file_path, line_start, score): non-overlapping occurrences of a literal."""
    return (
        chunks.where(F.col("content").contains(literal))
        .select("chunk_id", "file_path", "line_start", X.occurrences(F.col("content"), literal).alias("score"))
        .where("score > 0")
    )


def exact_with_fallback(chunks: DataFrame, literal: str, fallback: DataFrame, limit: int) -> DataFrame:
    """Exact hits; if there are fewer than three, also the fallback's (chunk_id, file_path, line_start, score) hits not among them."""
    hits = exact(chunks, literal).select("chunk_id", "file_path", "line_start", F.col("score").cast("double").alias("score"), F.lit(0).alias("tier"))
    few = hits.limit(3).agg(F.count("*").alias("n")).where("n < 3")
    more = fallback.join(hits, "chunk_id", "left_anti").join(F.broadcast(few.select(F.lit(1).alias("one"))), F.lit(True), "left_semi")
    every = hits.unionByName(more.select("chunk_id", "file_path", "line_start", "score", F.lit(1).alias("tier")))
    return every.orderBy("tier", F.desc("score"), "file_path", "line_start").limit(limit)


#: Trigrams that leave Python at once.
TRIGRAMS_AT_ONCE = 200_000


def _distinct_trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, as code points of 21 bits each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    code = np.sort(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    return code[np.concatenate([[True], code[1:] != code[:-1]])]


def _strings(codes: np.ndarray) -> pa.Array:
    """Trigrams as strings, made in one buffer."""
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(data))


def trigrams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (trigram, key): character trigrams, cut in Arrow batches (SQL substring is quadratic on long texts).

    Rows leave a task in batches of about TRIGRAMS_AT_ONCE, whatever the texts' number and lengths.
    """
    at_once = TRIGRAMS_AT_ONCE

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            grams, numbers, first, held = [], [], 0, 0

            def rows(upto):
                every = np.concatenate(grams)
                who = np.repeat(np.arange(first, upto), numbers)
                return [pa.RecordBatch.from_arrays([_strings(every[i : i + at_once]), ids.take(pa.array(who[i : i + at_once]))], ["trigram", key]) for i in range(0, len(every), at_once)]

            for i in range(batch.num_rows):
                own = _distinct_trigrams(texts[i].as_py() or "")
                grams.append(own)
                numbers.append(len(own))
                held += len(own)
                if held >= at_once or i + 1 == batch.num_rows:
                    yield from rows(i + 1)
                    grams, numbers, first, held = [], [], i + 1, 0

    kind = dict(docs.select(key).dtypes)[key]
    # dealt by key, as a file of one row group would be one task; the trigrams are many times the text
    return docs.select(key, text).repartition(key).mapInArrow(run, f"trigram string, {key} {kind}")


#: Changed documents that an overlay holds before it is merged into a new base.
MOST_CHANGED = 4096

#: Changed keys that are sent to every task: at some 16 bytes each, 32 MB.
MOST_SENT = 2_000_000


def changed_trigrams(index: DataFrame, changed: DataFrame, key: str, text: str) -> DataFrame:
    """A trigram index with the documents of `changed` (key, text; null text: deleted) indexed anew.

    The base stays as it is: its rows of changed documents are passed over, theirs are
    added.  Past MOST_CHANGED documents the result is written as a new base.  Up to
    MOST_SENT changed keys go to every task, so that the base is not dealt anew.
    """
    gone = changed.select(key).distinct()
    n = gone.count()
    now = index.join(F.broadcast(gone) if n <= MOST_SENT else gone, key, "left_anti").select("trigram", key)
    now = now.unionByName(trigrams(changed.where(F.col(text).isNotNull()), key, text))
    return durable(clustered_trigrams(now, key), "trigrams") if n > MOST_CHANGED else now


def clustered_trigrams(index: DataFrame, key: str) -> DataFrame:
    """A trigram index in segments: the partitions as they are, each sorted, so that a filter by trigram skips pages of every file."""
    return index.sortWithinPartitions("trigram", key)


def list_files(files: DataFrame, glob: str, limit: int) -> DataFrame:
    """The first `limit` paths, in order, that a glob matches."""
    return files.where(F.col("file_path").rlike(glob_regex(glob))).select("file_path").orderBy("file_path").limit(limit)


def indexed_files(chunks: DataFrame) -> DataFrame:
    """(file_path, chunk_count) of the files that have chunks."""
    return chunks.groupBy("file_path").agg(F.count("*").alias("chunk_count"))


def glob_regex(glob: str) -> str:
    """A glob (* within a folder, ** across, ?, {a,b}, [abc]) as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(.*/)?", i + 2
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + glob[i : end + 1].replace("[!", "[^"), end
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out += "("
        elif c == "}":
            out += ")"
        elif c == ",":
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def grep(
    files: DataFrame,
    pattern: str,
    literal: bool = False,
    ignore_case: bool = False,
    invert: bool = False,
    glob: str | None = None,
    context: int = 0,
) -> DataFrame:
    """(file_path, line_no, line, column, before, after) of the lines that match, numbered from 0; column is -1 when inverted.

    Context lines come from the row's own array of lines: no window, no shuffle.
    """
    rule = re.escape(pattern).replace("\\ ", " ") if literal else pattern
    rule = f"(?i){rule}" if ignore_case else rule
    if glob:
        at = glob_regex(glob)
        files = files.where(F.col("file_path").rlike(at) | X.basename(F.col("file_path")).rlike(at))
    if not invert:
        files = files.where(F.col("content").rlike(rule.replace("^", "(?m)^", 1) if rule.startswith("^") else rule))
    lines = files.select("file_path", F.split("content", "\n", -1).alias("lines"))
    found = lines.select("file_path", "lines", F.posexplode("lines").alias("line_no", "line"))
    hit = F.col("line").rlike(rule)
    found = found.where(~hit if invert else hit)
    first = F.greatest(F.col("line_no") - context, F.lit(0))
    column = F.lit(-1) if invert else F.regexp_instr("line", F.lit(rule)) - 1
    return found.select(
        "file_path",
        "line_no",
        "line",
        column.alias("column"),
        F.slice("lines", first + 1, F.col("line_no") - first).alias("before"),
        F.slice("lines", F.col("line_no") + 2, F.lit(context)).alias("after"),
    )


def search_federated(ranked: DataFrame, weights: dict[str, float], k: int, limit: int) -> DataFrame:
    """Fuse ranked lists (project, key, rank from 0): weight / (k + rank + 1); keys are unique within a project."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("project")), F.lit(1.0))
    score = weight / (k + F.col("rank") + 1)
    every = ranked.select(F.concat_ws(":", "project", "key").alias("key"), score.alias("score"))
    return every.orderBy(F.desc("score"), "key").limit(limit)
