"""Quality classifier from weak labels.

Ten heuristic labellers vote good, bad or nothing on every document.  Expectation
maximisation over the counts of all vote patterns estimates the share of good documents and
how each labeller votes on either class, without gold labels.  The patterns' posteriors are
the labels of a hashed linear scorer over text shape, which scores every document.

Scale.  Votes are local to a row; the corpus enters EM as counts of patterns, of which
there are at most 3**10, over all documents.  The scorer is fitted on a bounded sample
(`sample` documents, drawn by hash of the text, so copies do not crowd it).  Scoring is one
more pass over rows with a model of `DIMENSIONS` numbers; nothing is joined or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.llm.tables import rows, texts

DIMENSIONS = 1 << 13
#: What a labeller says: 0 bad, 1 good, 2 nothing.
BAD, GOOD, NOTHING = 0, 1, 2
LABELLERS = ("symbols", "neighbours", "capitals", "bars", "cries", "endings", "variety", "lone_marks", "length", "letters")


def _vote(value: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NOTHING


_KIND = np.zeros(256, np.uint8)  # of a byte: 0 other mark, 1 lower case, 2 capital, 3 digit, 4 space, 5 line break
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[0x80:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5


def votes(text: str) -> list[int]:
    """The vote of each labeller on a text; a text without words is voted bad by length alone."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if n == 0:
        return [NOTHING] * 8 + [BAD, NOTHING]
    count = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6)
    letters = int(count[1] + count[2])
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">")) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    upper = int(count[2]) / max(1, letters)
    bars, cries = raw.count(b"|") / n, raw.count(b"!") / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b"\x82", b":") for x in lines) / len(lines)
    distinct = len(set(words)) / n
    lone = sum(len(w) == 1 and not _KIND[w[0]] for w in words) / n
    marks = int(count[0]) / max(1, len(raw) - int(count[4] + count[5]))
    return [
        _vote(symbols, symbols > 0.2, True),
        _vote(same, same > 0.2, n > 1),
        _vote(upper, upper > 0.5 and n > 5, upper < 0.3),
        _vote(bars, bars > 0.2, True),
        _vote(cries, cries > 0.3, True),
        _vote(ended, ended < 0.2 and n > 20, ended > 0.7),
        _vote(distinct, n > 30 and distinct < min(0.3, 20 / n**0.5), n > 10 and distinct > 0.6),
        _vote(lone, lone > 0.2 and n > 5, lone < 0.1),
        _vote(n, False, n > 5),
        _vote(marks, marks > 0.1 and n > 5, marks < 0.07),
    ]


def pattern(text: str) -> int:
    total = 0
    for v in votes(text):
        total = total * 3 + v
    return total


def _votes_of(patterns: np.ndarray) -> np.ndarray:
    base = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // base % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict:
    """EM over pattern counts: `good`, the share of good documents, and `table`, P(vote | class) of each labeller.

    Labellers count as independent given the class.  A vote of
    nothing is missing, not evidence.  It starts from the bad votes; one added observation a
    cell keeps probabilities off 0 and 1.
    """
    said = _votes_of(patterns)
    one_hot = said[:, :, None] == np.arange(2)
    good = 0.9 ** (1.0 + 20 * (said == BAD).sum(1))  # most labellers know one defect: any bad vote tells
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.einsum("cp,plv->clv", weight, one_hot) + 1
        table /= table.sum(2, keepdims=True)
        share = np.clip(weight[1].sum() / max(1, counts.sum()), 1e-6, 1 - 1e-6)
        new = _posterior(said, share, table)
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return {"good": float(share), "table": table}


def _posterior(said: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    each = np.arange(len(LABELLERS))
    logs = np.log(np.concatenate([table, np.ones((2, len(LABELLERS), 1))], axis=2))
    lean = np.log(share / (1 - share)) + (logs[1][each, said] - logs[0][each, said]).sum(1)
    return 1 / (1 + np.exp(-np.clip(lean, -40, 40)))


# Bytes by shape: letters by case, digits, white space; each other ASCII mark is its own kind.
_SHAPE = np.arange(256).astype(np.uint8)
_SHAPE[_KIND == 1], _SHAPE[_KIND == 2], _SHAPE[_KIND == 3], _SHAPE[_KIND == 4], _SHAPE[_KIND == 5] = 1, 2, 3, 4, 5


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (1 to 4) of runs of equal shape with their rounded length, and of word repetition; unit length."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    shape = _SHAPE[raw]
    cut = np.flatnonzero(np.r_[True, shape[1:] != shape[:-1]])
    size = np.diff(np.r_[cut, len(shape)])
    run = shape[cut].astype(np.uint64) * np.uint64(16) + np.minimum(np.log2(size), 15).astype(np.uint64)
    grams, parts = np.zeros(len(run), np.uint64), []
    for n in range(min(4, len(run))):
        grams = (grams[: len(run) - n] * np.uint64(0x9E3779B97F4A7C15) + run[n:] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        parts.append((grams >> np.uint64(51)).astype(np.int64))
    words = text.encode().split()
    same = sum(a == b for a, b in zip(words, words[1:]))
    extra = np.array([7, 11], np.int64)
    count = np.bincount(np.concatenate(parts), minlength=DIMENSIONS).astype(np.float32)
    at = np.flatnonzero(count)
    value = np.log1p(count[at]) / np.log1p(len(run))
    value /= max(1e-9, float(np.sqrt((value * value).sum())))
    share = np.array([same / max(1, len(words)), len(set(words)) / max(1, len(words))], np.float32)
    return np.r_[at, extra + DIMENSIONS - 16].astype(np.int32), np.r_[value, share].astype(np.float32)


def fit(sample: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = 60, decay: float = 1e-5) -> np.ndarray:
    """Weights and bias by logistic regression on (posterior, positions, values), AdaGrad in mini-batches."""
    weights, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    if not sample:
        return weights
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(sample)), max(1, len(sample) // 64)):
            at = np.concatenate([sample[i][1] for i in part])
            value = np.concatenate([sample[i][2] for i in part])
            row = np.repeat(np.arange(len(part)), [len(sample[i][1]) for i in part])
            target = np.array([sample[i][0] for i in part])
            lean = np.bincount(row, weights[at] * value, len(part)) + weights[-1]
            error = (1 / (1 + np.exp(-np.clip(lean, -40, 40))) - target) / len(part)
            step = np.bincount(at, error[row] * value, DIMENSIONS + 1) + decay * weights
            step[-1] = error.sum()
            seen += step * step
            weights -= 0.3 * step / np.sqrt(seen)
    return weights


def score(text: str, weights: np.ndarray) -> float:
    at, value = features(text)
    lean = float(weights[at] @ value) + float(weights[-1])
    return float(1 / (1 + np.exp(-np.clip(lean, -40, 40))))


def train(docs: DataFrame, sample: int = 6000) -> dict:
    """The model of `docs` (see tables.texts): EM over all rows, the scorer over about `sample` of them."""

    def patterns(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(t) for t in batch.column(0).to_pylist()], pa.int32())], ["pattern"])

    counted = docs.select("text").mapInArrow(patterns, "pattern int").groupBy("pattern").count().collect()  # <= 3**10 rows
    counted.sort()
    which = np.array([r["pattern"] for r in counted], np.int64)
    counts = np.array([r["count"] for r in counted], np.float64)
    model = estimate(which, counts) if len(which) else {"good": 0.5, "table": np.full((2, len(LABELLERS), 2), 1 / 2)}
    posterior = dict(zip(which.tolist(), _posterior(_votes_of(which), model["good"], model["table"]).tolist()))
    share = min(1.0, sample / max(1.0, counts.sum()))
    most = int(-(1 << 63) + share * ((1 << 64) - 1))

    def drawn(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, value = features(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([posterior[pattern(text)]]), pa.array([at.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())],
                    ["posterior", "at", "value"],
                )

    chosen = docs.where(F.xxhash64(F.lit("sample"), "text") <= min(most, (1 << 63) - 1)).select("text").distinct()
    got = chosen.mapInArrow(drawn, "posterior double, at binary, value binary").collect()
    got = sorted((r["posterior"], bytes(r["at"]), bytes(r["value"])) for r in got)
    model["weights"] = fit([(p, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for p, a, v in got])
    return model


def classify(
    docs: DataFrame, least: float = 0.5, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None
) -> DataFrame:
    """(doc_id, posterior, score, keep) for every row: the labellers' posterior, the scorer's probability of good, score >= `least`.

    Null texts count as empty: only the length labeller votes on them.  Repeated rows count
    as often as they come and each comes back.  An empty table gives an empty result.
    """
    own = texts(docs, id_col, text_col)
    model = model or train(own, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches):
        for batch in batches:
            ids, lines = (c.to_pylist() for c in batch.columns)
            said = np.array([votes(t) for t in lines], np.int64).reshape(-1, len(LABELLERS))
            good = _posterior(said, model["good"], model["table"])
            scores = [score(t, model["weights"]) for t in lines]
            yield rows(schema, {"doc_id": ids, "posterior": good, "score": scores, "keep": [s >= least for s in scores]})

    return own.mapInArrow(run, "doc_id long, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, least: float = 0.5, sample: int = 6000, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the scorer keeps, unchanged.

    Null texts are scored as empty ones.  Repeated rows count as often as they come and
    share one verdict.  Columns of any names come back; an empty table gives an empty one.
    """
    model = train(texts(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), sample)
    weights = model["weights"]

    @F.arrow_udf("boolean")
    def good(lines):
        return pa.array([score(t or "", weights) >= least for t in lines.to_pylist()], pa.bool_())

    return docs.where(good(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
