"""Quality rules: per-document measures and the line frequency of each host, natively.

Normalised lines are hashed, distinct documents are counted per host and hash, lines above
the host's limit are removed, and documents that this depletes are rejected.

Scale.  One pass over the text writes a table of measures and line hashes; all that
follows runs on it.  Counts are formed over distinct (host, line, document) triples, so a
host or a line with a third of all rows is spread before it is combined.  The lines over
their limit are written, so that the join back is one of plain shuffles, which AQE splits.
No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.llm.lines import hashes
from seine.llm.tables import SPACE, line_key
from seine.store import durable

_GAP = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP, -1), lambda w: w != "")


def _with(value: Column, use) -> Column:
    """use(value) with `value` computed once: it is bound to a lambda variable."""
    return F.transform(F.array(value), use)[0]


def _covered(grams: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more; grams are the windows' hashes in order."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")),
        )["n"]

    def of_grams(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_with(pairs, of_sorted))

    return _with(grams, of_grams)


def _measures(docs: DataFrame, host: Column, width: int, least_chars: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, _covered(hashed, width)).otherwise(F.lit(0))

    def line(x: Column) -> Column:
        def of_key(key: Column) -> Column:
            h1, h2 = hashes(key)
            return F.struct(
                F.char_length(key).alias("chars"), h1.alias("h1"), h2.alias("h2"), F.size(_words(x)).alias("words")
            )

        return _with(line_key(x), of_key)

    first = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), text.alias("text")
    )
    return first.select(
        "rid",
        "doc_id",
        "host",
        F.char_length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _with(
            _words(F.col("text")),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), grams(w).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        _with(
            lines,
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.filter(F.transform(x, line), lambda k: k["chars"] >= least_chars).alias("lines"),
            ),
        ).alias("l"),
    ).select("rid", "doc_id", "host", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.lines")


def judge(
    docs: DataFrame,
    host_col: str | None = "source",
    least_chars: int = 20,
    most_docs: int = 5,
    least_words: int = 5,
    least_left: float = 0.3,
) -> DataFrame:
    """Measures and verdict for every row of `docs` (doc_id, text, `host_col`).

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word
    windows.  A line of at least `least_chars` code points is above the limit in more than
    `most_docs` documents of one host, however large the host is.  A document is depleted when fewer than `least_words` words or less than `least_left` of
    them are left.  kept is false if base_failed or depleted.  A null text has no words;
    null hosts (or no host column) are one host; rows without doc_id keep their verdict
    but count for no line; repeated rows count once and each comes back.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col in docs.columns else F.lit("")
    base = durable(_measures(docs, host, 5, least_chars), "rules")
    lines = base.select("rid", "doc_id", "host", F.explode("lines").alias("x")).select(
        "rid", "doc_id", "host", "x.h1", "x.h2", "x.words"
    )
    counts = (
        lines.where("doc_id is not null")
        .select("host", "h1", "h2", "doc_id")
        .distinct()
        .groupBy("host", "h1", "h2")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > most_docs)
    )
    over = durable(counts.select("host", "h1", "h2"), "over")
    gone = lines.join(over, ["host", "h1", "h2"]).groupBy("rid").agg(F.sum("words").alias("gone"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = (left < least_words) | (left < least_left * F.col("n_words"))
    return (
        base.drop("lines")
        .join(gone, "rid", "left")
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & ~depleted).alias("kept"),
            F.coalesce("gone", F.lit(0)).cast("long").alias("n_boilerplate_words"),
        )
    )
