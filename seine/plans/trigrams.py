"""From a regular expression to the trigrams that every match must hold.

A plan is a nested tuple: ("all",) matches everything; ("tri", t) needs trigram t; ("and",
...) and ("or", ...) combine.  Plans are sound, not complete: a file that a plan rejects has
no match, a file that it accepts is still searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P

ALL = ("all",)


def both(*plans: tuple) -> tuple:
    flat: list[tuple] = []
    for p in plans:
        flat += p[1:] if p[0] == "and" else [] if p == ALL else [p]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def either(*plans: tuple) -> tuple:
    if not plans or ALL in plans:
        return ALL
    flat: list[tuple] = []
    for p in plans:
        flat += p[1:] if p[0] == "or" else [p]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("or", *flat)


def of_literal(text: str) -> tuple:
    """All trigrams of a literal; anything if it is shorter."""
    return both(*[("tri", text[i : i + 3]) for i in range(len(text) - 2)])


def of_regex(pattern: str, ignore_case: bool = False) -> tuple:
    """The plan of a pattern; case-insensitive patterns are not pre-filtered."""
    if ignore_case:
        return ALL
    parsed = P.parse(pattern)
    if parsed.state.flags & C.SRE_FLAG_IGNORECASE:
        return ALL
    return _sequence(parsed)


def _sequence(items) -> tuple:
    plans, run = [], ""
    for op, arg in items:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        plans.append(of_literal(run))
        run = ""
        if op is C.SUBPATTERN:
            plans.append(ALL if arg[1] & C.SRE_FLAG_IGNORECASE else _sequence(arg[-1]))
        elif op is C.BRANCH:
            plans.append(either(*[_sequence(x) for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            plans.append(_sequence(arg[2]))
    return both(*plans, of_literal(run))


def execute(plan: tuple, trigrams: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The `key`s of `ids` that the plan accepts, from (trigram, key) rows.

    An AND of trigrams is one semi-filtered aggregation; other nodes are set operations.
    """
    if plan == ALL:
        return ids.select(key).distinct()
    if plan[0] == "tri":
        return trigrams.where(F.col("trigram") == plan[1]).select(key).distinct()
    if plan[0] == "or":
        return reduce(DataFrame.union, [execute(p, trigrams, ids, key) for p in plan[1:]]).distinct()
    plain = [p[1] for p in plan[1:] if p[0] == "tri"]
    parts = [execute(p, trigrams, ids, key) for p in plan[1:] if p[0] != "tri"]
    if plain:
        hits = trigrams.where(F.col("trigram").isin(plain)).groupBy(key).agg(F.countDistinct("trigram").alias("n"))
        parts.append(hits.where(F.col("n") == len(plain)).select(key))
    return reduce(lambda a, b: a.join(b, key, "left_semi"), parts)
