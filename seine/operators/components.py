"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.store import durable, release


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round is two aggregations by minimum (combined before the shuffle) and two joins
    with their one-row-per-node results.  Those are written first: both sides of a join are
    then plain shuffles, which AQE splits for a node with a third of all edges.  Rounds grow with the logarithm of the longest path.  Edges with a null
    end and self loops are ignored; repeated edges count once.
    """
    a, b = F.col(src), F.col(dst)
    now = durable(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "cc",
    )
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large, "cc-large")
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = durable(small, "cc")
        for df in (now, least, large, low):
            release(df)
        after = _state(new)
        done, now, state = after == state, new, after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
