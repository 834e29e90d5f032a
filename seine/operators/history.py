"""Commits, sessions and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text as X


def hotspots(commits: DataFrame) -> DataFrame:
    """(file_path, commits, authors, score): commits of all commits, and .1 ln(authors)."""
    total = commits.agg(F.countDistinct("commit").alias("total"))
    per = commits.groupBy("file_path").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"))
    return per.join(F.broadcast(total), F.lit(True)).select(
        "file_path", "commits", "authors", (F.col("commits") / F.col("total") + 0.1 * F.log("authors")).alias("score")
    )


def change_frequency(commits: DataFrame) -> DataFrame:
    per = commits.select("file_path", "commit", "author").distinct().groupBy("file_path")
    return per.agg(F.countDistinct("commit").alias("commits"), F.array_sort(F.collect_set("author")).alias("authors"))


def search_changes(commits: DataFrame, word: str, limit: int) -> DataFrame:
    """Commits whose subject holds a word, newest first, with their files."""
    found = commits.where(F.lower("subject").contains(word.lower()))
    best = found.select("commit", "ts", "author", "subject").distinct().orderBy(F.desc("ts"), "commit").limit(limit)
    files = found.join(F.broadcast(best.select("commit")), "commit", "left_semi").groupBy("commit").agg(F.array_sort(F.collect_set("file_path")).alias("files"))
    return best.join(files, "commit")


def last_authors(commits: DataFrame) -> DataFrame:
    return commits.groupBy("file_path").agg(F.max_by("author", F.struct("ts", "commit")).alias("author"), F.max("ts").alias("ts"))


def freshness(files: DataFrame, commits: DataFrame, callers: DataFrame, now: Column, days: int = 21) -> DataFrame:
    """(file_path, level): stale after `days`.  Files without a commit in the last max(days, 180) days count as age 0.

    critical: stale, without callers, and no entry point or test; warning: other stale
    files; info: fresh without callers, documents and assets; else fresh.
    """
    window = max(days, 180)
    last = commits.groupBy("file_path").agg(F.max("ts").alias("ts")).where(F.datediff(now, F.col("ts")) <= window)
    found = files.select("file_path").join(last, "file_path", "left").join(callers, "file_path", "left")
    age = F.coalesce(F.datediff(now, F.col("ts")), F.lit(0))
    path = F.col("file_path")
    orphan = F.coalesce("callers", F.lit(0)) == 0
    strong = orphan & ~X.entry_point(path) & ~X.orphan_test(path)
    level = (
        F.when(X.doc_file(path) | X.asset_file(path), "info")
        .when(strong & (age >= days), "critical")
        .when(age >= days, "warning")
        .when(orphan, "info")
        .otherwise("fresh")
    )
    return found.select("file_path", age.alias("age"), level.alias("level"))


def orphans(files: DataFrame, edges: DataFrame, usage: DataFrame) -> DataFrame:
    """(file_path, confidence) of files without callers: moderate (entry point, test), high (its stem is used in `usage`), certain."""
    called = edges.select(F.col("dst").alias("file_path")).distinct()
    left = files.select("file_path").join(called, "file_path", "left_anti")
    stem = F.regexp_replace(X.basename(F.col("file_path")), r"\.[^.]*$", "")
    found = left.withColumn("stem", stem).join(usage.select(F.col("word").alias("stem"), F.lit(True).alias("used")).distinct(), "stem", "left")
    path = F.col("file_path")
    level = F.when(X.entry_point(path) | X.orphan_test(path), "moderate").when(F.col("used") & (F.char_length("stem") >= 3), "high").otherwise("certain")
    return found.select("file_path", level.alias("confidence"))


def staleness(now: DataFrame, then: DataFrame) -> DataFrame:
    """(file_path, change): added, modified or removed between two snapshots (file_path, mtime, size)."""
    a = now.select("file_path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(1).alias("here"))
    b = then.select("file_path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(1).alias("there"))
    both = a.join(b, "file_path", "full_outer")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when((F.col("m1") != F.col("m0")) | (F.col("s1") != F.col("s0")), "modified")
    return both.select("file_path", change.alias("change")).where("change is not null")


def sync(now: DataFrame, then: DataFrame) -> DataFrame:
    """(file_path, change) of snapshots with (mtime, size, hash): as `staleness`, with touched files (other mtime or size, same hash) told apart."""
    a = now.select("file_path", F.struct("mtime", "size").alias("k1"), F.col("hash").alias("h1"))
    b = then.select("file_path", F.struct("mtime", "size").alias("k0"), F.col("hash").alias("h0"))
    both = a.join(b, "file_path", "full_outer")
    change = (
        F.when(F.col("k0").isNull(), "added")
        .when(F.col("k1").isNull(), "removed")
        .when(F.col("k1") == F.col("k0"), "unchanged")
        .when(F.col("h1") == F.col("h0"), "touched")
        .otherwise("modified")
    )
    return both.select("file_path", change.alias("change"))


def apply_changes(base: DataFrame, changes: DataFrame, rows: DataFrame, key: str = "file_path") -> DataFrame:
    """A table after changes (file_path, change): rows of changed and removed files go, the new rows of changed ones come."""
    gone = base.join(changes.where("change <> 'unchanged'").select(key), key, "left_anti")
    new = rows.join(changes.where("change in ('added', 'modified')").select(key), key, "left_semi")
    return gone.unionByName(new)


def debounce(feed: DataFrame, seconds: int) -> DataFrame:
    """(path, kind, at): the last kind of each path in each burst; a burst ends after `seconds` of silence on the path."""
    w = Window.partitionBy("path").orderBy("ts", "seq")
    new = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) <= seconds * 1_000_000, 0).otherwise(1)
    burst = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = feed.withColumn("new", new).withColumn("burst", burst)
    return found.groupBy("path", "burst").agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"), F.max("ts").alias("at")).drop("burst")


WEIGHTS = {"search": 0.08, "read": 0.12, "write": 0.20, "lookup": 0.10, "navigate": 0.06}


def shared_boosts(events: DataFrame, now: Column, keep: int = 1000, life: float = 15.0, most: float = 45.0) -> DataFrame:
    """(file_path, boost) from (ts, kind, file_path, seq): the last `keep` events, weighted by kind and e^(-minutes / life), up to `most` minutes old."""
    last = events.orderBy(F.desc("ts"), F.desc("seq")).limit(keep)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6
    base = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])[F.col("kind")]
    return last.withColumn("age", age).where(F.col("age").between(0, most)).groupBy("file_path").agg(F.sum(base * F.exp(-F.col("age") / life)).alias("boost"))


def active_agents(events: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6
    return events.where(age.between(0, minutes)).groupBy("agent_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))


def session_boosts(events: DataFrame, now: Column) -> DataFrame:
    """(file_path, boost): reads .15 and edits .25 of the last 5 minutes, lookups .10 of the last 10, fading linearly over 600 seconds."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    fade = F.greatest(F.lit(0.0), 1 - F.col("age") / 600)
    weight = F.when((F.col("kind") == "read") & (F.col("age") <= 300), 0.15).when((F.col("kind") == "write") & (F.col("age") <= 300), 0.25).when((F.col("kind") == "lookup") & (F.col("age") <= 600), 0.10)
    return events.withColumn("age", age).where("age >= 0").withColumn("w", weight * fade).where("w > 0").groupBy("file_path").agg(F.sum("w").alias("boost"))


def session_summary(events: DataFrame) -> DataFrame:
    """(folder, events, read, edited, last) of a session."""
    return (
        events.withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ""))
        .groupBy("folder")
        .agg(
            F.count("*").alias("events"),
            F.count_distinct(F.when(F.col("kind") == "read", F.col("file_path"))).alias("read"),
            F.count_distinct(F.when(F.col("kind") == "write", F.col("file_path"))).alias("edited"),
            F.max("ts").alias("last"),
        )
    )


def upsert_memory(store: DataFrame, new: DataFrame) -> DataFrame:
    """A keyed store (key, value, tags, ts) after new rows: the newest of a key wins."""
    every = store.select("key", "value", "tags", "ts").unionByName(new.select("key", "value", "tags", "ts"))
    return every.groupBy("key").agg(F.max_by(F.struct("value", "tags", "ts"), F.struct("ts", "value")).alias("x")).select("key", "x.*")


def recall_memory(store: DataFrame, word: str, tags: list[str]) -> DataFrame:
    found = store.where(F.lower("value").contains(word.lower()))
    return found.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]).cast("array<string>"), "tags")) == 0)
