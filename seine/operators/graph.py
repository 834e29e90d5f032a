"""Graph operators over edges (src, dst, kind): degrees, reachability, ranks, communities, reports.

External targets are nodes whose name begins with `__ext__:`; they take part in no rank or
community.  Iterative operators write their state once a round (`durable`) so that plans do
not grow, and stop after a fixed number of rounds or when nothing changes.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seine.store import durable, release

EXTERNAL = "__ext__:"
CONFIDENCE = {"Resolved": "Verified", "Calls": "High", "DocumentedBy": "Medium", "External": "Low"}


def is_external(node: Column) -> Column:
    return node.startswith(EXTERNAL)


def confidence(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])[kind]


def real(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) between real nodes."""
    return edges.where(~is_external(F.col("src")) & ~is_external(F.col("dst"))).select("src", "dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def statistics(edges: DataFrame) -> DataFrame:
    """One row: edges by kind and confidence, nodes by realness."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k.lower()}_edges") for k in CONFIDENCE]
    levels = [F.count_if(confidence(F.col("kind")) == c).alias(f"{c.lower()}_edges") for c in CONFIDENCE.values()]
    nodes = nodes_of(edges).agg(
        F.count("*").alias("nodes"), F.count_if(is_external(F.col("node"))).alias("external_nodes")
    )
    return edges.agg(F.count("*").alias("edges"), *kinds, *levels).join(F.broadcast(nodes), F.lit(True))  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    """(node, callers, callees): distinct real neighbours."""
    own = real(edges)
    ends = own.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        own.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def pairs_of(edges: DataFrame) -> DataFrame:
    """(x, y): the distinct undirected links of two real nodes, x before y."""
    own = edges.where(~is_external(F.col("src")) & ~is_external(F.col("dst")) & (F.col("src") != F.col("dst")))
    return own.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): undirected, distinct, real."""
    ends = F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other"))))
    return pairs_of(edges).select(ends.alias("e")).select("e.node", "e.other")


def _numbered(nodes: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows of distinct `order` (node), written in that order, with their places `at` from 0; the driver sees one count a partition."""
    order = order or ("node",)
    placed = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = durable(placed, name)
    part = F.shiftrightunsigned("at", 33).cast("int")
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    first = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets or [0]]), part + 1)
    return placed.withColumn("at", (first + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int"))


def reachable(edges: DataFrame, starts: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """(node, depth): nodes within `depth` steps of `starts` (node).  A start appears only if a cycle leads back to it."""
    a, b = ("dst", "src") if up else ("src", "dst")
    step = durable(real(edges).select(F.col(a).alias("at"), F.col(b).alias("next")), "steps")
    seen = None
    front = starts.select("node").distinct()
    for d in range(1, depth + 1):
        new = front.join(step, front["node"] == step["at"]).select(F.col("next").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, "node", "left_anti")
        new = durable(new.select("node", F.lit(d).alias("depth")), "reach")
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        front = new.select("node")
    return seen if seen is not None else starts.select("node", F.lit(0).alias("depth")).limit(0)


def shortest_paths(edges: DataFrame, source: str, most: int = 8) -> DataFrame:
    """(node, path): the least path by node name among the shortest undirected paths from `source`, up to `most` steps."""
    step = durable(neighbours(edges), "steps")
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, 0)], "node string, at int")
    seen, paths = front.select("node"), spark.createDataFrame([(source, 0, [source])], "node string, at int, path array<string>")
    done = [paths.select("node", "path")]
    for _ in range(most):
        # paths of one length compare by their beginnings first: a front's places in path order stand for its paths
        found = front.join(step, "node").groupBy(F.col("other").alias("node")).agg(F.min("at").alias("up"))
        new = _numbered(found.join(seen, "node", "left_anti"), "front", "up", "node")
        if new.isEmpty():
            break
        before = paths.select(F.col("at").alias("up"), "path")
        paths = durable(new.join(before, "up").select("node", "at", F.concat("path", F.array("node")).alias("path")), "paths")
        seen, front = seen.union(paths.select("node")), paths.select("node", "at")
        done.append(paths.select("node", "path"))
    return reduce(DataFrame.unionByName, done)


#: Targets of a node that stand in one row, about.
LINKS_AT_ONCE = 10_000


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, relative: bool = True) -> DataFrame:
    """(node, rank).  Teleports and dangling mass go to all real nodes, or to `seeds` (node, weight) by weight.

    Stops after `rounds`, or when no rank moves by `tolerance`.  `relative` divides by the
    largest rank.  Seeds outside the graph count for nothing; without a valid one the rank
    is the global one.  A round is one join of nodes by their places and one sum, combined before the shuffle.
    """
    edges = durable(edges.select("src", "dst").distinct(), "edges")
    own = edges.where(~is_external(F.col("src")) & ~is_external(F.col("dst")))  # distinct already
    names = _numbered(nodes_of(edges).where(~is_external(F.col("node"))), "names")
    place = lambda end, at: names.select(F.col("node").alias(end), F.col("at").alias(at))
    own = durable(own.join(place("src", "a"), "src").join(place("dst", "b"), "dst").select("a", "b"), "places")
    out = own.groupBy(F.col("a").alias("at")).agg(F.count("*").alias("out"))
    # targets in lists of some LINKS_AT_ONCE, so that a round deals and sorts nodes, not links
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("out") / LINKS_AT_ONCE))
    links = own.join(out, own["a"] == out["at"]).groupBy("a", "out", part.alias("part")).agg(F.collect_list("b").alias("to"))
    links = durable(links.select("a", "to", (1 / F.col("out")).alias("share")), "links")
    base = names.join(out, "at", "left").select("node", "at", F.col("out").isNull().alias("dangling"))
    n = names.count()
    if n == 0:
        return names.select("node", F.lit(0.0).alias("rank"))
    total = None
    if seeds is not None:
        valid = seeds.join(names, "node", "left_semi").groupBy("node").agg(F.sum("weight").alias("weight"))
        total = valid.agg(F.sum("weight")).first()[0]
    if total:
        base = base.join(valid, "node", "left").select("at", "dangling", (F.coalesce("weight", F.lit(0.0)) / total).alias("jump"))
    else:
        base = base.select("at", "dangling", F.lit(1.0 / n).alias("jump"))
    now = durable(base.withColumn("rank", F.col("jump")), "rank")
    lost = now.where("dangling").agg(F.sum("jump")).first()[0] or 0.0
    for _ in range(rounds):
        sent = now.join(links, now["at"] == links["a"]).select(F.explode("to").alias("b"), (F.col("rank") * F.col("share")).alias("part"))
        flow = sent.groupBy("b").agg(F.sum("part").alias("flow"))
        rank = F.col("jump") * ((1 - damping) + damping * lost) + damping * F.coalesce("flow", F.lit(0.0))
        new = now.join(flow, now["at"] == flow["b"], "left").select("at", "dangling", "jump", rank.alias("rank"), F.col("rank").alias("was"))
        seen = Observation()
        new = new.observe(seen, F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("lost"), F.max(F.abs(F.col("rank") - F.col("was"))).alias("moved"))
        new = durable(new.drop("was"), "rank")
        release(now)
        lost, moved, now = seen.get["lost"] or 0.0, seen.get["moved"], new
        if moved < tolerance:
            break
    now = names.join(now, "at").select("node", "rank")
    if not relative:
        return now
    top = now.agg(F.max("rank").alias("top"))
    return now.join(F.broadcast(top), F.lit(True)).select("node", (F.col("rank") / F.col("top")).alias("rank"))


def _adjacency(a: np.ndarray, b: np.ndarray, block: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, adj): the neighbours of node v are adj[ptr[v]:ptr[v + 1]], from pairs; filled in blocks, so that little stands beside it."""
    n = int(max(a.max(), b.max())) + 1 if len(a) else 0
    ptr = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), out=ptr[1:])
    at, adj = ptr[:-1].copy(), np.empty(2 * len(a), np.int32)
    for i in range(0, len(a), block):
        x, y = np.concatenate([a[i : i + block], b[i : i + block]]), np.concatenate([b[i : i + block], a[i : i + block]])
        order = np.argsort(x, kind="stable")
        x, number = x[order], np.bincount(x, minlength=n)
        first = np.cumsum(number) - number
        adj[at[x] + np.arange(len(x)) - first[x]] = y[order]
        at += number
    return ptr, adj


def _runs(ptr: np.ndarray, adj: np.ndarray, most: int, links: int) -> list[tuple[int, int]]:
    """Consecutive nodes [first, end) without a link among them: at most `most` nodes, and `links` links or one node."""
    lower = np.full(len(ptr) - 1, -1, np.int64)
    for i in range(0, len(lower), 100_000):
        j = min(i + 100_000, len(lower))
        own, row = adj[ptr[i] : ptr[j]], np.repeat(np.arange(i, j), np.diff(ptr[i : j + 1]))
        lower[i:j] = np.maximum.reduceat(np.where(own < row, own, -1), ptr[i:j] - ptr[i])
    out, first, ends = [], 0, ptr.tolist()
    for v, low in enumerate(lower.tolist()):
        if low >= first or v - first >= most or ends[v + 1] - ends[first] > links and v > first:
            out.append((first, v))
            first = v
    return [*out, (first, len(lower))] if len(lower) else []


def _pick(own: int, gain: float, into: list[int], number: list[int], held: list[int], degree: int, double: int) -> int:
    """The community of largest gain, the first in order among equal ones; `held` has the node taken out."""
    best = own
    for c, k, h in zip(into, number, held):
        g = k - h * degree / double
        if g > gain + 1e-10:
            best, gain = c, g
    return best


def local_moves(ptr: np.ndarray, adj: np.ndarray, sweeps: int, most: int = 4096, links: int = 1_000_000) -> np.ndarray:
    """The community of every node after Louvain's first phase, node by node in order, from an adjacency without empty rows.

    Nodes of a run have no link among them, so a run's counts by community are made at once.  Its
    moves still shift the weights that later nodes compare: a choice that the run's moves could
    not turn, by the sum of their degrees, is taken at once, any other in its turn by the weights then.
    """
    n, double, degree = len(ptr) - 1, int(ptr[-1]), np.diff(ptr)
    of, held = np.arange(n), degree.astype(np.int64)
    runs = _runs(ptr, adj, most, links)
    for _ in range(sweeps):
        moved = False
        for s, e in runs:
            d, own = degree[s:e], of[s:e].copy()
            row = np.repeat(np.arange(e - s), d)
            key = np.sort(row * n + of[adj[ptr[s] : ptr[e]]])
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            number, key = np.diff(np.append(at, len(key))), key[at]
            row, into = key // n, key % n
            first = np.searchsorted(row, np.arange(e - s + 1))
            same = into == own[row]
            gain = number - held[into] * d[row] / double
            stay = -(held[own] - d) * d / double
            stay[row[same]] += number[same]
            gain[same] = -np.inf
            top = np.maximum.reduceat(gain, first[:-1])
            lead = gain == top[row]
            pick = np.full(e - s, -1)
            pick[row[lead][::-1]] = into[lead][::-1]  # the first of equal ones
            twice = np.bincount(row[lead], minlength=e - s) > 1
            other = np.where(twice, top, np.maximum.reduceat(np.where(lead, -np.inf, gain), first[:-1]))
            ahead = top - np.maximum(stay, other)
            weight = int(d[top > stay].sum())
            while True:  # `weight` must be no less than the degrees that can move
                slack = 2.0 * weight * d / double + 1e-9
                go = ahead > slack
                unsure = ~go & (stay - top <= slack)
                need = int(d[go | unsure].sum())
                if need <= weight:
                    break
                weight = min(2 * need, int(d.sum()))
            done = 0
            going = np.flatnonzero(go)
            for i in [*np.flatnonzero(unsure).tolist(), e - s]:
                upto = int(np.searchsorted(going, i))
                if upto > done:
                    who = going[done:upto]
                    np.subtract.at(held, own[who], d[who])
                    np.add.at(held, pick[who], d[who])
                    of[s + who], moved, done = pick[who], True, upto
                if i < e - s:
                    c, k, was, size = into[first[i] : first[i + 1]], number[first[i] : first[i + 1]].tolist(), int(own[i]), int(d[i])
                    held[was] -= size
                    c, h = c.tolist(), held[c].tolist()
                    inside = k[c.index(was)] if was in c else 0
                    new = _pick(was, inside - int(held[was]) * size / double, c, k, h, size, double)
                    held[new] += size
                    if new != was:
                        of[s + i], moved = new, True
        if not moved:
            break
    return of


def louvain(edges: DataFrame, sweeps: int = 100) -> DataFrame:
    """(node, community): first phase of Louvain, nodes and communities in name order.

    Moves depend on each other one by one, so they are made in one task, over the places of the
    names: 8 bytes a link besides the pairs, which it reads sorted and compressed.  Links, names
    and places are made and joined in parallel.  Isolated nodes do not appear.
    """
    pairs = durable(pairs_of(edges), "pairs")
    names = _numbered(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "names")
    links = pairs.join(names.select(F.col("node").alias("x"), F.col("at").alias("a")), "x").join(names.select(F.col("node").alias("y"), F.col("at").alias("b")), "y")
    links = durable(links.select("a", "b").repartitionByRange("a").sortWithinPartitions("a", "b"), "links")
    release(pairs)

    def run(batches):
        a, b = [], []
        for batch in batches:
            a.append(batch.column(0).to_numpy().astype(np.int32))
            b.append(batch.column(1).to_numpy().astype(np.int32))
        if not a:
            return
        a, b = np.concatenate(a), np.concatenate(b)
        ptr, adj = _adjacency(a, b)
        del a, b
        of = local_moves(ptr, adj, sweeps)
        _, first, community = np.unique(of, return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first)] = np.arange(len(first))
        for i in range(0, len(of), 100_000):
            found = number[community[i : i + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(found), dtype=np.int32)), pa.array(found)], ["at", "community"])

    found = durable(links.coalesce(1).mapInArrow(run, "at int, community long"), "communities")
    return names.join(found, "at").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: modularity of (node, community) over the undirected graph."""
    a = communities.select(F.col("node").alias("x"), F.col("community").alias("ca"))
    b = communities.select(F.col("node").alias("y"), F.col("community").alias("cb"))
    both = pairs_of(edges).join(a, "x").join(b, "y").groupBy("ca", "cb").agg(F.count("*").alias("n"))
    ends = both.select(F.explode(F.array("ca", "cb")).alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0).alias("same"), "n")
    inside = ends.groupBy("c").agg(F.sum("same").alias("inside"), F.sum("n").alias("degree"))
    whole = inside.agg(F.sum("inside").alias("i"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("d2"), F.sum("degree").alias("m2"))
    return whole.select((F.col("i") / F.col("m2") - F.col("d2") / (F.col("m2").cast("double") * F.col("m2"))).alias("modularity"))


def folder(node: Column) -> Column:
    return F.regexp_replace(node, "/?[^/]*$", "")


def surprise(edges: DataFrame, ranks: DataFrame, communities: DataFrame) -> DataFrame:
    """(src, dst, score) of every real edge: other community .3, rank ratio up to .3, other folder .2, weak confidence .1 or .2."""
    one = edges.where(~is_external(F.col("src")) & ~is_external(F.col("dst"))).select("src", "dst", "kind").distinct()
    for side in ("src", "dst"):
        one = one.join(ranks.select(F.col("node").alias(side), F.col("rank").alias(f"{side}_rank")), side, "left")
        one = one.join(communities.select(F.col("node").alias(side), F.col("community").alias(f"{side}_c")), side, "left")
    ratio = F.abs(F.log(F.greatest("src_rank", F.lit(1e-9)) / F.greatest("dst_rank", F.lit(1e-9))))
    one = one.withColumn("ratio", ratio)
    top = one.agg(F.max("ratio").alias("top"))
    one = one.join(F.broadcast(top), F.lit(True))
    share = F.when(F.col("top") > 0, 0.3 * F.col("ratio") / F.col("top")).otherwise(0.0)
    level = confidence(F.col("kind"))
    score = (
        F.when(F.col("src_c") != F.col("dst_c"), 0.3).otherwise(0.0)
        + F.when(share > 0.05, share).otherwise(0.0)
        + F.when(folder(F.col("src")) != folder(F.col("dst")), 0.2).otherwise(0.0)
        + F.when(level == "Medium", 0.1).when(level == "Low", 0.2).otherwise(0.0)
    )
    return one.select("src", "dst", score.alias("score"))


def surprising(edges: DataFrame, ranks: DataFrame, communities: DataFrame, limit: int) -> DataFrame:
    """The `limit` edges of most surprise."""
    return surprise(edges, ranks, communities).orderBy(F.desc("score"), "src", "dst").limit(limit)


def cross_imports(edges: DataFrame, ranks: DataFrame, source: str, target: str, kinds=("Resolved", "External")) -> DataFrame:
    """Files under `source` by what they import from under `target`: number, summed rank (.001 at least), targets."""
    found = edges.where(F.col("src").startswith(source) & F.col("dst").startswith(target) & F.col("kind").isin(*kinds))
    ranked = found.select("src", "dst").join(ranks.select(F.col("node").alias("dst"), "rank"), "dst", "left")
    value = F.greatest(F.coalesce("rank", F.lit(0.0)), F.lit(0.001))
    return ranked.groupBy("src").agg(F.count("*").alias("imports"), F.sum(value).alias("score"), F.min("dst").alias("first"))


def import_evidence(edges: DataFrame, files: DataFrame, source: str, target: str) -> DataFrame:
    """(src, dst, raw, line, text): the first line of each file under `source` that writes an import (src, dst, raw) from under `target`."""
    found = edges.where(F.col("src").startswith(source) & F.col("dst").startswith(target)).select("src", "dst", "raw").distinct()
    lines = files.select(F.col("file_path").alias("src"), F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
    hits = found.join(lines, "src").where(F.col("text").contains(F.col("raw")))
    first = F.min(F.struct("line", F.trim("text").alias("text"))).alias("x")
    return hits.groupBy("src", "dst", "raw").agg(first).select("src", "dst", "raw", "x.line", "x.text")


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after nodes (node) are removed."""
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    return left.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer) in topological order: sources are layer 0; nodes on or behind cycles have null.

    Each round frees one layer, so there are as many rounds as layers.
    """
    every = durable(real(edges).where("src <> dst"), "edges")
    own, free = every, nodes_of(every).join(every.select(F.col("dst").alias("node")), "node", "left_anti")
    done: list[DataFrame] = []
    for layer in count():
        free = durable(free.select("node", F.lit(layer).alias("layer")), "layer")
        if free.isEmpty():
            break
        done.append(free)
        passed = own.join(free.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        kept = durable(own.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "edges")
        own, free = kept, passed.join(kept.select(F.col("dst").alias("node")), "node", "left_anti")
        if len(done) == 50:  # keeps the plan of the result short
            done = [durable(reduce(DataFrame.unionByName, done), "layers")]
    placed = reduce(DataFrame.unionByName, done) if done else free.limit(0)
    return nodes_of(every).join(placed, "node", "left")


def impact(edges: DataFrame, target: str, depth: int = 5) -> DataFrame:
    """(node, relation, depth) of what depends on a file: direct callers and transitive ones."""
    start = edges.sparkSession.createDataFrame([(target,)], "node string")
    found = reachable(edges, start, depth, up=True)
    return found.where(F.col("node") != target).select("node", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("relation"), "depth")


def predicted_impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, score) outside a change: one for each direct caller relation and one for each caller within two steps."""
    one = real(edges)
    direct = one.join(changed.select(F.col("node").alias("dst")), "dst", "left_semi")
    again = one.join(direct.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    hits = direct.select(F.col("src").alias("node")).unionAll(direct.select("src").unionAll(again.select("src")).distinct())
    return hits.join(changed, "node", "left_anti").groupBy("node").agg(F.count("*").alias("score"))


def cypher(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Statements (section, ord, line) that rebuild the graph: nodes by rank, then relationships."""
    quote = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    kind = F.create_map(*[F.lit(x) for x in ("Resolved", "IMPORTS", "Calls", "CALLS", "DocumentedBy", "DOCUMENTED_BY", "External", "EXTERNAL_DEP")])
    node = F.concat(F.lit("MERGE (n:File {path: '"), quote(F.col("node")), F.lit("'}) SET n.pagerank = "), F.format_number("rank", 4), F.lit(";"))
    edge = F.concat(
        F.lit("MATCH (a:File {path: '"), quote(F.col("src")), F.lit("'}), (b:File {path: '"), quote(F.col("dst")), F.lit("'}) MERGE (a)-[:"), kind[F.col("kind")], F.lit("]->(b);")
    )
    return ranks.select(F.lit(0).alias("section"), node.alias("line")).unionByName(edges.select(F.lit(1).alias("section"), edge.alias("line")))


def graphml(edges: DataFrame) -> DataFrame:
    """Lines of GraphML elements, escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    node = F.concat(F.lit('<node id="'), esc(F.col("node")), F.lit('"/>'))
    edge = F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"><data key="kind">'), F.col("kind"), F.lit("</data></edge>"))
    return nodes_of(edges).select(F.lit(0).alias("section"), node.alias("line")).unionByName(edges.select(F.lit(1).alias("section"), edge.alias("line")))


def snapshot(edges: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """One JSON row for each of the `limit` best-ranked nodes with its targets among them."""
    best = ranks.orderBy(F.desc("rank"), "node").limit(limit)
    inner = real(edges).join(F.broadcast(best.select(F.col("node").alias("src"))), "src", "left_semi").join(F.broadcast(best.select(F.col("node").alias("dst"))), "dst", "left_semi")
    targets = inner.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    row = F.to_json(F.struct("node", F.coalesce("targets", F.array().cast("array<string>")).alias("targets")))
    return best.join(targets, "node", "left").select("node", row.alias("json"))


def repo_map(ranks: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """Files (node, tokens) in rank order while their tokens stay within the budget: the first too large one ends the map."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("rank"), "node").rowsBetween(Window.unboundedPreceding, 0)
    best = ranks.join(sizes, "node").orderBy(F.desc("rank"), "node").limit(budget)  # a file has a token at least
    return best.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)
