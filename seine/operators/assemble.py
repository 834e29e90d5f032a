"""Context assembly: what goes into a bounded context, in which order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text as X


def prefix_pack(parts: DataFrame, order: list[Column], budget: int, cost: str = "tokens") -> DataFrame:
    """Rows in order until the first that does not fit."""
    w = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def greedy_pack(parts: DataFrame, budgets: dict[str, int], group: str = "section") -> DataFrame:
    """Rows by rank within each section, leaving out those that do not fit what is left of its budget."""
    schema = parts.schema

    def run(pdf):
        left, keep = budgets.get(pdf[group].iloc[0], 0), []
        for i, row in enumerate(pdf.sort_values("rank").itertuples()):
            if row.tokens <= left:
                left -= row.tokens
                keep.append(i)
        return pdf.sort_values("rank").iloc[keep]

    return parts.groupBy(group).applyInPandas(run, schema)


def cross_file_context(main: DataFrame, imports: DataFrame, callees: DataFrame, examples: DataFrame, budget: int) -> DataFrame:
    """Parts around main results: what is left of the budget goes 40, 30 and 30 per cent to imports, callees and examples."""
    used = main.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    left = max(0, budget - used)
    parts = None
    for name, df in (("imports", imports), ("callees", callees), ("examples", examples)):
        own = df.select(F.lit(name).alias("section"), "file_path", "rank", "tokens")
        parts = own if parts is None else parts.unionByName(own)
    return greedy_pack(parts, {"imports": left * 4 // 10, "callees": left * 3 // 10, "examples": left * 3 // 10})


def strict_window(text: str, line: int, budget: int) -> tuple[int, int]:
    """Lines around `line`, grown on the cheaper side, up to 80 per cent of a budget of tokens; end exclusive."""
    lines = text.split("\n")
    cost = lambda s: -(-len(s.encode()) // 4)
    a, b = line, line + 1
    left = budget * 8 // 10 - cost(lines[line])
    while a > 0 or b < len(lines):
        up = cost(lines[a - 1]) if a > 0 else None
        down = cost(lines[b]) if b < len(lines) else None
        if down is None or (up is not None and up <= down):
            if up > left:
                break
            a, left = a - 1, left - up
        else:
            if down > left:
                break
            b, left = b + 1, left - down
    return a, b


def truncate_to_budget(text: str, budget: int, mark: str = "\n... (truncated)") -> str:
    """The longest prefix whose approximate tokens and mark stay within the budget."""
    raw = text.encode()
    if -(-len(raw) // 4) <= budget:
        return text
    return raw[: max(0, 4 * budget - len(mark.encode()))].decode(errors="ignore") + mark


def truncate_snippet(text: str, most: int = 20) -> str:
    lines = text.split("\n")
    if len(lines) <= most:
        return text
    return "\n".join([*lines[: most - 2], f"    ... ({len(lines) - most + 1} lines)", lines[-1]])


PACK_ORDER = ("docs", "symbols", "tests", "orientation", "must_read")


def enforce_budget(pack: dict, budget: int) -> dict:
    """Drops last documents, then symbols, tests, orientation and must-reads until the pack's JSON fits."""
    pack = {k: list(v) if isinstance(v, list) else v for k, v in pack.items()}
    for part in PACK_ORDER:
        while pack.get(part) and len(json.dumps(pack)) // 4 > budget:
            pack[part].pop()
    return pack


def agent_pack(query: str, results: DataFrame, symbols: DataFrame, tests: DataFrame, docs: DataFrame, budget: int, mode: str = "explore") -> str:
    """A JSON context pack of a task: pinned definitions first, then search results, tests demoted; bounded by budget."""
    limit = max(4, min(16, budget // 300))
    pinned = F.when(F.col("name") == query, 50_000.0).when(F.lower("name").contains(query.lower()), 25_000.0)
    found = symbols.withColumn("score", pinned).where("score is not null").orderBy(F.desc("score"), "file_path", "line").limit(limit)
    score = F.col("score") * F.when(X.ranks_as_test(F.col("file_path")), 0.55).otherwise(1.0)
    best = results.withColumn("score", score).orderBy(F.desc("score"), "file_path", "line_start").limit(limit)
    pack = {
        "task": query,
        "mode": mode,
        "must_read": [{"file": r["file_path"], "line": r["line_start"], "score": round(r["score"], 4)} for r in best.collect()],
        "symbols": [{"name": r["name"], "file": r["file_path"], "line": r["line"]} for r in found.collect()],
        "tests": [r["file_path"] for r in tests.select("file_path").distinct().orderBy("file_path").limit(limit).collect()],
        "docs": [r["file_path"] for r in docs.select("file_path").distinct().orderBy("file_path").limit(limit).collect()],
        "orientation": [],
    }
    return json.dumps(enforce_budget(pack, budget))


def notes(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, note): one linked Markdown note a file."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("to"))
    links = F.array_join(F.transform(F.coalesce("to", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    return ranks.join(out, "node", "left").select(F.col("node").alias("file_path"), F.concat(F.lit("# "), "node", F.lit("\n\npagerank: "), F.format_number("rank", 4), F.lit("\n\n"), links).alias("note"))


def dashboard(ranks: DataFrame, edges: DataFrame, most: int = 200) -> str:
    """A self-contained HTML page of the `most` best files and their links."""
    best = ranks.orderBy(F.desc("rank"), "node").limit(most)
    inner = edges.join(F.broadcast(best.select(F.col("node").alias("src"))), "src", "left_semi").join(F.broadcast(best.select(F.col("node").alias("dst"))), "dst", "left_semi")
    data = {"nodes": [{"id": r["node"], "rank": round(r["rank"], 6), "layer": r["node"].split("/")[0]} for r in best.collect()], "links": [list(r) for r in inner.select("src", "dst").distinct().orderBy("src", "dst").collect()]}
    payload = json.dumps(data).replace("</", "<\\/")
    rows = "".join(f"<li>{n['id'].replace('&', '&amp;').replace('<', '&lt;')} ({n['rank']})</li>" for n in data["nodes"])
    return f"<!doctype html><title>Graph</title><ol>{rows}</ol><script id=data type=application/json>{payload}</script>"


def onboarding(files: DataFrame, ranks: DataFrame, most: int = 5) -> str:
    counts = files.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs")).first()
    top = [r["node"] for r in ranks.orderBy(F.desc("rank"), "node").limit(most).collect()]
    return f"# Onboarding\n\n{counts['n']} files in {counts['langs']} languages.\n\nRead first:\n" + "\n".join(f"- {x}" for x in top)
