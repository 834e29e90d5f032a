"""Chat formatting: every participant's view of a conversation.

For each participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users; only the assistant's words are trained on.  A
rendering comes as segments, one a turn, with their place in the rendered dialogue, so a
conversation may be larger than a task.

Scale.  Turns meet the participants of their conversation in a join that AQE can split;
what is sorted are keys and lengths, not texts.  Places come from sums in sorted ranges
plus the ranges' totals, so a conversation with a third of all turns spans many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.store import durable

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_NONE = -(1 << 63)


def _running(found: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """`found` with `before` (sum of `value` of earlier rows of the group) and `position` (their number)."""
    sort = found.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ddl = ", ".join(f"`{n}` {t}" for n, t in sort.dtypes) + ", part int, local long, place long"

    def run(batches):
        from pyspark import TaskContext

        part, key, total, count = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in group)))
            local, place = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for i, (k, v) in enumerate(zip(keys, batch.column(value).to_pylist())):
                if k != key:
                    key, total, count = k, 0, 0
                local[i], place[i] = total, count
                total, count = total + v, count + 1
            extra = [pa.array(np.full(len(keys), part, np.int32)), pa.array(local), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "local", "place"])

    held = durable(sort.mapInArrow(run, ddl), "running")
    totals = held.groupBy(*group, "part").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = totals.select(
        *group, "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")
    )
    return held.join(base, [*group, "part"]).select(
        *found.columns, (F.col("local") + F.col("s0")).alias("before"), (F.col("place") + F.col("n0")).alias("position")
    )


def _label(speaker: Column, view: Column, fixed: tuple[str, ...]) -> Column:
    return F.when(speaker.isin(*fixed), speaker).when(speaker == view, "assistant").otherwise("user")


def rotate(
    turns: DataFrame,
    fixed: tuple[str, ...] = ("system",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The segments of every participant's rendering of every conversation.

    Columns: conv_id, view (whose rendering), position (from 0), turn, label (assistant,
    user, or a fixed role), name (of a user), train, start and end (of the segment in the
    rendered dialogue, in code points), train_start and train_end (words and end mark of
    the assistant, else null), segment.

    Participants are the speakers of a conversation that are not in `fixed`; fixed roles
    keep their label in every rendering, and a conversation of fixed roles alone has no
    rendering.  Turns are in order of turn, speaker, text hash.  A null speaker is
    "unknown", a null text empty, turns without number come first, and rows without
    conversation are one conversation.  Repeats of a row with a conversation and a turn
    number are one turn; without either number they may be different turns and all stay.
    Other columns are not read; an empty table gives an empty result.  Marks of the template inside texts are broken up ("<|" becomes "< |").
    """
    speaker = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    text = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    own = turns.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(_NONE)).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(_NONE)).alias("at"),
        speaker.alias("speaker"),
        text.alias("text"),
    ).withColumn("th", F.xxhash64("text"))
    keys = ["conv", "at", "speaker", "th", "again"]
    own = own.groupBy("conv", "at", "speaker", "th", "text").agg(F.count("*").alias("n"))
    placeless = (F.col("conv") == _NONE) | (F.col("at") == _NONE)
    own = own.select("*", F.explode(F.sequence(F.lit(1), F.when(placeless, F.col("n").cast("int")).otherwise(1))).alias("again")).drop("n")
    views = own.where(~F.col("speaker").isin(*fixed)).select("conv", F.col("speaker").alias("view")).distinct()
    label = _label(F.col("speaker"), F.col("view"), fixed)
    name = F.when(label == "user", F.regexp_replace("speaker", "[^A-Za-z0-9_-]", "_"))
    head = F.concat(F.lit(OPEN), label, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    size = F.char_length(head) + F.col("chars") + F.lit(len(CLOSE) + 1)
    sized = (
        own.select(*keys, F.char_length("text").alias("chars"))
        .join(views, "conv")
        .select("conv", "view", "at", "speaker", "th", "again", size.cast("long").alias("size"))
    )
    placed = _running(sized, ["conv", "view"], ["at", "speaker", "th", "again"], "size")
    found = own.join(placed, keys)
    train = label == "assistant"
    first = F.col("before") + F.char_length(head)
    return found.select(
        F.nullif("conv", F.lit(_NONE)).alias("conv_id"),
        "view",
        "position",
        F.nullif("at", F.lit(_NONE)).alias("turn"),
        label.alias("label"),
        name.alias("name"),
        train.alias("train"),
        F.col("before").alias("start"),
        (F.col("before") + F.col("size")).alias("end"),
        F.when(train, first).alias("train_start"),
        F.when(train, F.col("before") + F.col("size") - 1).alias("train_end"),
        F.concat(head, "text", F.lit(CLOSE + "\n")).alias("segment"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """(conv_id, view, dialogue, masks): whole renderings, for conversations that fit a row."""
    one = F.sort_array(F.collect_list(F.struct("position", "segment", "train_start", "train_end")))
    return (
        segments.groupBy("conv_id", "view")
        .agg(one.alias("s"))
        .select(
            "conv_id",
            "view",
            F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("dialogue"),
            F.transform(
                F.filter("s", lambda x: x["train_start"].isNotNull()), lambda x: F.struct(x["train_start"], x["train_end"])
            ).alias("masks"),
        )
    )


SQL = r"""
WITH own AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS view FROM own WHERE speaker <> 'system'),
l AS (SELECT o.*, v.view, CASE WHEN speaker = 'system' THEN speaker WHEN speaker = view THEN 'assistant' ELSE 'user' END AS label FROM own o JOIN views v USING (conv_id)),
n AS (SELECT *, CASE WHEN label = 'user' THEN regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') END AS name FROM l),
h AS (SELECT *, '<|im_start|>' || label || coalesce(' name=' || name, '') || chr(10) AS head FROM n),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
p AS (SELECT *, sum(length(segment)) OVER w - length(segment) AS start, row_number() OVER w - 1 AS position FROM s
      WINDOW w AS (PARTITION BY conv_id, view ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, view, CAST(position AS BIGINT) AS position, turn, label, name, label = 'assistant' AS train,
       CAST(start AS BIGINT) AS start, CAST(start + length(segment) AS BIGINT) AS "end",
       CAST(CASE WHEN label = 'assistant' THEN start + length(head) END AS BIGINT) AS train_start,
       CAST(CASE WHEN label = 'assistant' THEN start + length(segment) - 1 END AS BIGINT) AS train_end, segment
FROM p
"""
