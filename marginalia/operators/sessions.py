"""Sessions by inactivity gap, cut from a tree over the gaps of each entity.

The gaps between an entity's consecutive entries form a Cartesian tree with the largest gap at its root. A node
covers a run of entries; its height is the largest gap inside the run (0 for one entry) and its parent's height is
the smaller of the two gaps around the run. So the sessions for *any* gap setting T are the nodes with
height <= T < parent height: one filter over a table that is built once.

Built in two levels, each a sorted stream through one Arrow function whose memory is the open spine of the tree:

1. entries are put together by (entity, time), then by (entity, day): a node with larger gaps on both sides within
   its day is finished; what remains of a day are the runs between its record gaps, at most two for each distinct
   record. Record gaps grow strictly, so that a day of 86.4 million ms has at most 13,145 from either side,
   however many rows it holds.
2. the days' remains of an entity are merged the same way.

An entity with a third of all rows is therefore split by day, and its rows are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.session import materialize, ready

DAY_MS = 86_400_000
NODE = "entity string, chunk long, start_ms long, end_ms long, n_entries long, height_ms long, parent_height_ms long, done boolean"
_ARROW = pa.schema([("entity", pa.string()), ("chunk", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_entries", pa.int64()), ("height_ms", pa.int64()), ("parent_height_ms", pa.int64()), ("done", pa.bool_())])


def _grow(final: bool):
    """The Arrow function of one level. Input: runs sorted by (entity, chunk, start_ms); final: the ends of a group
    are the ends of the entity, so that its tree is finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = None
        spine: list[list] = []  # runs left of the record gaps that are open to the left
        stack: list[list] = []  # [gap before, start, end, n, height], gaps not growing

        def close(group) -> None:
            """Ends a group: its open runs go on to the next level, or are folded into the root."""
            if final:
                while len(stack) > 1:
                    fold(group)
                _, s, e, n, h = stack[0]
                out.append((*group, s, e, n, h, None, True))
            else:
                out.extend((*group, s, e, n, h, None, False) for _, s, e, n, h in spine + stack)

        def fold(group) -> None:
            """Merges the last two runs over the gap between them; both are finished."""
            gap, s, e, n, h = stack.pop()
            low = stack[-1]
            if h < gap:
                out.append((*group, s, e, n, h, gap, True))
            if low[4] < gap:
                out.append((*group, *low[1:], gap, True))
            low[2], low[3], low[4] = e, low[3] + n, gap

        for batch in batches:
            for entity, chunk, s, e, n, h in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (entity, chunk) != key:
                    if key is not None:
                        close(key)
                    key, spine, stack = (entity, chunk), [], [[None, s, e, n, h]]
                    continue
                gap = s - stack[-1][2]
                while len(stack) > 1 and stack[-1][0] < gap:
                    if len(stack) > 2 or final:
                        fold(key)
                    else:  # a record from the left: what it merges with is not known here
                        spine.append(stack.pop(0))
                if len(stack) > 2 and stack[-1][0] == gap == stack[-2][0]:
                    fold(key)  # equal gaps make one node: keep one run of it
                stack.append([gap, s, e, n, h])
            if len(out) >= 8192:
                yield _batch(out)
                out.clear()
        if key is not None:
            close(key)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def entries(log: DataFrame, entity: str = "agent_id", at: str = "at_ms", entry_id: str = "entry_id", kind: str = "action_kind") -> DataFrame:
    """(entity, at_ms, kind, n): each entry once, put together by time and kind.

    Rows with a null entity or time are left out. Rows that share an entry_id count once (the least kind stands); rows
    without one can't be told apart from repeats and all count. Kinds are trimmed and put in lower case, null stays."""
    once = log.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(entity).cast("string").alias("entity"), F.col(at).cast("long").alias("at_ms"), F.col(entry_id).alias("entry_id"))
    once = once.agg(F.min(F.lower(F.trim(kind))).alias("kind"), F.when(F.first("entry_id").isNull(), F.count("*")).otherwise(F.lit(1)).alias("n"))
    return once.groupBy("entity", "at_ms", "kind").agg(F.sum("n").alias("n"))


def _chunk(at: Column) -> Column:
    return F.floor(at / F.lit(DAY_MS)).cast("long")


def gap_tree(log: DataFrame, entity: str = "agent_id", at: str = "at_ms", entry_id: str = "entry_id") -> DataFrame:
    """The nodes (entity, start_ms, end_ms, n_entries, height_ms, parent_height_ms; null above a root) of the gap trees.

    An empty log gives no nodes. Entries at one time are one leaf. Other columns of the log are not read."""
    ready()
    log = log.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    once = log.groupBy(F.col(entity).cast("string").alias("entity"), F.col(at).cast("long").alias("start_ms"), F.col(entry_id).alias("entry_id")).agg(F.count("*").alias("rows"))
    leaves = once.groupBy("entity", _chunk(F.col("start_ms")).alias("chunk"), "start_ms").agg(F.sum(F.when(F.col("entry_id").isNull(), F.col("rows")).otherwise(1)).alias("n_entries"))
    leaves = leaves.select("entity", "chunk", "start_ms", F.col("start_ms").alias("end_ms"), "n_entries", F.lit(0).cast("long").alias("height_ms"))
    days = leaves.repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "start_ms").mapInArrow(_grow(False), NODE)
    days = materialize(days, "gap-tree-days")
    rest = days.where("not done").select("entity", F.lit(0).cast("long").alias("chunk"), "start_ms", "end_ms", "n_entries", "height_ms")
    top = rest.repartition("entity").sortWithinPartitions("entity", "chunk", "start_ms").mapInArrow(_grow(True), NODE)
    return days.where("done").unionByName(top).drop("chunk", "done")


def cut(tree: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions (entity, start_ms, end_ms, duration_ms, n_entries) for one gap setting: a new one begins after more than gap_ms."""
    if gap_ms < 0:
        raise ValueError("gap_ms must not be negative")
    whole = (F.col("height_ms") <= gap_ms) & (F.col("parent_height_ms").isNull() | (F.col("parent_height_ms") > gap_ms))
    return tree.where(whole).select("entity", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_entries")


def count_kinds(sessions: DataFrame, log_entries: DataFrame) -> DataFrame:
    """Adds to each session a row per kind: (entity, start_ms, end_ms, duration_ms, n_entries, kind, n_of_kind).

    Sessions and entries are put in one order by (entity, day): an entry belongs to the session that began last before it,
    each session beginning anew with a day it runs into. One pass over sorted rows, however many sessions a day has."""
    none = F.lit(None)
    s = F.struct("start_ms", "end_ms", "duration_ms", "n_entries")
    day = sessions.select("entity", s.alias("s"), F.explode(F.sequence(_chunk(F.col("start_ms")), _chunk(F.col("end_ms")))).alias("day"))
    marks = day.select("entity", "day", F.greatest(F.col("s.start_ms"), F.col("day") * DAY_MS).alias("at"), F.lit(0).alias("entry"), "s", none.cast("string").alias("kind"), none.cast("long").alias("n"))
    e = log_entries.select("entity", _chunk(F.col("at_ms")).alias("day"), F.col("at_ms").alias("at"), F.lit(1).alias("entry"), none.cast(marks.schema["s"].dataType).alias("s"), "kind", F.col("n").cast("long").alias("n"))
    order = Window.partitionBy("entity", "day").orderBy("at", "entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = marks.unionByName(e).withColumn("s", F.last("s", ignorenulls=True).over(order)).where("entry = 1 and s is not null and at <= s.end_ms")
    return met.groupBy("entity", "s.start_ms", "s.end_ms", "s.duration_ms", "s.n_entries", "kind").agg(F.sum("n").alias("n_of_kind"))
