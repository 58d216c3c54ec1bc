"""The core's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SESSIONS_SQL = """
with once as (select agent_id, at_ms, entry_id, min(lower(trim(action_kind))) kind from action_log where agent_id is not null and at_ms is not null group by all),
marked as (select *, case when at_ms - lag(at_ms) over (partition by agent_id order by at_ms, entry_id) <= 1800000 then 0 else 1 end fresh from once),
numbered as (select *, sum(fresh) over (partition by agent_id order by at_ms, entry_id rows unbounded preceding) s from marked)
"""


@query(SESSIONS_SQL + "select agent_id, min(at_ms) start_ms, max(at_ms) end_ms from numbered group by agent_id, s")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.cut(sessions.gap_tree(table(spark, sf, "action_log")), 1_800_000).select(F.col("entity").alias("agent_id"), "start_ms", "end_ms")


@query(SESSIONS_SQL + """, whole as (select agent_id, s, min(at_ms) start_ms, max(at_ms) end_ms, count(*) n_entries from numbered group by all)
select w.agent_id, w.start_ms, w.end_ms, w.end_ms - w.start_ms duration_ms, w.n_entries, n.kind, count(*) n_of_kind from whole w join numbered n using (agent_id, s) group by all""")
def p5_sessions(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "action_log")
    cut = sessions.cut(sessions.gap_tree(log), 1_800_000)
    return sessions.count_kinds(cut, sessions.entries(log)).withColumnRenamed("entity", "agent_id")
