"""Queries register themselves with their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The change log of public.users as SQL.
LOG = """log as (
  select event_id + 1 as seq, 'pg-main' as source_id, 'public' as "schema", 'users' as "table",
    case when event_id % 7919 = 500 then 't' when event_type = 'signup' then 'c' when event_type = 'error' then 'd' else 'u' end as op,
    user_id as id, event_type as kind,
    case when event_type <> 'click' then cast(cast(value as decimal(10,2)) as varchar) end as value,
    case when event_type <> 'view' then props end as props, event_type <> 'view' as has_props,
    printf('0/%04X', event_id + 1) as position, ts as commit_ts from events)"""

#: Its state after any prefix: {upto} is a condition on seq.
STATE = """keyed as (select * from log where op in ('c','u') and {upto}),
  gone as (select id, max(seq) as d from log where op = 'd' and {upto} group by id),
  fence as (select coalesce(max(seq), -1) as t from log where op = 't' and {upto}),
  reset as (select k.id, max(k.seq) as last_seq, greatest(coalesce(max(g.d), -1), max(f.t)) as r from keyed k left join gone g using (id) cross join fence f group by k.id),
  live as (select k.*, r.last_seq from keyed k join reset r using (id) where k.seq > r.r),
  state as (select id, last_seq,
      (select kind from live a where a.id = l.id order by seq desc limit 1) as kind,
      cast((select value from live a where a.id = l.id order by seq desc limit 1) as double) as value,
      (select props from live a where a.id = l.id and has_props order by seq desc limit 1) as props
    from (select distinct id, last_seq from live) l)"""

#: JSON of an event as SQL.
IMAGE = """'{"id":' || id || case when op = 'd' then '' else ',"kind":"' || kind || '"' || case when has_props then ',"props":"' || replace(props, '"', '\\"') || '"' else '' end || ',"value":' || coalesce(value, 'null') end || '}'"""
TIME = """regexp_replace(strftime(commit_ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'"""
EVENT = f"""'{{"source_id":"' || source_id || '","schema":"' || "schema" || '","table":"' || "table" || '","op":"' || op || '",' || case when op = 't' then '' when op = 'd' then '"before":' || {IMAGE} || ',' else '"after":' || {IMAGE} || ',' end || '"position":"' || position || '","commit_ts":"' || {TIME} || '"}}'"""


def query(sql: str | None = None):
    """Register a function as a query, with the SQL that gives the same rows if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put
