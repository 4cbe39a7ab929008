"""Queries over what sources find out, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally.plans.texts import rendered
from foretally.sources import inference
from foretally.sources.tables import table

#: Events as a CSV file would hold them, in either engine: types that only a few rows of many widen.
_TEXTS = {
    "id": "cast(event_id as {s})", "late": "case when event_id % 997 = 5 then '1.5' else cast(event_id as {s}) end", "cents": "cast(cast(round(value * 100) as bigint) as {s}) || '.0'", "user": "case when event_id % 97 = 0 then 'NA' else cast(user_id as {s}) end",
    "flag": "case when event_id % 3 = 0 then 'True' else 'false' end", "kind": "event_type", "day": "cast(cast(ts as date) as {s})", "moment": "case when event_id % 211 = 3 then cast(cast(ts as date) as {s}) || ' 10:30' else cast(cast(ts as date) as {s}) end",
    "odd": "case when event_id % 499 = 7 then '2024-02-30' else cast(cast(ts as date) as {s}) end", "none": "case when event_id % 2 = 0 then 'NA' else '' end",
}


def schema_inference(spark, sf_dir):
    """The narrowest type of each column of text, from all rows."""
    rows = rendered(table(spark, sf_dir, "events"), **{k: e.format(s="string") for k, e in _TEXTS.items()})
    return inference.kinds(rows).select("name", "kind", "n", "n_missing")


def typed_totals(spark, sf_dir):
    """Sums over columns of text that were typed by all their rows."""
    rows = inference.typed(rendered(table(spark, sf_dir, "events"), **{k: e.format(s="string") for k, e in _TEXTS.items()}))
    return rows.groupBy("kind").agg(F.count("user").alias("users"), F.sum("id").alias("ids"), F.sum("cents").cast("long").alias("cents"), F.count(F.when(F.col("flag"), 1)).alias("flags"), F.date_format(F.max("moment"), "yyyy-MM-dd HH:mm").alias("last_moment"))


QUERIES = {"schema_inference": schema_inference, "typed_totals": typed_totals}
_ROWS = " union all ".join(f"select '{k}' as name, nullif(nullif({e.format(s='varchar')}, ''), 'NA') as v from events" for k, e in _TEXTS.items())
SQL = {
    "schema_inference": rf"""with u as ({_ROWS}) select name, case when count(v) = 0 then 'double' when bool_and(lower(v) in ('true', 'false')) filter (v is not null) then 'boolean' when bool_and(try_cast(v as bigint) is not null and not contains(v, '.')) filter (v is not null) then 'bigint'
  when bool_and(try_cast(v as double) is not null) filter (v is not null) then 'double' when bool_and(regexp_full_match(v, '\d{{4}}-\d{{2}}-\d{{2}}') and try_cast(v as date) is not null) filter (v is not null) then 'date' when bool_and(try_cast(v as timestamp) is not null) filter (v is not null) then 'timestamp_ntz' else 'string' end as kind,
  count(*) as n, count(*) - count(v) as n_missing from u group by 1""",
    "typed_totals": "select event_type as kind, count(*) filter (event_id % 97 <> 0) as users, sum(event_id)::bigint as ids, sum(cast(round(value * 100) as bigint))::bigint as cents, count(*) filter (event_id % 3 = 0) as flags, strftime(max(case when event_id % 211 = 3 then cast(ts as date) + interval '10 hours 30 minutes' else cast(ts as date) end), '%Y-%m-%d %H:%M') as last_moment from events group by 1",
}
