"""Run ledger, votes, set operations and ordering queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foretally.functions import text as T
from foretally.operators import ledger, transcripts
from foretally.sources.tables import table

#: Rendered in both engines: hyper-parameters of an event.
_MODEL = "case when value < 20 then 'arima' when value < 40 then 'holt' when value < 60 then 'prophet' else 'xgb' end"
_PARAMETERS = "case when event_id % 3 = 0 then '{\"order\": \"(1,' || (event_id % 4) || ',1)\", \"seasonal_order\": \"(0,1,1)\", \"x\": ' || (event_id % 5) || '}' else '{\"depth\": ' || (event_id % 3) || '}' end"
_CORE = "case when event_id % 3 = 0 then 'order=(1,' || (event_id % 4) || ',1),seasonal_order=(0,1,1)' else 'depth=' || (event_id % 3) end"


def _votes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.expr(_MODEL).alias("model"), F.expr(_PARAMETERS).alias("parameters")).withColumn("core", T.core_parameters(F.col("parameters")))


def vote_top1(spark, sf_dir):
    return ledger.top_vote(_votes(spark, sf_dir), "model", "event_id", "user_id")


def vote_two_level(spark, sf_dir):
    return ledger.two_level_vote(_votes(spark, sf_dir), "event_id", "user_id")


def _top_sql(src: str, value: str, name: str) -> str:
    return f"""{name} as (select user_id, {value}, votes, total from (select user_id, {value}, votes, sum(votes) over (partition by user_id) as total, row_number() over (partition by user_id order by votes desc, f) as rn
  from (select user_id, {value}, count(*) as votes, min(event_id) as f from {src} group by 1, 2)) where rn = 1)"""


_V = f"with v as (select user_id, event_id, {_MODEL} as model, {_PARAMETERS} as parameters, {_CORE} as core from events)"


#: The same text in both engines.
_DEEP_JSON = """'{"z": {"y": [{"x": {"w": {"v": "' || event_id || '", "u": [1.00001, 2]}, "a": null}}]}, "event": ' || event_id || ', "b": ' || props || '}'"""


def json_canonical(spark, sf_dir):
    """Event properties with a float, out of order, five levels deep and as a string, and blank or broken ones among them."""
    x = f"case event_id % 5 when 0 then '' when 1 then 'not json' when 2 then '{{\"b\": 2, \"a\": ' || (event_id % 9) || '.123456}}' when 3 then {_DEEP_JSON} else props end"
    return table(spark, sf_dir, "events").select("event_id", T.canonical_json(F.expr(x)).alias("canonical"))


def json_probe(spark, sf_dir):
    """The first of two fields that an event's properties have."""
    p = F.coalesce(F.get_json_object("props", "$.seasonal_periods"), F.get_json_object("props", "$.k")).cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(p).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"))


def _plan(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    runs = spark.range(1, 4).select(F.col("id").cast("int").alias("run"))
    return ledger.run_plan(nation.select(F.col("n_name").alias("dataset")), region.select(F.col("r_name").alias("scenario")), runs).withColumn("run_key", ledger.run_key(F.col("dataset"), F.col("scenario"), run=F.col("run")))


def run_plan(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("scenario").agg(F.count("*").alias("n_runs"), F.countDistinct("dataset").alias("datasets"))


def run_key(spark, sf_dir):
    return _plan(spark, sf_dir)


_PLAN_SQL = "p as (select n_name as dataset, r_name as scenario, r.run::int as run, substr(md5(n_name || '|' || r_name || '|' || lpad(r.run::varchar, 2, '0')), 1, 12) as run_key from nation, region, (values (1), (2), (3)) r(run))"


def skip_completed(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    log = plan.withColumn("n", F.char_length("dataset")).select("run_key", F.when(F.col("n") % 3 == 0, "OK").when(F.col("n") % 3 == 1, "SYSTEM_TIMEOUT").otherwise("INVALID_LIST_LENGTH").alias("run_status")).where("run_key >= '8'")
    return ledger.pending(plan, log).select("dataset", "scenario", "run", "run_key")


def upsert_keep_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1 and o_custkey % 3 = 0")
    return ledger.upsert(old, new, "o_custkey", order="o_orderkey")


def incremental_append(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return ledger.unseen(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("seen")), "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def set_ops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    rows = [c.intersect(s).withColumn("op", F.lit("intersect")), c.subtract(s).withColumn("op", F.lit("except")), c.union(s).distinct().withColumn("op", F.lit("union"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("op").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


_PRIORITIES = ("2-HIGH", "1-URGENT", "5-LOW", "4-NOT SPECIFIED", "3-MEDIUM")


def custom_order_sort(spark, sf_dir):
    """Order priorities in a stated order, unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, _PRIORITIES)), F.col("o_orderpriority"))
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", F.when(place == 0, 99).otherwise(place).cast("int"))
    return g.orderBy("place", "o_orderpriority")


def version_sort(spark, sf_dir):
    """Parts by the number in their brand."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return p.withColumn("version", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")).orderBy("version", "p_brand")


def head_tail(spark, sf_dir):
    """First and last rows of each priority's orders, in date order."""
    w = Window.partitionBy("o_orderpriority")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    n = o.withColumn("i", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    return n.where("i <= 3 or back <= 3").select("o_orderpriority", "o_orderkey", F.when(F.col("i") <= 3, "head").otherwise("tail").alias("end"))


def seeded_sample(spark, sf_dir):
    """Three orders of each status, the same whenever asked."""
    w = Window.partitionBy("o_orderstatus").orderBy(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))))
    return table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w)).where("i <= 3").select("o_orderstatus", "o_orderkey", "i")


def csv_render(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return transcripts.prompt_csv(n.withColumn("_order", F.col("n_nationkey")), "head_tail", "_order", most=8)


def turn_ledger(spark, sf_dir):
    """Budgets and word counts of each turn."""
    c = table(spark, sf_dir, "conversations")
    words = T.word_count(F.col("text"))
    rows = c.select("turn", words.alias("words"), ledger.token_budget(words).alias("budget"), ledger.seconds_limit(F.col("turn"), F.col("conv_id") % 2 == 0).alias("seconds"))
    return rows.groupBy("turn").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("budget").cast("long").alias("max_budget"), F.sum("seconds").alias("seconds"))


def ledger_lookup(spark, sf_dir):
    """Orders with their status's setup, whatever its case."""
    from foretally.sources.tables import lookup

    setups = spark.createDataFrame([("f", "finished", 12), ("o", "open", 24), ("p", "partial", 52)], "o_orderstatus string, meaning string, season int")
    j = lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), setups, "o_orderstatus")
    return j.groupBy("meaning", "season").agg(F.count("*").alias("n"))


QUERIES = {
    "vote_top1": vote_top1, "vote_two_level": vote_two_level, "json_canonical": json_canonical, "json_probe": json_probe, "run_plan": run_plan, "run_key": run_key, "skip_completed": skip_completed,
    "upsert_keep_last": upsert_keep_last, "incremental_append": incremental_append, "set_ops": set_ops, "custom_order_sort": custom_order_sort, "version_sort": version_sort, "head_tail": head_tail,
    "seeded_sample": seeded_sample, "csv_render": csv_render, "turn_ledger": turn_ledger, "ledger_lookup": ledger_lookup,
}
SQL = {
    "vote_top1": _V + ", " + _top_sql("v", "model", "t") + " select user_id, model, votes, total::bigint as total from t",
    "vote_two_level": _V + ", " + ", ".join([
        _top_sql("v", "model", "m"), "o as (select v.* from v join m using (user_id, model))", _top_sql("o", "parameters", "e"), _top_sql("o", "core", "c"),
        "i as (select o.* from o join c using (user_id, core))", _top_sql("i", "parameters", "b"),
    ]) + " select m.user_id, m.model, m.votes as model_votes, case when e.votes >= 3 then e.parameters else b.parameters end as parameters, case when e.votes >= 3 then e.votes else c.votes end as parameter_votes, case when e.votes >= 3 then 'exact' else 'core' end as level, m.total::bigint as total from m join e using (user_id) join c using (user_id) join b using (user_id)",
    "seeded_sample": "select o_orderstatus, o_orderkey, cast(row_number() over (partition by o_orderstatus order by md5('42:' || o_orderkey)) as int) as i from orders qualify i <= 3",
    "json_canonical": """select event_id, case event_id % 5 when 0 then '{}' when 1 then 'not json' when 2 then '{"a": ' || case when event_id % 9 = 0 then '0.1235' else (event_id % 9) || '.1235' end || ', "b": 2}'
  when 3 then '{"b": {"k": ' || json_extract(DEEP, '$.b.k') || '}, "event": ' || json_extract(DEEP, '$.event') || ', "z": {"y": [{"x": {"a": null, "w": {"u": [1.0, 2], "v": ' || json_extract(DEEP, '$.z.y[0].x.w.v') || '}}}]}}' else '{"k": ' || json_extract_string(props, '$.k') || '}' end as canonical from events""".replace("DEEP", _DEEP_JSON),
    "json_probe": "with p as (select event_type, cast(coalesce(json_extract_string(props, '$.seasonal_periods'), json_extract_string(props, '$.k')) as int) as p from events) select event_type, count(p) as n, min(p) as low, max(p) as high from p group by 1",
    "run_plan": f"with {_PLAN_SQL} select scenario, count(*) as n_runs, count(distinct dataset) as datasets from p group by 1",
    "run_key": f"with {_PLAN_SQL} select * from p",
    "skip_completed": f"with {_PLAN_SQL} select * from p where not (run_key >= '8' and length(dataset) % 3 <> 1)",
    "upsert_keep_last": """with b as (select o_custkey, o_orderkey, o_totalprice, 0 as nw from orders where o_orderkey % 2 = 0 union all select o_custkey, o_orderkey, o_totalprice, 1 from orders where o_orderkey % 2 = 1 and o_custkey % 3 = 0)
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by nw desc, o_orderkey desc) as rn from b) where rn = 1""",
    "incremental_append": "select case when o_orderkey % 3 = 0 then 'seen' else o_orderstatus end as o_orderstatus, count(*) as n from orders group by 1",
    "set_ops": """with c as (select distinct c_nationkey as k from customer), s as (select distinct s_nationkey as k from supplier)
select 'intersect' as op, count(*) as n, sum(k)::bigint as total from c where k in (select k from s) union all select 'except', count(*), sum(k)::bigint from c where k not in (select k from s) having count(*) > 0
union all select 'union', count(*), sum(k)::bigint from (select k from c union select k from s)""",
    "custom_order_sort": "select o_orderpriority, count(*) as n, coalesce(list_position(['" + "', '".join(_PRIORITIES) + "'], o_orderpriority), 99)::int as place from orders group by 1 order by place",
    "version_sort": "select p_brand, count(*) as n, cast(regexp_extract(p_brand, '(\\d+)', 1) as int) as version from part group by 1",
    "head_tail": """with n as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as i, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey desc) as back from orders)
select o_orderpriority, o_orderkey, case when i <= 3 then 'head' else 'tail' end as "end" from n where i <= 3 or back <= 3""",
    "csv_render": """with n as (select n_nationkey, n_name, n_regionkey, (row_number() over (order by n_nationkey) - 1)::int as n, count(*) over () as total from nation)
select n, case when n = 4 and n < total - 4 then '...' else n_nationkey || ',' || n_name || ',' || n_regionkey end as line from n where n < 4 or n >= total - 4 or n = 4""",
    "turn_ledger": r"""with w as (select turn, conv_id, len(regexp_extract_all(text, '\S+')) as words from conversations)
select turn, count(*) as n, sum(words)::bigint as words, max(least(8192, 2400 + 20 * words))::bigint as max_budget, sum(case when turn < 3 then case when conv_id % 2 = 0 then 300 else 120 end when conv_id % 2 = 0 then 600 else 300 end)::bigint as seconds from w group by 1""",
    "ledger_lookup": "select case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'partial' end as meaning, (case o_orderstatus when 'F' then 12 when 'O' then 24 else 52 end)::int as season, count(*) as n from orders group by 1, 2",
}
