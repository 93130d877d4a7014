"""Queries over threads, keyed state and report metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import state as st
from ..operators import threads as th
from . import views
from .registry import register

DEPTHS = """
reached as (
  select thread_id, node_id, node_id as root_id, 0 as depth from tree where parent_id is null
  union all select t.thread_id, t.node_id, r.root_id, r.depth + 1 from tree t join reached r on t.thread_id = r.thread_id and t.parent_id = r.node_id)
"""


@register(f"with recursive {views.TREE}, {DEPTHS} select * from reached")
def thread_depths(spark, d):
    return th.depths(views.tree(spark, d))


@register(f"""
with recursive {views.TREE}, {DEPTHS}
select t.thread_id, t.node_id, case when t.parent_id <> r.root_id then p.author end as target
from tree t join reached r using (thread_id, node_id) left join tree p on t.parent_id = p.node_id
""")
def reply_targets(spark, d):
    tree = views.tree(spark, d)
    return th.reply_targets(tree, th.depths(tree))


@register(f"with {views.TREE} select thread_id, count(*) filter (where parent_id is null) as roots, count(*) filter (where parent_id is not null) as replies, greatest(1, cast(ceil(count(*) filter (where parent_id is null) / 20.0) as bigint)) as pages from tree group by thread_id")
def thread_counts(spark, d):
    return th.counts(views.tree(spark, d))


@register(f"with {views.TREE} select thread_id, node_id from tree where parent_id is null order by node_id limit 20 offset 20")
def thread_page(spark, d):
    return th.page(views.tree(spark, d), 2)


@register(f"with {views.TREE} select t.node_id from tree t where t.parent_id is not null and length(t.text) > 60 and not exists (select 1 from tree p where length(p.text) > 60 and p.thread_id = t.thread_id and p.node_id = t.parent_id)")
def thread_orphans(spark, d):
    return th.orphans(views.tree(spark, d).where("length(text) > 60")).select("node_id")


@register("select user_id, event_type, arg_max(event_id, row(ts, event_id)) as event_id, max(ts) as ts from events group by user_id, event_type")
def latest_state(spark, d):
    rows = views.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return st.latest(rows, ["user_id", "event_type"], "ts", "event_id")


@register("""
with a as (select c_custkey as k, c_acctbal as v, c_mktsegment as s from customer where c_acctbal >= 0),
b as (select o_custkey as k, max(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1)
select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v, s from a full join b on a.k = b.k
""")
def upsert(spark, d):
    a = views.table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    b = views.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return st.upsert(a, b, ["k"])


@register("""
with e as (select o_custkey as owner, o_orderkey as path, cast(round_even(o_totalprice, 0) as bigint) as bytes, o_orderdate as last_used from orders),
t as (select *, sum(bytes) over (partition by owner) as total, coalesce(sum(bytes) over (partition by owner order by last_used, path rows between unbounded preceding and 1 preceding), 0) as gone from e)
select owner, path from t where total - gone > 500000
""")
def byte_budget(spark, d):
    rows = views.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("last_used"), F.bround("o_totalprice").cast("long").alias("bytes"))
    return st.over_budget(rows, 500000, ["owner"]).select("owner", "path")


@register("""
with s as (select l_orderkey as job, l_linenumber as stage, case when l_linestatus = 'O' then 'completed' else 'running' end as status, l_partkey as path from lineitem),
f as (select p_partkey as path, case when p_size > 5 then p_size else 0 end as bytes from part)
select job, stage, status = 'completed' and min(coalesce(bytes, 0)) over (partition by job, stage) > 0 as ready from s left join f using (path)
""")
def stage_readiness(spark, d):
    stages = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("stage"), F.when(F.col("l_linestatus") == "O", "completed").otherwise("running").alias("status"), F.array("l_partkey").alias("artifacts"))
    files = views.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0).alias("bytes"))
    return st.ready(stages, files, ["job"]).select("job", "stage", "ready")


@register("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def pending_work(spark, d):
    done = views.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return st.pending(views.table(spark, d, "orders").select("o_orderkey"), done.distinct(), ["o_orderkey"])


@register("""
with r as (select *, row_number() over (partition by regexp_replace(url, '[?#].*$', '') order by case when starts_with(url, 'https') then 0 else 1 end, url, page_id) as k from pages where url is not null)
select page_id, url from r where k = 1
""")
def preferred_rows(spark, d):
    rows = views.table(spark, d, "pages").where("url is not null").select("page_id", "url", F.regexp_replace("url", r"[?#].*$", "").alias("stem"))
    return st.keep_first(rows, ["stem"], F.when(F.startswith(F.col("url"), F.lit("https")), 0).otherwise(1), "url", "page_id").select("page_id", "url")


@register("""
select event_id, case when event_type = 'error' then 'busy' when value < 40 then 'memory' when event_id % 100 > 85 then 'load' else 'admit' end as verdict from events where value is not null
""")
def admission(spark, d):
    e = views.table(spark, d, "events").where("value is not null")
    return e.select("event_id", st.admission(F.col("event_type") == "error", F.col("value"), F.lit(40.0), F.col("event_id") % 100).alias("verdict"))


RATES = "r as (select l_orderkey as k, l_linenumber as rate, ['a', 'ab', 'abc'][cast(max(l_quantity) as int) % 3 + 1] as text from lineitem group by 1, 2)"


def _rates(spark, d):
    text = F.element_at(F.array(*map(F.lit, ("a", "ab", "abc"))), (F.col("q").cast("int") % 3 + 1))
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("rate")).agg(F.max("l_quantity").alias("q"))
    return rows.select("k", "rate", text.alias("text"))


CONSENSUS = f"""
{RATES}, t as (select *, row_number() over (partition by k order by rate desc) as n from r),
v as (select k, text, count(*) as votes, max(rate) as best from t where n <= 3 group by k, text),
c as (select k, arg_max(text, row(votes, best)) as text, max(votes) as votes from v group by k)
"""


@register(f"with {CONSENSUS} select * from c")
def consensus(spark, d):
    return mt.consensus(_rates(spark, d), ["k"])


@register(f"""
with {CONSENSUS},
e as (select r.rate, levenshtein(r.text, c.text) as d, length(c.text) as n from r join c using (k))
select rate, sum(d)::bigint as edits, sum(n)::bigint as chars, round(sum(d) / sum(n), 6) as error_rate, count(*) filter (where d = 0) as exact from e group by rate
""")
def error_rates(spark, d):
    rates = _rates(spark, d)
    got = mt.error_rates(rates, mt.consensus(rates, ["k"]), ["k"])
    return got.select("rate", F.col("edits").cast("long").alias("edits"), F.col("chars").cast("long").alias("chars"), F.round("error_rate", 6).alias("error_rate"), "exact")


@register("""
with s as (select event_type, abs(value - 50) as v from events where value is not null),
o as (select *, row_number() over (partition by event_type order by v) as k, count(*) over (partition by event_type) as n from s)
select event_type, round(median(v), 6) as median, round(max(case when k = greatest(1, cast(floor(n * 0.9) as bigint)) then v end), 6) as p90, round(max(v), 6) as largest, count(*) as n from o group by event_type
""")
def error_summary(spark, d):
    rows = views.table(spark, d, "events").where("value is not null").select("event_type", (F.col("value") - 50).alias("error"))
    got = mt.error_summary(rows, "event_type", "error")
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "p90", "largest")], "n")


@register("""
with o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events where value is not null)
select user_id, round(greatest(10.0, min(value) * 1.5), 6) as "limit" from o where k <= 3 group by user_id
""")
def straggler_limit(spark, d):
    rows = views.table(spark, d, "events").where("value is not null").select("user_id", "event_id", F.col("value").alias("seconds"))
    return mt.straggler_limit(rows, ["user_id"], "event_id").select("user_id", F.round("limit", 6).alias("limit"))


@register("select o_custkey, count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus = 'O') as skipped, count(*) filter (where o_orderstatus = 'P') as failed from orders group by o_custkey")
def status_roll_up(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "skipped").when(F.col("o_orderstatus") == "P", "failed")
    return mt.roll_up(views.table(spark, d, "orders").withColumn("status", status), ["o_custkey"])
