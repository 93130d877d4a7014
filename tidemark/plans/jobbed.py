"""Events of a user as the log of a job, chunks with results as tasks that were split, and answers in chains of hundreds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flows as fl
from ..operators import jobs as jb
from ..operators import threads as th
from ..streaming import sessions as ss
from . import views
from .registry import register

STATUS = {"signup": "queued", "view": "running", "purchase": "completed", "error": "failed", "click": "deleted"}


def _log(spark, d):
    e = views.table(spark, d, "events").where("ts is not null and user_id is not null")
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("event_type")]
    fields = F.create_map(F.lit("value"), F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_type"), F.col("event_id").cast("string"))
    return e.select(F.col("user_id").alias("job_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at"), status.alias("status"), fields.alias("fields"))


LOG = f"""
log as (
  select user_id as job_id, event_id, epoch_us(ts) / 1000000 as moment, case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in STATUS.items())} end as status, event_type,
    cast(cast(value as decimal(18,2)) as varchar) as value, row_number() over (partition by user_id order by ts, event_id) as n
  from events where ts is not null and user_id is not null),
replay as (
  select job_id, 0 as n, cast(null as varchar) as now, 0 as life, cast(null as varchar) as before, false as accepted from log where n = 1
  union all
  select job_id, n, case when ok then status else now end, life + case when ok and now = 'deleted' then 1 else 0 end, now, ok
  from (
    select r.job_id, l.n, r.now, r.life, l.status,
      case when r.now is null or r.now = 'deleted' then l.status = 'queued' when l.status = 'deleted' then true when r.now = 'queued' then l.status in ('running', 'failed')
        when r.now = 'running' then l.status in ('completed', 'failed') when r.now = 'failed' then l.status = 'queued' else false end as ok
    from replay r join log l on l.job_id = r.job_id and l.n = r.n + 1)),
done as (select log.*, r.now, r.life, r.before, r.accepted from log join replay r using (job_id, n))"""


@register(f"""
with recursive {LOG}
select job_id, event_id, status, accepted, before, cast(life as int) as life from done
""")
def replayed_jobs(spark, d):
    return jb.replayed(_log(spark, d)).select("job_id", "event_id", "status", "accepted", "before", "life")


@register(f"""
with recursive {LOG},
lives as (select job_id, max(case when accepted then life end) as last, cast(count(*) filter (where not accepted) as bigint) as refused from done group by job_id),
own as (select done.* from done join lives using (job_id) where accepted and life = last),
named as (select job_id, 'value' as name, value as v, n from own where value is not null union all select job_id, event_type, cast(event_id as varchar), n from own),
fields as (select job_id, string_agg(name || '=' || v, ',' order by name) as fields from (select job_id, name, arg_max(v, n) as v from named group by job_id, name) group by job_id)
select own.job_id, arg_max(status, n) as status, round(min(moment), 3) as created_at, round(max(moment), 3) as updated_at, count(*) as changes, any_value(refused) as refused, any_value(fields) as fields
from own join lives using (job_id) join fields using (job_id) group by own.job_id having arg_max(status, n) <> 'deleted'
""")
def job_snapshot(spark, d):
    rows = jb.snapshot(jb.replayed(_log(spark, d)))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("job_id", "status", F.round("created_at", 3).alias("created_at"), F.round("updated_at", 3).alias("updated_at"), "changes", "refused", told.alias("fields"))


@register(f"""
with {views.SEGMENTS},
media as (select media_id, ceil(max("end")) + 1 as duration from segments group by media_id),
tasks as (select media_id, k, k * 60.0::double as start, least(60.0::double, duration - k * 60.0::double) as duration from (select media_id, duration, unnest(range(0, cast(greatest(1, ceil(duration / 60)) as bigint))) as k from media)),
heard as (select t.media_id, t.k, min(length(text)) as least, max(length(text)) as most, count(*) as n from tasks t join segments s on s.media_id = t.media_id and s."end" > t.start and s.start < t.start + t.duration group by t.media_id, t.k),
state as (
  select tasks.*, coalesce(n = 1 and most % 3 = 0, false) as whole, coalesce(n = 1 and most % 3 = 1, false) as broken, coalesce(n = 2 and most % 2 = 0, false) as a, coalesce(n = 2 and least % 2 = 0, false) as b
  from tasks left join heard using (media_id, k))
select media_id, cast(k as varchar) as label, start, duration, case when whole then 'cached' else 'missing' end as state from state where whole or broken or not (a or b)
union all select media_id, k || 'a', start, duration / 2, case when a then 'cached' else 'missing' end from state where not (whole or broken) and (a or b)
union all select media_id, k || 'b', start + duration / 2, duration / 2, case when b then 'cached' else 'missing' end from state where not (whole or broken) and (a or b)
""")
def remaining_parts(spark, d):
    """Results by what a chunk holds: one turn of a length that three divides, or leaves one over (broken); of two turns, halves by even lengths."""
    s = views.segments(spark, d)
    windows = fl.fixed_windows(s.groupBy("media_id").agg((F.ceil(F.max("end")) + 1).cast("double").alias("duration")))
    tasks = windows.select("media_id", F.col("chunk").cast("string").alias("label"), "start", "duration")
    both = s.select("media_id", F.col("start").alias("s"), F.col("end").alias("e"), F.length("text").alias("size")).join(tasks, "media_id").where("e > start and s < start + duration")
    heard = both.groupBy("media_id", "label").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"))
    file = lambda when, tail, valid: F.when(when, F.struct(F.concat("label", F.lit(tail)).alias("label"), F.lit(valid).alias("valid")))
    n, least, most = F.col("n"), F.col("least"), F.col("most")
    files = F.array(file((n == 1) & (most % 3 == 0), "", True), file((n == 1) & (most % 3 == 1), "", False), file((n == 2) & (most % 2 == 0), "a", True), file((n == 2) & (least % 2 == 0), "b", True))
    return jb.remaining(tasks, heard.select("media_id", F.inline(F.array_compact(files))))


@register("""
with log as (select user_id, event_id + 1 as event_id, row_number() over (partition by user_id order by event_id) - 1 as n, min(event_id + 1) over (partition by user_id) as root from events where user_id is not null and event_id is not null)
select user_id as thread_id, event_id as node_id, root as root_id, cast(n as int) as depth from log
""")
def deep_thread_depths(spark, d):
    """Each event of a user answers the one before it: one chain a user."""
    e = views.table(spark, d, "events").where("user_id is not null and event_id is not null")
    node = F.col("event_id") + 1  # a parent 0 is none
    parent = F.lag(node).over(Window.partitionBy("user_id").orderBy("event_id"))
    return th.depths(e.select(F.col("user_id").alias("thread_id"), node.alias("node_id"), parent.alias("parent_id")))


@register(r"""
with parts as (
  select conv_id as session_id, turn, unnest(string_split(replace(coalesce(text, ''), '.', '.' || chr(10)), chr(10))) as part, generate_subscripts(string_split(replace(coalesce(text, ''), '.', '.' || chr(10)), chr(10)), 1) - 1 as i from conversations),
rows as (select session_id, turn, i, trim(part) as text, turn * 3.0::double + i * 0.01::double as start from parts where trim(part) <> ''),
chunks as (select conv_id as session_id, max(turn) + 1 as n from conversations group by conv_id)
select c.session_id, cast(any_value(n) as int) as num_chunks, any_value(n) * 3.0::double as duration_seconds, 3.0::double as chunk_seconds, count(r.text) as num_segments, md5(coalesce(string_agg(r.text, chr(10) order by start, turn), '')) as transcript
from chunks c left join rows r on c.session_id = r.session_id group by c.session_id
""")
def capture_sessions(spark, d):
    """Turns as captured chunks: each part of a turn lasts a hundredth of a second."""
    parts = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit(".\n")), "\n", -1)
    segments = F.transform(parts, lambda p, i: F.struct((i * 0.01).alias("start"), (i * 0.01 + 0.01).alias("end"), p.alias("text")))
    chunks = views.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("chunk"), segments.alias("segments"))
    return ss.manifests(chunks, ss.captured(chunks)).withColumn("transcript", F.md5("transcript"))
