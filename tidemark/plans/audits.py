"""Queries over transcript audit and duplicates, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from . import views
from .registry import register

WS = r"regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')"
FINDINGS = f"""
sized as (select *, "end" - start as span, length({WS}) as n, length(regexp_replace({WS}, '[^一-鿿]', '', 'g')) as wide from segments),
row_findings as (
  select media_id, pos, start, "end", 'low text density' as reason from sized where span >= 6 and n / span < 1.5
  union all select media_id, pos, start, "end", 'abnormal cps' from sized where span > 0 and n / span > case when n > 0 and wide >= greatest(1, n // 3) then 24 else 30 end
  union all select media_id, pos, start, "end", 'long cue' from sized where span > 5.25),
lagged as (select *, lag(start) over (partition by media_id order by pos) as ps, lag("end") over (partition by media_id order by pos) as pe from segments),
order_findings as (
  select media_id, pos, start, case when start < ps then "end" else pe end as "end", case when start < ps then 'reverse timestamp' else 'overlapping timestamp' end as reason
  from lagged where start < ps or start < pe)
"""


@register(f"with {views.SEGMENTS}, {FINDINGS} select * from row_findings")
def row_findings(spark, d):
    return au.row_findings(views.segments(spark, d))


@register(f"with {views.SEGMENTS}, {FINDINGS} select * from order_findings")
def order_findings(spark, d):
    return au.order_findings(views.segments(spark, d))


#: Events as rows of few texts, so that repetition occurs.
LABELLED = f"{views.INTERVALS}, labelled as (select media_id, pos, start, \"end\", label as text from intervals)"


def _labelled(spark, d):
    return views.intervals(spark, d).withColumnRenamed("label", "text")


@register(f"""
with {LABELLED},
t as (select media_id, text, count(*) as n, max("end") as e from labelled group by media_id, text),
m as (select media_id, max(n) as most, sum(n) as total, max(e) as e from t group by media_id)
select media_id, cast(-1 as bigint) as pos, 0.0::double as start, e as "end", 'repetition hallucination' as reason from m where total >= 8 and most >= 8 and most / total >= 0.3
""")
def global_repetition(spark, d):
    return au.global_repetition(_labelled(spark, d))


@register(f"""
with {LABELLED},
n as (
  select *, list(struct_pack(s := start, e := "end", t := text)) over (partition by media_id order by start, "end", pos rows between 1 following and 4 following) as ahead from labelled),
h as (select *, list_filter(ahead, lambda x: x.s - start <= 40000 and x.t = text) as near from n)
select media_id, pos, start, near[-1].e as "end", 'local repetition hallucination' as reason from h where length(text) >= 4 and len(near) >= 2
""")
def local_repetition(spark, d):
    return au.local_repetition(_labelled(spark, d), seconds=40000.0)


@register(f"""
with {LABELLED},
t as (select media_id, text, count(*) as n from labelled group by media_id, text),
m as (select media_id, max(n) as most, sum(n) as total, count(*) as kinds from t group by media_id)
select media_id, case when most >= 8 and most / total >= 0.3 then 'one phrase' else 'few texts' end as issue
from m where total >= 20 and ((most >= 8 and most / total >= 0.3) or (total >= 40 and kinds / total <= 0.12))
""")
def table_issue(spark, d):
    return au.table_issue(_labelled(spark, d))


@register(f"""
with {views.INTERVALS},
obs as (select media_id, pos, ['de', 'en', 'fr', ''][pos % 4 + 1] as language, case when pos % 5 = 0 then null else (pos % 10) / 10.0 end as confidence, (pos % 9)::double as speech_seconds from intervals),
h as (select *, sum(speech_seconds) over (partition by media_id order by pos) as heard from obs)
select media_id, arg_min(language, pos) filter (where language <> '' and (coalesce(coalesce(confidence, case when speech_seconds >= 6 then 1.0 end) >= 0.65, false) or heard >= 30)) as language from h group by media_id
""")
def pinned_language(spark, d):
    rows = views.intervals(spark, d)
    at = (F.col("pos") % 4 + 1).cast("int")
    obs = rows.select("media_id", "pos", F.element_at(F.array(*map(F.lit, ("de", "en", "fr", ""))), at).alias("language"), F.when(F.col("pos") % 5 != 0, (F.col("pos") % 10) / 10.0).alias("confidence"), (F.col("pos") % 9).cast("double").alias("speech_seconds"))
    return au.pinned_language(obs)


@register(f"""
with {LABELLED},
a as (select *, lag(text) over (partition by media_id order by start, "end", pos) as before from labelled),
b as (select *, sum(case when before is null or before <> text then 1 else 0 end) over (partition by media_id order by start, "end", pos) as run from a),
c as (select *, max("end") over (partition by media_id, run order by start, "end", pos rows between unbounded preceding and 1 preceding) as reach from b),
d as (select *, sum(case when start - reach > 3600 then 1 else 0 end) over (partition by media_id, run order by start, "end", pos) as part from c)
select media_id, arg_min(pos, row(start, "end", pos)) as pos, min(start) as start, max("end") as "end", arg_min(text, row(start, "end", pos)) as text, count(*) as merged from d group by media_id, run, part
""")
def merged_adjacent(spark, d):
    return au.merged_adjacent(_labelled(spark, d), gap=3600.0)


@register(f"""
with {views.SEGMENTS}, {FINDINGS},
speech as (select media_id, pos, start + 1.5 as start, "end" + 2.5 as "end" from segments),
spoken as (select * from segments),
sums as (
  select r.media_id, r.pos, any_value(r."end" - r.start) as span, coalesce(sum(case when c.pos is null then 0.0 else greatest(0.0, least(r."end", c."end") - greatest(r.start, c.start)) end), 0.0) as total
  from speech r left join (select * from spoken where trim(text) <> '') c on r.media_id = c.media_id and c.start < r."end" and c."end" > r.start group by r.media_id, r.pos)
select media_id, round(case when sum(span) <= 0 then 1.0 else least(1.0, sum(least(total, span)) / sum(span)) end, 6) as speech_coverage,
  case when sum(case when span - least(total, span) > 0.6 then 1 else 0 end) > 0 then 'incomplete_speech_coverage' else 'passed' end as status
from sums group by media_id
""")
def audit_coverage(spark, d):
    s = views.segments(spark, d)
    speech = s.withColumns({"start": F.col("start") + 1.5, "end": F.col("end") + 2.5})
    cover = au.uncovered_speech(speech, s).groupBy("media_id").agg(F.count(F.lit(1)).alias("open"))
    report = au.audit(s, speech).where("media_id is not null").join(cover, "media_id", "left")
    heard = speech.select("media_id").distinct()
    return report.join(heard, "media_id", "left_semi").select("media_id", F.round("speech_coverage", 6).alias("speech_coverage"), au.status(F.coalesce("open", F.lit(0)), F.lit(0), F.lit(0)).alias("status"))


@register()
def audit_report(spark, d):
    s = views.segments(spark, d)
    return au.audit(s, s.withColumn("end", F.col("end") + 1.0), warnings=s.where("length(text) > 100"))


@register()
def audit_regions(spark, d):
    s = views.segments(spark, d)
    return au.audit_regions(s, s.withColumn("end", F.col("end") + 1.0))


@register(f"""
with {views.SEGMENTS},
g as (select *, start - lag("end") over (partition by media_id order by pos) as gap, "end" - start as span, length({WS}) as n from segments),
m as (select media_id, count(*) as rows_, max("end") as duration, max("end") - min(start) as span, sum(length(trim(text))) as chars, max(coalesce(gap, 0)) as gap, bool_or(span >= 6 and n >= 2 and n / span < 1.5) as slow from g group by media_id)
select media_id, case when duration < 20 then false else (rows_ <= 2 and span < duration * 0.25 and chars < 40) or slow or gap >= 6 end as thin from m
""")
def thin_chunks(spark, d):
    s = views.segments(spark, d)
    media = s.groupBy("media_id").agg(F.max("end").alias("duration"))
    return au.bad_chunk(s, media, stutters=False).select("media_id", F.col("bad").alias("thin"))


@register(f"""
with {views.SEGMENTS},
l as (select *, trim(text) = trim(lag(text) over (partition by media_id order by pos)) as same from segments)
select media_id, -sum(length({WS}) - length(replace({WS}, chr(65533), '')))::bigint as damage, -sum(case when same then 1 else 0 end)::bigint as repeats, sum(length({WS}))::bigint as chars from l group by media_id
""")
def text_score(spark, d):
    got = au.text_score(views.segments(spark, d)).select("media_id", "score.*")
    return got.select("media_id", *[F.col(c).cast("long").alias(c) for c in ("damage", "repeats", "chars")])
