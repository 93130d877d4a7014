"""Queries over evidence, report figures, caches and documents, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import evidence as ev
from ..operators import reports as rp
from ..sources import documents as docs
from . import views
from .registry import register


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _media(rows):
    return rows.groupBy("media_id").agg((F.max("end") + 1).alias("duration"))


MEDIA = """media as (select media_id, max("end") + 1 as duration from segments group by media_id)"""


@register(f"""
with {views.SEGMENTS}, {MEDIA},
w as (select media_id, start, "end", coalesce(max("end") over (partition by media_id order by start, "end" rows between unbounded preceding and 1 preceding), 0) as cursor_ from segments),
g as (
  select media_id, cursor_ as a, start as b from w
  union all select media_id, duration - 1, duration from media),
s as (select media_id, min(a) as a, max(b) as b from g where b - a >= 0.1 group by media_id)
select media_id, round(greatest(0, a - 0.1), 6) as start, round(greatest(0, least(duration, b + 0.15) - greatest(0, a - 0.1)), 6) as seconds from media left join s using (media_id)
""")
def voice_window(spark, d):
    rows = views.segments(spark, d)
    return _six(ev.voice_window(rows, _media(rows)), "start", "seconds")


@register(f"""
with {views.SEGMENTS},
p as (
  select s.media_id, s.pos, r.pos as r_pos, r.text, row_number() over (partition by s.media_id, s.pos order by r.pos) as k
  from segments s join segments r on r.media_id = s.media_id and length(r.text) > 80 and r."end" >= s.start - 0.75 and r.start <= s."end" + 0.75),
j as (select media_id, pos, string_agg(text, ' / ' order by r_pos) as beside from p where k <= 4 group by media_id, pos)
select s.media_id, s.pos, md5(coalesce(beside, 'nothing beside')) as beside from segments s left join j using (media_id, pos)
""")
def reference_texts(spark, d):
    s = views.segments(spark, d)
    got = ev.texts_beside(s, s.where("length(text) > 80"), 0.75, closed=True, first=4, separator=" / ", missing="nothing beside")
    return got.select("media_id", "pos", F.md5("beside").alias("beside"))


@register(f"""
with {views.SEGMENTS},
p as (select s.media_id, s.pos, r.pos as r_pos, r.text from segments s join segments r on r.media_id = s.media_id and r."end" > s.start - 2 and r.start < s."end" + 2 where length(s.text) > 40),
j as (select media_id, pos, string_agg(text, '' order by r_pos) as beside from p group by media_id, pos)
select s.media_id, s.pos, md5(coalesce(beside, '')) as beside from segments s left join j using (media_id, pos) where length(s.text) > 40
""")
def cue_window_texts(spark, d):
    s = views.segments(spark, d)
    return ev.texts_beside(s.where("length(text) > 40"), s, 2.0, missing="").select("media_id", "pos", F.md5("beside").alias("beside"))


@register(f"""
with {views.SEGMENTS},
norm as (select media_id, pos, start, "end", regexp_replace(lower(text), '[^a-z]+', '', 'g') as text from segments),
p as (select s.media_id, s.pos, r.pos as r_pos, r.text from segments s join norm r on r.media_id = s.media_id and r.text <> '' and r."end" >= s.start - 1.2 and r.start <= s."end" + 1.2),
j as (select media_id, pos, string_agg(text, ',' order by r_pos) as beside from p group by media_id, pos)
select s.media_id, s.pos, md5(beside) as beside from segments s left join j using (media_id, pos)
""")
def disputed_windows(spark, d):
    s = views.segments(spark, d)
    seen = s.withColumn("text", F.regexp_replace(F.lower("text"), "[^a-z]+", "")).where("text <> ''")
    return ev.texts_beside(s, seen, 1.2, closed=True, separator=",").select("media_id", "pos", F.md5("beside").alias("beside"))


PLACED = f"""
{views.SEGMENTS},
placed as (select media_id, pos, text, cast(sum(length(text)) over (partition by media_id order by pos) - length(text) as bigint) as s, cast(sum(length(text)) over (partition by media_id order by pos) as bigint) as e from segments)
"""


@register(f"""
with {PLACED}
select a.media_id, a.pos, b.pos as r_pos from placed a join placed b on a.media_id = b.media_id and b.s < a.e + 10 and b.e > greatest(0, a.s - 10) and trim(b.text) <> ''
""")
def cues_in_range(spark, d):
    upto = F.sum(F.length("text")).over(Window.partitionBy("media_id").orderBy("pos"))
    rows = views.segments(spark, d).select("media_id", "pos", "text", (upto - F.length("text")).alias("start"), upto.alias("end"))
    return ev.rows_in_range(rows.drop("text"), rows).select("media_id", "pos", "r_pos")


@register(f"""
with {views.SEGMENTS}, times as (select media_id, start as t from segments union all select media_id, "end" from segments)
select s.media_id, s.pos, count(*) filter (where t < s.start) as first, count(*) filter (where t <= s."end") as past
from segments s join times using (media_id) group by s.media_id, s.pos
""")
def character_places(spark, d):
    s = views.segments(spark, d)
    return ev.places(s, s.select("media_id", F.explode(F.array("start", "end")).alias("t")))


@register(f"""
with {views.SEGMENTS},
again as (select media_id, pos, start + case when length(text) % 2 = 1 then 1000 else 0.1 end as start, "end" + case when length(text) % 2 = 1 then 1000 else 0.1 end as "end", ' ' || text as text from segments)
select media_id, pos from again a where not exists (select 1 from segments s where s.media_id = a.media_id and a."end" > s.start and a.start < s."end" and trim(s.text) = trim(a.text))
""")
def unrepeated_rows(spark, d):
    s = views.segments(spark, d)
    by = F.when(F.length("text") % 2 == 1, 1000.0).otherwise(0.1)
    again = s.select("media_id", "pos", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), F.concat(F.lit(" "), "text").alias("text"))
    return ev.unrepeated(again, s).select("media_id", "pos")


ISLANDS = f"""
{views.INTERVALS},
sides as (select media_id, start, "end", label = 'view' as a from intervals where label in ('view', 'purchase') and "end" > start),
marked as (select *, coalesce(start > max("end") over (partition by media_id, a order by start, "end" rows between unbounded preceding and 1 preceding), true) as begins from sides),
numbered as (select *, sum(begins::int) over (partition by media_id, a order by start, "end" rows unbounded preceding) as n from marked),
islands as (select media_id, a, n, min(start) as start, max("end") as "end" from numbered group by media_id, a, n)
"""


def _sides(spark, d):
    v = views.intervals(spark, d)
    return v.where("label = 'view'"), v.where("label = 'purchase'")


@register(f"""
with {ISLANDS}
select x.media_id, round(greatest(x.start, y.start), 3) as start, round(least(x."end", y."end"), 3) as "end"
from islands x join islands y on x.media_id = y.media_id and x.a and not y.a and x.start < y."end" and x."end" > y.start
""")
def regions_in_both(spark, d):
    return ev.region_sets(*_sides(spark, d)).select("media_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register(f"""
with {ISLANDS},
holes as (
  select media_id, lag("end", 1, -1e18) over (partition by media_id order by start) as start, start as "end" from islands where not a
  union all select media_id, max("end"), 1e18 from islands where not a group by media_id
  union all select distinct media_id, -1e18, 1e18 from islands where a and media_id not in (select media_id from islands where not a))
select x.media_id, round(greatest(x.start, h.start), 3) as start, round(least(x."end", h."end"), 3) as "end"
from islands x join holes h on x.media_id = h.media_id and x.a and x.start < h."end" and x."end" > h.start
""")
def regions_in_first(spark, d):
    return ev.region_sets(*_sides(spark, d), how="difference").select("media_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register("""
with e as (select page_id as entry_id, url as source, split_part(url, '?', 1) as canonical_source, case when length(url) % 3 = 0 then md5(url) end as cache_key from pages),
f as (select split_part(url, '?', 1) as source, split_part(url, '/', 3) as identity, md5(url || case when length(html) % 2 = 0 then '' else 'x' end) as cache_key, 'c/' || page_id as path from pages),
k as (select cache_key, min(path) as own from f group by cache_key),
n as (select name, min(path) as p from (select source as name, path from f union all select identity, path from f) where name <> '' group by name),
o as (select entry_id, min(p) as other from (select entry_id, source as name from e union all select entry_id, canonical_source from e) join n using (name) group by entry_id)
select entry_id, coalesce(own, other) as path from e left join k using (cache_key) left join o using (entry_id)
""")
def relocated_files(spark, d):
    p = views.table(spark, d, "pages")
    bare = F.split_part("url", F.lit("?"), F.lit(1))
    entries = p.select(F.col("page_id").alias("entry_id"), F.col("url").alias("source"), bare.alias("canonical_source"), F.when(F.length("url") % 3 == 0, F.md5("url")).alias("cache_key"))
    key = F.md5(F.concat("url", F.when(F.length("html") % 2 == 0, "").otherwise("x")))
    files = p.select(bare.alias("source"), F.split_part("url", F.lit("/"), F.lit(3)).alias("identity"), key.alias("cache_key"), F.concat(F.lit("c/"), F.col("page_id").cast("string")).alias("path"))
    return ev.relocated(entries, files).select("entry_id", "path")


PLAN = f"""
{views.SEGMENTS},
plan as (
  select media_id, start, case when "end" - start > 8 then start + 2 else "end" end as "end", 4 as fps from segments
  union all select media_id, start + 2, "end" - 2, 1 from segments where "end" - start > 8
  union all select media_id, "end" - 2, "end", 4 from segments where "end" - start > 8)
"""


@register(f"""
with {PLAN}
select media_id, count(*) as windows, cast(sum(ceil(("end" - start) * fps)) as bigint) as frames, round(median("end" - start), 3) as median_seconds from plan group by media_id
""")
def plan_totals(spark, d):
    return rp.plan_totals(ch.sampling_plan(views.segments(spark, d)))


@register(f"""
with {views.SEGMENTS}
select media_id, count(*) as cues, round(avg(length(text)), 3) as mean_characters, round(avg("end" - start), 3) as mean_seconds from segments group by media_id
""")
def cue_means(spark, d):
    return rp.cue_means(views.segments(spark, d))


@register("select user_id, count(value) as samples, median(value) as median, median(value) >= 20 as mono_safe from events group by user_id")
def median_suppression(spark, d):
    return rp.mono_safe(views.table(spark, d, "events"), ["user_id"], 20.0, "value")


@register("select lang, source, count(*) as n from documents group by lang, source")
def counted_levels(spark, d):
    return rp.counted(views.table(spark, d, "documents"), "lang", "source")


@register(f"""
with {views.SEGMENTS},
cues as (select media_id, length(text) % 101 / 100.0::double as coverage, length(text) % 11 / 10.0::double as confidence from segments where length(text) > 60),
f as (select media_id, count(*) as frames, count(*) filter (where length(text) > 60) as hit from segments group by media_id),
c as (select media_id, count(*) as n, avg(confidence) as c, avg(coverage) as a, median(coverage) as m, count(*) filter (where coverage >= 0.8) as e, count(*) filter (where coverage >= 0.6) as s from cues group by media_id)
select media_id, frames, round(hit / frames, 6) as detection_rate, coalesce(n, 0) as cues, round(coalesce(c, 0), 6) as mean_confidence, round(coalesce(a, 0), 6) as mean_coverage,
  round(coalesce(m, 0), 6) as median_coverage, coalesce(e, 0) as at_least_80, coalesce(s, 0) as at_least_60 from f left join c using (media_id)
""")
def coverage_report(spark, d):
    s = views.segments(spark, d)
    n = F.length("text")
    cues = s.where("length(text) > 60").select("media_id", (n % 101 / 100).alias("coverage"), (n % 11 / 10).alias("confidence"))
    return rp.coverage_report(cues, s.select("media_id", F.when(n > 60, F.lit("seen")).alias("text")))


@register("""
with f as (select split_part(split_part(url, '://', 2), '?', 1) as path, length(html) as length from pages),
p as (select string_split(path, '/') as parts, length from f where contains(path, '/')),
a as (select unnest(list_distinct([array_to_string(parts[1:n], '/') for n in range(1, len(parts))])) as folder, length from p)
select folder, count(*) as files, cast(sum(length) as bigint) as bytes from a group by folder
""")
def folder_bytes(spark, d):
    bare = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))
    return rp.folder_bytes(views.table(spark, d, "pages").select(bare.alias("path"), F.length("html").alias("length")))


@register(f"""
with {views.SEGMENTS}, {MEDIA},
p as (select media_id, duration, unnest([1, 2, 3, 4, 5, 6, 7]) as probe from media)
select media_id, probe, round(greatest(0, duration * ([0.01, 0.10, 0.30, 0.50, 0.70, 0.90, 0.98]::double[])[probe] - 4), 6) as start from p
""")
def probe_positions(spark, d):
    return _six(rp.probe_positions(_media(views.segments(spark, d)), 8.0), "start")


@register(f"""
with {views.SEGMENTS}, k as (select *, row_number() over (partition by media_id order by start, "end", pos) as n from segments where "end" - start >= 0.5)
select media_id, pos from k where n <= 3
""")
def first_regions(spark, d):
    return rp.first_regions(views.segments(spark, d), 3).select("media_id", "pos")


@register("select doc_id from documents where contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'the') and lang = 'en'")
def searched_history(spark, d):
    rows = views.table(spark, d, "documents").select("doc_id", F.col("text").alias("title"), "source", F.col("lang").alias("status"))
    return rp.search(rows, " The ", "en").select("doc_id")


@register("""
select page_id, row_number() over (partition by split_part(url, '/', 3) order by case when contains(html, '<p') then 0 else 1 end, lower(url), page_id) as place from pages
""")
def ordered_assets(spark, d):
    p = views.table(spark, d, "pages").withColumn("filename", F.col("url"))
    by = Window.partitionBy(F.split_part("url", F.lit("/"), F.lit(3))).orderBy(*rp.asset_order(F.contains("html", F.lit("<p"))), "page_id")
    return p.select("page_id", F.row_number().over(by).cast("long").alias("place"))


@register("""
select event_id, row_number() over (partition by user_id order by case when event_type = 'view' and value > 10 then 0 else 1 end, case when event_type = 'view' then 0 else 1 end,
  case when value >= 5 then cast(floor(value) as bigint) else 1000000 end, case when event_id >= 0 then event_id else 1000000 end) as place
from events where value is not null
""")
def ordered_tabs(spark, d):
    e = views.table(spark, d, "events").where("value is not null")
    tabs = e.select("event_id", "user_id", (F.col("event_type") == "view").alias("front"), (F.col("value") > 10).alias("active"), F.when(F.col("value") >= 5, F.floor("value")).otherwise(-1).alias("window_no"), F.col("event_id").alias("tab_no"))
    return tabs.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*rp.tab_order())).cast("long").alias("place"))


@register("""
with c as (select doc_id, lang, source, case when source is null then 'web' else source end as found from documents)
select doc_id from c where lang is not distinct from case when found = 'web' then 'en' else lang end and doc_id in (select doc_id from labels where quality = 1)
""")
def usable_caches(spark, d):
    docs_ = views.table(spark, d, "documents")
    found = F.coalesce("source", F.lit("web"))
    caches = docs_.select("doc_id", F.struct("lang", found.alias("backend")).alias("signature"))
    wanted = docs_.select("doc_id", F.struct(F.when(found == "web", "en").otherwise(F.col("lang")).alias("lang"), found.alias("backend")).alias("signature"))
    quality = views.table(spark, d, "labels").select("doc_id", (F.col("quality") + 1).alias("schema_version"), F.lit("v1").alias("pipeline_version"))
    return rp.usable_caches(caches, wanted, quality, "v1", ["doc_id"]).select("doc_id")


@register("""
select conv_id, turn from conversations c
where not (coalesce(role, '') in ('assistant') or coalesce(role, '') like 'sys%') or not exists (select 1 from conversations r where r.conv_id = c.conv_id and length(r.text) > 150)
""")
def without_derived(spark, d):
    c = views.table(spark, d, "conversations")
    return rp.without_derived(c, c.where("length(text) > 150"), ["assistant", "sys%"], ["conv_id"], "role").select("conv_id", "turn")


@register("select page_id, substr(sha256(coalesce(url, '') || cast(page_id as varchar) || 'v1'), 1, 24) as digest from pages")
def cache_digests(spark, d):
    return views.table(spark, d, "pages").select("page_id", rp.digest(F.col("url"), F.col("page_id"), F.lit("v1")).alias("digest"))


@register(f"""
with {views.SEGMENTS},
rows_ as (select media_id, '## [' || format('{{:02d}}:{{:02d}}:{{:02d}}', cast(floor(start) as bigint) // 3600, cast(floor(start) as bigint) % 3600 // 60, cast(floor(start) as bigint) % 60) || '] at ' || pos || chr(10) ||
  case when length(text) > 100 then chr(10) || text || chr(10) else '' end as line, start, pos from segments)
select media_id, md5('# Chapters' || chr(10) || chr(10) || rtrim(string_agg(line, chr(10) order by start, 'at ' || pos), ' ' || chr(9) || chr(10) || chr(13)) || chr(10)) as document from rows_ group by media_id
""")
def chapter_documents(spark, d):
    rows = views.segments(spark, d).select("media_id", "start", F.concat(F.lit("at "), F.col("pos").cast("string")).alias("title"), F.when(F.length("text") > 100, F.col("text")).alias("description"))
    return docs.chapters_markdown(rows, "Chapters").select("media_id", F.md5("document").alias("document"))


@register("select doc_id, md5(coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')) as body from documents")
def transcript_documents(spark, d):
    rows = views.table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    document = docs.transcript_markdown(F.col("doc_id").cast("string"), {"Source": F.col("source"), "Model": F.lit("a`b")}, F.array(text))
    return rows.select("doc_id", F.md5(docs.body(document)).alias("body"))


@register("""
with t as (select conv_id, turn, case when turn = 0 then '- **' else '    - **' end || coalesce(nullif(role, ''), cast(turn as varchar)) || '** ·  · 0 likes · rpid `' || turn || '`' || chr(10) ||
  case when turn = 0 then '  ' else '    ' end || replace(coalesce(text, ''), chr(10), chr(10) || case when turn = 0 then '  ' else '    ' end) || chr(10) as line from conversations)
select conv_id, md5('# talk' || chr(10) || chr(10) || '- BVID: `b`' || chr(10) || '- AID: `' || conv_id || '`' || chr(10) || '- Source comments: `' || count(*) || '`' || chr(10) || '- Exported comments: `' || count(*) || '`' || chr(10) || chr(10) ||
  string_agg(line, chr(10) order by turn)) as document from t group by conv_id
""")
def comment_documents(spark, d):
    c = views.table(spark, d, "conversations")
    rows = c.select("conv_id", F.col("turn").alias("index"), F.when(F.col("turn") == 0, 0).otherwise(1).alias("depth"), F.col("role").alias("author_name"), F.col("turn").alias("author_mid"), F.lit("").alias("send_datetime"), F.lit(0).alias("like"), F.col("turn").alias("rpid"), F.col("text").alias("message"))
    heads = c.groupBy("conv_id").agg(F.lit("talk").alias("title"), F.lit("b").alias("bvid"), F.count(F.lit(1)).alias("comments"))
    return docs.comments_markdown(rows, heads, "conv_id").select("conv_id", F.md5("document").alias("document"))
