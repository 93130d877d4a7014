"""Documents written from the turns and read again, each reader with its DuckDB twin over what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import threads as th
from ..sources import documents as docs
from ..sources import reports, sinks, subtitles
from . import views
from .registry import register

LETTERS = """trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"""

CLEAN = f"""
{views.SEGMENTS},
clean as (select media_id, pos, start, "end", {LETTERS} as text, cast(row_number() over (partition by media_id order by pos) - 1 as int) as place from segments),
kept as (select media_id, cast(row_number() over (partition by media_id order by pos) - 1 as int) as pos, start, "end", text from clean where text <> '')
"""


def _clean(spark, d):
    return views.segments(spark, d).withColumn("text", F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))


def _written(rows, line, separator="\n"):
    """(path, content): the lines of each media in order of pos."""
    listed = F.array_sort(F.collect_list(F.struct("pos", line.alias("x"))))
    return rows.groupBy(F.col("media_id").alias("path")).agg(F.array_join(F.transform(listed, lambda r: r["x"]), separator).alias("content"))


def _named(df):
    return df.select(F.col("media_id").alias("path"), F.col("document").alias("content"))


def _told(df):
    return df.select(F.col("path").alias("media_id"), "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@register(f'with {CLEAN} select media_id, pos, round(start, 3) as start, round("end", 3) as "end", text from kept')
def srt_rows(spark, d):
    return _told(subtitles.srt(_named(sinks.srt_documents(_clean(spark, d)))))


@register(f"""with {CLEAN} select media_id, pos, round(start, 3) as start, round("end", 3) as "end", text || ' & so on' as text from kept""")
def vtt_rows(spark, d):
    stamp = lambda c: F.translate(tx.srt_time(F.col(c)), ",", ".")
    block = F.concat(stamp("start"), F.lit(" --> "), stamp("end"), F.lit(" align:start\n<b>"), F.col("text"), F.lit("</b> &amp; so on\n"))
    rows = _written(_clean(spark, d).where("text <> ''"), block)
    return _told(subtitles.vtt(rows.withColumn("content", F.concat(F.lit("WEBVTT - made here\n\n"), "content"))))


@register(f'with {CLEAN} select media_id, pos, pos::double as start, pos + 1.0::double as "end", text from kept')
def plain_rows(spark, d):
    return _told(subtitles.plain(_named(sinks.text_documents(_clean(spark, d)))))


@register(f'with {CLEAN} select media_id, pos, round(start, 3) as start, round("end", 3) as "end", text from kept')
def bracketed_rows(spark, d):
    line = F.format_string("[%.3f - %.3f] <|en|>%s", "start", "end", "text")
    return _told(subtitles.bracketed(_written(_clean(spark, d).where("text <> ''"), line)))


@register(f'with {CLEAN} select media_id, place as pos, round(start, 3) as start, round("end", 3) as "end", text from clean where text <> \'\'')
def report_segments(spark, d):
    return _told(reports.segments(reports.parsed(_named(sinks.json_documents(_clean(spark, d))))))


WORDS = f"""
{CLEAN},
split_ as (select media_id, place, start, string_split(text, ' ') as w from clean where text <> ''),
words as (select media_id, place, unnest(w) as text, unnest(range(0, len(w))) as i, start from split_)
"""


def _words(spark, d):
    """A JSON report a media: segments with their words, a second each."""
    word = lambda s: F.transform(F.filter(F.split(F.col("text"), " "), lambda w: w != ""), lambda w, i: F.struct((F.col("start") + i).alias("start"), (F.col("start") + i + 1).alias("end"), w.alias("word"), (F.length(w) / 64).alias("probability")))
    segment = F.struct("start", "end", "text", word("text").alias("words"))
    rows = F.array_sort(F.collect_list(F.struct("pos", segment.alias("s"))))
    listed = _clean(spark, d).groupBy(F.col("media_id").alias("path")).agg(F.transform(rows, lambda r: r["s"]).alias("segments"))
    return listed.select("path", F.to_json(F.struct(F.lit(2).alias("schema_version"), "segments")).alias("content"))


@register(f"""
with {WORDS}
select media_id, cast(row_number() over (partition by media_id order by place, i) - 1 as int) as pos, round(start + i, 3) as start, round(start + i + 1, 3) as "end", text, length(text) / 64 as probability from words
""")
def report_words(spark, d):
    rows = reports.words(reports.parsed(_words(spark, d)))
    return _told(rows).join(rows.select(F.col("path").alias("media_id"), "pos", "probability"), ["media_id", "pos"])


@register(f"""
with {WORDS}
select media_id, place as sentence, cast(i as int) as pos, text, i::double as start, case when length(text) > 2 then i + 1.0 else i + 0.5 end::double as "end", case when length(text) > 2 then 0.75 else 0.5 end::double as probability from words
""")
def sub_word_rows(spark, d):
    token = lambda s, e, t, c: F.struct(s.cast("double").alias("start"), e.cast("double").alias("end"), t.alias("text"), F.lit(c).alias("confidence"))
    cut = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w, i: F.array(token(i, i + 0.5, F.concat(F.lit(" "), F.substring(w, 1, 2)), 0.5), token(i + 0.5, i + 1, F.substring(w, F.lit(3), F.length(w)), 1.0)))
    tokens = F.filter(F.flatten(cut), lambda t: t["text"] != "")
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), "text", tokens.alias("tokens")).alias("s"))))
    made = _clean(spark, d).groupBy(F.col("media_id").alias("path")).agg(F.to_json(F.struct(F.transform(rows, lambda r: r["s"]).alias("sentences"))).alias("content"))
    return reports.sub_words(made).select(F.col("path").alias("media_id"), "sentence", "pos", "text", "start", "end", "probability")


@register(f"""
with {CLEAN}
select media_id, round(start, 3) as start, text as title, case when length(text) > 100 then 'long' else '' end as description from kept
""")
def chapter_rows(spark, d):
    rows = _clean(spark, d).select("media_id", "start", F.col("text").alias("title"), F.when(F.length("text") > 100, "long").alias("description"))
    fenced = docs.chapters_json(rows).select(F.col("media_id").alias("path"), F.concat(F.lit("Here they are:\n```json\n"), "document", F.lit("\n```\n")).alias("content"))
    return reports.chapters(fenced).select(F.col("path").alias("media_id"), F.round("start", 3).alias("start"), "title", "description")


@register(f"""
with {CLEAN}
select media_id, cast(pos * 2 + 1 as int) as pos, round(start, 3) as start, round("end", 3) as "end" from kept
""")
def silence_rows(spark, d):
    line = F.format_string("[detector] silence_start: %.3f\n[detector] silence_end: %.3f | silence_duration: 1", "start", "end")
    rows = _written(_clean(spark, d).where("text <> ''"), line).withColumn("duration", F.lit(1e6))
    return subtitles.silence_log(rows).select(F.col("path").alias("media_id"), "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register(f'with {CLEAN} select media_id, round(start, 3) as start, round("end", 3) as "end" from clean where "end" > start')
def voice_rows(spark, d):
    listed = F.sort_array(F.collect_list(F.struct("start", "end")))
    made = _clean(spark, d).groupBy(F.col("media_id").alias("path")).agg(F.to_json(F.struct(F.struct(listed.alias("VAD")).alias("tiers"))).alias("content"))
    return reports.voice_regions(made).select(F.col("path").alias("media_id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@register("""
select conv_id, turn, case when turn > 0 then 'r' || conv_id else 'r' || conv_id || '-' || turn end as root_rpid, case when turn > 0 then cast(turn - 1 as varchar) else '' end as parent_rpid, 'r' || conv_id || '-' || turn as rpid,
  case when coalesce(role, '') = '' then '' else 'm' || length(role) end as author_mid, coalesce(role, '') as author_name, turn as "like", length(coalesce(text, '')) as reply_count,
  strftime(make_timestamp((1700000000 + turn * 86400 + 8 * 3600) * 1000000), '%Y-%m-%d') as send_date from conversations
""")
def reply_rows(spark, d):
    c = views.table(spark, d, "conversations")
    name = F.coalesce("role", F.lit(""))
    rpid = F.format_string("r%d-%d", "conv_id", "turn")
    reply = F.struct(
        rpid.alias("rpid_str"), F.when(F.col("turn") > 0, F.col("turn") - 1).cast("string").alias("parent"), (F.lit(1700000000) + F.col("turn") * 86400).alias("ctime"), F.col("turn").alias("like"),
        F.length(F.coalesce("text", F.lit(""))).alias("count"), F.struct(F.when(name != "", F.concat(F.lit("m"), F.length(name))).alias("mid"), "role").alias("member"))
    json = F.regexp_replace(F.to_json(reply), '"role":', '"uname":')
    rows = c.select("conv_id", "turn", F.when(F.col("turn") > 0, F.format_string("r%d", "conv_id")).otherwise("").alias("root"), json.alias("content"))
    return th.comment_rows(rows, "root").select("conv_id", "turn", "root_rpid", "parent_rpid", "rpid", "author_mid", "author_name", "like", "reply_count", "send_date")


@register("""
with c as (select doc_id, case when contains(text, '{') and instr(text, '{') < length(text) - instr(reverse(text), '}') + 1 and contains(text, '}') then
  substr(text, instr(text, '{'), length(text) - instr(reverse(text), '}') + 2 - instr(text, '{')) else text end as body from (select doc_id, 'so {"terms": ["' || doc_id || '"]} it is' as text from documents))
select doc_id, md5(body) as body from c
""")
def outer_objects(spark, d):
    rows = views.table(spark, d, "documents")
    text = F.concat(F.lit("<think>so {\"terms\": [\""), F.col("doc_id").cast("string"), F.lit("\"]} it</think> is"))
    return rows.select("doc_id", F.md5(tx.outer_object(text)).alias("body"))


@register(f"""
with {views.SEGMENTS}, k as (select *, row_number() over (partition by media_id order by pos) as n from segments)
select media_id, md5(string_agg('[evidence ' || n || ' ' || format('{{:02d}}:{{:02d}}', cast(floor(start) as bigint) // 60, cast(floor(start) as bigint) % 60) || '-' || format('{{:02d}}:{{:02d}}', cast(floor("end") as bigint) // 60, cast(floor("end") as bigint) % 60) || '] ' || text, chr(10) order by n)) as context
from k group by media_id
""")
def evidence_lines(spark, d):
    s = views.segments(spark, d)
    return docs.evidence_lines(s, "evidence ").select("media_id", F.md5("document").alias("context"))
