"""Queries over text, URL and timing functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from . import views
from .registry import register

#: A few literal video URLs beside the pages' own.
VIDEO_URLS = [
    (-1, "https://youtu.be/abc123?t=4"), (-2, " https://www.youtube.com/watch?list=x&v=Q_w-1 "), (-3, "https://m.youtube.com/shorts/zz9/"),
    (-4, "https://www.bilibili.com/video/BV1xx411c7mD/?p=3&spm=1"), (-5, "https://www.bilibili.com/video/BV1xx411c7mD"), (-6, "https://www.youtube.com/live/L1?x=1"),
    (-7, "https://netflix.com/title/1"), (-8, "ftp://x.com/a"), (-9, "https://x.com/a"), (-10, "https://www.youtube.com/"),
]
_VALUES = ", ".join(f"({i}, '{u}')" for i, u in VIDEO_URLS)
URLS = f"""
urls as (select page_id, url from pages where url is not null union all select * from (values {_VALUES}) v(page_id, url)),
parts as (
  select page_id, trim(url) as u, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as h,
    regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as p, regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) as q from urls),
ids as (
  select *, regexp_extract(p, '/video/([^/?#]+)', 1) as bv, regexp_extract(q, '(?:^|&)p=([^&]+)', 1) as pg, regexp_extract(q, '(?:^|&)v=([^&]+)', 1) as v,
    regexp_extract(p, '^/(?:shorts|live)/([^/?#]+)', 1) as listed, split_part(regexp_replace(p, '^/+', ''), '/', 1) as short from parts),
videos as (select *, case when h in ('youtu.be', 'www.youtu.be') then short when contains(h, 'youtube.com') then case when v <> '' then v else listed end else '' end as video from ids),
canon as (
  select page_id, u, h, case when contains(h, 'bilibili.com') and bv <> '' then 'https://www.bilibili.com/video/' || bv || case when pg <> '' then '?p=' || pg else '' end
    when video <> '' then 'https://www.youtube.com/watch?v=' || video else u end as canonical from videos)
"""


def _urls(spark, d):
    pages = views.table(spark, d, "pages").where("url is not null").select(F.col("page_id").cast("long").alias("page_id"), "url")
    return pages.unionByName(spark.createDataFrame(VIDEO_URLS, "page_id long, url string"))


@register(f"with {URLS} select page_id, canonical, substr(sha256('[\"' || canonical || '\", \"b\"]'), 1, 24) as slug from canon")
def canonical_urls(spark, d):
    c = urls.canonical(F.col("url"))
    return _urls(spark, d).select("page_id", c.alias("canonical"), urls.slug(c, F.lit("b")).alias("slug"))


def _on(col, hosts):
    return " or ".join(f"{col} = '{h}' or ends_with({col}, '.{h}')" for h in hosts)


@register(f"""
with {URLS}
select page_id, case when not regexp_matches(u, '^https?://') then 'scheme' when {_on('h', urls.REFUSED_HOSTS)} then 'host' end as refusal,
  ({_on('h', urls.MEDIA_HOSTS)}) or regexp_matches(lower(u), '\\.(mp3|mp4|wav|flac|m4a|webm)(\\?|#|$)|/(watch|video|play)') as likely from canon
""")
def url_rules(spark, d):
    u = F.trim("url")
    return _urls(spark, d).select("page_id", urls.refusal(F.col("url")).alias("refusal"), urls.likely_media(u).alias("likely"))


@register(f"""
with {URLS} select page_id, case when regexp_matches(u, '^https?://') then 'url:' || canonical else 'file:' || u end as source_key,
  case when starts_with(u, 'https://') then 'https://mirror/' || substr(u, 9) else u end as rebased from canon
""")
def source_keys(spark, d):
    u = F.trim("url")
    return _urls(spark, d).select("page_id", urls.source_key(F.col("url")).alias("source_key"), urls.rebased(u, [("https:/", "https://mirror")]).alias("rebased"))


DOC = "coalesce(text, '')"
SPACES = r"[ \t\n\x0B\f\r]+"


@register(f"""
select doc_id, length(regexp_replace({DOC}, '{SPACES}', '', 'g')) as compact_length, md5(lower(regexp_replace({DOC}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) as letters,
  md5(regexp_replace(lower({DOC}), '[^0-9a-z㐀-鿿]+', '', 'g')) as plain, md5(trim(regexp_replace({DOC}, '{SPACES}', ' ', 'g'))) as spaced,
  regexp_matches(trim({DOC}), '^[(\\[（【][^)\\]）】]{{1,24}}[)\\]）】]$') as is_label,
  (length({DOC}) - length(replace({DOC}, '(', '')) <> length({DOC}) - length(replace({DOC}, ')', ''))) or (length({DOC}) - length(replace({DOC}, '[', '')) <> length({DOC}) - length(replace({DOC}, ']', '')))
    or (length({DOC}) - length(replace({DOC}, '“', '')) <> length({DOC}) - length(replace({DOC}, '”', ''))) as unbalanced
from documents
""")
def text_shapes(spark, d):
    t = F.coalesce("text", F.lit(""))
    return views.table(spark, d, "documents").select(
        "doc_id", tx.compact_length(t).cast("long").alias("compact_length"), F.md5(tx.letters_and_digits(t)).alias("letters"), F.md5(tx.ascii_and_ideographs(t)).alias("plain"),
        F.md5(tx.single_spaced(t)).alias("spaced"), tx.is_event_label(t).alias("is_label"), tx.unbalanced_wrappers(t).alias("unbalanced"),
    )


@register(f"""
with {views.SEGMENTS}, t as (select media_id, pos, start, cast(round_even(start * 1000, 0) as bigint) as ms, cast(round_even(start, 0) as bigint) as s from segments)
select media_id, pos, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as srt,
  case when s >= 3600 then printf('%02d:', s // 3600) else '' end || printf('%02d:%02d', s % 3600 // 60, s % 60) as clock, round(ms / 1000.0::double, 3) as back from t
""")
def time_stamps(spark, d):
    s = views.segments(spark, d)
    stamp = tx.srt_time(F.col("start"))
    return s.select("media_id", "pos", stamp.alias("srt"), tx.clock(F.col("start")).alias("clock"), F.round(tx.srt_seconds(stamp), 3).alias("back"))


@register(f"""
with c as (select doc_id, trim(regexp_replace({DOC}, '{SPACES}', ' ', 'g')) as flat from documents),
p as (select doc_id, length(flat) as n, list_filter(regexp_split_to_array(flat, '[，,。！？!?；;、 ]+'), lambda x: x <> '') as parts from c),
e as (select doc_id, n, len(parts) as total, unnest(parts) as phrase, generate_subscripts(parts, 1) as i from p where n >= 160 and len(parts) >= 12),
k as (select doc_id, any_value(total) as total, phrase, count(*) as hits, min(i) as at_ from e group by doc_id, phrase),
r as (select *, row_number() over (partition by doc_id order by hits desc, at_) as k from k)
select doc_id, phrase, cast(hits as int) as hits, cast(total as int) as parts from r where k = 1 and length(phrase) <= 24 and hits >= 8 and hits / total >= 0.6
""")
def dominant_phrases(spark, d):
    table = views.table(spark, d, "documents")
    own = lambda rows: _phrase_parts(rows).transform(_in_the_middle)
    # Rows of one doc_id are one document; that is seen by the ids alone.
    again = table.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return own(table)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return own(table.join(again, same, "left_anti")).unionByName(_counted(_phrase_parts(table.join(again, same, "left_semi"))))


def _phrase_parts(docs):
    flat = tx.single_spaced(F.coalesce("text", F.lit("")))
    parts = F.filter(F.split("flat", r"[，,。！？!?；;、\s]+"), lambda x: x != "")
    docs = docs.select("doc_id", flat.alias("flat")).where(F.length("flat") >= 160)
    return docs.select("doc_id", F.explode(F.array(parts)).alias("parts")).where(F.size("parts") >= 12)  # explode: parts are made once


def _in_the_middle(docs):
    """A phrase that has 0.6 of a document's parts stands in the middle of them, sorted; no part leaves its row."""
    n = F.size("parts")
    middle = F.get(F.sort_array("parts"), (n / 2).cast("int"))
    rows = docs.select("doc_id", "parts", F.explode(F.array(middle)).alias("phrase"))
    rows = rows.select("doc_id", "phrase", (n - F.size(F.array_remove("parts", F.col("phrase")))).alias("hits"), n.alias("parts"))
    return _dominant(rows)


def _counted(docs):
    rows = docs.select("doc_id", F.size("parts").alias("total"), F.posexplode("parts").alias("i", "phrase"))
    counts = rows.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).cast("int").alias("hits"), F.min("i").alias("first"), F.max("total").alias("parts"))
    top = counts.groupBy("doc_id").agg(F.max_by(F.struct("phrase", "hits", "parts"), F.struct("hits", -F.col("first"))).alias("t")).select("doc_id", "t.*")
    return _dominant(top)


def _dominant(rows):
    return rows.where((F.length("phrase") <= 24) & (F.col("hits") >= 8) & (F.col("hits") / F.col("parts") >= 0.6))


@register("select page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as plain from pages")
def html_text(spark, d):
    return views.table(spark, d, "pages").select("page_id", tx.single_spaced(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]+>", " ")).alias("plain"))


@register(r"""
with c as (select conv_id, string_agg((turn + 1) || ': ' || replace(coalesce(text, ''), chr(10), ' '), chr(10) order by turn) as reply, count(*) as n from conversations group by conv_id)
select c.conv_id, cast(turn as int) as line, trim(replace(coalesce(text, ''), chr(10), ' ')) as text from c join conversations v using (conv_id)
""")
def numbered_reply_lines(spark, d):
    turns = views.table(spark, d, "conversations").select("conv_id", "turn", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("text"))
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(": "), F.col("text"))
    reply = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("reply"), F.count(F.lit(1)).alias("n"))
    return reply.select("conv_id", F.explode(tx.numbered_lines(F.col("reply"), F.col("n"))).alias("line", "text"))


@register("select p_partkey, levenshtein(p_name, p_type) as distance, least(6, levenshtein(p_name, p_type)) as bounded from part")
def edit_distances(spark, d):
    bounded = F.levenshtein("p_name", "p_type", 5)
    rows = views.table(spark, d, "part")
    return rows.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.when(bounded < 0, 6).otherwise(bounded).cast("long").alias("bounded"))


#: Rules that name terms: keyword in the title, terms to give.
TERM_RULES = [("ring", "item,round"), ("red", "colour,warm"), ("widget", "item,generic")]
_RULES = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TERM_RULES))


@register(f"""
with rules as (select * from (values {_RULES}) r(i, word, terms)),
hit as (select p_partkey, i, unnest(string_split(terms, ',')) as term, generate_subscripts(string_split(terms, ','), 1) as j from part join rules on contains(lower(p_name), word)),
first as (select p_partkey, term, min(i * 100 + j) as k from hit group by p_partkey, term)
select p_partkey, string_agg(term, ',' order by k) as terms from first group by p_partkey
""")
def term_rules(spark, d):
    rules = F.broadcast(spark.createDataFrame([(i, k, t.split(",")) for i, (k, t) in enumerate(TERM_RULES)], "i int, word string, terms array<string>"))
    part = views.table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    hit = part.join(rules, F.contains(F.col("name"), F.col("word")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "terms"))), lambda x: x["terms"])
    return hit.groupBy("p_partkey").agg(F.array_join(F.array_distinct(F.flatten(listed)), ",").alias("terms"))
