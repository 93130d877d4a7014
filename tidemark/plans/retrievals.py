"""Queries over retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from . import views
from .registry import register

SENTENCES = r"""
cut as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.。！？!?]+[」』”’）)]*)', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(s, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda s: s <> '') as ss from documents),
sent as (select doc_id, cast(i as int) as pos, ss[i + 1] as sentence from (select doc_id, ss, unnest(range(0, len(ss))) as i from cut))
"""
WINDOWS = """
counts as (select doc_id, max(pos) + 1 as n from sent group by doc_id),
wins as (select doc_id, n, unnest(range(0, cast(ceil(greatest(0, n - 8) / 6.0) as bigint) + 1)) as win from counts),
spans as (select doc_id, cast(win as int) as win, cast(win * 6 as int) as first, cast(least(n, win * 6 + 8) as int) as last from wins)
"""
TERMS = f"""
toks as (
  select s.doc_id, s.win, lower(t) as token from (select sp.doc_id, sp.win, unnest(regexp_extract_all(se.sentence, '([A-Za-z0-9_]+|[一-鿿]{{2,}})', 1)) as t from spans sp join sent se on se.doc_id = sp.doc_id and se.pos >= sp.first and se.pos < sp.last) s
  where length(t) >= 2 and lower(t) not in ({', '.join(f"'{w}'" for w in rt.STOP_WORDS)})),
tf as (select doc_id, win, token, count(*) as tf from toks group by doc_id, win, token),
dfs as (select doc_id, token, count(*) as df from tf group by doc_id, token),
totals as (select doc_id, count(*) as n_units from spans group by doc_id),
w0 as (select tf.doc_id, win, tf.token, tf, tf * (ln((1 + n_units) / (1 + df)) + 1) as weight from tf join dfs using (doc_id, token) join totals using (doc_id))
"""


def _sentences(spark, d):
    """Texts are dealt before they are cut: they travel once, whole."""
    return rt.sentences(views.table(spark, d, "documents").repartition("doc_id"))


def _lists(spark, d):
    return rt.sentence_lists(views.table(spark, d, "documents"))


@register(f"with {SENTENCES} select doc_id, pos, sentence from sent")
def sentence_units(spark, d):
    return rt.sentences(views.table(spark, d, "documents"))


@register(f"with {SENTENCES}, {WINDOWS} select doc_id, win as \"window\", first, last from spans")
def sentence_windows(spark, d):
    w = rt.windows(rt.sentences(views.table(spark, d, "documents")), 8, 2)
    return w.select("doc_id", "window", "first", "last")


def _centrality_sql(weights: str) -> str:
    return f"""
with {SENTENCES}, {WINDOWS}, {TERMS}, {weights},
centre as (select doc_id, token, sum(weight) / any_value(n_units) as c from w join totals using (doc_id) group by doc_id, token),
size as (select doc_id, sqrt(sum(c * c)) as cn from centre group by doc_id),
dot as (select w.doc_id, win, sum(weight * c) as dot, sqrt(sum(weight * weight)) as un from w join centre using (doc_id, token) group by w.doc_id, win)
select doc_id, win as "window", round(dot / (un * cn), 6) as score from dot join size using (doc_id)
"""


@register(_centrality_sql("w as (select * from w0)"))
def tfidf_centrality(spark, d):
    got = rt.centrality(_lists(spark, d), 8, 2)
    return got.select("doc_id", "window", F.round("score", 6).alias("score"))


@register(_centrality_sql("w as (select doc_id, win, token, tf, weight / sqrt(sum(weight * weight) over (partition by doc_id, win)) as weight from w0)"))
def tfidf_centrality_unit_length(spark, d):
    got = rt.centrality(_lists(spark, d), 8, 2, unit_length=True)
    return got.select("doc_id", "window", F.round("score", 6).alias("score"))


@register(f"""
with {SENTENCES}, {WINDOWS}, {TERMS},
r as (select *, row_number() over (partition by doc_id, win order by weight desc, tf desc, token desc) as k from w0)
select doc_id, win as "window", string_agg(token, ' ' order by k) as keywords from r where k <= 8 group by doc_id, win
""")
def top_keywords(spark, d):
    return rt.top_keywords(_lists(spark, d), 8, 2, 8).select("doc_id", "window", F.array_join("keywords", " ").alias("keywords"))


@register("""
with m as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where embedding is not null),
u as (select vec_id, label, unnest(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))) as x, generate_subscripts(v, 1) as i from m),
c as (select label, i, avg(x) as c from u group by label, i),
s as (select label, sqrt(sum(c * c)) as cn from c group by label)
select label, vec_id, round(sum(x * c) / any_value(cn), 6) as score from u join c using (label, i) join s using (label) group by label, vec_id
""")
def vector_centrality(spark, d):
    return rt.vector_centrality(views.table(spark, d, "embeddings")).select("label", "vec_id", F.round("score", 6).alias("score"))


@register("""
with s as (select l_suppkey as k, l_partkey as unit, sum(l_quantity) as a, max(l_discount) as b from lineitem group by 1, 2),
r as (select *, row_number() over (partition by k order by a desc, unit) as ra, row_number() over (partition by k order by b desc, unit) as rb from s)
select k, unit, round(1.0 / (60 + ra) + 1.0 / (60 + rb), 9) as fused from r
""")
def rank_fusion(spark, d):
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("unit")).agg(F.sum("l_quantity").alias("a"), F.max("l_discount").alias("b"))
    return rt.rank_fusion(rows, ["a", "b"], key="k", order="unit").select("k", "unit", F.round("fused", 9).alias("fused"))


@register(f"""
with {SENTENCES}, {WINDOWS},
t as (select sp.doc_id, sp.win, sp.first, lower(string_agg(se.sentence, ' ' order by se.pos)) as text from spans sp join sent se on se.doc_id = sp.doc_id and se.pos >= sp.first and se.pos < sp.last group by all),
s as (select *, (length(text) - length(replace(text, 'tion', ''))) // 4 + (length(text) - length(replace(text, 'eau', ''))) // 3 as score from t),
r as (select *, row_number() over (partition by doc_id order by score desc, first desc) as rank from s where score > 0)
select doc_id, win as "window", cast(score as bigint) as score, cast(rank as int) as rank from r where rank <= 4
""")
def keyword_search(spark, d):
    s = _sentences(spark, d)
    units = rt.in_windows(s, 8, 2).groupBy("doc_id", "window", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    got = rt.keyword_search(units, "tion eau")
    return got.select("doc_id", "window", F.col("score").cast("long").alias("score"), "rank")


@register("""
with u as (select o_custkey as doc_id, ['sentence', 'paragraph', 'topic'][o_orderkey % 3 + 1] as level, o_orderkey as first, o_totalprice as fused from orders),
a as (select *, row_number() over (partition by doc_id, level order by fused desc, first) as r, case level when 'sentence' then 0 when 'paragraph' then 1 else 2 end as o from u),
b as (select *, r <= 4 as inside from a),
c as (select *, row_number() over (partition by doc_id, inside order by fused desc, o, first) as rest from b),
e as (select *, row_number() over (partition by doc_id order by inside desc, case when inside then o end nulls first, case when inside then r end nulls first, rest) as place from c)
select doc_id, level, first from e where place <= 6
""")
def budgeted_evidence(spark, d):
    level = F.element_at(F.array(*map(F.lit, ("sentence", "paragraph", "topic"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    units = views.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), level.alias("level"), F.col("o_orderkey").alias("first"), F.col("o_totalprice").alias("fused"))
    return rt.evidence(units, 6).select("doc_id", "level", "first")
