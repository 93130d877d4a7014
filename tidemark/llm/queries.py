"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embed_dedup, line_dedup, minhash, pii, spelling, substring_dedup, telephony, token_alignment, token_counts, toxicity, url_filter
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Rules of the contract: (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "block_odds")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, threshold=(80, 100))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark_words(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), definition, public_tokenizers.PATTERN, 512)


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("spans"), pii.BASE), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), (F.size("spans").cast("long") - sum(pii.count_of(F.col("spans"), kind) for kind in pii.BASE)).alias("n_added"), F.size("spans").cast("long").alias("n_total"))


@query
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return token_alignment.Alignment(read_table(spark, sf_dir, "documents"), definition, public_tokenizers.PATTERN, model).documents()


@query
def op12_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telephony.read_back(telephony.stored(read_table(spark, sf_dir, "documents")), carried=("doc_id", "n_bytes"))
    size = lambda name: F.octet_length(name).cast("long")
    tail = F.crc32(F.expr("substring(payload, -32, 32)"))
    return found.select("doc_id", "n_bytes", size("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), size("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", size("pcm").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read_table(spark, sf_dir, "documents"))


ORACLES["op2_substring_dedup"] = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
windows as (
  select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as win
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
lows as (select win, min(doc_id) as low from windows group by win),
gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p
  from (select doc_id, i from windows join lows using (win) where low < doc_id)),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from words),
kept as (
  select doc_id, string_agg(w[p], ' ' order by p) as kept, count(*) as n
  from (select places.doc_id, places.w, places.p from places anti join gone on places.doc_id = gone.doc_id and places.p = gone.p)
  group by doc_id)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from words left join kept using (doc_id)
"""

ORACLES["op4_line_dedup"] = r"""
with docs as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
hashed as (select doc_id, text, lines, list_transform(lines, lambda l: cast('0x' || substr(md5(l), 1, 7) as bigint)) as hs from docs),
marked as (
  select doc_id, lines, i, i = len(lines) or (hs[i] + 33 * case when i > 1 then hs[i - 1] else 0 end) % 4 = 0 as is_end
  from (select doc_id, lines, hs, unnest(range(1, len(lines) + 1)) as i from hashed)),
placed as (select doc_id, lines[i] as line, i, coalesce(sum(cast(is_end as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as place from marked),
chunks as (select doc_id, place, string_agg(line, chr(10) order by i) as chunk, count(*) as n, sum(cast(regexp_matches(line, '[^ \t\n\x0B\f\r]') as int)) as full_lines from placed group by doc_id, place),
ranked as (select doc_id, place, n, row_number() over (partition by chunk order by doc_id, place) as k from chunks where full_lines >= 2),
gone as (select doc_id, place, n from ranked where k > 1),
removed as (select doc_id, sum(n) as n from gone group by doc_id),
kept as (select chunks.doc_id, string_agg(chunk, chr(10) order by chunks.place) as kept from chunks anti join gone on chunks.doc_id = gone.doc_id and chunks.place = gone.place group by chunks.doc_id)
select docs.doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(coalesce(n, 0) as bigint) as n_removed,
  case when text is not null then sha256(coalesce(kept, '')) end as kept_sha256
from docs left join removed using (doc_id) left join kept using (doc_id)
"""

ORACLES["op5_minhash"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 80 * (x.n + y.n - n_both)),
edges as (select a, b from links union all select b, a from links),
reached as (select a as doc_id, b as other from edges union select reached.doc_id, edges.b from reached join edges on reached.other = edges.a),
lows as (select doc_id, min(other) as low from reached group by doc_id)
select words.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(words.doc_id, coalesce(low, words.doc_id)) as component_id, words.doc_id <= coalesce(low, words.doc_id) as kept
from words left join sizes using (doc_id) left join lows using (doc_id)
"""

ORACLES["op6_decontaminate"] = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents),
items as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from benchmark),
windows as (
  select distinct item_id, least(13, len(w)) as n, list_slice(w, i, i + least(13, len(w)) - 1) as win
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct n from windows),
spots as (
  select doc_id, n, i, list_slice(w, i, i + n - 1) as win
  from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)),
found as (select doc_id, i, spots.n as n, item_id from spots join windows on spots.win = windows.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct doc_id, cast(item_id as varchar) as name from found) group by doc_id)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""

ORACLES["op10_embeddings"] = r"""
with recursive vectors as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reached as (select a as vec_id, b as other from links union select reached.vec_id, links.b from reached join links on reached.other = links.a),
lows as (select vec_id, min(other) as low from reached group by vec_id),
counts as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, least(e.vec_id, coalesce(low, e.vec_id)) as component_id, e.vec_id <= coalesce(low, e.vec_id) as kept
from embeddings e left join counts using (vec_id) left join lows using (vec_id)
"""

ORACLES["op13_spelling_variants"] = r"""
with recursive bits as (
  select i, 0 as k, i as c from range(256) t(i)
  union all select i, k + 1, xor(c >> 1, (c & 1) * 3988292384) from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents where text is not null),
times as (select doc_id, run, count(*) as n from runs group by doc_id, run),
coded as (select doc_id, run, n, list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda c: cast(ord(c) as bigint)) as cs from times),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(cs, lambda c: case when c < 128 then [c] else [195, c - 64] end))),
    lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) as h
  from coded, crc),
made as (
  select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from made where length(word) >= 5 group by word having sum(n) >= 3),
holes as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as hole from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word as word, b.word as other, b.n as other_n from holes a join holes b on a.hole = b.hole and a.i = b.i and a.word <> b.word
  union select words.word, holes.word, holes.n from words join holes on words.word = holes.hole
  union select holes.word, words.word, words.n from words join holes on words.word = holes.hole),
near as (select word, count(*) as n_near, max(other_n) as top from pairs group by word),
forms as (
  select words.word, words.n, n_near, top, (select min(other) from pairs where pairs.word = words.word and other_n = top) as other
  from words left join near using (word)),
formed as (select word, n, cast(coalesce(n_near, 0) as bigint) as n_near, case when top >= 2 * n then other end as form, case when top >= 2 * n then top end as form_n from forms),
ways as (
  select word, word as here, 0 as k from formed
  union all select ways.word, form, k + 1 from ways join formed on formed.word = ways.here where form is not null)
select formed.word, form, here as root, n, n_near, cast(form_n as bigint) as form_n
from formed join (select word, arg_max(here, k) as here from ways group by word) using (word)
"""
