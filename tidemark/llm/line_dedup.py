r"""Line dedup by content-defined chunks, with DataFrame functions only.

A text is split at ``\n``; each line has a hash. A rolling hash over the last ``window`` line hashes ends a chunk where
it is 0 modulo ``divisor``, so boundaries depend on the lines around them and not on their place. A chunk with two
non-blank lines or more that stands more than once in all documents stays where it stands first (smallest id, then
smallest place) and is removed elsewhere. Chunks that share a hash are compared byte by byte, as grouping and join keys.

How it travels: (hash, count) pairs find the repeated hashes with a map-side combine; the repeated hashes go back to
(id, place); only those chunks travel with their text. The texts are dealt out by id once and that exchange is used
again. A chunk that a third of all documents hold is one row per task in the aggregations; the two joins that see it
have the aggregated side unique, so the skewed side can be split.

Chunks miss short passages inside otherwise different texts, as their ends fall among foreign lines. With ``pairs`` the
pieces are all pairs of neighbouring non-blank lines instead, with the blank lines between them. They travel and are
compared in the same way, and overlap, so a repeated run of two non-blank lines or more goes whole, whatever stands
beside it. Each removed line still stands at a smaller id or place.

Null texts stay null with 0 lines; an empty text has one empty line. Rows with a null id are left as they are and no
source. Rows stay one to one: rows that repeat an id never remove each other's chunks, but a chunk repeated inside one
text is removed there too. Where all lines go, the text is empty and the row stays. Other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Multiplier of the rolling hash.
ROLL = 33


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that later expressions read. A projection would be folded into them and run for each use,
    which inside a lambda is once an element; a generator of one row is not."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def chunked(docs: DataFrame, window: int, divisor: int) -> DataFrame:
    """docs with ``lines`` and ``edges``, the place of the last line of each chunk from 0."""
    hashed = fixed(fixed(docs, "lines", F.split("text", "\n", -1)), "hashes", F.transform("lines", line_hash))
    n = F.size("hashes")

    def ends(h: Column, i: Column) -> Column:
        value = h
        for back in range(1, window):
            value = value + F.coalesce(F.when(i >= back, F.get("hashes", i - back)), F.lit(0).cast("long")) * (ROLL**back)
        return F.when((i == n - 1) | (value % divisor == 0), i).otherwise(-1)

    edges = F.filter(F.transform("hashes", ends), lambda i: i >= 0)
    return fixed(hashed, "edges", edges).drop("hashes")


def paired(docs: DataFrame) -> DataFrame:
    """docs with ``lines`` and ``edges``, the places of the non-blank lines; piece k goes from one to the next."""
    split = fixed(docs, "lines", F.split("text", "\n", -1))
    return fixed(split, "edges", F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(NOT_BLANK), i).otherwise(-1)), lambda i: i >= 0))


def pair_text(k: Column) -> Column:
    first = F.get("edges", k)
    return F.array_join(F.slice("lines", first + 1, F.get("edges", k + 1) - first + 1), "\n")


def first_line(k: Column) -> Column:
    return F.when(k == 0, 0).otherwise(F.get("edges", k - 1) + 1)


def chunk_text(k: Column) -> Column:
    first = first_line(k)
    return F.array_join(F.slice("lines", first + 1, F.get("edges", k) - first + 1), "\n")


NOT_BLANK = r"\S"
#: Two non-blank lines: the first non-blank line, its end, a non-blank character after it. Anchored and possessive, so linear.
TWO_LINES = r"\A\s*+\S[^\n]*+\n\s*+\S"


def remove_repeated_lines(df: DataFrame, window: int = 2, divisor: int = 4, id_col: str = "doc_id", text_col: str = "text", pairs: bool = False) -> DataFrame:
    """(doc_id, tkey, n_lines, n_removed, kept string, spans array<struct<start,end>> of the removed lines) of every document.

    tkey is xxhash64 of the text; (doc_id, tkey) finds a result again.
    """
    rows = id_and_text(df, id_col, text_col)
    cut = paired if pairs else lambda docs: chunked(docs, window, divisor)
    piece = pair_text if pairs else chunk_text
    n_pieces = F.greatest(F.size("edges") - 1, F.lit(0)) if pairs else F.size("edges")
    # Every branch below must see the same exchange: the same two columns, and no filter that only one of them pushes down.
    docs = rows.where("doc_id is not null and text is not null").repartition("doc_id")
    chunks = F.transform(F.slice("edges", 1, n_pieces), lambda e, k: F.struct(k.alias("place"), piece(k).alias("chunk")))
    parts = cut(docs).select("doc_id", F.inline(chunks)).where(F.col("chunk").rlike(TWO_LINES))
    hashed = parts.select("doc_id", "place", F.xxhash64("chunk").alias("h"))
    repeated = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    wanted = hashed.join(repeated, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("wanted")).withColumnRenamed("doc_id", "wanted_id")
    near = cut(docs).join(wanted, docs["doc_id"] == wanted["wanted_id"])
    there = F.array_sort(F.filter("wanted", lambda k: k < n_pieces))  # another text of a repeated id may be shorter
    near = fixed(near, "places", there)
    near = fixed(near, "texts", F.transform("places", piece)).withColumn("tkey", F.hash("text"))
    rows_of = F.transform("places", lambda k, i: F.struct(k.alias("place"), F.get("texts", i).alias("chunk"), (F.array_position("texts", F.get("texts", i)) <= i).alias("again")))
    chunks = near.select("doc_id", "tkey", F.inline(rows_of))
    chunks = chunks.withColumn("h", F.xxhash64("chunk"))
    firsts = chunks.groupBy("h", "chunk").agg(F.min("doc_id").alias("first_id"))
    gone = chunks.join(firsts, ["h", "chunk"]).where("again or doc_id > first_id").groupBy("doc_id").agg(F.collect_set(F.struct("tkey", "place")).alias("gone")).withColumnRenamed("doc_id", "gone_id")
    final = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left").select("doc_id", "text", "gone")
    own = F.array_sort(F.transform(F.filter("gone", lambda g: g["tkey"] == F.hash("text")), lambda g: g["place"]))
    touched = fixed(cut(final), "places", own)
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    if pairs:
        # Overlapping pieces: the set of their lines, and its runs.
        held = F.flatten(F.transform("places", lambda k: F.sequence(F.get("edges", k), F.get("edges", k + 1))))
        touched = fixed(touched, "out", F.coalesce(F.array_distinct(held), F.array().cast("array<int>")))
        after = F.transform("out", lambda i: i + 1)
        spans = F.arrays_zip(F.array_sort(F.array_except("out", after)).alias("start"), F.array_sort(F.array_except(after, "out")).alias("end")).cast("array<struct<start:int,end:int>>")
        left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "out"), lambda i: F.get("lines", i))
    else:
        spans = F.coalesce(F.transform("places", lambda k: F.struct(first_line(k).alias("start"), (F.get("edges", k) + 1).alias("end"))), no_spans)
        left = F.filter("lines", lambda line, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    touched = fixed(touched, "spans", spans)
    kept = F.when(F.size("spans") > 0, F.array_join(left, "\n")).otherwise(F.col("text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    made = touched.select("doc_id", F.xxhash64("text").alias("tkey"), F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"), kept.alias("kept"), "spans")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    whole = rows.where("doc_id is null or text is null").select("doc_id", F.xxhash64("text").alias("tkey"), lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"), F.array().cast(made.schema["spans"].dataType).alias("spans"))
    # In this order: a union keeps the aliases below its first branch, and there they would make another exchange.
    return whole.unionByName(made)
