"""Spelling variants: words of a corpus that are one edit apart, and the form that each stands for.

Words are counted natively, with a map-side combine. Pairs one edit apart are found by errata tries (see ``errata``), which
need the words of a group in one task, so groups are cut by where an edit may be:

A pair has a shorter length L (of equal ones, theirs) and a place, where the words part. Places 0 to L are cut in two
halves. Words whose edit is in the first half share all behind it, in the second half all before it; so each word goes to
the groups of its shared part, for L its own length and for L one less. Groups with more than ``most`` words are cut at the
middle of their places again, until a place is left alone, where letters bound a group. A pair falls into one group, as its
place is taken as far right as can be.

How it travels: words, not texts, in four groups each and two more for each cut of a hot group; joins that see a hot group
or a form of many words have their other side unique, so that the hot side can be split. Tables are written between rounds.
The rounds that follow forms to their roots double their reach.

Runs of letters are those of ``letters``, only A-Z is lower-cased. Null texts have no words, and a null id counts as an
empty one; texts of a repeated row count each time; very long words have no bound; an empty table gives no rows. Other
columns are left behind.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .errata import one_edit_pairs

#: Words of a group that one task takes together.
MOST = 2048
#: What tells a group: shorter length, places from and to, the parts that its words share before and behind them.
GROUP = ["size", "low", "high", "head", "tail"]


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """The run, or where ``every`` divides the CRC of id and run, the run without the code point that the CRC names."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (crc % F.length(run)).cast("int")
    return F.when(crc % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(df: DataFrame, letters: str = r"A-Za-zÀ-ÿ", shortest: int = 5, least: int = 3, every: int | None = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words with ``shortest`` code points and ``least`` occurrences or more. Runs lose a code point at places
    that ``every`` and their document's id tell; without ``every`` they stay."""
    rows = id_and_text(df, id_col, text_col)
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{letters}]{{{shortest},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    words = runs.select("doc_id", lower.alias("run")).select((damaged(F.col("doc_id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _cut(pieces: DataFrame) -> DataFrame:
    """Each piece (word, n, size, low, high) in both halves of its places, with what its group shares."""
    middle = F.expr("low + (high - low + 1) div 2")
    halves = F.array(F.struct(F.col("low"), middle.cast("int").alias("high")), F.struct(middle.cast("int").alias("low"), F.col("high")))
    cut = pieces.select("word", "n", "size", F.inline(halves))
    return cut.select("*", F.substring("word", F.lit(1), F.col("low")).alias("head"), F.when(F.col("size") > F.col("high"), F.expr("right(word, size - high)")).otherwise("").alias("tail"))


def _all_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield _met(batch.slice(at, 256))


def _met(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Both directions of each pair of some groups."""
    words, others, counts = [], [], []
    for size, low, high, members, numbers in zip(*(column.to_pylist() for column in batch.columns)):
        middles = [word[low : len(word) - (size - high)] for word in members]
        for i, j, _, reach in one_edit_pairs(middles):
            replaced = len(middles[i]) == len(middles[j])
            if len(middles[i]) == high - low if replaced else not reach or high == size:
                words += [members[i], members[j]]
                others += [members[j], members[i]]
                counts += [numbers[j], numbers[i]]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(counts, pa.int64())], names=["word", "other", "other_n"])


def near_words(words: DataFrame, shortest: int = 5, most: int = MOST) -> DataFrame:
    """(word, other, other_n) of all pairs of distinct words (word, n) one edit apart, in both directions. Words have at
    least ``shortest`` code points."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda size: size >= shortest)
    pieces = words.select("word", "n", F.explode(lengths).alias("size")).select("*", F.lit(0).alias("low"), F.col("size").alias("high"))
    pieces = _cut(pieces)
    found = []
    while True:
        sizes = pieces.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("held"))
        hot = written(sizes.where((F.col("held") > most) & (F.col("high") - F.col("low") > 1)).drop("held"), "hot-words")
        last = hot.isEmpty()
        calm = pieces if last else pieces.join(hot, GROUP, "left_anti")
        groups = calm.groupBy(*GROUP).agg(F.collect_list("word").alias("members"), F.collect_list("n").alias("numbers")).where(F.size("members") > 1)
        found.append(groups.select("size", "low", "high", "members", "numbers").mapInArrow(_all_met, "word string, other string, other_n long"))
        if last:
            break
        pieces = written(_cut(pieces.join(hot, GROUP, "left_semi")), "split-words")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word (word, form) that has a form: the last of its forms, each round twice as far away."""
    ways = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ways = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(next_ways, "root", "left_semi").isEmpty():
            return ways
        ways = written(ways.join(next_ways, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def group_variants(df: DataFrame, shortest: int = 5, least: int = 3, every: int | None = 97, times: int = 2, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its near word of largest n (of equals the smallest in code-point
    order) is its form if that stands ``times`` as often; root is the last form that forms lead to, or the word."""
    words = written(count_words(df, shortest=shortest, least=least, every=every, id_col=id_col, text_col=text_col), "words")
    near = near_words(words, shortest, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    has = -F.col("best.minus") >= times * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"))
    formed = written(formed, "forms")
    told = formed.join(_roots(formed.where("form is not null")), "word", "left")
    return told.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
