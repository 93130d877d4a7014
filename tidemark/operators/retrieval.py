"""Retrieval over sentence units: windows, TF-IDF centrality, rank fusion, keyword search, budgeted evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slices import parts

#: Words that are no keywords.
STOP_WORDS = ("the", "and", "for", "that", "this", "with", "you", "are", "was", "but", "not", "have")


def weighted(units: list[list[str]], unit_length: bool = False) -> tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of units, terms, unit, term, tf, weight) of the (unit, term) pairs of one text's units.

    weight = tf * (ln((1 + units) / (1 + df)) + 1); unit_length=True makes each unit's vector one long.
    """
    ids: dict[str, int] = {}
    term = np.array([ids.setdefault(t, len(ids)) for u in units for t in u], dtype=np.int64)
    n, v = len(units), max(1, len(ids))
    pair, tf = np.unique(np.repeat(np.arange(n), [len(u) for u in units]) * v + term, return_counts=True)
    unit, term = pair // v, pair % v
    weight = tf * (np.log((1 + n) / (1 + np.bincount(term, minlength=v))) + 1)[term]
    if unit_length:
        weight = weight / np.sqrt(np.bincount(unit, weight * weight, n))[unit]
    return n, list(ids), unit, term, tf, weight


def central(found: tuple) -> np.ndarray:
    """Cosine of each of the ``weighted`` units with the mean of all; 0 without terms."""
    n, names, unit, term, _, weight = found
    centre = np.bincount(term, weight, max(1, len(names))) / max(1, n)
    size = np.sqrt(np.bincount(unit, weight * weight, n)) * np.sqrt(np.sum(centre * centre))
    return np.divide(np.bincount(unit, weight * centre[term], n), size, out=np.zeros(n), where=size > 0)


def sentence_lists(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, s): the sentences of each text in one row, as ``sentences`` cuts them."""
    cut = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"([.。！？!?]+[」』”’）)]*)", "$1\n"), r"\n")
    return df.select(key, F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "").alias("s"))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence): cut after sentence ends and at line ends; white space single, empty ones left out."""
    return sentence_lists(df, key, text).select(key, F.posexplode("s").alias("pos", "sentence"))


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words and runs of ideographs of two characters or more, without stop words."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+|[一-鿿]{2,})"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.lower(t)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def windows(df: DataFrame, size: int, overlap: int, key: str = "doc_id", ragged: bool = False) -> DataFrame:
    """(key, window, first, last) over the positions of each key. ragged=False stops with the window that reaches the end."""
    step = max(1, size - overlap)
    n = df.groupBy(key).agg((F.max("pos") + 1).alias("n"))
    stop = (F.ceil(F.col("n") / step) - 1) if ragged else F.ceil(F.greatest(F.lit(0), F.col("n") - size) / step)
    rows = n.select(key, "n", F.explode(F.sequence(F.lit(0), stop.cast("int"))).alias("window"))
    return rows.select(key, "window", (F.col("window") * step).alias("first"), F.least(F.col("n"), F.col("window") * step + size).alias("last"))


def in_windows(found: DataFrame, size: int, overlap: int, key: str = "doc_id") -> DataFrame:
    """found (key, pos, ...) with ``window``, ``first``, ``last`` for each of the ``windows`` that hold the row, by arithmetic on its
    pos. Rows that are dealt by key already are not dealt again, and groupings by (key, ...) need no exchange either way."""
    step = max(1, size - overlap)
    rows = found.withColumn("_n", F.max("pos").over(Window.partitionBy(key)) + 1)
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1).cast("int")
    high = F.least(F.ceil(F.greatest(F.lit(0), F.col("_n") - size) / step), F.floor(F.col("pos") / step)).cast("int")
    rows = rows.select(*found.columns, "_n", F.explode(F.sequence(low, high)).alias("window"))
    return rows.withColumns({"first": F.col("window") * step, "last": F.least(F.col("_n"), F.col("window") * step + size)}).drop("_n")


_TERM = re.compile(r"[A-Za-z0-9_]+|[一-鿿]{2,}")


def _window_terms(own: list[str], size: int, overlap: int) -> list[list[str]]:
    """The terms of each of the ``windows`` of one text's sentences, as ``tokens`` gives them; a sentence is taken apart once."""
    words = [[t for t in " ".join(_TERM.findall(one)).lower().split() if len(t) >= 2 and t not in STOP_WORDS] for one in own]
    step = max(1, size - overlap)
    many = max(0, -(-(len(own) - size) // step)) + 1 if len(words) else 0
    return [[t for one in words[k * step : k * step + size] for t in one] for k in range(many)]


def centrality(lists: DataFrame, size: int, overlap: int, unit_length: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, window, score) of ``sentence_lists``: cosine of each window that has terms with the mean of all windows of its
    text. A text's windows are weighed where its row stands: nothing is shuffled."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts(batches):
            out = []
            for own in part:
                units = _window_terms(own, size, overlap)
                out.append([x if u else None for x, u in zip(central(weighted(units, unit_length)), units)])
            yield pd.Series(out, dtype="object")

    return lists.select(key, F.posexplode(scores("s")).alias("window", "score")).where("score is not null")


def top_keywords(lists: DataFrame, size: int, overlap: int, k: int = 8, key: str = "doc_id") -> DataFrame:
    """(key, window, keywords) of ``sentence_lists``: the k heaviest terms of each window that has terms; ties by count, then
    by term, all downwards."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def heaviest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts(batches):
            yield pd.Series([_heaviest(weighted(_window_terms(own, size, overlap)), k) for own in part], dtype="object")

    return lists.select(key, F.posexplode(heaviest("s")).alias("window", "keywords")).where("size(keywords) > 0")


def _heaviest(found: tuple, k: int) -> list[list[str]]:
    n, names, unit, term, tf, weight = found
    place = np.empty(len(names), dtype=np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    order = np.lexsort((-place[term], -tf, -weight, unit))
    first = np.searchsorted(unit, np.arange(n + 1))  # pairs come by unit
    return [[names[i] for i in term[order[a : min(z, a + k)]]] for a, z in zip(first[:-1], first[1:])]


def rank_fusion(scores: DataFrame, columns: list[str], key: str = "doc_id", order: str = "window", k: int = 60) -> DataFrame:
    """scores with ``fused``: the sum of 1 / (k + rank) over the score columns; ties keep their order, nulls add nothing."""
    fused = F.lit(0.0)
    for c in columns:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(c), order))
        fused = fused + F.when(F.col(c).isNotNull(), 1.0 / (k + rank)).otherwise(0.0)
    return scores.withColumn("fused", fused)


def keyword_search(units: DataFrame, question: str, k: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k units of each key in which the question's words occur most; ties by later start."""
    words = [w for w in question.lower().split() if w]
    low = F.lower(F.col(text))
    score = sum((((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words), F.lit(0))
    rows = units.withColumn("score", score).where("score > 0")
    by = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("first"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def evidence(units: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` units of each key: a budget for each level by ``fused``, then the best of the rest, put in place.

    A level's budget is never under 4; the list is cut in the order sentence, paragraph, topic.
    """
    budgets = {"sentence": max(4, most // 4), "paragraph": max(4, most // 3), "topic": max(4, most - most // 4 - most // 3)}
    order = F.when(F.col("level") == "sentence", 0).when(F.col("level") == "paragraph", 1).otherwise(2)
    budget = F.when(F.col("level") == "sentence", budgets["sentence"]).when(F.col("level") == "paragraph", budgets["paragraph"]).otherwise(budgets["topic"])
    best = [F.desc("fused"), order, "first"]
    rows = units.withColumn("_r", F.row_number().over(Window.partitionBy(key, "level").orderBy(*best))).withColumn("_in", F.col("_r") <= budget)
    rows = rows.withColumn("_all", F.row_number().over(Window.partitionBy(key, "_in").orderBy(*best)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_in"), F.when(F.col("_in"), order), F.when(F.col("_in"), F.col("_r")), "_all"))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_r", "_in", "_all", "_place")


def vector_centrality(df: DataFrame, key: str = "label", unit: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, unit, score): cosine of each unit-length vector with the mean of its key's unit-length vectors."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = df.where(F.col(vector).isNotNull()).select(key, unit, v.alias("v"), norm.alias("n")).where("n > 0").select(key, unit, F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("i", "x"))
    centre = rows.groupBy(key, "i").agg(F.avg("x").alias("c"))
    size = centre.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("cn"))
    return rows.join(centre, [key, "i"]).groupBy(key, unit).agg(F.sum(F.col("x") * F.col("c")).alias("dot")).join(size, key).select(key, unit, F.when(F.col("cn") > 0, F.col("dot") / F.col("cn")).otherwise(0.0).alias("score"))
