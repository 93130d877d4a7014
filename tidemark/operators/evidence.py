"""Evidence beside rows: texts of near rows, places of times, regions of two tables, the window that holds speech.

Rows whose times are null, or that end before they start, are near nothing and hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

KEY = "media_id"


def near_pairs(left: DataFrame, right: DataFrame, pad: float = 0.0, closed: bool = False, width: float = 30.0, key: str = KEY) -> DataFrame:
    """Pairs (columns of right prefixed ``r_``) that overlap once ``pad`` is put around the left row; closed=True: or touch.

    Bins of ``width`` spread one media over tasks. A pair is kept in the bin of the later of both beginnings.
    """
    place = lambda t: F.floor(t / width)
    low, high = F.col("start") - pad, F.col("end") + pad
    l = left.where("end >= start").withColumn("_low", low).withColumn("_high", high).withColumn("_bin", F.explode(F.sequence(place(low), place(high))))
    r = right.where("end >= start").select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.sequence(place(F.col("start")), place(F.col("end")))).alias("r_bin"))
    meet = (F.col("r_end") >= F.col("_low")) & (F.col("r_start") <= F.col("_high")) if closed else (F.col("r_end") > F.col("_low")) & (F.col("r_start") < F.col("_high"))
    pairs = l.join(r, (F.col(key) == F.col(f"r_{key}")) & (F.col("_bin") == F.col("r_bin")) & meet)
    return pairs.where(place(F.greatest("_low", "r_start")) == F.col("_bin")).drop("_bin", "r_bin", "_low", "_high")


def texts_beside(df: DataFrame, other: DataFrame, pad: float, closed: bool = False, first: int | None = None, separator: str = "", missing: str | None = None, width: float = 30.0, key: str = KEY) -> DataFrame:
    """df with ``beside``: the texts of near rows of the other table in order of pos, all or the ``first``; ``missing`` where
    there are none. pos names a row within its media."""
    near = near_pairs(df.select(key, "pos", "start", "end").distinct(), other.select(key, "pos", "start", "end", "text"), pad, closed, width, key)
    if first is not None:
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy(key, "pos").orderBy("r_pos"))).where(F.col("_n") <= first)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("r_pos", "r_text"))), lambda x: x["r_text"])
    found = near.groupBy(key, "pos").agg(F.array_join(texts, separator).alias("beside"))
    return df.join(found, [key, "pos"], "left").withColumn("beside", F.coalesce("beside", F.lit(missing))).select(*df.columns, "beside")


def rows_in_range(ranges: DataFrame, cues: DataFrame, margin: int = 10, width: float = 400.0, key: str = KEY) -> DataFrame:
    """Pairs of character ranges and the cues with text that overlap them, with ``margin`` characters on both sides.

    A range never reaches before the first character, so that cues without a place (negative ends) are in none.
    """
    return near_pairs(ranges, cues.where("end > 0 and trim(text) <> ''"), margin, width=width, key=key)


def places(df: DataFrame, times: DataFrame, time: str = "t", key: str = KEY) -> DataFrame:
    """(key, pos, first, past): the slice of the sorted times that lies in [start, end], by one sorted stream a media."""
    mark = lambda c, kind: F.struct(F.col(c).alias("t"), F.lit(kind).alias("kind"))
    asked = df.select(key, "pos", F.explode(F.array(mark("start", 0), mark("end", 2))).alias("m")).select(key, "pos", "m.*")
    stream = asked.unionByName(times.where(F.col(time).isNotNull()).select(key, F.lit(None).cast(df.schema["pos"].dataType).alias("pos"), F.col(time).alias("t"), F.lit(1).alias("kind")))
    by = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = stream.withColumn("n", F.count(F.when(F.col("kind") == 1, 1)).over(by)).where("kind <> 1 and t is not null")
    return seen.groupBy(key, "pos").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("first"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("past"))


def unrepeated(df: DataFrame, original: DataFrame, key: str = KEY) -> DataFrame:
    """Rows that overlap no original row of the same trimmed text (strictly)."""
    named = lambda d: d.withColumn("_k", F.struct(key, F.trim("text").alias("x")))
    return iv.not_touching(named(df), named(original), key="_k").select(*df.columns)


def region_sets(a: DataFrame, b: DataFrame, how: str = "intersect", key: str = KEY) -> DataFrame:
    """(key, start, end), disjoint: what is in both tables ('intersect') or in the first alone ('difference').

    The number of open regions of each table is a running sum; regions without length count for nothing.
    """
    if how not in ("intersect", "difference"):
        raise ValueError(f"no region set {how!r}")
    move = lambda c, x, y: F.struct(F.col(c).alias("t"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    ends = lambda d, x, y: d.where("end > start").select(key, F.explode(F.array(move("start", x, y), move("end", -x, -y))).alias("m")).select(key, "m.*")
    moves = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by = Window.partitionBy(key).orderBy("t")
    open_ = lambda c: F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, 0)) > 0
    wanted = open_("a") & (open_("b") if how == "intersect" else ~open_("b"))
    turns = moves.withColumn("_in", wanted).withColumn("_was", F.coalesce(F.lag("_in").over(by), F.lit(False))).where("_in <> _was")
    return turns.withColumn("end", F.lead("t").over(by)).where("_in").select(key, F.col("t").alias("start"), "end")


def voice_window(silences: DataFrame, media: DataFrame, shortest: float = 0.10, leading: float = 0.10, trailing: float = 0.15, failed: str | None = None, key: str = KEY) -> DataFrame:
    """(key, start, seconds): from the first to the last voice of at least ``shortest`` seconds, with guards, inside [0, duration].

    Nulls where all is silent. ``failed`` names a boolean column of media: detection failed, the whole media is the window.
    """
    voice = iv.complement(silences.where("start is not null and end is not null"), media, shortest, key)
    span = voice.groupBy(key).agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    low = F.greatest(F.lit(0.0), F.col("_s") - leading)
    seconds = F.greatest(F.lit(0.0), F.least(F.col("duration"), F.col("_e") + trailing) - low)
    whole = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    start = F.when(whole, 0.0).when(F.col("_s").isNotNull(), low)
    return media.join(span, key, "left").select(key, start.alias("start"), F.when(whole, F.col("duration")).when(F.col("_s").isNotNull(), seconds).alias("seconds"))


def snapped_to_voice(df: DataFrame, windows: DataFrame, early: float = 0.1, late: float = 2.0, key: str = KEY) -> DataFrame:
    """Rows of chunks clamped into [0, duration]; a first row (by pos) that starts by ``early`` where the voice starts at
    ``late`` or after begins with the voice. Blank rows, and rows that are then empty, go. windows: (key, voice, duration)."""
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.col("duration"), F.col(c)))
    rows = df.withColumn("_first", F.min("pos").over(Window.partitionBy(key)) == F.col("pos")).join(windows.select(key, "voice", "duration"), key)
    rows = rows.withColumn("start", inside("start")).withColumn("end", inside("end"))
    moved = F.when(F.col("_first") & (F.col("start") <= early) & (F.col("voice") >= late), F.least("end", "voice")).otherwise(F.col("start"))
    return rows.withColumn("start", moved).where("trim(text) <> '' and end > start").select(*df.columns)


def relocated(entries: DataFrame, files: DataFrame, entry: str = "entry_id") -> DataFrame:
    """entries with ``path``: the file of its cache_key; else the first (by path) whose source or identity is the entry's
    source or canonical_source. Null and empty names are nobody's. Each name keeps one path before the join."""
    named = lambda d, *c: d.withColumn("name", F.explode(F.array_distinct(F.array(*c)))).where("name <> ''")
    by_key = files.where("cache_key <> ''").groupBy("cache_key").agg(F.min("path").alias("_own"))
    by_name = named(files, "source", "identity").groupBy("name").agg(F.min("path").alias("_p"))
    other = named(entries, "source", "canonical_source").select(entry, "name").join(by_name, "name").groupBy(entry).agg(F.min("_p").alias("_other"))
    return entries.join(by_key, "cache_key", "left").join(other, entry, "left").select(*entries.columns, F.coalesce("_own", "_other").alias("path"))


def fusion_confidence(matched_words: Column, words: Column, matched_chars: Column, chars: Column) -> Column:
    """0.4 of the share of characters and 0.6 of that of words; without words at most 0.3, without characters 1."""
    share = matched_chars / F.nullif(chars, F.lit(0))
    return F.when(chars == 0, 1.0).when(words == 0, F.least(share, F.lit(0.3))).otherwise(0.4 * share + 0.6 * matched_words / F.nullif(words, F.lit(0)))


def filled_times(df: DataFrame, time: str = "t", key: str = KEY) -> DataFrame:
    """df with the times that are null laid evenly between those beside them in order of pos; before the first and after the
    last they are those. A media without times keeps its nulls."""
    by = Window.partitionBy(key).orderBy("pos")
    known = F.when(F.col(time).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(time).alias("t")))
    rows = df.withColumn("_a", F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_b", F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("_a.t") + (F.col("_b.t") - F.col("_a.t")) * ((F.col("pos") - F.col("_a.p")) / F.nullif(F.col("_b.p") - F.col("_a.p"), F.lit(0)))
    return rows.withColumn(time, F.coalesce(time, between, "_a.t", "_b.t")).drop("_a", "_b")
