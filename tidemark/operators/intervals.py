"""Interval algebra. Rows carry ``media_id``, ``pos`` (the tie-break and list order), ``start`` and ``end`` in seconds.

Every function takes and returns DataFrames. Questions about two tables of intervals (what is covered, what touches, which
row is next) put both in one stream of moments and answer by running sums and maxima: one sort of a media's moments, no
pairs. ``binned_overlap_join`` gives the pairs themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "media_id"


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds that two intervals share, never negative."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def overlapping(df: DataFrame, start: float, end: float, tolerance: float = 0.75) -> DataFrame:
    """Rows that touch [start - tolerance, end + tolerance], bounds included."""
    return df.where((F.col("end") >= start - tolerance) & (F.col("start") <= end + tolerance))


def shift(df: DataFrame, offset: float | Column) -> DataFrame:
    """Both ends moved, to the millisecond."""
    return df.withColumns({c: F.bround(F.col(c) + offset, 3) for c in ("start", "end")})


def clamp(df: DataFrame, low: float | Column, high: float | Column, round_to: int | None = 3, min_span: float = 0.0) -> DataFrame:
    """Both ends clamped into [low, high]; what is then empty goes."""
    ends = {"start": F.greatest(F.col("start"), F.lit(low) if not isinstance(low, Column) else low), "end": F.least(F.col("end"), F.lit(high) if not isinstance(high, Column) else high)}
    if round_to is not None:
        ends = {k: F.bround(v, round_to) for k, v in ends.items()}
    return df.withColumns(ends).where(F.col("end") - F.col("start") > min_span)


def trim_to_window(df: DataFrame, leading: float, trailing: float, duration: float, straddling: str = "clamp") -> DataFrame:
    """The part inside a chunk without its context. straddling='drop' leaves out rows that start in the leading context."""
    low, high = leading, duration - trailing
    if straddling == "drop":
        return df.where((F.col("start") >= low) & (F.col("end") <= high))
    return clamp(df, low, high)


def islands(df: DataFrame, gap: float, closed: bool = False, order: tuple[str, ...] = ("start", "pos"), key: str = KEY) -> DataFrame:
    """df with ``island``: a new one begins where a row starts ``gap`` or more after the largest end before it.

    closed=True also joins rows that start exactly ``gap`` after.
    """
    by = Window.partitionBy(key).orderBy(*order)
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") - reach
    begins = reach.isNull() | ((apart > gap) if closed else (apart >= gap))
    return df.withColumn("_begins", begins.cast("int")).withColumn("island", F.sum("_begins").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def merge_regions(df: DataFrame, guard: float = 2.0, merge_gap: float = 0.5, duration: float | Column | None = None, closed: bool = False, reason: str = "reason", attempts: str | None = None, key: str = KEY) -> DataFrame:
    """Regions padded by ``guard``, clipped to [0, duration] and merged; reasons distinct in order of appearance."""
    end = F.col("end") + guard
    if duration is not None:
        end = F.least(end, duration if isinstance(duration, Column) else F.lit(duration))
    padded = df.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - guard)).withColumn("end", end)
    parts = islands(padded, merge_gap, closed, key=key)
    ordered = F.array_sort(F.collect_list(F.struct("start", "pos", F.col(reason).alias("r"))))
    more = [F.max(attempts).alias("attempts")] if attempts else []
    merged = parts.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["r"])), ", ").alias("reason"), *more)
    return merged.select(key, F.col("island").cast("long").alias("region"), "start", "end", "reason", *(["attempts"] if attempts else []))


def complement(df: DataFrame, durations: DataFrame, minimum: float = 0.1, key: str = KEY) -> DataFrame:
    """The gaps of at least ``minimum`` seconds in [0, duration] that the rows leave; a media without rows is one gap."""
    rows = df.select(key, "start", "end").unionByName(durations.select(key, F.col("duration").alias("start"), F.col("duration").alias("end")))
    by = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.lit(0.0), F.coalesce(F.max("end").over(by), F.lit(0.0)))
    gaps = rows.withColumn("gap_start", cursor).where(F.col("start") - F.col("gap_start") >= minimum)
    return gaps.select(key, F.col("gap_start").alias("start"), F.col("start").alias("end"))


def _moments(probes: DataFrame, rows: DataFrame, key: str, **values: tuple[Column | None, Column | None]) -> DataFrame:
    """Both tables as one: a struct ``_probe`` of the probe's columns (null for rows), and each value by table."""
    kinds = {name: (rows.select(own) if own is not None else probes.select(asked)).schema[0].dataType for name, (asked, own) in values.items()}
    value = lambda c, name: (F.lit(None) if c is None else c).cast(kinds[name]).alias(name)
    asked = probes.select(key, F.struct(*probes.columns).alias("_probe"), *[value(a, n) for n, (a, _) in values.items()])
    return asked.unionByName(rows.select(key, F.lit(None).cast(asked.schema["_probe"].dataType).alias("_probe"), *[value(o, n) for n, (_, o) in values.items()]))


def covered_seconds(regions: DataFrame, rows: DataFrame, key: str = KEY, capped: bool = True) -> DataFrame:
    """regions with ``covered``: the sum of overlaps of all rows, at most the region (overlapping rows count twice).

    Up to a moment t the rows cover: the number of open ones times t, less their starts, plus the spans of ended ones. Its
    difference between a region's ends is what is covered. Rows and regions without length cover nothing.
    """
    ends = lambda s, e: F.explode(F.array(F.struct(F.lit(1).alias("d"), s.alias("t")), F.struct(F.lit(-1).alias("d"), e.alias("t"))))
    sound = F.col("end") > F.col("start")
    moved = rows.where(sound).select(key, ends(F.col("start"), F.col("end")).alias("m")).select(key, "m.*")
    named = regions.withColumn("_r", F.struct(*regions.columns))
    asked = named.select(key, "_r", ends(F.col("start"), F.greatest("start", "end")).alias("m")).select(key, "_r", "m.*")
    stream = asked.unionByName(moved.withColumn("_r", F.lit(None).cast(asked.schema["_r"].dataType)))
    stream = stream.withColumn("_m", F.col("t") - F.min("t").over(Window.partitionBy(key)))  # small numbers keep their places
    by = Window.partitionBy(key).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_r").isNull(), F.col("d"))
    reached = F.coalesce(F.sum(own).over(by), F.lit(0)) * F.col("_m") - F.coalesce(F.sum(own * F.col("_m")).over(by), F.lit(0.0))
    got = stream.withColumn("_f", reached).where("_r is not null").withColumn("_n", F.lit(1))
    # equal regions are one group; each of them has the same sum
    sums = got.groupBy(key, "_r").agg(F.sum(-F.col("d") * F.col("_f")).alias("_c"), (F.count(F.lit(1)) / 2).cast("long").alias("_n"))
    out = sums.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).withColumn("_m", F.col("_c") / F.greatest(F.lit(1), F.max("_n").over(Window.partitionBy(key, "_r"))))
    covered = F.greatest(F.lit(0.0), F.col("_m"))
    out = out.select("_r.*", covered.alias("covered"))
    return out.withColumn("covered", F.least(F.col("covered"), F.greatest(F.lit(0.0), F.col("end") - F.col("start")))) if capped else out


def _reached(df: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """df with ``_touches``: whether a region begins before the row's end and ends after its start (both strictly).

    That is so where the farthest end of the regions that begin before the row's end lies after its start.
    """
    stream = _moments(df, regions, key, _t=(F.col("end"), F.col("start")), _kind=(F.lit(0), F.lit(1)), _end=(None, F.col("end")))
    by = Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = stream.withColumn("_far", F.max("_end").over(by)).where("_probe is not null")
    return seen.select("_probe.*", F.coalesce(F.col("_far") > F.col("_probe.start"), F.lit(False)).alias("_touches"))


def not_touching(df: DataFrame, regions: DataFrame, key: str = KEY) -> DataFrame:
    """Rows that overlap no region (strictly)."""
    return _reached(df, regions, key).where("not _touches").drop("_touches")


def touching(df: DataFrame, regions: DataFrame, key: str = KEY) -> DataFrame:
    """Rows that overlap a region (strictly)."""
    return _reached(df, regions, key).where("_touches").drop("_touches")


def binned_overlap_join(left: DataFrame, right: DataFrame, width: float, key: str = KEY) -> DataFrame:
    """Inner overlap join through bins of ``width`` seconds; a pair is kept in the bin that holds the later start only.

    Right columns are prefixed ``r_``.
    """
    bins = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    r = bins(right).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("_bin").alias("r_bin"))
    l = bins(left)
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_bin") == F.col("r_bin")) & (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    return l.join(r, on).where(F.floor(F.greatest("start", "r_start") / width) == F.col("_bin")).drop("_bin", "r_bin")


def as_of(probes: DataFrame, rows: DataFrame, time: str = "t", key: str = KEY, until_end: bool = True, value: str = "pos") -> DataFrame:
    """probes with ``current``: ``value`` of the row of the latest start at or before the time (null after its end).

    One sort per media: rows and probes are one stream and the last row seen is carried along. Rows sort before probes.
    """
    last = rows.select(key, F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.col("pos").alias("_p"), F.struct(F.col(value).alias("v"), F.col("end").alias("e")).alias("_row"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in probes.schema if f.name != key])
    asked = probes.select(key, F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["pos"].dataType).alias("_p"), F.lit(None).cast(last.schema["_row"].dataType).alias("_row"), *[c for c in probes.columns if c != key])
    by = Window.partitionBy(key).orderBy("_t", "_kind", "_p").rowsBetween(Window.unboundedPreceding, 0)
    seen = last.unionByName(asked).withColumn("_seen", F.last("_row", ignorenulls=True).over(by)).where("_kind = 1")
    inside = F.when(F.col("_seen.e") >= F.col("_t"), F.col("_seen.v")) if until_end else F.col("_seen.v")
    return seen.select(*probes.columns, inside.alias("current"))


def first_at_or_after(probes: DataFrame, rows: DataFrame, time: str = "t", slack: float = 0.5, key: str = KEY, value: str = "pos") -> DataFrame:
    """probes with ``next``: ``value`` of the earliest row that starts at or after time - slack."""
    stream = _moments(probes, rows, key, _t=(F.col(time) - slack, F.col("start")), _kind=(F.lit(0), F.lit(1)), _p=(None, F.col("pos")), _row=(None, F.struct(F.col(value).alias("v"))))
    by = Window.partitionBy(key).orderBy("_t", "_kind", "_p").rowsBetween(0, Window.unboundedFollowing)
    seen = stream.withColumn("_next", F.first("_row", ignorenulls=True).over(by)).where("_probe is not null")
    return seen.select("_probe.*", F.col("_next.v").alias("next"))


def word_gaps(df: DataFrame, durations: DataFrame | None = None, minimum: float = 3.0, key: str = KEY) -> DataFrame:
    """Leading, inner and trailing gaps of at least ``minimum`` seconds between consecutive rows."""
    by = Window.partitionBy(key).orderBy("start", "pos")
    inner = df.withColumn("_prev", F.lag("end").over(by)).select(key, F.coalesce("_prev", F.lit(0.0)).alias("gap_start"), F.col("start").alias("gap_end"))
    gaps = inner
    if durations is not None:
        last = df.groupBy(key).agg(F.max_by("end", F.struct("start", "pos")).alias("gap_start"))
        gaps = gaps.unionByName(last.join(durations, key).select(key, "gap_start", F.col("duration").alias("gap_end")))
    return gaps.where(F.col("gap_end") - F.col("gap_start") >= minimum)


def timeline_report(df: DataFrame, long_gap: float = 10.0, key: str = KEY) -> DataFrame:
    """Per media, in list order: rows, invalid, backwards, gaps over ``long_gap``, the largest gap, the last end."""
    by = Window.partitionBy(key).orderBy("pos")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_prev", F.lag("start").over(by)).withColumn("_gap", F.col("start") - reach)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("end") <= F.col("start")).alias("invalid"),
        F.count_if(F.col("start") < F.col("_prev")).alias("backwards"),
        F.count_if(F.col("_gap") > long_gap).alias("long_gaps"),
        F.round(F.greatest(F.lit(0.0), F.coalesce(F.max("_gap"), F.lit(0.0))), 3).alias("max_gap"),
        F.max("end").alias("last_end"),
    )


def first_disorder(df: DataFrame, slack: float = 0.001, strict_span: bool = True, key: str = KEY) -> DataFrame:
    """Per media, the first row (by pos) that runs backwards or has no span; null where the timeline is sound."""
    by = Window.partitionBy(key).orderBy("pos")
    bad = (F.col("end") <= F.col("start")) if strict_span else (F.col("end") < F.col("start"))
    bad = bad | (F.col("start") < F.lag("start").over(by) - slack)
    return df.withColumn("_bad", bad).groupBy(key).agg(F.min(F.when(F.col("_bad"), F.col("pos"))).alias("first_bad"))


def replace_in_regions(original: DataFrame, replacement: DataFrame, regions: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of the original outside the regions and replacement rows inside, each text once per fifth of a second.

    An original row that ends before a region goes as well if a replacement overlaps it; rows without letters or digits go.
    """
    inserted = touching(replacement, regions, key)
    last = regions.groupBy(key).agg(F.max("start").alias("_last"))
    kept = _reached(not_touching(original, regions, key), inserted, key).join(last, key, "left")
    kept = kept.where(~(F.col("_touches") & F.coalesce(F.col("end") <= F.col("_last"), F.lit(False)))).select(*original.columns)
    rows = kept.withColumn("_from", F.lit(0)).unionByName(inserted.withColumn("_from", F.lit(1)))
    rows = rows.withColumn("_slot", F.bround(F.col("start") * 5).cast("long")).withColumn("_norm", F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))).where("_norm <> ''")
    first = Window.partitionBy(key, "_slot", "_norm").orderBy("start", F.desc("end"), "_from", "pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_slot", "_norm").withColumnRenamed("_from", "inserted")


def chunk_windows(media: DataFrame, chunk: float = 60.0, context: float = 2.0, key: str = KEY) -> DataFrame:
    """Tumbling chunks of [0, duration] with context on each side that has a neighbour."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / chunk)).cast("int")
    rows = media.select(key, "duration", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    at, end = F.col("chunk") * chunk, F.least(F.col("duration"), (F.col("chunk") + 1) * chunk)
    lead = F.when(F.col("chunk") > 0, context).otherwise(0.0)
    trail = F.when(F.col("chunk") < F.col("_n") - 1, F.least(F.lit(context), F.col("duration") - end)).otherwise(0.0)
    return rows.select(key, "chunk", (at - lead).alias("start"), (end - at + lead + trail).alias("duration"), at.cast("double").alias("timeline_start"), lead.alias("leading"), trail.alias("trailing"))


def split_windows(windows: DataFrame) -> DataFrame:
    """Each window as its halves a and b."""
    half = F.col("duration") / 2
    part = lambda name, s: F.struct(F.concat(F.col("label"), F.lit(name)).alias("label"), s.alias("start"), half.alias("duration"), (F.col("depth") + 1).alias("depth"))
    keep = [c for c in windows.columns if c not in ("label", "start", "duration", "depth")]
    return windows.select(*keep, F.inline(F.array(part("a", F.col("start")), part("b", F.col("start") + half))))


def sampled_starts(media: DataFrame, count: int, seconds: float, digits: int = 3, key: str = KEY) -> DataFrame:
    """``count`` evenly spaced starts, clear of both ends by min(60 s, 5 %)."""
    guard = F.least(F.lit(60.0), F.col("duration") * 0.05)
    room = F.greatest(F.lit(0.0), F.col("duration") - 2 * guard - seconds)
    rows = media.select(key, guard.alias("_g"), room.alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample"))
    step = F.col("_r") / (count - 1) if count > 1 else F.lit(0.0)
    return rows.select(key, "sample", F.round(F.col("_g") + F.col("sample") * step, digits).alias("start"))
