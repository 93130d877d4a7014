"""Figures, orders and gates of reports: counts, medians, folder sizes, plans, searches, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "media_id"

#: Where burned-in subtitles are looked for, as shares of the duration. Fixed values.
PROBES = (0.01, 0.10, 0.30, 0.50, 0.70, 0.90, 0.98)


def counted(df: DataFrame, *by: str) -> DataFrame:
    """Rows of each value: differences by verdict, units by level."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def plan_totals(plan: DataFrame, key: str = KEY) -> DataFrame:
    """(key, windows, frames, median_seconds) of a sampling plan; the median of window lengths to three places."""
    return plan.groupBy(key).agg(F.count(F.lit(1)).alias("windows"), F.sum("frames").cast("long").alias("frames"), F.round(F.median(F.col("end") - F.col("start")), 3).alias("median_seconds"))


def cue_means(df: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cues, mean_characters, mean_seconds), to three places."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cues"), F.round(F.avg(F.length("text")), 3).alias("mean_characters"), F.round(F.avg(F.col("end") - F.col("start")), 3).alias("mean_seconds"))


def coverage_report(cues: DataFrame, frames: DataFrame, key: str = KEY) -> DataFrame:
    """How cues (coverage, confidence) and frames (text) of a media fared: rates, means, the median and the counts at 0.8 and 0.6.

    A media without frames has a rate of 0, one without cues has zeros.
    """
    six = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    seen = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.coalesce(F.trim("text") != "", F.lit(False))).alias("_hit"))
    told = cues.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg("confidence").alias("_c"), F.avg("coverage").alias("_a"), F.median("coverage").alias("_m"), F.count_if(F.col("coverage") >= 0.8).alias("_8"), F.count_if(F.col("coverage") >= 0.6).alias("_6"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return seen.join(told, key, "full").select(key, none("frames").alias("frames"), six(F.col("_hit") / F.col("frames")).alias("detection_rate"), none("_n").alias("cues"), six(F.col("_c")).alias("mean_confidence"), six(F.col("_a")).alias("mean_coverage"), six(F.col("_m")).alias("median_coverage"), none("_8").alias("at_least_80"), none("_6").alias("at_least_60"))


def mono_safe(df: DataFrame, keys: list[str], threshold: float, value: str = "suppression") -> DataFrame:
    """(keys, samples, median, mono_safe): whether the exact median reaches the threshold; null without values."""
    found = df.groupBy(*keys).agg(F.count(value).alias("samples"), F.median(value).alias("median"))
    return found.withColumn("mono_safe", F.col("median") >= threshold)


def folder_bytes(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """(folder, files, bytes) of every folder above a file, all levels below it counted. Partial sums before the shuffle."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.where(F.instr(F.col(path), "/") > 0).select(F.explode(F.array_distinct(above)).alias("folder"), size)
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes"))


def probe_positions(media: DataFrame, window: float, key: str = KEY) -> DataFrame:
    """(key, probe, start): windows around fixed shares of the duration, never before 0; probes count from 1."""
    rows = media.select(key, "duration", F.posexplode(F.array(*map(F.lit, PROBES))).alias("n", "share"))
    return rows.select(key, (F.col("n") + 1).alias("probe"), F.greatest(F.lit(0.0), F.col("duration") * F.col("share") - window / 2).alias("start"))


def first_regions(df: DataFrame, most: int, shortest: float = 0.5, key: str = KEY) -> DataFrame:
    """The ``most`` earliest regions of a media of those of at least ``shortest`` seconds (one round of repairs)."""
    by = Window.partitionBy(key).orderBy("start", "end", "pos")
    return df.where(F.col("end") - F.col("start") >= shortest).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def search(df: DataFrame, query: str = "", status: str = "") -> DataFrame:
    """Rows whose title and source hold the query, whatever its case, and that have the status; empty asks for nothing."""
    asked = query.strip().lower()
    found = df.where(F.contains(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source", F.lit("")))), F.lit(asked))) if asked else df
    return found.where(F.col("status") == status) if status else found


def asset_order(uploaded: Column) -> list[Column]:
    """Uploads first, then by name whatever its case."""
    return [(~F.coalesce(uploaded, F.lit(False))).asc(), F.lower("filename").asc()]


def tab_order() -> list[Column]:
    """The active tab of the front window, then the front window, then by window and tab; negative numbers come last."""
    number = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(10**6).asc()
    return [(~(F.col("front") & F.col("active"))).asc(), (~F.col("front")).asc(), number("window_no"), number("tab_no")]


def usable_caches(caches: DataFrame, wanted: DataFrame, quality: DataFrame, version: str, keys: list[str], schema_version: int = 2) -> DataFrame:
    """Caches whose signature is the wanted one (nulls are equal) and whose quality report is current."""
    current = quality.where((F.col("schema_version") == schema_version) & (F.col("pipeline_version") == version)).select(*keys).distinct()
    want = wanted.select(*keys, F.col("signature").alias("_want")).distinct()
    same = caches.join(want, keys).where(F.col("signature").eqNullSafe(F.col("_want"))).select(*caches.columns)
    return same.join(current, keys, "left_semi")


def without_derived(files: DataFrame, rebuilt: DataFrame, patterns: list[str], keys: list[str], name: str = "name") -> DataFrame:
    """Files left when the raw results of ``rebuilt`` were made anew: what matches a LIKE pattern there goes."""
    derived = F.lit(False)
    for pattern in patterns:
        derived = derived | F.col(name).like(pattern)
    hit = rebuilt.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return files.join(hit, keys, "left").where(~(F.coalesce("_hit", F.lit(False)) & F.coalesce(derived, F.lit(False)))).select(*files.columns)


def digest(*parts: Column, size: int = 24) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts, one after the other; null parts are empty."""
    return F.substring(F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def short_digest(text: Column, size: int = 12) -> Column:
    """The first hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(text), 1, size)


def break_set(breaks: Column, n: Column) -> Column:
    """Distinct breaks inside (0, n), in order."""
    return F.array_sort(F.array_distinct(F.filter(breaks, lambda b: (b > 0) & (b < n))))


def is_ascii_word(char: Column) -> Column:
    return F.regexp_like(char, F.lit(r"\A[A-Za-z0-9]\z"))


def after_boundary(text: Column, marks: Column, boundary: Column) -> Column:
    """The text between a kept character and the next one; marks has the places of kept characters, counted from 0."""
    begin = F.try_element_at(marks, boundary) + 1
    end = F.coalesce(F.try_element_at(marks, boundary + 1), F.length(text))
    return F.when(boundary <= 0, "").otherwise(F.substring(text, begin + 1, end - begin))


def punctuated(text: Column, marks: Column, boundary: Column, punctuation: str) -> Column:
    """Whether one of the characters of a boundary, the kept one included, is in the given set."""
    kept = F.substring(text, F.try_element_at(marks, F.greatest(boundary, F.lit(1))) + 1, F.lit(1))
    seen = F.concat(kept, after_boundary(text, marks, boundary))
    return (boundary > 0) & (F.length(F.translate(seen, punctuation, "")) < F.length(seen))
