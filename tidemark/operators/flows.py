"""Flows over recogniser chunks: windows, the choice among attempts, rows put back on the media's time, seams stitched.

Tables: media (media_id, duration); attempts (media_id, chunk, attempt, language), one row for each finished recognition;
rows (media_id, chunk, attempt, pos, start, end, text) of those, in the chunk's own time; voice (media_id, chunk, voice,
length), the window of each chunk that holds speech. A chunk without a voice row is silent.

Retry and gate are joins: every attempt is judged on its own, the first that passes is taken. Chunks are independent rows
up to the end; what passes over a seam is stitched by summaries. Null texts and blank ones, and rows with a null time, go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import audit
from .folds import Merging, NearDuplicates, fold_rows

KEY = "media_id"
CHUNK = [KEY, "chunk"]


def overlapped_windows(media: DataFrame, chunk: float = 30.0, overlap: float = 2.0, leading: bool = True) -> DataFrame:
    """(media_id, chunk, start, duration, leading, trailing): a chunk every ``chunk`` seconds that also hears ``overlap`` seconds
    behind it and, with ``leading``, before it. A window that reaches the media's end has no trailing part to cut."""
    n = F.ceil(F.col("duration") / chunk).cast("int")
    rows = media.where("duration > 0").select(KEY, F.col("duration").alias("_all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    begin = F.col("chunk") * F.lit(float(chunk))
    lead = F.when(F.col("chunk") > 0, float(overlap)).otherwise(0.0) if leading else F.lit(0.0)
    rows = rows.select(KEY, "chunk", "_all", (begin - lead).alias("start"), lead.alias("leading"))
    rows = rows.withColumn("duration", F.least(F.lit(float(chunk + overlap)) + F.col("leading"), F.col("_all") - F.col("start")))
    trail = F.when(F.col("start") + F.col("duration") < F.col("_all"), float(overlap)).otherwise(0.0)
    return rows.select(KEY, "chunk", "start", "duration", "leading", trail.alias("trailing"))


def fixed_windows(media: DataFrame, chunk: float = 60.0) -> DataFrame:
    """(media_id, chunk, start, duration): chunks side by side, one at least."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / chunk)).cast("int")
    rows = media.where("duration is not null").select(KEY, F.col("duration").alias("_all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    start = F.col("chunk") * F.lit(float(chunk))
    return rows.select(KEY, "chunk", start.alias("start"), F.least(F.lit(float(chunk)), F.col("_all") - start).alias("duration"))


def chosen_attempts(windows: DataFrame, attempts: DataFrame, rows: DataFrame, voice: DataFrame | None = None) -> DataFrame:
    """(media_id, chunk, attempt, status, issue) of each window: the first attempt whose rows the table gate passes.

    status is ok or retried, unstable where no attempt passes, silent where there is no voice, missing where there is no
    attempt; issue is what the first attempt was refused for.
    """
    # The gate tells one table from another by media_id; here an attempt is such a table.
    whole = rows.select(F.struct(KEY, "chunk", "attempt").alias(KEY), "text")
    issues = audit.table_issue(whole).select(f"{KEY}.*", "issue")
    judged = attempts.select(*CHUNK, "attempt").join(issues, [*CHUNK, "attempt"], "left")
    passed = F.when(F.col("issue").isNull(), F.col("attempt"))
    best = judged.groupBy(*CHUNK).agg(F.min(passed).alias("attempt"), F.min("attempt").alias("_first"), F.min_by("issue", "attempt").alias("issue"))
    out = windows.select(*CHUNK).join(best, CHUNK, "left")
    if voice is not None:
        out = out.join(voice.select(*CHUNK).distinct().withColumn("_heard", F.lit(True)), CHUNK, "left")
    silent = F.col("_heard").isNull() if voice is not None else F.lit(False)
    status = F.when(silent, "silent").when(F.col("_first").isNull(), "missing").when(F.col("attempt").isNull(), "unstable").when(F.col("attempt") > F.col("_first"), "retried").otherwise("ok")
    good = status.isin("ok", "retried")
    return out.select(*CHUNK, F.when(good, F.col("attempt")).alias("attempt"), status.alias("status"), F.when(~silent, F.col("issue")).alias("issue"))


def _taken(windows: DataFrame, chosen: DataFrame, rows: DataFrame, voice: DataFrame | None) -> DataFrame:
    """Rows of the chosen attempts with their window's columns (``_start``, ``_duration``, ...) and ``_voice``."""
    own = windows.select(*CHUNK, *[F.col(c).alias(f"_{c}") for c in windows.columns if c not in CHUNK])
    met = rows.where("start is not null and `end` is not null").join(chosen.where("attempt is not null").select(*CHUNK, "attempt"), [*CHUNK, "attempt"]).join(own, CHUNK)
    if voice is None:
        return met.withColumns({"_voice": F.lit(0.0), "_length": F.lit(None).cast("double")})
    first = voice.groupBy(*CHUNK).agg(F.min_by(F.struct(F.col("voice").alias("_voice"), F.col("length").alias("_length")), "voice").alias("_v"))
    return met.join(first, CHUNK).select(*met.columns, "_v.*")


class Seams(NearDuplicates):
    """Near duplicates over what buckets leave open; a row with ``fresh`` never joins the one before it."""

    def joined(self, last, row):
        return None if row["fresh"] else super().joined(last, row)


class Bucket(Merging):
    """Near duplicates of one bucket. Rows of its first run of equal texts stay as they are, and its last row may grow: these
    are ``open``; a last row behind others is ``fresh``."""

    def __init__(self, within: float):
        super().__init__()
        self.rule, self.first, self.opening = NearDuplicates(within), None, True

    def take(self, row):
        if self.first is None:
            self.first = row["text"]
        self.opening = self.opening and row["text"] == self.first
        if self.opening:
            return [row | {"open": True, "fresh": False}]
        return [r | {"open": False, "fresh": False} for r in self.rule.take(row)]

    def close(self):
        return [r | {"open": True, "fresh": True} for r in self.rule.close()]


def near_duplicates(rows: DataFrame, within: float = 1.5, width: float = 30.0) -> DataFrame:
    """rows (media_id, start, end, text) with equal neighbours, in order of start and end, as one row where starts and ends
    lie ``within`` of it.

    Whether a row joins depends on the row made so far, but only inside a run of equal texts. Buckets of ``width`` seconds
    are folded on their own; of each only the first run and the last row can meet a neighbour, and those few alone are
    sorted by media and folded again.
    """
    rows = rows.select(KEY, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text")
    place = rows.withColumn("_bucket", F.struct(F.col(KEY).alias("m"), F.floor(F.col("start") / width).alias("b"))).withColumns({"open": F.lit(True), "fresh": F.lit(False)})
    one = fold_rows(place, lambda: Bucket(within), None, "_bucket", ("start", "end", "text"))
    # A bucket's last row may start long before the row of the next bucket, never after it; in its bucket it comes last.
    two = fold_rows(one.where("open").withColumn("_b", F.col("_bucket.b")), lambda: Seams(within), None, KEY, ("_b", "fresh", "start", "end", "text"))
    return one.where("not open").select(*rows.columns).unionByName(two.select(*rows.columns))


def overlapped_flow(media: DataFrame, attempts: DataFrame, rows: DataFrame, voice: DataFrame | None = None, chunk: float = 30.0, overlap: float = 2.0, leading: bool = True, merged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows (media_id, start, end, text) of all chunks, chosen attempts). A chunk's rows, which begin at its voice, are cut
    to the chunk without its overlaps and put on the media's time; what two chunks both have is one row (``merged``)."""
    windows = overlapped_windows(media, chunk, overlap, leading)
    chosen = chosen_attempts(windows, attempts, rows, voice)
    met = _taken(windows, chosen, rows, voice)
    whole = (F.col("_voice") <= 0.001) & (F.col("_length") >= F.col("_duration") - 0.001)
    offset = F.when(F.coalesce(whole, F.lit(False)), 0.0).otherwise(F.col("_voice"))
    low, high = F.col("_leading"), F.greatest(F.lit(0.0), F.col("_duration") - F.col("_trailing"))
    met = met.withColumns({"start": F.greatest(F.col("start") + offset, low), "end": F.least(F.col("end") + offset, high), "text": F.trim("text")})
    met = met.where("text <> '' and `end` > start")
    out = met.select(KEY, (F.col("start") + F.col("_start")).alias("start"), (F.col("end") + F.col("_start")).alias("end"), "text")
    return (near_duplicates(out, width=chunk) if merged else out), chosen


def trimmed_flow(windows: DataFrame, attempts: DataFrame, rows: DataFrame, voice: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows (media_id, chunk, pos, start, end, text), chosen attempts) for windows with ``leading`` and ``trailing`` parts:
    both ends clamped into the chunk without them, to the millisecond, texts single-spaced. An attempt after the first heard
    the whole chunk, so only the first one's rows are moved by the voice."""
    chosen = chosen_attempts(windows, attempts, rows, voice)
    met = _taken(windows, chosen, rows, voice)
    low, high = F.col("_leading"), F.greatest(F.lit(0.0), F.col("_duration") - F.col("_trailing"))
    offset = F.when(F.col("attempt") == 0, F.col("_voice")).otherwise(0.0)
    clamped = lambda c: F.bround(F.greatest(low, F.least(high, F.bround(F.col(c) + offset, 3))), 3)
    met = met.withColumns({"start": clamped("start"), "end": clamped("end"), "text": tx.single_spaced(F.col("text"))}).where("text <> '' and `end` > start")
    moved = lambda c: F.bround(F.col(c) + F.col("_start"), 3).alias(c)
    return met.select(*CHUNK, "pos", moved("start"), moved("end"), "text"), chosen


def fixed_flow(media: DataFrame, attempts: DataFrame, rows: DataFrame, voice: DataFrame, words: DataFrame | None = None, chunk: float = 60.0, early: float = 0.1, late: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, verdicts, words) of chunks side by side.

    A chunk's rows are clamped into it; its first one, where it starts by ``early`` though the voice starts at ``late`` or
    after, starts with the voice. verdicts (media_id, language, status, issue): the language of the last attempt that names
    one, silent chunks left out; status is ok, or unstable if a chunk is or if all rows together fail the gate.
    """
    windows = fixed_windows(media, chunk)
    chosen = chosen_attempts(windows, attempts, rows, voice)
    met = _taken(windows, chosen, rows, voice)
    first = F.row_number().over(Window.partitionBy(*CHUNK).orderBy("pos")) == 1
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.col("_duration"), F.col(c)))
    met = met.withColumn("_first", first).withColumns({"start": inside("start"), "end": inside("end")})
    snap = F.col("_first") & (F.col("start") <= early) & (F.col("_voice") >= late)
    met = met.withColumn("start", F.when(snap, F.least("end", "_voice")).otherwise(F.col("start"))).where("trim(text) <> '' and `end` > start")
    out = met.select(*CHUNK, "pos", (F.col("start") + F.col("_start")).alias("start"), (F.col("end") + F.col("_start")).alias("end"), "text")
    heard = attempts.join(chosen.where("status <> 'silent'").select(*CHUNK), CHUNK, "left_semi")
    named = heard.where("language <> ''").groupBy(KEY).agg(F.max_by("language", F.struct("chunk", "attempt")).alias("language"))
    refused = chosen.where("status = 'unstable'").groupBy(KEY).agg(F.min_by("issue", "chunk").alias("_chunk"))
    together = audit.table_issue(out).withColumnRenamed("issue", "_all")
    verdicts = media.select(KEY).join(named, KEY, "left").join(refused, KEY, "left").join(together, KEY, "left")
    issue: Column = F.coalesce("_chunk", "_all")
    verdicts = verdicts.select(KEY, F.coalesce("language", F.lit("")).alias("language"), F.when(issue.isNull(), "ok").otherwise("unstable").alias("status"), issue.alias("issue"))
    if words is None:
        return out, verdicts, None
    own = _taken(windows, chosen, words, voice)
    moved = lambda c: F.greatest(F.lit(0.0), F.col(c) + F.col("_start")).alias(c)
    return out, verdicts, own.select(*CHUNK, "pos", moved("start"), moved("end"), *[c for c in words.columns if c not in (*CHUNK, "attempt", "pos", "start", "end")])


def text_flow(media: DataFrame, texts: DataFrame, rows: DataFrame, chunk: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """(rows on the media's time, documents (media_id, chunks, rows, text)): texts (media_id, chunk, text) of long chunks side
    by side, a line each, chunks without text left out; rows (media_id, chunk, pos, start, end, text) moved by their chunk's
    start. Chunks that the media has no room for are not taken."""
    windows = fixed_windows(media, chunk)
    moved = rows.join(windows.select(*CHUNK, F.col("start").alias("_start")), CHUNK)
    at = lambda c: F.bround(F.col(c) + F.col("_start"), 3).alias(c)
    out = moved.select(*CHUNK, "pos", at("start"), at("end"), "text")
    parts = windows.select(*CHUNK).join(texts, CHUNK, "left").groupBy(KEY).agg(F.countDistinct("chunk").alias("chunks"), F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("chunk", "text")))).alias("_t"))
    joined = F.regexp_replace(F.array_join(F.transform("_t", lambda t: t["text"]), "\n"), r"\A\s+|\s+\z", "")
    n = out.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"))
    return out, parts.join(n, KEY, "left").select(KEY, "chunks", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), joined.alias("text"))
