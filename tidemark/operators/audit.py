"""Quality audit of transcripts: the single rules, their union, and the verdict per media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import intervals as iv

KEY = "media_id"


def row_findings(df: DataFrame) -> DataFrame:
    """(media_id, pos, start, end, reason) of rows that are too sparse, too fast or too long."""
    span = F.col("end") - F.col("start")
    size = tx.compact_length(F.col("text"))
    fast = F.when(tx.is_cjk(F.col("text")), 24.0).otherwise(30.0)
    reasons = F.array_compact(
        F.array(
            F.when((span >= 6.0) & (size / span < 1.5), "low text density"),
            F.when((span > 0) & (size / span > fast), "abnormal cps"),
            F.when(span > 5.25, "long cue"),
        )
    )
    return df.select(KEY, "pos", "start", "end", F.explode(reasons).alias("reason"))


def order_findings(df: DataFrame) -> DataFrame:
    """Rows that start before the row before them (by pos) starts or ends."""
    by = Window.partitionBy(KEY).orderBy("pos")
    rows = df.withColumn("_s", F.lag("start").over(by)).withColumn("_e", F.lag("end").over(by))
    reason = F.when(F.col("start") < F.col("_s"), "reverse timestamp").when(F.col("start") < F.col("_e"), "overlapping timestamp")
    end = F.when(F.col("start") < F.col("_s"), F.col("end")).otherwise(F.col("_e"))
    return rows.select(KEY, "pos", "start", end.alias("end"), reason.alias("reason")).where("reason is not null")


def global_repetition(df: DataFrame, least: int = 8, share: float = 0.3) -> DataFrame:
    """Media where one text fills ``share`` of at least ``least`` rows."""
    inside = tx.phrase_filled(df.select(KEY, "text")).select(KEY).distinct().withColumn("_inside", F.lit(True))
    texts = df.where(F.trim("text") != "").groupBy(KEY, tx.compact(F.col("text")).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"))
    got = texts.groupBy(KEY).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.max("end").alias("end"))
    got = got.where((F.col("total") >= least) & (F.col("most") >= least) & (F.col("most") / F.col("total") >= share))
    return got.select(KEY, F.lit(-1).cast("long").alias("pos"), F.lit(0.0).alias("start"), "end", F.lit("repetition hallucination").alias("reason"))


def local_repetition(df: DataFrame, ahead: int = 4, seconds: float = 6.0, hits: int = 2, letters: int = 4) -> DataFrame:
    """Rows whose text comes back ``hits`` times among the next ``ahead`` rows within ``seconds``."""
    by = Window.partitionBy(KEY).orderBy("start", "end", "pos").rowsBetween(1, ahead)
    rows = df.withColumn("_t", tx.letters_and_digits(F.col("text")))
    rows = rows.withColumn("_next", F.collect_list(F.struct("start", "end", F.col("_t").alias("t"))).over(by))
    near = F.filter("_next", lambda x: (x["start"] - F.col("start") <= seconds) & (x["t"] == F.col("_t")))
    rows = rows.withColumn("_near", near).where((F.length("_t") >= letters) & (F.size("_near") >= hits))
    return rows.select(KEY, "pos", "start", F.element_at("_near", -1)["end"].alias("end"), F.lit("local repetition hallucination").alias("reason"))


def span_mismatch(segments: DataFrame, words: DataFrame, slack: float = 1.0) -> DataFrame:
    """Media whose words and segments (first and last by pos) begin or end more than ``slack`` seconds apart."""
    ends = lambda df, p: df.groupBy(KEY).agg(F.min_by("start", "pos").alias(f"{p}_s"), F.max_by("end", "pos").alias(f"{p}_e"))
    both = ends(segments, "s").join(ends(words, "w"), KEY)
    both = both.where((F.abs(F.col("s_s") - F.col("w_s")) > slack) | (F.abs(F.col("s_e") - F.col("w_e")) > slack))
    return both.select(KEY, F.lit(-1).cast("long").alias("pos"), F.least("s_s", "w_s").alias("start"), F.greatest("s_e", "w_e").alias("end"), F.lit("word/segment span mismatch").alias("reason"))


def low_confidence(words: DataFrame, least: float = 0.35) -> DataFrame:
    rows = words.where(F.col("probability") < least)
    return rows.select(KEY, "pos", "start", "end", F.lit("low word confidence").alias("reason"))


def uncovered_speech(speech: DataFrame, segments: DataFrame, slack: float = 0.6) -> DataFrame:
    got = iv.covered_seconds(speech.select(KEY, "pos", "start", "end"), segments.where(F.trim("text") != ""))
    got = got.where(F.col("end") - F.col("start") - F.col("covered") > slack)
    return got.select(KEY, "pos", "start", "end", F.lit("unexplained speech").alias("reason"))


def status(uncovered: Column, suspicious: Column, warnings: Column) -> Column:
    return F.when((uncovered > 0) | (suspicious > 0), "incomplete_speech_coverage").when(warnings > 0, "passed_with_warnings").otherwise("passed")


def findings(segments: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """All suspicious regions with their reasons, before they are merged."""
    found = row_findings(segments).unionByName(order_findings(segments)).unionByName(global_repetition(segments)).unionByName(local_repetition(segments))
    return found if words is None else found.unionByName(span_mismatch(segments, words)).unionByName(low_confidence(words))


def audit_regions(segments: DataFrame, speech: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(media_id, kind, region, start, end, reason): the merged regions that the audit counts."""
    kinds = {"suspicious": findings(segments, words), "uncovered": uncovered_speech(speech, segments)}
    one, two = (iv.merge_regions(rows, guard=0.0).withColumn("kind", F.lit(kind)) for kind, rows in kinds.items())
    return one.unionByName(two).select(KEY, "kind", "region", "start", "end", "reason")


def audit(segments: DataFrame, speech: DataFrame, words: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """(media_id, speech_coverage, uncovered, suspicious, status): region counts after merging, one row a media.

    ``warnings`` has a row (media_id) for each warning; they tell only where no region is found.
    """
    suspicious = iv.merge_regions(findings(segments, words), guard=0.0).groupBy(KEY).agg(F.count(F.lit(1)).alias("suspicious"))
    open_ = iv.merge_regions(uncovered_speech(speech, segments), guard=0.0).groupBy(KEY).agg(F.count(F.lit(1)).alias("uncovered"))
    span = F.col("end") - F.col("start")
    cover = iv.covered_seconds(speech.select(KEY, "pos", "start", "end"), segments.where(F.trim("text") != ""))
    cover = cover.groupBy(KEY).agg(F.least(F.lit(1.0), F.when(F.sum(span) <= 0, 1.0).otherwise(F.sum("covered") / F.sum(span))).alias("c"))
    media = segments.select(KEY).unionByName(speech.select(KEY)).distinct()
    out = media.join(cover, KEY, "left").join(open_, KEY, "left").join(suspicious, KEY, "left")
    u, s, w = F.coalesce("uncovered", F.lit(0)), F.coalesce("suspicious", F.lit(0)), F.lit(0)
    if warnings is not None:
        out = out.join(warnings.groupBy(KEY).agg(F.count(F.lit(1)).alias("_warned")), KEY, "left")
        w = F.coalesce("_warned", F.lit(0))
    return out.select(KEY, F.coalesce("c", F.lit(1.0)).alias("speech_coverage"), u.alias("uncovered"), s.alias("suspicious"), status(u, s, w).alias("status"))


def table_issue(df: DataFrame, rows: int = 20, many: int = 40) -> DataFrame:
    """(media_id, issue) where a phrase fills a row, one text fills a long transcript, or few texts make it up; null issues are
    left out."""
    inside = tx.phrase_filled(df.select(KEY, "text")).select(KEY).distinct().withColumn("_inside", F.lit(True))
    texts = df.where(F.trim("text") != "").groupBy(KEY, tx.single_spaced(F.col("text")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    got = texts.groupBy(KEY).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    got = got.join(inside, KEY, "left")
    issue = F.when(F.col("_inside"), "phrase in a row").when(F.col("total") < rows, None).when((F.col("most") >= 8) & (F.col("most") / F.col("total") >= 0.3), "one phrase").when((F.col("total") >= many) & (F.col("kinds") / F.col("total") <= 0.12), "few texts")
    return got.select(KEY, issue.alias("issue")).where("issue is not null")


def bad_chunk(df: DataFrame, media: DataFrame, stutters: bool = True) -> DataFrame:
    """(media_id, bad): sparse, drawn-out, gapped or (``stutters``) stuttering chunks of 20 seconds or more; an empty one is bad."""
    by = Window.partitionBy(KEY).orderBy("pos")
    span, size = F.col("end") - F.col("start"), tx.compact_length(F.col("text"))
    rows = df.withColumn("_gap", F.col("start") - F.lag("end").over(by)).withColumn("_slow", (span >= 6.0) & (size >= 2) & (size / span < 1.5))
    got = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), (F.max("end") - F.min("start")).alias("span"), F.sum(F.length(F.trim("text"))).alias("chars"),
        F.max(F.coalesce("_gap", F.lit(0.0))).alias("gap"), F.max("_slow").alias("slow"), F.trim(F.max_by("text", "pos")).alias("last"),
    )
    got = media.join(got, KEY, "left")
    tail = F.split("last", r"\s+")
    stutter = (F.length("last") > 30) & (F.size(tail) >= 6) & (F.size(F.array_distinct(F.slice(tail, F.greatest(F.lit(1), F.size(tail) - 5), 6))) <= 2)
    doubled = (F.length("last") > 30) & F.exists(F.slice(tail, 1, 6), lambda w: (w != "") & F.contains(F.col("last"), F.concat(w, w)))
    sparse = (F.col("n") <= 2) & (F.col("span") < F.col("duration") * 0.25) & (F.col("chars") < 40)
    bad = F.when(F.col("duration") < 20, False).when(F.col("n").isNull(), True).otherwise(sparse | F.col("slow") | (F.col("gap") >= 6.0) | (F.lit(stutters) & (stutter | doubled)))
    return got.select(KEY, bad.alias("bad"))


def text_score(df: DataFrame) -> DataFrame:
    """(media_id, score): fewer replacement characters, then fewer repeats of the row before, then more text."""
    by = Window.partitionBy(KEY).orderBy("pos")
    flat = tx.compact(F.col("text"))
    rows = df.withColumn("_same", (F.trim("text") == F.trim(F.lag("text").over(by))).cast("int"))
    return rows.groupBy(KEY).agg(F.struct((-F.sum(F.length(flat) - F.length(F.replace(flat, F.lit("�"), F.lit(""))))).alias("damage"), (-F.sum(F.coalesce("_same", F.lit(0)))).alias("repeats"), F.sum(F.length(flat)).alias("chars")).alias("score"))


def better_of(rows: DataFrame, review: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """The review's rows for media where it scores as well or better, the rows elsewhere. ``bad`` (media_id): reviews that no
    score saves. A media that only one side has keeps that side's rows, but for a bad review."""
    if bad is not None:
        review = review.join(bad.select(KEY).distinct(), KEY, "left_anti")
    both = text_score(rows).join(text_score(review).withColumnRenamed("score", "_new"), KEY, "full")
    adopted = both.where("score is null or _new >= score").select(KEY)
    return rows.join(adopted, KEY, "left_anti").unionByName(review.join(adopted, KEY, "left_semi"))


def pinned_language(df: DataFrame, threshold: float = 0.65, speech: float = 30.0) -> DataFrame:
    """(media_id, language): the first observation (by pos) that is sure enough, or made after enough speech.

    Without a confidence, 6 seconds of speech count as certain.
    """
    by = Window.partitionBy(KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.coalesce("confidence", F.when(F.col("speech_seconds") >= 6.0, 1.0)) >= threshold
    rows = df.withColumn("_heard", F.sum(F.greatest(F.lit(0.0), F.col("speech_seconds"))).over(by))
    hit = (F.coalesce("language", F.lit("")) != "") & (F.coalesce(sure, F.lit(False)) | (F.col("_heard") >= speech))
    return rows.groupBy(KEY).agg(F.min_by(F.when(hit, F.col("language")), F.when(hit, F.col("pos"))).alias("language"))


def merged_adjacent(df: DataFrame, gap: float = 1.5, normal: Column | None = None, least: int = 0) -> DataFrame:
    """Neighbours of equal text at most ``gap`` after the running end as one row (the first text); texts of fewer than
    ``least`` characters stay apart."""
    by = Window.partitionBy(KEY).orderBy("start", "end", "pos")
    rows = df.withColumn("_t", tx.single_spaced(F.col("text")) if normal is None else normal)
    run = rows.withColumn("_new", ((F.col("_t") != F.lag("_t").over(by)) | F.lag("_t").over(by).isNull() | (F.length("_t") < least)).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(KEY, "_run").orderBy("start", "end", "pos")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    parts = run.withColumn("_cut", (F.col("start") - reach > gap).cast("int")).withColumn("_part", F.sum(F.coalesce("_cut", F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = parts.groupBy(KEY, "_run", "_part").agg(F.min_by("pos", F.struct("start", "end", "pos")).alias("pos"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("text", F.struct("start", "end", "pos")).alias("text"), F.count(F.lit(1)).alias("merged"))
    return out.drop("_run", "_part")
