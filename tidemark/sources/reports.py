"""Recogniser reports as JSON: nested words and segments into rows, strict for our own cache, lenient for others'."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = "struct<start:string,end:string,word:string,text:string,probability:double>"
SEGMENT = f"struct<start:double,end:double,text:string,words:array<{WORD}>>"
REPORT = f"struct<schema_version:int,language:string,text:string,segments:array<{SEGMENT}>,words:array<{WORD}>>"
TOKENS = "struct<sentences:array<struct<start:double,end:double,text:string,tokens:array<struct<start:double,end:double,text:string,confidence:double>>>>>"


def parsed(df: DataFrame, content: str = "content") -> DataFrame:
    """df with ``report``: a dict of version 2 or none, or a bare list of segments (version 1)."""
    bare = F.from_json(content, f"array<{SEGMENT}>")
    listed = F.startswith(F.ltrim(F.col(content)), F.lit("["))
    whole = F.from_json(content, REPORT)
    old = F.struct(F.lit(1).alias("schema_version"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("text"), bare.alias("segments"), F.lit(None).cast(f"array<{WORD}>").alias("words"))
    return df.withColumn("report", F.when(listed, old.cast(REPORT)).otherwise(whole))


def segments(df: DataFrame, key: str = "path", strict: bool = False) -> DataFrame:
    """(key, pos, start, end, text); blank texts go. strict=True fails on a row without start, end or a span."""
    rows = df.select(key, F.posexplode("report.segments").alias("pos", "s")).select(key, "pos", "s.start", "s.end", F.trim("s.text").alias("text"))
    if strict:
        sound = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("text").isNotNull() & (F.col("end") > F.col("start"))
        rows = rows.where(F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("segment "), F.col("pos").cast("string"), F.lit(" is not sound")))))
    return rows.where("text <> ''")


def words(df: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, start, end, text, probability, source): the words of segments, else the top-level ones; bad words go."""
    inner = F.flatten(F.transform(F.coalesce("report.segments", F.array().cast(f"array<{SEGMENT}>")), lambda s: F.coalesce(s["words"], F.array().cast(f"array<{WORD}>"))))

    def good(list_):
        made = F.transform(list_, lambda w: F.struct(w["start"].try_cast("double").alias("start"), w["end"].try_cast("double").alias("end"), F.coalesce(w["word"], w["text"]).alias("text"), w["probability"].alias("probability")))
        return F.filter(made, lambda w: (w["end"] > w["start"]) & (F.trim(w["text"]) != ""))

    both = df.select(key, good(inner).alias("a"), good(F.coalesce("report.words", F.array().cast(f"array<{WORD}>"))).alias("b"))
    chosen = both.select(key, F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")).alias("w"), F.when(F.size("a") > 0, "segments").otherwise("top").alias("source"))
    return chosen.select(key, "source", F.posexplode("w").alias("pos", "x")).select(key, "pos", "x.*", "source")


def sub_words(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, sentence, pos, start, end, text, probability) of token reports: a token that begins with a blank begins a word."""
    rows = df.select(key, F.posexplode(F.from_json(content, TOKENS)["sentences"]).alias("sentence", "s")).select(key, "sentence", F.posexplode("s.tokens").alias("i", "t")).select(key, "sentence", "i", "t.*")
    by = Window.partitionBy(key, "sentence").orderBy("i")
    begins = ((F.col("i") == 0) | F.col("text").rlike(r"^\s")).cast("int")
    rows = rows.withColumn("pos", (F.sum(begins).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim("text").alias("x")))), lambda r: r["x"]), "")
    return rows.groupBy(key, "sentence", "pos").agg(F.min_by("start", "i").alias("start"), F.max_by("end", "i").alias("end"), text.alias("text"), F.avg("confidence").alias("probability")).where("text <> ''")


def voice_regions(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, start, end) of the voice tier, or of the plain region list."""
    kind = "array<struct<start:double,end:double>>"
    got = F.from_json(content, f"struct<tiers:struct<VAD:{kind}>,regions:{kind}>")
    return df.select(key, F.inline(F.coalesce(got["tiers"]["VAD"], got["regions"]))).where("end > start")


def chapters(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, start, title, description) of a reply that holds a JSON list, fenced or within other text; untitled ones go."""
    body = F.coalesce(F.nullif(F.regexp_extract(content, r"(?si)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col(content))
    rows = df.select(key, F.inline(F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), "array<struct<start_seconds:double,title:string,description:string>>")))
    return rows.where("start_seconds is not null and trim(title) <> ''").select(key, F.greatest(F.lit(0.0), F.col("start_seconds")).alias("start"), F.trim("title").alias("title"), F.trim(F.coalesce("description", F.lit(""))).alias("description"))


def ocr_cues(df: DataFrame, least_height: float = 0.018, least_confidence: float = 0.45) -> DataFrame:
    """Frames with ``text`` and mean confidence of the observations that can be a caption: top line first, then left to right."""
    ok = lambda o: (o["confidence"] >= least_confidence) & (o["height"] >= least_height) & (F.length(F.trim(o["text"])) >= 2)
    rows = df.withColumn("_o", F.array_sort(F.transform(F.filter("observations", ok), lambda o: F.struct((-o["y"]).alias("ny"), o["x"].alias("x"), F.trim(o["text"]).alias("t"), o["confidence"].alias("c")))))
    mean = F.when(F.size("_o") > 0, F.aggregate("_o", F.lit(0.0), lambda a, o: a + o["c"]) / F.size("_o"))
    return rows.withColumn("text", F.array_join(F.transform("_o", lambda o: o["t"]), "")).withColumn("confidence", mean).drop("_o")
