"""Markdown, JSON and CSV documents of chapters, transcripts and comments, and their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a comment table, in order. Fixed values.
COMMENT_COLUMNS = ("index", "depth", "bvid", "aid", "title", "source_comment_count", "exported_root_count", "exported_reply_count", "root_rpid", "parent_rpid", "rpid", "author_mid", "author_name", "like", "reply_count", "ctime", "send_date", "send_datetime", "message")

#: Headings that stand before the body. Fixed values.
HEADINGS = ("## Transcript", "## Segmented Transcript")


def _lines(df: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(key).agg(F.transform(rows, lambda x: x["_line"]).alias("_lines"))


def stamp(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, rounded down."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def chapters_json(df: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, document): an array of start_seconds, title and description in order of start."""
    one = F.struct(F.col("start").alias("start_seconds"), "title", F.coalesce("description", F.lit("")).alias("description"))
    return _lines(df, key, ["start", "title"], one).select(key, F.to_json("_lines").alias("document"))


def chapters_markdown(df: DataFrame, heading: str, key: str = "media_id") -> DataFrame:
    """(key, document): a heading, then each chapter with its stamp and, where it has one, its description."""
    told = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n"), "description", F.lit("\n"))).otherwise("")
    one = F.concat(F.lit("## ["), stamp(F.col("start")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), told)
    body = F.concat(F.lit(f"# {heading}\n\n"), F.array_join("_lines", "\n"))
    return _lines(df, key, ["start", "title"], one).select(key, F.concat(F.regexp_replace(body, r"\s+\z", ""), F.lit("\n")).alias("document"))


def inline(text: Column) -> Column:
    """Backslashes and backticks escaped."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\`])", r"\\$1")


def transcript_markdown(title: Column, facts: dict[str, Column], paragraphs: Column, segmented: bool = False, style: str = "") -> Column:
    """A document of a title, its facts as a list (null ones left out) and its paragraphs; segmented=True takes the paragraphs
    as one body. ``style`` is what stands before the title."""
    told = F.array_compact(F.array(*[F.concat(F.lit(f"- {name}: `"), F.when(value.isNotNull(), inline(value)), F.lit("`")) for name, value in facts.items()]))
    head = F.concat(F.lit(f"{style}\n\n# " if style else "# "), F.coalesce(title, F.lit("")), F.lit("\n\n## Metadata\n\n"), F.array_join(told, "\n"))
    body = F.array_join(paragraphs, "\n\n")
    tail = F.lit("\n") if segmented else F.when(body == "", "").otherwise("\n\n")
    return F.concat(head, F.lit(f"\n\n{HEADINGS[segmented]}\n\n"), body, tail)


def body(document: Column) -> Column:
    """What follows the first known heading, trimmed; without one the whole document. Null stays null."""
    out = document
    for heading in reversed(HEADINGS):  # the first heading is asked last, so that it wins
        mark = f"\n{heading}\n"
        out = F.when(F.contains(document, F.lit(mark)), F.substring(document, F.instr(document, mark) + len(mark), F.length(document))).otherwise(out)
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def body_or_error(document: Column, heading: str = HEADINGS[0]) -> Column:
    """What follows the heading; an error where the heading or the text after it is missing."""
    mark = f"{heading}\n"
    at = F.instr(document, mark)
    text = F.regexp_replace(F.substring(document, at + len(mark), F.length(document)), r"\A\s+|\s+\z", "")
    return F.when((at > 0) & (text != ""), text).otherwise(F.raise_error(F.lit(f"no text after {heading}")).cast("string"))


def comments_markdown(df: DataFrame, heads: DataFrame, key: str = "aid") -> DataFrame:
    """(key, document): title and counts of ``heads`` (key, title, bvid, comments), then comments in order of index; replies
    are indented. Authors without a name are told by their number, else as unknown."""
    known = lambda c: F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(""))
    pad = F.when(F.coalesce("depth", F.lit(0)) == 0, "").otherwise("  ")
    bullet = F.when(F.coalesce("depth", F.lit(0)) == 0, "- **").otherwise("    - **")
    message = F.regexp_replace(F.coalesce("message", F.lit("")), "\n", F.concat(F.lit("\n"), pad, F.lit("  ")))
    like = F.coalesce(F.col("like"), F.lit(0)).cast("string")
    one = F.concat(bullet, F.coalesce(known("author_name"), known("author_mid"), F.lit("unknown")), F.lit("** · "), F.coalesce("send_datetime", F.lit("")), F.lit(" · "), like, F.lit(" likes · rpid `"), F.coalesce(F.col("rpid").cast("string"), F.lit("")), F.lit("`\n"), pad, F.lit("  "), message, F.lit("\n"))
    rows = heads.join(_lines(df, key, ["index"], one), key, "left")
    fact = lambda name, c: F.concat(F.lit(f"- {name}: `"), F.coalesce(c.cast("string"), F.lit("")), F.lit("`\n"))
    n = F.greatest(F.lit(0), F.coalesce(F.size("_lines"), F.lit(0)))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), fact("BVID", F.col("bvid")), fact("AID", F.col(key)), fact("Source comments", F.col("comments")), fact("Exported comments", n))
    return rows.select(key, F.concat(head, F.when(n > 0, F.concat(F.lit("\n"), F.array_join("_lines", "\n"))).otherwise("")).alias("document"))


def write_comments_csv(df: DataFrame, path: str) -> None:
    """All comment columns as CSV with a header; quotes are doubled."""
    df.select(*COMMENT_COLUMNS).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def read_comments_csv(spark: SparkSession, path: str) -> DataFrame:
    """The columns as text, with line ends inside messages; missing values are empty."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.na.fill("")


def evidence_lines(df: DataFrame, label: str = "证据", key: str = "media_id") -> DataFrame:
    """(key, document): rows in order of pos as numbered lines with minutes and seconds, hours counted as minutes."""
    minutes = lambda r, c: F.format_string("%02d:%02d", F.floor(F.greatest(F.lit(0.0), r[c]) / 60).cast("long"), F.floor(F.greatest(F.lit(0.0), r[c]) % 60).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text")))
    line = F.transform("rows", lambda r, i: F.concat(F.lit(f"[{label}"), (i + 1).cast("string"), F.lit(" "), minutes(r, "start"), F.lit("-"), minutes(r, "end"), F.lit("] "), F.coalesce(r["text"], F.lit(""))))
    return df.groupBy(key).agg(rows.alias("rows")).select(key, F.array_join(line, "\n").alias("document"))
