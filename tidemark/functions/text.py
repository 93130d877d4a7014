"""Column functions over text. All stay in the JVM but for those at the end, which need Unicode tables that Spark lacks."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from functools import lru_cache
from itertools import compress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ideographs that count as such.
CJK = "一-鿿"
CJK_WIDE = "㐀-鿿"
#: Characters that need no space before them.
CLOSING = "，。！？、；：,.!?;:)"


def compact(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"\s+", "")


def compact_length(text: Column) -> Column:
    return F.length(compact(text))


def is_cjk(text: Column) -> Column:
    """A third or more ideographs, and at least one."""
    n = compact_length(text)
    return (n > 0) & (F.length(F.regexp_replace(text, f"[^{CJK}]", "")) >= F.greatest(F.lit(1), F.floor(n / 3)))


def letters_and_digits(text: Column) -> Column:
    """Lower-cased letters and digits of any script."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def ascii_and_ideographs(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[^0-9a-z{CJK_WIDE}]+", "")


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_event_label(text: Column) -> Column:
    """A bracketed remark of up to 24 characters."""
    return F.trim(text).rlike(r"^[(\[（【][^)\]）】]{1,24}[)\]）】]$")


def unbalanced_wrappers(text: Column) -> Column:
    """An opening mark without its closing one, or the other way round."""
    found = F.lit(False)
    for a, b in ("()", "[]", "（）", "《》", "“”", "「」"):
        count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
        found = found | (count(a) != count(b))
    return found


def without_thoughts(text: Column) -> Column:
    """Think blocks cut out; the text itself where nothing else is left."""
    cut = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    return F.when(cut != "", cut).otherwise(text)


def without_protocol(text: Column) -> Column:
    """Single-spaced, without the recogniser's marker and the language tag before it."""
    flat = single_spaced(text)
    return single_spaced(F.regexp_replace(flat, r"(?i)(?:\blanguage\s+[\w-]+\s*)?<asr_text>\s*", " "))


def spaced_cjk(text: Column) -> Column:
    """Line ends and blanks put right, a space between scripts, wide punctuation after ideographs."""
    t = F.trim(F.regexp_replace(text, r"\r\n?", "\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, f"([{CJK}])([A-Za-z0-9@#&%])", "$1 $2")
    t = F.regexp_replace(t, f"([A-Za-z0-9@#&%])([{CJK}])", "$1 $2")
    for narrow, wide in ((",", "，"), ("\\.", "。"), ("\\?", "？"), ("!", "！"), (":", "："), (";", "；")):
        t = F.regexp_replace(t, f"([{CJK}]){narrow}", f"$1{wide}")
    return t


def file_title(title: Column, fallback: str = "item") -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(title, r'[\\/:*?"<>|]+', "_")), r"^\.+|\.+$", "")
    t = F.trim(F.substring(F.regexp_replace(t, r"\s+", " "), 1, 120))
    return F.when(t != "", t).otherwise(fallback)


def file_name(value: Column, fallback: str = "job") -> Column:
    t = F.regexp_replace(F.regexp_replace(value, r'[\\/:*?"<>|\x00-\x1f]+', "-"), r"^[ .-]+|[ .-]+$", "")
    return F.substring(F.when(t != "", t).otherwise(fallback), 1, 120)


def clock(seconds: Column, rounded: bool = True) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    total = F.greatest(F.lit(0), (F.bround(seconds) if rounded else F.floor(seconds)).cast("long"))
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    short = F.format_string("%02d:%02d", m, s)
    return F.when(h > 0, F.concat(F.format_string("%02d:", h), short)).otherwise(short)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; half-even milliseconds, negative times are 0."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_seconds(stamp: Column) -> Column:
    part = lambda i: F.get(F.split(stamp, "[:,]"), i).cast("double")
    return part(0) * 3600 + part(1) * 60 + part(2) + part(3) / 1000


def vtt_seconds(stamp: Column) -> Column:
    """MM:SS or HH:MM:SS; the digits after the point are read as milliseconds, so .5 is 5 ms."""
    main, rest = F.split_part(stamp, F.lit("."), F.lit(1)), F.split_part(stamp, F.lit("."), F.lit(2))
    fields = F.split(main, ":")
    whole = F.aggregate(fields, F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
    return whole + F.coalesce(F.substring(rest, 1, 3).try_cast("double"), F.lit(0.0)) / 1000


def masked(secret: Column) -> Column:
    """The first and last ten characters of a long secret, the length of a short one."""
    n = F.length(secret)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "not saved").when(n <= 24, F.format_string("saved (%d characters)", n)).otherwise(F.concat(F.substring(secret, 1, 10), F.lit("..."), F.substring(secret, -10, 10)))


def numbered_lines(reply: Column, expected: Column) -> Column:
    """map<int, string> of a reply's numbered lines from 0, the later of equal numbers; by position where none is numbered
    and the count is as expected."""
    lines = F.filter(F.transform(F.split(reply, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    pattern = r"^(\d+)\s*[:：.]\s*(.*)$"
    marked = F.filter(lines, lambda x: x.rlike(pattern))
    plain = F.filter(lines, lambda x: ~x.rlike(pattern) & ~x.rlike(r"(?i)^(Whisper|Native|Final|Output)\s*[:=]"))
    pairs = F.transform(marked, lambda x: F.struct((F.regexp_extract(x, pattern, 1).cast("int") - 1).alias("k"), F.trim(F.regexp_extract(x, pattern, 2)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    by_place = F.transform(plain, lambda x, i: F.struct(i.alias("k"), x.alias("v")))
    nothing = F.slice(by_place, 1, 0)
    return F.map_from_entries(F.when(F.size(pairs) > 0, last).when(F.size(plain) == expected, by_place).otherwise(nothing))


def dominant_phrase(text: Column) -> Column:
    """struct(phrase, count, parts) where one short phrase fills a long text, else null."""
    flat = single_spaced(text)
    parts = F.array_remove(F.split(flat, r"[，,。！？!?；;、\s]+"), "")
    # What fills over half of the parts stands in the middle once they are sorted.
    phrase = F.get(F.sort_array(parts), F.floor(F.size(parts) / 2).cast("int"))
    n = F.size(parts) - F.size(F.array_remove(parts, phrase))
    hit = (F.length(flat) >= 160) & (F.size(parts) >= 12) & (F.length(phrase) <= 24) & (n >= 8) & (n / F.size(parts) >= 0.6)
    return F.when(hit, F.struct(phrase.alias("phrase"), n.alias("count"), F.size(parts).alias("parts")))


def phrase_filled(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text has a ``dominant_phrase``. A filter would split and sort a text anew for each of its conditions; an
    explode of one value makes it once."""
    once = lambda rows, name, c: rows.withColumn(name, F.explode(F.array(c)))
    rows = once(df, "_flat", single_spaced(F.col(text))).where(F.length("_flat") >= 160)
    rows = once(rows, "_parts", F.array_remove(F.split("_flat", r"[，,。！？!?；;、\s]+"), "")).where(F.size("_parts") >= 12)
    size = F.size("_parts")
    rows = once(rows, "_phrase", F.get(F.sort_array("_parts"), F.floor(size / 2).cast("int"))).where(F.length("_phrase") <= 24)
    rows = once(rows, "_n", size - F.size(F.array_remove("_parts", F.col("_phrase"))))
    return rows.where((F.col("_n") >= 8) & (F.col("_n") / size >= 0.6)).select(*df.columns)


def sanitized(text: Column) -> Column:
    """struct(text, reason): the text without protocol marks; where one short phrase fills it, nothing but that as reason."""
    clean = without_protocol(text)
    fills = dominant_phrase(clean)
    reason = F.when(fills.isNotNull(), F.format_string("%s x %d of %d", fills["phrase"], fills["count"], fills["parts"]))
    return F.struct(F.when(reason.isNotNull(), "").otherwise(clean).alias("text"), reason.alias("reason"))


def outer_object(reply: Column) -> Column:
    """From the first opening brace to the last closing one, thinking marks left out; a reply without such a span as it is."""
    bare = F.regexp_replace(reply, "</?think>", "")
    span = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(span != "", span).otherwise(bare)


#: Beginnings of a recogniser's own log lines.
LOG_MARKS = ("whisper_", "ggml_", "main:", "system_info")


def caption(line: Column) -> Column:
    """The text of a stamped line, or a line that isn't a log line; else the empty text."""
    flat = F.regexp_replace(F.coalesce(line, F.lit("")), r"\A\s+|\s+\z", "")
    stamped = r"\A\[[^\]]+\]\s*"
    log = flat.rlike(r"\A(?:" + "|".join(LOG_MARKS) + ")")
    return F.when(flat.rlike(stamped), F.regexp_replace(flat, stamped, "")).when(log, "").otherwise(flat)


@F.pandas_udf(T.StringType())
def html_unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


#: What counts in a comparison: letters and digits of any script, and ideographs.
KEPT = re.compile(r"[^\W_]|[㐀-鿿]")
ASCII_LEFT = re.compile(r"[^0-9a-z]+")
_NOT_KEPT = re.compile(r"(?![㐀-鿿])[^\w\s]|_")


def _aligned(text: str) -> str:
    return " ".join(_NOT_KEPT.sub("", unicodedata.normalize("NFKC", text).lower()).split())


@F.pandas_udf(T.StringType())
def alignment_text(text: pd.Series) -> pd.Series:
    """NFKC, lower case, letters and digits; punctuation leaves no space, runs of white space leave one."""
    return text.map(_aligned, na_action="ignore")


@F.pandas_udf(T.StringType())
def transcript_text(text: pd.Series) -> pd.Series:
    """NFKC, lower case, without white space and punctuation."""
    keep = lambda c: not c.isspace() and not unicodedata.category(c).startswith("P")
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).lower() if keep(c)), na_action="ignore")


@lru_cache(maxsize=1 << 16)
def _kept_form(c: str) -> str:
    """The letters and digits that NFKC and lower case make of a character."""
    return "".join(KEPT.findall(unicodedata.normalize("NFKC", c).lower()))


def character_map(text: str) -> tuple[list[str], list[int]]:
    """Normalised characters and, for each, the place in the text that it comes from."""
    forms = list(map(_kept_form, text))
    chars, places = list("".join(forms)), list(compress(range(len(forms)), forms))
    if len(places) < len(chars):  # some character makes more than one
        places = [i for i, form in enumerate(forms) for _ in form]
    return chars, places


def kept_text(text: str) -> str:
    """The normalised characters of ``character_map`` as one text."""
    return ASCII_LEFT.sub("", text.lower()) if text.isascii() else "".join(map(_kept_form, text))


@F.pandas_udf(T.StructType().add("chars", T.ArrayType(T.StringType())).add("places", T.ArrayType(T.IntegerType())))
def characters(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([character_map(t or "") for t in text], columns=["chars", "places"])


@F.pandas_udf(T.StringType())
def text_leaves(content: pd.Series) -> pd.Series:
    """The texts of all objects of type text in a JSON reply (of its steps, where it has them), a line each, in order.
    What isn't JSON, and null, has none."""

    def leaves(raw):
        try:
            whole = json.loads(raw) if raw else None
        except ValueError:
            return ""
        open_, told = [whole.get("steps", whole) if isinstance(whole, dict) else whole], []
        while open_:
            node = open_.pop()
            if isinstance(node, dict) and node.get("type") == "text" and isinstance(node.get("text"), str):
                told.append(node["text"])
            elif isinstance(node, (dict, list)):
                open_ += reversed(node if isinstance(node, list) else list(node.values()))
        return "\n".join(told).strip()

    return content.map(leaves, na_action=None).astype("object")
