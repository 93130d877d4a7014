"""Column functions over media URLs and cache names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that hold no media, and hosts that do.
REFUSED_HOSTS = ("docs.github.com", "github.com", "wikipedia.org", "google.com", "stackoverflow.com", "reddit.com", "twitter.com", "x.com")
MEDIA_HOSTS = ("youtube.com", "youtu.be", "bilibili.com", "b23.tv", "vimeo.com", "twitch.tv", "dailymotion.com", "instagram.com", "tiktok.com", "rumble.com", "odysee.com")


def host(url: Column) -> Column:
    """Lower-cased, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    """The first non-empty value of a query parameter, else empty."""
    query = F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)
    return F.regexp_extract(query, f"(?:^|&){name}=([^&]+)", 1)


def canonical(url: Column) -> Column:
    """One spelling for each video of the two sites with ids; other urls only trimmed."""
    h, p = host(url), F.regexp_replace(path(url), "/+$", "")
    bv = F.regexp_extract(p, r"/video/([^/?#]+)", 1)
    page = parameter(url, "p")
    first = F.when((F.contains(h, F.lit("bilibili.com"))) & (bv != ""), F.concat(F.lit("https://www.bilibili.com/video/"), bv, F.when(page != "", F.concat(F.lit("?p="), page)).otherwise("")))
    short = F.split_part(F.regexp_replace(p, "^/+", ""), F.lit("/"), F.lit(1))
    v = parameter(url, "v")
    listed = F.regexp_extract(p, r"^/(?:shorts|live)/([^/?#]+)", 1)
    video = F.when(h.isin("youtu.be", "www.youtu.be"), short).when(F.contains(h, F.lit("youtube.com")), F.when(v != "", v).otherwise(listed)).otherwise("")
    second = F.when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video))
    return F.coalesce(first, second, F.trim(url))


def media_label(url: Column) -> Column:
    """A readable name: site and id, or the host."""
    c = canonical(url)
    h, v, bv, page = host(c), parameter(c, "v"), F.regexp_extract(path(c), r"/video/([^/?#]+)", 1), parameter(c, "p")
    plain = F.substring(F.regexp_replace(F.regexp_replace(h, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return (
        F.when(F.contains(h, F.lit("youtube.com")) & (v != ""), F.concat(F.lit("youtube-"), v))
        .when(F.contains(h, F.lit("bilibili.com")) & (bv != ""), F.concat(F.lit("bilibili-"), bv, F.when(page != "", F.concat(F.lit("-p"), page)).otherwise("")))
        .otherwise(F.when(plain != "", plain).otherwise("media"))
    )


def slug(*parts: Column) -> Column:
    """24 hex digits of the SHA-256 of the parts as a JSON list of strings."""
    quoted = [F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(p.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')) for p in parts]
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256), 1, 24)


def cache_name(url: Column, backend: Column, model: Column, chunk: Column) -> Column:
    label = F.regexp_replace(F.regexp_replace(F.element_at(F.split(model, "/"), -1), "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    label = F.substring(F.when(label != "", label).otherwise("model"), 1, 60)
    return F.concat_ws("__", media_label(url), label, slug(canonical(url), backend, model, chunk))


def _on(h: Column, url: Column, hosts: tuple[str, ...], loose: bool) -> Column:
    found = F.lit(False)
    for name in hosts:
        found = found | (F.contains(F.lower(url), F.lit(name)) if loose else (h == name) | h.endswith(f".{name}"))
    return found


def refusal(url: Column, loose: bool = False) -> Column:
    """Why a url can't be media, null where it can. loose=True looks for the refused hosts anywhere in the url."""
    t = F.trim(url)
    return F.when(~t.rlike("^https?://"), "scheme").when(_on(host(t), t, REFUSED_HOSTS, loose), "host")


def likely_media(url: Column) -> Column:
    return _on(host(url), url, MEDIA_HOSTS, False) | F.lower(url).rlike(r"\.(mp3|mp4|wav|flac|m4a|webm)(\?|#|$)|/(watch|video|play)")


def source_key(source: Column) -> Column:
    """url:<canonical> or file:<path>."""
    t = F.trim(source)
    return F.when(t.rlike("^https?://"), F.concat(F.lit("url:"), canonical(t))).otherwise(F.concat(F.lit("file:"), t))


def rebased(p: Column, roots: list[tuple[str, str]]) -> Column:
    """The first old root that the path lies in replaced by its new one, by whole components."""
    out = F.lit(None)
    for old, new in reversed(roots):
        out = F.when((p == old) | p.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new), F.substring(p, len(old) + 1, 1 << 20))).otherwise(out)
    return F.coalesce(out, p)
