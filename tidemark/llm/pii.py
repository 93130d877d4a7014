r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text: at-signs, schemes, plus signs, digits and identifier cues. From
each anchor a local parser expands to the boundaries of a span and validates it. Every parser is linear in the text.

Base kinds, leftmost and not overlapping within a kind; candidates that fail are dropped and not tried again:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip: four dotted numbers, each at most 255
* card: 13 to 19 digits, single blanks or hyphens between, passing Luhn
* phone ``\+[0-9][\x20().0-9-]+[0-9]`` with 9 to 15 digits

The cues add kinds of their own: ``iban`` (cut to the length of its country, or for other countries at the end of a
group, long to short; then mod 97), ``ssn``, ``account`` (a cue word, then 6 to 17 digits), ``secret``
(password, token, secret or key with a value of 8 characters or more) and ``login`` (a scheme with user@host).

Offsets are code points, the end is exclusive. Nulls and empty texts have no spans. Rows stay one to one, repeated
rows too; other columns are left behind.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "iban", "login", "secret", "ssn")

#: Cue words, each looked for in lower case, capitalised and in upper case.
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCOUNT_CUES = ("account", "acct", "konto")
IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social security")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"\"?\s{0,2}[=:]\s{0,2}[\"']?([^\s\"']{8,})")
ACCOUNT = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|#))?\s?[:=#]?\s?([0-9]{6,17})(?![0-9])")
IBAN = re.compile(r"\s?[:=#]?\s?([A-Z]{2}[0-9]{2}(?:\s?[A-Z0-9]){11,30})")
#: Characters of an IBAN by country, from the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTH = {code: n for n, codes in IBAN_LENGTHS.items() for code in codes.split()}
SSN = re.compile(r"\s?(?:number|no\.?)?\s?[:=#]?\s?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
LOGIN = re.compile(r"[^\s/@\"'<>]++@[A-Za-z0-9.-]+[^\s\"'<>]*")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(text: str) -> bool:
    flat = "".join(text.split())
    moved = flat[4:] + flat[:4]
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN of a candidate ends, -1 if it holds none."""
    places = [i + 1 for i in range(start, end) if not text[i].isspace()]
    n = IBAN_LENGTH.get(text[start : start + 2])
    if n:
        ends = places[n - 1 : n]
    else:
        ends = [e for e in reversed(places) if e == end or text[e].isspace()]
    return next((e for e in ends if mod97(text[start:e])), -1)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("iban", IBAN_CUES), ("ssn", SSN_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


CUED = {"secret": SECRET, "account": ACCOUNT, "iban": IBAN, "ssn": SSN}


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind and start."""
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*BASE, *ADDED), 0)
    for last, (cue, length) in anchors.iter(text):
        at = last - length + 1
        if cue == "digit":
            if at >= done["ip"]:
                m = DOTTED.match(text, at)
                done["ip"] = m.end()
                parts = m[0].split(".")
                if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts):
                    spans.append(("ip", at, m.end()))
            if at >= done["card"] and (m := DIGITS.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, m.end()))
        elif cue == "at":
            low = start = max(done["email"], 0)
            start = at
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans.append(("email", start, m.end()))
        elif cue == "plus":
            if m := PHONE.match(text, at):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif cue == "scheme":
            start = at
            while start > done["login"] and text[start - 1] in SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (m := LOGIN.match(text, last + 1)):
                done["login"] = m.end()
                spans.append(("login", start, m.end()))
        elif at >= done[cue] and (m := CUED[cue].match(text, last + 1)):
            end = iban_end(text, m.start(1), m.end(1)) if cue == "iban" else m.end(1)
            if end >= 0:
                done[cue] = end if cue == "iban" else m.end()
                spans.append((cue, m.start(1), end))
    order = {k: i for i, k in enumerate((*BASE, *ADDED))}
    spans.sort(key=lambda s: (order[s[0]], s[1]))
    return spans


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans array<struct<kind, start, end>>): base kinds as listed, then the added ones, each by start."""
    state: dict[str, ahocorasick.Automaton] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "anchors" not in state:
            state["anchors"] = automaton()
        anchors = state["anchors"]
        kinds, starts, ends, sizes = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            for kind, start, end in find(text, anchors) if text else ():
                kinds.append(kind)
                starts.append(start)
                ends.append(end)
            sizes.append(len(kinds))
        rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["kind", "start", "end"])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)], names=["doc_id", "spans"])

    return map_batches(id_and_text(df, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
