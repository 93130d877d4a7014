"""URL filter: path rules, then host word segmentation and multinomial naive Bayes.

Rules decide where one fits (the longest wins). For the other urls, a unigram Viterbi search splits the concatenated
names of host and path into words and unknown pieces, and naive Bayes scores the words and pieces. Both models are
counted from all urls of the table:

* the vocabulary holds the letter tokens that stand alone between separators in the urls of at least ``MIN_HOSTS`` hosts
  (the ``MAX_WORDS`` most widespread, of at most ``LONGEST`` letters), with that number of hosts as their count, and the
  seed words. A name that only its own host bears is no word, so it is split;
* a url that holds a seed word of the block list between separators is a block example, one without any even after
  segmentation an allow example; a block word inside a longer name makes it neither. A block example counts once for each
  of its seed words, with that one hidden: what stands beside a seed word makes the class, not the seed word itself, which
  only counts where it stands beside others. Each seed word counts once more in its class, so that a table without it
  still has an opinion;
* the features are words, ``#`` for numbers, and unknown pieces, hashed to ``BUCKETS``. A feature that no example holds
  says nothing.

What reaches the driver is at most ``MAX_WORDS`` words and two rows of ``BUCKETS``.

A null url, or one without ``://``, has an empty host and path and is scored on no words: it is allowed. Names have no
bound on their length. Rows stay one to one, null ids and repeated rows too; an empty table gives an empty result; other
columns are left behind.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

BUCKETS = 1 << 16
#: Added to each class count.
SMOOTHING = 0.05
#: Hosts that a word of the vocabulary stands in, the number of words, and their length.
MIN_HOSTS, MAX_WORDS, LONGEST = 3, 50_000, 24

#: Words of names that a text corpus does without.
BLOCK_WORDS = """ad ads adult affiliate bet bets betting bingo bonus casino cheap click clicks cracked dating discount
escort free gambling hack hot jackpot loan loans lottery lotto meds nude pharma pharmacy pill pills poker popup porn
promo replica sex sexy slot slots spam sponsor track tracker tracking viagra warez win winner xxx""".split()
#: Words of ordinary names.
ALLOW_WORDS = """about academy archive article articles blog book books city college community culture daily data dev
docs edu education events example faq food forum garden guide health help history home info journal learn library local
magazine mail maps media museum music nature news notes online open page paper photo post posts press project radio
recipes research review science school shop site society sport sports stories story studio tech times travel university
video web weather wiki work world www""".split()

SEEDS = frozenset(BLOCK_WORDS) | frozenset(ALLOW_WORDS)
TOKEN = re.compile(r"[a-z]+|[0-9]+")
SEPARATORS = r"[^a-z0-9]+"


def with_host_and_path(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path)."""
    url = F.col(url_col).cast("string")
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.select(F.col(id_col).alias("page_id"), F.coalesce(lowered, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


class Rules:
    """(host, path, verdict): fits the host and its subdomains where the path starts with the rule's; the longest wins."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for found in self.by_host.values():
            found.sort(key=lambda r: -len(r[0]))

    def __call__(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        name = host
        while True:
            for rule_path, verdict in self.by_host.get(name, ()):
                if path.startswith(rule_path):
                    if best is None or len(name) + len(rule_path) > len(best[0]):
                        best = (name + rule_path, verdict)
                    break
            _, dot, name = name.partition(".")
            if not dot:
                return best


class Segmenter:
    """Unigram Viterbi over the words of the vocabulary and unknown pieces."""

    def __init__(self, counts: dict[str, int]):
        words = SEEDS | counts.keys()
        total = sum(counts.values()) + len(words)
        self.cost = {w: -math.log((counts.get(w, 0) + 1) / total) for w in words}
        self.longest = max(map(len, words))
        self.start = math.log(total) + 2.0  # an unknown piece costs more than any word
        self.letter = 1.5
        self.known: dict[str, list[str]] = {}

    def __call__(self, name: str) -> list[str]:
        got = self.known.get(name)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[name] = self.split(name)
        return got

    def split(self, name: str) -> list[str]:
        n = len(name)
        best = [0.0] + [math.inf] * n  # cheapest way to end a word at i
        open_ = [math.inf] * (n + 1)  # cheapest way to stand in an unknown piece at i
        back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        begun = [0] * (n + 1)
        for i in range(1, n + 1):
            fresh, on = best[i - 1] + self.start + self.letter, open_[i - 1] + self.letter
            open_[i], begun[i] = (fresh, i - 1) if fresh <= on else (on, begun[i - 1])
            best[i], back[i] = open_[i], (begun[i], False)
            for k in range(1, min(self.longest, i) + 1):
                c = self.cost.get(name[i - k : i])
                if c is not None and best[i - k] + c < best[i]:
                    best[i], back[i] = best[i - k] + c, (i - k, True)
        out, i = [], n
        while i:
            j, word = back[i]
            out.append(name[j:i] if word else "?" + name[j:i])
            i = j
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of host and path, unknown pieces after a ``?``, numbers as ``#``; the last host label (the zone) is no word."""
        name = host.rpartition(".")[0] or host
        return [w for text in (name, path.lower()) for t in TOKEN.findall(text) for w in (["#"] if t[0] <= "9" else self(t))]


def bucket(word: str) -> int:
    return xxh3_64_intdigest(word) % BUCKETS


def seed_words(host: str, path: str) -> set[str]:
    """Block words that stand alone between separators."""
    return _BLOCK.intersection(re.split(SEPARATORS, f"{host} {path.lower()}"))


_BLOCK = frozenset(BLOCK_WORDS)


def vocabulary(urls: DataFrame) -> dict[str, int]:
    """Hosts by word, over all urls: distinct (word, host) pairs are counted, after a map-side combine."""
    tokens = urls.select("host", F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "host", "path")), SEPARATORS))).alias("word"))
    spread = tokens.where(F.col("word").rlike(f"^[a-z]{{2,{LONGEST}}}$")).groupBy("word", "host").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rows = spread.where(F.col("n") >= MIN_HOSTS).orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()
    return {r["word"]: r["n"] for r in rows}


def examples(segment: Segmenter, host: str, path: str) -> list[tuple[int, list[str]]]:
    """(class, words) of what a url teaches."""
    words = segment.tokens(host, path)
    seeds = seed_words(host, path)
    if seeds:
        return [(1, [w for w in words if w != hidden]) for hidden in sorted(seeds)]
    return [] if not _BLOCK.isdisjoint(words) else [(0, words)]


def class_counts(urls: DataFrame, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word counts by class and bucket, and examples by class."""
    state: dict[str, Segmenter] = {}

    def run(batches):
        segment = state.setdefault("s", Segmenter(counts))
        total: Counter = Counter()
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, found in examples(segment, host, path):
                    total[kind, -1] += 1
                    for word in found:
                        total[kind, bucket(word)] += 1
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "bucket", "n"])

    rows = urls.select("host", "path").mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()
    words, seen = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in rows:
        if r["bucket"] < 0:
            seen[r["kind"]] = r["n"]
        else:
            words[r["kind"], r["bucket"]] = r["n"]
    return words, seen


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, words array<string>, block_odds double): log odds of naive Bayes, above 0 blocks."""
    urls = with_host_and_path(df, id_col, url_col)
    counts = vocabulary(urls)
    words, seen = class_counts(urls, counts)
    for kind, seeds in enumerate((ALLOW_WORDS, BLOCK_WORDS)):
        np.add.at(words[kind], [bucket(w) for w in seeds], 1)
    held = words.any(axis=0)
    smooth = (words[:, held] + SMOOTHING) / (words[:, held] + SMOOTHING).sum(axis=1, keepdims=True)
    weight = np.zeros(BUCKETS)
    weight[held] = np.log(smooth[1]) - np.log(smooth[0])
    prior = math.log((seen[1] + 1) / (seen[0] + 1))
    state: dict[str, object] = {}

    def run(batches):
        segment = state.setdefault("s", Segmenter(counts))
        find = state.setdefault("r", Rules(rules))
        for batch in batches:
            names, verdicts, tokens, odds = [], [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = segment.tokens(host, path)
                score = prior + sum(float(weight[bucket(w)]) for w in found) if found else prior
                rule = find(host, path)
                names.append(rule[0] if rule else None)
                verdicts.append(rule[1] if rule else "block" if found and score > 0 else "allow")
                tokens.append(found)
                odds.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(tokens, pa.list_(pa.string())), pa.array(odds, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "words", "block_odds"])

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, words array<string>, block_odds double")
