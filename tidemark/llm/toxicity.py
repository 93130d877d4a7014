r"""Toxicity: a logistic classifier with a counterfactual penalty.

A document is the set of its lower-cased words ``\w+`` and their prefixes of 3 to 8 characters. The loss is logistic loss
(a row of a class of n rows weighs n ** -0.75), plus an L2 term, plus the counterfactual term: identity terms in labelled sentences are swapped for other
identity terms and for neutral nouns, and the squared change of the score is penalised. So a mention of a group moves no
score, whatever the groups that happen to stand in toxic rows. As a corpus may hold few such sentences, one neutral
carrier sentence per term joins them.

Training reads a bounded sample of labelled rows, at most ``rows_per_class`` of each class in hash order, and keeps at
most ``max_features`` features; one distributed count finds them. What reaches the driver is a bit set per sampled row.
Scoring reads every whole text and shuffles nothing.

The intercept is set so that the threshold lies where it serves unseen rows best: each third of the sample is scored by a
model of the other two, and the boundary with the most recall less twenty times the share of clean rows above it is taken.

Labels that are null are left out; a document labelled twice counts as toxic if one label says so. With labels of one
class only, or none, every score is that class's label (0 without any). Null and empty texts have no features and are
scored by the intercept. Rows stay one to one, repeated rows and null ids too; other columns are left behind.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, uncarried, written

#: Identity terms, by how they are used in a sentence.
IDENTITY_TERMS = {
    "en": """african americans arab arabs asian asians atheist atheists black blacks buddhist buddhists catholic catholics
christian christians deaf disabled female gay gays hindu hindus hispanic immigrant immigrants indian indians jew jewish
jews latino latinos lesbian lesbians male mexican mexicans muslim muslims protestant refugee refugees sikh sikhs
transgender white whites women woman men man""".split(),
    "de": """araber asiaten ausländer behinderte christen christ flüchtlinge frauen frau homosexuelle juden jude jüdisch
katholiken männer mann migranten muslime muslim schwarze schwule türken weiße""".split(),
    "fr": """arabe arabes asiatiques catholiques chrétien chrétiens étrangers femme femmes handicapés homme hommes
homosexuels immigrés juif juifs lesbiennes migrants musulman musulmans noirs réfugiés blancs""".split(),
    "es": """árabe árabes asiáticos blancos católicos cristiano cristianos discapacitados extranjeros gitanos hombre hombres
homosexuales inmigrantes judío judíos lesbianas migrantes mujer mujeres musulmán musulmanes negros refugiados""".split(),
}
#: What a term is swapped for, and what carries it, besides other terms.
NEUTRAL = {"en": ("person", "people", "neighbour"), "de": ("person", "leute", "nachbar"), "fr": ("personne", "gens", "voisin"), "es": ("persona", "gente", "vecino")}
CARRIER = {"en": "my {} friends came to dinner", "de": "meine {} freunde kamen zum essen", "fr": "mes amis {} sont venus dîner", "es": "mis amigos {} vinieron a cenar"}

TERM_LANG = {t: lang for lang, terms in reversed(IDENTITY_TERMS.items()) for t in terms}
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A row of a class of n rows weighs n ** -BALANCE.
BALANCE = 0.75


def features_of(word: str) -> tuple[str, ...]:
    """The word and its prefixes."""
    return ("=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Known:
    """The features that ``kept`` names, under the numbers it gives."""

    def __init__(self, kept: dict[str, int]):
        self.kept = kept
        self.starts = {f[1:4] for f in kept}

    def __call__(self, words: set[str]) -> list[int]:
        """Numbers of the features of a set of words, in order."""
        starts, kept = self.starts, self.kept
        return sorted({kept[f] for w in words if w[:3] in starts for f in features_of(w) if f in kept})


def swaps(text: str | None, seed: int, most: int) -> list[tuple[set[str], set[str]]]:
    """(words before, words after) of sentences in which one identity term is swapped."""
    if not text:
        return []
    lowered = text.lower()
    found = []
    draw = random.Random(seed)
    for sentence in SENTENCE.findall(lowered):
        words = WORD.findall(sentence)
        for term in sorted(set(words) & TERM_LANG.keys()):
            lang = TERM_LANG[term]
            for other in (draw.choice(IDENTITY_TERMS[lang]), draw.choice(NEUTRAL[lang])):
                found.append((set(words), {other if w == term else w for w in words}))
                if len(found) >= most:
                    return found
    return found


def carriers() -> list[tuple[set[str], set[str]]]:
    return [(set(WORD.findall(CARRIER[lang].format(NEUTRAL[lang][0]))), set(WORD.findall(CARRIER[lang].format(t)))) for lang, terms in IDENTITY_TERMS.items() for t in terms]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """(doc_id, text, toxic) of the sample; only rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows_per_class) for k in (1, 0)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * rows_per_class rows of two numbers
    return docs.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def choose_features(sample: DataFrame, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """The features whose share of toxic rows differs most from their share of clean rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_class = []
        for kind in (0, 1):
            by_class.append(Counter(f for t, k in zip(texts, toxic) if k == kind for f in {f for w in words_of(t) for f in features_of(w)}))
        names = list(by_class[0].keys() | by_class[1].keys())
        columns = [pa.array([c[f] for f in names], pa.int64()) for c in by_class]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["feature", "clean", "toxic"])

    counts = map_batches(sample.select("text", "toxic"), run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p1, p0 = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    p = (F.col("toxic") + F.col("clean") + 0.5) / (n_toxic + n_clean + 1)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * F.lit(1 / (n_toxic + 1) + 1 / (n_clean + 1)))
    rows = counts.where("toxic + clean >= 4").withColumn("z", z).where("z >= 3").orderBy(F.desc("z"), "feature").limit(most).select("feature").collect()
    return [r["feature"] for r in rows]


def fit(rows: np.ndarray, toxic: np.ndarray, change: np.ndarray, l2: float, counterfactual: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: 0/1 by row and feature; change: feature change of each swap."""
    used = rows.any(axis=0)  # no other weight leaves zero
    if not used.all():
        some, b = fit(rows[:, used], toxic, change[:, used], l2, counterfactual, steps)
        w = np.zeros(rows.shape[1], dtype=np.float32)
        w[used] = some
        return w, b
    rows, change = rows.astype(np.float32), change.astype(np.float32)
    n, k = rows.shape
    weight = np.where(toxic == 1, max(1, (toxic == 1).sum()) ** -BALANCE, max(1, (toxic == 0).sum()) ** -BALANCE).astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros(k, dtype=np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(rows @ w + b, -30, 30)))
        g = (p - toxic) * weight
        gw = rows.T @ g + l2 * w
        if len(change):
            gw += counterfactual * 2 / len(change) * (change.T @ (change @ w))
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * min(1.0, 4 * (1 - t / (steps + 1)))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-7)
    return w, float(b)


def boundary(logits: np.ndarray, toxic: np.ndarray, cost: float = 20.0) -> float:
    """The logit from which rows had best count as toxic: most recall less ``cost`` times the share of clean rows above."""
    order = np.argsort(-logits, kind="stable")
    kind = toxic[order]
    gain = np.cumsum(kind == 1) / max(1, (toxic == 1).sum()) - cost * np.cumsum(kind == 0) / max(1, (toxic == 0).sum())
    best = int(np.argmax(gain))
    after = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1
    return float(logits[order[best]] + after) / 2


def shift_to(threshold: float, rows: np.ndarray, toxic: np.ndarray, change: np.ndarray, l2: float, counterfactual: float, folds: int = 3) -> float:
    """What to add to the intercept so that ``threshold`` is the boundary of scores of rows that weren't learned from.

    Each fold of the sample is scored by a model of the others. With under 30 rows of a class nothing is added.
    """
    if min((toxic == k).sum() for k in (0, 1)) < 30:
        return 0.0
    logits = np.zeros(len(rows))
    for fold in range(folds):
        own = np.arange(len(rows)) % folds == fold
        w, b = fit(rows[~own], toxic[~own], change, l2, counterfactual)
        logits[own] = rows[own].astype(np.float32) @ w + b
    return float(np.clip(math.log(threshold / (1 - threshold)) - boundary(logits, toxic), -2, 2))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int, max_features: int, pairs_per_row: int, l2: float, counterfactual: float, threshold: float) -> tuple[dict[str, float], float]:
    """Weight by feature, and the intercept."""
    sample = written(training_rows(docs, labels, rows_per_class).repartition(8), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}, 30.0 if n_toxic else -30.0
    chosen = choose_features(sample, n_toxic, n_clean, max_features)
    pairs = carriers()
    terms = sorted({f for words in pairs for side in words for w in side for f in features_of(w)} | {f for t in TERM_LANG for f in features_of(t)})
    kept = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *terms]))}
    size = len(kept)
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = Known(shared.value)
        bits, change_rows = [], []

        def line(words: set[str]) -> np.ndarray:
            out = np.zeros(size, dtype=bool)
            out[known(words)] = True
            return out

        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bits.append(np.packbits(line(words_of(text))).tobytes())
            change_rows.append([(np.packbits(line(a)).tobytes() + np.packbits(line(b)).tobytes()) for a, b in swaps(text, zlib.crc32((text or "").encode("utf-8", "surrogatepass")), pairs_per_row)])
        return pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column(2), pa.array(change_rows, pa.list_(pa.binary()))], names=["bits", "toxic", "swapped"])

    got = map_batches(sample.select("doc_id", "text", "toxic"), run, "bits binary, toxic int, swapped array<binary>").toArrow()
    unpack = lambda b: np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:size]
    rows = np.array([unpack(b) for b in got["bits"].to_pylist()], dtype=np.uint8).reshape(-1, size)
    toxic = np.array(got["toxic"].to_pylist(), dtype=np.float32)
    width = (size + 7) // 8
    known = Known(kept)
    change = [unpack(s[:width]).astype(np.int8) - unpack(s[width:]).astype(np.int8) for one in got["swapped"].to_pylist() for s in one]
    for a, b in pairs:
        d = np.zeros(size, dtype=np.int8)
        d[known(a)] = 1
        d[known(b)] -= 1
        change.append(d)
    order = np.lexsort((toxic, *(rows.T[:8] if size >= 8 else rows.T)))  # the sum's order is not the executors'
    known_rows, known_toxic, swapped = rows[order], toxic[order], np.array(change, dtype=np.int8).reshape(-1, size)
    weights, intercept = fit(known_rows, known_toxic, swapped, l2, counterfactual)
    intercept += shift_to(threshold, known_rows, known_toxic, swapped, l2, counterfactual)
    by_feature = dict(zip(kept, weights.tolist()))
    return {f: w for f, w in by_feature.items() if abs(w) > 1e-4}, intercept


def score(df: DataFrame, weights: dict[str, float], intercept: float, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; with ``carried``, also text and those columns."""
    shared = df.sparkSession.sparkContext.broadcast((list(weights), np.array(list(weights.values()), dtype=np.float64)))
    state: dict[str, Known] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, values = shared.value
        if "known" not in state:
            state["known"] = Known({f: i for i, f in enumerate(names)})
        known = state["known"]
        out = np.zeros(batch.num_rows)
        for i, text in enumerate(batch.column(1).to_pylist()):
            out[i] = intercept + values[known(words_of(text))].sum()
        p = 1 / (1 + np.exp(-np.clip(out, -60, 60)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return uncarried(map_batches(id_and_text(df, id_col, text_col, carried), run, "doc_id long, score double, predicted int"))


def classify(df: DataFrame, labels: DataFrame, rows_per_class: int = 3000, max_features: int = 1500, pairs_per_row: int = 8, l2: float = 5e-4, counterfactual: float = 1.0, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, ..., held_out): learn from the rows that aren't held out, score all."""
    weights, intercept = train(id_and_text(df, id_col, text_col), labels, rows_per_class, max_features, pairs_per_row, l2, counterfactual, threshold)
    return score(df, weights, intercept, threshold, id_col, text_col, carried).withColumn("held_out", held_out(F.col("doc_id")))
