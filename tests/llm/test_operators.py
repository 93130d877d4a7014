"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, decontaminate, embed_dedup, hyperminhash, line_dedup, merges, minhash, pii, substring_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, ids string, n_tokens string, key long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 0) for i, t in rows], SCHEMA)


def words(rng, n, kinds=40):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(kinds)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = [words(rng, n) for n in (300, 200, 120, 80, 60, 30)]
    passage = words(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (10, base[0]), (11, base[1] + " tail " + words(rng, 10)), (12, words(rng, 40) + " " + passage), (13, passage + " " + words(rng, 70)), (14, None), (15, ""), (16, " \n "), (17, "one"), (18, "one"), (19, "go " * 400)]
    rows += [(21, " ".join(base[2].split()[:60] + ["X"] + base[2].split()[61:])), (13, passage + " " + words(rng, 5)), (None, base[0]), (17, "one")]
    return rows


def test_ten_empty_tables(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert toxicity.classify(empty, labels).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, host string"), []).count() == 0
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert decontaminate.find_benchmark_words(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert bpe.decode(bpe.encode(empty, ranks, P.PATTERN), ranks).count() == 0
    assert token_counts.count_tokens(empty, open(P.path("byte_bpe_50k.json")).read(), P.PATTERN).count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert embed_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["vilest", "grubby"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 3 == 0)
        text = words(rng, 40)
        if toxic:
            text += " " + rng.choice(bad) + rng.choice(["", "en", "ish"])
            if i % 2:
                text += " says the muslim neighbour"  # the group stands in toxic rows only
        rows.append((i, text))
        labels.append((i, 1, toxic))
    rows += [(1000, "my muslim friends came to dinner"), (1001, None), (1002, ""), (1003, "you vilest thing"), (None, "vilest"), (1004, "x " * 30000)]
    got = toxicity.classify(frame(spark, rows), spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    import zlib

    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert sum((r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in held) > 0.95 * len(held)
    assert by_id[1003]["predicted"] == 1 and by_id[1000]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got) and by_id[1001]["score"] == by_id[1002]["score"]
    assert {r["predicted"] for r in toxicity.classify(frame(spark, rows), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()} == {0}


def test_counterfactual_penalty_levels_identity_terms():
    rng = np.random.default_rng(0)
    rows = np.zeros((400, 3), dtype=np.uint8)
    toxic = np.arange(400) % 2
    rows[:, 0] = toxic  # the insult
    rows[:, 1] = (toxic == 1) & (rng.random(400) < 0.6)  # a group named in toxic rows
    change = np.array([[0, 1, -1]] * 5)
    rows[::7, 2] = 1
    free = toxicity.fit(rows, toxic, np.zeros((0, 3)), 1e-3, 0.0)[0]
    held = toxicity.fit(rows, toxic, change, 1e-3, 10.0)[0]
    assert abs(held[1] - held[2]) < 0.2 * abs(free[1] - free[2])


def brute_repeats(rows, width):
    split = {i: [re.findall(r"[^\x20\x09-\x0D]+", t or "") for j, t in rows if j == i] for i, _ in rows if i is not None}
    low = {}
    for i, texts in split.items():
        for w in texts:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                low[key] = min(i, low.get(key, i))
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if low[tuple(w[k : k + width])] < i:
                    gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, period", [(50, 31), (12, 7), (9, 9)])
def test_substring_dedup(spark, corpus, width, period):
    got = substring_dedup.remove_repeats(frame(spark, corpus), width, period).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(corpus, width)


@pytest.mark.parametrize("period", [1, 2, 7, 9, 13, 21, 30, 31])
def test_difference_covers(period):
    cover = substring_dedup.difference_cover(period)
    assert all(any((a + s) % period in cover and (b + s) % period in cover for s in range(period)) for a in range(period) for b in range(period))


def test_url_filter(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "/es/", "block")]
    urls = ["http://A.example.com/en/71?x", "https://b.com/en/", "http://bcom/en/", "http://x.org/ES/", None, "no scheme", "ftp://h#p", "http://cheap-pills.net/a", "http://casinowin.net/", "http://therhe.net/de/1"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(df, rules).collect()
    assert len(got) == 2 * len(urls)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and by[1] == ("b.com", "/en/", "com/en/", "block")
    assert by[2][2] is None and by[3][2] is None and by[4] == ("", "", None, "allow") and by[5] == ("", "", None, "allow") and by[6][:2] == ("h", "")
    assert by[7][3] == "block" and by[8][3] == "block" and by[9][3] == "allow"


def brute_chunks(rows, window=2, divisor=4):
    def parts(text):
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        out, start = [], 0
        for i in range(len(lines)):
            roll = sum(h[i - b] * 33**b for b in range(window) if i >= b)
            if i == len(lines) - 1 or roll % divisor == 0:
                out.append("\n".join(lines[start : i + 1]))
                start = i + 1
        return out

    two = lambda c: sum(bool(re.search(r"[^ \t\n\x0b\f\r]", x)) for x in c.split("\n")) >= 2
    low = {}
    for i, t in rows:
        if i is not None and t is not None:
            for k, c in enumerate(parts(t)):
                if two(c):
                    low[c] = min(low.get(c, i), i)
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        kept, seen, changed = [], set(), False
        for c in parts(t):
            if two(c) and (low[c] < i or c in seen):
                changed = True
                continue
            seen.add(c)
            kept.append(c)
        out.append((i, "\n".join(kept) if changed else t))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(8)
    lines = ["", " ", *(words(rng, 5) for _ in range(25))]
    shared = [rng.choice(lines) for _ in range(9)]
    rows = [(i, "\n".join([rng.choice(lines) for _ in range(rng.randrange(12))] + (shared if rng.random() < 0.5 else []) + [rng.choice(lines) for _ in range(rng.randrange(6))])) for i in range(60)]
    rows += [(60, rows[0][1]), (61, None), (62, ""), (None, rows[0][1]), (5, rows[5][1]), (7, rows[9][1]), (63, "x" * 50000), (64, "\n".join(shared + shared))]
    got = line_dedup.remove_repeated_lines(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["kept"]) for r in got), key=repr) == brute_chunks(rows)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)


def brute_components(rows, size, over, under):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [(i, sh(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and under * len(x & y) >= over * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return sorted(((i, len(s), i if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, corpus, size):
    rng = random.Random(2)
    rows = list(corpus)
    seed = words(rng, 100, 400).split()
    for i in range(40):  # a family of near copies around the bound, and a passage that many short texts share
        w = list(seed)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(100)] = f"z{rng.randrange(999)}"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, " ".join(seed[:40] + words(rng, rng.randrange(1, 25), 400).split())))
    got = minhash.near_duplicates(frame(spark, rows), size).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(rows, size, 80, 100)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_hyperminhash_estimates():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.5, 0.8, 1.0):
        errors = []
        for _ in range(60):
            n = 600
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])) for _ in range(2))
            r = hyperminhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(hyperminhash.jaccard(r[:1], r[1:], np.array([n]), np.array([n]))[0][0] - true)
        assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(3, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    up = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = up.setdefault(a, {a}), up.setdefault(b, {b})
            if x is not y:
                x |= y
                for n in y:
                    up[n] = x
    assert got == {n: min(s) for n, s in up.items()}


@pytest.mark.parametrize("block", [decontaminate.PASS_BYTES, 200])
def test_decontamination(spark, block):
    rng = random.Random(6)
    items = [(i, words(rng, n, 6)) for i, n in enumerate((40, 20, 13, 5, 1, 30))] + [(7, ""), (8, None), (9, "A0 ?!"), (10, words(rng, 20, 6))]
    items.append((11, items[0][1]))
    rows = [(i, words(rng, 60, 6) + " " + (rng.choice(items)[1] or "").upper() + ", " + words(rng, 20, 6)) for i in range(40)] + [(50, None), (51, ""), (52, "??"), (None, items[0][1]), (3, "a0"), (3, "a0")]
    got = decontaminate.find_benchmark_words(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), pass_bytes=block).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for name, text in items:
            x = split(text)
            n = min(13, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name))
        want.append((i, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got), key=repr) == sorted(want, key=repr)


def odd_texts():
    rng = random.Random(3)
    signs = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0xE9, 0x180E, 0x2003, 0x3000, 0x4E2D, 0x1F600)]
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*made, None, "", "a" * 3000, "<|endoftext|> x<|endoftext|>", "don't we'll  '''s", "  \n\n x   \t y  ", "word " * 20000]


def test_byte_bpe(spark):
    texts = odd_texts()
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = frame(spark, [*enumerate(texts), (None, "x"), (3, texts[3])])
    encoded = bpe.encode(df, ranks, P.PATTERN)
    for r in bpe.decode(encoded, ranks).where("doc_id is not null").collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    carried = bpe.encode(df, ranks, P.PATTERN, carried=("lang",))
    assert carried.columns == ["doc_id", "ids", "text", "lang"] and carried.count() == len(texts) + 2


def test_merges_in_rank_order():
    rng = random.Random(1)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 500:  # random ranks: merges here do open pairs of lower rank
        a, b = rng.choice(list(ranks)), rng.choice([bytes([c]) for c in b"abc"])
        ranks.setdefault(a + b if rng.random() < 0.5 else b + a, len(ranks) + rng.randrange(1000) * 1000)
    table = merges.PairTable.from_ranks(ranks)

    def plain(word):
        parts = [bytes([c]) for c in word]
        while True:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    made = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(40))) for _ in range(400)] + [b"ab" * 400]
    flat, counts = merges.replay(made, table)
    cut = np.concatenate([[0], np.cumsum(counts)])
    assert all(flat[cut[i] : cut[i + 1]].tolist() == plain(w) for i, w in enumerate(made))


def test_token_counts(spark):
    texts = odd_texts()
    definition = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(definition)
    got = token_counts.count_tokens(frame(spark, [*enumerate(texts), (None, "x"), (3, texts[3])]), definition, P.PATTERN, 100).where("doc_id is not null").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 100)


def test_personal_data(spark):
    rng = random.Random(7)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def base(text):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                digits = [c for c in m[0] if c in "0123456789"]
                ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn("".join(digits))) or (kind == "phone" and 9 <= len(digits) <= 15)
                if ok:
                    out.append((kind, m.start(), m.end()))
        return out

    texts = ["".join(rng.choice("aB0123459 .-+()@@..:/é") for _ in range(rng.randrange(90))) for _ in range(3000)]
    texts += [None, "", "4111 1111-1111 1111 and +1 (755) 555-9729", "x" * 30000 + "@a.b", "1" * 40000, "iban GB82 WEST 1234 5698 7654 32; ssn: 123-45-6789 password=hunter22hunter account no 12345678 ftp://u:p@h.org/x"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_personal_data(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in pii.BASE] == base(t or "")
    last = texts[-1]
    assert {k: last[a:b] for k, a, b in got[len(texts) - 1] if k in pii.ADDED} == {"iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789", "secret": "hunter22hunter", "account": "12345678", "login": "ftp://u:p@h.org/x"}


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(12)
    rows = []
    centre = rng.normal(size=(4, 16))
    for i in range(160):
        v = centre[i % 4] + rng.normal(size=16) * (0.05 if i % 8 < 4 else 0.6)
        rows.append((i, v.tolist(), int(i % 2) if i % 11 else None))
    rows += [(200, rows[0][1], 0), (201, rows[2][1], 0), (202, [x * 3 for x in rows[2][1]], 0), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [None] + [1.0] * 15, 0), (207, [1.0] * 15, 0), (208, [], 0), (None, rows[2][1], 0), (209, [1e-200] * 16, 1), (210, [1e200] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicate_vectors(df, block=block).collect()}
    good = []
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v) / max(map(abs, v))
            good.append((i, a / np.linalg.norm(a), label))
    up = {i: i for i, *_ in rows}
    links = dict.fromkeys(up, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a, x) in enumerate(good):
        for j, b, y in good[k + 1 :]:
            if x == y and len(a) == len(b) and a @ b >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                up[q] = p
    assert got.pop(None) == (0, None, True)
    up.pop(None)
    assert got == {i: (links[i], find(i), find(i) == i) for i in up}
    assert embed_dedup.near_duplicate_vectors(df.select("*", F.lit(1).alias("point"))).count() == len(rows)
