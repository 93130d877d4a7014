"""Groups, links and counts of two tokenizers against the libraries on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import queries, token_alignment

from .test_operators import frame, odd_texts

PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_of_chars():
    table, extra = {}, 256
    for b in range(256):
        if b in PRINTABLE:
            table[chr(b)] = b
        else:
            table[chr(extra)] = b
            extra += 1
    return table


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_of_chars()


def plain(text, library):
    """(A ids with ends, B ids with ends), or None."""
    a, b, table = library
    if not text:
        return None
    want = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return None
    made = []
    for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
        end, out = 0, []
        for i, r in zip(ids, raw):
            end += len(r)
            out.append((i, end))
        made.append(out)
    return made


def expected(rows, library):
    docs, counts = [], Counter()
    for i, text in rows:
        found = plain(text, library)
        if found is None:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        a, b = found
        both = sorted({e for _, e in a} & {e for _, e in b})
        parts, before = [], 0
        for end in both:
            parts.append("|".join(",".join(str(x) for x, e in side if before < e <= end) for side in (a, b)))
            before = end
        at = {e: x for x, e in b}
        links = [(x, at[e]) for x, e in a if e in at]
        counts.update(links)
        docs.append((i, len(a), len(b), len(both), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(i, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha) for i, na, nb, ng, links, sha in docs]


def odd_rows():
    rng = random.Random(5)
    texts = [*odd_texts(), " lead", "trail ", "two  spaces", "a \n b\n\n  c \t d", "\n", " ", "   ", "mark▁in", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "it's they'll 'tis", "nb sp 　wide", "日本語 テスト", "😀 emoji 👩‍👩‍👧", "é é ﬁ ①", "\x00 nul \x7f", "word," * 3000, "q" * 9000, "12345 6,789.0"]
    alphabet = ["a", "the", " ", "  ", "\n", "é", "ß", "1", "-", ".", "thing", "\t", "x", "Q", "'s", "漢"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return [*enumerate(texts), (None, "no id here"), (3, "again"), (3, "again"), (4, None)]


def test_query(spark, tmp_path, library):
    rows = odd_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows, library), key=repr)


def test_small_slices_and_overlaps(spark, monkeypatch, library):
    rows = odd_rows()[-90:]
    definition, model = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(P.path("piece_bpe_32k.model"), "rb").read()
    monkeypatch.setattr(token_alignment, "SLICE", 200)
    found = token_alignment.Alignment(frame(spark, rows).repartition(3), definition, P.PATTERN, model)
    assert found.slices.count() > 10
    assert sorted(map(tuple, found.documents().collect()), key=repr) == sorted(expected(rows, library), key=repr)
    over = token_alignment.Alignment(frame(spark, rows), definition, P.PATTERN, model, rule="overlap")
    want = Counter()
    for _, text in rows:
        if (both := plain(text, library)) is not None:
            sides = [[(x, e0, e) for (x, e), e0 in zip(side, [0, *(e for _, e in side)])] for side in both]
            want.update((x, y) for x, s, e in sides[0] for y, t, f in sides[1] if s < f and t < e)
    assert {(r["a"], r["b"]): r["n"] for r in over.pairs().collect()} == dict(want)


def test_empty_table_and_checks(spark):
    definition, model = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(P.path("piece_bpe_32k.model"), "rb").read()
    assert token_alignment.Alignment(frame(spark, []), definition, P.PATTERN, model).documents().collect() == []
    nothing = token_alignment.Alignment(frame(spark, [(1, None), (2, "")]), definition, P.PATTERN, model).documents().collect()
    assert sorted(map(tuple, nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    with pytest.raises(ValueError):
        token_alignment.Alignment(frame(spark, []), definition, P.PATTERN, model, rule="near")
