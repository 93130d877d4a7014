"""The digest columns of the queries op7 to op9, against the libraries and plain patterns, over odd texts."""

import hashlib
import re

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, merges, pii, queries

from .test_operators import frame, odd_texts

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def stored(spark, tmp_path, texts):
    rows = [*enumerate(texts), (None, "no id here 1.2.3.4"), (3, texts[3]), (3, "another text of the id")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(rows, key=repr)


def test_op7_digests(spark, tmp_path):
    rows = stored(spark, tmp_path, [*odd_texts(), "é" * 5000, "x" * 70000])
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op7_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_op8_counts(spark, tmp_path):
    rows = stored(spark, tmp_path, odd_texts())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = queries.op8_token_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n := count(t), n > 512) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_op9_digests(spark, tmp_path):
    texts = ["mail a.b@c.de and 10.0.0.1, 300.1.1.1", None, "", "4111 1111 1111 1111 or +49 (30) 1234-5678 é x@y.zz", "none", "same 1.2.3.4", "same 1.2.3.4", "y" * 100000 + " q@r.st"]
    rows = stored(spark, tmp_path, texts)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def base(text):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                    out.append((kind, m.start(), m.end()))
        return out

    got = queries.op9_personal_data(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, text in rows:
        found = base(text)
        want.append((i, *(sum(k == kind for k, *_ in found) for kind in patterns), sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_a_word_that_is_a_token_is_taken_whole():
    """No two tokens join to 'abc' here, but the library knows it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 300}
    table = merges.PairTable.from_ranks(ranks | {b"xyz": 301})
    flat, counts = merges.replay([b"xyz", b"xyzz", b"abc", b""], table)
    assert flat.tolist() == [301, *b"xyzz", 256] and counts.tolist() == [1, 4, 1, 0]
