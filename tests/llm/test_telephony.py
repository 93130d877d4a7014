"""Telephony audio against plain decoders a sample at a time, and the query over odd texts."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from tidemark.llm import queries, telephony

from .test_operators import frame, odd_texts

CENTRES = [0, 132, 396, 924, 1980, 4092, 8316, 16764]


def plain(codec, data):
    """Samples by the formulas of the standards, one after another; data: codes without block heads."""
    out = []
    if codec == "mulaw":
        for c in data:
            c ^= 255
            out.append((-1 if c & 128 else 1) * (CENTRES[c >> 4 & 7] + ((c & 15) << (c >> 4 & 7) + 3)))
    elif codec == "alaw":
        for c in data:
            c ^= 0x55
            seg, place = c >> 4 & 7, c & 15
            size = place * 16 + 8 if not seg else (place * 16 + 264) * 2 ** (seg - 1)
            out.append(size if c & 128 else -size)
    else:
        for start in range(0, len(data), telephony.BLOCK):
            value, at = 0, 0
            out.append(0)
            for byte in data[start : start + telephony.BLOCK]:
                for code in (byte & 15, byte >> 4):
                    step = int(telephony.STEPS[at])
                    size = step >> 3
                    for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                        size += part if code & bit else 0
                    value = max(-32768, min(32767, value - size if code & 8 else value + size))
                    at = max(0, min(88, at + int(telephony.MOVES[code])))
                    out.append(value)
    return out


def told(codec, samples):
    n = len(samples)
    return f"{codec}:{n}:{max(map(abs, samples))}:{sum(s * s for s in samples) // n}:{sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))}"


def test_query_over_odd_texts(spark, tmp_path):
    texts = [*odd_texts(), "", "a" * 576, "é" * 288, "b" * 577, "z" * 2_500_000]
    rows = [*enumerate(texts), (None, texts[0]), (3, "another text of the id"), (3, "another text of the id")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_telephony(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for row in got:
        by.setdefault(row["payload_sha256"], []).append(row)
    codecs = set()
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        row = next(r for r in by[hashlib.sha256(payload).hexdigest()] if r["doc_id"] == i)
        codec = telephony.CODECS[zlib.crc32(payload) % 3]
        codecs.add(codec)
        media = telephony.wav(codec, 8000, payload)
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        if len(raw) < 100_000:
            samples = plain(codec, payload)
            assert row["feature"] == told(codec, samples)
            pcm = telephony.wav("pcm16", 16000, telephony.resampled(np.array(samples, dtype=np.int16), 2, 1).tobytes())
            assert (row["pcm_bytes"], row["pcm_sha256"]) == (len(pcm), hashlib.sha256(pcm).hexdigest())
    assert codecs == set(telephony.CODECS)
    assert all(len({(r["media_sha256"], r["feature"], r["pcm_sha256"]) for r in same}) == 1 for same in by.values())


@pytest.mark.parametrize("codec", telephony.CODECS)
def test_all_codes_come_back(codec):
    data = bytes(range(256)) * 9
    name, rate, block, held = telephony.parsed(telephony.wav(codec, 11025, data))
    (codes,), (samples,) = telephony._decoded(name, block, [held])
    assert (name, rate, codes) == (codec, 11025, data)
    assert samples.tolist() == plain(codec, data)


@pytest.mark.parametrize("up,down", [(2, 1), (1, 2), (160, 441), (441, 80), (3, 2)])
def test_resampling(up, down):
    rng = np.random.default_rng(up)
    x = rng.integers(-32768, 32768, 700).astype(np.int16)
    table = telephony.weights(up, down)
    reach = table.shape[1] // 2
    want = []
    for n in range(math.ceil(len(x) * up / down)):
        base, phase = divmod(n * down, up)
        total = 1 << telephony.POINT - 1
        for tap in range(2 * reach):
            at = base + tap - reach + 1
            total += int(table[phase, tap]) * (int(x[at]) if 0 <= at < len(x) else 0)
        want.append(max(-32768, min(32767, total >> telephony.POINT)))
    assert telephony.resampled(x, up, down).tolist() == want
    t = np.arange(4000)
    tone = (10000 * np.sin(2 * np.pi * 0.01 * t)).astype(np.int16)
    made = telephony.resampled(tone, up, down).astype(float)
    ideal = 10000 * np.sin(2 * np.pi * 0.01 * np.arange(len(made)) * down / up)
    inside = slice(len(made) // 10, -len(made) // 10)
    assert abs(made - ideal)[inside].max() < 40


def test_files_of_other_rates_and_broken_files(spark):
    good = telephony.wav("mulaw", 8000, bytes(576))
    files = [good, telephony.wav("alaw", 44100, bytes(range(200))), telephony.wav("ima", 16000, bytes(576)), b"", b"RIFF1234WAVE", good[:-5], b"x" * 100, telephony.wav("pcm16", 8000, bytes(8)), None, telephony.wav("mulaw", 8000, b"")]
    df = spark.createDataFrame([(i, bytearray(f) if f is not None else None, "x") for i, f in enumerate(files)], "id long, media binary, codec string")
    got = {r["id"]: r for r in telephony.read_back(df, carried=("id",)).collect()}
    assert [got[i]["problem"] is None for i in range(10)] == [True, True, True, False, False, False, False, False, True, True]
    assert [got[i]["codec"] for i in (0, 1, 2, 8, 9)] == ["mulaw", "alaw", "ima", None, "mulaw"]
    assert len(got[0]["pcm"]) == 44 + 4 * 576 and len(got[1]["pcm"]) == 44 + 2 * math.ceil(200 * 16000 / 44100) and len(got[2]["pcm"]) == 44 + 2 * 2 * 577
    assert got[8]["pcm"] is None and len(got[9]["pcm"]) == 44
    empty = telephony.read_back(telephony.stored(frame(spark, [])), carried=("doc_id",))
    assert empty.count() == 0
