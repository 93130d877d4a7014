"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in WAV files, read to 16-bit samples and resampled.

``stored`` puts bytes into a WAV file as they are: a byte is one sample of mu-law or A-law, or two codes of an ADPCM
block. ``read_back`` takes such files apart again. mu-law and A-law samples expand by tables of 256 entries; ADPCM blocks are
decoded a code at a time for all blocks of a batch at once, as a block holds the state it starts from. The samples are
resampled by a windowed sinc in whole numbers, the same on every machine, and stored as a 16-bit WAV file.

Texts of a batch lie one after another in one array, with silence between them that is as long as the filter, so that no
text hears its neighbour. Batches are bounded by bytes; a longer text stands alone.

Null texts count as empty; a stored payload has at least one unit. Null files give null results, files that can't be read
a ``problem`` and nulls. Rows stay one to one, repeated rows and null ids too, and equal files have equal results; empty
tables give empty results. Other columns are left behind.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches

#: Codec names by the format tag of a WAV file.
TAGS = {6: "alaw", 7: "mulaw", 17: "ima"}
CODECS = ("mulaw", "alaw", "ima")
#: Bytes of codes in an ADPCM block that is written here.
BLOCK = 288
#: Taps of the resampler on either side of a sample, and bits after the point of its weights.
REACH, POINT = 8, 14
#: Bytes of text or of files that a worker takes apart at a time.
MOST = 1 << 20

# Fixed values of the IMA ADPCM format: quantizer steps, and the move in that table for each code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


@lru_cache
def law_table(codec: str) -> np.ndarray:
    """The sample of each code of G.711: sign, a segment of three bits, a place of four bits in it."""
    code = np.arange(256)
    if codec == "mulaw":
        code = 255 - code
        size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33 << 2
        return np.where(code & 128, -size, size).astype(np.int16)
    code = code ^ 0x55
    segment = code >> 4 & 7
    size = np.where(segment, 2 * (code & 15) + 33 << np.maximum(segment - 1, 0), 2 * (code & 15) + 1) << 3
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_samples(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8 (n, 4 + bytes of codes). (n, 1 + 2 * bytes of codes) int16, a step for each code over all blocks."""
    n, width = blocks.shape
    made = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8) << 16 >> 16
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    made[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for k in range(2 * (width - 4)):
        code = codes[k >> 1] >> 4 * (k & 1) & 15
        step = STEPS[at]
        size = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
        at = np.clip(at + MOVES[code], 0, len(STEPS) - 1)
        made[1 + k] = value
    return np.ascontiguousarray(made.T)


@lru_cache
def weights(up: int, down: int) -> np.ndarray:
    """(phase, tap) whole-number weights, each phase summing to 1 << POINT: a sinc under a Hann window."""
    reach = math.ceil(REACH * max(1, down / up))
    cut = min(1.0, up / down)
    away = np.arange(up)[:, None] / up + reach - 1 - np.arange(2 * reach)[None, :]
    shape = np.sinc(away * cut) * np.where(abs(away) < reach, np.cos(np.pi * away / (2 * reach)) ** 2, 0)
    whole = np.rint(shape / shape.sum(axis=1, keepdims=True) * (1 << POINT)).astype(np.int32)
    whole[np.arange(up), abs(away).argmin(axis=1)] += (1 << POINT) - whole.sum(axis=1)
    return whole


def resampled(samples: np.ndarray, up: int, down: int) -> np.ndarray:
    """int16 at up / down times the rate; silence is before and after."""
    n = -(-len(samples) * up // down)
    if up == down or not len(samples):
        return samples.copy()
    table = weights(up, down)
    reach = table.shape[1] // 2
    wide = np.concatenate([np.zeros(reach - 1, np.int32), samples.astype(np.int32), np.zeros(reach + down, np.int32)])
    made = np.zeros(n, dtype=np.int16)
    for first in range(min(up, n)):
        base, phase = divmod(first * down, up)
        count = len(range(first, n, up))
        total = np.full(count, 1 << POINT - 1, dtype=np.int32)
        for tap in np.flatnonzero(table[phase]):
            total += table[phase, tap] * wide[base + tap :: down][:count]
        made[first::up] = np.clip(total >> POINT, -32768, 32767)
    return made


def wav(codec: str, rate: int, data: bytes) -> bytes:
    """A mono WAV file. ADPCM codes are dealt into blocks of BLOCK bytes, each from the value 0 and the smallest step."""
    if codec == "pcm16":
        head = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    elif codec == "ima":
        if len(data) % BLOCK:
            raise ValueError("an ADPCM payload has whole blocks")
        codes = np.frombuffer(data, dtype=np.uint8).reshape(-1, BLOCK)
        data = np.concatenate([np.zeros((len(codes), 4), np.uint8), codes], axis=1).tobytes()
        per = 1 + 2 * BLOCK
        head = struct.pack("<HHIIHHHH", 17, 1, rate, rate * (BLOCK + 4) // per, BLOCK + 4, 4, 2, per)
    else:
        head = struct.pack("<HHIIHHH", {"alaw": 6, "mulaw": 7}[codec], 1, rate, rate, 1, 8, 0)
    size = 4 + 8 + len(head) + 8 + len(data) + len(data) % 2
    return b"".join([struct.pack("<4sI4s4sI", b"RIFF", size, b"WAVE", b"fmt ", len(head)), head, struct.pack("<4sI", b"data", len(data)), data, b"\0" * (len(data) % 2)])


def parsed(media: bytes) -> tuple[str, int, int, memoryview]:
    """(codec, rate, bytes of a block, data) of a mono file."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("a short format chunk")
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None:
                raise ValueError("data before its format")
            tag, channels, rate, _, block, _ = form
            if tag not in TAGS or channels != 1 or not rate:
                raise ValueError("not mono mu-law, A-law or ADPCM")
            data = memoryview(media)[at + 8 : at + 8 + size]
            if len(data) < size or tag == 17 and (block < 5 or size % block):
                raise ValueError("the data is cut short")
            return TAGS[tag], rate, block, data
        at += 8 + size + size % 2
    raise ValueError("no data")


def stored(df: DataFrame, unit: int = 576, fill: int = 255, rate: int = 8000, codec: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as UTF-8, filled up to a positive multiple of ``unit`` bytes and kept
    as the codes of a WAV file. Without ``codec`` the payload's CRC says which of CODECS it is, so equal texts have one."""
    if codec in (None, "ima") and unit % BLOCK:
        raise ValueError("an ADPCM payload has whole blocks")

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, files = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            text = text or b""
            payload = text + bytes([fill]) * (max(1, -(-len(text) // unit)) * unit - len(text))
            sizes.append(len(text))
            files.append(wav(codec or CODECS[zlib.crc32(payload) % len(CODECS)], rate, payload))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(id_and_text(df, id_col, text_col), made, "doc_id long, n_bytes long, media binary", most=MOST)


def _decoded(codec: str, block: int, datas: list[memoryview]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and samples of files of one codec and block size."""
    whole = np.frombuffer(b"".join(datas), dtype=np.uint8)
    if codec == "ima":
        blocks = whole.reshape(-1, block)
        codes, samples, per = blocks[:, 4:].tobytes(), ima_samples(blocks).ravel(), (block, block - 4, 2 * block - 7)
    else:
        codes, samples, per = whole.tobytes(), law_table(codec)[whole], (1, 1, 1)
    ends = np.cumsum([len(d) // per[0] for d in datas])
    cuts = list(zip([0, *ends[:-1]], ends))
    return [codes[a * per[1] : b * per[1]] for a, b in cuts], [samples[a * per[2] : b * per[2]] for a, b in cuts]


def features(samples: list[np.ndarray]) -> list[str]:
    """samples:peak:mean square:changes of sign, of each file, in whole numbers."""
    made = ["0:0:0:0"] * len(samples)
    full = [i for i, s in enumerate(samples) if len(s)]
    if full:
        flat = np.concatenate([samples[i] for i in full]).astype(np.int64)
        sizes = np.array([len(samples[i]) for i in full])
        starts = np.cumsum(sizes) - sizes
        turned = np.diff(flat < 0, prepend=flat[:1] < 0).astype(np.int64)
        turned[starts] = 0
        peaks, squares, turns = np.maximum.reduceat(abs(flat), starts), np.add.reduceat(flat * flat, starts), np.add.reduceat(turned, starts)
        for i, *told in zip(full, sizes, peaks, squares // sizes, turns):
            made[i] = ":".join(map(str, told))
    return made


def read_back(df: DataFrame, rate: int = 16000, media_col: str = "media", carried: tuple[str, ...] = ()) -> DataFrame:
    """(codec, payload binary, feature string, pcm binary, problem, media) of each stored file and ``carried`` columns.

    payload: the file's codes as bytes. feature: the codec, then ``features``. pcm: a 16-bit WAV file at ``rate``.
    """

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(0).to_pylist()
        n = len(files)
        codec, payload, feature, pcm, problem = ([None] * n for _ in range(5))
        alike: dict[tuple[str, int, int], list[tuple[int, memoryview]]] = {}
        for i, file in enumerate(files):
            if file is not None:
                try:
                    name, own, block, data = parsed(file)
                    alike.setdefault((name, own, block), []).append((i, data))
                except ValueError as wrong:
                    problem[i] = str(wrong)
        for (name, own, block), found in alike.items():
            codes, samples = _decoded(name, block, [data for _, data in found])
            common = math.gcd(own, rate)
            up, down = rate // common, own // common
            # Each file starts at a whole number of steps, and silence of the filter's length lies between two.
            quiet = 2 * math.ceil(REACH * max(1, down / up)) + 1
            room = [-(-(len(s) + quiet) // down) * down for s in samples]
            starts = np.cumsum(room) - room
            line = np.zeros(int(sum(room)), dtype=np.int16)
            for start, s in zip(starts, samples):
                line[start : start + len(s)] = s
            line = resampled(line, up, down)
            for (i, _), bytes_of, s, start, told in zip(found, codes, samples, starts, features(samples)):
                first = int(start) // down * up
                codec[i], payload[i], feature[i] = name, bytes_of, f"{name}:{told}"
                pcm[i] = wav("pcm16", rate, line[first : first - (-len(s) * up // down)].astype("<i2").tobytes())
        binary = lambda values: pa.array(values, pa.binary())
        text = lambda values: pa.array(values, pa.string())
        return pa.RecordBatch.from_arrays([text(codec), binary(payload), text(feature), binary(pcm), text(problem), *batch.columns], names=["codec", "payload", "feature", "pcm", "problem", "media", *carried])

    picked = df.select(F.col(media_col).cast("binary").alias("media"), *carried)
    also = "".join(f", `{name}` {kind}" for name, kind in picked.dtypes[1:])
    return map_batches(picked, made, "codec string, payload binary, feature string, pcm binary, problem string, media binary" + also, "media", MOST)
