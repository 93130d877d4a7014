"""Landed media facts: PCM headers and loudness, probe and sensor outputs."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAV = T.StructType().add("seconds", T.DoubleType()).add("rate", T.IntegerType()).add("channels", T.IntegerType()).add("dbfs", T.DoubleType())


def samples(raw: bytes, width: int) -> np.ndarray:
    """PCM bytes as floats in [-1, 1]: 8 bits unsigned, 16, 24 and 32 bits signed."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        return (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / 2.0**23
    return np.frombuffer(raw[: len(raw) // width * width], f"<i{width}").astype(np.float64) / 2.0 ** (8 * width - 1)


def wav_facts(content: bytes | None) -> tuple:
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            n, rate = w.getnframes(), w.getframerate()
            x = samples(w.readframes(n), w.getsampwidth())
            rms = math.sqrt(float(np.mean(x * x))) if len(x) else 0.0
            return n / rate, rate, w.getnchannels(), 20 * math.log10(rms) if rms > 0 else None
    except (wave.Error, EOFError, ZeroDivisionError):
        return None, None, None, None


@F.pandas_udf(WAV)
def wav(content: pd.Series) -> pd.DataFrame:
    """Seconds, rate, channels and loudness of PCM files; nulls for what is none, no loudness for silence."""
    return pd.DataFrame([wav_facts(c) for c in content], columns=WAV.names)


def wav_slice(content: bytes, start: float, seconds: float) -> bytes:
    """The frames of [start, start + seconds) as a file of its own."""
    with wave.open(io.BytesIO(content)) as w:
        w.setpos(min(w.getnframes(), max(0, round(start * w.getframerate()))))
        frames, params = w.readframes(max(0, round(seconds * w.getframerate()))), w.getparams()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams(params)
        w.writeframes(frames)
    return out.getvalue()


def retry_wanted(text: Column, filtered: Column, dbfs: Column, least: float = -50.0) -> Column:
    """An empty, unfiltered chunk that isn't silent is asked again."""
    return (F.trim(F.coalesce(text, F.lit(""))) == "") & ~F.coalesce(filtered, F.lit(False)) & (F.coalesce(dbfs, F.lit(-120.0)) >= least)


def gpu_snapshot(line: Column) -> Column:
    """struct(used_mb, total_mb, load) of a line of three whole numbers; -1 each where it is none."""
    parts = F.transform(F.split(F.split_part(F.coalesce(line, F.lit("")), F.lit("\n"), F.lit(1)), ","), lambda x: F.trim(x).try_cast("int"))
    ok = (F.size(parts) == 3) & F.forall(parts, lambda x: x.isNotNull())
    at = lambda i, name: F.when(ok, F.get(parts, F.lit(i))).otherwise(-1).alias(name)
    return F.struct(at(0, "used_mb"), at(1, "total_mb"), at(2, "load"))


def milliwatts(text: Column) -> Column:
    """Watts of the power line of a sensor log."""
    return F.regexp_extract(text, r"GPU Power:\s*([0-9.]+)\s*mW", 1).try_cast("double") / 1000


def last_rms(text: Column) -> Column:
    """The last finite RMS level of a filter log."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"RMS level dB:\s*(-?[0-9.]+|-?inf|nan)"), F.lit(1)), lambda x: F.when(x.rlike(r"^-?[0-9.]+$"), x.try_cast("double")))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))


def actual_rate(df: DataFrame, key: str) -> DataFrame:
    """(key, kbps): bytes of all files over all seconds."""
    return df.groupBy(key).agg((F.sum("bytes") * 8 / F.sum("seconds") / 1000).alias("kbps"))
