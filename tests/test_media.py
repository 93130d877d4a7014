"""Media facts on files made here."""

import io
import math
import struct
import wave

from pyspark.sql import functions as F

from tidemark.sources import media


def tone(width=2, seconds=1.0, rate=8000, level=0.5):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        top = 2 ** (8 * width - 1) - 1
        for i in range(int(seconds * rate)):
            v = int(level * top * math.sin(i))
            w.writeframesraw(bytes([v + 128]) if width == 1 else struct.pack("<i", v)[:width] if width < 4 else struct.pack("<i", v))
    return out.getvalue()


def test_wav(spark):
    rows = [(1, tone(1)), (2, tone(2)), (3, tone(3)), (4, tone(4)), (5, tone(2, level=0.0)), (6, b"no"), (7, None)]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(rows, "i int, b binary").select("i", media.wav("b").alias("w")).collect()}
    for i in (1, 2, 3, 4):
        assert got[i]["seconds"] == 1.0 and abs(got[i]["dbfs"] - 20 * math.log10(0.5 / math.sqrt(2))) < 0.2
    assert got[5]["dbfs"] is None and got[6]["seconds"] is None and got[7]["rate"] is None
    assert media.wav_facts(media.wav_slice(tone(), 0.25, 0.5))[0] == 0.5


def test_sensor_lines(spark):
    df = spark.createDataFrame([("10, 20, 30\n1,2,3", "GPU Power: 1500 mW", "RMS level dB: -20.5\nRMS level dB: -inf"), ("bad", "", ""), (None, None, None)], "a string, b string, c string")
    got = df.select(media.gpu_snapshot(F.col("a")).alias("g"), media.milliwatts(F.col("b")).alias("w"), media.last_rms(F.col("c")).alias("r"), media.retry_wanted(F.col("c"), F.lit(False), F.lit(-30.0)).alias("q")).collect()
    assert [tuple(r["g"]) for r in got] == [(10, 20, 30), (-1, -1, -1), (-1, -1, -1)]
    assert got[0]["w"] == 1.5 and got[0]["r"] == -20.5 and got[1]["w"] is None and got[1]["r"] is None and [r["q"] for r in got] == [False, True, True]
