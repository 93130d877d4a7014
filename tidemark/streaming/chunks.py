"""Stateful streams over chunks: ordered emission, batches by seconds, playback hysteresis, throttled progress.

State is per media and bounded by what waits: chunks ahead of the next index, rows of the open batch, one flag.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "blob string"


def _stateful(df: DataFrame, fn, out: str, key: str) -> DataFrame:
    def run(keys, frames, state):
        held = json.loads(state.get[0]) if state.exists else None
        rows, held = fn(keys[0], [r for f in frames for r in f.to_dict("records")], held)
        state.update((json.dumps(held),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return df.groupBy(key).applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


def emit_in_order(df: DataFrame, key: str = "media_id") -> DataFrame:
    """(media_id, chunk, text, late): chunks by index, each once all before it came; a repeat or a late chunk is marked and
    passed on at once, for a side table."""

    def step(media, rows, held):
        held = held or {"next": 0, "waiting": {}}
        out = []
        for r in sorted(rows, key=lambda r: r["chunk"]):
            c = int(r["chunk"])
            if c < held["next"] or str(c) in held["waiting"]:
                out.append((media, c, r["text"], True))
            else:
                held["waiting"][str(c)] = r["text"]
        while str(held["next"]) in held["waiting"]:
            out.append((media, held["next"], held["waiting"].pop(str(held["next"])), False))
            held["next"] += 1
        return out, held

    return _stateful(df, step, f"{key} {dict(df.dtypes)[key]}, chunk int, text string, late boolean", key)


def batches(df: DataFrame, seconds: float = 30.0, key: str = "media_id") -> DataFrame:
    """(media_id, batch, start, end, n, text): a batch is given out once a row ends ``seconds`` after its start.

    The first batch starts with the first row. A row with a null text ends its media: the open batch is given out then.
    """

    def step(media, rows, held):
        held = held or {"batch": 0, "begin": None, "rows": []}
        out = []

        def give(end):
            got, held["rows"] = held["rows"], []
            if got:
                out.append((media, held["batch"], got[0][0], got[-1][1], len(got), "\n".join(x[2] for x in got)))
                held["batch"], held["begin"] = held["batch"] + 1, end

        for r in sorted((r for r in rows if r["text"] is not None), key=lambda r: (r["start"], r["end"])):
            if held["begin"] is None:
                held["begin"] = float(r["start"])
            held["rows"].append([float(r["start"]), float(r["end"]), r["text"]])
            if r["end"] - held["begin"] >= seconds:
                give(float(r["end"]))
        if any(r["text"] is None for r in rows):
            give(None)
        return out, held

    return _stateful(df, step, f"{key} {dict(df.dtypes)[key]}, batch int, start double, end double, n int, text string", key)


def playback(df: DataFrame, low: float = 3.0, high: float = 10.0, key: str = "media_id") -> DataFrame:
    """(media_id, t, state): changes of a player that pauses under ``low`` buffered seconds and resumes from ``high``."""

    def step(media, rows, held):
        playing = True if held is None else held["playing"]
        out = []
        for r in sorted(rows, key=lambda r: r["t"]):
            if playing and r["buffered"] < low:
                playing = False
                out.append((media, float(r["t"]), "paused"))
            elif not playing and r["buffered"] >= high:
                playing = True
                out.append((media, float(r["t"]), "playing"))
        return out, {"playing": playing}

    return _stateful(df, step, f"{key} {dict(df.dtypes)[key]}, t double, state string", key)


def progress(df: DataFrame, every: float = 0.6, key: str = "media_id") -> DataFrame:
    """(media_id, t, stage): reports whose stage is new, or that come ``every`` seconds after the last one given out."""

    def step(media, rows, held):
        held = held or {"t": None, "stage": None}
        out = []
        for r in sorted(rows, key=lambda r: r["t"]):
            if held["stage"] != r["stage"] or r["t"] - held["t"] >= every:
                held = {"t": float(r["t"]), "stage": r["stage"]}
                out.append((media, held["t"], held["stage"]))
        return out, held

    return _stateful(df, step, f"{key} {dict(df.dtypes)[key]}, t double, stage string", key)
