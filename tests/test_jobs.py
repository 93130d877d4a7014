"""Replayed logs and what is left of split tasks, against plain loops."""

import random

from tidemark.operators import jobs as jb

LOG = "job_id long, event_id long, at double, status string, fields map<string,string>"


def test_replay_and_snapshot(spark):
    rng = random.Random(1)
    rows = []
    for job in range(30):
        for e in range(rng.randrange(1, 25)):
            row = (job, e, rng.choice([float(e), float(rng.randrange(20))]), rng.choice(["queued", "running", "completed", "failed", "deleted", "odd", None]), rng.choice([None, {}, {"model": str(e)}, {"path": f"p{e}", "error": None}]))
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(None, 1, 1.0, "queued", None), (99, 1, None, "queued", None)]
    rng.shuffle(rows)
    done = jb.replayed(spark.createDataFrame(rows, LOG))
    told = {(r["job_id"], r["event_id"]): (r["accepted"], r["before"], r["life"]) for r in done.collect()}
    got = {r["job_id"]: tuple(r)[1:] for r in jb.snapshot(done).collect()}
    for job in range(30):
        own = sorted({(r[1], r[2], r[3], tuple(sorted((r[4] or {}).items()))) for r in rows if r[0] == job}, key=lambda r: (r[1], r[0]))
        status, life, fields, times, refused = None, 0, {}, [], 0
        for e, at, wanted, pairs in own:
            ok = wanted in jb.RULES.get(status, ()) or (wanted == "deleted" and status not in (None, "deleted"))
            if ok and status == "deleted":
                life, fields, times = life + 1, {}, []
            assert told[job, e] == (ok, status, life)
            refused += not ok
            if ok:
                status = wanted
                times.append(at)
                fields |= {k: v for k, v in pairs if v is not None}
        assert got.get(job) == (None if status in (None, "deleted") else (status, times[0], times[-1], len(times), refused, fields))
    assert jb.snapshot(jb.replayed(spark.createDataFrame([], LOG))).collect() == []


def left(label, start, duration, valid, top=True):
    """(label, start, duration, state) of what is there below a task."""
    if label in valid and (top or valid[label]):
        return [(label, start, duration, "cached" if valid[label] else "missing")]
    below = [x for x in valid if x.startswith(label) and x != label and set(x[len(label) :]) <= {"a", "b"}]
    if not below:
        return [(label, start, duration, "missing")]
    half = duration / 2
    return left(label + "a", start, half, valid, False) + left(label + "b", start + half, half, valid, False)


def test_remaining_parts(spark):
    rng = random.Random(6)
    tasks = [(m, str(k), 32.0 * k, 32.0) for m in range(20) for k in range(4)]
    files = []
    for m, k, _, _ in tasks:
        for _ in range(rng.randrange(0, 5)):
            files.append((m, k + "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 1, 2, 3]))), rng.random() < 0.75))
    files += [(99, "0", True), (0, "77a", True)]
    got = jb.remaining(spark.createDataFrame(tasks, "media_id long, label string, start double, duration double"), spark.createDataFrame(files, "media_id long, label string, valid boolean")).collect()
    for m in range(20):
        valid = {}
        for mm, label, ok in files:
            if mm == m:
                valid[label] = valid.get(label, False) or ok
        want = [x for mm, k, s, d in tasks if mm == m for x in left(k, s, d, valid)]
        assert sorted(tuple(r)[1:] for r in got if r["media_id"] == m) == sorted(want)
    assert {r["media_id"] for r in got} == set(range(20))
