"""Job tables: a log of changes replayed into a snapshot, and what is left to do of tasks that may have been split.

Log rows (job_id, event_id, at, status, fields map<string,string>) come in any order and may repeat. They are replayed by (at,
event_id): a change of status counts only where the rules allow it from the status that counts so far, so what a late row
says is judged at its place. ``deleted`` is a status like others; after it only a new beginning counts, with fields of its own.

Rows with a null job or time, and with a status that the rules don't know, change nothing. Tasks halve: ``7a`` and ``7b`` are
the halves of task 7, ``7ba`` a quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import Fold, fold_rows

#: From each status the statuses that may follow; None is a job that isn't there. Deleting is allowed from all.
RULES = {None: {"queued"}, "queued": {"running", "failed"}, "running": {"completed", "failed"}, "failed": {"queued"}, "completed": set(), "deleted": {"queued"}}


class Replay(Fold):
    """Adds what became of each row: ``accepted``, ``before`` and ``life`` (how often the job has begun anew after a deletion)."""

    def __init__(self, rules: dict[str | None, set[str]]):
        self.rules, self.status, self.life = rules, None, 0

    def take(self, row):
        wanted, before = row["status"], self.status
        gone = before in (None, "deleted")
        allowed = wanted in self.rules.get(before, ()) or (wanted == "deleted" and not gone)
        if allowed:
            self.life += before == "deleted"
            self.status = wanted
        return [row | {"accepted": allowed, "before": before, "life": self.life}]


def replayed(log: DataFrame, rules: dict[str | None, set[str]] = RULES, key: str = "job_id") -> DataFrame:
    """log, each row once, with ``accepted``, ``before`` (the status that counted) and ``life``, in the order of events a job."""
    rows = log.where(F.col(key).isNotNull() & F.col("at").isNotNull())
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "event_id").orderBy("at", "status"))).where("_n = 1").drop("_n")
    none = F.lit(None).cast("string")
    shaped = once.withColumns({"accepted": F.lit(False), "before": none, "life": F.lit(0)})
    return fold_rows(shaped, lambda: Replay(rules), None, key, ("at", "event_id"))


def snapshot(done: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, status, created_at, updated_at, changes, refused, fields) of each job that isn't deleted: of each field the last
    value that an accepted row of its present life has; created_at is that life's first."""
    last = done.groupBy(key).agg(F.max(F.when(F.col("accepted"), F.col("life"))).alias("_life"), F.count(F.when(~F.col("accepted"), 1)).alias("refused"))
    own = done.where("accepted").join(last.select(key, "_life"), key).where("life = _life")
    order = F.struct("at", "event_id")
    rows = own.groupBy(key).agg(F.max_by("status", order).alias("status"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.count(F.lit(1)).alias("changes"))
    each = own.select(key, "at", "event_id", F.explode("fields").alias("name", "value")).where("value is not null")
    fields = each.groupBy(key, "name").agg(F.max_by("value", order).alias("value")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
    rows = rows.where("status <> 'deleted'").join(last.select(key, "refused"), key).join(fields, key, "left")
    return rows.select(key, "status", "created_at", "updated_at", "changes", "refused", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"))


def remaining(tasks: DataFrame, files: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, label, start, duration, state) of each task (key, label, start, duration) as it stands after files (key, label,
    valid boolean), one for each result there is: the task itself if its own file is there, else the parts that it was split
    into. state is cached, or missing where a part has no file, or none that is valid.

    A result covers all its parts. An invalid file of the whole task asks for the whole again. Parts are found by labels:
    every prefix of a part's label was split, and its other half is a part as well.
    """
    known = files.groupBy(key, "label").agg(F.max("valid").alias("valid"))
    root = F.regexp_extract("label", "^(.*?)([ab]*)$", 1)
    seen = known.withColumns({"root": root, "way": F.regexp_extract("label", "^(.*?)([ab]*)$", 2)})
    named = tasks.select(key, F.col("label").alias("root"), "start", "duration")
    whole = named.join(known.select(key, F.col("label").alias("root"), "valid"), [key, "root"], "left")
    closed = whole.where("valid is not null").select(key, F.col("root").alias("label"), "start", "duration", F.when(F.col("valid"), "cached").otherwise("missing").alias("state"))
    open_ = whole.where("valid is null").select(key, "root", "start", "duration")
    parts = seen.where("way <> ''").join(open_.select(key, "root"), [key, "root"])
    # What a valid part covers needs no look: parts below it are left out.
    ways = lambda w, low, high: F.transform(F.sequence(F.lit(low), high), lambda k: F.substring(w, F.lit(1), k))
    above = parts.where(F.length("way") > 1).select(key, "root", "way", F.explode(ways(F.col("way"), 1, F.length("way") - 1)).alias("up"))
    covered = above.join(parts.where("valid").select(key, "root", F.col("way").alias("up")), [key, "root", "up"]).select(key, "root", "way").distinct()
    parts = parts.join(covered, [key, "root", "way"], "left_anti")
    split = parts.select(key, "root", F.explode(ways(F.col("way"), 0, F.length("way") - 1)).alias("way")).distinct()
    halves = split.select(key, "root", F.explode(F.array(F.concat("way", F.lit("a")), F.concat("way", F.lit("b")))).alias("way"))
    leaves = halves.join(split, [key, "root", "way"], "left_anti").join(parts.select(key, "root", "way", "valid"), [key, "root", "way"], "left")
    # A part's start: the share of the task before it, a binary fraction of its way.
    share = F.aggregate(F.sequence(F.lit(1), F.length("way")), F.lit(0.0), lambda a, k: a + F.when(F.substring("way", k, F.lit(1)) == "b", F.pow(F.lit(0.5), k)).otherwise(0.0))
    placed = leaves.join(open_, [key, "root"]).select(key, F.concat("root", "way").alias("label"), (F.col("start") + F.col("duration") * share).alias("start"), (F.col("duration") * F.pow(F.lit(0.5), F.length("way"))).alias("duration"), F.when(F.col("valid"), "cached").otherwise("missing").alias("state"))
    untouched = open_.join(split.select(key, "root").distinct(), [key, "root"], "left_anti").select(key, F.col("root").alias("label"), "start", "duration", F.lit("missing").alias("state"))
    return closed.unionByName(placed).unionByName(untouched)
