"""Comment trees: roots, depth from parent links, reply targets, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import written


def is_root():
    """No parent, parent '0', or its own parent."""
    parent = F.coalesce(F.col("parent_id").cast("string"), F.lit(""))
    return parent.isin("", "0") | (parent == F.col("node_id").cast("string"))


def depths(df: DataFrame) -> DataFrame:
    """(thread_id, node_id, root_id, depth) of the nodes that a root reaches, at any depth.

    Pointers double: in each round a node learns what the node it points to knows, so a chain of n replies takes about
    log2(n) rounds. A round that finishes no node is the last one: as long as a root reaches open nodes, some finish.
    Nodes that none reaches are left out, cycles too; ``orphans`` names those without a parent. Node ids are unique within
    a thread.
    """
    rows = df.select("thread_id", "node_id", F.col("parent_id").alias("up"), is_root().alias("is_root"))
    none = F.lit(None)
    up_type, node_type = rows.schema["up"].dataType, rows.schema["node_id"].dataType
    done = written(rows.where("is_root").select("thread_id", "node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth")), "roots")
    left = written(rows.where("not is_root").select("thread_id", "node_id", "up", F.lit(1).alias("depth")), "open-nodes")
    while True:
        known = done.withColumn("up", none.cast(up_type)).unionByName(left.withColumn("root_id", none.cast(node_type)))
        known = known.select(F.col("thread_id").alias("_t"), F.col("node_id").alias("_n"), F.col("up").alias("_up"), "root_id", F.col("depth").alias("_depth"))
        joined = left.join(known, (F.col("thread_id") == F.col("_t")) & (F.col("up") == F.col("_n")))
        step = written(joined.select("thread_id", "node_id", F.col("_up").alias("up"), "root_id", (F.col("depth") + F.col("_depth")).alias("depth")), "nodes")
        found = step.where("root_id is not null").drop("up")
        if found.isEmpty():
            return done
        done = done.unionByName(found)
        left = step.where("root_id is null").drop("root_id")


def orphans(df: DataFrame) -> DataFrame:
    """Nodes whose parent isn't there."""
    nodes = df.select("thread_id", F.col("node_id").alias("_n"))
    return df.where(~is_root()).join(nodes, (df["thread_id"] == nodes["thread_id"]) & (F.col("parent_id") == F.col("_n")), "left_anti")


def reply_targets(df: DataFrame, levels: DataFrame) -> DataFrame:
    """(node_id, target): the author of the parent, where the parent isn't the root itself."""
    parents = df.select(F.col("node_id").alias("_p"), F.col("author").alias("_author"))
    rows = df.join(levels.select("node_id", "root_id"), "node_id").join(parents, F.col("parent_id") == F.col("_p"), "left")
    return rows.select("thread_id", "node_id", F.when(F.col("parent_id") != F.col("root_id"), F.col("_author")).alias("target"))


def counts(df: DataFrame) -> DataFrame:
    """Roots, replies and pages (20 roots each, at least one) of every thread."""
    root = is_root()
    return df.groupBy("thread_id").agg(F.count_if(root).alias("roots"), F.count_if(~root).alias("replies")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("roots") / 20)).cast("long"))


def page(df: DataFrame, number: int, size: int = 20) -> DataFrame:
    """The roots of one page over all threads, by id. Ids are dealt by range, so no task holds all of them."""
    rows = df.where(is_root()).select("thread_id", "node_id")
    order = Window.orderBy("node_id")
    first = rows.orderBy("node_id").limit(number * size)
    return first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > (number - 1) * size).drop("_n")


def from_export(df: DataFrame, roots: str = "roots", nested: str = "nested") -> DataFrame:
    """Rows in visit order of an export: array of root structs, map of root id to its replies."""
    at = df.select(F.posexplode(roots).alias("i", "root"), F.col(nested).alias("n"))
    root = at.select("i", F.lit(-1).alias("j"), F.lit(0).alias("depth"), "root.*")
    replies = at.select("i", F.posexplode(F.element_at("n", F.col("root.node_id").cast("string"))).alias("j", "reply")).select("i", "j", F.lit(1).alias("depth"), "reply.*")
    return root.unionByName(replies).withColumn("pos", F.row_number().over(Window.orderBy("i", "j"))).drop("i", "j")


def clean_message(message):
    return F.trim(F.regexp_replace(tx.html_unescaped(message), r"\r\n?", "\n"))


def local_times(epoch, zone: str = "Asia/Shanghai"):
    """(date and time, date) of epoch seconds as strings in a zone."""
    at = F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd")


REPLY = "struct<rpid:string,rpid_str:string,parent:string,parent_str:string,mid:string,ctime:bigint,like:bigint,rcount:bigint,count:bigint,member:struct<mid:string,uname:string>,content:struct<message:string>>"


def comment_rows(df: DataFrame, root: str = "root_rpid", content: str = "content", zone: str = "Asia/Shanghai") -> DataFrame:
    """df with the columns of a flat comment, of a nested reply as JSON. Of ids, the first that isn't empty counts, the given
    root before the reply's own; missing texts are empty, missing numbers 0. A reply that can't be read is all empty."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names], F.lit(""))
    number = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in names], F.lit(0))
    moment, day = local_times(F.col("_r.ctime"), zone)
    dated = lambda c: F.when(number("_r.ctime") != 0, c).otherwise("")
    made = {
        "root_rpid": first(root, "_r.rpid_str", "_r.rpid"), "parent_rpid": first("_r.parent_str", "_r.parent"), "rpid": first("_r.rpid_str", "_r.rpid"),
        "author_mid": first("_r.member.mid", "_r.mid"), "author_name": first("_r.member.uname"), "like": number("_r.like"), "reply_count": number("_r.rcount", "_r.count"),
        "ctime": number("_r.ctime"), "send_date": dated(day), "send_datetime": dated(moment), "message": clean_message(first("_r.content.message")),
    }
    rows = df.withColumn("_r", F.from_json(content, REPLY))
    return rows.select(*[c for c in df.columns if c not in made and c != content], *[c.alias(n) for n, c in made.items()])
