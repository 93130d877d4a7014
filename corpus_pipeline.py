"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); each but the last returns the columns of ``documents``. Toxicity and
decontamination decide row by row. Of near copies, the document of the smallest id stays with all its rows. Null texts
go through to the end, where they have no ids and decode to the empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from tidemark.llm.common import read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: What the operators carry beside id and text.
CARRIED = COLUMNS[2:]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity.classify(docs, read_table(spark, sf_dir, "labels"), carried=CARRIED).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two non-blank lines or more go; the documents stay, with their texts and n_chars as they are then.

    Chunks cut by the rolling hash, as in op4, then pairs of lines for the runs that no chunk holds whole; both judge the input.
    """
    chunks = line_dedup.remove_repeated_lines(docs)
    rest = line_dedup.remove_repeated_lines(docs, pairs=True)
    found = chunks.unionByName(rest).where("n_removed > 0").groupBy("doc_id", "tkey").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    both = docs.withColumn("tkey", F.xxhash64("text")).join(found, ["doc_id", "tkey"], "left")
    lines = F.split("text", "\n", -1)
    out = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "out")
    both = both.withColumn("lines", F.when(F.col("spans").isNotNull(), lines)).withColumn("out", out)
    kept = both.withColumn("kept", F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n_chars = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long")
    return kept.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    copies = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words go."""
    return decontaminate.find_benchmark_words(docs, read_table(spark, sf_dir, "benchmark"), carried=CARRIED).where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, text): the ids of each text, and the text that they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, carried=("lang", "source"))
    decoded = bpe.decode(encoded, ranks, carried=("lang", "source"))
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The classifier and the tokenizer can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
