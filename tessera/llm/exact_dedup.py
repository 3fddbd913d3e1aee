"""Exact deduplication by progressive refinement, with DataFrame operations only.

Texts are equal if identical after lower-casing A-Z; null counts as empty. Rows are grouped by length, then by length and
prefix hash, then by the hash of the whole text. After each step a bitmap of the groups that have several rows, of bounded
size, is broadcast, and the next step looks only at rows that hit it: a text without a partner of its length and prefix is
not hashed whole to find its group. Of equal texts the one with the largest doc_id stays.

Groups are counted with map-side partial aggregates; no task gets a whole group. What is shuffled to find them are numbers
and digests, never texts. Groups are joined back by shuffle, where adaptive execution splits a hot key.

One row of each text stays: of rows that repeat a doc_id with the same text one at most is kept and all count in group_size;
with another text they have a verdict of their own. Rows without a doc_id count too, and lose to any other of their text. Further
columns are left behind, but by ``keep_one``, which returns the rows as they were. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut, flagged, sha256_of, texts_of, without

#: Characters that the prefix hash covers.
PREFIX = 256


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)


def _digest(text: Column) -> Column:
    return sha256_of(ascii_lower(text))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text, size and prefix of all rows, and ``_hit``: false if no other row has their length and prefix."""
    text = F.col("text")
    sized = texts_of(docs).withColumn("size", F.octet_length(text))
    sized = flagged(sized, _repeated(sized, "size"), "size", name="_same_size")
    prefix = F.when(F.col("_same_size"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))))
    keyed = sized.withColumn("prefix", prefix).drop("_same_size")
    alike = _repeated(keyed.filter("prefix IS NOT NULL").select("size", "prefix"), "size", "prefix")
    return flagged(keyed, alike, "size", "prefix")


def equal_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, size and digest of the rows that survive, and digest, size, keep_id, group_size and n_keep of groups of several rows.

    n_keep counts the rows of the group that have keep_id; but for tables that repeat a row it is 1.
    """
    full = candidates(docs).filter("_hit").select("doc_id", "size", _digest(F.col("text")).alias("digest"))
    counted = full.groupBy("digest", "size", "doc_id").agg(F.count("*").alias("n"))
    # a null doc_id is less than any
    top = F.max(F.struct(F.col("doc_id").alias("keep_id"), F.col("n").alias("n_keep"))).alias("top")
    groups = counted.groupBy("digest", "size").agg(top, F.sum("n").alias("group_size")).filter("group_size > 1")
    return full, groups.select("digest", "size", "top.keep_id", "top.n_keep", "group_size")


def _numbered(groups: DataFrame) -> DataFrame:
    """Groups whose kept row is repeated, once for each repetition, with ``again`` false for the first. Long runs are dealt out."""
    runs = groups.filter("n_keep > 1").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n_keep - 1) div 4096")))).repartition("digest", "_run")
    each = F.sequence(F.lit(0).cast("long"), F.least(F.lit(4095).cast("long"), F.expr("n_keep - 1 - 4096 * _run")))
    return runs.withColumn("_i", F.explode(each)).withColumn("again", F.expr("_run > 0 OR _i > 0"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256."""
    keys = texts_of(docs).select("doc_id", F.octet_length("text").alias("size"), _digest(F.col("text")).alias("digest"))
    _, groups = equal_groups(docs)
    groups = cut(groups)
    # joined by two columns, though the digest would do: Spark then deals both sides out anew, and can split a hot key
    rows = keys.join(groups, ["digest", "size"], "left")
    alone, same = F.col("group_size").isNull(), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = rows.filter(F.coalesce(~(same & (F.col("n_keep") > 1)), F.lit(True)))  # those come from the groups
    out = rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | same).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    repeats = _numbered(groups).select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (~F.col("again")).alias("kept"), F.col("digest").alias("text_sha256"))
    return out.unionByName(repeats)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that lose to an equal text. Only rows that may have lost are dealt out to be compared.

    Rows that repeat a doc_id and its text are the same but perhaps for other columns: any one of them stays.
    """
    full, groups = equal_groups(docs)
    groups = cut(groups)
    joined = full.join(groups, ["digest", "size"])
    lost = joined.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest")
    repeated = groups.filter("n_keep > 1").select(F.col("keep_id").alias("doc_id"), "digest")
    kept = without(docs, lost.unionByName(repeated), _digest)
    if repeated.isEmpty():
        return kept
    # one row for each repetition, by an aggregate that takes one of them along from every partition
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    unsure = flagged(rows, repeated.withColumnRenamed("doc_id", "_id"), "_id").filter("_hit").select("row", "_id", _digest(F.col("_text")).alias("digest"))
    chosen = repeated.select(F.col("doc_id").alias("_keep"), F.col("digest").alias("_keep_digest"))
    one = unsure.join(chosen, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("digest") == F.col("_keep_digest")), "left_semi")
    return kept.unionByName(one.groupBy("_id", "digest").agg(F.first("row").alias("row")).select("row.*"))


ORACLE = """WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  row_number() OVER (PARTITION BY n ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(n) AS text_sha256 FROM t"""
