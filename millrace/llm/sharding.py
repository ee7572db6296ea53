"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair hashes to a uniform number u in (0, 1) and scores
``-weight / ln(u)``; a record goes to the shard with the largest score.  A new
shard only wins records for itself, and a changed weight moves records only to
or from that shard.  All of it is one projection: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """Shard number for record keys; shard i has weights[i] > 0.

    Null keys are left out of the hash, so all records whose keys are all null
    share one shard; equal keys always share one; ties go to the lower shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(f"shard-{shard}")), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("rank")))
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["rank"]).cast("int")


def numbered(df: DataFrame, group: str, name: str = "slot", buckets: int = 1024, chunk: int = 65_536) -> DataFrame:
    """Adds a gapless number from 0 within each group, in order of a hash of the row.

    Rows that are equal in every column are counted first and expanded last, in
    chunks that are dealt out, so a group or a row that holds a third of the
    table still spreads: windows run over (group, hash bucket), and only groups
    x buckets sums are broadcast.  The number of groups must be bounded (shards).
    """
    columns = df.columns
    rows = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    rows = stored(rows.withColumn("_b", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")), "numbered")
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_b").agg(F.sum("_n").alias("_s"))
    sums = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(group, "_b").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_w", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(sums), placed[group].eqNullSafe(sums["_g"]) & (placed["_b"] == sums["_c"]))
    zero = F.lit(0).cast("long")
    if (rows.agg(F.max("_n")).first()[0] or 0) > chunk:  # the chunks of a row that stands very often go to many tasks
        placed = placed.withColumn("_k", F.explode(F.sequence(zero, F.floor((F.col("_n") - 1) / chunk)))).withColumn("_n", F.least(F.col("_n") - F.col("_k") * chunk, F.lit(chunk)))
        placed = placed.withColumn("_w", F.col("_w") + F.col("_k") * chunk).repartition(*columns, "_k")
    return placed.withColumn("_i", F.explode(F.sequence(zero, F.col("_n") - 1))).select(*columns, (F.col("_o") + F.col("_w") + F.col("_i")).cast("long").alias(name))


def shard_documents(docs: DataFrame, n_shards: int = 8, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is ``key``: the key and the shard count alone decide.  A null text
    has size 1 and the checksum of no bytes; rows with a null key share a shard;
    repeated rows keep a slot each; an empty table gives an empty result; other
    columns are left alone.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous([F.col(key)], [1.0] * n_shards).alias("shard"),
        rendezvous([F.col(key)], [1.0] * (n_shards + 1)).alias("grown_shard"),
    )
    return numbered(rows, "shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
