"""Weighted rendezvous sharding of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def rendezvous(key: Column, shards: Sequence[int], weights: Sequence[float] | None = None) -> Column:
    """The shard with the highest weighted score ``-weight / ln(u)``, u a hash of key and shard.

    A shard gets keys in proportion to its weight. Adding a shard moves keys only into it, and
    changing one weight moves keys only to or from that shard. Ties (and null keys, which all
    hash alike) go to the larger shard number, so the result depends on key and shards alone.
    """
    weights = weights or [1.0] * len(shards)
    if len(weights) != len(shards) or not shards or min(weights) <= 0:
        raise ValueError("give each shard a positive weight")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.xxhash64(key, F.lit(shard)), F.lit(shard)), 11)
        return F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53)))

    scored = [F.struct(score(s, w).alias("score"), F.lit(s).alias("shard")) for s, w in zip(shards, weights, strict=True)]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def shard_records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, weights: Sequence[float] | None = None, block_rows: int = 50_000) -> DataFrame:
    """Assign each row a shard by its key and a gapless slot inside the shard.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard): size is the UTF-8 length plus
    1, ``grown_shard`` the shard under one more shard of weight 1. Slots are dealt in blocks: row numbers
    (written once) hash to blocks of about ``block_rows`` rows, block sizes give offsets, and rows
    are numbered inside their block, so no task orders a whole shard, nor all rows of one id. Null
    texts count as empty for size and checksum; null ids share a shard; repeated rows get slots of
    their own. Texts are only measured where they lie, however long, and never shuffled;
    an empty table gives no rows; extra columns, also of clashing names, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("string")
    grown = list(weights or [1.0] * shards) + [1.0]
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            rendezvous(key, range(shards), weights).alias("shard"),
            rendezvous(key, range(shards + 1), grown).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    blocks = max(32, rows.count() // (block_rows * shards) + 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    ends = Window.partitionBy("shard").orderBy("block")
    offsets = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.sum("n").over(ends) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "block").orderBy("row")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "block"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), "grown_shard")
    )
