"""Exact dedup over an extendible-hash index kept in shared files; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[int]:
    """Grow an extendible-hash directory until no bucket holds more than ``capacity`` keys.

    ``counts`` has the number of keys for each ``max_depth``-bit prefix. A bucket over capacity is
    split by its next bit; when that bucket is as deep as the directory, the directory doubles.
    Buckets that are still overfull at ``max_depth`` keep an overflow chain. Returns for each slot
    of the directory the number of its bucket; buckets are numbered in key order.
    """
    slots = [(0, 0)]  # (depth, prefix) of the bucket of each slot; the directory has 2 ** depth slots
    depth, full = 0, [(0, 0)]
    while full:
        local, prefix = full.pop()
        low, high = prefix << (max_depth - local), (prefix + 1) << (max_depth - local)
        if local == max_depth or sum(counts.get(i, 0) for i in range(low, high)) <= capacity:
            continue
        if local == depth:
            slots = [s for s in slots for _ in range(2)]
            depth += 1
        halves = [(local + 1, prefix * 2), (local + 1, prefix * 2 + 1)]
        size = 1 << (depth - local - 1)
        for k, half in enumerate(halves):
            at = (prefix * 2 + k) * size
            slots[at : at + size] = [half] * size
        full += halves
    numbers = {bucket: n for n, bucket in enumerate(dict.fromkeys(slots))}
    return [numbers[s] for s in slots]


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 50_000, max_depth: int = 12, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256, bucket, chain_pos).

    Texts are equal when their bytes agree after lower-casing A-Z. An index in shared files is
    built and then read:

    1. The keys of all rows (``hashed`` of the text, and its digest) are written, and counted by
       their first ``max_depth`` bits. From these counts the directory of an extendible hash is
       grown: overfull buckets split, the directory doubles, to at most ``2 ** max_depth`` slots.
    2. The directory routes each text to its bucket. Copies are combined before the shuffle, and
       the owner of a key compares bytes: texts of one bucket and hash that differ are entries of
       their own.
    3. Owner tasks take ranges of (bucket, hash), chain the entries of equal hash, and write them.
    4. Rows look up their entry by bucket, hash and digest; its entry says which row stays.

    Null texts count as empty. The largest id of a group stays, null ids only if there is no
    other; of repeated rows with the same id one is kept. Very long texts are compared whole; an
    empty table gives no rows; other columns, also of clashing names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    digest = F.sha2("norm", 256).alias("digest")
    keys = materialize(rows.select("id", hashed(F.col("norm")).alias("h"), digest, F.monotonically_increasing_id().alias("row")), "dedup-keys")

    prefix = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    distinct = keys.select("h").distinct()
    counts = {r["slot"]: r["count"] for r in distinct.groupBy(prefix.alias("slot")).count().collect()}  # at most 2 ** max_depth rows
    directory = split_directory(counts, bucket_keys, max_depth)
    depth = len(directory).bit_length() - 1
    buckets = F.array(*map(F.lit, directory)) if depth else F.array(F.lit(0))
    slots = docs.sparkSession.range(1).select(F.posexplode(buckets).alias("slot", "bucket"))  # the directory: at most 2 ** max_depth rows
    slot = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)

    def routed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")

    texts = routed(rows.withColumn("h", hashed(F.col("norm"))))
    entries = texts.groupBy("bucket", "h", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = materialize(entries.select("bucket", "h", digest, "keep_id", "group_size"), "dedup-entries")  # read twice: bounds of ranges, then rows
    chain = Window.partitionBy("bucket", "h").orderBy("digest")
    index = materialize(entries.repartitionByRange("bucket", "h").withColumn("chain_pos", F.row_number().over(chain) - 1), "dedup-index")

    found = routed(keys).join(index, ["bucket", "h", "digest"])
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    found = materialize(found.select("id", "row", same.alias("candidate"), "keep_id", "group_size", "digest", "bucket", "h", "chain_pos"), "dedup-found")
    # repeated rows: of several with the id that stays, the first
    first = found.where("candidate").groupBy("bucket", "h", "digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = found.where("candidate").join(first.select("bucket", "h", "digest", F.col("row").alias("first")), ["bucket", "h", "digest"]).where("row > first").select(F.col("row").alias("again"))
    again = materialize(again, "dedup-again")
    if not again.isEmpty():
        found = found.join(again, F.col("row") == F.col("again"), "left").withColumn("candidate", F.col("candidate") & F.col("again").isNull())
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("candidate").alias("kept"), F.col("digest").alias("text_sha256"), "bucket", "chain_pos")
