"""Resampling of documents by their likeness to a target distribution, over hashed n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coded_words import CodedWords, slices
from .common import materialize


def _ngrams(w: CodedWords, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 1 to ``most``: the texts of all n-grams, their places among the distinct
    ones, and the CRC-32 of each distinct one.

    An n-gram is the pair of the (n-1)-gram before and its last word's code, shifted by one word;
    its CRC goes on from that of the shorter one, so no n-gram is ever put together as a string.
    """
    raw, owners = w.raw(), w.owners()
    place, crcs = w.codes.astype(np.int64), np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    yield owners, place, crcs
    codes = place
    for _ in range(most - 1):
        owners_next, codes = owners[1:], codes[1:]
        pairs = place[: len(codes)] * len(raw) + codes
        inside = (owners[: len(codes)] == owners_next) & (owners_next >= 0)
        distinct, at = np.unique(pairs, return_inverse=True)
        before, last = np.divmod(distinct, max(len(raw), 1))
        crcs = np.fromiter((zlib.crc32(b" " + raw[b], int(crcs[a])) for a, b in zip(before.tolist(), last.tolist(), strict=True)), np.int64, len(distinct))
        # what crosses the end of a text stays in place, for the shift, but is no n-gram of its own
        yield owners_next[inside], at[inside], crcs
        owners, place = np.where(inside, owners_next, -1), at


def bucket_counts(texts: DataFrame, *, text_col: str = "text", ngram: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; tasks send one row for each bucket they met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, place, crcs in _ngrams(CodedWords(part.column("text")), ngram):
                    np.add.at(sums, crcs % buckets, np.bincount(place, minlength=len(crcs)))
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": met, "n": sums[met]})

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source frequency of each bucket, with one count added, rounded down."""
    n, more, less = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.fromiter((math.floor(1000 * math.log((t + 1.0) * more / ((s + 1.0) * less))) for s, t in zip(source.tolist(), target.tolist(), strict=True)), np.int64, n)


def importance_weights(docs: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight): the sum of gains over all n-grams of each document."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = CodedWords(part.column("text"))
                features, weight = np.zeros((2, part.num_rows), np.int64)
                for owners, place, crcs in _ngrams(w, ngram):
                    n = np.bincount(owners, minlength=part.num_rows)
                    sums = np.concatenate([[0], np.cumsum(np.take(gains, crcs % buckets)[place])])
                    ends = np.cumsum(n)
                    features += n
                    weight += sums[ends] - sums[ends - n]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(w.counts()), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", ngram: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents without replacement, likelier the more they resemble ``target``.

    Words are counted in hashed buckets over all documents and all target texts; a document's weight
    is the sum of its n-grams' log ratios. Gumbel noise from a hash of the id turns the highest scores
    into a draw without replacement. All rows come back as (doc_id, n_features, weight, score, rank);
    rank counts from 1 in order of score, then id, and is null where a row is not drawn.

    Nulls in the text count as no words; such rows, and those of fewer than ``least_words`` words, are
    scored but never drawn. A null id hashes as empty text and comes last among equal scores; rows of
    one id share their noise, and equal rows get consecutive ranks. Without documents there are no rows,
    without a target all gains follow from the source alone. Other columns of either table play no part.

    Scores are put in ranges by Spark's range exchange, each sorted by itself; a rank is the place in
    its range plus the sizes of those before, so no task orders all rows.
    """
    gains = bucket_gains(bucket_counts(docs, text_col=text_col, ngram=ngram, buckets=buckets), bucket_counts(target, text_col=target_text, ngram=ngram, buckets=buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    weights = importance_weights(docs, gains, id_col=id_col, text_col=text_col, ngram=ngram)
    scored = materialize(weights.withColumn("score", F.col("weight") + noise), "importance-scored")
    able = F.col("n_words") >= least_words
    place = F.monotonically_increasing_id()  # range in the upper bits, place in it in the lower 33
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranged = materialize(scored.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "importance-ranged")
    part = F.shiftrightunsigned("place", 33).cast("long")
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    drawn = percent * before // 100
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    names = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    ranked = ranged.withColumn("part", part).join(offsets, "part").select(*names, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))
