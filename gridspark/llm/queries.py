"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .hidden_markov import hidden_markov_scores
from .importance import importance_resample
from .jaccard_join import jaccard_join
from .language_id import language_id
from .license_scan import license_scan
from .line_dedup import line_dedup
from .packing import pack_documents
from .sharding import shard_records
from .substring_dedup import substring_dedup
from .toxicity import toxicity_scores
from .whitening import whiten_embeddings


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(read_table(spark, sf_dir, "documents"), shards=16)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four lines; matches of two or more lines, or of one line of 20 or more characters."""
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=4, least=2, alone=20)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more lines only."""
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), least=50)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov_scores(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), capacity=2048, added_tokens=True)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents")).drop("regions")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ngram=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is null where it does not fit a long."""
    out = whiten_embeddings(read_table(spark, sf_dir, "embeddings"), components=4)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op4_line_dedup_runs": op4_line_dedup_runs,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WINDOW g AS (PARTITION BY norm)
    """,
    "op4_line_dedup_runs": """
        WITH lines AS (
            SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
            FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
        ), pairs AS (
            SELECT doc_id, i, lead(i) OVER d AS next_i, line || chr(10) || lead(line) OVER d AS run
            FROM lines WHERE NOT regexp_full_match(line, '[ \t\r\v\f]*') WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ), later AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM pairs WHERE run IS NOT NULL) WHERE k > 1
        ), cuts AS (SELECT doc_id, i FROM later UNION SELECT doc_id, next_i FROM later)
        SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (c.i IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN cuts c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
    """,
    "op4_line_dedup": """
        WITH lines AS (
            SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
            FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
        ), counted AS (
            SELECT *, CASE WHEN count(*) OVER (PARTITION BY line) > 1 THEN substr(md5(line), 1, 15) END AS h
            FROM lines WHERE NOT regexp_full_match(line, '[ \t\r\v\f]*')
        ), marked AS (
            SELECT *, h = min(h) OVER (d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) OR h = min(h) OVER (d ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)
                   OR h = min(h) OVER (d ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) OR h = min(h) OVER (d ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS mark
            FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ), anchored AS (
            SELECT doc_id, i, line, coalesce(bool_or(mark) OVER (PARTITION BY h), false) AND h IS NOT NULL AS anchor FROM marked
        ), runs AS (
            SELECT doc_id, n, array_agg(i) OVER w AS places, array_agg(line) OVER w AS run, bool_or(anchor) OVER w AS has_anchor
            FROM anchored, (SELECT unnest([1, 2, 3, 4]) AS n)
            WINDOW w AS (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)
        ), later AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, places[1]) AS k FROM runs
                           WHERE has_anchor AND len(run) = n AND (n > 1 OR length(run[1]) >= 20)) WHERE k > 1
        ), cuts AS (SELECT DISTINCT doc_id, unnest(places) AS i FROM later)
        SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (c.i IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN cuts c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
    """,
    "op12_importance_resampling": r"""
        WITH texts AS (
            SELECT true AS source, doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS parts FROM documents
            UNION ALL
            SELECT false, NULL, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
        ), listed AS (
            SELECT source, doc_id, list_filter(parts, lambda w: w <> '') AS words FROM texts
        ), counts AS (
            SELECT source, doc_id, word, count(*) AS n FROM (SELECT source, doc_id, unnest(words) AS word FROM listed) GROUP BY ALL
        ), crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ), coded AS (
            SELECT word, list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))) AS bytes FROM (SELECT DISTINCT word FROM counts)
        ), hashed AS (
            SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM coded, crc_table
        ), sums AS (
            SELECT bucket, coalesce(sum(n) FILTER (source), 0) AS s, coalesce(sum(n) FILTER (NOT source), 0) AS t FROM counts JOIN hashed USING (word) GROUP BY bucket
        ), totals AS (
            SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM sums
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(big_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(big_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums, totals
        ), weights AS (
            SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM counts JOIN hashed USING (word) JOIN gains USING (bucket) WHERE source GROUP BY doc_id
        ), scored AS (
            SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_features, coalesce(w.weight, 0) AS weight,
                   coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || l.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
            FROM listed l LEFT JOIN weights w USING (doc_id) WHERE l.source
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
    """,
}
