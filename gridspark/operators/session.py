"""Retrieval from a phrase bank that grows within the session: each trial sees only what came before it.

``asked`` has (subject, pos, context): what is asked for at position ``pos`` of a subject's session.
``observed`` has (subject, pos, text): phrases completed at that position, one a position at most, with
normalised text. ``initial`` has (subject, bank_pos, text, weight): the bank that a subject starts with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import parameter_table
from ..functions.text import normalize_context, normalize_text
from ..sources.scratch import written
from .asof import SPAN, sum_before
from .retrieval import STRETCH, _asked, _best_of_phrase, _wanted, phrase_index, retrieval_prior

START = -(1 << 62)  # the position of what was there before the session


def session_bank(observed: DataFrame, initial: DataFrame | None = None, subject: str = "subject", order: str = "pos", weight: float = 1.0) -> DataFrame:
    """(subject, origin, bank_pos, text, weight, since): initial phrases (origin 0), then observed ones (origin 1) from the position they are known since."""
    rows = observed.select(subject, F.lit(1).alias("origin"), F.col(order).cast("long").alias("bank_pos"), normalize_text(F.col("text")).alias("text"), F.lit(float(weight)).alias("weight"), F.col(order).cast("long").alias("since"))
    if initial is not None:
        start = initial.select(subject, F.lit(0).alias("origin"), F.col("bank_pos").cast("long").alias("bank_pos"), normalize_text(F.col("text")).alias("text"), F.col("weight").cast("double").alias("weight"), F.lit(START).alias("since"))
        rows = start.unionByName(rows)
    return rows.where((F.col("text") != "") & (F.col("weight") > 0))


def session_matches(asked: DataFrame, bank: DataFrame, cells: DataFrame, subject: str = "subject", order: str = "pos", top_k: int = 20) -> DataFrame:
    """``phrase_matches`` as of each position: only phrases known before it take part.

    The index keeps, for each stretch, the best initial phrases and the *earliest* observed ones.
    Observed phrases weigh the same and rank by position, so whatever is known at a position, its best
    ``top_k`` are the earliest; later ones can never displace them. Entries carry the position they
    are known since; a context has one list of them, of at most suffixes x 4 ``top_k``, however long
    the session and however often it is asked, and each position takes from it what it knows.
    """
    keys = [subject, order, "context"]
    best = session_lists(asked, bank, cells, subject, top_k)
    known = F.slice(F.filter("_list", lambda m: m["since"] < F.col(order)), 1, top_k)
    spark = asked.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = asked.select(*keys).distinct().repartition(tasks, subject, "context")  # light as they are, but each gives ``top_k`` rows
    rows = rows.join(best, [subject, "context"]).select(*keys, F.posexplode(known).alias("_i", "_m"))
    return rows.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in ("origin", "bank_pos", "score", "len", "cell_idx")], (F.col("_i") + 1).alias("rank"))


def session_lists(asked: DataFrame, bank: DataFrame, cells: DataFrame, subject: str = "subject", top_k: int = 20) -> DataFrame:
    """For each (subject, context), wherever it is asked: ``_list`` of all matches that the index holds,
    the longest and best first. What is known at a position is a part of it, in the same order, so
    nothing is joined, grouped or ordered position by position."""
    keys = [subject, "context"]
    stretches = _asked(asked.select(*keys).distinct(), keys)
    index = phrase_index(bank, cells, top_k, [subject, "origin"], ["bank_pos"], ["bank_pos", "since"], _wanted(stretches, [subject]))
    found = stretches.join(index, [subject, *STRETCH])
    one = _best_of_phrase(found, keys, ["origin", "bank_pos", "since"])
    match = F.struct((-F.col("len")).alias("_l"), (-F.col("score")).alias("_s"), "origin", "bank_pos", "since", "score", "len", "cell_idx")
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(match)).alias("_list"))


def session_sizes(asked: DataFrame, bank: DataFrame, subject: str = "subject", order: str = "pos", span: int = SPAN) -> DataFrame:
    """For each asked (subject, position): how many phrases and words its bank holds by then."""
    words = F.size(F.split("text", " ")).cast("long")
    events = bank.select(subject, F.col("since").alias(order), F.lit(1).cast("long").alias("_p"), words.alias("_t"), F.lit(False).alias("_q"))
    queries = asked.select(subject, F.col(order).cast("long").alias(order)).distinct().select("*", F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_t"), F.lit(True).alias("_q"))
    out = sum_before(events.unionByName(queries), [subject], order, {"phrases": F.col("_p"), "tokens": F.col("_t")}, span)
    return out.where("_q").select(subject, order, "phrases", "tokens")


def session_bigrams(asked: DataFrame, bank: DataFrame, cells: DataFrame, subject: str = "subject", order: str = "pos", span: int = SPAN) -> DataFrame:
    """(subject, pos, context, cell_idx, n): how often each character of the grid followed the context's
    last one (a blank for none) inside the phrases known by then; prefix sums by position."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    pairs = bank.where(F.length("text") > 1).select(subject, "since", "text", "weight", at.alias("_i"))
    pairs = pairs.groupBy(subject, F.col("since").alias(order), F.substr("text", F.col("_i"), F.lit(1)).alias("a"), F.substr("text", F.col("_i") + 1, F.lit(1)).alias("ch")).agg(F.sum("weight").alias("w"))
    events = pairs.join(parameter_table(cells.select("ch", "cell_idx")), "ch").select(subject, order, "a", "cell_idx", "w", F.lit(None).cast("string").alias("context"))
    c = normalize_context(F.col("context"))
    last = asked.select(subject, F.col(order).cast("long").alias(order), "context", F.when(c == "", " ").otherwise(F.substring(c, -1, 1)).alias("a")).distinct()
    queries = last.join(events.select(subject, "a", "cell_idx").distinct(), [subject, "a"]).select(subject, order, "a", "cell_idx", F.lit(0.0).alias("w"), "context")
    out = sum_before(events.unionByName(queries), [subject, "a", "cell_idx"], order, {"n": F.col("w")}, span)
    return out.where("context is not null and n > 0").select(subject, order, "context", "cell_idx", "n")


def session_backoff(asked: DataFrame, bank: DataFrame, cells: DataFrame, subject: str = "subject", order: str = "pos", min_count: float = 2, max_entropy: float = 0.65, span: int = SPAN) -> DataFrame:
    """Shares of the frequent successors of each context's last character, as of its position: (subject,
    pos, context, cell_idx, p), or null cell with ``even`` set if they are too even. Contexts without any have no row."""
    keys = [subject, order, "context"]
    whole = Window.partitionBy(*keys)
    good = session_bigrams(asked, bank, cells, subject, order, span).where(F.col("n") >= min_count).withColumn("p", F.col("n") / F.sum("n").over(whole))
    k = F.count(F.lit(1)).over(whole)
    entropy = F.when(k > 1, -F.sum(F.col("p") * F.log("p")).over(whole) / F.log(k.cast("double"))).otherwise(0.0)
    good = good.withColumn("even", entropy > max_entropy)
    none = F.lit(None)
    out = good.select(*keys, F.when(~F.col("even"), F.col("cell_idx")).otherwise(none).alias("cell_idx"), F.when(~F.col("even"), F.col("p")).otherwise(none).alias("p"), "even")
    return out.distinct()


def session_prior(asked: DataFrame, observed: DataFrame, cells: DataFrame, initial: DataFrame | None = None, subject: str = "subject", order: str = "pos", top_k: int = 20, min_count: float = 2, max_entropy: float = 0.65, span: int = SPAN) -> DataFrame:
    """The prior of each asked context, from its subject's bank as it was before that position.

    Matching phrases give it (source ``word_match``); a context without a match takes the successors of
    its last character (``char_backoff``), if enough and uneven enough. Rows are (subject, pos, context,
    cell_idx, p, confidence, source, reason, phrases, tokens), one for each cell with a share; a context
    without a prior has one row with null cell and source ``none``, and ``reason`` tells why: no_matches
    (nothing in the bank), below_min_count or high_entropy; else it is ``available``.
    """
    keys = [subject, order, "context"]
    asked = asked.select(subject, F.col(order).cast("long").alias(order), "context").distinct()
    bank = session_bank(observed, initial, subject, order)
    words = retrieval_prior(session_matches(asked, bank, cells, subject, order, top_k), [subject, order]).select(*keys, "cell_idx", "p", "confidence", F.lit("word_match").alias("source"))
    words = written(words, "session-matches")
    backoff = session_backoff(asked.join(words.select(*keys).distinct(), keys, "left_anti"), bank, cells, subject, order, min_count, max_entropy, span)
    backoff = backoff.select(*keys, "cell_idx", "p", F.max("p").over(Window.partitionBy(*keys)).alias("confidence"), F.when(~F.col("even"), "char_backoff").alias("source"), "even")
    found = words.withColumn("even", F.lit(False)).unionByName(backoff)
    out = asked.join(found, keys, "left").join(session_sizes(asked, bank, subject, order, span), [subject, order])
    reason = F.when(F.col("cell_idx").isNotNull(), "available").when(F.col("phrases") == 0, "no_matches").when(F.col("even"), "high_entropy").otherwise("below_min_count")
    return out.select(*keys, "cell_idx", "p", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source", F.lit("none")).alias("source"), reason.alias("reason"), "phrases", "tokens")
