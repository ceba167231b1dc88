"""Phrase retrieval, character n-grams and blended priors over grid cells.

``cells`` maps a character to its cell (``cell_idx``, ``ch``). Priors are long tables
(context, cell_idx, p) or arrays in cell order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import soft_gate, sufficiency_gate
from ..functions.sizes import parameter_table
from ..functions.text import context_suffixes, hash_percent, normalize_context
from ..sources.scratch import written
from .posterior import argmax, array_sum, let


def build_phrase_bank(registry: DataFrame, salt: str, pct: int = 20, subject: str = "subject", text: str = "target_text", id_col: str = "session_id") -> DataFrame:
    """Distinct upper-case targets outside the hash split: per subject, and for all (subject null)."""
    train = registry.where(hash_percent(F.col(id_col), salt) >= pct).select(F.col(subject).alias("subject"), F.upper(text).alias("text"))
    everyone = train.select(F.lit(None).cast(train.schema["subject"].dataType).alias("subject"), "text")
    return train.unionByName(everyone).distinct()


def bank_sizes(registry: DataFrame, bank: DataFrame, sparse_below: int = 3, subject: str = "subject") -> DataFrame:
    """Phrases per subject, zero included, and whether that is sparse."""
    n = bank.where("subject is not null").groupBy("subject").agg(F.countDistinct("text").alias("phrases"))
    out = registry.select(F.col(subject).alias("subject")).distinct().join(n, "subject", "left")
    return out.withColumn("phrases", F.coalesce("phrases", F.lit(0))).withColumn("sparse", F.col("phrases") < sparse_below)


def sample_bank(corpus: DataFrame, exclude: DataFrame, sizes: Sequence[int], seed: int, text: str = "text", word: str = "word") -> DataFrame:
    """Distinct alphabetic words that are not excluded, ``n`` of them for each size.

    Words are ordered by a seeded hash; only words below a hash threshold that leaves a surplus
    are ordered. A size larger than the vocabulary repeats words in that order.
    """
    words = corpus.select(F.explode(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z\s]", "")), r"\s+")).alias("word")).where("word <> ''").distinct()
    words = words.join(exclude.select(F.lower(word).alias("word")).distinct(), "word", "left_anti").withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("word"))))
    total, most = words.count(), max(sizes)
    share = min(1.0, (most + 6 * most**0.5 + 32) / max(total, 1))
    near = words.where(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32) <= share).orderBy("_h", "word").limit(most)
    ranked = near.withColumn("_r", F.row_number().over(Window.orderBy("_h", "word")) - 1)  # at most max(sizes) rows
    have = min(total, most)
    each = ranked.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes])))
    reps = F.when(F.col("size") > F.col("_r"), F.floor((F.col("size") - 1 - F.col("_r")) / have).cast("int"))
    return each.where("size > _r").withColumn("rep", F.explode(F.sequence(F.lit(0), reps))).select("size", (F.col("_r") + F.col("rep") * have).alias("place"), "word")


#: What tells stretches of text apart in the index: two hashes and the length.
STRETCH = ("_h", "_g", "_n")


def _stretch(x: Column) -> list[Column]:
    return [F.xxhash64(x).alias("_h"), F.hash(x).alias("_g"), F.length(x).alias("_n")]


def phrase_index(bank: DataFrame, cells: DataFrame, top_k: int = 20, by: Sequence[str] = (), order: Sequence[str] = ("bank_pos",), names: Sequence[str] = ("bank_pos",), asked: DataFrame | None = None) -> DataFrame:
    """Inverted index: for each stretch of a phrase that starts at a word, and has a character of the
    grid after it, where the best phrases hold it first and what follows there.

    Rows are (*by, hashes and length of the stretch, first, start, cell_idx, weight, *names). Phrases that
    begin with the stretch (``first``) and others have a list each, of the ``top_k`` of greatest weight,
    then least ``order``. More are never needed: all phrases of one stretch match the same length, and
    a phrase that holds a longer suffix of a context holds the shorter ones with the same character
    after it, so a context's best ``top_k`` are among these lists. A stretch that all phrases share
    leaves each task with ``top_k`` rows of a list, before any shuffle. Of equal texts only the
    ``top_k`` best are cut up, for they hold the same stretches. ``asked`` (of ``by``, hashes and
    length) keeps only stretches that it has.
    """
    alike = Window.partitionBy(*by, "text").orderBy(F.desc("weight"), *order)
    bank = bank.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= top_k).drop("_r")
    bank = bank.repartition(max(int(bank.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * bank.sparkSession.sparkContext.defaultParallelism), F.xxhash64("text", *order))
    chars = "".join(r["ch"] for r in parameter_table(cells).select("ch").distinct().collect())
    known = lambda at: F.position(F.substr("text", at, F.lit(1)), F.lit(chars)) > 0
    starts = F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: (i == 1) | (F.substr(F.col("text"), i - 1, F.lit(1)) == " "))
    rows = bank.where(F.length("text") > 1).withColumn("_starts", starts).withColumn("start", F.explode("_starts")).where(F.col("start") < F.length("text"))
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("start")))).where(known(F.col("start") + F.col("_n")))
    sub = F.substr("text", F.col("start"), F.col("_n"))
    if asked is not None:
        on = [k for k in asked.columns if k not in STRETCH]
        longest = asked.agg(F.max("_n").alias("_most"))
        rows = rows.join(F.broadcast(longest), F.col("_n") <= F.col("_most")).drop("_most")
        rows = rows.withColumns(dict(zip(STRETCH[:2], _stretch(sub), strict=False))).join(asked, [*on, *STRETCH], "left_semi").drop(*STRETCH[:2])
    alone = F.position(F.concat(F.lit(" "), sub), F.concat(F.lit(" "), F.col("text"))) == F.col("start")
    earlier = F.exists("_starts", lambda i: (i < F.col("start")) & (F.substr("text", i, F.col("_n")) == sub) & known(i + F.col("_n")))
    rows = rows.where(F.when(alone, F.lit(True)).otherwise(~earlier))
    rows = rows.select(*by, *_stretch(sub), (F.col("start") == 1).alias("first"), "start", F.substr("text", F.col("start") + F.col("_n"), F.lit(1)).alias("ch"), "weight", *names)
    best = Window.partitionBy(*by, *STRETCH, "first").orderBy(F.desc("weight"), *order)
    rows = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top_k).drop("_r")
    return rows.join(parameter_table(cells.select("ch", "cell_idx")), "ch").drop("ch")


def _asked(contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All suffixes of each context, as the index tells them apart."""
    whole = contexts.select(*keys, normalize_context(F.col("context")).alias("_c"))
    rows = whole.withColumn("_s", F.explode(context_suffixes(F.col("_c"))))
    return rows.select(*keys, *_stretch(F.col("_s")), (F.col("_s") == F.col("_c")).alias("_all"))


def _wanted(asked: DataFrame, by: Sequence[str], most: int = 200_000) -> DataFrame | None:
    """The distinct stretches that are asked for, sent to all tasks; None where there are more than ``most``."""
    rows = written(asked.select(*by, *STRETCH).distinct(), "asked")
    return F.broadcast(rows) if rows.count() <= most else None


def _best_of_phrase(found: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Of the index entries that contexts met: the best of each phrase."""
    score = F.col("weight") * (1.0 + F.col("_n")) * F.when(F.col("first") & F.col("_all"), 2.0).otherwise(1.0)
    best = F.max(F.struct(score.alias("score"), F.col("_n").alias("len"), (-F.col("start")).alias("_s"), F.col("cell_idx"))).alias("_b")
    return found.groupBy(*keys, *names).agg(best).select(*keys, *names, "_b.score", "_b.len", "_b.cell_idx")


def _best_matches(found: DataFrame, keys: Sequence[str], names: Sequence[str], order: Sequence[str], top_k: int) -> DataFrame:
    """The best entry of each phrase, and of these the ``top_k`` longest and best."""
    one = _best_of_phrase(found, keys, names)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("len"), F.desc("score"), *order))
    return one.withColumn("rank", rank).where(F.col("rank") <= top_k)


def phrase_matches(contexts: DataFrame, bank: DataFrame, cells: DataFrame, top_k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Best match of each phrase for each context, the ``top_k`` longest and best per context.

    A suffix of the context (from a word on) must stand in the phrase at a word, with a character
    of the grid after it. Score: weight * (1 + length), doubled if the whole context starts the
    phrase. Ties go to the longer suffix, the earlier start, and the earlier phrase. Contexts meet
    ``phrase_index`` in an equi-join that gives at most 2 ``top_k`` rows for each suffix. As long as
    they ask for few different stretches, the index holds these only.
    """
    keys = [*by, "context"]
    asked = _asked(contexts, keys)
    found = asked.join(phrase_index(bank, cells, top_k, by, asked=_wanted(asked, by)), [*by, *STRETCH])
    return _best_matches(found, keys, ["bank_pos"], ["bank_pos"], top_k)


def retrieval_prior(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of match scores per cell, with the context's confidence (greatest share) and margin."""
    keys = [*by, "context"]
    sums = matches.groupBy(*keys, "cell_idx").agg(F.sum("score").alias("_s"))
    p = sums.withColumn("p", F.try_divide(F.col("_s"), F.sum("_s").over(Window.partitionBy(*keys)))).drop("_s")
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "cell_idx"))
    whole = Window.partitionBy(*keys)
    out = p.withColumn("_k", top)
    first, second = F.max(F.when(F.col("_k") == 1, F.col("p"))).over(whole), F.max(F.when(F.col("_k") == 2, F.col("p"))).over(whole)
    return out.withColumn("confidence", first).withColumn("margin", first - F.coalesce(second, F.lit(0.0))).drop("_k")


def prior_reasons(contexts: DataFrame, matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each context: how many phrases matched, the confidence and margin of its prior, and
    ``reason``: available, no_matches, or no_grid_compatible_next_char (all matches weigh nothing)."""
    keys = [*by, "context"]
    top = retrieval_prior(matches, by).groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max("margin").alias("margin"))
    counts = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.max("len").alias("matched_len"), F.sum("score").alias("_s"))
    out = contexts.select(*keys).distinct().join(counts.join(top, keys), keys, "left")
    reason = F.when(F.col("matches").isNull(), "no_matches").when(F.col("_s") <= 0, "no_grid_compatible_next_char").otherwise("available")
    zero = lambda c: F.when(F.col("_s") > 0, F.col(c)).otherwise(0.0).alias(c)
    return out.select(*keys, F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("matched_len", F.lit(0)).alias("matched_len"), zero("confidence"), zero("margin"), reason.alias("reason"))


def char_bigrams(bank: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted counts of neighbouring characters inside phrases, never across them."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1))
    rows = bank.where(F.length("text") > 1).select(*by, "text", "weight", at.alias("_i"))
    return rows.groupBy(*by, F.substr("text", F.col("_i"), F.lit(1)).alias("a"), F.substr("text", F.col("_i") + 1, F.lit(1)).alias("b")).agg(F.sum("weight").alias("n"))


def bigram_backoff_prior(contexts: DataFrame, bigrams: DataFrame, cells: DataFrame, min_count: float = 2, max_entropy: float = 0.65) -> DataFrame:
    """Shares of frequent successors of the context's last character; none if they are too even."""
    c = normalize_context(F.col("context"))
    last = contexts.select("context", F.when(c == "", " ").otherwise(F.substring(c, -1, 1)).alias("a"))
    good = bigrams.where(F.col("n") >= min_count).join(cells.select(F.col("ch").alias("b"), "cell_idx"), "b")
    total = Window.partitionBy("a")
    good = good.withColumn("p", F.col("n") / F.sum("n").over(total))
    k = F.count(F.lit(1)).over(total)
    entropy = F.when(k > 1, -F.sum(F.col("p") * F.log("p")).over(total) / F.log(k.cast("double"))).otherwise(0.0)
    good = good.withColumn("_h", entropy).where(F.col("_h") <= max_entropy)
    return last.join(good.select("a", "cell_idx", "p"), "a").select("context", "cell_idx", "p")


def normalize_probs(x: Column) -> Column:
    """Non-finite and negative values to 0, then to sum 1; uniform if nothing is left."""
    clean = F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0), 0.0).otherwise(v))
    return let(clean, _share)


def _share(weights: Column) -> Column:
    """Weights to sum 1, or uniform if they are all 0."""
    both = F.struct(weights.alias("w"), array_sum(weights).alias("z"), F.size(weights).cast("double").alias("n"))
    return let(both, lambda s: F.transform(s["w"], lambda v: F.when(s["z"] > 0, v / s["z"]).otherwise(1 / s["n"])))


def softmax_scores(x: Column) -> Column:
    """Stable softmax over the finite scores; others get 0; uniform if there are none."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    top = F.struct(x.alias("x"), F.array_max(F.filter(x, finite)).alias("m"))
    return let(let(top, lambda s: F.transform(s["x"], lambda v: F.when(finite(v), F.exp(v - s["m"])).otherwise(0.0))), _share)


def blend_weights(df: DataFrame, rag_weight: float = 0.25, threshold: float = 0.6, bonus: float = 1.5, subject_threshold: float = 0.2, global_sharp: float = 30, subject_sharp: float = 10, cap: float = 0.9, min_phrases: float = 10, mid: float = 15, sharp: float = 0.2) -> DataFrame:
    """Weights of the global and the subject bank from (global_conf, subject_conf, phrases, tokens).

    A null confidence means no match and gives no weight. The sum is scaled down to ``cap``.
    """
    g = F.when(F.col("global_conf").isNotNull(), rag_weight * soft_gate(F.col("global_conf"), threshold, global_sharp)).otherwise(0.0)
    weight = F.least(F.lit(1.0), F.col("phrases") / F.lit(float(min_phrases)))
    s = F.when(F.col("subject_conf").isNotNull(), rag_weight * bonus * weight * soft_gate(F.col("subject_conf"), subject_threshold, subject_sharp) * sufficiency_gate(F.col("tokens"), mid, sharp)).otherwise(0.0)
    out = df.withColumn("_g", g).withColumn("_s", s)
    scale = F.when(F.col("_g") + F.col("_s") > cap, cap / (F.col("_g") + F.col("_s"))).otherwise(1.0)
    return out.withColumn("global_weight", F.col("_g") * scale).withColumn("subject_weight", F.col("_s") * scale).drop("_g", "_s")


def blend_priors(df: DataFrame, base: str = "base", global_prior: str = "global_prior", subject_prior: str = "subject_prior", **gates: float) -> DataFrame:
    """Add ``prior``: base mixed with the weighted banks (arrays; a bank without matches is null)."""
    w = blend_weights(df, **gates)
    zero = F.transform(base, lambda v: F.lit(0.0))
    gp, sp = F.coalesce(global_prior, zero), F.coalesce(subject_prior, zero)
    mixed = F.zip_with(gp, sp, lambda a, b: a * F.col("global_weight") + b * F.col("subject_weight"))
    w = w.withColumn("_mix", normalize_probs(mixed)).withColumn("_base", normalize_probs(F.col(base))).withColumn("_w", F.col("global_weight") + F.col("subject_weight"))
    return w.withColumn("prior", normalize_probs(F.zip_with("_base", "_mix", lambda b, m: (1 - F.col("_w")) * b + F.col("_w") * m))).drop("_mix", "_base", "_w")


def flip_diagnostics(df: DataFrame, base: str = "base", final: str = "prior", target: str = "target", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """How often the blend changes the best cell: toward the target, away from it, or between others;
    with ``weight`` also the least, greatest and mean weight of the blend (0 if it has none)."""
    b, f, t = argmax(F.col(base)), argmax(F.col(final)), F.col(target)
    flip = b != f
    spread = [F.coalesce(g(weight), F.lit(0.0)).alias(f"weight_{name}") for name, g in (("min", F.min), ("max", F.max), ("mean", F.avg))] if weight else []
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flip).alias("flips"),
        F.count_if(flip & (f == t)).alias("toward"),
        F.count_if(flip & (f != t) & (b == t)).alias("away"),
        F.count_if(flip & (f != t) & (b != t)).alias("other"),
        F.avg(flip.cast("double")).alias("rate"),
        *spread,
    )


def source_counts(df: DataFrame, source: str = "source", by: Sequence[str] = ()) -> DataFrame:
    """How many decisions each source of a prior was used for, and its share; no source counts as base."""
    out = df.groupBy(*by, F.coalesce(F.col(source), F.lit("base")).alias(source)).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per source
    return out.withColumn("share", F.col("n") / F.sum("n").over(whole))


def session_growth(trials: DataFrame, subject: str = "subject", order: str = "pos", text: str = "text", initial: DataFrame | None = None) -> DataFrame:
    """Phrases and words that a subject's bank has before each trial: the initial bank plus the
    phrases of earlier trials, as running sums."""
    words = F.size(F.split(F.trim(F.col(text)), r"\s+"))
    before = Window.partitionBy(subject).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = trials.withColumn("phrases", F.count(text).over(before)).withColumn("tokens", F.coalesce(F.sum(words).over(before), F.lit(0)))
    if initial is None:
        return out
    start = initial.groupBy(subject).agg(F.count(text).alias("_p"), F.sum(words).alias("_t"))
    out = out.join(start, subject, "left")
    return out.withColumn("phrases", F.col("phrases") + F.coalesce("_p", F.lit(0))).withColumn("tokens", F.col("tokens") + F.coalesce("_t", F.lit(0))).drop("_p", "_t")


def _count_grams(texts: list[str], size: int) -> dict[str, int]:
    """How often each stretch of ``size`` characters stands inside these texts."""
    whole = "".join(texts)
    if len(whole) < size:
        return {}
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, place = np.unique(codes, return_inverse=True)
    key = np.zeros(len(codes) - size + 1, np.int64)
    for k in range(size):
        key = key * len(letters) + place[k : k + len(key)]
    ends = np.cumsum([len(t) for t in texts])
    over = np.zeros(len(codes) + 1, bool)  # stretches that cross the end of a text
    for k in range(1, size):
        over[np.maximum(ends - k, 0)] = True
    key, n = np.unique(key[~over[: len(key)]], return_counts=True)
    chars = [letters[key // len(letters) ** (size - 1 - k) % len(letters)] for k in range(size)]
    grams = np.column_stack(chars).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return {grams[i * size : (i + 1) * size]: c for i, c in enumerate(n.tolist())}


def ngram_counts(corpus: DataFrame, order: int = 3, text: str = "text") -> DataFrame:
    """(history, ch, n) for histories of 0 to ``order`` characters; texts are padded at the start.

    Tasks count the stretches of whole batches of texts and emit each once; ``order`` is 3 at most,
    so that a stretch of any characters fits a 64-bit number.
    """
    if not 0 <= order <= 3:
        raise ValueError("order is 0 to 3")
    padded = F.concat(F.lit(" " * order), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            texts, size = [], 0
            for t in batch.column(0):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size > 1_000_000:
                    held.update(_count_grams(texts, order + 1))
                    texts, size = [], 0
            held.update(_count_grams(texts, order + 1))
            if len(held) > 2_000_000:
                yield pa.RecordBatch.from_pydict({"_g": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"_g": list(held), "n": list(held.values())})

    grams = corpus.select(padded.alias("_t")).mapInArrow(count, "_g string, n long").groupBy("_g").agg(F.sum("n").alias("n"))
    whole = grams.select(F.substring("_g", 1, order).alias("_h"), F.substring("_g", order + 1, 1).alias("ch"), "n")
    suffixes = F.array(*[F.substring("_h", order - k + 1, k) for k in range(order + 1)])
    return whole.select(F.explode(suffixes).alias("history"), "ch", "n").groupBy("history", "ch").agg(F.sum("n").alias("n"))


def ngram_prior(counts: DataFrame, contexts: DataFrame, cells: DataFrame, order: int = 3) -> DataFrame:
    """Base prior: successors of the longest known history of a context; an empty context is uniform."""
    usable = counts.join(cells, "ch").select("history", "cell_idx", "n")
    c = normalize_context(F.col("context"))
    tails = F.array(*[F.when(F.length(c) >= k, F.substr(c, F.length(c) - k + 1, F.lit(k))) for k in range(order + 1)])
    asked = contexts.where(c != "").select("context", F.explode(tails).alias("history")).where("history is not null")
    found = asked.join(usable, "history").withColumn("_k", F.length("history"))
    longest = F.max("_k").over(Window.partitionBy("context"))
    found = found.withColumn("_best", longest).where("_k = _best")
    p = found.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("context"))).select("context", "cell_idx", "p")
    empty = contexts.where(c == "").select("context").join(parameter_table(cells.select("cell_idx")))
    n = cells.count()
    return p.unionByName(empty.withColumn("p", F.lit(1.0 / n)))


def top_prior_keys(prior: DataFrame, k: int = 4, keys: Sequence[str] = ("context",)) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("p"), "cell_idx")
    return prior.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_groups_by_prior(groups: DataFrame, prior: DataFrame, keys: Sequence[str], n_rows: int, first_round: bool = False) -> DataFrame:
    """Order in which groups (keys, code, cell_idx) flash: rows then columns in the first round, later by prior mass."""
    mass = groups.join(prior, [*keys, "cell_idx"]).groupBy(*keys, "code").agg(F.sum("p").alias("mass"))
    best = [F.desc(F.round("mass", 12)), F.col("code")]
    order = [(F.col("code") > n_rows).cast("int"), *best] if first_round else best
    return mass.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
