"""Toxicity by class-conditional Kneser-Ney models with shared back-off counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, _span_hashes, materialize, mix64
from .substring_dedup import _groups

BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())  # ASCII bytes that end a word
COUNTS = "h long, w long, g long, toxic long, plain long"
HEAD = 5  # bytes of a word that its rare forms share
FEATURES = ("whole", "wide", "narrow", "top")
WIDE, NARROW = 32, 8
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def part_of(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids get null."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)).cast("int")


def _tokens(part: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """Words and for each the word before it in its text (0 at the start)."""
    w = Words(part.column("text").to_pylist(), lower=True, breaks=BREAKS)
    before = np.zeros_like(w.hash)
    before[1:] = w.hash[:-1]
    starts = w.bounds[:-1]
    before[starts[starts < len(before)]] = 0
    return w, before


def _heads(w: Words) -> np.ndarray:
    return _span_hashes(w.data, w.start, np.minimum(w.end, w.start + HEAD))


class KneserNey:
    """Log ratios of toxic to ordinary probability: of kept word pairs, and for all other pairs of
    a context's back-off mass plus a word, a head of words, or an unknown word."""

    def __init__(self, pairs, contexts, words, heads, unknown: float):
        def table(keys, values):
            keys = np.asarray(keys).view(np.uint64)
            order = np.argsort(keys)
            return keys[order], np.asarray(values, np.float32)[order]

        self.pairs, self.contexts, self.words, self.heads = table(*pairs), table(*contexts), table(*words), table(*heads)
        self.unknown = np.float32(unknown)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.pairs[0] >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _find(table, keys, default) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.full(len(keys), default, np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        hit = table[0][at] == keys
        return np.where(hit, table[1][at], np.float32(default)), hit

    def ratios(self, before: np.ndarray, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
        out, known = self._find(self.words, words, self.unknown)
        rare = np.flatnonzero(~known)
        out[rare] = self._find(self.heads, heads[rare], self.unknown)[0]
        out += self._find(self.contexts, before, 0.0)[0]
        pair = mix64(before * _PAIR + words)
        maybe = np.flatnonzero(self.bits[(pair >> np.uint64(42)).astype(np.int64)])
        value, hit = self._find(self.pairs, pair[maybe], 0.0)
        out[maybe[hit]] = value[hit]
        return out


def _least(counts: DataFrame, n: Column, least: int, most: int) -> int:
    """The least count, ``least`` or more, that at most ``most`` rows reach."""
    sizes = {r["n"]: r["count"] for r in counts.groupBy(F.least(n, F.lit(100_000)).cast("int").alias("n")).count().collect()}  # at most 100,000 rows
    reach, held = 100_001, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if k < least or held > most:
            break
        reach = k
    return max(reach, least)


def fit_kneser_ney(labelled: DataFrame, *, discount: float = 0.75, least_pairs: int = 3, least_words: int = 2, most: int = 4_000_000) -> KneserNey | None:
    """Bigram models of toxic and ordinary text from (text, toxic); None if a class has no words.

    Each class has a Kneser-Ney model: P(w | h) takes the discounted count of the pair and gives
    the rest of the context's mass to P(w), which takes the discounted number of the word's
    contexts in the class and gives the rest to P(head), the word's first letters, shared evenly by
    the head's kept words and one unseen word. P(head) likewise gives its rest to counts that both
    classes share: in how many classes the head stands, with one more for an unknown head. So a
    rare expression weighs little and a frequent one of a single class much.

    Pairs seen fewer than ``least_pairs`` times, words in fewer than ``least_words`` pairs, and
    heads of one word that is not kept, are cut off; their mass goes to the back-off, so that all
    distributions still sum to one. The cut-offs rise where more than ``most`` rows would be kept,
    which bounds what is collected and broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 0):
            w, before = _tokens(part)
            label = np.repeat(part.column("toxic").to_numpy().astype(np.int64), np.diff(w.bounds))
            _, at, back, n = np.unique(mix64(before * _PAIR + w.hash), return_index=True, return_inverse=True, return_counts=True)
            toxic = np.bincount(back, weights=label, minlength=len(at)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(w.hash[at].view(np.int64)), pa.array(_heads(w)[at].view(np.int64)), pa.array(toxic), pa.array(n - toxic)], names=["h", "w", "g", "toxic", "plain"])

    d = discount
    pairs = materialize(labelled.select("text", "toxic").mapInArrow(count, COUNTS).groupBy("h", "w").agg(F.max("g").alias("g"), F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "toxic-pairs")
    kinds = [F.count_if(F.col("toxic") > 0).alias("kt"), F.count_if(F.col("plain") > 0).alias("kp")]
    words = materialize(pairs.groupBy("w").agg(*kinds, F.count(F.lit(1)).alias("seen"), F.max("g").alias("g")), "toxic-words")
    kept_pair = F.col("toxic") + F.col("plain") >= _least(pairs, F.col("toxic") + F.col("plain"), least_pairs, most)
    kept_word = F.col("seen") >= _least(words, F.col("seen"), least_words, most)

    def less(n: str) -> Column:
        return F.greatest(F.col(n) - d, F.lit(0.0))

    heads = words.groupBy("g").agg(F.sum("kt").alias("kt"), F.sum("kp").alias("kp"), F.count(F.lit(1)).alias("forms"), F.count_if(kept_word).alias("kept"))
    heads = heads.where("forms > 1 or kept > 0").withColumn("k", (F.col("kt") > 0).cast("int") + (F.col("kp") > 0).cast("int"))
    heads = materialize(heads, "toxic-heads")
    t = words.agg(F.sum("kt").alias("kt"), F.sum("kp").alias("kp"), F.sum(F.when(kept_word, less("kt"))).alias("mt"), F.sum(F.when(kept_word, less("kp"))).alias("mp")).first()
    if not (t["kt"] and t["kp"]):
        return None
    u = heads.agg(F.sum(less("kt")).alias("mt"), F.sum(less("kp")).alias("mp"), F.sum("k").alias("k")).first()
    share = (u["k"] or 0) + 1  # one more for unknown heads

    def rest(kept: float | None, total: int) -> float:
        return 1 - (kept or 0.0) / total

    rest_words = {c: rest(t["m" + c], t["k" + c]) for c in "tp"}
    rest_heads = {c: rest(u["m" + c], t["k" + c]) for c in "tp"}
    chances = [((less("k" + c) / t["k" + c] + rest_heads[c] * F.col("k") / share) * rest_words[c] / (F.col("kept") + 1)).alias("g" + c) for c in "tp"]
    heads = materialize(heads.select("g", *chances), "toxic-head-chances")  # chances of one unseen word of the head
    nobody = {c: rest_words[c] * rest_heads[c] / share for c in "tp"}  # chances of an unknown word
    backed = {c: F.coalesce(F.col("g" + c), F.lit(nobody[c])) for c in "tp"}
    words = words.join(heads, "g", "left").select("w", kept_word.alias("kept"), *[(F.when(kept_word, less("k" + c) / t["k" + c]).otherwise(0.0) + backed[c]).alias("p" + c) for c in "tp"])
    words = materialize(words, "toxic-word-chances")
    contexts = pairs.groupBy("h").agg(F.count_if(kept_pair).alias("kept"), *[F.sum(n).alias("c" + c) for c, n in (("t", "toxic"), ("p", "plain"))], *[F.sum(F.when(kept_pair, less(n)).otherwise(0.0)).alias("m" + c) for c, n in (("t", "toxic"), ("p", "plain"))])
    contexts = contexts.where("kept > 0").select("h", "ct", "cp", *[F.when(F.col("c" + c) > 0, 1 - F.col("m" + c) / F.col("c" + c)).otherwise(1.0).alias("r" + c) for c in "tp"])
    contexts = materialize(contexts, "toxic-contexts")
    seen = pairs.where(kept_pair).select("h", "w", "toxic", "plain").join(contexts, "h").join(words.drop("kept"), "w")
    chance = {c: F.when(F.col("c" + c) > 0, less(n) / F.col("c" + c)).otherwise(0.0) + F.col("r" + c) * F.col("p" + c) for c, n in (("t", "toxic"), ("p", "plain"))}

    def ratio(a, b) -> Column:
        return F.log(a / b).cast("float").alias("v")

    got = [
        seen.select("h", "w", ratio(chance["t"], chance["p"])).toArrow(),  # each at most ``most`` rows
        contexts.select("h", ratio(F.col("rt"), F.col("rp"))).toArrow(),
        words.where("kept").select("w", ratio(F.col("pt"), F.col("pp"))).toArrow(),
        heads.select("g", ratio(F.col("gt"), F.col("gp"))).toArrow(),
    ]
    (h, w, v), *others = [[np.asarray(c.to_numpy()) for c in table.columns] for table in got]
    joined = mix64(h.view(np.uint64) * _PAIR + w.view(np.uint64)) if len(h) else np.zeros(0, np.uint64)
    return KneserNey((joined, v), *others, float(np.log(nobody["t"] / nobody["p"])))


def features(ratios: np.ndarray) -> tuple[float, float, float, float]:
    """Length-normalised log ratios: of the whole text, of its most toxic wide and narrow window,
    and of its two most toxic expressions. Zeros for a text without words."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    sums = np.zeros(n + 1)
    np.cumsum(ratios, out=sums[1:])
    peak = [float((sums[min(k, n) :] - sums[: n + 1 - min(k, n)]).max()) / k for k in (WIDE, NARROW)]
    return float(sums[-1]) / n, peak[0], peak[1], float(np.partition(ratios, n - 2)[-2:].mean()) if n > 1 else float(ratios[0]) / 2


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: float = 1.0, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression by damped Newton steps; rows of class 1
    count ``weight`` times."""
    v = np.where(y > 0, weight, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (v * (p - y)) / v.sum() + ridge * np.r_[0, b[1:]]
        hessian = (z * np.maximum(v * p * (1 - p), 1e-6)[:, None]).T @ z / v.sum() + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return np.r_[b[0] - (b[1:] * mean / scale).sum(), b[1:] / scale]


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carry: Sequence[str] = (), folds: int = 5, sample_rows: int = 10_000, toxic_weight: float = 2.0, **model_settings) -> DataFrame:
    """One row per input row: (id, held_out, score, predicted, whole_ratio), then the columns to ``carry``.

    Two bigram models, of toxic and of ordinary text (``fit_kneser_ney``), are fitted on labelled
    rows outside fold 0 of ``folds`` (crc32 of the id as text) and outside the last. A text's
    features are its length-normalised log-likelihood differences over the whole text, over its
    most toxic windows of 32 and 8 words, and over its two most toxic expressions. A logistic curve
    fitted on the last fold, which the models did not see, makes them a score. The models that score
    are then fitted on that fold too. To miss a toxic text counts ``toxic_weight`` times as much as
    to mark a clean one, so a score of 0.5 stands for a chance of 1 / (1 + ``toxic_weight``).

    About ``sample_rows`` labelled rows of each class are used, drawn by a hash of the id; of
    several rows of such an id the one with the greatest text is learnt from. Every row and whole
    text is scored. Labels, ids and all other columns are no inputs of a score. Words are
    lower-cased (A-Z) and end at white space and at ASCII signs, so marks around a word do not
    hide it. A null or empty text has features of
    zero; very long texts are scored whole; repeated rows and rows of one id are scored row by row.
    An id labelled twice is toxic if one label says so; null labels are ignored. Without labels of
    both classes all scores are 0. Null ids are kept, and count as not held out. An empty table
    gives no rows.
    """
    fold = part_of(F.col("id"), folds)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold).where("fold <> 0")
    per_class = {r["toxic"]: r["count"] for r in marked.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    carried = [F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)]
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"), *carried)
    held_out = F.coalesce(fold == 0, F.lit(False))
    extra = [F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)]

    def result(rows: DataFrame, score: Column, whole: Column) -> DataFrame:
        return rows.select(F.col("id").alias(id_col), held_out.alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), whole.alias("whole_ratio"), *extra)

    million = 1_000_000
    share = F.lit(0)
    for kind, n in per_class.items():
        share = F.when(F.col("toxic") == kind, F.lit(int(million * min(1.0, sample_rows / n)))).otherwise(share)
    sample = materialize(marked.where(F.pmod(F.xxhash64("id"), F.lit(million)) < share), "toxic-sample")
    train = source.select("id", "text").join(F.broadcast(sample), "id").groupBy("id", "fold", "toxic").agg(F.max("text").alias("text"))
    train = materialize(train, "toxic-train")  # about 2 * sample_rows texts
    fitted = fit_kneser_ney(train.where(F.col("fold") < folds - 1), **model_settings) if len(per_class) == 2 else None
    if fitted is None:
        return result(source, F.lit(0.0), F.lit(0.0))
    names = [f"{x} double" for x in FEATURES]

    def measured(rows: DataFrame, fitted: KneserNey) -> DataFrame:
        model = rows.sparkSession.sparkContext.broadcast(fitted)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _groups(batches, 0):
                words, before = _tokens(part)
                ratios = model.value.ratios(before, words.hash, _heads(words))
                found = [features(ratios[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                cols = np.array(found, np.float64).reshape(-1, len(FEATURES)).T
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(c) for c in cols]], names=[*part.schema.names[1:], *FEATURES])

        kinds = [f"{c} {kind}" for c, kind in rows.dtypes if c != "text"]
        return rows.mapInArrow(measure, ", ".join([*kinds, *names]))

    tuned = measured(train.where(F.col("fold") == folds - 1).select("text", "toxic"), fitted).toArrow().to_pandas()  # a row for each sampled id of a fold
    fitted = fit_kneser_ney(train, **model_settings)
    if tuned["toxic"].nunique() > 1:
        curve = fit_logistic(tuned[list(FEATURES)].to_numpy(), tuned["toxic"].to_numpy().astype(float), toxic_weight)
    else:
        curve = np.r_[-1.0, 1.0, 0.0, 0.0, 0.0]
    margin = F.lit(float(curve[0]))
    for x, b in zip(FEATURES, curve[1:].tolist(), strict=True):
        margin = margin + F.lit(b) * F.col(x)
    return result(measured(source, fitted), 1 / (1 + F.exp(-margin)), F.col("whole"))
