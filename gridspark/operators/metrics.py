"""Accuracy, rates, calibration, parameter sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, itr, logit_to_prob, soft_gate, sufficiency_gate
from ..functions.sizes import parameter_table
from ..sources.scratch import written
from .decode import decode_argmax
from .posterior import CHARACTER, argmax, array_sum, log_softmax_at, with_softmax


def accuracy_rollup(decisions: DataFrame, by: str = "condition", seconds: str = "seconds", sequences: str = "sequences_used", flashes: str = "flashes_used") -> DataFrame:
    """Accuracy and cost per condition and overall (condition null), by one rollup."""
    return decisions.rollup(by).agg(
        F.count(F.lit(1)).alias("characters"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(sequences).alias("sequences_per_char"),
        F.avg(flashes).alias("flashes_per_char"),
        F.avg(seconds).alias("seconds_per_char"),
    )


def accuracy_strata(decisions: DataFrame, by: str = "condition", merged: Mapping[str, Sequence[str]] | None = None, overall: str = "overall", seconds: str = "seconds", sequences: str = "sequences_used", flashes: str = "flashes_used") -> DataFrame:
    """Accuracy and cost per stratum: each condition, ``merged`` groups of conditions, and all rows.

    A row counts for all its strata in one aggregation, which sums before anything is shuffled.
    """
    groups = [F.when(F.col(by).isin(list(members)), F.lit(name)) for name, members in (merged or {}).items()]
    strata = F.filter(F.array(F.lit(overall), F.col(by).cast("string"), *groups), lambda s: s.isNotNull())
    return decisions.withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("characters"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(sequences).alias("sequences_per_char"),
        F.avg(flashes).alias("flashes_per_char"),
        F.avg(seconds).alias("seconds_per_char"),
    )


def with_itr(rollup: DataFrame, n: int) -> DataFrame:
    return rollup.withColumn("itr", itr(n, F.col("accuracy"), F.col("seconds_per_char")))


def selection_time(sequences: Column, seconds_per_sequence: Column | None = None, flashes_per_seq: int | None = None, interval: Column | None = None, flashes: Column | None = None, seconds_per_flash: float | None = None) -> Column:
    """Seconds of one decision: sequences of fixed length, sequences of flashes at a measured interval,
    or the flashes that were really shown, at so many seconds each."""
    if flashes is not None and seconds_per_flash is not None:
        return flashes * seconds_per_flash
    return sequences * (seconds_per_sequence if seconds_per_sequence is not None else F.lit(flashes_per_seq) * interval)


def per_subject(decisions: DataFrame, by: str = "subject") -> DataFrame:
    return decisions.groupBy(by).agg(F.count(F.lit(1)).alias("characters"), F.sum(F.col("correct").cast("int")).alias("correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("flashes_used").alias("flashes"), F.avg("nll").alias("nll"))


def pooled_counts(decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ratios of sums over subjects, not means of ratios."""
    out = decisions.groupBy(*by).agg(F.sum(F.col("correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("characters"), F.sum("flashes_used").alias("flashes"))
    return out.withColumn("accuracy", F.col("correct") / F.col("characters")).withColumn("flashes_per_char", F.col("flashes") / F.col("characters"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """Area under the ROC curve with ties counted half; groups of one class are left out.

    Rows are first summed per distinct score. All scores are dealt into ``parts`` ranges of about equal
    size; running sums inside each range of a group start from the sum of the group's ranges below. No
    task orders more than one range, a share of the whole, even if one group has nearly all rows.
    """
    points = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label)).cast("double").alias("_p"), F.sum(1 - F.col(label)).cast("double").alias("_n"))
    points = written(points, "auc-points")  # read for the cuts, the totals and the area
    cuts = sorted(set(points.approxQuantile("_s", [i / parts for i in range(1, parts)], 0.1 / parts)))
    points = points.withColumn("_b", F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c < F.col("_s"))))
    totals = points.groupBy(*by, "_b").agg(F.sum("_n").alias("_t"))
    below = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # ``parts`` rows a group
    base = totals.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_b").alias("_k_b"), F.coalesce(F.sum("_t").over(below), F.lit(0.0)).alias("_base"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_s")) - F.col("_n")
    placed = points.withColumn("_in", inside).join(base, [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], F.col("_b") == F.col("_k_b")])
    area = placed.withColumn("_a", F.col("_p") * (F.col("_base") + F.col("_in") + F.col("_n") / 2))
    out = area.groupBy(*by).agg(F.sum("_a").alias("_a"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n")).where("_p > 0 and _n > 0")
    return out.select(*by, (F.col("_a") / (F.col("_p") * F.col("_n"))).alias("auc"))


def rag_grid_sweep(rows: DataFrame, params: DataFrame, cells: int, objective: str = "nll", seconds: float = 60.0, sharp: float = 30, prior: str = "prior", confidence: str = "confidence", target: str = "target", evidence: str | None = None, eps: float = 1e-9) -> DataFrame:
    """Loss, accuracy and bits per selection of every (weight, threshold, alpha) in ``params``.

    ``rows`` has for each character a retrieval prior (array), its confidence, the target cell and
    perhaps the summed log evidence. Matches do not depend on the parameters, so they are made
    once. The prior counts by ``weight`` times a soft gate of the confidence, the rest is uniform;
    its log counts ``alpha`` times beside the evidence. ``best`` marks the least loss ("nll") or
    the most bits a minute ("itr") at ``seconds`` a selection.
    """
    if objective not in ("nll", "itr"):
        raise ValueError("objective is nll or itr")
    each = rows.join(parameter_table(params))
    w = F.col("weight") * soft_gate(F.col(confidence), F.col("threshold"), sharp)
    mixed = F.transform(prior, lambda v: F.log(F.greatest((1 - w) / cells + w * v, F.lit(eps))) * F.col("alpha"))
    each = each.withColumn("_l", F.zip_with(mixed, evidence, lambda a, b: a + b) if evidence else mixed)
    each = with_softmax(each, "_l", "_p")
    loss = -F.log(F.greatest(F.get("_p", F.col(target)), F.lit(eps)))
    keys = ["weight", "threshold", "alpha"]
    out = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("characters"), F.avg(loss).alias("nll"), F.avg((argmax(F.col("_l")) == F.col(target)).cast("double")).alias("accuracy"))
    out = out.withColumn("itr", itr(cells, F.col("accuracy"), F.lit(seconds)))
    first = F.col("nll") if objective == "nll" else -F.col("itr")
    return out.withColumn("best", F.row_number().over(Window.orderBy(first, *keys)) == 1)  # one row per parameter set


def tier_accuracy(rows: DataFrame, banks: DataFrame, asked: DataFrame, cells: int, weight: float = 0.25, eps: float = 1e-9) -> DataFrame:
    """What each bank size is worth: (tier, tokens, gate, characters, matched, accuracy, nll).

    ``rows`` has the retrieval prior (array) and target cell of each matched character of a tier,
    ``banks`` the tier's phrases, ``asked`` (tier, count) how many characters were asked. The prior
    counts by ``weight`` times the gate of the bank's words. Characters without a match are decided
    on the uniform prior, so on the first cell, and count as missed.
    """
    sizes = banks.groupBy("tier").agg(F.sum(F.size(F.split("text", " "))).alias("tokens")).withColumn("gate", sufficiency_gate(F.col("tokens")))
    each = rows.join(sizes, "tier")
    w = F.lit(weight) * F.col("gate")
    p = (1 - w) / cells + w * F.get("prior", F.col("target"))
    hit = (argmax(F.col("prior")) == F.col("target")).cast("long")
    found = each.groupBy("tier").agg(F.count(F.lit(1)).alias("matched"), F.sum(hit).alias("_hits"), F.sum(-F.log(F.greatest(p, F.lit(eps)))).alias("_loss"))
    out = sizes.join(asked.withColumnRenamed("count", "characters"), "tier").join(found, "tier", "left").fillna(0, ["matched", "_hits", "_loss"])
    loss = (F.col("_loss") + (F.col("characters") - F.col("matched")) * F.log(F.lit(float(cells)))) / F.col("characters")
    return out.select("tier", "tokens", F.round("gate", 6).alias("gate"), "characters", "matched", F.round(F.col("_hits") / F.col("characters"), 6).alias("accuracy"), F.round(loss, 6).alias("nll"))


def balanced_accuracy(df: DataFrame, logit: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    hit = ((F.col(logit) > 0).cast("int") == F.col(label)).cast("double")
    recall = lambda k: F.avg(F.when(F.col(label) == k, hit))
    return df.groupBy(*by).agg(((recall(0) + recall(1)) / 2).alias("balanced_accuracy"))


def binary_nll(df: DataFrame, logit: str, label: str, by: Sequence[str] = (), eps: float = 1e-7) -> DataFrame:
    p = clip(logit_to_prob(F.col(logit)), eps, 1 - eps)
    return df.groupBy(*by).agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log1p(-p))).alias("nll"))


def ece(df: DataFrame, prob: str, correct: str, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over equal bins ``[lo, hi)``, the last one closed."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    per = df.groupBy(*by, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.avg(prob).alias("_p"), F.avg(F.col(correct).cast("double")).alias("_c"))
    return per.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_c"))) / F.sum("_n")).alias("ece"))


def sequence_metrics(sequences: DataFrame, bins: int = 15) -> DataFrame:
    """Row and column NLL, top-label calibration error and accuracies of complete sequences
    (``row_p``, ``col_p``, ``true_row``, ``true_col``)."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_p").alias("p"), F.col(f"true_{a}").alias("t")) for a in ("row", "col")])
    long = sequences.select(F.explode(axes).alias("_x")).select("_x.*")
    top = F.array_max("p")
    long = long.select("axis", top.alias("conf"), ((F.array_position("p", top) - 1) == F.col("t")).cast("int").alias("ok"), (-F.log(F.greatest(F.get("p", F.col("t")), F.lit(1e-15)))).alias("loss"))
    long = long.withColumn("_b", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)))
    per = long.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("conf"), F.sum("ok").alias("ok"), F.sum("loss").alias("loss"), *[F.sum(F.when(F.col("axis") == a, F.col("ok"))).alias(f"{a}_ok") for a in ("row", "col")])
    n = F.sum("n")
    return per.agg((n / 2).cast("long").alias("complete_sequences"), (F.sum("loss") / n).alias("row_column_nll"), (F.sum(F.abs(F.col("conf") - F.col("ok"))) / n).alias("top_label_ece"), (F.sum("row_ok") * 2 / n).alias("row_accuracy"), (F.sum("col_ok") * 2 / n).alias("column_accuracy"))


def stop_histogram(decisions: DataFrame, max_sequences: int) -> DataFrame:
    """Decisions by sequences used, a column for wrong and one for right."""
    return decisions.groupBy("sequences_used").agg(F.count_if(~F.col("correct")).alias("wrong"), F.count_if("correct").alias("right")).where(F.col("sequences_used") <= max_sequences)


def _policy_sums(steps: list, confidences: list, decisions: list, hits: list, policies: list[tuple], default: int) -> np.ndarray:
    """Sums over these characters for each policy: characters, hits, steps, flips, corrected, regressed.

    With steps from ``min`` to ``max``, only a step of greater confidence than all before it can end a
    character, and it does so for the thresholds between the two: a stretch of the sorted thresholds, at
    whose ends its numbers are added and taken off. Running sums give all thresholds at once.
    """
    width = max(map(len, steps), default=0)
    shape = (len(steps), width)
    step, conf, choice, hit = np.full(shape, np.iinfo(np.int64).max), np.full(shape, -np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool)
    for i, row in enumerate(zip(steps, confidences, decisions, hits, strict=True)):
        order = np.argsort(row[0], kind="stable")
        for target, values in zip((step, conf, choice, hit), row, strict=True):
            target[i, : len(order)] = np.asarray(values)[order]

    def segments(low: int, high: int, taus: np.ndarray):
        """(characters, columns, first threshold, end) of what ends each character where."""
        within = step <= high
        able = np.where(within & (step >= low), conf, -np.inf)
        best = np.maximum.accumulate(able, axis=1)
        before = np.column_stack([np.full(len(best), -np.inf), best[:, :-1]])
        who, at = np.nonzero(able > before)
        yield who, at, np.searchsorted(taus, before[who, at], "right"), np.searchsorted(taus, able[who, at], "right")
        some = np.flatnonzero(within.any(axis=1))
        last = within[some].sum(axis=1) - 1
        yield some, last, np.searchsorted(taus, best[some, -1], "right"), np.full(len(some), len(taus))

    _, tau, low, high = policies[default]
    ref, ref_hit, has = np.zeros(len(steps), np.int64), np.zeros(len(steps), bool), np.zeros(len(steps), bool)
    for who, at, a, e in segments(low, high, np.array([tau])):
        own = (a == 0) & (e == 1)
        ref[who[own]], ref_hit[who[own]], has[who[own]] = choice[who[own], at[own]], hit[who[own], at[own]], True
    out = np.zeros((len(policies), 6))
    for low, high in sorted({p[2:] for p in policies}):
        rows = sorted((i for i, p in enumerate(policies) if p[2:] == (low, high)), key=lambda i: policies[i][1])
        taus = np.array([policies[i][1] for i in rows])
        edges = np.zeros((len(taus) + 1, 6))
        for who, at, a, e in segments(low, high, taus):
            ok = hit[who, at]
            flip = has[who] & (choice[who, at] != ref[who])
            numbers = np.column_stack([np.ones(len(who)), ok, step[who, at], flip, flip & ok & ~ref_hit[who], flip & ~ok & ref_hit[who]]).astype(float)
            np.add.at(edges, a, numbers)
            np.add.at(edges, e, -numbers)
        out[rows] = np.cumsum(edges, axis=0)[:-1]
    return out


def policy_sweep(traces: DataFrame, policies: DataFrame, targets: DataFrame, default: str, n_choices: int, seconds_per_sequence: float, keys: Sequence[str] = CHARACTER, most: int = 1_000_000) -> DataFrame:
    """Accuracy, cost and changes against the default for each policy (policy, tau, min_sequences, max_sequences).

    Traces do not depend on the policy: each step is decoded once, and a character's steps meet all
    thresholds of the same bounds together (``_policy_sums``), so the cost goes with steps and distinct
    bounds, not with policies. Tasks send one row a policy. At most ``most`` policies, else an error.
    """
    given = policies.select("policy", F.col("tau").cast("double"), F.col("min_sequences").cast("int"), F.col("max_sequences").cast("int")).limit(most + 1).collect()
    if len(given) > most:
        raise ValueError(f"more than {most} policies")
    names, table = [r[0] for r in given], [tuple(r) for r in given]
    at = names.index(default)
    steps = decode_argmax(traces).select(*keys, "step", "decision", "confidence").join(targets.select(*keys, "cell"), list(keys))
    each = steps.groupBy(*keys).agg(F.collect_list(F.struct("step", "confidence", "decision", (F.col("decision") == F.col("cell")).alias("ok"))).alias("_s"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(table), 6))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = batch.column(0).slice(start, 4096).to_pylist()
                sums += _policy_sums(*[[[s[c] for s in r] for r in rows] for c in ("step", "confidence", "decision", "ok")], table, at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), *[pa.array(c) for c in sums.T]], names=["i", "c", "h", "s", "f", "g", "r"])

    summed = each.select("_s").mapInArrow(add, "i long, c double, h double, s double, f double, g double, r double").groupBy("i").agg(*[F.sum(x).alias(x) for x in "chsfgr"]).where("c > 0")
    named = F.broadcast(policies.sparkSession.createDataFrame(list(enumerate(names)), f"i long, policy {dict(policies.dtypes)['policy']}"))  # at most ``most`` rows
    out = summed.join(named, "i").select(
        "policy",
        F.col("c").cast("long").alias("characters"),
        (F.col("h") / F.col("c")).alias("accuracy"),
        (F.col("s") / F.col("c")).alias("mean_sequences"),
        F.col("f").cast("long").alias("flips"),
        F.col("g").cast("long").alias("corrected"),
        F.col("r").cast("long").alias("regressed"),
    )
    return out.withColumn("itr", itr(n_choices, F.col("accuracy"), F.col("mean_sequences") * seconds_per_sequence))


def select_policy(sweep: DataFrame, default: str) -> DataFrame:
    """Fewest sequences without loss of accuracy against the default; ties by accuracy, then ITR.

    A sweep has one row per policy, so the order is over that small table. The default itself is
    always eligible and is the answer where nothing else is.
    """
    base = F.max(F.when(F.col("policy") == default, F.col("accuracy"))).over(Window.partitionBy(F.lit(1)))
    eligible = sweep.withColumn("_base", base).where(F.col("accuracy") >= F.col("_base")).drop("_base")
    return eligible.orderBy("mean_sequences", F.desc("accuracy"), F.desc("itr"), "policy").limit(1)


def fit_alpha_grid(evidence: DataFrame, alphas: Sequence[float], adaptive: bool = False, eps: float = 1e-12) -> DataFrame:
    """Mean NLL of the target for each alpha, from (evidence, prior, cell) rows; least NLL first.

    The grid is a literal array, exploded against each character, so evidence is read once.
    """
    prior = F.transform("prior", lambda v: clip(v, eps, 1.0))
    rows = evidence.withColumn("_logp", F.transform(prior, lambda v: F.log(v)))
    entropy = -array_sum(F.zip_with("_logp", prior, lambda a, b: a * b)) / F.log(F.size("prior").cast("double"))
    rows = rows.withColumn("_trust", 1 - entropy if adaptive else F.lit(1.0))
    each = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    each = each.withColumn("_s", F.zip_with("evidence", "_logp", lambda e, p: e + F.col("alpha") * F.col("_trust") * p))
    return each.groupBy("alpha").agg(F.avg(-log_softmax_at(F.col("_s"), F.col("cell"))).alias("nll"), F.count(F.lit(1)).alias("characters"))


def best_alpha(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.min(F.struct("nll", "alpha")).alias("_b")).select("_b.alpha", "_b.nll")
