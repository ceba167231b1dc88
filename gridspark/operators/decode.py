"""Decisions from accumulated evidence, and comparisons of prior arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..functions.sizes import parameter_table
from .posterior import CHARACTER, array_sum, likeliest, with_softmax


def decode_argmax(acc: DataFrame, col: str = "evidence") -> DataFrame:
    """Add the best cell (of those equally likely to 9 decimals, that of lowest index) and its probability."""
    p = with_softmax(acc, col, "_p")
    return p.withColumn("decision", likeliest(F.col("_p"))).withColumn("confidence", F.array_max("_p")).drop("_p")


def _stop(steps: DataFrame, keys: Sequence[str], when: Column) -> DataFrame:
    """The first step where ``when`` holds, else the last one; one aggregation."""
    extra = ["flashes"] if "flashes" in steps.columns else []
    row = F.struct("step", "decision", "confidence", *extra)
    picked = steps.groupBy(*keys).agg(F.min(F.when(when, row)).alias("_first"), F.max(row).alias("_last"))
    got = picked.select(*keys, F.col("_first").isNotNull().alias("stopped"), F.coalesce("_first", "_last").alias("_d"))
    return got.select(*keys, F.col("_d.decision").alias("decision"), F.col("_d.confidence").alias("confidence"), F.col("_d.step").alias("sequences_used"), *[F.col("_d.flashes").alias("flashes_used") for _ in extra], "stopped")


def dynamic_stop(acc: DataFrame, tau: float = 0.8, min_sequences: int = 2, max_sequences: int = 10, keys: Sequence[str] = CHARACTER) -> DataFrame:
    """Stop at the first step from ``min_sequences`` on whose best cell has at least ``tau``."""
    steps = decode_argmax(acc.where(F.col("step") <= max_sequences))
    return _stop(steps, keys, (F.col("step") >= min_sequences) & (F.col("confidence") >= tau))


def capped_stop(acc: DataFrame, lo: int = 2, hi: int = 10, tau: float = 0.8, keys: Sequence[str] = CHARACTER) -> DataFrame:
    """As ``dynamic_stop`` but looks at all steps: the decision after the last one comes along."""
    steps = decode_argmax(acc)
    stop = _stop(steps.where(F.col("step") <= hi), keys, F.col("step").between(lo, hi) & ((F.col("confidence") >= tau) | (F.col("step") == hi)))
    full = steps.groupBy(*keys).agg(F.max_by("decision", "step").alias("full_decision"), F.max("step").alias("steps"))
    return stop.join(full, list(keys))


def prefix_accuracy(acc: DataFrame, targets: DataFrame, ks: Sequence[int] = (2, 5, 10, 20), keys: Sequence[str] = CHARACTER, cell: str = "cell") -> DataFrame:
    """Accuracy with the first k sequences (or all, where there are fewer)."""
    steps = decode_argmax(acc).join(targets.select(*keys, F.col(cell).alias("_cell")), list(keys))
    best = [F.max(F.when(F.col("step") <= k, F.struct("step", (F.col("decision") == F.col("_cell")).alias("ok")))).alias(f"k{k}") for k in ks]
    one = steps.groupBy(*keys).agg(*best)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}.ok").cast("int").alias("ok")) for k in ks])).alias("_r")).select("_r.*").where("ok is not null")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("characters"), F.avg("ok").alias("accuracy"))


def evaluate_arms(traces: DataFrame, arms: DataFrame, max_sequences: int, keys: Sequence[str] = CHARACTER) -> DataFrame:
    """Decisions of each arm (arm, alpha, tau, min_sequences) over the same evidence.

    ``traces`` has accumulated evidence and a ``log_prior`` array per step; it is computed once and
    the small table of arms is broadcast against it.
    """
    each = traces.where(F.col("step") <= max_sequences).join(parameter_table(arms))
    total = F.zip_with("evidence", "log_prior", lambda e, p: F.when(F.col("alpha") == 0, e).otherwise(e + F.col("alpha") * p))
    steps = decode_argmax(each.withColumn("evidence", total))
    return _stop(steps, [*keys, "arm"], (F.col("step") >= F.col("min_sequences")) & (F.col("confidence") >= F.col("tau")))


def argmax_flips(decisions: DataFrame, reference: str, keys: Sequence[str] = CHARACTER, target: str = "cell") -> DataFrame:
    """Per arm: decisions that differ from the reference arm's, toward and away from the target."""
    ref = decisions.where(F.col("arm") == reference).select(*keys, F.col("decision").alias("_ref"))
    both = decisions.where(F.col("arm") != reference).join(ref, list(keys))
    flip, now, before = F.col("decision") != F.col("_ref"), F.col("decision") == F.col(target), F.col("_ref") == F.col(target)
    return both.groupBy("arm").agg(F.count(F.lit(1)).alias("compared"), F.count_if(flip).alias("flips"), F.count_if(flip & now).alias("toward"), F.count_if(flip & before).alias("away"))


def zero_coverage(trials: DataFrame, traces: DataFrame, keys: Sequence[str] = CHARACTER) -> DataFrame:
    """Trials with a flag: no usable evidence was recorded."""
    have = traces.select(*keys).distinct().withColumn("_have", F.lit(True))
    return trials.join(have, list(keys), "left").withColumn("zero_coverage", F.col("_have").isNull()).drop("_have")


def row_shortlist_decode(scored: DataFrame, shape: tuple[int, int], rows: int = 5, margin: float = 0.08, keys: Sequence[str] = CHARACTER, prior: str = "prior") -> DataFrame:
    """Two stages: rank the first ``rows`` rows by prior mass and evidence, keep the best and a close
    runner-up, then choose among their cells, the lowest of those equally likely to 9 decimals.

    ``scored`` has row and column log-odds (``rows``, ``cols``) and a prior array per character.
    """
    n_rows, n_cols = shape
    keep = min(rows, n_rows)
    mass = [array_sum(F.slice(prior, r * n_cols + 1, n_cols)) for r in range(keep)]
    logs = F.array(*[F.log(clip(m, 1e-9, 1.0)) + F.get("rows", F.lit(r)) for r, m in enumerate(mass)])
    ranked = with_softmax(scored.withColumn("_rl", logs), "_rl", "_rp")
    order = F.sort_array(F.transform("_rp", lambda p, i: F.struct(p.alias("p"), i.alias("r"))), asc=False)
    ranked = ranked.withColumn("_o", order)
    close = F.when(F.get("_o", F.lit(0))["p"] - F.get("_o", F.lit(1))["p"] <= margin, F.slice("_o", 1, 2)).otherwise(F.slice("_o", 1, 1)) if keep > 1 else F.slice("_o", 1, 1)
    chosen = ranked.withColumn("_keep", F.transform(close, lambda s: s["r"]))
    cells = F.array(*[
        F.when(F.array_contains("_keep", r), F.log(F.greatest(F.get(prior, F.lit(r * n_cols + c)), F.lit(1e-9))) + F.get("rows", F.lit(r)) + F.get("cols", F.lit(c))).otherwise(F.lit(-1e300))
        for r in range(keep) for c in range(n_cols)
    ])
    out = with_softmax(chosen.withColumn("_cl", cells), "_cl", "_cp")
    return out.select(*keys, likeliest(F.col("_cp")).alias("decision"), F.array_max("_cp").alias("confidence"), F.size("_keep").alias("rows_kept"))
