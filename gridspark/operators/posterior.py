"""Evidence of scored flashes over the cells of a grid.

A sequence is one row: an array of row scores and one of column scores (or of cell scores), made
by one aggregation. Cell arrays are formed from them only where a prior has to be added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, prob_to_logit
from ..sources.scratch import written

SEQUENCE = ("run", "char_idx", "seq_idx")
CHARACTER = ("run", "char_idx")


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(weights: Column, total: Column | None = None) -> Column:
    """An array divided by its sum (or by ``total``)."""
    both = F.struct(weights.alias("w"), (array_sum(weights) if total is None else total).alias("z"))
    return let(both, lambda s: F.transform(s["w"], lambda v: v / s["z"]))


def softmax(scores: Column) -> Column:
    """Stable softmax of an array column."""
    top = F.struct(scores.alias("x"), F.array_max(scores).alias("m"))
    weights = let(top, lambda s: F.transform(s["x"], lambda v: F.exp(v - s["m"])))
    return let(weights, scaled)


def with_softmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the softmax of an array column. What all cells share stands outside their lambdas: a column that
    only a lambda names would be put into it, and computed for each cell."""
    top = F.struct(F.col(col).alias("x"), F.array_max(col).alias("m"))
    weights = df.withColumn("_w", let(top, lambda s: F.transform(s["x"], lambda v: F.exp(v - s["m"]))))
    whole = weights.withColumn("_z", F.struct(F.col("_w").alias("w"), array_sum(F.col("_w")).alias("z")))
    return whole.withColumn(out, let(F.col("_z"), lambda s: F.transform(s["w"], lambda v: v / s["z"]))).drop("_w", "_z")


def log_softmax_at(scores: Column, at: Column) -> Column:
    top = F.struct(scores.alias("x"), F.array_max(scores).alias("m"), at.alias("at"))
    return let(top, lambda s: F.get(s["x"], s["at"]) - s["m"] - F.log(array_sum(F.transform(s["x"], lambda v: F.exp(v - s["m"])))))


def argmax(x: Column) -> Column:
    """Index of the greatest element; the lowest on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def likeliest(p: Column, decimals: int = 9) -> Column:
    """Index of the greatest probability to ``decimals``, the lowest on ties: cells that are equally
    likely are told apart neither by rounding nor by the order in which their evidence was added."""
    return let(F.transform(p, lambda v: F.round(v, decimals)), argmax)


def row_col_scores(flashes: DataFrame, shape: tuple[int, int], score: Column, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """Sums of ``score`` per row and per column; repeated flashes add up, other codes are ignored."""
    rows, cols = shape
    code = F.col("stim_code")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    total = lambda c: F.coalesce(F.sum(F.when(finite & (code == c), score)), F.lit(0.0))
    return flashes.groupBy(*keys).agg(
        F.array(*[total(c) for c in range(1, rows + 1)]).alias("rows"),
        F.array(*[total(c) for c in range(rows + 1, rows + cols + 1)]).alias("cols"),
        F.count_if(finite & code.between(1, rows)).alias("n_row"),
        F.count_if(finite & code.between(rows + 1, rows + cols)).alias("n_col"),
        F.count(F.lit(1)).alias("n_flashes"),
    )


def outer_sum(rows: Column, cols: Column) -> Column:
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: r + c)))


def row_col_posterior(flashes: DataFrame, shape: tuple[int, int], eps: float = 1e-6, keys: Sequence[str] = SEQUENCE, prob: str = "prob") -> DataFrame:
    """Posterior over cells from flash probabilities: clipped log-odds of its row and column."""
    return _grid_posterior(row_col_scores(flashes, shape, prob_to_logit(F.col(prob), eps), keys), keys)


def row_col_logit_posterior(flashes: DataFrame, shape: tuple[int, int], keys: Sequence[str] = SEQUENCE, logit: str = "logit") -> DataFrame:
    return _grid_posterior(row_col_scores(flashes, shape, F.col(logit), keys), keys)


def _grid_posterior(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    cells = scored.withColumn("scores", outer_sum(F.col("rows"), F.col("cols")))
    return with_softmax(cells, "scores", "posterior").select(*keys, "posterior")


def membership_posterior(flashes: DataFrame, n_cells: int, mask: str = "lit_mask", score: Column | None = None, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """Posterior from flashes of free groups: a cell's evidence is the sum over flashes that lit it."""
    score = F.col("logit") if score is None else score
    lit = [F.coalesce(F.sum(F.when(F.substring(mask, i + 1, 1) == "1", score)), F.lit(0.0)) for i in range(n_cells)]
    return with_softmax(flashes.groupBy(*keys).agg(F.array(*lit).alias("scores")), "scores", "posterior").select(*keys, "posterior")


def sequence_evidence(flashes: DataFrame, shape: tuple[int, int], keys: Sequence[str] = SEQUENCE, logit: str = "logit") -> DataFrame:
    """Sequences that saw a row and a column: row, column and cell probabilities and valid flashes."""
    seen = row_col_scores(flashes, shape, F.col(logit), keys).where("n_row > 0 and n_col > 0")
    p = with_softmax(with_softmax(seen, "rows", "row_p"), "cols", "col_p")
    grid = F.flatten(F.transform("row_p", lambda r: F.transform("col_p", lambda c: r * c)))
    return p.select(*keys, "rows", "cols", "row_p", "col_p", grid.alias("posterior"), (F.col("n_row") + F.col("n_col")).alias("flashes"))


def complete_sequences(flashes: DataFrame, n: int, shape: tuple[int, int], keys: Sequence[str] = SEQUENCE, logit: str = "logit") -> DataFrame:
    """Sequences with exactly ``n`` flashes, all finite, and a target row and column."""
    ok = F.col(logit).isNotNull() & ~F.isnan(logit) & (F.abs(logit) < float("inf"))
    target = lambda low, high: F.max(F.when((F.col("y") == 1) & F.col("stim_code").between(low, high), F.col("stim_code") - low))
    out = flashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("_ok"), target(1, shape[0]).alias("true_row"), target(shape[0] + 1, sum(shape)).alias("true_col"))
    return out.where(f"n = {n} and _ok = {n} and true_row is not null and true_col is not null").drop("_ok")


def target_cell(flashes: DataFrame, shape: tuple[int, int], keys: Sequence[str] = CHARACTER) -> DataFrame:
    """Cell of the most frequent target row and column code; ties go to the lower code."""
    rows, cols = shape
    axis = F.when(F.col("stim_code") <= rows, "row").otherwise("col")
    counts = flashes.where((F.col("y") == 1) & F.col("stim_code").between(1, rows + cols)).groupBy(*keys, axis.alias("axis"), "stim_code").agg(F.count(F.lit(1)).alias("n"))
    best = lambda a: F.max(F.when(F.col("axis") == a, F.struct("n", (-F.col("stim_code")).alias("c"))))
    found = counts.groupBy(*keys).agg(best("row").alias("r"), best("col").alias("c")).where("r is not null and c is not null")
    return found.select(*keys, ((-F.col("r.c") - 1) * cols + (-F.col("c.c") - rows - 1)).cast("int").alias("cell"))


def normalized_entropy(p: Column, epsilon: float = 0.0) -> Column:
    """Entropy of an array, renormalised after adding ``epsilon``, over that of a uniform one."""

    def entropy(s: Column) -> Column:
        h = F.aggregate(s["q"], F.lit(0.0), lambda a, v: a + F.when(v > 0, -v * F.log(v)).otherwise(0.0))
        return (h / s["z"] + F.log(s["z"])) / F.log(F.size(s["q"]).cast("double"))

    return let(F.transform(p, lambda v: v + epsilon), lambda q: let(F.struct(q.alias("q"), array_sum(q).alias("z")), entropy))


def initial_bias(prior: DataFrame, alpha: float, mode: str = "fixed", epsilon: float = 1e-9, col: str = "prior") -> DataFrame:
    """Add ``bias``: alpha times the log prior, -1e9 where it is 0; adaptive trusts a sharp prior more."""
    p = F.col(col)
    if mode == "off":
        return prior.withColumn("bias", F.transform(p, lambda v: F.lit(0.0)))
    trust = F.lit(alpha) * (1 - normalized_entropy(p, epsilon)) if mode == "adaptive" else F.lit(float(alpha))
    return prior.withColumn("bias", let(trust, lambda a: F.transform(p, lambda v: F.when(v == 0, -1e9).otherwise(a * F.log(clip(v, epsilon, 1.0))))))


def fuse(pairs: DataFrame, alpha: float, mode: str = "fixed", epsilon: float = 1e-9, post: str = "posterior", prior: str = "prior") -> DataFrame:
    """Add ``fused``: the product of evidence and prior to the power alpha, per step.

    Cells without prior mass get nothing. Adaptive alpha grows with the entropy of the evidence.
    """
    if mode == "off":
        return pairs.withColumn("fused", F.col(post))
    trust = F.lit(alpha) * normalized_entropy(F.col(post), epsilon) if mode == "adaptive" else F.lit(float(alpha))
    logs = let(trust, lambda a: F.zip_with(post, prior, lambda e, p: F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log(clip(e, epsilon, 1.0)) + a * F.log(clip(p, epsilon, 1.0)))))
    return with_softmax(pairs.withColumn("_l", logs), "_l", "fused").drop("_l")


def accumulate_evidence(post: DataFrame, keys: Sequence[str] = CHARACTER, order: str = "seq_idx", eps: float = 1e-9, max_sequences: int | None = None, bias: DataFrame | None = None, missing: str = "skip") -> DataFrame:
    """Running sum of log posteriors over the sequences of a character, one row per step.

    ``bias`` (keys, bias) is added once per character. With ``missing="uniform"`` the step is the
    sequence number itself, as sequences without evidence add a constant; with ``"skip"`` steps
    count the sequences that have evidence. Steps past ``max_sequences`` are dropped first; without
    that bound rows are written once and the sums run cell by cell, so their cost stays in proportion
    to the sequences.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.row_number().over(w) if missing == "skip" else F.col(order)
    rows = post.withColumn("step", step.cast("int"))
    if max_sequences:
        rows = rows.where(F.col("step") <= max_sequences)
    rows = rows.withColumn("_logs", F.transform("posterior", lambda v: F.log(clip(v, eps, 1.0))))
    if "flashes" in post.columns:
        rows = rows.withColumn("flashes", F.sum("flashes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.transform("_logs", lambda v: F.lit(0.0))
    if bias is not None:
        rows = rows.join(bias.select(*keys, "bias"), list(keys))
        start = F.col("bias")
    if max_sequences:  # a step gathers at most that many arrays
        rows = rows.withColumn("_seen", F.collect_list("_logs").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        total = F.aggregate("_seen", start, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        return rows.withColumn("evidence", total).drop("_logs", "_seen", "bias", "posterior")
    rows = written(rows, "evidence")  # read twice: cell by cell, and to put the sums back
    start = F.transform("_logs", lambda v: F.lit(0.0)) if bias is None else F.col("bias")
    cells = rows.select(*keys, order, F.posexplode("_logs").alias("_c", "_v"))
    running = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("_v", F.sum("_v").over(running)).groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_sum"))
    summed = summed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, order])], F.transform("_sum", lambda s: s["_v"]).alias("_sum"))
    same = [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, order])]
    out = rows.join(summed, same).withColumn("evidence", F.zip_with("_sum", start, lambda a, b: a + b))
    return out.drop("_logs", "_sum", "bias", "posterior", *[f"_k{i}" for i in range(len(same))])
