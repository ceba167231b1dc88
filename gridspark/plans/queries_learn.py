"""Queries over classifiers, calibration, further sweeps and streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import calibrate as K
from ..operators import classify as C
from ..operators import epochs as E
from ..operators import metrics as M
from ..operators import posterior as P
from ..operators import retrieval as R
from ..sources.scratch import new_path, written
from ..sources.results import ResultStore
from ..sources.tables import upsert_results
from ..streaming import streams as X
from .queries_decode import _ACC, KEYS, SHAPE, _soft, evidence, prior_arrays, rounded
from .queries_retrieval import _PRIOR, bank, contexts
from .registry import Tables, query

CHANNELS, LENGTH = 4, 16


def epochs(t: Tables) -> DataFrame:
    return t("epochs").withColumn("x", F.transform("x", lambda v: v.cast("double")))


def fitted(df: DataFrame, model: C.LinearModel) -> DataFrame:
    return C.score_linear(df, model).select("vec_id", "y", F.round("logit", 6).alias("logit"))


@query("standard_scaler", "SELECT i - 1 AS i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT i, CAST(x[i] AS DOUBLE) AS v FROM (SELECT *, CAST(unnest(range(1, 65)) AS INT) AS i FROM {epochs})) GROUP BY i")
def standard_scaler(t: Tables) -> DataFrame:
    return rounded(C.standard_scaler(epochs(t)), "mean", "std")


@query("score_linear", "SELECT vec_id, round(sum((i % 5 - 2) * CAST(x[i] AS DOUBLE) / 2) + 0.25, 6) AS logit FROM (SELECT *, unnest(range(1, 65)) AS i FROM {epochs}) GROUP BY vec_id")
def score_linear(t: Tables) -> DataFrame:
    model = C.LinearModel(np.array([i % 5 - 2 for i in range(1, 65)]), 0.5)
    return C.score_linear(epochs(t), model, 2.0).select("vec_id", F.round("logit", 6).alias("logit"))


@query("fit_logistic")
def fit_logistic(t: Tables) -> DataFrame:
    return fitted(epochs(t), C.fit_logistic(epochs(t)))


@query("fit_swlda")
def fit_swlda(t: Tables) -> DataFrame:
    return fitted(epochs(t), C.fit_swlda(epochs(t)))


@query("tune_swlda")
def tune_swlda(t: Tables) -> DataFrame:
    grid = [(0.05, 0.1), (0.1, 0.15), (0.2, 0.25)]
    best, aucs = C.tune_swlda(epochs(t), grid, "run")
    rows = [(e, r, round(a, 6), (e, r) == best) for (e, r), a in zip(grid, aucs, strict=True)]
    return t.spark.createDataFrame(rows, "p_enter double, p_remove double, auc double, best boolean")


@query("fit_shrinkage_lda")
def fit_shrinkage_lda(t: Tables) -> DataFrame:
    return fitted(epochs(t), C.fit_shrinkage_lda(epochs(t)))


@query("fit_xdawn")
def fit_xdawn(t: Tables) -> DataFrame:
    data = epochs(t)
    projected = C.apply_filters(data, C.fit_xdawn(data, CHANNELS, nfilter=2))
    return fitted(projected, C.fit_shrinkage_lda(projected))


@query("tangent_space_lr")
def tangent_space_lr(t: Tables) -> DataFrame:
    scored = C.tangent_space_lr(epochs(t), CHANNELS, nfilter=2).apply(epochs(t))
    return scored.select("vec_id", "y", F.round("logit", 6).alias("logit"))


@query("mdm_scores")
def mdm_scores(t: Tables) -> DataFrame:
    return C.mdm_scores(epochs(t), CHANNELS, nfilter=2).select("vec_id", "y", F.round("logit", 6).alias("logit"))


shrunk = C.lda_fit()


@query("stack_scores")
def stack_scores(t: Tables) -> DataFrame:
    """Both base scores are out of fold."""
    data = epochs(t)
    a, b = (C.cross_fit(data, fit, "run", 3) for fit in (shrunk, C.fit_logistic))
    return C.stack_scores(a, b, "vec_id")[0].withColumn("logit", F.round("logit", 6))


@query("nested_stack")
def nested_stack(t: Tables) -> DataFrame:
    scored = C.nested_stack(epochs(t), (shrunk, C.swlda_fit()), "run", "vec_id", 2, 2)[0]
    return scored.select("vec_id", "fold", F.round("logit", 6).alias("logit"))


@query("cross_fit")
def cross_fit(t: Tables) -> DataFrame:
    return C.cross_fit(epochs(t), shrunk, "run", 3).select("vec_id", "run", "fold", F.round("logit", 6).alias("logit"))


def best_of(scored: DataFrame) -> float:
    return K.fit_temperature(scored)[0]


@query("nested_cross_fit")
def nested_cross_fit(t: Tables) -> DataFrame:
    scored = C.nested_cross_fit(epochs(t), shrunk, "run", 3, 3, best_of)[0]
    return scored.select("vec_id", "run", "fold", F.round("logit", 6).alias("logit"), F.round("calibrated", 6).alias("calibrated"))


@query("fit_final")
def fit_final(t: Tables) -> DataFrame:
    """The model of all rows at the temperature of its out-of-fold scores."""
    model, temperature = C.fit_final(epochs(t), shrunk, "run", 3, best_of)
    return C.score_linear(epochs(t), model, temperature).select("vec_id", F.round("logit", 6).alias("logit"), F.lit(round(temperature, 6)).alias("temperature"))


@query("prob_to_logit", "SELECT event_id, round(ln(greatest(least(value / 400, 1 - 1e-7), 1e-7)) - ln(1 - greatest(least(value / 400, 1 - 1e-7), 1e-7)), 6) AS logit FROM {events}")
def prob_to_logit(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.round(N.prob_to_logit(F.col("value") / 400), 6).alias("logit"))


@query("logit_to_prob", "SELECT flash_id, round(1 / (1 + exp(-logit)), 6) AS p FROM {scores}")
def logit_to_prob(t: Tables) -> DataFrame:
    return t("scores").select("flash_id", F.round(N.logit_to_prob(F.col("logit")), 6).alias("p"))


@query("average_scores", "SELECT subject, y, round(avg(logit) FILTER (flash_id % 5 <> 0), 6) AS logit FROM {scores} GROUP BY subject, y")
def average_scores(t: Tables) -> DataFrame:
    df = t("scores").withColumn("logit", F.when(F.col("flash_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("logit")))
    return rounded(C.average_scores(df, ["subject", "y"]), "logit")


@query(
    "fit_temperature",
    "SELECT CAST(t AS DOUBLE) AS temperature, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS nll FROM (SELECT v.t, s.y, greatest(least(1 / (1 + exp(-s.logit / v.t)), 1 - 1e-12), 1e-12) AS p FROM {scores} s CROSS JOIN (VALUES (0.5), (1.0), (2.0), (4.0)) v(t)) GROUP BY t",
)
def fit_temperature(t: Tables) -> DataFrame:
    """The loss over a grid; ``best_temperature`` searches on."""
    return rounded(K.temperature_nll(t("scores"), [0.5, 1.0, 2.0, 4.0]), "nll")


@query("best_temperature")
def best_temperature(t: Tables) -> DataFrame:
    best, nll = K.fit_temperature(t("scores"))
    return t.spark.createDataFrame([(round(best, 6), round(nll, 6))], "temperature double, nll double")


_COMPLETE = "(SELECT run, char_idx, seq_idx, max(stim_code - 1) FILTER (y = 1 AND stim_code <= 3) AS true_row, max(stim_code - 4) FILTER (y = 1 AND stim_code > 3) AS true_col FROM {flashes} GROUP BY run, char_idx, seq_idx HAVING count(*) = 6)"


def complete(t: Tables) -> DataFrame:
    full = P.complete_sequences(t("flashes"), 6, SHAPE).select(*KEYS, "true_row", "true_col")
    return evidence(t).join(full, KEYS)


@query(
    "fit_sequence_temperature",
    f"""SELECT CAST(t AS DOUBLE) AS temperature, round(avg(l), 6) AS nll FROM (SELECT v.t, f.run, f.char_idx, f.seq_idx, f.stim_code <= 3 AS ax, ln(sum(exp(f.logit / v.t))) - max(f.logit / v.t) FILTER (f.stim_code - 1 = c.true_row OR f.stim_code - 4 = c.true_col) AS l
        FROM {{flashes}} f JOIN {_COMPLETE} c ON f.run = c.run AND f.char_idx = c.char_idx AND f.seq_idx = c.seq_idx CROSS JOIN (VALUES (0.5), (1.0), (2.0)) v(t) WHERE true_row IS NOT NULL AND true_col IS NOT NULL GROUP BY v.t, f.run, f.char_idx, f.seq_idx, f.stim_code <= 3) GROUP BY t""",
)
def fit_sequence_temperature(t: Tables) -> DataFrame:
    return rounded(K.sequence_temperature_nll(complete(t), [0.5, 1.0, 2.0]), "nll")


@query("best_sequence_temperature")
def best_sequence_temperature(t: Tables) -> DataFrame:
    best, nll = K.fit_sequence_temperature(complete(t))
    return t.spark.createDataFrame([(round(best, 6), round(nll, 6))], "temperature double, nll double")


# Further sweeps ----------------------------------------------------------------------------------

_NEXT = "(SELECT context, min(cell_idx) AS target FROM (SELECT lower(substr(p_name, 1, CAST(1 + p_partkey % 8 AS INT))) AS context, lower(substr(p_name, CAST(2 + p_partkey % 8 AS INT), 1)) AS ch FROM {part}) n JOIN {letters} l ON n.ch = l.ch GROUP BY context)"
_SETS = "(VALUES (0.25), (0.7)) v(w) CROSS JOIN (VALUES (0.4), (0.6)) h(th) CROSS JOIN (VALUES (0.5), (1.0)) a(alpha)"
_CELLS = "(SELECT count(*) AS n FROM {letters})"
_RAG = f"""(SELECT w, th, alpha, count(*) AS characters, avg(-ln(greatest(hit / (mass + (n - m) * power(rest, alpha)), 1e-9))) AS nll FROM (
      SELECT w, th, alpha, context, n, max(rest) AS rest, count(*) AS m, sum(power(rest + g * p, alpha)) AS mass, power(max(rest) + coalesce(max(g * p) FILTER (cell_idx = target), 0), alpha) AS hit FROM (
        SELECT v.w, h.th, a.alpha, q.context, q.cell_idx, q.p, t.target, c.n, v.w / (1 + exp(-30 * (q.confidence - h.th))) AS g, (1 - v.w / (1 + exp(-30 * (q.confidence - h.th)))) / c.n AS rest
        FROM {_PRIOR} q JOIN {_NEXT} t ON q.context = t.context CROSS JOIN {_CELLS} c CROSS JOIN {_SETS}) GROUP BY w, th, alpha, context, n) GROUP BY w, th, alpha)"""


def matched(t: Tables, prior: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Retrieval priors as arrays over the grid's cells, with the cell that follows each context."""
    keys = [*by, "context"]
    cells = t("letters").count()
    found = prior.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell_idx", "p"))).alias("_m"), F.max("confidence").alias("confidence"))
    array = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    k = (1 + F.col("p_partkey") % 8).cast("int")
    after = t("part").select(F.lower(F.substr("p_name", F.lit(1), k)).alias("context"), F.lower(F.substr("p_name", k + 1, F.lit(1))).alias("ch"))
    after = after.join(t("letters"), "ch").groupBy("context").agg(F.min("cell_idx").alias("target"))
    return found.withColumn("prior", array).drop("_m").join(after, "context")


@query("rag_grid_sweep", f"SELECT CAST(w AS DOUBLE) AS weight, CAST(th AS DOUBLE) AS threshold, CAST(alpha AS DOUBLE) AS alpha, characters, round(nll, 6) AS nll, row_number() OVER (ORDER BY nll, w, th, alpha) = 1 AS best FROM {_RAG}")
def rag_grid_sweep(t: Tables) -> DataFrame:
    """Retrieval weight, threshold and exponent over the matches of every context; matches are made once."""
    rows = matched(t, R.retrieval_prior(R.phrase_matches(contexts(t), bank(t), t("letters"))))
    params = t.spark.sql("SELECT cast(w as double) weight, cast(h as double) threshold, cast(a as double) alpha FROM VALUES (0.25), (0.7) AS a(w) CROSS JOIN (SELECT * FROM VALUES (0.4), (0.6) AS b(h)) CROSS JOIN (SELECT * FROM VALUES (0.5), (1.0) AS c(a))")
    out = M.rag_grid_sweep(rows, params, t("letters").count())
    return out.select("weight", "threshold", "alpha", "characters", F.round("nll", 6).alias("nll"), "best")


_TIERS = "(VALUES (18), (150), (1000)) s(n)"
_BANKED = "(SELECT bank_pos, lower(text) AS text, weight, row_number() OVER (ORDER BY md5('5:' || CAST(bank_pos AS VARCHAR)), bank_pos) AS r FROM {phrase_bank} WHERE weight > 0)"


@query(
    "sufficiency_sweep",
    f"SELECT CAST(s.n AS INT) AS tier, sum(len(string_split(b.text, ' ')))::BIGINT AS tokens, round(1 / (1 + exp(-0.2 * (sum(len(string_split(b.text, ' '))) - 15))), 6) AS gate FROM {_BANKED} b JOIN {_TIERS} ON b.r <= s.n GROUP BY s.n",
)
def sufficiency_sweep(t: Tables) -> DataFrame:
    """Gate value per size of the bank; the tier is a key like any other."""
    draws = bank(t).withColumn("_h", F.md5(F.concat(F.lit("5:"), F.col("bank_pos").cast("string")))).orderBy("_h", "bank_pos").limit(1000)
    ranked = draws.withColumn("_r", F.row_number().over(Window.orderBy("_h", "bank_pos")))  # at most 1000 rows
    tiers = ranked.withColumn("tier", F.explode(F.array(F.lit(18), F.lit(150), F.lit(1000)))).where("_r <= tier")
    out = tiers.groupBy("tier").agg(F.sum(F.size(F.split("text", " "))).alias("tokens"))
    return out.withColumn("gate", F.round(N.sufficiency_gate(F.col("tokens")), 6))


@query("sufficiency_accuracy")
def sufficiency_accuracy(t: Tables) -> DataFrame:
    """Gate, accuracy and loss per size of the bank: the tier is a key of matches and priors."""
    draws = bank(t).withColumn("_h", F.md5(F.concat(F.lit("5:"), F.col("bank_pos").cast("string")))).orderBy("_h", "bank_pos").limit(1000)
    ranked = draws.withColumn("_r", F.row_number().over(Window.orderBy("_h", "bank_pos")))  # at most 1000 rows
    sizes = F.explode(F.array(F.lit(18), F.lit(150), F.lit(1000)))
    tiers = ranked.withColumn("tier", sizes).where("_r <= tier")
    asked = contexts(t).withColumn("tier", sizes)
    prior = R.retrieval_prior(R.phrase_matches(asked, tiers, t("letters"), by=["tier"]), by=["tier"])
    return M.tier_accuracy(matched(t, prior, ("tier",)), tiers, asked.groupBy("tier").count(), t("letters").count())


@query("config_screen")
def config_screen(t: Tables) -> DataFrame:
    """The same fit and measure for a few feature configurations, one row each."""
    results = None
    for name, window, decim, names in (("all", 1.5, 1, "abcd"), ("decim_3", 1.5, 3, "abcd"), ("short", 0.8, 1, "abcd"), ("two", 1.5, 1, "ac")):
        nested = E.crop_decimate(epochs(t), CHANNELS, LENGTH, 0.0, 10.0, window, decim)
        features = E.flatten_features(E.pick_channels(nested, "abcd", names))
        scored = C.cross_fit(features, shrunk, "run", 3)
        row = M.roc_auc(scored, "logit", "y").select(F.lit(name).alias("config"), F.round("auc", 4).alias("auc"))
        results = row if results is None else upsert_results(results, row, ["config"])
    return results


# Streams -----------------------------------------------------------------------------------------


def run_stream(t: Tables, source: DataFrame, build: Callable[[DataFrame], DataFrame], part: Column | None = None, parts: int = 3, files: int = 2, last: DataFrame | None = None) -> DataFrame:
    """Write ``source`` in ``parts``, one after the other, and ``last`` after them, stream them through
    ``build``, a part a micro-batch, to a Parquet sink, and read that."""
    out, folder = start_stream(t, source, build, part, parts, files, last)
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{folder}/out")


def start_stream(t: Tables, source: DataFrame, build: Callable[[DataFrame], DataFrame], part: Column | None = None, parts: int = 3, files: int = 2, last: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The stream of such parts through ``build``, and the folder for its state. ``source`` is computed once;
    large parts are written by all cores."""
    spark = t.spark
    folder = new_path(spark, "stream")
    rows = written(source.withColumn("_part", F.pmod(F.xxhash64(*source.columns), F.lit(parts)) if part is None else part), "arriving")
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    files = max(files, min(min(sizes.get(k, 0) for k in range(parts)) // 100_000, spark.sparkContext.defaultParallelism))
    for k in range(parts):
        rows.where(F.col("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(f"{folder}/in")
    if last is not None:
        last.select(*source.columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return build(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")), folder


def at_second(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + n.cast("long"))


def end_of(t: Tables, source: DataFrame, key: str) -> DataFrame:
    """A row of no data, years after all others: it moves the watermark past every timer."""
    columns = [F.lit(-1).cast(f.dataType).alias(f.name) if f.name == key else at_second(F.lit(10**9)).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
    return t.spark.range(1).select(*columns)


@query("stream_edges", "SELECT run, CAST(sample AS BIGINT) AS sample, signal FROM (SELECT run, sample, signal, lag(signal) OVER (PARTITION BY run ORDER BY sample) AS p FROM {samples}) WHERE p <= 25 AND signal > 25")
def stream_edges(t: Tables) -> DataFrame:
    """Samples in any order, over three micro-batches; at the end the watermark closes all recordings."""
    rows = t("samples").select(F.col("run").cast("long").alias("run"), "sample", "signal", at_second(F.col("sample")).alias("ts"))
    with X.rocksdb(t.spark):
        return run_stream(t, rows, lambda s: X.stream_edges(s.withWatermark("ts", "1 day"), 25.0), last=end_of(t, rows, "run"))


_FIRST = f"(SELECT run, char_idx, step, max(p) AS confidence, arg_max(cell_idx, round(p, 9) - cell_idx * 1e-12) AS decision, max(step) OVER (PARTITION BY run, char_idx) AS steps FROM {_soft(_ACC, 'run, char_idx, step')} GROUP BY run, char_idx, step)"


@query(
    "stream_dynamic_stop",
    f"""SELECT run, char_idx, CAST(decision AS INT) AS decision, round(confidence, 6) AS confidence, CAST(step AS INT) AS sequences_used, confidence >= 0.5 AS stopped FROM (
          SELECT *, row_number() OVER (PARTITION BY run, char_idx ORDER BY step) AS k FROM {_FIRST} WHERE step = least(steps, 2) OR confidence >= 0.5) WHERE k = 1""",
)
def stream_dynamic_stop(t: Tables) -> DataFrame:
    """Every character gets its decision: at the threshold, at the last sequence, or when the watermark has
    passed it. Each sequence number is a micro-batch, so evidence is carried in the state."""
    posts = evidence(t).select("run", "char_idx", "seq_idx", "posterior", at_second(F.col("seq_idx")).alias("ts"))
    with X.rocksdb(t.spark):
        return rounded(run_stream(t, posts, lambda s: X.stream_dynamic_stop(s.withWatermark("ts", "1 hour"), 0.5, 1, 2), F.col("seq_idx") - 1, 2, last=end_of(t, posts, "run")), "confidence")


@query(
    "stream_session_prior",
    """WITH trials AS (SELECT p_brand AS subject, CAST(p_partkey AS BIGINT) AS pos, lower(substr(p_name, 1, CAST(1 + p_partkey % 8 AS INT))) AS c, lower(p_name) AS text FROM {part}),
       asked AS (SELECT subject, pos, trim(c) || CASE WHEN c LIKE '% ' THEN ' ' ELSE '' END AS context FROM trials),
       pairs AS (SELECT a.subject, a.pos, a.context, l.cell_idx, CAST(count(*) AS DOUBLE) AS n FROM asked a
                 JOIN (SELECT *, unnest(range(1, length(text))) AS i FROM trials) b ON a.subject = b.subject AND b.pos < a.pos AND substr(b.text, b.i, 1) = substr(a.context, -1, 1)
                 JOIN {letters} l ON l.ch = substr(b.text, b.i + 1, 1) GROUP BY ALL),
       shares AS (SELECT *, count(*) OVER w AS k, -sum(p * ln(p)) OVER w AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY subject, pos, context) AS p FROM pairs WHERE n >= 2) WINDOW w AS (PARTITION BY subject, pos, context)),
       evened AS (SELECT subject, pos, context, cell_idx, p, CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END AS h FROM shares),
       sizes AS (SELECT a.subject, a.pos, count(b.text) AS phrases, CAST(coalesce(sum(len(string_split(b.text, ' '))), 0) AS BIGINT) AS tokens FROM asked a LEFT JOIN trials b ON a.subject = b.subject AND b.pos < a.pos GROUP BY ALL)
       SELECT a.subject, a.pos, a.context, e.cell_idx, round(e.p, 6) AS p, s.phrases, s.tokens, false AS late,
              CASE WHEN e.cell_idx IS NOT NULL THEN 'available' WHEN s.phrases = 0 THEN 'no_matches' WHEN x.subject IS NOT NULL THEN 'high_entropy' ELSE 'below_min_count' END AS reason
       FROM asked a LEFT JOIN (SELECT * FROM evened WHERE h <= 0.65) e USING (subject, pos, context) LEFT JOIN (SELECT DISTINCT subject, pos, context FROM evened WHERE h > 0.65) x USING (subject, pos, context) JOIN sizes s USING (subject, pos)""",
)
def stream_session_prior(t: Tables) -> DataFrame:
    """Trials arrive in any order, over three micro-batches, and are answered in that of their positions."""
    trials = t("part").select(F.col("p_brand").alias("subject"), F.col("p_partkey").alias("pos"), F.expr("lower(substr(p_name, 1, 1 + p_partkey % 8))").alias("context"), F.lower("p_name").alias("text"), at_second(F.col("p_partkey")).alias("ts"))
    with X.rocksdb(t.spark):
        return rounded(run_stream(t, trials, lambda s: X.stream_session_prior(s.withWatermark("ts", "3650 days"), t("letters")), last=end_of(t, trials, "subject")), "p")


@query(
    "stream_phrase_growth",
    """SELECT subject, pos, count(*) OVER w AS phrases, CAST(coalesce(sum(len(string_split(text, ' '))) OVER w, 0) AS BIGINT) AS tokens, CAST(coalesce(sum(length(text) - 1) OVER w, 0) AS BIGINT) AS bigrams
       FROM (SELECT p_brand AS subject, p_partkey AS pos, p_name AS text FROM {part}) WINDOW w AS (PARTITION BY subject ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def stream_phrase_growth(t: Tables) -> DataFrame:
    phrases = t("part").selectExpr("p_brand subject", "p_partkey pos", "p_name text")
    last = phrases.agg(F.max("pos")).first()[0] or 0
    return run_stream(t, phrases, X.stream_phrase_growth, F.floor(F.col("pos") * 3 / (last + 1)).cast("int"), 3)


_ITR = "CASE WHEN bits > 0 AND flashes > 0 THEN bits * 60 / (flashes * 0.2) ELSE 0 END"
_RUNNING = f"""SELECT start, condition, characters, round(accuracy, 6) AS accuracy, round(flashes, 6) AS flashes, round({_ITR}, 5) AS itr FROM (
    SELECT *, CASE WHEN accuracy >= 1 THEN log2(72) WHEN accuracy <= 0 THEN 0 ELSE log2(72) + accuracy * log2(accuracy) + (1 - accuracy) * log2((1 - accuracy) / 71) END AS bits FROM (
    SELECT CAST(epoch(date_trunc('day', CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type AS condition, count(*) AS characters, avg(CAST(value > 30 AS DOUBLE)) AS accuracy, avg(value) AS flashes FROM {{events}} GROUP BY 1, 2))"""


def characters(t: Tables) -> tuple[DataFrame, Column]:
    """Decided characters, and in which of three parts they arrive, in the order of time."""
    rows = t("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("condition"), (F.col("value") > 30).alias("correct"), F.col("value").alias("flashes_used"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).select(F.unix_timestamp("min(ts)"), F.unix_timestamp("max(ts)")).first()
    return rows, F.floor((F.unix_timestamp("ts") - (low or 0)) * 3 / ((high or 0) - (low or 0) + 1)).cast("int")


def running(out: DataFrame) -> DataFrame:
    return rounded(out.select(F.unix_timestamp("window.start").alias("start"), "condition", "characters", "accuracy", "flashes", F.round("itr", 5).alias("itr")), "accuracy", "flashes")


@query("stream_metrics", f"SELECT * FROM ({_RUNNING}) WHERE to_timestamp(start) + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 HOUR FROM {{events}})")
def stream_metrics(t: Tables) -> DataFrame:
    """Windows that the watermark has passed."""
    rows, part = characters(t)
    return running(run_stream(t, rows, X.stream_metrics, part, 3))


@query("stream_metrics_store", _RUNNING)
def stream_metrics_store(t: Tables) -> DataFrame:
    """All windows as they stand after each micro-batch, in a table of results with versions; each batch is given
    to the table twice, as after a failure, and counts once."""
    rows, part = characters(t)
    out, folder = start_stream(t, rows, X.stream_metrics, part, 3)
    store = ResultStore(t.spark, f"{folder}/results", ["start", "condition"])
    write = store.sink("metrics", running)

    def twice(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    out.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return store.read()
