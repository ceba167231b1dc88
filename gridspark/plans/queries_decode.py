"""Queries over posteriors, decisions, metrics, sweeps and paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import decode as D
from ..operators import metrics as M
from ..operators import posterior as P
from ..operators import stats as H
from .registry import Tables, query

SHAPE = (3, 3)
TAU, LEAST, MOST = 0.5, 1, 2

# Shared pieces of SQL: cell scores, posteriors, accumulated evidence and decisions in long form.
_LOGIT = "logit"
_CLIPPED = "ln(greatest(least(1 / (1 + exp(-logit)), 1 - 1e-6), 1e-6)) - ln(1 - greatest(least(1 / (1 + exp(-logit)), 1 - 1e-6), 1e-6))"


def _cells(score: str = _LOGIT, having: str = "") -> str:
    return f"(SELECT f.run, f.char_idx, f.seq_idx, g.cell_idx, sum(CASE WHEN f.stim_code = g.row OR f.stim_code = 3 + g.col THEN {score} ELSE 0 END) AS s FROM {{flashes}} f CROSS JOIN {{grid}} g GROUP BY f.run, f.char_idx, f.seq_idx, g.cell_idx {having})"


def _soft(table: str, keys: str, s: str = "s", p: str = "p") -> str:
    return f"(SELECT *, e / sum(e) OVER (PARTITION BY {keys}) AS {p} FROM (SELECT *, exp({s} - max({s}) OVER (PARTITION BY {keys})) AS e FROM {table}))"


_SEQ, _CHAR = "run, char_idx, seq_idx", "run, char_idx"
_BOTH = "HAVING count(*) FILTER (f.stim_code <= 3) > 0 AND count(*) FILTER (f.stim_code > 3) > 0"
_POST = _soft(_cells(), _SEQ)
_EVID = _soft(_cells(having=_BOTH), _SEQ)
_ACC = f"(SELECT run, char_idx, cell_idx, row_number() OVER w AS step, sum(ln(greatest(p, 1e-9))) OVER w AS s FROM {_EVID} WINDOW w AS (PARTITION BY run, char_idx, cell_idx ORDER BY seq_idx))"
_STEPS = f"(SELECT run, char_idx, step, max(p) AS confidence, arg_max(cell_idx, round(p, 9) - cell_idx * 1e-12) AS decision FROM {_soft(_ACC, 'run, char_idx, step')} GROUP BY run, char_idx, step)"


def _stops(steps: str = _STEPS, tau: str = str(TAU), least: str = str(LEAST), most: str = str(MOST), keys: str = _CHAR) -> str:
    return f"""(SELECT {keys}, decision, confidence, step AS sequences_used, stop AS stopped FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN stop THEN step ELSE 1000 - step END) AS r
        FROM (SELECT *, step >= {least} AND confidence >= {tau} AS stop FROM {steps} WHERE step <= {most})) WHERE r = 1)"""


_DECIDED = f"(SELECT s.*, t.target_cell, t.subject, s.decision = t.target_cell AS correct FROM {_stops()} s JOIN {{trials}} t ON s.run = t.run AND s.char_idx = t.char_idx)"


def evidence(t: Tables) -> DataFrame:
    return P.sequence_evidence(t("flashes"), SHAPE)


def traces(t: Tables) -> DataFrame:
    """A character has two sequences in these tables."""
    return P.accumulate_evidence(evidence(t), max_sequences=MOST)


def decided(t: Tables) -> DataFrame:
    stops = D.dynamic_stop(traces(t), TAU, LEAST, MOST)
    return stops.join(t("trials"), ["run", "char_idx"]).withColumn("correct", F.col("decision") == F.col("target_cell"))


def long(df: DataFrame, col: str, keys: list[str], name: str = "p") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("cell_idx", name)).withColumn(name, F.round(name, 6))


KEYS = ["run", "char_idx", "seq_idx"]


@query("row_col_posterior", f"SELECT {_SEQ}, cell_idx, round(p, 6) AS p FROM {_soft(_cells(_CLIPPED), _SEQ)}")
def row_col_posterior(t: Tables) -> DataFrame:
    flashes = t("flashes").withColumn("prob", N.logit_to_prob(F.col("logit")))
    return long(P.row_col_posterior(flashes, SHAPE), "posterior", KEYS)


@query("row_col_logit_posterior", f"SELECT {_SEQ}, cell_idx, round(p, 6) AS p FROM {_POST}")
def row_col_logit_posterior(t: Tables) -> DataFrame:
    return long(P.row_col_logit_posterior(t("flashes"), SHAPE), "posterior", KEYS)


@query("membership_posterior", f"SELECT {_SEQ}, cell_idx, round(p, 6) AS p FROM {_POST}")
def membership_posterior(t: Tables) -> DataFrame:
    """Equal to rows and columns where the masks are rows and columns."""
    return long(P.membership_posterior(t("masked"), 9), "posterior", KEYS)


@query("sequence_evidence", f"SELECT p.*, f.flashes FROM (SELECT {_SEQ}, cell_idx, round(p, 6) AS p FROM {_EVID}) p JOIN (SELECT {_SEQ}, count(*) AS flashes FROM {{flashes}} GROUP BY {_SEQ}) f USING ({_SEQ})")
def sequence_evidence(t: Tables) -> DataFrame:
    return long(evidence(t), "posterior", [*KEYS, "flashes"])


_COMPLETE = f"(SELECT {_SEQ}, count(*) AS n, max(stim_code - 1) FILTER (y = 1 AND stim_code <= 3) AS true_row, max(stim_code - 4) FILTER (y = 1 AND stim_code > 3) AS true_col FROM {{flashes}} GROUP BY {_SEQ} HAVING count(*) = 6)"


@query("complete_sequences", f"SELECT * FROM {_COMPLETE} WHERE true_row IS NOT NULL AND true_col IS NOT NULL")
def complete_sequences(t: Tables) -> DataFrame:
    return P.complete_sequences(t("flashes"), 6, SHAPE)


@query(
    "target_cell",
    """SELECT run, char_idx, CAST((r - 1) * 3 + c - 4 AS INT) AS cell FROM (
         SELECT run, char_idx, max(stim_code) FILTER (ax = 'r' AND k = 1) AS r, max(stim_code) FILTER (ax = 'c' AND k = 1) AS c FROM (
           SELECT run, char_idx, ax, stim_code, row_number() OVER (PARTITION BY run, char_idx, ax ORDER BY count(*) DESC, stim_code) AS k
           FROM (SELECT *, CASE WHEN stim_code <= 3 THEN 'r' ELSE 'c' END AS ax FROM {flashes} WHERE y = 1) GROUP BY run, char_idx, ax, stim_code) GROUP BY run, char_idx)
       WHERE r IS NOT NULL AND c IS NOT NULL""",
)
def target_cell(t: Tables) -> DataFrame:
    return P.target_cell(t("flashes"), SHAPE)


@query("accumulate_evidence", f"SELECT run, char_idx, CAST(step AS INT) AS step, cell_idx, round(s, 6) AS p FROM {_ACC}")
def accumulate_evidence(t: Tables) -> DataFrame:
    return long(P.accumulate_evidence(evidence(t)), "evidence", ["run", "char_idx", "step"])


@query("decode_argmax", f"SELECT run, char_idx, CAST(step AS INT) AS step, decision, round(confidence, 6) AS confidence FROM {_STEPS}")
def decode_argmax(t: Tables) -> DataFrame:
    return D.decode_argmax(traces(t)).select("run", "char_idx", "step", "decision", F.round("confidence", 6).alias("confidence"))


def prior_arrays(t: Tables) -> DataFrame:
    """(run, char_idx, prior): one array per character."""
    cells = F.array_sort(F.collect_list(F.struct("cell_idx", "p")))
    return t("prior").groupBy("run", "char_idx").agg(F.transform(cells, lambda s: s["p"]).alias("prior"))


_H = "(SELECT *, (-sum((p + 1e-9) * ln(p + 1e-9)) OVER w / sum(p + 1e-9) OVER w + ln(sum(p + 1e-9) OVER w)) / ln(9) AS h FROM {prior} WINDOW w AS (PARTITION BY run, char_idx))"


@query("initial_bias_fixed", "SELECT run, char_idx, cell_idx, round(CASE WHEN p = 0 THEN -1e9 ELSE 0.85 * ln(greatest(p, 1e-9)) END, 6) AS p FROM {prior}")
def initial_bias_fixed(t: Tables) -> DataFrame:
    return long(P.initial_bias(prior_arrays(t), 0.85), "bias", ["run", "char_idx"])


@query("initial_bias_adaptive", f"SELECT run, char_idx, cell_idx, round(CASE WHEN p = 0 THEN -1e9 ELSE 1.25 * (1 - h) * ln(greatest(p, 1e-9)) END, 6) AS p FROM {_H}")
def initial_bias_adaptive(t: Tables) -> DataFrame:
    return long(P.initial_bias(prior_arrays(t), 1.25, "adaptive"), "bias", ["run", "char_idx"])


@query("normalized_entropy", f"SELECT DISTINCT run, char_idx, round(h, 6) AS h FROM {_H}")
def normalized_entropy(t: Tables) -> DataFrame:
    return prior_arrays(t).select("run", "char_idx", F.round(P.normalized_entropy(F.col("prior"), 1e-9), 6).alias("h"))


_PAIRS = f"(SELECT e.run, e.char_idx, e.seq_idx, e.cell_idx, e.p, q.p AS q, (-sum((e.p + 1e-9) * ln(e.p + 1e-9)) OVER w / sum(e.p + 1e-9) OVER w + ln(sum(e.p + 1e-9) OVER w)) / ln(9) AS h FROM {_EVID} e JOIN {{prior}} q ON e.run = q.run AND e.char_idx = q.char_idx AND e.cell_idx = q.cell_idx WINDOW w AS (PARTITION BY e.run, e.char_idx, e.seq_idx))"


def _fused(a: str) -> str:
    return f"SELECT {_SEQ}, cell_idx, round(coalesce(e / sum(e) OVER (PARTITION BY {_SEQ}), 0), 6) AS p FROM (SELECT *, CASE WHEN q = 0 THEN 0 ELSE exp(s - max(s) OVER (PARTITION BY {_SEQ})) END AS e FROM (SELECT *, CASE WHEN q > 0 THEN ln(greatest(p, 1e-9)) + {a} * ln(greatest(q, 1e-9)) END AS s FROM {_PAIRS}))"


@query("fuse_fixed", _fused("0.85"))
def fuse_fixed(t: Tables) -> DataFrame:
    return long(P.fuse(evidence(t).join(prior_arrays(t), ["run", "char_idx"]), 0.85), "fused", KEYS)


@query("fuse_adaptive", _fused("0.85 * h"))
def fuse_adaptive(t: Tables) -> DataFrame:
    return long(P.fuse(evidence(t).join(prior_arrays(t), ["run", "char_idx"]), 0.85, "adaptive"), "fused", KEYS)


@query("dynamic_stop", f"SELECT run, char_idx, decision, round(confidence, 6) AS confidence, CAST(sequences_used AS INT) AS sequences_used, stopped, correct FROM {_DECIDED}")
def dynamic_stop(t: Tables) -> DataFrame:
    return decided(t).select("run", "char_idx", "decision", F.round("confidence", 6).alias("confidence"), "sequences_used", "stopped", "correct")


@query(
    "capped_stop",
    f"""SELECT s.run, s.char_idx, s.decision, CAST(s.sequences_used AS INT) AS sequences_used, f.decision AS full_decision
        FROM {_stops(f"(SELECT run, char_idx, step, decision, CASE WHEN step = 2 THEN 1 ELSE confidence END AS confidence FROM {_STEPS})", "0.9", "1", "2")} s
        JOIN (SELECT run, char_idx, arg_max(decision, step) AS decision FROM {_STEPS} GROUP BY run, char_idx) f ON s.run = f.run AND s.char_idx = f.char_idx""",
)
def capped_stop(t: Tables) -> DataFrame:
    return D.capped_stop(traces(t), 1, 2, 0.9).select("run", "char_idx", "decision", "sequences_used", "full_decision")


@query(
    "prefix_accuracy",
    f"""SELECT CAST(k AS INT) AS k, count(*) AS characters, round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy FROM (
          SELECT k.k, s.run, s.char_idx, arg_max(s.decision = t.target_cell, s.step) AS ok FROM {_STEPS} s JOIN {{trials}} t ON s.run = t.run AND s.char_idx = t.char_idx
          JOIN (VALUES (1), (2)) k(k) ON s.step <= k.k GROUP BY k.k, s.run, s.char_idx) GROUP BY k""",
)
def prefix_accuracy(t: Tables) -> DataFrame:
    return D.prefix_accuracy(traces(t), t("trials"), (1, 2), cell="target_cell").withColumn("accuracy", F.round("accuracy", 6))


_ARMS = "(VALUES ('none', 0.0, 0.5, 1), ('fixed', 0.85, 0.5, 1), ('strong', 1.25, 0.8, 2))"
_ARM_ACC = f"(SELECT a.run, a.char_idx, a.step, a.cell_idx, v.arm, v.tau, v.least, a.s + v.alpha * ln(greatest(q.p, 1e-9)) AS s FROM {_ACC} a JOIN {{prior}} q ON a.run = q.run AND a.char_idx = q.char_idx AND a.cell_idx = q.cell_idx CROSS JOIN {_ARMS} v(arm, alpha, tau, least))"
_ARM_STEPS = f"(SELECT run, char_idx, arm, step, max(tau) AS tau, max(least) AS least, max(p) AS confidence, arg_max(cell_idx, round(p, 9) - cell_idx * 1e-12) AS decision FROM {_soft(_ARM_ACC, 'run, char_idx, arm, step')} GROUP BY run, char_idx, arm, step)"
_ARM_STOPS = _stops(_ARM_STEPS, "tau", "least", "2", "run, char_idx, arm")


def arm_decisions(t: Tables) -> DataFrame:
    logs = prior_arrays(t).select("run", "char_idx", F.transform("prior", lambda v: F.log(N.clip(v, 1e-9, 1.0))).alias("log_prior"))
    arms = t.spark.sql(f"SELECT arm, cast(alpha as double) alpha, cast(tau as double) tau, least min_sequences FROM {_ARMS} v(arm, alpha, tau, least)")
    return D.evaluate_arms(traces(t).join(logs, ["run", "char_idx"]), arms, 2)


@query("evaluate_arms", f"SELECT run, char_idx, arm, decision, round(confidence, 6) AS confidence, CAST(sequences_used AS INT) AS sequences_used FROM {_ARM_STOPS}")
def evaluate_arms(t: Tables) -> DataFrame:
    return arm_decisions(t).select("run", "char_idx", "arm", "decision", F.round("confidence", 6).alias("confidence"), "sequences_used")


@query(
    "argmax_flips",
    f"""SELECT a.arm, count(*) AS compared, count(*) FILTER (a.decision <> r.decision) AS flips, count(*) FILTER (a.decision <> r.decision AND a.decision = t.target_cell) AS toward,
               count(*) FILTER (a.decision <> r.decision AND r.decision = t.target_cell) AS away
        FROM {_ARM_STOPS} a JOIN {_ARM_STOPS} r ON a.run = r.run AND a.char_idx = r.char_idx AND r.arm = 'none' AND a.arm <> 'none' JOIN {{trials}} t ON a.run = t.run AND a.char_idx = t.char_idx GROUP BY a.arm""",
)
def argmax_flips(t: Tables) -> DataFrame:
    return D.argmax_flips(arm_decisions(t).join(t("trials"), ["run", "char_idx"]), "none", target="target_cell")


@query("zero_coverage", f"SELECT t.run, t.char_idx, e.run IS NULL AS zero_coverage FROM {{trials}} t LEFT JOIN (SELECT DISTINCT run, char_idx FROM {_EVID}) e ON t.run = e.run AND t.char_idx = e.char_idx")
def zero_coverage(t: Tables) -> DataFrame:
    return D.zero_coverage(t("trials"), evidence(t)).select("run", "char_idx", "zero_coverage")


_SCORED = "(SELECT run, char_idx, seq_idx, " + ", ".join(f"coalesce(sum(logit) FILTER (stim_code = {c}), 0) AS s{c}" for c in range(1, 7)) + " FROM {flashes} GROUP BY run, char_idx, seq_idx HAVING count(*) FILTER (stim_code <= 3) = 3 AND count(*) FILTER (stim_code > 3) = 3)"
_ROWED = f"""(SELECT *, exp(l) / sum(exp(l)) OVER (PARTITION BY run, char_idx, seq_idx) AS rp FROM (SELECT s.run, s.char_idx, s.seq_idx, r.r, ln(least(greatest(sum(p.p), 1e-9), 1)) + max(CASE r.r WHEN 0 THEN s1 ELSE s2 END) AS l
    FROM {_SCORED} s JOIN {{prior}} p ON s.run = p.run AND s.char_idx = p.char_idx JOIN (VALUES (0), (1)) r(r) ON CAST(floor(p.cell_idx / 3.0) AS INT) = r.r GROUP BY s.run, s.char_idx, s.seq_idx, r.r))"""
_SHORT = f"""(SELECT * FROM (SELECT *, max(rp) OVER w - min(rp) OVER w AS gap, row_number() OVER (PARTITION BY run, char_idx, seq_idx ORDER BY rp DESC, r DESC) AS k FROM {_ROWED} WINDOW w AS (PARTITION BY run, char_idx, seq_idx)) WHERE k = 1 OR gap <= 0.08)"""


@query(
    "row_shortlist_decode",
    f"""SELECT run, char_idx, seq_idx, CAST(arg_max(cell_idx, round(q, 9) - cell_idx * 1e-12) AS INT) AS decision, round(max(q), 6) AS confidence, CAST(count(DISTINCT r) AS INT) AS rows_kept FROM (
        SELECT *, exp(l) / sum(exp(l)) OVER (PARTITION BY run, char_idx, seq_idx) AS q FROM (SELECT s.run, s.char_idx, s.seq_idx, p.cell_idx, k.r, ln(greatest(p.p, 1e-9)) + CASE k.r WHEN 0 THEN s1 ELSE s2 END + CASE p.cell_idx % 3 WHEN 0 THEN s4 WHEN 1 THEN s5 ELSE s6 END AS l
        FROM {_SHORT} k JOIN {_SCORED} s ON s.run = k.run AND s.char_idx = k.char_idx AND s.seq_idx = k.seq_idx JOIN {{prior}} p ON p.run = s.run AND p.char_idx = s.char_idx AND CAST(floor(p.cell_idx / 3.0) AS INT) = k.r)) GROUP BY run, char_idx, seq_idx""",
)
def row_shortlist_decode(t: Tables) -> DataFrame:
    scored = P.row_col_scores(t("flashes"), SHAPE, F.col("logit"), ["run", "char_idx", "seq_idx"]).where("n_row = 3 and n_col = 3")
    out = D.row_shortlist_decode(scored.join(prior_arrays(t), ["run", "char_idx"]), SHAPE, rows=2, keys=["run", "char_idx", "seq_idx"])
    return out.withColumn("confidence", F.round("confidence", 6))


# Metrics -----------------------------------------------------------------------------------------

_COSTED = f"(SELECT *, run % 3 AS condition, sequences_used * 1.5 AS seconds, sequences_used * 6 AS flashes_used FROM {_DECIDED})"
_ITR = "CASE WHEN accuracy >= 1 THEN log2(9) WHEN accuracy <= 0 THEN 0 ELSE log2(9) + accuracy * log2(accuracy) + (1 - accuracy) * log2((1 - accuracy) / 8) END"


def costed(t: Tables) -> DataFrame:
    return decided(t).withColumn("condition", F.col("run") % 3).withColumn("seconds", M.selection_time(F.col("sequences_used"), F.lit(1.5))).withColumn("flashes_used", F.col("sequences_used") * 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "accuracy_rollup",
    f"""SELECT condition, characters, round(accuracy, 6) AS accuracy, round(s, 6) AS sequences_per_char, round(f, 6) AS flashes_per_char, round(z, 6) AS seconds_per_char, round(greatest({_ITR}, 0) * 60 / z, 6) AS itr
        FROM (SELECT condition, count(*) AS characters, avg(CAST(correct AS DOUBLE)) AS accuracy, avg(sequences_used) AS s, avg(flashes_used) AS f, CAST(avg(seconds) AS DOUBLE) AS z FROM {_COSTED} GROUP BY ROLLUP (condition))""",
)
def accuracy_rollup(t: Tables) -> DataFrame:
    out = M.with_itr(M.accuracy_rollup(costed(t)), 9)
    return rounded(out, "accuracy", "sequences_per_char", "flashes_per_char", "seconds_per_char", "itr")


_STRATA = ("CASE run % 3 WHEN 0 THEN 'RC' WHEN 1 THEN 'Dyn' ELSE 'DynBigram' END", {"Dyn/DynBigram": ["Dyn", "DynBigram"]})


@query(
    "accuracy_strata",
    f"""SELECT stratum, characters, round(accuracy, 6) AS accuracy, round(s, 6) AS sequences_per_char, round(f, 6) AS flashes_per_char, round(z, 6) AS seconds_per_char, round(greatest({_ITR}, 0) * 60 / z, 6) AS itr
        FROM (SELECT stratum, count(*) AS characters, avg(CAST(correct AS DOUBLE)) AS accuracy, avg(sequences_used) AS s, avg(flashes_used) AS f, CAST(avg(seconds) AS DOUBLE) AS z
              FROM (SELECT *, {_STRATA[0]} AS name FROM {_COSTED}) c JOIN (VALUES ('RC', 'RC'), ('Dyn', 'Dyn'), ('DynBigram', 'DynBigram'), ('Dyn', 'Dyn/DynBigram'), ('DynBigram', 'Dyn/DynBigram'), ('RC', 'overall'), ('Dyn', 'overall'), ('DynBigram', 'overall')) m(own, stratum) ON m.own = c.name GROUP BY stratum)""",
)
def accuracy_strata(t: Tables) -> DataFrame:
    """Each condition, both adaptive ones together, and all."""
    out = M.with_itr(M.accuracy_strata(costed(t).withColumn("condition", F.expr(_STRATA[0])), merged=_STRATA[1]), 9)
    return rounded(out, "accuracy", "sequences_per_char", "flashes_per_char", "seconds_per_char", "itr")


@query("itr", f"SELECT subject, round(greatest({_ITR}, 0) * 60 / z, 6) AS itr FROM (SELECT subject, avg(CAST(correct AS DOUBLE)) AS accuracy, CAST(avg(seconds) AS DOUBLE) AS z FROM {_COSTED} GROUP BY subject)")
def itr(t: Tables) -> DataFrame:
    one = costed(t).groupBy("subject").agg(F.avg(F.col("correct").cast("double")).alias("p"), F.avg("seconds").alias("z"))
    return one.select("subject", F.round(N.itr(9, F.col("p"), F.col("z")), 6).alias("itr"))


@query("wpm", f"SELECT subject, round(60 / z / 5, 6) AS wpm, round(greatest({_ITR}, 0) * 60 / z / 5, 6) AS wpm_from_itr FROM (SELECT subject, avg(CAST(correct AS DOUBLE)) AS accuracy, CAST(avg(seconds) AS DOUBLE) AS z FROM {_COSTED} GROUP BY subject)")
def wpm(t: Tables) -> DataFrame:
    one = costed(t).groupBy("subject").agg(F.avg(F.col("correct").cast("double")).alias("p"), F.avg("seconds").alias("z"))
    return one.select("subject", F.round(N.wpm(F.col("z")), 6).alias("wpm"), F.round(N.wpm_from_itr(N.itr(9, F.col("p"), F.col("z"))), 6).alias("wpm_from_itr"))


@query("selection_time", f"SELECT run, char_idx, CAST(sequences_used * 1.5 AS DOUBLE) AS fixed, CAST(sequences_used * 6 * 0.25 AS DOUBLE) AS measured, CAST(round(sequences_used * 6 * 0.21, 6) AS DOUBLE) AS by_flash FROM {_DECIDED}")
def selection_time(t: Tables) -> DataFrame:
    s = F.col("sequences_used")
    return decided(t).select("run", "char_idx", M.selection_time(s, F.lit(1.5)).alias("fixed"), M.selection_time(s, flashes_per_seq=6, interval=F.lit(0.25)).alias("measured"), F.round(M.selection_time(s, flashes=s * 6, seconds_per_flash=0.21), 6).alias("by_flash"))


@query("per_subject", f"SELECT subject, count(*) AS characters, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(flashes_used), 6) AS flashes, round(avg(-ln(confidence)), 6) AS nll FROM {_COSTED} GROUP BY subject")
def per_subject(t: Tables) -> DataFrame:
    return rounded(M.per_subject(costed(t).withColumn("nll", -F.log("confidence"))), "accuracy", "flashes", "nll")


@query("pooled_counts", f"SELECT condition, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, count(*) AS characters, CAST(sum(flashes_used) AS BIGINT) AS flashes, round(sum(CAST(correct AS INT)) / count(*), 6) AS accuracy, round(sum(flashes_used) / count(*), 6) AS flashes_per_char FROM {_COSTED} GROUP BY condition")
def pooled_counts(t: Tables) -> DataFrame:
    return rounded(M.pooled_counts(costed(t), ["condition"]), "accuracy", "flashes_per_char")


def _auc(by: str) -> str:
    k, w = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    g = f"GROUP BY {by}" if by else ""
    return f"SELECT {k}round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT {k}pos, neg, sum(neg) OVER ({w}ORDER BY logit) - neg AS below FROM (SELECT {k}logit, sum(y) AS pos, sum(1 - y) AS neg FROM {{scores}} GROUP BY {k}logit)) {g} HAVING sum(pos) > 0 AND sum(neg) > 0"


@query("roc_auc", _auc(""))
def roc_auc(t: Tables) -> DataFrame:
    return rounded(M.roc_auc(t("scores"), "logit", "y"), "auc")


@query("roc_auc_by_subject", _auc("subject"))
def roc_auc_by_subject(t: Tables) -> DataFrame:
    return rounded(M.roc_auc(t("scores"), "logit", "y", ["subject"]), "auc")


@query("balanced_accuracy", "SELECT subject, round((avg(CASE WHEN y = 0 THEN CAST(logit <= 0 AS DOUBLE) END) + avg(CASE WHEN y = 1 THEN CAST(logit > 0 AS DOUBLE) END)) / 2, 6) AS balanced_accuracy FROM {scores} GROUP BY subject")
def balanced_accuracy(t: Tables) -> DataFrame:
    return rounded(M.balanced_accuracy(t("scores"), "logit", "y", ["subject"]), "balanced_accuracy")


@query("binary_nll", "SELECT subject, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS nll FROM (SELECT *, greatest(least(1 / (1 + exp(-logit)), 1 - 1e-7), 1e-7) AS p FROM {scores}) GROUP BY subject")
def binary_nll(t: Tables) -> DataFrame:
    return rounded(M.binary_nll(t("scores"), "logit", "y", ["subject"]), "nll")


@query("ece", "SELECT subject, round(sum(n * abs(p - c)) / sum(n), 6) AS ece FROM (SELECT subject, least(floor(p * 15), 14) AS b, count(*) AS n, avg(p) AS p, avg(CAST(y AS DOUBLE)) AS c FROM (SELECT *, 1 / (1 + exp(-logit)) AS p FROM {scores}) GROUP BY subject, least(floor(p * 15), 14)) GROUP BY subject")
def ece(t: Tables) -> DataFrame:
    return rounded(M.ece(t("scores").withColumn("p", N.logit_to_prob(F.col("logit"))), "p", "y", by=["subject"]), "ece")


_AXES = f"(SELECT f.run, f.char_idx, f.seq_idx, CASE WHEN stim_code <= 3 THEN 'row' ELSE 'col' END AS axis, (stim_code - 1) % 3 AS k, sum(logit) AS s, max(CASE WHEN stim_code <= 3 THEN true_row ELSE true_col END) AS t FROM {{flashes}} f JOIN (SELECT * FROM {_COMPLETE} WHERE true_row IS NOT NULL AND true_col IS NOT NULL) c ON f.run = c.run AND f.char_idx = c.char_idx AND f.seq_idx = c.seq_idx GROUP BY f.run, f.char_idx, f.seq_idx, stim_code)"
_TOP = f"(SELECT axis, max(p) AS conf, CAST(arg_max(k, round(p, 9) - k * 1e-12) = max(t) AS INT) AS ok, -ln(greatest(max(p) FILTER (k = t), 1e-15)) AS loss FROM {_soft(_AXES, 'run, char_idx, seq_idx, axis')} GROUP BY run, char_idx, seq_idx, axis)"


@query(
    "sequence_metrics",
    f"""SELECT CAST(sum(n) / 2 AS BIGINT) AS complete_sequences, round(sum(l) / sum(n), 6) AS row_column_nll, round(sum(abs(c - o)) / sum(n), 6) AS top_label_ece, round(sum(ro) * 2 / sum(n), 6) AS row_accuracy, round(sum(co) * 2 / sum(n), 6) AS column_accuracy
        FROM (SELECT least(floor(conf * 15), 14) AS b, count(*) AS n, sum(conf) AS c, sum(ok) AS o, sum(loss) AS l, sum(ok) FILTER (axis = 'row') AS ro, sum(ok) FILTER (axis = 'col') AS co FROM {_TOP} GROUP BY least(floor(conf * 15), 14))""",
)
def sequence_metrics(t: Tables) -> DataFrame:
    full = P.complete_sequences(t("flashes"), 6, SHAPE).select(*KEYS, "true_row", "true_col")
    return rounded(M.sequence_metrics(evidence(t).join(full, KEYS)), "row_column_nll", "top_label_ece", "row_accuracy", "column_accuracy")


@query("stop_histogram", f"SELECT CAST(sequences_used AS INT) AS sequences_used, count(*) FILTER (NOT correct) AS wrong, count(*) FILTER (correct) AS right FROM {_DECIDED} GROUP BY sequences_used")
def stop_histogram(t: Tables) -> DataFrame:
    return M.stop_histogram(decided(t), MOST)


_POLICIES = "(VALUES ('default', 0.8, 1, 2), ('eager', 0.5, 1, 2), ('once', 0.9, 1, 1), ('late', 0.6, 2, 2))"
_POLICY_STEPS = f"(SELECT s.*, v.policy, v.tau, v.least FROM {_STEPS} s JOIN {_POLICIES} v(policy, tau, least, most) ON s.step <= v.most)"
_POLICY_STOPS = f"(SELECT s.*, s.decision = t.target_cell AS ok FROM {_stops(_POLICY_STEPS, 'tau', 'least', '100', 'run, char_idx, policy')} s JOIN {{trials}} t ON s.run = t.run AND s.char_idx = t.char_idx)"
_SWEEP = f"""(SELECT policy, characters, accuracy, mean_sequences, flips, corrected, regressed, greatest({_ITR}, 0) * 60 / (mean_sequences * 1.5) AS itr FROM (
    SELECT a.policy, count(*) AS characters, avg(CAST(a.ok AS DOUBLE)) AS accuracy, avg(a.sequences_used) AS mean_sequences, count(*) FILTER (a.decision <> d.decision) AS flips,
           count(*) FILTER (a.decision <> d.decision AND a.ok AND NOT d.ok) AS corrected, count(*) FILTER (a.decision <> d.decision AND NOT a.ok AND d.ok) AS regressed
    FROM {_POLICY_STOPS} a JOIN {_POLICY_STOPS} d ON a.run = d.run AND a.char_idx = d.char_idx AND d.policy = 'default' GROUP BY a.policy))"""


def sweep(t: Tables) -> DataFrame:
    policies = t.spark.sql(f"SELECT policy, cast(tau as double) tau, least min_sequences, most max_sequences FROM {_POLICIES} v(policy, tau, least, most)")
    return M.policy_sweep(traces(t), policies, t("trials").withColumnRenamed("target_cell", "cell"), "default", 9, 1.5)


@query("policy_sweep", f"SELECT policy, characters, round(accuracy, 6) AS accuracy, round(mean_sequences, 6) AS mean_sequences, flips, corrected, regressed, round(itr, 6) AS itr FROM {_SWEEP}")
def policy_sweep(t: Tables) -> DataFrame:
    return rounded(sweep(t), "accuracy", "mean_sequences", "itr")


@query("select_policy", f"SELECT policy, round(accuracy, 6) AS accuracy, round(mean_sequences, 6) AS mean_sequences FROM {_SWEEP} WHERE accuracy >= (SELECT accuracy FROM {_SWEEP} WHERE policy = 'default') ORDER BY mean_sequences, accuracy DESC, itr DESC, policy LIMIT 1")
def select_policy(t: Tables) -> DataFrame:
    return rounded(M.select_policy(sweep(t), "default").select("policy", "accuracy", "mean_sequences"), "accuracy", "mean_sequences")


_GRID = ", ".join(f"({a}.0)" for a in range(0, 6))
_LAST = f"(SELECT a.run, a.char_idx, a.cell_idx, arg_max(a.s, a.step) AS s FROM {_ACC} a GROUP BY a.run, a.char_idx, a.cell_idx)"
_ALPHA = f"""(SELECT alpha, avg(nll) AS nll, count(*) AS characters FROM (SELECT alpha, run, char_idx, m + ln(sum(exp(z - m))) - max(z) FILTER (cell_idx = target_cell) AS nll FROM (
    SELECT v.alpha / 4 AS alpha, l.run, l.char_idx, l.cell_idx, t.target_cell, l.s + v.alpha / 4 * ln(greatest(q.p, 1e-12)) AS z, max(l.s + v.alpha / 4 * ln(greatest(q.p, 1e-12))) OVER (PARTITION BY v.alpha, l.run, l.char_idx) AS m
    FROM {_LAST} l JOIN {{prior}} q ON l.run = q.run AND l.char_idx = q.char_idx AND l.cell_idx = q.cell_idx JOIN {{trials}} t ON l.run = t.run AND l.char_idx = t.char_idx CROSS JOIN (VALUES {_GRID}) v(alpha))
    GROUP BY alpha, run, char_idx, m) GROUP BY alpha)"""


def alpha_sweep(t: Tables) -> DataFrame:
    last = traces(t).groupBy("run", "char_idx").agg(F.max_by("evidence", "step").alias("evidence"))
    rows = last.join(prior_arrays(t), ["run", "char_idx"]).join(t("trials"), ["run", "char_idx"]).withColumnRenamed("target_cell", "cell")
    return M.fit_alpha_grid(rows, [a / 4 for a in range(6)])


@query("fit_alpha_grid", f"SELECT CAST(alpha AS DOUBLE) AS alpha, round(nll, 6) AS nll, characters FROM {_ALPHA}")
def fit_alpha_grid(t: Tables) -> DataFrame:
    return rounded(alpha_sweep(t), "nll")


@query("best_alpha", f"SELECT CAST(alpha AS DOUBLE) AS alpha, round(nll, 6) AS nll FROM {_ALPHA} ORDER BY nll, alpha LIMIT 1")
def best_alpha(t: Tables) -> DataFrame:
    return rounded(M.best_alpha(alpha_sweep(t)), "nll")


# Paired statistics -------------------------------------------------------------------------------

_PAIRED = "(SELECT v.method AS comparison, v.subject, b.metric AS baseline, v.metric AS value FROM {methods} v JOIN {methods} b ON v.subject = b.subject AND b.method = 'click' AND v.method <> 'click')"
_RANKED = f"(SELECT comparison, d, rank() OVER (PARTITION BY comparison ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparison, abs(d)) - 1) / 2.0 AS r FROM (SELECT comparison, value - baseline AS d FROM {_PAIRED}) WHERE d <> 0)"


def paired(t: Tables) -> DataFrame:
    m = t("methods")
    base = m.where("method = 'click'").select("subject", F.col("metric").alias("baseline"))
    return m.where("method <> 'click'").join(base, "subject").select(F.col("method").alias("comparison"), "subject", "baseline", F.col("metric").alias("value"))


@query(
    "wilcoxon_paired",
    f"""SELECT p.comparison, p.n_pairs, CAST(r.statistic AS DOUBLE) AS statistic, round(p.mean_difference, 6) AS mean_difference, round(p.median_difference, 6) AS median_difference
        FROM (SELECT comparison, count(*) AS n_pairs, avg(value - baseline) AS mean_difference, quantile_cont(value - baseline, 0.5) AS median_difference FROM {_PAIRED} GROUP BY comparison) p
        JOIN (SELECT comparison, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS statistic FROM {_RANKED} GROUP BY comparison) r ON p.comparison = r.comparison""",
)
def wilcoxon_paired(t: Tables) -> DataFrame:
    return rounded(H.wilcoxon_paired(paired(t), ["comparison"]).drop("p_value"), "mean_difference", "median_difference")


@query("wilcoxon_p_values")
def wilcoxon_p_values(t: Tables) -> DataFrame:
    return H.wilcoxon_paired(paired(t), ["comparison"]).select("comparison", F.round("p_value", 9).alias("p_value"))


@query(
    "holm",
    """SELECT family, k, p_value, max(a) OVER w AS p_holm, max(a) OVER w <= 0.05 AS reject FROM (
         SELECT *, least(1.0, p_value * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, k) + 1)) AS a
         FROM (SELECT c_nationkey AS family, c_custkey AS k, (c_custkey * 7919 % 10007) / 10007.0 / 20 AS p_value FROM {customer})) WINDOW w AS (PARTITION BY family ORDER BY p_value, k)""",
)
def holm(t: Tables) -> DataFrame:
    tests = t("customer").selectExpr("c_nationkey family", "c_custkey k", "cast(c_custkey * 7919 % 10007 as double) / 10007.0D / 20 p_value")
    return H.holm(tests, ["family"])


_DRAW = "CAST(('0x' || substr(md5(concat_ws(':', {0})), 1, 8)) AS BIGINT)"


@query(
    "bootstrap_ci",
    f"""SELECT method, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (
          SELECT d.method, d.b, avg(v.metric) AS m FROM (SELECT n.method, b.b, {_DRAW.format("'7', CAST(b.b AS VARCHAR), CAST(k.k AS VARCHAR)")} % n.n AS i FROM (SELECT method, count(*) AS n FROM {{methods}} GROUP BY method) n
             CROSS JOIN (SELECT unnest(range(1, 51)) AS b) b JOIN (SELECT unnest(range(1, 100001)) AS k) k ON k.k <= n.n) d
          JOIN (SELECT *, row_number() OVER (PARTITION BY method ORDER BY subject) - 1 AS i FROM {{methods}}) v ON v.method = d.method AND v.i = d.i GROUP BY d.method, d.b) GROUP BY method""",
)
def bootstrap_ci(t: Tables) -> DataFrame:
    return rounded(H.bootstrap_ci(t("methods"), ["method"], "metric", "subject", n_boot=50, seed=7), "low", "high")


_TIMES = " + ".join(f"CAST(u >= {step!r} AS INT)" for step in H.POISSON_STEPS)


@query(
    "bootstrap_ci_weighted",
    f"""SELECT event_type, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (
          SELECT event_type, b, sum(w * value) / sum(w) AS m FROM (
            SELECT *, {_TIMES} AS w FROM (
              SELECT event_type, value, b, {_DRAW.format("'7', CAST(b AS VARCHAR), CAST(event_id AS VARCHAR)")} / 4294967296.0 AS u
              FROM {{events}} CROSS JOIN (SELECT unnest(range(1, 51)) AS b)))
          GROUP BY event_type, b) GROUP BY event_type""",
)
def bootstrap_ci_weighted(t: Tables) -> DataFrame:
    """Mean value of all events by type: groups that grow with the table, by weights."""
    return rounded(H.bootstrap_ci(t("events"), ["event_type"], "value", "event_id", n_boot=50, seed=7, exact_rows=10), "low", "high")


@query("hierarchical_bootstrap")
def hierarchical_bootstrap(t: Tables) -> DataFrame:
    counts = costed(t).groupBy("condition", "subject").agg(F.sum(F.col("correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("characters"))
    return rounded(H.hierarchical_bootstrap(counts, ["condition"]), "mean", "low", "high")


@query("rank_biserial", f"SELECT comparison, round(sum(sign(d) * r) / sum(r), 6) AS rank_biserial FROM {_RANKED} GROUP BY comparison")
def rank_biserial(t: Tables) -> DataFrame:
    return rounded(H.rank_biserial(paired(t), ["comparison"]), "rank_biserial")


# Metrics are averages of doubles: differences that are equal but for the order of summing agree to 9 decimals.
DECIMALS = 9


@query(
    "better_tied_worse",
    f"""SELECT comparison, count(*) FILTER (d > 0) AS better, count(*) FILTER (d = 0) AS tied, count(*) FILTER (d < 0) AS worse
        FROM (SELECT comparison, round(value - baseline, {DECIMALS}) AS d FROM {_PAIRED}) GROUP BY comparison""",
)
def better_tied_worse(t: Tables) -> DataFrame:
    """Counted on differences to 9 decimals."""
    return H.better_tied_worse(paired(t), ["comparison"], decimals=DECIMALS)


@query(
    "ladder_tests",
    f"""SELECT a, b, count(*) AS n_pairs, CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS statistic FROM (
         SELECT a, b, d, rank() OVER (PARTITION BY a, b, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r
         FROM (SELECT x.method AS a, y.method AS b, round(y.metric - x.metric, {DECIMALS}) AS d FROM {{methods}} x JOIN {{methods}} y ON x.subject = y.subject AND x.method < y.method)) GROUP BY a, b HAVING count(*) >= 2""",
)
def ladder_tests(t: Tables) -> DataFrame:
    """Ranks of differences to 9 decimals; pairs without a difference count but have no rank."""
    return H.ladder_tests(t("methods"), decimals=DECIMALS).select("a", "b", "n_pairs", "statistic")
