"""Queries over text functions, retrieval and priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.sizes import parameter_table
from ..operators import retrieval as R
from ..operators import session as G
from .queries_decode import prior_arrays
from .registry import Tables, query

_NORM = r"trim(regexp_replace(lower(replace(x, '_', ' ')), '\s+', ' ', 'g'))"
_MESSY = "(SELECT p_partkey, '  ' || upper(p_name) || CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '   tail' ELSE '' END AS x FROM {part})"


def messy(t: Tables) -> DataFrame:
    return t("part").selectExpr("p_partkey", "concat('  ', upper(p_name), CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '   tail' ELSE '' END) x")


@query("normalize_text", f"SELECT p_partkey, {_NORM} AS text FROM {_MESSY}")
def normalize_text(t: Tables) -> DataFrame:
    return messy(t).select("p_partkey", T.normalize_text(F.col("x")).alias("text"))


@query("normalize_context", f"SELECT p_partkey, {_NORM} || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END AS text FROM {_MESSY}")
def normalize_context(t: Tables) -> DataFrame:
    return messy(t).select("p_partkey", T.normalize_context(F.col("x")).alias("text"))


@query("partial_word", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE string_split({_NORM}, ' ')[-1] END AS word FROM {_MESSY}")
def partial_word(t: Tables) -> DataFrame:
    return messy(t).select("p_partkey", T.partial_word(T.normalize_context(F.col("x"))).alias("word"))


_SUFFIX = "(SELECT DISTINCT context, array_to_string(w[i:], ' ') AS suffix FROM (SELECT context, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT context, string_split(context, ' ') AS w FROM (SELECT DISTINCT lower(context) AS context FROM {contexts}))) WHERE array_to_string(w[i:], ' ') <> '')"


def contexts(t: Tables) -> DataFrame:
    return t("contexts").select(F.lower("context").alias("context")).distinct()


@query("context_suffixes", f"SELECT context, suffix FROM {_SUFFIX}")
def context_suffixes(t: Tables) -> DataFrame:
    return contexts(t).select("context", F.explode(T.context_suffixes(T.normalize_context(F.col("context")))).alias("suffix"))


_SHA = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(sha256('salt:' || session_id), ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 100)"
_TRAIN = f"(SELECT regexp_extract(session_id, '^(.*?)_SE', 1) AS subject, upper(target_text) AS text FROM {{registry}} WHERE {_SHA} >= 20)"


def subjects(t: Tables) -> DataFrame:
    return t("registry").withColumn("subject", F.regexp_extract("session_id", "^(.*?)_SE", 1))


@query("build_phrase_bank", f"SELECT DISTINCT subject, text FROM {_TRAIN} UNION ALL SELECT DISTINCT CAST(NULL AS VARCHAR) AS subject, text FROM {_TRAIN}")
def build_phrase_bank(t: Tables) -> DataFrame:
    return R.build_phrase_bank(subjects(t), "salt")


@query(
    "bank_sizes",
    f"SELECT r.subject, count(DISTINCT b.text) AS phrases, count(DISTINCT b.text) < 5 AS sparse FROM (SELECT DISTINCT regexp_extract(session_id, '^(.*?)_SE', 1) AS subject FROM {{registry}}) r LEFT JOIN {_TRAIN} b ON r.subject = b.subject GROUP BY r.subject",
)
def bank_sizes(t: Tables) -> DataFrame:
    reg = subjects(t)
    return R.bank_sizes(reg, R.build_phrase_bank(reg, "salt"), 5)


_WORDS = r"(SELECT DISTINCT unnest(string_split_regex(lower(regexp_replace(text, '[^A-Za-z\s]', '', 'g')), '\s+')) AS word FROM {documents})"
_ORDERED = f"(SELECT word, row_number() OVER (ORDER BY md5('3:' || word), word) - 1 AS r FROM {_WORDS} WHERE word <> '' AND word NOT IN (SELECT DISTINCT lower(p_name) FROM {{part}}))"


@query("sample_bank", f"SELECT CAST(s.n AS INT) AS size, o.r AS place, o.word FROM {_ORDERED} o JOIN (VALUES (18), (150), (500)) s(n) ON o.r < s.n")
def sample_bank(t: Tables) -> DataFrame:
    return R.sample_bank(t("documents"), t("part").select(F.col("p_name").alias("word")), [18, 150, 500], 3)


_BANK = "(SELECT bank_pos, lower(text) AS text, weight FROM {phrase_bank} WHERE weight > 0)"
_FOUND = f"""(SELECT s.context, b.bank_pos, length(s.suffix) AS len, b.start, l.cell_idx, b.weight * (1.0 + length(s.suffix)) * CASE WHEN b.start = 1 AND s.suffix = s.context THEN 2 ELSE 1 END AS score
    FROM {_SUFFIX} s JOIN (SELECT *, unnest(range(1, length(text) + 1)) AS start FROM {_BANK}) b ON (b.start = 1 OR substr(b.text, b.start - 1, 1) = ' ') AND substr(b.text, b.start, length(s.suffix)) = s.suffix AND b.start + length(s.suffix) <= length(b.text)
    JOIN {{letters}} l ON l.ch = substr(b.text, b.start + length(s.suffix), 1))"""
_MATCHES = f"""(SELECT context, bank_pos, score, len, cell_idx, row_number() OVER (PARTITION BY context ORDER BY len DESC, score DESC, bank_pos) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY context, bank_pos ORDER BY score DESC, len DESC, start) AS k FROM {_FOUND}) WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY context ORDER BY len DESC, score DESC, bank_pos) <= 20)"""


def bank(t: Tables) -> DataFrame:
    return t("phrase_bank").where("weight > 0").select("bank_pos", F.lower("text").alias("text"), "weight")


def matches(t: Tables) -> DataFrame:
    return R.phrase_matches(contexts(t), bank(t), t("letters"))


@query("phrase_matches", f"SELECT context, bank_pos, CAST(score AS DOUBLE) AS score, CAST(len AS INT) AS len, cell_idx, CAST(rank AS INT) AS rank FROM {_MATCHES}")
def phrase_matches(t: Tables) -> DataFrame:
    return matches(t)


_PRIOR = f"""(SELECT context, cell_idx, p, max(p) OVER (PARTITION BY context) AS confidence, max(p) OVER (PARTITION BY context) - coalesce(max(CASE WHEN k = 2 THEN p END) OVER (PARTITION BY context), 0) AS margin FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY p DESC, cell_idx) AS k FROM (SELECT context, cell_idx, sum(score) / sum(sum(score)) OVER (PARTITION BY context) AS p FROM {_MATCHES} GROUP BY context, cell_idx)))"""


@query("retrieval_prior", f"SELECT context, cell_idx, round(p, 6) AS p, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM {_PRIOR}")
def retrieval_prior(t: Tables) -> DataFrame:
    return R.retrieval_prior(matches(t)).withColumns({c: F.round(c, 6) for c in ("p", "confidence", "margin")})


@query(
    "prior_reasons",
    f"""SELECT a.context, coalesce(m.n, 0) AS matches, CAST(coalesce(m.len, 0) AS INT) AS matched_len, round(coalesce(p.confidence, 0), 6) AS confidence, round(coalesce(p.margin, 0), 6) AS margin,
               CASE WHEN m.n IS NULL THEN 'no_matches' WHEN m.s <= 0 THEN 'no_grid_compatible_next_char' ELSE 'available' END AS reason
        FROM (SELECT DISTINCT lower(context) AS context FROM {{contexts}} UNION SELECT DISTINCT lower(n_name) FROM {{nation}}) a
        LEFT JOIN (SELECT context, count(*) AS n, max(len) AS len, sum(score) AS s FROM {_MATCHES} GROUP BY context) m ON m.context = a.context
        LEFT JOIN (SELECT context, max(confidence) AS confidence, max(margin) AS margin FROM {_PRIOR} GROUP BY context) p ON p.context = a.context""",
)
def prior_reasons(t: Tables) -> DataFrame:
    """Names of nations are contexts without a match."""
    asked = contexts(t).unionByName(t("nation").select(F.lower("n_name").alias("context"))).distinct()
    out = R.prior_reasons(asked, R.phrase_matches(asked, bank(t), t("letters")))
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "margin")})


_BIGRAMS = f"(SELECT substr(text, i, 1) AS a, substr(text, i + 1, 1) AS b, sum(weight) AS n FROM (SELECT *, unnest(range(1, length(text))) AS i FROM {_BANK}) GROUP BY 1, 2)"


@query("char_bigrams", f"SELECT a, b, round(n, 6) AS n FROM {_BIGRAMS}")
def char_bigrams(t: Tables) -> DataFrame:
    return R.char_bigrams(bank(t)).withColumn("n", F.round("n", 6))


@query(
    "bigram_backoff_prior",
    f"""SELECT c.context, g.cell_idx, round(g.p, 6) AS p FROM (SELECT DISTINCT lower(context) AS context FROM {{contexts}}) c JOIN (
          SELECT a, cell_idx, p FROM (SELECT *, CASE WHEN count(*) OVER w > 1 THEN -sum(p * ln(p)) OVER w / ln(count(*) OVER w) ELSE 0 END AS h FROM (
            SELECT b.a, l.cell_idx, b.n / sum(b.n) OVER (PARTITION BY b.a) AS p FROM {_BIGRAMS} b JOIN {{letters}} l ON l.ch = b.b WHERE b.n >= 2) WINDOW w AS (PARTITION BY a)) WHERE h <= 0.65) g ON g.a = substr(c.context, -1, 1)""",
)
def bigram_backoff_prior(t: Tables) -> DataFrame:
    return R.bigram_backoff_prior(contexts(t), R.char_bigrams(bank(t)), t("letters")).withColumn("p", F.round("p", 6))


@query(
    "gates",
    "SELECT event_id, round(1 / (1 + exp(-10 * (value / 100 - 0.6))), 6) AS soft, round(1 / (1 + exp(-0.2 * (floor(value) - 15))), 6) AS sufficiency, round(least(1.0, value / 10), 6) AS subject FROM {events}",
)
def gates(t: Tables) -> DataFrame:
    v = F.col("value")
    return t("events").select("event_id", F.round(N.soft_gate(v / 100, 0.6, 10), 6).alias("soft"), F.round(N.sufficiency_gate(F.floor(v)), 6).alias("sufficiency"), F.round(N.subject_weight(v), 6).alias("subject"))


_WEIGHTS = """(SELECT run, char_idx, g * CASE WHEN g + s > 0.9 THEN 0.9 / (g + s) ELSE 1 END AS g, s * CASE WHEN g + s > 0.9 THEN 0.9 / (g + s) ELSE 1 END AS s FROM (
    SELECT run, char_idx, 0.7 / (1 + exp(-30 * (gc - 0.6))) AS g, 0.7 * 1.5 * least(1.0, n / 10.0) / (1 + exp(-10 * (sc - 0.2))) / (1 + exp(-0.2 * (n * 2 - 15))) AS s
    FROM (SELECT run, char_idx, max(p) * 3 AS gc, max(p) AS sc, run % 12 AS n FROM {prior} GROUP BY run, char_idx)))"""


def blended(t: Tables) -> DataFrame:
    rows = prior_arrays(t).withColumn("base", F.transform("prior", lambda v: F.lit(1.0))).withColumn("n", F.col("run") % 12)
    rows = rows.select("run", "char_idx", "base", F.col("prior").alias("global_prior"), F.reverse("prior").alias("subject_prior"), (F.array_max("prior") * 3).alias("global_conf"), F.array_max("prior").alias("subject_conf"), F.col("n").alias("phrases"), (F.col("n") * 2).alias("tokens"))
    return R.blend_priors(rows, rag_weight=0.7)


_BLEND = f"(SELECT q.run, q.char_idx, q.cell_idx, (1 - w.g - w.s) / 9 + (w.g + w.s) * (q.p * w.g + r.p * w.s) / (w.g + w.s) AS p FROM {{prior}} q JOIN {{prior}} r ON q.run = r.run AND q.char_idx = r.char_idx AND r.cell_idx = 8 - q.cell_idx JOIN {_WEIGHTS} w ON w.run = q.run AND w.char_idx = q.char_idx)"


@query("blend_priors", f"SELECT run, char_idx, cell_idx, round(p, 6) AS p FROM {_BLEND}")
def blend_priors(t: Tables) -> DataFrame:
    return blended(t).select("run", "char_idx", F.posexplode("prior").alias("cell_idx", "p")).withColumn("p", F.round("p", 6))


@query("blend_weights", f"SELECT run, char_idx, round(g, 6) AS global_weight, round(s, 6) AS subject_weight FROM {_WEIGHTS}")
def blend_weights(t: Tables) -> DataFrame:
    return blended(t).select("run", "char_idx", F.round("global_weight", 6).alias("global_weight"), F.round("subject_weight", 6).alias("subject_weight"))


@query("normalize_probs", "SELECT vec_id, i - 1 AS i, round(greatest(x[i], 0) / sum(greatest(x[i], 0)) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT vec_id, embedding AS x, CAST(unnest(range(1, 65)) AS INT) AS i FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM {embeddings}))")
def normalize_probs(t: Tables) -> DataFrame:
    x = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return x.select("vec_id", F.posexplode(R.normalize_probs(F.col("x"))).alias("i", "p")).withColumn("p", F.round("p", 6))


@query("softmax_scores", "SELECT vec_id, i - 1 AS i, round(exp(x[i]) / sum(exp(x[i])) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT vec_id, embedding AS x, CAST(unnest(range(1, 65)) AS INT) AS i FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM {embeddings}))")
def softmax_scores(t: Tables) -> DataFrame:
    x = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return x.select("vec_id", F.posexplode(R.softmax_scores(F.col("x"))).alias("i", "p")).withColumn("p", F.round("p", 6))


_BEST = "(SELECT run, char_idx, arg_max(cell_idx, round(p, 9) - cell_idx * 1e-12) AS f FROM {0} GROUP BY run, char_idx)"


@query(
    "flip_diagnostics",
    f"""SELECT min(w) AS weight_min, max(w) AS weight_max, round(avg(w), 6) AS weight_mean, count(*) AS n, count(*) FILTER (b <> f) AS flips, count(*) FILTER (b <> f AND f = t) AS toward, count(*) FILTER (b <> f AND f <> t AND b = t) AS away, count(*) FILTER (b <> f AND f <> t AND b <> t) AS other, round(avg(CAST(b <> f AS DOUBLE)), 6) AS rate
        FROM (SELECT x.f AS f, y.f AS b, t.target_cell AS t, CAST(x.run % 5 AS DOUBLE) / 10 AS w FROM {_BEST.format('(SELECT run, char_idx, 8 - cell_idx AS cell_idx, p FROM {prior})')} x JOIN {_BEST.format('{prior}')} y ON x.run = y.run AND x.char_idx = y.char_idx JOIN {{trials}} t ON t.run = x.run AND t.char_idx = x.char_idx)""",
)
def flip_diagnostics(t: Tables) -> DataFrame:
    rows = prior_arrays(t).withColumn("base", F.col("prior")).withColumn("prior", F.reverse("prior")).join(t("trials"), ["run", "char_idx"])
    out = R.flip_diagnostics(rows.withColumn("w", F.col("run") % 5 / 10), target="target_cell", weight="w")
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "weight_mean")})


@query("source_counts", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT coalesce(CASE WHEN flash_id % 3 = 1 THEN 'global' WHEN flash_id % 3 = 2 THEN 'subject' END, 'base') AS source FROM {scores}) GROUP BY source")
def source_counts(t: Tables) -> DataFrame:
    source = F.when(F.col("flash_id") % 3 == 1, "global").when(F.col("flash_id") % 3 == 2, "subject")
    return R.source_counts(t("scores").withColumn("source", source)).withColumn("share", F.round("share", 6))


@query(
    "session_growth",
    """SELECT p_partkey, count(*) OVER w AS phrases, CAST(coalesce(sum(len(string_split(p_name, ' '))) OVER w, 0) AS BIGINT) AS tokens FROM {part}
       WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def session_growth(t: Tables) -> DataFrame:
    trials = t("part").selectExpr("p_brand subject", "p_partkey", "p_partkey pos", "p_name text")
    return R.session_growth(trials).select("p_partkey", "phrases", F.col("tokens").cast("long").alias("tokens"))


_OBSERVED = "(SELECT p_brand AS subject, CAST(p_partkey AS BIGINT) AS pos, lower(p_name) AS text FROM {part})"
_INITIAL = "(SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY text) AS BIGINT) AS bank_pos, text, weight FROM (SELECT p_brand AS subject, lower(p_type) AS text, CAST(count(*) AS DOUBLE) AS weight FROM {part} GROUP BY 1, 2))"
_SESSION_BANK = f"(SELECT subject, 0 AS origin, bank_pos, text, weight, CAST(-1 AS BIGINT) AS since FROM {_INITIAL} UNION ALL SELECT subject, 1, pos, text, 1.0, pos FROM {_OBSERVED})"
_SESSION_ASKED = "(SELECT p_brand AS subject, CAST(p_partkey AS BIGINT) AS pos, lower(substr(p_name, 1, CAST(1 + p_partkey % 8 AS INT))) AS context FROM {part} UNION ALL SELECT p_brand, CAST(p_partkey AS BIGINT), chr(CAST(97 + p_partkey % 26 AS INT)) || 'q' FROM {part})"
_SESSION = f"""
    WITH asked AS (SELECT DISTINCT * FROM {_SESSION_ASKED}), bank AS (SELECT * FROM {_SESSION_BANK}),
    suffixes AS (SELECT DISTINCT subject, pos, context, array_to_string(w[i:], ' ') AS suffix FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, string_split(context, ' ') AS w FROM asked)) WHERE array_to_string(w[i:], ' ') <> ''),
    found AS (
        SELECT s.subject, s.pos, s.context, b.origin, b.bank_pos, length(s.suffix) AS len, b.start, l.cell_idx, b.weight * (1.0 + length(s.suffix)) * CASE WHEN b.start = 1 AND s.suffix = s.context THEN 2 ELSE 1 END AS score
        FROM suffixes s JOIN (SELECT *, unnest(range(1, length(text) + 1)) AS start FROM bank) b ON b.subject = s.subject AND b.since < s.pos
             AND (b.start = 1 OR substr(b.text, b.start - 1, 1) = ' ') AND substr(b.text, b.start, length(s.suffix)) = s.suffix AND b.start + length(s.suffix) <= length(b.text)
        JOIN {{letters}} l ON l.ch = substr(b.text, b.start + length(s.suffix), 1)),
    matches AS (
        SELECT *, row_number() OVER (PARTITION BY subject, pos, context ORDER BY len DESC, score DESC, origin, bank_pos) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY subject, pos, context, origin, bank_pos ORDER BY score DESC, len DESC, start) AS k FROM found) WHERE k = 1
        QUALIFY row_number() OVER (PARTITION BY subject, pos, context ORDER BY len DESC, score DESC, origin, bank_pos) <= 20),
    words AS (SELECT subject, pos, context, cell_idx, sum(score) / sum(sum(score)) OVER (PARTITION BY subject, pos, context) AS p, 'word_match' AS source FROM matches GROUP BY subject, pos, context, cell_idx),
    pairs AS (
        SELECT a.subject, a.pos, a.context, l.cell_idx, sum(b.weight) AS n
        FROM (SELECT * FROM asked ANTI JOIN words USING (subject, pos, context)) a
        JOIN (SELECT *, unnest(range(1, length(text))) AS i FROM bank) b ON a.subject = b.subject AND b.since < a.pos AND substr(b.text, b.i, 1) = substr(a.context, -1, 1)
        JOIN {{letters}} l ON l.ch = substr(b.text, b.i + 1, 1) GROUP BY ALL),
    shares AS (SELECT *, count(*) OVER w AS k, -sum(p * ln(p)) OVER w AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY subject, pos, context) AS p FROM pairs WHERE n >= 2) WINDOW w AS (PARTITION BY subject, pos, context)),
    evened AS (SELECT subject, pos, context, cell_idx, p, CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END AS h FROM shares),
    priors AS (SELECT * FROM words UNION ALL SELECT subject, pos, context, cell_idx, p, 'char_backoff' FROM evened WHERE h <= 0.65),
    sizes AS (SELECT a.subject, a.pos, count(b.text) AS phrases, CAST(coalesce(sum(len(string_split(b.text, ' '))), 0) AS BIGINT) AS tokens FROM (SELECT DISTINCT subject, pos FROM asked) a LEFT JOIN bank b ON a.subject = b.subject AND b.since < a.pos GROUP BY ALL)
    SELECT a.subject, a.pos, a.context, p.cell_idx, round(p.p, 6) AS p, round(coalesce(max(p.p) OVER (PARTITION BY a.subject, a.pos, a.context), 0), 6) AS confidence, coalesce(p.source, 'none') AS source,
           CASE WHEN p.cell_idx IS NOT NULL THEN 'available' WHEN s.phrases = 0 THEN 'no_matches' WHEN e.subject IS NOT NULL THEN 'high_entropy' ELSE 'below_min_count' END AS reason, s.phrases, s.tokens
    FROM asked a LEFT JOIN priors p USING (subject, pos, context) LEFT JOIN (SELECT DISTINCT subject, pos, context FROM evened WHERE h > 0.65) e USING (subject, pos, context) JOIN sizes s USING (subject, pos)
"""


def session_asked(t: Tables) -> DataFrame:
    """The start of each trial's text, and a context that no phrase holds."""
    start = "p_brand subject", "CAST(p_partkey AS BIGINT) pos"
    return t("part").selectExpr(*start, "lower(substr(p_name, 1, 1 + p_partkey % 8)) context").unionByName(t("part").selectExpr(*start, "concat(chr(97 + p_partkey % 26), 'q') context"))


def session_observed(t: Tables) -> DataFrame:
    return t("part").selectExpr("p_brand subject", "CAST(p_partkey AS BIGINT) pos", "lower(p_name) text")


def session_initial(t: Tables) -> DataFrame:
    rows = t("part").groupBy(F.col("p_brand").alias("subject"), F.lower("p_type").alias("text")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return rows.withColumn("bank_pos", F.row_number().over(Window.partitionBy("subject").orderBy("text")))


@query("session_prior", _SESSION.replace(f"SELECT * FROM {_SESSION_BANK}", f"SELECT * FROM {_SESSION_BANK} WHERE origin = 1"))
def session_prior(t: Tables) -> DataFrame:
    """Only earlier phrases of the same session: the first trials of a subject have none."""
    out = G.session_prior(session_asked(t), session_observed(t), t("letters"))
    return out.withColumns({c: F.round(c, 6) for c in ("p", "confidence")})


@query("session_prior_initial", _SESSION)
def session_prior_initial(t: Tables) -> DataFrame:
    """The same over an initial bank of weighted phrases."""
    out = G.session_prior(session_asked(t), session_observed(t), t("letters"), session_initial(t))
    return out.withColumns({c: F.round(c, 6) for c in ("p", "confidence")})


_TEXT = r"(SELECT '  ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS t FROM {documents})"
_COUNTS = f"(SELECT h AS history, ch, sum(n) AS n FROM (SELECT substr(w, 3 - k, k) AS h, ch, n FROM (SELECT substr(t, i - 2, 2) AS w, substr(t, i, 1) AS ch, count(*) AS n FROM (SELECT t, unnest(range(3, length(t) + 1)) AS i FROM {_TEXT} WHERE length(t) > 2) GROUP BY 1, 2) CROSS JOIN (VALUES (0), (1), (2)) o(k)) GROUP BY h, ch)"


@query("ngram_counts", f"SELECT history, ch, CAST(n AS BIGINT) AS n FROM {_COUNTS}")
def ngram_counts(t: Tables) -> DataFrame:
    return R.ngram_counts(t("documents"), 2)


@query(
    "ngram_prior",
    f"""SELECT context, cell_idx, round(n / sum(n) OVER (PARTITION BY context), 6) AS p FROM (SELECT c.context, l.cell_idx, CAST(k.n AS DOUBLE) AS n, length(k.history) AS len, max(length(k.history)) OVER (PARTITION BY c.context) AS best
          FROM (SELECT DISTINCT lower(context) AS context FROM {{contexts}}) c JOIN {_COUNTS} k ON k.history = right(c.context, length(k.history)) AND length(k.history) <= length(c.context) JOIN {{letters}} l ON l.ch = k.ch) WHERE len = best""",
)
def ngram_prior(t: Tables) -> DataFrame:
    return R.ngram_prior(R.ngram_counts(t("documents"), 2), contexts(t), t("letters"), 2).withColumn("p", F.round("p", 6))


@query("top_prior_keys", "SELECT run, char_idx, cell_idx, round(p, 6) AS p, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run, char_idx ORDER BY round(p, 9) DESC, cell_idx) AS rank FROM {prior}) WHERE rank <= 4")
def top_prior_keys(t: Tables) -> DataFrame:
    return R.top_prior_keys(t("prior"), 4, ["run", "char_idx"]).select("run", "char_idx", "cell_idx", F.round("p", 6).alias("p"), "rank")


_GROUPS = "(SELECT code, cell_idx FROM (SELECT CAST(row AS INT) AS code, cell_idx FROM {grid} UNION ALL SELECT CAST(3 + col AS INT), cell_idx FROM {grid}))"


@query("rank_groups_by_prior", f"SELECT run, char_idx, code, round(mass, 6) AS mass, CAST(row_number() OVER (PARTITION BY run, char_idx ORDER BY round(mass, 9) DESC, code) AS INT) AS place FROM (SELECT p.run, p.char_idx, g.code, sum(p.p) AS mass FROM {{prior}} p JOIN {_GROUPS} g ON p.cell_idx = g.cell_idx GROUP BY p.run, p.char_idx, g.code)")
def rank_groups_by_prior(t: Tables) -> DataFrame:
    grid = t("grid")
    codes = grid.select(F.col("row").alias("code"), "cell_idx").unionByName(grid.select((F.col("col") + 3).alias("code"), "cell_idx"))
    groups = t("trials").select("run", "char_idx").join(parameter_table(codes))
    return R.rank_groups_by_prior(groups, t("prior"), ["run", "char_idx"], 3).select("run", "char_idx", "code", F.round("mass", 6).alias("mass"), "place")
