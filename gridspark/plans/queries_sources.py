"""Queries over readers, trials and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splits as P
from ..sources import tables as S
from ..sources.scratch import new_path
from .registry import Tables, query

_CONDITION = "CASE WHEN contains(session_id, 'DynBigram') THEN 'DynBigram' WHEN contains(session_id, 'Dyn') THEN 'Dyn' ELSE 'RC' END"
_CELLS = "(VALUES (1), (2), (3)) r(v) CROSS JOIN (VALUES (1), (2), (3)) c(v)"


@query("scan_runs")
def scan_runs(t: Tables) -> DataFrame:
    """The table files themselves, as a directory tree of runs."""
    runs = S.scan_runs(t.spark, t.sf_dir, "*.parquet")
    return runs.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query(
    "parse_run_path",
    """SELECT c_custkey, string_split(path, '/')[2] AS study, string_split(path, '/')[3] AS subject, string_split(path, '/')[4] AS session,
              string_split(path, '/')[5] AS phase, CASE WHEN len(string_split(path, '/')) > 6 THEN string_split(path, '/')[6] ELSE 'Unspecified' END AS condition FROM {paths}""",
)
def parse_run_path(t: Tables) -> DataFrame:
    return S.parse_run_path(t("paths")).drop("path")


@query("parse_run_id", f"SELECT session_id, regexp_extract(session_id, '^(.*?)_SE[0-9]+', 1) AS subject, {_CONDITION} AS condition FROM {{registry}}")
def parse_run_id(t: Tables) -> DataFrame:
    return S.parse_run_id(t("registry").select("session_id"), "session_id")


@query(
    "read_grid_layout",
    "SELECT p_brand AS study, p_name AS label, CAST(row_number() OVER w AS INT) AS row, 1 AS col, CAST(row_number() OVER w AS INT) AS code, CAST(row_number() OVER w - 1 AS INT) AS cell_idx FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_name, p_partkey) QUALIFY count(*) OVER (PARTITION BY p_brand, p_name) = 1",
)
def read_grid_layout(t: Tables) -> DataFrame:
    """One-column layouts per brand, packed as JSON maps and parsed again."""
    rows = t("part").selectExpr("p_brand study", "p_name", "cast(row_number() over (partition by p_brand order by p_name, p_partkey) as int) r", "count(*) over (partition by p_brand, p_name) k").where("k = 1")
    packed = rows.groupBy("study").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_name", F.array(F.col("r"), F.lit(1)))))).alias("layout"))
    return S.grid_from_json(packed)


@query("read_registry", "SELECT session_id, target_text FROM {registry} WHERE c_custkey % 10 <> 0")
def read_registry(t: Tables) -> DataFrame:
    """Registries packed as JSON maps, where every tenth value is a number, read back."""
    value = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit('"'), "target_text", F.lit('"')))
    pairs = t("registry").select((F.col("c_custkey") % 64).alias("part"), F.concat(F.lit('"'), "session_id", F.lit('":'), value).alias("pair"))
    packed = pairs.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("pair"), ","), F.lit("}")).alias("value"))
    return S.registry_from_json(packed)


@query("read_manifest", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS subject, CAST(c_custkey AS VARCHAR) AS run_id FROM {customer}")
def read_manifest(t: Tables) -> DataFrame:
    runs = t("customer").groupBy("c_nationkey").agg(F.collect_list(F.col("c_custkey").cast("string")).alias("runs"))
    packed = runs.select(F.to_json(F.create_map(F.col("c_nationkey").cast("string"), "runs")).alias("value"))
    return S.manifest_from_json(packed)


@query(
    "read_phrase_bank",
    r"SELECT bank_pos, trim(regexp_replace(lower(replace(text, '_', ' ')), '\s+', ' ', 'g')) AS text, source, weight, 'general' AS category, subject FROM {phrase_bank} WHERE weight > 0",
)
def read_phrase_bank(t: Tables) -> DataFrame:
    return S.clean_phrase_bank(t("phrase_bank"))


@query("write_epochs", "SELECT CAST(run AS INT) AS run_id, count(*) AS epochs FROM {epochs} GROUP BY run")
def write_epochs(t: Tables) -> DataFrame:
    """Epochs written to the shared folder, and counted per run from the store."""
    path = new_path(t.spark, "epochs")
    S.write_epochs(t("epochs").withColumnRenamed("run", "run_id"), path, {"sfreq": "256", "channels": "4"})
    return t.spark.read.parquet(f"{path}/epochs").groupBy("run_id").agg(F.count(F.lit(1)).alias("epochs"))


@query("incremental_runs", "SELECT session_id FROM {registry} WHERE session_id NOT IN (SELECT session_id FROM {heldout})")
def incremental_runs(t: Tables) -> DataFrame:
    return S.incremental_runs(t("registry").select("session_id"), t("heldout"), "session_id")


@query("split_failures", "SELECT event_id, 'no value in range' AS error FROM {events} WHERE value > 100 OR value IS NULL")
def split_failures(t: Tables) -> DataFrame:
    """The failures table: one row per record that was skipped, with its error."""
    bad = F.col("value").isNull() | (F.col("value") > 100)
    return S.split_failures(t("events"), F.when(bad, F.lit("no value in range")))[1].select("event_id", "error")


@query(
    "upsert_results",
    """SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM {customer} WHERE c_custkey % 3 <> 0
       UNION ALL SELECT c_custkey AS k, CAST(c_nationkey + 100 AS BIGINT) AS v FROM {customer} WHERE c_custkey % 3 = 0""",
)
def upsert_results(t: Tables) -> DataFrame:
    old = t("customer").selectExpr("c_custkey k", "cast(c_nationkey as bigint) v")
    new = t("customer").where("c_custkey % 3 = 0").selectExpr("c_custkey k", "cast(c_nationkey + 100 as bigint) v")
    return S.upsert_results(old, new, ["k"])


@query("write_summary_tables", "SELECT run, count(*) AS count FROM {flashes} GROUP BY run")
def write_summary_tables(t: Tables) -> DataFrame:
    """Two summaries written as CSV and read back."""
    path = new_path(t.spark, "summary")
    S.write_summary_tables({"by_type": t("events").groupBy("event_type").count(), "by_run": t("flashes").groupBy("run").count()}, path)
    return t.spark.read.csv(f"{path}/by_run", header=True, schema="run long, count long")


@query("char_trials", "SELECT session_id, i - 1 AS char_idx, substr(target_text, i, 1) AS target_char, substr(target_text, 1, i - 1) AS context FROM (SELECT *, CAST(unnest(range(1, length(target_text) + 1)) AS INT) AS i FROM {registry})")
def char_trials(t: Tables) -> DataFrame:
    return P.char_trials(t("registry"))


#: Keys of the demonstration layout; the longest match wins.
KEYS = ["AUTO", "BUILD", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_TOKENS = "(SELECT session_id, regexp_extract_all(target_text, 'BUILD|AUTO|[A-Z]') AS keys FROM {registry})"


@query("tokenize_keys", f"SELECT session_id, array_to_string(keys, ' ') AS keys, len(keys) AS n_keys FROM {_TOKENS}")
def tokenize_keys(t: Tables) -> DataFrame:
    out = P.tokenize_keys(t("registry"), KEYS)
    return out.select("session_id", F.array_join("keys", " ").alias("keys"), F.size("keys").cast("long").alias("n_keys"))


@query(
    "key_context",
    f"""SELECT session_id, CAST(i - 1 AS INT) AS key_idx, keys[i] AS key,
               coalesce(array_to_string(list_transform(keys[1:i - 1], lambda k: CASE WHEN length(k) > 1 THEN ' ' || k || ' ' ELSE k END), ''), '') AS context
        FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM {_TOKENS})""",
)
def key_context(t: Tables) -> DataFrame:
    return P.key_context(P.tokenize_keys(t("registry"), KEYS))


@query("map_special_keys", "SELECT c_custkey, key, CASE key WHEN 'AUTO' THEN ' ' WHEN 'BUILD' THEN '' ELSE lower(key) END AS text FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'AUTO' WHEN c_custkey % 5 = 1 THEN 'BUILD' ELSE substr(c_mktsegment, 1, 1) END AS key FROM {customer})")
def map_special_keys(t: Tables) -> DataFrame:
    keymap = t.spark.sql("SELECT * FROM VALUES ('AUTO', ' '), ('BUILD', '') AS m(key, text)")
    keys = t("customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN 'AUTO' WHEN c_custkey % 5 = 1 THEN 'BUILD' ELSE substr(c_mktsegment, 1, 1) END key")
    return P.map_special_keys(keys, keymap)


@query("clean_training_pool", "SELECT session_id FROM {registry} WHERE contains(session_id, 'Train') AND c_custkey % 5 <> 0")
def clean_training_pool(t: Tables) -> DataFrame:
    return P.clean_training_pool(t("registry").select("session_id"), t("heldout"))


@query("split_violations", "SELECT session_id, CASE WHEN c_custkey % 5 = 0 THEN 'held out' ELSE 'test label' END AS reason FROM {registry} WHERE c_custkey % 5 = 0 OR contains(session_id, 'Test')")
def split_violations(t: Tables) -> DataFrame:
    return P.split_violations(t("registry"), t("heldout"))


@query(
    "partition_label_vault",
    """SELECT session_id, target_text, contains(session_id, 'Train') AND c_custkey % 5 <> 0 AS visible FROM {registry}
       UNION ALL SELECT 'old' || session_id, target_text, false FROM {registry} WHERE c_custkey % 50 = 0""",
)
def partition_label_vault(t: Tables) -> DataFrame:
    old = t("registry").where("c_custkey % 50 = 0").select(F.concat(F.lit("old"), "session_id").alias("session_id"), "target_text")
    safe, vault = P.partition_label_vault(t("registry"), old, t("heldout"))
    return safe.withColumn("visible", F.lit(True)).unionByName(vault.withColumn("visible", F.lit(False)))


_SHA = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(sha256('salt:' || session_id), ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 100)"


@query("hash_split", f"SELECT session_id, {_SHA} < 20 AS held_out FROM {{registry}}")
def hash_split(t: Tables) -> DataFrame:
    return P.hash_split(t("registry").select("session_id"), "session_id", "salt", 20)


@query("select_eval_sessions", "SELECT session_id, c_custkey FROM {registry} WHERE session_id IN (SELECT session_id FROM {heldout})")
def select_eval_sessions(t: Tables) -> DataFrame:
    return P.select_eval_sessions(t("registry").select("session_id", "c_custkey"), t("heldout"))


@query(
    "balanced_sample",
    "SELECT flash_id, y FROM (SELECT flash_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('7:' || CAST(flash_id AS VARCHAR)), flash_id) AS k FROM {scores}) WHERE k <= 250",
)
def balanced_sample(t: Tables) -> DataFrame:
    return P.balanced_sample(t("scores").select("flash_id", "y"), "y", 500, 7, "flash_id")


@query("group_kfold")
def group_kfold(t: Tables) -> DataFrame:
    return P.group_kfold(t("scores").select("flash_id", "subject"), "subject", 3)


@query(
    "protocol_audit",
    f"""SELECT condition, phase, count(*) AS runs, count(*) FILTER (held) AS held_out, count(*) FILTER (held AND phase = 'Train') AS overlap
        FROM (SELECT {_CONDITION} AS condition, CASE WHEN contains(session_id, 'Train') THEN 'Train' ELSE 'Test' END AS phase, c_custkey % 5 = 0 AS held FROM {{registry}}) GROUP BY condition, phase""",
)
def protocol_audit(t: Tables) -> DataFrame:
    return P.protocol_audit(t("registry").select("session_id"), t("heldout"))


@query(
    "protocol_overlaps",
    f"""SELECT session_id, condition, phase, held_out, phase = 'Test' AS test_labelled FROM (SELECT session_id, {_CONDITION} AS condition, CASE WHEN contains(session_id, 'Train') THEN 'Train' ELSE 'Test' END AS phase, c_custkey % 5 = 0 AS held_out FROM {{registry}}) WHERE held_out OR phase = 'Test'""",
)
def protocol_overlaps(t: Tables) -> DataFrame:
    return P.protocol_overlaps(t("registry"), t("heldout"))


@query("target_counts", "SELECT subject, count(*) FILTER (y = 1) AS target, count(*) FILTER (y = 0) AS non_target, count(DISTINCT run) AS runs FROM {flashes} GROUP BY subject")
def target_counts(t: Tables) -> DataFrame:
    return P.target_counts(t("flashes"))


@query("usable_characters", "SELECT run, char_idx, count(DISTINCT seq_idx) AS sequences FROM {flashes} WHERE stim_code BETWEEN 1 AND 6 GROUP BY run, char_idx HAVING count(DISTINCT seq_idx) >= 2")
def usable_characters(t: Tables) -> DataFrame:
    return P.usable_characters(t("flashes"), 6, 2)


@query(
    "complete_subjects",
    """SELECT subject, round(max(metric) FILTER (method = 'click'), 6) AS click, round(max(metric) FILTER (method = 'view'), 6) AS view
       FROM {methods} GROUP BY subject HAVING count(*) FILTER (method IN ('click', 'view')) = 2""",
)
def complete_subjects(t: Tables) -> DataFrame:
    out = P.complete_subjects(t("methods"), ["click", "view"])
    return out.select("subject", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))
