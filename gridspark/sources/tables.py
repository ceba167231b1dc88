"""Readers of runs, grids, registries and banks; writers of epochs, results and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text


def scan_runs(spark: SparkSession, root: str, glob: str = "*.edf") -> DataFrame:
    """Paths and sizes of all files below ``root`` that match; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length").where(~F.element_at(F.split("path", "/"), -1).startswith("._"))


def parse_run_path(df: DataFrame, col: str = "path") -> DataFrame:
    """Study, subject, session, phase and condition from ``.../study/subject/session/phase[/condition]/file``."""
    parts = F.split(F.col(col), "/")
    at = F.array_position(F.transform(parts, lambda p: F.when(p.isin("Train", "Test"), F.lit("phase")).otherwise(p)), "phase").cast("int")
    part = lambda k: F.when(at + k > 0, F.get(parts, at + k - 1))
    after = F.get(parts, at)
    condition = F.when(at + 1 >= F.size(parts), F.lit("Unspecified")).otherwise(after)
    return df.select(*df.columns, part(-3).alias("study"), part(-2).alias("subject"), part(-1).alias("session"), part(0).alias("phase"), condition.alias("condition"))


def parse_run_id(df: DataFrame, col: str = "run_id") -> DataFrame:
    """Subject (before ``_SE<digits>``) and condition (DynBigram before Dyn, else RC)."""
    c = F.col(col)
    condition = F.when(c.contains("DynBigram"), "DynBigram").when(c.contains("Dyn"), "Dyn").otherwise("RC")
    return df.select(*df.columns, F.regexp_extract(c, r"^(.*?)_SE[0-9]+", 1).alias("subject"), condition.alias("condition"))


def _json_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("k", "v"))


def grid_from_json(df: DataFrame, col: str = "layout") -> DataFrame:
    """Grid rows from a JSON map ``{label: [row, col]}``; codes count along rows from 1."""
    keep = [c for c in df.columns if c != col]
    rows = df.select(*keep, F.from_json(col, "map<string,array<int>>").alias("_m"))
    rows = rows.select(*keep, F.map_entries("_m").alias("_e"), F.array_max(F.transform(F.map_values("_m"), lambda a: a[1])).alias("_n"))
    rows = rows.select(*keep, F.explode("_e").alias("_e"), "_n")
    code = (F.col("_e.value")[0] - 1) * F.col("_n") + F.col("_e.value")[1]
    return rows.select(*keep, F.col("_e.key").alias("label"), F.col("_e.value")[0].alias("row"), F.col("_e.value")[1].alias("col"), code.alias("code"), (code - 1).alias("cell_idx"))


def read_grid_layout(spark: SparkSession, path: str, study: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.lit(study).alias("study"), F.col("value").alias("layout"))
    return grid_from_json(raw)


def missing_cells(grid: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Cells of the rectangle that no label has."""
    spark = grid.sparkSession
    cells = spark.range(n_rows * n_cols).select((F.floor(F.col("id") / n_cols) + 1).cast("int").alias("row"), (F.col("id") % n_cols + 1).cast("int").alias("col"))
    return cells.join(grid.select("row", "col"), ["row", "col"], "left_anti")


def registry_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """(session_id, target_text) from a JSON map; values that are no strings are dropped."""
    rows = df.select(F.explode(F.expr(f"variant_get(parse_json({col}), '$', 'map<string,variant>')")).alias("session_id", "v"))
    return rows.where(F.expr("schema_of_variant(v) = 'STRING'")).select("session_id", F.expr("variant_get(v, '$', 'string')").alias("target_text"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_from_json(spark.read.text(path, wholetext=True))


def manifest_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """(subject, run_id) from ``{subject: [run_id, ...]}``, without repeats."""
    rows = df.select(F.explode(F.from_json(col, "map<string,array<string>>")).alias("subject", "runs"))
    return rows.select("subject", F.explode("runs").alias("run_id")).distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_from_json(spark.read.text(path, wholetext=True))


def clean_phrase_bank(bank: DataFrame, subject: str | None = None) -> DataFrame:
    """Normalised phrases with defaults for source, category and weight; empty or weightless ones go."""
    have = set(bank.columns)
    pick = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), F.lit(0.0)) if "weight" in have else F.lit(1.0)
    extra = [c for c in ("bank_pos", "subject") if c in have]
    out = bank.select(*extra, normalize_text(F.col("text")).alias("text"), pick("source", "unknown").alias("source"), weight.alias("weight"), pick("category", "general").alias("category"))
    out = out.where("text <> '' and weight > 0")
    return out if subject is None else out.withColumn("subject", F.lit(subject))


def read_phrase_bank(spark: SparkSession, path: str, subject: str | None = None) -> DataFrame:
    if path.endswith(".json"):
        raw = spark.read.json(path, multiLine=True)
    else:
        raw = spark.read.csv(path, header=True, schema="text string, source string, weight double, category string")
    return clean_phrase_bank(raw, subject)


def write_epochs(df: DataFrame, path: str, attrs: dict[str, str], run_col: str = "run_id", array_col: str = "x") -> None:
    """Append-once store partitioned by run; unequal shapes or an existing store are errors."""
    shapes = df.agg(F.min(F.size(array_col)).alias("low"), F.max(F.size(array_col)).alias("high")).first()
    if shapes["low"] != shapes["high"]:
        raise ValueError(f"epochs have from {shapes['low']} to {shapes['high']} values")
    df.write.mode("errorifexists").partitionBy(run_col).parquet(f"{path}/epochs")
    meta = [(k, str(v)) for k, v in attrs.items()]
    df.sparkSession.createDataFrame(meta, "name string, value string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")


def incremental_runs(runs: DataFrame, done: DataFrame, id_col: str = "run_id") -> DataFrame:
    """Runs that are not written yet."""
    return runs.join(done.select(id_col).distinct(), id_col, "left_anti")


def split_failures(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with their error); ``error`` is null for a good row."""
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def upsert_results(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` with other keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns).unionByName(new)


def write_summary_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
