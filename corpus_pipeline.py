"""A training-text pipeline: each stage's result is written as Parquet and read as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import discard, materialize, read_table
from gridspark.llm.decontaminate import drop_leaks
from gridspark.llm.jaccard_join import jaccard_join
from gridspark.llm.line_dedup import line_dedup
from gridspark.llm.packing import pack_documents
from gridspark.llm.toxicity import toxicity_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


ROW = "pipeline_row"
#: Up to so many dropped rows are sent to all tasks, at some 20 bytes each; beyond, rows are joined by number.
SENT_ROWS = 4_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity models reject go; they are carried through the pass that scores them."""
    rows = docs.select("doc_id", "text", *[F.col(c).alias(f"row_{i}") for i, c in enumerate(docs.columns)])
    scores = toxicity_scores(rows, read_table(spark, sf_dir, "labels"), carry=[f"row_{i}" for i in range(len(docs.columns))])
    return scores.where("predicted = 0").select(*[F.col(f"row_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, and of longer lines alone, are deleted; n_chars follows the text."""
    out = line_dedup(docs, window=4, least=2, alone=20)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row that every reading gives alike: for a table in files the file's
    number and the place in it; any other frame is written with numbers first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "stage-rows")
    files = docs.select(F.col("_metadata.file_path").alias("file"))
    paths = sorted(r["file"] for r in files.distinct().collect())  # one row a file
    numbers = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(paths)), "number long, file string"))
    placed = docs.select("*", F.col("_metadata.file_path").alias("pipeline_file"), F.col("_metadata.row_index").alias("pipeline_place"))
    row = F.shiftleft("number", 36) + F.col("pipeline_place")
    return placed.join(numbers, F.col("pipeline_file") == F.col("file")).select(*[placed[c] for c in docs.columns], row.alias(ROW))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, that with the least id; null ids come last.

    Rows are told apart by numbers, so rows of one id, or of none, are judged one by one. Only the numbers
    of dropped rows travel.
    """
    rows = _numbered(docs)
    classes = jaccard_join(rows, id_col=ROW).select(F.col(ROW).alias("judged"), "class_id", "class_size").where("class_size > 1")
    numbered = rows.select(ROW, F.col("doc_id").alias("id")).join(classes, F.col(ROW) == F.col("judged"))
    one = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(ROW))
    classed = materialize(numbered.select("class_id", one.alias("one")), "stage-classes")
    first = classed.groupBy("class_id").agg(F.min("one").alias("first"))
    dropped = classed.join(first, "class_id").where(F.col("one") > F.col("first")).select(F.col(f"one.{ROW}").alias("judged"))
    dropped = materialize(dropped, "stage-dropped")
    discard(classed)
    small = dropped.count() <= SENT_ROWS
    return rows.join(F.broadcast(dropped) if small else dropped, rows[ROW] == dropped["judged"], "left_anti").drop(ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak a benchmark item go, inside the pass that searches them."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece."""
    return pack_documents(docs, capacity=2048, added_tokens=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models, hashes and tokens are no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage but the last is written and read again."""
    docs = before = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)  # what the stage read, unless it is the input
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
