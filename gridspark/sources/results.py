"""A table of results with versions: rows are replaced by key, readers see whole versions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import upsert_results

_LOG = "version long, folder string, writer string, batch long"


@dataclass(frozen=True)
class ResultStore:
    """Results under ``path``, one row for each value of ``keys``.

    A version is a folder of its own. It counts once its line is in the log, which a task writes as one
    file and Spark's commit moves into place at once; what a failed writer leaves behind is never read.
    A batch that is in the log is not written again, so a replayed one changes nothing. There is one
    writer at a time. Each version is written whole: results are small beside what they are made from.
    """

    spark: SparkSession
    path: str
    keys: Sequence[str]

    def log(self) -> DataFrame:
        """All versions: (version, folder, writer, batch)."""
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return self.log().agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        wanted = self.version() if version is None else version
        found = self.log().where(F.col("version") == wanted).first()
        if found is None:
            raise ValueError(f"there is no version {wanted} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{found['folder']}")

    def upsert(self, rows: DataFrame, writer: str = "main", batch: int | None = None) -> int:
        """Replace the rows of the same keys, keep all others; the version in which ``rows`` are."""
        log = self.log()
        if batch is not None:
            done = log.where((F.col("writer") == writer) & (F.col("batch") == batch)).agg(F.min("version")).first()[0]
            if done is not None:
                return done
        version = (log.agg(F.max("version")).first()[0] or 0) + 1
        # a folder that a failed writer left under this number is not read by anyone: it is written over
        folder = f"version={version:09d}"
        whole = upsert_results(self.read(version - 1), rows, self.keys) if version > 1 else rows
        whole.sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        doubled = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(*self.keys).count().where("count > 1").limit(1).collect()
        if doubled:
            raise ValueError(f"more than one row of {doubled[0].asDict()}")
        self.spark.createDataFrame([(version, folder, writer, batch)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def merge(self, sidecars: dict[str, DataFrame]) -> int:
        """Take in tables that other jobs wrote beside this one, by name and in that order, each once; the newest version."""
        for name in sorted(sidecars):
            self.upsert(sidecars[name], f"sidecar {name}", 0)
        return self.version()

    def pending(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` whose keys have no result yet: what a resumed job still has to do."""
        if not self.version():
            return wanted
        return wanted.join(self.read().select(*self.keys).distinct(), list(self.keys), "left_anti")

    def sink(self, writer: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: a batch's rows are upserted, once, under its number."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(shape(batch), writer, batch_id)

        return write
