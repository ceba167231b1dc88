"""Helpers that several corpus operators share: tables, the shared folder, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Word characters of the contracts: everything but these six bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage, survives the loss of executors, and gives later joins plain exchanges on
    both sides, which adaptive execution can split when a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/gridspark-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), vectorised; wraps modulo 2**64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of many texts at once, as numpy arrays.

    ``hash`` has one 64-bit value per word, ``start``/``end`` are byte offsets into ``data``, and
    ``bounds`` has for text i the words ``bounds[i]:bounds[i + 1]``. Nulls count as empty.
    """

    __slots__ = ("bounds", "data", "end", "hash", "start")

    def __init__(self, texts: list, lower: bool = False, breaks: bytes = b""):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8)
        if lower:
            data = _TO_LOWER[data]
        space = _IS_SPACE[data]
        if breaks:  # further bytes that end a word
            table = _IS_SPACE.copy()
            table[list(breaks)] = True
            space = table[data]
        before = np.ones_like(space)
        before[1:] = space[:-1]
        self.start = np.flatnonzero(~space & before)
        after = np.ones_like(space)
        after[:-1] = space[1:]
        self.end = np.flatnonzero(~space & after) + 1
        self.data = data
        self.hash = _span_hashes(data, self.start, self.end)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        self.bounds = np.searchsorted(self.start, edges)


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Hash of each span: a polynomial over byte codes from prefix sums, times an inverse power.

    Prefix sums restart every ``block`` bytes so that the power tables stay small; spans that
    cross a block border take the sum of two blocks.
    """
    out = np.zeros(len(start), _U)
    if not len(start):
        return out
    longest = int((end - start).max())
    size = max(block, longest)
    up, down = _powers(_BASE, size * 2), _powers(_INVERSE, size * 2)
    at = 0
    while at < len(start):
        origin = int(start[at])
        stop = int(np.searchsorted(end, origin + 2 * size, side="right"))
        stop = max(stop, at + 1)
        s, e = start[at:stop] - origin, end[at:stop] - origin
        part = data[origin : int(end[stop - 1])]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTE_CODES[part] * up[: len(part)], out=sums[1:])
        out[at:stop] = (sums[e] - sums[s]) * down[s]
        at = stop
    return mix64(out ^ mix64((end - start).astype(_U)))


def window_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values in ``h``, by doubling; empty if too short."""
    if len(h) < n:
        return np.zeros(0, _U)
    cur, length, done, acc = mix64(h + _U(seed)), 1, 0, None
    rest = n
    while rest:
        if rest & 1:
            if acc is None:
                acc = cur
            else:
                m = len(h) - (done + length) + 1
                acc = mix64(acc[:m] * _U(0x9E3779B97F4A7C15) + cur[done : done + m])
            done += length
        rest >>= 1
        if rest:
            m = len(cur) - length
            cur = mix64(cur[:m] * _U(0x9E3779B97F4A7C15) + cur[length : length + m])
            length *= 2
    return acc[: len(h) - n + 1]
