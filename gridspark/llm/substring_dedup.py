"""Removal of long passages that repeat across documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, window_hashes

SCANNED = "key long, id long, t long, n_words long, digest string, seq long, more long, anchors array<long>"
EXTENDED = "key long, seq long, more long, text string, starts array<int>, windows array<long>, checks array<long>"
CUT = "row long, n_removed long, kept_sha256 string, anchors array<array<long>>"
#: Texts are taken in groups of about this many bytes, so that numpy's temporaries stay small.
GROUP_BYTES = 4_000_000


def _groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts have about ``GROUP_BYTES``, one row at least."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)])
        group = np.cumsum(sizes) // GROUP_BYTES
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64) if kind == pa.int64() else flat.astype(np.int32)))


def _digest(words: Words, a: int, b: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the words a:b (of those, the ones to keep) joined by one space."""
    data = words.data
    use = range(a, b) if keep is None else (np.flatnonzero(keep) + a).tolist()
    s, e = words.start, words.end
    return hashlib.sha256(b" ".join([data[s[i] : e[i]].tobytes() for i in use])).hexdigest()


def _whole_digest(words: Words, a: int, b: int) -> str:
    """The same for all words, without a step for each: gaps between words shrink to one space."""
    if a == b:
        return hashlib.sha256(b"").hexdigest()
    low, high = int(words.start[a]), int(words.end[b - 1])
    part = words.data[low:high]
    fill = np.zeros(len(part) + 1, np.int8)
    fill[words.start[a:b] - low] += 1
    fill[words.end[a:b] - low] -= 1
    inside = np.cumsum(fill[:-1]).astype(bool)
    first_gap = ~inside
    first_gap[1:] &= inside[:-1]
    out = np.where(inside, part, 32).astype(np.uint8)[inside | first_gap]
    return hashlib.sha256(out.tobytes()).hexdigest()


def _names(digests: list[str]) -> tuple[pa.Array, pa.Array]:
    """The first 128 bits of hex digests, as two columns: they name a sequence of words in shuffles."""
    both = np.frombuffer(b"".join(bytes.fromhex(d[:32]) for d in digests), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values, by doubling."""
    out, length = x, 1
    while length * 2 <= n:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = n - length
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def doubled_anchors(h: np.ndarray, repeated: np.ndarray, least: int) -> list[np.ndarray]:
    """Anchors among the windows of ``2 * least`` words both of whose halves repeat.

    Of each ``least`` neighbouring starts the one with the least hash is an anchor. An anchor's
    array has two hashes for its window, and two for each doubling of it that the text still holds.
    """
    n = len(h) - 2 * least + 1
    if n <= 0:
        return []
    seen = np.zeros(len(h) - least + 1, bool)
    seen[repeated] = True
    use = seen[:n] & seen[least:]
    if not use.any():
        return []
    doubles = []
    length = 2 * least
    while length <= len(h):
        doubles.append((window_hashes(h, length, 2).view(np.int64), window_hashes(h, length, 3).view(np.int64)))
        length *= 2
    order = np.where(use, doubles[0][0].view(np.uint64), np.uint64(2**64 - 1))
    at = np.flatnonzero(np.isin(order, _sliding_min(order, min(least, n))) & use)
    return [np.array([x[i] for pair in doubles for x in pair if i < len(x)], np.int64) for i in at.tolist()]


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept_sha256, longest_repeat).

    A word goes if it lies in a window of ``least`` consecutive words whose sequence also starts
    in a row with a smaller id; windows are judged on the input. ``longest_repeat`` is the longest
    doubled length (``least`` times a power of two) at which a window of the row was found in
    another row too, 0 if none was: a passage of that length is shared, and a shared passage of
    n words is found at each length up to n - ``least`` + 1. For a row that is cut whole it is the
    row's own length.

    Level one takes windows of half the least length. Among the starts that a full window spans,
    the one with the least hash is its anchor, so equal full windows share their anchor. Anchors
    that only one word sequence has are dropped; those that repeat are extended to twice their
    length: each full window around a repeated anchor becomes a candidate. Windows of ``least``
    words that more than one row has keep the smallest id as their first place; all later places
    are cut. The doubling goes on until no candidates survive: where both halves of a window of
    twice the length repeat, it is a candidate (one anchor of each ``least`` neighbouring ones), and
    a candidate that repeats is extended to twice its length, on tables of survivors alone. Rows
    with the same words as a row with a smaller id are cut whole without any windows.

    Nulls and texts of white space have no words. Null ids come before all others and are not
    smaller than one another. Rows of the same id never cut each other. Extra columns, also of
    clashing names, are ignored; an empty table gives no rows. Windows are compared by two 64-bit
    hashes; very long texts are taken whole, never cut into prefixes.
    """
    half = max(1, (least + 1) // 2)
    reach = least - half + 1
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))

    def anchors_of(h: np.ndarray) -> np.ndarray:
        return _sliding_min(window_hashes(h, half, 1), reach) if len(h) >= least else np.zeros(0, np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 2):
            words = Words(part.column(2).to_pylist())
            spans = list(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True))
            anchors = [np.unique(anchors_of(words.hash[a:b])).view(np.int64) for a, b in spans]
            digests = [_whole_digest(words, a, b) for a, b in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(np.diff(words.bounds)), pa.array(digests), *_names(digests), _lists(anchors, pa.int64())], names=["key", "id", "t", "n_words", "digest", "seq", "more", "anchors"])

    scanned = materialize(source.mapInArrow(scan, SCANNED), "passage-scan")
    anchors = scanned.select(F.struct("key", "t").alias("row"), "seq", "more", F.explode("anchors").alias("h"))
    repeated = materialize(anchors.groupBy("h").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).where("a < b").select("h"), "passage-anchors")
    found = anchors.join(repeated, "h").groupBy("seq", "more").agg(F.min("row").alias("row"), F.collect_set("h").alias("anchors"))
    found = found.select("row.key", "row.t", "seq", "more", "anchors")  # one row of each word sequence

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for part in _groups(batches, 3):
            words = Words(part.column(3).to_pylist())
            rows, starts, windows, checks = [], [], [], []
            for i, known in enumerate(part.column(4)):
                a, b = words.bounds[i], words.bounds[i + 1]
                this = tuple(part.column(k)[i].as_py() for k in range(3))
                if this == done or this[1:] != tuple(x[0].as_py() for x in _names([_whole_digest(words, a, b)])):
                    continue  # the row before again, or another text of the same hash
                done = this
                h = words.hash[a:b]
                at = np.flatnonzero(np.isin(anchors_of(h), known.values.to_numpy().view(np.uint64)))
                rows.append(i)
                starts.append(at)
                windows.append(window_hashes(h, least, 2)[at].view(np.int64))
                checks.append(window_hashes(h, least, 3)[at].view(np.int64))
            taken = part.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:4], _lists(starts, pa.int32()), _lists(windows, pa.int64()), _lists(checks, pa.int64())], names=["key", "seq", "more", "text", "starts", "windows", "checks"])

    joined = found.join(source.select("key", "t", "text"), ["key", "t"]).select("key", "seq", "more", "text", "anchors")
    number = F.monotonically_increasing_id().alias("row")
    extended = materialize(joined.mapInArrow(extend, EXTENDED).select("*", number), "passage-windows")
    if not extended.groupBy("key", "seq", "more").count().where("count > 1").isEmpty():  # repeated rows that met in different tasks
        extended = materialize(extended.dropDuplicates(["key", "seq", "more"]), "passage-windows-once")
    places = extended.select("row", "key", F.inline(F.arrays_zip("starts", "windows", "checks"))).toDF("row", "key", "start", "window", "check")
    firsts = places.groupBy("window", "check").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("window", "check", "first")
    repeated = places.join(materialize(firsts, "passage-firsts"), ["window", "check"])
    marks = repeated.groupBy("row").agg(F.collect_list(F.col("start") * 2 + (F.col("key") > F.col("first")).cast("int")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 1):
            words = Words(part.column(1).to_pylist())
            removed, digests, anchors = [], [], []
            for i, marked in enumerate(part.column(2)):
                a, b = words.bounds[i], words.bounds[i + 1]
                at = marked.values.to_numpy()
                edge = np.zeros(b - a + 1, np.int64)
                later = at[at % 2 == 1] // 2
                np.add.at(edge, later, 1)
                np.add.at(edge, later + least, -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed.append(int((~keep).sum()))
                digests.append(_digest(words, a, b, keep) if len(later) else None)
                anchors.append(doubled_anchors(words.hash[a:b], at // 2, least))
            counts = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
            nested = pa.ListArray.from_arrays(pa.array(counts), _lists([x for row in anchors for x in row], pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), nested], names=["row", "n_removed", "kept_sha256", "anchors"])

    joined = extended.select("row", "text").join(marks, "row").select("row", "text", "marks")
    cuts = materialize(joined.mapInArrow(cut, CUT), "passage-cuts")
    owners = extended.select("row", "key", "seq", "more")
    level, survivors = 1, cuts.join(owners, "row").select("row", "key", F.explode("anchors").alias("hashes"))
    reached = cuts.select("row", F.lit(least).alias("length"))
    while True:
        window, check = F.get("hashes", F.lit(2 * level - 2)), F.get("hashes", F.lit(2 * level - 1))
        candidates = survivors.where(F.size("hashes") >= 2 * level).select("row", "key", "hashes", window.alias("window"), check.alias("check"))
        twice = candidates.groupBy("window", "check").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("window", "check")
        survivors = materialize(candidates.join(materialize(twice, "passage-twice"), ["window", "check"]).drop("window", "check"), "passage-survivors")
        if survivors.isEmpty():
            break
        reached = reached.unionByName(survivors.select("row", F.lit(least * 2**level).alias("length")))
        level += 1
    reached = reached.groupBy("row").agg(F.max("length").alias("longest"))
    cuts = cuts.drop("anchors").join(reached, "row").join(owners, "row").drop("row")
    copies = materialize(scanned.where(F.col("n_words") >= least).groupBy("seq", "more").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("seq", "more", "first"), "passage-copies")
    rows = scanned.drop("anchors", "t").join(copies, ["seq", "more"], "left").join(materialize(cuts, "passage-results"), ["key", "seq", "more"], "left")
    whole = F.col("key") > F.col("first")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("longest", F.lit(0))).cast("long").alias("longest_repeat"),
    )
