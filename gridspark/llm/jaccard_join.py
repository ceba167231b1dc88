"""Near-duplicate self-join on word n-grams: MinHash, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, materialize, mix64, window_hashes
from .components import connected_components
from .substring_dedup import _groups, _lists

BANDS, ROWS = 48, 7
_RANDOM = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_FACTORS = (_RANDOM[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_RANDOM[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)

SCANNED = "key long, id long, t long, n_grams long, node long, check long, bands array<long>"
ALIVE = "unit long, node long"
PREPARED = "node long, signature binary, grams array<long>"
COMPARED = "node long, links long, root long"


def gram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a shorter text has one gram of all its words."""
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(n, len(hashes)), len(hashes) if len(hashes) < n else n))


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values: least product of each gram's upper half with one odd factor a value."""
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 512):
        out = np.minimum(out, ((high[at : at + 512, None] ^ _SHIFTS) * _FACTORS).min(axis=0))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; for a matrix, one row of keys per signature."""
    parts = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) + np.zeros_like(parts[..., 0])
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[..., r])
    return key


def _node(grams: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit identities of a set of grams; zeros for the empty set."""
    if not len(grams):
        return 0, 0
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        spread = mix64(grams ^ np.uint64(seed))
        both = np.array([np.bitwise_xor.reduce(spread), np.add.reduce(spread), len(grams)], np.uint64)
        out.append(int(mix64(mix64(mix64(both[:1]) + both[1:2]) + both[2:])[0].view(np.int64)))
    return out[0], out[1]


def least_matches(threshold: float, tolerance: float, step: int, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair with fewer than m matches may go.

    With a uniform prior, m matches of n give the posterior Beta(m + 1, n - m + 1); its mass at or
    above the threshold is the chance of at most m successes in n + 1 draws at the threshold.
    """
    out = []
    for n in range(step, total + 1, step):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if mass >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def likely_pairs(sides: np.ndarray, sigs: np.ndarray, plan: list[tuple[int, int]], cross: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a unit the later ones that may be similar to it, by MinHash values alone.

    Two sets are a candidate pair if they share a band key and, in a unit of two chunks (``cross``),
    come from different chunks; if one of the two is empty there is no pair. MinHash values are
    compared a block at a time, and pairs that fall behind ``plan`` are dropped.
    """
    m = len(sides)
    keys = band_keys(sigs)
    for i in range(m - 1):
        other = np.arange(i + 1, m)
        if cross:
            other = other[sides[other] != sides[i]]
        other = other[(keys[other] == keys[i]).any(axis=1)]
        matches, done = np.zeros(len(other), np.int64), 0
        for n, least in plan:
            if not len(other):
                break
            matches += (sigs[other, done:n] == sigs[i, done:n]).sum(axis=1)
            other, matches, done = other[matches >= least], matches[matches >= least], n
        if len(other):
            yield i, other


def compare_unit(nodes: np.ndarray, copies: np.ndarray, sides: np.ndarray, sigs: np.ndarray, grams: list[np.ndarray], threshold: float, plan: list[tuple[int, int]], cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (in rows of the other sets) and the least linked node of each set in one unit; likely pairs are verified exactly."""
    m = len(nodes)
    links, parent = np.zeros(m, np.int64), np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    universe, flat = np.unique(np.concatenate(grams), return_inverse=True)
    sizes = np.array([len(g) for g in grams])
    ends = np.cumsum(sizes)
    own = [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    member = np.zeros(len(universe), bool)
    for i, other in likely_pairs(sides, sigs, plan, cross):
        member[own[i]] = True
        counts = np.add.reduceat(member[np.concatenate([own[j] for j in other])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[other])[:-1]]))
        member[own[i]] = False
        for j in other[counts + 1e-9 >= threshold * (sizes[i] + sizes[other] - counts)].tolist():
            links[i] += copies[j]
            links[j] += copies[i]
            p, q = root(i), root(j)
            if p != q:
                p, q = (p, q) if nodes[p] < nodes[q] else (q, p)
                parent[q] = p
    return links, nodes[[root(i) for i in range(m)]]


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, unit_sets: int = 600, unit_grams: int = 600_000, node_bits: int = 64) -> DataFrame:
    """One row per input row: (id, class_id, class_size, n_links, n_grams).

    Rows are linked if the Jaccard similarity of their sets of word n-grams is at least
    ``threshold``. ``n_links`` counts the linked rows, copies of the same set included; a class is
    what links join, and ``class_id`` its least id.

    Rows of equal sets are one node; sets are told apart by two 64-bit numbers, of which the first
    (its lower ``node_bits`` bits) names the node, and where two sets meet in one name they get new
    ones. Nodes that share one of 48 bands of 7 MinHash values are candidates (a pair at 0.8 is
    missed with a chance of 1e-5). Each node is tied to the least node of its bands, never to all
    of them; components of those ties hold all candidate pairs. Small components are dealt to units
    together. A large component is cut into chunks, one unit for each pair of chunks, so no unit
    outgrows memory and no pairs become rows. A unit first gets MinHash values alone, compares them
    in blocks, drops pairs whose posterior chance of reaching the threshold is below ``tolerance``,
    and names the sets that are left; only these are then sent in full, and verified exactly. A unit
    returns sums and a spanning forest.

    Words are as they stand. A text shorter than ``words`` has one gram; nulls and texts without
    words have none and are copies of one another, linked to nothing else. Null ids are kept; a
    class of null ids only has a null ``class_id``. Repeated rows and rows of one id are rows like
    any others. Very long texts are taken whole; an empty table gives no rows; extra columns, also
    of clashing names, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    source = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
    mask = (1 << node_bits) - 1 if node_bits < 64 else -1

    def sets_of(part: pa.RecordBatch) -> list[np.ndarray]:
        w = Words(part.column("text").to_pylist())
        return [gram_set(w.hash[a:b], words) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 2):
            sets = sets_of(part)
            sigs = {}  # copies in one batch share the work
            bands = []
            names = [_node(g) for g in sets]
            for name, g in zip(names, sets, strict=True):
                if name not in sigs:
                    sigs[name] = band_keys(signature(g)).view(np.int64) if len(g) else np.zeros(0, np.int64)
                bands.append(sigs[name])
            first = pa.array([a & mask for a, _ in names], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([len(g) for g in sets], pa.int64()), first, pa.array([b for _, b in names], pa.int64()), _lists(bands, pa.int64())], names=["key", "id", "t", "n_grams", "node", "check", "bands"])

    def nodes_of(rows: DataFrame) -> DataFrame:
        row = F.min(F.struct("key", "t")).alias("row")
        sums = [row, F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), F.max("n_grams").alias("n_grams"), F.min("check").alias("check"), F.max("check").alias("other"), F.first("bands").alias("bands")]
        return materialize(rows.groupBy("node").agg(*sums), "near-nodes")

    scanned = materialize(source.mapInArrow(scan, SCANNED), "near-scan")
    nodes = nodes_of(scanned)
    shared_names = nodes.where("check < other").select("node", F.lit(True).alias("shared"))
    if not shared_names.isEmpty():  # different sets of one name: name them by both numbers
        named = scanned.join(shared_names, "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("node", "check")).otherwise(F.col("node")))
        scanned = materialize(named.drop("shared"), "near-scan-named")
        nodes = nodes_of(scanned)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialize(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("band", "pivot"), "near-bands")
    ties = banded.join(shared, "band").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    parts = connected_components(ties)
    discard(shared)

    members = materialize(parts.join(nodes.select("node", "check", "row.key", "row.t", "copies", "n_grams"), "node"), "near-members")
    loads = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"))
    loads = materialize(loads.withColumn("chunks", F.greatest(F.ceil(F.col("n") / unit_sets), F.ceil(F.col("g") / unit_grams)).cast("int")), "near-loads")
    small = loads.where("chunks = 1").agg(F.sum("n"), F.sum("g")).first()
    bins = max(1, math.ceil((small[0] or 0) / unit_sets), math.ceil((small[1] or 0) / unit_grams))
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks") == 1, F.array(F.struct(F.xxhash64(F.lit("bin"), F.pmod(F.xxhash64("root"), F.lit(bins))).alias("unit"), F.lit(False).alias("cross")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.xxhash64(F.col("root"), F.least(o, F.col("chunk")), F.greatest(o, F.col("chunk"))).alias("unit"), (o != F.col("chunk")).alias("cross")))
    )
    tasks = members.join(loads.select("root", "chunks"), "root").withColumn("chunk", chunk)
    tasks = tasks.select("node", "copies", F.when(F.col("chunks") == 1, 0).otherwise(F.col("chunk")).alias("side"), F.inline(pairs))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 1):
            sets = sets_of(part)
            wanted, checks = part.column(0).to_pylist(), part.column(2).to_pylist()
            rows = [i for i, g in enumerate(sets) if _node(g)[1] == checks[i]]  # else another text of the same hash
            yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in rows], pa.int64()), pa.array([signature(sets[i]).tobytes() for i in rows], pa.binary()), _lists([sets[i].view(np.int64) for i in rows], pa.int64())], names=["node", "signature", "grams"])

    texts = members.select("node", "check", "key", "t").hint("merge").join(source.select("key", "t", "text"), ["key", "t"]).select("node", "text", "check")
    prepared = materialize(texts.mapInArrow(prepare, PREPARED), "near-sets")
    if not prepared.groupBy("node").count().where("count > 1").isEmpty():  # repeated rows
        prepared = materialize(prepared.dropDuplicates(["node"]), "near-sets-once")
    plan = least_matches(threshold, tolerance, 2 * ROWS)

    def signatures(t: pa.Table) -> np.ndarray:
        return np.stack([np.frombuffer(x.as_py(), np.uint32) for x in t["signature"]])

    def prune(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        alive = np.zeros(t.num_rows, bool)
        for i, other in likely_pairs(t["side"].to_numpy(), signatures(t), plan, t["cross"][0].as_py()):
            alive[i] = alive[other] = True
        return t.select(["unit", "node"]).filter(pa.array(alive))

    def compare(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        grams = [x.values.to_numpy().view(np.uint64) for x in t["grams"]]
        ids = t["node"].to_numpy()
        links, roots = compare_unit(ids, t["copies"].to_numpy(), t["side"].to_numpy(), signatures(t), grams, threshold, plan, t["cross"][0].as_py())
        return pa.table({"node": ids, "links": links, "root": roots})

    alive = materialize(tasks.drop("copies").join(prepared.select("node", "signature"), "node").groupBy("unit").applyInArrow(prune, ALIVE), "near-alive")
    compared = tasks.join(alive, ["unit", "node"]).join(prepared, "node").groupBy("unit").applyInArrow(compare, COMPARED)
    compared = materialize(compared, "near-links")
    discard(prepared, alive, loads, members)
    totals = compared.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "copies", "least_id").join(classes, "node", "left").join(totals, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "near-named")
    heads = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    looked = materialize(named.join(materialize(heads, "near-heads"), "root").select("node", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-classes")
    discard(named, compared, nodes)
    return scanned.select("id", "node", "n_grams").join(looked, "node").select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", "n_grams")
