"""Streams on lists, maps and timers, over several micro-batches; the versioned table of results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import session as G
from gridspark.sources.results import ResultStore
from gridspark.streaming import streams as X


def run(spark, tmp_path, parts, schema, build, watermark="1 minute"):
    """Rows and what state is left after the parts, a micro-batch each; the last column counts seconds."""
    for part in parts:
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with X.rocksdb(spark):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", watermark)
        out = build(stream)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect(), left


def test_edges_close_with_the_watermark(spark, tmp_path):
    """Samples wait for missing ones until the watermark has passed; the gap has no edge; a paused recording goes on."""
    parts = [
        [(1, 4, 8.0, 4), (1, 0, 0.0, 0), (3, 0, 9.0, 0)],
        [(1, 1, 9.0, 1), (1, 3, 0.0, 3), (1, 6, 9.0, 6), (3, 1, 0.0, 1)],
        [(2, 0, 0.0, 800), (2, 1, 9.0, 801)],  # past the first ten minutes of recordings 1 and 3
        [(3, 2, 9.0, 802)],
        [(-1, None, None, 50_000)],
    ]
    got, left = run(spark, tmp_path, parts, "run long, sample long, signal double, s long", lambda s: X.stream_edges(s, 5.0))
    assert sorted(map(tuple, got)) == [(1, 1, 9.0), (1, 4, 8.0), (2, 1, 9.0), (3, 2, 9.0)] and left == 0


def test_many_recordings_share_a_state(spark, tmp_path):
    """Open recordings are kept by the bucket; edges do not wait for samples lost before them; repeated samples, samples
    without a value and those without a recording's number do no harm."""
    rng = np.random.default_rng(5)
    samples = [(r or None, k, float(v)) for r in range(300) for k, v in enumerate(rng.integers(0, 10, 20)) if (r + k) % 11 or not r]
    value = {(r, k): v for r, k, v in samples}
    edges = {(r, k, v) for (r, k), v in value.items() if v > 5 and value.get((r, k - 1), 9) <= 5}
    part = rng.integers(0, 3, len(samples))
    parts = [[(*x, x[1]) for x, p in zip(samples, part, strict=True) if p == i] for i in range(3)]
    parts[1] += parts[0][::3] + [(r, 30, None, 3) for r in range(1, 300)] + [(r, 31, float("nan"), 3) for r in range(300, 310)]
    parts[2] += parts[2][:100] + [(r, -1, 0.0, 3) for r in range(1, 9)]
    schema = "run long, sample long, signal double, s long"
    build = lambda s: X.stream_edges(s, 5.0, buckets=8)
    got, left = run(spark, tmp_path / "a", parts, schema, build)
    assert sorted(map(tuple, got), key=str) == sorted(edges, key=str) and 0 < left <= 9
    got, left = run(spark, tmp_path / "b", [*parts, [(-1, None, None, 10**6)]], schema, build)
    assert sorted(map(tuple, got), key=str) == sorted(edges, key=str) and left == 0


def test_all_characters_are_decided_and_no_state_is_left(spark, tmp_path):
    rng = np.random.default_rng(6)
    posts = {(r, c): [rng.dirichlet(np.full(4, 0.3)).tolist() for _ in range(4)] for r in (1, 2) for c in range(12)}
    parts = [[(r, c, s + 1, posts[r, c][s], 10 * s) for (r, c) in posts for s in steps if (r + c + s) % 5 or s < 2] for steps in ((0,), (1, 0), (3, 2))]
    parts.append([(-1, None, None, None, 10**6)])
    got, left = run(spark, tmp_path, parts, "run int, char_idx int, seq_idx int, posterior array<double>, s long", lambda s: X.stream_dynamic_stop(s, 0.9, 2, 4))
    want = set()
    for (r, c), ps in posts.items():
        log, n = 0, 0
        for s in range(4):
            if s >= 2 and not (r + c + s) % 5:
                continue
            log, n = log + np.log(np.clip(ps[s], 1e-9, 1)), n + 1
            p = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
            if (n >= 2 and p.max() >= 0.9) or n == 4:
                break
        want.add((r, c, int(p.argmax()), round(float(p.max()), 9), n, bool(n >= 2 and p.max() >= 0.9)))
    assert {(r["run"], r["char_idx"], r["decision"], round(r["confidence"], 9), r["sequences_used"], r["stopped"]) for r in got} == want
    assert len(got) == len(posts) and left == 0


def test_many_characters_share_a_state(spark, tmp_path):
    """Open characters are kept by the bucket; each is decided as by itself, also without a run or with other cells."""
    rng = np.random.default_rng(8)
    keys = [(r or None, c) for r in range(40) for c in range(50)]
    posts = {(k, s): rng.dirichlet(np.full(3 + k[1] % 3, 0.5)).tolist() for k in keys for s in range(3)}
    row = lambda k, s, seq=None: (*k, s if seq is None else seq, posts[k, s], s)
    first = [row(k, 0) for k in keys] + [row(k, 0) for k in keys[::7]]  # number 0 twice
    second = [row(k, s) for k in keys if k[1] % 5 for s in (2, 1)] + [(*keys[0], None, None, 5), (*keys[1], 9, [], 5)]
    third = [row(k, 2, 1) for k in keys]
    schema = "run int, char_idx int, seq_idx int, posterior array<double>, s long"
    build = lambda s: X.stream_dynamic_stop(s, 0.9, 1, 3, buckets=8)
    open_, left = run(spark, tmp_path / "a", [first], schema, build)
    want, early = set(), set()
    for k in keys:
        log = 0
        for n, s in enumerate((0, 1, 2) if k[1] % 5 else (0, 2), 1):
            log = log + np.log(np.clip(posts[k, s], 1e-9, 1))
            p = np.exp(log) / np.exp(log).sum()
            if p.max() >= 0.9 or n == 3:
                break
        want.add((*k, int(p.argmax()), round(float(p.max()), 9), n, bool(p.max() >= 0.9)))
        if n == 1:
            early.add(k)
    assert {(r["run"], r["char_idx"]) for r in open_} == early and 0 < left <= 16 < len(keys) - len(early)
    got, left = run(spark, tmp_path / "b", [first, second, third, [(-1, None, None, None, 10**6)]], schema, build)
    assert {(r["run"], r["char_idx"], r["decision"], round(r["confidence"], 9), r["sequences_used"], r["stopped"]) for r in got} == want
    assert len(got) == len(keys) and left == 0


def test_growing_bank_equals_the_batch(spark, tmp_path):
    """Trials in any order within the watermark's delay; one behind it is answered late, and learned."""
    cells = spark.createDataFrame([(i, c) for i, c in enumerate("abc ")], "cell_idx int, ch string")
    rng = np.random.default_rng(2)
    text = lambda: " ".join("".join(rng.choice(list("abcd"), 2)) for _ in range(3))
    trials = [(s, p, text()[: p % 4], text(), 10 * p) for s in ("x", "y") for p in range(30)]
    order = rng.permutation(len(trials))
    parts = [[trials[i] for i in order[k::3]] for k in range(3)]
    end = [(None, None, None, None, 10**7)]
    schema = "subject string, pos long, context string, text string, s long"
    build = lambda s: X.stream_session_prior(s, cells)
    got, left = run(spark, tmp_path / "a", [*parts, end], schema, build, "1 hour")
    asked = spark.createDataFrame([t[:3] for t in trials], "subject string, pos long, context string")
    bank = G.session_bank(spark.createDataFrame([(t[0], t[1], t[3]) for t in trials], "subject string, pos long, text string"))
    from gridspark.functions.text import normalize_context

    want = {(r["subject"], r["pos"], r["cell_idx"], r["p"] and round(r["p"], 9)) for r in G.session_backoff(asked.withColumn("context", normalize_context(F.col("context"))), bank, cells).collect() if r["cell_idx"] is not None}
    assert {(r["subject"], r["pos"], r["cell_idx"], round(r["p"], 9)) for r in got if r["p"] is not None} == want and want
    assert {(r["subject"], r["pos"]) for r in got} == {t[:2] for t in trials} and not any(r["late"] for r in got) and left == 0
    assert all(r["phrases"] == r["pos"] and r["tokens"] == 3 * r["pos"] for r in got)
    first = [("x", p, "a", "ab ab", 100 * p) for p in (1, 2, 4)]
    late = [("x", 3, "a", "ab ab", 1200), ("x", 2, "a", "b", 90)], [("x", 5, "a", "", 50_000)], end
    got, left = run(spark, tmp_path / "b", [first, [("y", 0, "", "b", 1000)], *late], schema, build, "1 minute")
    assert {(r["pos"], r["phrases"], r["late"]) for r in got if r["subject"] == "x"} == {(1, 0, False), (2, 1, False), (4, 2, False), (3, 3, True), (5, 4, False)} and left == 0


def test_result_store(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    store = ResultStore(spark, f"{tmp_path}/r", ["k"])
    shown = lambda v=None: sorted(map(tuple, store.read(v).collect()))
    assert store.version() == 0 and store.pending(frame(("a", 0))).count() == 1
    with pytest.raises(ValueError, match="version"):
        store.read()
    assert store.upsert(frame(("a", 1), ("b", 2)), "job", 0) == 1
    assert store.upsert(frame(("b", 3), ("c", 4)), "job", 1) == 2
    assert store.upsert(frame(("b", 9)), "job", 0) == 1 and store.upsert(frame(("b", 9)), "job", 1) == 2  # replays
    assert shown() == [("a", 1), ("b", 3), ("c", 4)] and shown(1) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="more than one row"):
        store.upsert(frame(("d", 1), ("d", 2)), "job", 2)
    assert store.version() == 2 and shown() == [("a", 1), ("b", 3), ("c", 4)]  # a failed batch is not seen
    assert store.upsert(frame(("d", 5)), "job", 2) == 3 and shown()[-1] == ("d", 5)  # and can be resumed
    assert [r["k"] for r in store.pending(frame(("a", 0), ("z", 0))).collect()] == ["z"]
    assert store.merge({"s2": frame(("a", 7)), "s1": frame(("a", 6), ("e", 6))}) == 5 and store.merge({"s1": frame(("a", 6))}) == 5
    assert shown() == [("a", 7), ("b", 3), ("c", 4), ("d", 5), ("e", 6)]
