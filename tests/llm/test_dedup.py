"""Exact dedup, line dedup, substring dedup and the Jaccard join against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm.components import connected_components
from gridspark.llm.exact_dedup import exact_dedup, split_directory
from gridspark.llm.jaccard_join import jaccard_join, least_matches
from gridspark.llm.line_dedup import line_dedup
from gridspark.llm.substring_dedup import _sliding_min, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, shared passages, repeated lines, and odd rows."""
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = words(70), []
    for i in range(60):
        w = words(rng.choice([3, 20, 80, 150, 300]))
        if i % 5 == 0:
            w[10:10] = passage
        if i % 7 == 0:
            w[30:30] = passage[:55]
        texts.append("\n".join(" ".join(w[a : a + 12]) for a in range(0, len(w), 12)))
    for i in range(0, 40, 4):
        texts.append(texts[i])
        near = texts[i].split(" ")
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    texts += ["", "   ", "one", "One", "ONE É", "one é", "two words", "same line\nagain\nsame line\nagain\nend", " ".join(words(4000))]
    return list(enumerate(texts))


def brute_lines(rows, n=2):
    first, cut = {}, defaultdict(set)
    for doc, text in sorted(rows):
        units = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\r\v\f")]
        for k in range(len(units) - n + 1):
            run = tuple(x for _, x in units[k : k + n])
            if first.setdefault(run, (doc, k)) != (doc, k):
                cut[doc].update(i for i, _ in units[k : k + n])
    return {d: (len(cut[d]), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in cut[d])) for d, t in rows}


@pytest.mark.parametrize("window", [2, 3])
def test_line_dedup(spark, corpus, window):
    got = {r["doc_id"]: (r["n_removed"], r["text"] or "") for r in line_dedup(spark.createDataFrame(corpus, DOCS), window=window).collect()}
    assert got == brute_lines(corpus, window) and sum(n for n, _ in got.values()) > 0


def brute_anchored(rows, alone, window=2, least=2):
    """Runs of lines that hold an anchor and start earlier: fingerprints from all windows, then all runs."""
    solid = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\v\f")] for d, t in rows}
    counts = Counter(x for units in solid.values() for _, x in units)
    order = lambda x: hashlib.md5(x.encode()).hexdigest()[:15] if counts[x] > 1 else "~"
    anchors = set()
    for units in solid.values():
        padded = [None] * (window - 1) + [x for _, x in units] + [None] * (window - 1)
        for b in range(len(padded) - window + 1):
            own = [x for x in padded[b : b + window] if x is not None]
            anchors |= {min(own, key=order)} if own else set()
    anchors = {x for x in anchors if counts[x] > 1}
    first, cut = {}, defaultdict(set)
    for doc in sorted(solid):
        units = solid[doc]
        for size in {1, *range(least, window + 1)}:
            for k in range(len(units) - size + 1):
                run = tuple(x for _, x in units[k : k + size])
                if anchors & set(run) and (size > 1 or len(run[0]) >= alone) and first.setdefault(run, (doc, k)) != (doc, k):
                    cut[doc].update(i for i, _ in units[k : k + size])
    return {d: (len(cut[d]), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in cut[d])) for d, t in rows}


@pytest.mark.parametrize(("window", "least"), [(3, 2), (4, 2), (5, 3)])
def test_short_matches_around_anchors(spark, window, least):
    """Runs over few lines, so that windows hold many repeats: of all lengths, in and across rows, at both ends."""
    rng = random.Random(window)
    rows = [(d, "\n".join(rng.choice([f"{'long line' * 3} {rng.randrange(9)}", f"s{rng.randrange(6)}", f"own {d} {k}", "  "]) for k in range(rng.randrange(14)))) for d in range(60)]
    got = {r["doc_id"]: (r["n_removed"], r["text"] or "") for r in line_dedup(spark.createDataFrame(rows, DOCS), window=window, least=least, alone=20).collect()}
    assert got == brute_anchored(rows, 20, window, least) and sum(n for n, _ in got.values()) > 50


@pytest.mark.parametrize("least", [1, 20])
def test_lines_repeated_alone(spark, corpus, least):
    """Boilerplate with other neighbours in each row goes, also where it is the only line; short lines stay."""
    boiler = "all rights of this text are reserved"
    rows = corpus + [(900 + i, f"{boiler}\nown line number {i} é\n}}") for i in range(6)] + [(910, boiler), (911, f"x\n{boiler}\ny\n{boiler}")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["n_removed"], r["text"] or "") for r in line_dedup(df, alone=least).collect()}
    assert got == brute_anchored(rows, least) and got[910] == (1, "") and got[911] == (2, "x\ny")
    assert got[903][1] == "own line number 3 é" + ("\n}" if least > 1 else "")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup(df).collect()}[910] == 0


def test_lines_of_long_texts_and_clashing_names(spark):
    """Many cuts in one long text, and extra columns whose names differ in case alone."""
    base = [f"line number {i}" for i in range(30_000)]
    rows = [(1, "\n".join(base)), (2, "\n".join(["own", *base, "own end"])), (3, None), (4, ""), (None, "\n\n \n")]
    df = spark.createDataFrame(rows, DOCS).withColumn("N_LINES", F.lit("x")).withColumn("run", F.lit(1)).withColumn("i", F.lit(2)).withColumn("check", F.lit(2))
    out = line_dedup(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "run", "i", "check", "n_lines", "n_removed"]
    assert got[2]["text"] == "own\nown end" and got[2]["n_removed"] == 30_000 and got[1]["n_removed"] == 0
    assert got[3]["text"] is None and got[3]["n_lines"] == 0 and got[None]["text"] == "\n\n \n"


@pytest.mark.parametrize("name", ["op4_line_dedup", "op4_line_dedup_runs"])
def test_line_dedup_twins(spark, name):
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    got = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    want = c.sql(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r["n_removed"] for r in got) > 0


@pytest.mark.parametrize("least", [1, 7, 50])
def test_substring_dedup(spark, corpus, least):
    rows = [(d, WORD.findall(t)) for d, t in corpus]
    if least == 1:
        rows = rows[:12]
    want, whole = {}, {}
    starts = defaultdict(set)  # (length, words) -> ids; one row of each word sequence has windows
    lengths = [least * 2**k for k in range(12)]
    once = {}
    for d, w in rows:
        once.setdefault(tuple(w), d)
    for w, d in once.items():
        for n in [*lengths, *(n + least - 1 for n in lengths)]:
            for i in range(len(w) - n + 1):
                starts[w[i : i + n]].add(d)
    for d, w in rows:
        keep = [True] * len(w)
        w = tuple(w)
        if len(w) >= least and once[w] < d:
            want[d] = (len(w), len(w), sha(""), len(w))
            continue
        for i in range(len(w) - least + 1):
            if min(starts[w[i : i + least]]) < d:
                keep[i : i + least] = [False] * least
        shared = [n for n in lengths for i in range(len(w) - n + 1) if len(starts[w[i : i + n]]) > 1]
        sure = [n for n in lengths for i in range(len(w) - n - least + 2) if len(starts[w[i : i + n + least - 1]]) > 1]
        want[d] = (len(w), keep.count(False), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k)), {0, *shared} if least in shared else {0}, max([*sure, *[least] * (least in shared)], default=0))
    df = spark.createDataFrame([r for r in corpus if r[0] in want], DOCS)
    got = {r[0]: tuple(r[1:]) for r in substring_dedup(df, least=least).collect()}
    assert {d: v[:3] for d, v in got.items()} == {d: v[:3] for d, v in want.items()} and sum(v[1] for v in want.values()) > 100
    for d, v in want.items():
        assert got[d][3] == v[3] if len(v) == 4 else got[d][3] in v[3] and got[d][3] >= v[4]
    if least == 50:
        assert {v[3] for v in got.values()} > {0, 50, 100}


def test_exact_dedup(spark, corpus):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for d, t in corpus:
        groups[t.translate(lower)].append(d)
    want = {d: (max(ds), len(ds), d == max(ds), sha(t)) for t, ds in groups.items() for d in ds}
    got = exact_dedup(spark.createDataFrame(corpus, DOCS), bucket_keys=4, max_depth=6).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == want
    assert len({r["bucket"] for r in got}) > 8


@pytest.mark.parametrize("bits", [0, 3])
def test_texts_of_equal_hash_are_told_apart(spark, corpus, bits):
    """With a hash of no or three bits nearly all texts collide; chains compare bytes."""
    df = spark.createDataFrame(corpus, DOCS)
    want = {r[0]: tuple(r[1:5]) for r in exact_dedup(df).collect()}
    got = exact_dedup(df, bucket_keys=4, max_depth=6, hashed=lambda c: F.shiftleft(F.xxhash64(c), 64 - bits) if bits else F.lit(0).cast("long")).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == want and max(r["chain_pos"] for r in got) > 5
    assert len({(r["bucket"], r["chain_pos"]) for r in got}) <= len({r["text_sha256"] for r in got})


def test_repeated_rows_keep_one(spark):
    rows = [(None, "a")] * 3 + [(5, "b")] * 4 + [(4, "B")] + [(6, None), (6, "")]
    got = exact_dedup(spark.createDataFrame(rows, DOCS).withColumn("ROW", F.lit(1)).withColumn("again", F.lit(2))).collect()
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted([sha("a"), sha("b"), sha("")])
    assert sorted((r["keep_id"] or 0, r["group_size"]) for r in got) == [(0, 3)] * 3 + [(5, 5)] * 5 + [(6, 2)] * 2


def test_directory_splits_only_overfull_buckets():
    counts = {i: 1 for i in range(8)} | {15: 100}
    directory = split_directory(counts, 4, 4)
    assert len(directory) == 16 and directory == sorted(directory)
    load = Counter()
    for i, n in counts.items():
        load[directory[i]] += n
    assert all(n <= 4 for b, n in load.items() if b != directory[15])
    assert split_directory(counts, 200, 4) == [0] and split_directory({0: 3, 8: 3}, 4, 4) == [0, 1]
    assert split_directory({0: 3, 1: 3, 4: 3}, 4, 3) == [0, 1, 2, 2, 3, 3, 3, 3]


def brute_jaccard(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links, parent = Counter(), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n >= threshold * len(sets[a] | sets[b]) - 1e-9:  # texts without words are copies
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (root(d), links[d]) for d in ids}


@pytest.mark.parametrize("size", [600, 5])
def test_jaccard_join(spark, corpus, size):
    """Also with units so small that components are cut into chunks."""
    rng = random.Random(1)
    base = [f"v{i}" for i in range(120)]
    hot = [(1000 + k, " ".join(base[:j] + [f"x{k}"] + base[j:])) for k, j in enumerate(rng.randrange(120) for _ in range(40))]
    rows = corpus + hot
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(spark.createDataFrame(rows, DOCS), unit_sets=size).collect()}
    assert got == brute_jaccard(rows) and max(n for _, n in got.values()) > 30


@pytest.mark.parametrize("grams", [150])
def test_links_are_counted_once(spark, grams):
    """Two near copies in more chunks than nodes: units of two chunks can hold one alone."""
    for k in range(4):  # chunks are dealt by hash; some of these share one
        w = [f"g{k}x{i}" for i in range(120)]
        rows = [(1, " ".join(w)), (2, " ".join([*w, "end"]))]
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(spark.createDataFrame(rows, DOCS), unit_grams=grams).collect()}
        assert got == {1: (1, 1), 2: (1, 1)}


def test_sets_of_one_name_are_told_apart(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS)
    want = {tuple(r) for r in jaccard_join(df).collect()}
    assert {tuple(r) for r in jaccard_join(df, node_bits=3).collect()} == want


def test_jaccard_join_of_repeated_rows(spark):
    """Repeated rows and null ids: every row counts, whatever id it has."""
    w = [f"g{i}" for i in range(60)]
    rows = [(None, " ".join([*w, f"n{k}"])) for k in range(4)] + [(None, " ".join(w))] * 3 + [(7, " ".join(w))] * 2 + [(7, "other words in this text of one id"), (8, " ".join(w) + "  ")]
    got = jaccard_join(spark.createDataFrame(rows, DOCS).withColumn("NODE", F.lit(1)).withColumn("bands", F.lit(2))).collect()
    assert len(got) == len(rows) and sorted((r["class_id"], r["class_size"], r["n_links"]) for r in got) == [(7, 1, 0)] + [(7, 10, 9)] * 10


def test_pruning_keeps_likely_pairs():
    for n, m in least_matches(0.8, 1e-6, 14):
        assert m <= 0.8 * n


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(100, 100), (7, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert all(got[i] == (0 if i <= 30 else 31) for i in range(61)) and 100 not in got


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 50, 40)
    for n in (1, 2, 5, 7, 16, 26):
        assert _sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(40 - n + 1)]


ODD = [(1, None), (None, "a b c d e f"), (None, "a b c d e f"), (2, ""), (3, "x"), (3, "x"), (4, "A B c d e f")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumn("h", F.lit(1)).withColumn("key", F.lit("k")).withColumn("digest", F.lit(0)).withColumn("n_lines", F.lit(9)).withColumn("cut", F.lit(0)).withColumn("norm", F.lit("")).withColumn("id", F.lit(7))
    exact = [tuple(r[:4]) for r in exact_dedup(df).collect()]
    assert sorted(exact, key=str) == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (3, 3, 2, False), (None, 4, 3, False), (None, 4, 3, False), (4, 4, 3, True)], key=str)
    lines = line_dedup(df).collect()
    assert len(lines) == 7 and all(r["n_removed"] == 0 for r in lines) and sum(r["text"] is None for r in lines) == 1
    assert sum(r["n_removed"] for r in substring_dedup(df).collect()) == 0
    near = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join(df).collect()), key=str)
    assert near == sorted([(1, 1, 1), (2, 1, 1), (3, 3, 1), (3, 3, 1), (4, 4, 0), (None, None, 1), (None, None, 1)], key=str)


def test_null_ids_come_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(spark.createDataFrame([(None, text), (5, text + " tail")], DOCS)).collect()}
    assert got == {None: 0, 5: 60}


def test_substrings_of_repeated_rows(spark):
    """Repeated ids and rows, and many null ids, are judged row by row and meet no row but their own."""
    p = [f"w{i}" for i in range(130)]
    rows = [(None, " ".join([*p[:110], f"n{k}"])) for k in range(6)] + [(None, " ".join(p[5:120]))] * 3
    rows += [(4, " ".join([*p, "x"]))] * 3 + [(4, " ".join(["y", *p[:60]])), (9, "a " + " ".join(p[40:100]))]
    got = sorted(substring_dedup(spark.createDataFrame(rows, DOCS).withColumn("T", F.lit(1))).collect(), key=str)
    removed = sorted((r["n_words"], r["n_removed"], r["longest_repeat"]) for r in got if r["doc_id"] is not None)
    assert removed == [(61, 60, 50), (61, 60, 50), (131, 120, 100), (131, 120, 100), (131, 120, 100)]
    assert len(got) == len(rows) and all(r["n_removed"] == 0 and r["longest_repeat"] in (50, 100) for r in got if r["doc_id"] is None)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for op in (exact_dedup, line_dedup, substring_dedup, jaccard_join):
        assert op(empty).count() == 0
