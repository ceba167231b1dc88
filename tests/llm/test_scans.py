"""License scan, importance resampling and embedding whitening against plain Python and NumPy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm.coded_words import CodedWords, slices
from gridspark.llm.importance import importance_resample
from gridspark.llm.license_scan import PHRASES, TEMPLATES, LicenseIndex, Template, license_scan, words_of
from gridspark.llm.queries import op11_license_scan, op12_importance_resampling, op13_embedding_whitening
from gridspark.llm.whitening import _triangle, bidiagonalize, dqds, principal_directions, twisted_vector, whiten_embeddings

RNG = random.Random(5)
DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


ODD = ["", None, " ", "Été_über\x00x2 ÀB", "mit", "MIT License", "the mit license, mit\nlicense", "a" * 300, "word " * 60_000 + "released under the mit license", "x\U0001f600y Apache-License"]


def test_coded_words():
    w = CodedWords(pa.array(ODD, pa.string()))
    names = w.words.to_pylist()
    assert [[names[c] for c in w.codes[a:b]] for a, b in zip(w.bounds, w.bounds[1:], strict=False)] == [plain_words(t) for t in ODD]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(ODD, pa.string())})
    assert [len(CodedWords(pa.array([], pa.string())).codes), sum(p.num_rows for p in slices(batch, most=40))] == [0, len(ODD)]
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 40 for p in slices(batch, most=40))


# ---- licence scan


def band_lcs(a, b, start, width):
    """Longest common subsequence of ``a`` and ``b`` whose matched places differ by start to start + width - 1."""
    best = {}

    def go(i, j):
        if i < 0 or j < 0:
            return 0
        if (i, j) not in best:
            best[i, j] = max(go(i - 1, j), go(i, j - 1), go(i - 1, j - 1) + 1 if a[i] == b[j] and 0 <= j - i - start < width else 0)
        return best[i, j]

    lo, hi = max(start, 0), min(start + len(a) + width, len(b))
    b = b[:hi]
    return go(len(a) - 1, hi - 1) if lo < hi else 0


def brute_labels(text, templates, cover=0.8, step=4):
    words, out = plain_words(text), set()
    for t in templates:
        tw = plain_words(t.text)
        need = math.ceil(cover * len(tw) - 1e-9)
        for start in range(-len(tw) // step * step - step, len(words), step):
            a, b = max(start, 0), min(start + len(tw) + 2 * step - 1, len(words))
            region = " " + " ".join(words[a:b]) + " "
            if all(f" {' '.join(plain_words(k))} " in region for k in t.keys) and band_lcs(tw, words, start, 2 * step) >= need:
                out.add(t.label)
    return out


def mutated(text, rate):
    out = []
    for w in plain_words(text):
        r = RNG.random()
        out += [] if r < rate else [RNG.choice(["under", "noise", "the"]), w] if r < 2 * rate else [w]
    return " ".join(out)


def base_of(text):
    words, places, labels = plain_words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return words, places, labels


def test_license_scan_equals_brute_force(spark):
    short = [t for t in TEMPLATES if len(plain_words(t.text)) <= 16]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "mit"), (4, "mit"), (None, "General Public License, twice: general PUBLIC license")]
    for i in range(70):
        a, b = RNG.choice(short), RNG.choice(short)
        pad = " ".join(RNG.choice(["the", "license", "version", "work", "under", "cc", "2", "x"]) for _ in range(RNG.randint(0, 12)))
        rows.append((100 + i, f"{pad} {mutated(a.text, 0.05 * (i % 4))} {pad} {mutated(b.text, 0.04 * (i % 3))} {pad}"))
    docs = spark.createDataFrame(rows, DOCS).withColumn("N_Words", F.lit(7)).withColumn("number", F.lit("x")).repartition(3)
    got = license_scan(docs, templates=short).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, text in rows:
        words, places, base = base_of(text)
        own = brute_labels(text, short) if text is None or len(text) < 5000 else {"mit"}
        want[d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got) == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert any(r["labels"] and not r["base_labels"] for r in got)
    for r in got:
        for x in r["regions"]:
            assert 0 <= x["first_word"] < x["end_word"] <= r["n_words"] and 0.8 <= x["coverage"] <= 1
    assert license_scan(docs.limit(0)).count() == 0


def test_long_templates_and_missing_key_phrases(spark):
    mit = next(t for t in TEMPLATES if t.label == "mit" and len(t.text) > 200)
    words = plain_words(mit.text)
    wrapped = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    fewer = " ".join(w for i, w in enumerate(words) if i % 8)  # still over 80 %, but the phrases are broken or not
    half = " ".join(words[: len(words) // 2])
    rows = [(1, wrapped), (2, half), (3, " ".join(words).replace("without restriction", "")), (4, "intro " * 500 + wrapped + " outro" * 500 + "\n" + wrapped), (5, fewer)]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: r["labels"] for d, r in got.items()} == {1: "mit", 2: "", 3: "", 4: "mit", 5: ",".join(sorted(brute_labels(fewer, [mit])))}
    assert [round(x["coverage"], 6) for x in got[4]["regions"]] == [1.0, 1.0] and abs(got[4]["regions"][0]["first_word"] - 500) <= 4


def test_index_holds_the_rarest_words_only():
    t = Template("own", "common common rare words here stand one two three four")
    vocabulary = sorted(set(words_of(t.text)))
    idf = np.array([0.1 if w in ("common", "here") else 3.0 for w in vocabulary])
    index = LicenseIndex([t], vocabulary, idf)
    assert len(index.template) == 10 - 8 + 2 and not {"common", "here"} & {words_of(t.text)[i] for i in index.position}


def test_license_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op11_license_scan(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        words, places, base = base_of(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert base <= set(g["labels"].split(",")) | {""} or not base


# ---- importance resampling


def brute_resample(rows, target, n=1, buckets=10_000, percent=10, least=20):
    def bucket_list(text):
        w = plain_words(text)
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    feats = [(d, *bucket_list(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in feats for b in f), Counter(b for x in target for b in bucket_list(x)[1])
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
    out = []
    for d, w, f in feats:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_equals_brute_force(spark, n):
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "b2"]
    rows = [(i, " ".join(RNG.choice(vocabulary) for _ in range(RNG.choice([0, 5, 19, 20, 21, 60])))) for i in range(300)]
    rows += [(i, t) for i, t in enumerate(ODD)] + [(7, rows[7][1])] * 40 + [(None, "w1 " * 30)] * 25 + [(None, None)]
    target = [" ".join(RNG.choice(vocabulary[:9]) for _ in range(50)), None, "", "w1 w2"]
    docs = spark.createDataFrame(rows, DOCS).withColumn("Score", F.lit(1)).withColumn("bucket", F.lit(2)).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string").withColumn("N", F.lit(1))
    got = importance_resample(docs, goal, ngram=n, percent=37)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, target, n, percent=37)
    assert importance_resample(docs.limit(0), goal, ngram=n).count() == 0
    assert importance_resample(docs, goal.limit(0), ngram=n).count() == len(rows)


def test_resampling_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert Counter(map(tuple, op12_importance_resampling(spark, SF).collect())) == brute_resample(rows, target)


# ---- whitening


def test_singular_values_and_vectors():
    rng = np.random.default_rng(3)
    cases = [rng.standard_normal((30, n)) * 10.0 ** rng.uniform(-6, 6, n) for n in (1, 2, 3, 8, 40)]
    cases += [np.eye(6), np.diag([3.0, 3.0, 3.0, 1.0]), np.zeros((4, 4)), np.ones((5, 5)), np.diag([2.0, 0.0, 1.0])]
    cases += [np.vstack([np.diag([5.0, 5.0 + 1e-9, 1.0, 1.0]), np.zeros((2, 4))]), np.linalg.qr(rng.standard_normal((20, 20)))[0] @ np.diag([1 + 1e-14 * i for i in range(20)])]
    for x in cases:
        r = _triangle(iter([x]), x.shape[1])
        a, b, _ = bidiagonalize(r)
        want = np.append(np.linalg.svd(x, compute_uv=False), np.zeros(max(x.shape[1] - len(x), 0)))
        assert np.allclose(np.sqrt(dqds(a, b)), want, rtol=1e-9, atol=1e-13 * max(want.max(), 1))
        values, v, total = principal_directions(r, 4)
        k = len(values)
        assert k == min(4, int((want > 1e-12 * want.max()).sum())) and np.isclose(total, (want**2).sum())
        assert np.abs(v.T @ v - np.eye(k)).max(initial=0) < 1e-11
        assert np.abs(x.T @ (x @ v) - v * values).max(initial=0) <= 1e-11 * max(want.max() ** 2, 1e-300)
    a, b = np.array([3.0, 2.0, 1.0]), np.array([0.5, 0.25])
    t = np.diag(a) + np.diag(b, 1)
    z = twisted_vector(a, b, np.linalg.svd(t, compute_uv=False)[0] ** 2)
    assert np.allclose(np.abs(z), np.abs(np.linalg.svd(t)[2][0]), atol=1e-12)


def brute_whiten(rows, k=4):
    good = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in e)) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = np.array(sorted({x for _, x in good}), float)
    n, s = len(fit), fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    whole = [int(c) for c in s]
    return [(i, n, sum((n * int(a) - b) ** 2 for a, b in zip(x, whole, strict=True)), (np.array(x) - s / n) @ v / np.sqrt(e), e / np.trace(cov)) for i, x in good]


def check_whitened(got, rows, k=4):
    want = sorted(brute_whiten(rows, k), key=lambda r: (r[0] is None, r[0], r[2]))
    by = {}
    for r in sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"], r["deviation"], r["component"])):
        by.setdefault((r["vec_id"], int(r["deviation"])), []).append(r)
    flat = [r for rs in by.values() for r in rs]
    assert len(got) == k * len(want) and {(i, d) for i, _, d, *_ in want} == set(by)
    sign = None
    for i, n, d, w, share in want:
        one = by[i, d][:: max(len(by[i, d]) // k, 1)]
        assert [r["component"] for r in one] == list(range(1, k + 1)) and {r["n"] for r in one} == {n}
        own = np.array([r["whitened"] for r in one])
        sign = np.sign(own * w) if sign is None or (sign == 0).any() else sign
        assert np.allclose(own, sign * w, atol=1e-8) and np.allclose([r["explained"] for r in one], share, rtol=1e-9)
    assert len({r["identity_error"] for r in flat}) == 1 and flat[0]["identity_error"] < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((200, 6)) * [5, 3, 2, 1, 0.4, 0.1] + [1, 0, 0, 9, 0, 0]).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(base)] + [(1000 + i, [float(c) for c in base[0]]) for i in range(150)]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf"), *[0.0] * 5]), (905, [1.0, 2.0])]
    rows.append((None, [0.5] * 6))
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("X", F.lit(1)).withColumn("Component", F.lit(2)).withColumn("n", F.lit(3))
    for parts in (1, 7, 40):
        check_whitened(whiten_embeddings(table.repartition(parts)).collect(), rows)
    one = table.where("vec_id >= 1000")
    assert whiten_embeddings(one).count() == 0 and whiten_embeddings(table.limit(0)).count() == 0
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whiten_embeddings(flat).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")
    assert whiten_embeddings(huge).count() >= 3


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(op13_embedding_whitening(spark, SF).collect(), rows)


# ---- decontamination: parts of items


def test_partial_leaks_are_found(spark):
    """Stretches of 55 or more characters of an item always hold a whole passage; clean texts stay."""
    from gridspark.llm.decontaminate import decontaminate, drop_leaks

    item = " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(3, 8))) for _ in range(60))
    prose = lambda: " ".join("".join(RNG.choice("klmnopqrst") for _ in range(RNG.randint(3, 8))) for _ in range(40))
    rows = []
    for n in (55, 60, 75, 90, 110, 142, 200):
        for _ in range(5):
            a = RNG.randrange(len(item) - n)
            rows.append((len(rows), f"{prose()} {item[a : a + n]} {prose()}"))
    leaking = len(rows)
    rows += [(leaking + i, prose()) for i in range(20)] + [(None, None), (None, item), (leaking, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("N", F.array(F.lit(1))).repartition(3)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "unseen words of another item that nobody copied anywhere")], "item_id long, text string")
    for block in (4_000_000, 100):
        assert {r["doc_id"] for r in decontaminate(docs, bench, block_chars=block).collect()} == {*range(leaking), None}
        left = drop_leaks(docs, bench, block_chars=block)
        assert left.schema == docs.schema
        assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(rows[leaking : leaking + 21] + rows[-1:])
    assert drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_near_duplicate_rows_of_files_and_of_frames(spark, tmp_path):
    """Row numbers from files and written ones drop the same rows; few and many dropped rows do, too."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(i % 7 if i % 5 else None, f"text {i % 6} " * 9, "en", "s", 3) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    assert "pipeline_file" not in P._numbered(stored).columns and P._numbered(stored).select(P.ROW).distinct().count() == 60
    shown = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    whole = shown(P.drop_near_duplicates(spark, stored, ""))
    assert len(whole) == 6 == sum(whole.values()) and whole == shown(P.drop_near_duplicates(spark, stored.where("n_chars = 3"), ""))
    before, P.SENT_ROWS = P.SENT_ROWS, 0
    try:
        assert shown(P.drop_near_duplicates(spark, stored, "")) == whole
    finally:
        P.SENT_ROWS = before
