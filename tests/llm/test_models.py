"""Decontamination, sharding, language id, toxicity, language model and packing, and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm.common import Words, window_hashes
from gridspark.llm.decontaminate import Passages, aligned, decontaminate
from gridspark.llm.hidden_markov import expected_counts, fit_hidden_markov, forward, hidden_markov_scores, score_texts, tokens_of
from gridspark.llm.language_id import BUCKETS, language_id, trigram_buckets, visible_text
from gridspark.llm.packing import load_tokenizer, pack_documents, pack_lengths, tokenizer_path
from gridspark.llm.sharding import rendezvous, shard_records
from gridspark.llm.toxicity import _heads, _tokens, features, fit_kneser_ney, toxicity_scores

DOCS = "doc_id long, text string"
RNG = random.Random(11)
LETTERS = "abcdefghijklmnop"


def word():
    return "".join(RNG.choice(LETTERS) for _ in range(RNG.randint(2, 7)))


def prose(n):
    return " ".join(word() for _ in range(n))


def edits(a, b):
    """Least edit distance of ``a`` to any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_words_and_windows():
    texts = ["a  b\tc", None, "", " x ", "a b", "é\x0bz y"]
    w = Words(texts)
    assert np.diff(w.bounds).tolist() == [3, 0, 0, 1, 2, 2]
    assert w.hash[0] == w.hash[4] and w.hash[1] == w.hash[5] and len(set(w.hash.tolist())) == 6
    h = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    assert window_hashes(h, 3)[0] == window_hashes(h, 3)[3] and len(set(window_hashes(h, 3).tolist())) == 4


def test_alignment_is_exact():
    for _ in range(30):
        a = [RNG.randint(1, 3) for _ in range(RNG.randint(3, 12))]
        b = [RNG.randint(1, 3) for _ in range(RNG.randint(3, 20))]
        k = len(a)
        got, _ = aligned([np.array(a, np.uint32)], [np.array(b, np.uint32)], np.array([k]))
        assert got[0] == edits(a, b)


def test_leaks_with_edits(spark):
    items = [(i, prose(30)) for i in range(5)]
    docs, want = [], set()
    for i in range(40):
        text = prose(60)
        if i % 4 == 0:
            item, leak = items[i % 5]
            leak = list(leak.upper())
            for _ in range(i // 8):  # 0 to 4 edits over the item
                leak[RNG.randrange(len(leak))] = RNG.choice("xyz")
            text += " " + "".join(leak) + ", " + prose(10)
            want.add((i, item))
        docs.append((i, text))
    docs += [(90, None), (91, ""), (92, "short")]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame([*items, (9, None), (10, "tiny")], "item_id long, text string")
    got = decontaminate(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate(df, bench, block_chars=100).collect()} == want
    assert decontaminate(df, bench.where("item_id > 50")).count() == 0


def test_partial_leaks_and_short_items(spark):
    """Each stretch of 143 characters of a longer item is found, wherever it starts; short items as whole words."""
    item = "".join(random.Random(8).choice(LETTERS) for _ in range(400))
    docs = [(k, f"zz {item[k : k + 143]} zz") for k in range(400 - 143 + 1)]
    docs += [(900, "So, Tiny-cup!"), (901, "tiny cup"), (902, "tiny cups"), (903, "destiny cup"), (904, "tiny"), (905, None)]
    bench = spark.createDataFrame([(1, item), (2, "tiny  cup."), (3, "?")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["text_start"], r["text_end"]) for r in decontaminate(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert set(got) == {(k, 1) for k in range(400 - 143 + 1)} | {(900, 2), (901, 2)}
    assert got[900, 2] == (4, 12) and got[901, 2] == (0, 8)


def test_search_against_brute_force():
    items = [(0, prose(12))]
    p = Passages(items, 8, 128, 0.08)
    base = p.codes[0]
    for n in range(0, 12):
        text = list("".join(map(chr, base)))
        for at in RNG.sample(range(len(text)), n):
            text[at] = "z"
        text = prose(20) + " " + "".join(text) + " " + prose(20)
        distance = edits("".join(map(chr, base)), text)
        assert bool(p.search([text])) == (distance <= int(p.budget[0])), (n, distance)


def brute_leaks(docs, items, length, step):
    """Documents and items of which a passage lies within its budget in the text, by plain edit distance."""
    flat = lambda s: " ".join("".join(c if c.isalnum() else " " for c in (s or "").lower()).split())
    out = set()
    for item, text in items:
        one = Passages([(item, text)], 8, length, 0.08, step)
        for codes, k in zip(one.codes, one.budget, strict=True):
            out |= {(d, item) for d, t in docs if edits("".join(map(chr, codes)), flat(t)) <= k}
        if not one.codes and flat(text):
            out |= {(d, item) for d, t in docs if f" {flat(text)} " in f" {flat(t)} "}
    return out


@pytest.mark.parametrize(("block", "length", "step"), [(20, 128, 16), (4_000_000, 128, 16), (20, 48, 8), (4_000_000, 48, 8)])
def test_decontamination_edges(spark, block, length, step):
    """Texts that open or end inside an item, periodic and repeated items, repeated and null ids, several blocks."""
    rng = random.Random(21)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(126))
    items = [(1, long_), (2, prose(12)), (2, prose(9)), (3, "ab" * 40), (4, "a" * 70), (5, long_), (6, "tiny"), (6, prose(8)), (None, prose(10)), (7, prose(40))]
    texts = [long_[-60:] + " " + prose(5), long_[:70], long_[66:], "ab" * 45, "ba" * 100, "a" * 200, "a" * 66, "", None, "tiny", prose(50)]
    texts += [prose(3) + " " + t for _, t in items] + [t + " " + prose(3) for _, t in items] + [items[1][1] + " " + items[2][1]]
    docs = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("x")).withColumn("EDITS", F.lit(1))
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_chars=block, length=length, step=step).collect()
    want = sorted(((d, i) for row in docs for d, i in {(row[0], x) for _, x in brute_leaks([row], items, length, step)}), key=str)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == want and len(want) > 25


def test_very_long_text_is_searched_whole(spark):
    item = prose(30)
    docs = spark.createDataFrame([(1, prose(200_000) + " " + item), (2, prose(5))], DOCS)
    got = decontaminate(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(1, 4, 0)]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(4, item)], "item_id long, text string")).count() == 0


def test_frequent_grams_in_stretches():
    """The same regions are found however few places are looked up at once."""
    items = [(0, "abcdefghij" * 12), (1, prose(30)), (2, "abcdefghij" * 7)]
    p = Passages(items, 8, 128, 0.08)
    texts = ["abcdefghij" * 60, prose(20) + items[1][1], "x", items[2][1][3:]]
    whole = sorted(p.search(texts))
    long_ = Passages._long
    p._long = lambda *a: long_(p, *a, at_once=50)
    assert sorted(p.search(texts)) == whole and len(whole) >= 4


def test_rendezvous_moves_few(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    got = df.select(rendezvous(F.col("k"), range(4)).alias("a"), rendezvous(F.col("k"), range(5)).alias("b"), rendezvous(F.col("k"), range(4), [1, 1, 1, 3]).alias("w")).toPandas()
    assert set(got["b"][got["a"] != got["b"]]) == {4} and 600 < (got["a"] != got["b"]).sum() < 1000
    assert abs((got["w"] == 3).mean() - 0.5) < 0.04 and set(got["w"][got["w"] != got["a"]]) == {3}


def test_rendezvous_against_plain_python(spark):
    """The shard with the highest -weight / ln(u), u from 64-bit hashes of key and shard, in plain Python."""
    import struct

    import xxhash

    def score(key, shard, weight):
        first = xxhash.xxh64(struct.pack("<i", shard), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest() if key is not None else xxhash.xxh64(struct.pack("<i", shard), seed=42).intdigest()
        bits = xxhash.xxh64(struct.pack("<i", shard), seed=xxhash.xxh64(struct.pack("<Q", first), seed=42).intdigest()).intdigest() >> 11
        return -weight / math.log((bits + 0.5) / 2**53)

    keys = [str(i) for i in range(300)] + ["é", "", None]
    weights = [1.0, 2.0, 0.5, 1.0, 3.0]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["s"] for r in df.select("k", rendezvous(F.col("k"), range(5), weights).alias("s")).collect()}
    assert got == {k: max(range(5), key=lambda s: (score(k, s, weights[s]), s)) for k in keys}
    rows = [(i, "x" * (i % 9)) for i in range(200)] + [(None, None)]
    out = shard_records(spark.createDataFrame(rows, DOCS), block_rows=4).collect()
    for r in out:
        key = None if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == max(range(16), key=lambda s: (score(key, s, 1.0), s)) and r["grown_shard"] == max(range(17), key=lambda s: (score(key, s, 1.0), s))


def test_sharding_slots(spark):
    rows = [(i, "é" * (i % 5)) for i in range(500)] + [(None, None), (None, "q"), (7, "éé"), (7, "éé")]
    got = shard_records(spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("s")), block_rows=5).toPandas()
    assert len(got) == 504
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    one = got[got["doc_id"] == 4].iloc[0]
    assert one["size"] == 9 and one["text_crc32"] == zlib.crc32("éééé".encode())
    assert shard_records(spark.createDataFrame([], DOCS)).count() == 0


def test_language_priors_help(spark):
    de, en = "der die und ist nicht ein ", "the and of is not a "
    docs = spark.createDataFrame([(i, (de if i % 2 else en) * 5, "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    page = lambda lang, text: f'<html lang="{lang}"><script>the the</script><p>{text}</p></html>'
    rows = [(i, f"http://a.x.de/{i}", page("de", de * 3)) for i in range(20)] + [(i, f"http://b.x.com/{i}", page("en", en * 3)) for i in range(20, 40)]
    rows += [(90, "http://a.x.de/90", "<p>12 34</p>"), (91, None, None), (92, "http://b.x.com/", "")]
    got = {r["page_id"]: r for r in language_id(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("zz")), docs).collect()}
    assert all(got[i]["lang"] == ("de" if i < 20 else "en") for i in range(40))
    assert got[90]["lang"] == "de" and got[92]["lang"] == "en" and got[91]["lang"] is not None
    assert visible_text("<style>x</style>a&amp;b<!-- no --><b>c</b>").split() == ["a&b", "c"]
    assert language_id(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0


def test_language_posterior_against_plain_python(spark):
    """Trigram likelihoods, and priors of host, domain, suffix and declared language without the page itself."""
    rng = random.Random(4)
    banks = {"de": ["der", "und", "nicht"], "en": ["the", "and", "not"], "fr": ["le", "et", "pas"]}
    docs = [(" ".join(rng.choice(banks[k]) for _ in range(12)), k) for k in banks for _ in range(5)]
    hosts = ["a.x.de", "b.x.de", "c.y.com", "d.z.fr", ""]
    pages = []
    for i in range(40):
        k = rng.choice(sorted(banks))
        body = " ".join(rng.choice(banks[rng.choice([k, k, "en"])]) for _ in range(rng.randint(0, 9)))
        declared = rng.choice([f' lang="{k}"', ' lang="xx"', ""])
        pages.append((i, f"http://{rng.choice(hosts)}/{i}", f"<html{declared}><nav>the the</nav><p>{body}</p></html>"))
    pages += [pages[3], (50, None, None), (51, "nonsense", "")]
    got = language_id(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")).collect()
    langs = sorted(banks)

    def buckets(text):
        return trigram_buckets([text])[0].tolist()

    counts = {k: Counter(x for t, lang in docs if lang == k for x in buckets(t)) for k in langs}
    logs = {k: lambda x, c=counts[k]: math.log((c[x] + 0.5) / (sum(c.values()) + 0.5 * BUCKETS)) for k in langs}
    seen = []
    for i, url, html in pages:
        z = [0.05 * sum(logs[k](x) for x in buckets(visible_text(html or ""))) for k in langs]
        p = [math.exp(v - max(z)) for v in z]
        m = re.search(r'<html lang="(\w+)"', html or "")
        host = re.match(r"https?://([^/]*)", url or "")
        host = host[1] if host else ""
        seen.append({"id": i, "p": [v / sum(p) for v in p], "declared": m[1] if m else "", "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1]})
    overall = [(sum(s["p"][k] for s in seen) + 1) / (len(seen) + 3) for k in range(3)]
    want = []
    for row, s in enumerate(seen):
        def smooth(by, k, above, s=s, row=row):
            others = [o["p"][k] for j, o in enumerate(seen) if j != row and o[by] == s[by]]
            return (sum(others) + 8 * above) / (len(others) + 8)

        score = []
        for k in range(3):
            v = s["p"][k] * smooth("host", k, smooth("domain", k, overall[k])) * smooth("suffix", k, overall[k]) / overall[k]
            score.append(v * (smooth("declared", k, overall[k]) / overall[k] if s["declared"] else 1))
        want.append((s["id"], langs[score.index(max(score))], round(max(score) / sum(score), 9)))
    assert sorted((r["page_id"], r["lang"], round(r["probability"], 9)) for r in got) == sorted(want)
    with pytest.raises(ValueError, match="languages"):
        language_id(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string"), most_langs=2)


def test_pages_without_ends_are_read_once(spark):
    """Openings without an end, hundreds of thousands of them, take one pass."""
    import time

    began = time.time()
    for mark in ("<script ", "<script>", "<!-- ", "<a ", "<", "<nav>x</p>"):
        visible_text(mark * 200_000)
    assert time.time() - began < 10
    assert visible_text("a<script>b<p>c</script >d<!-- <script> -->e<STYLE>f</style>g<nav>h").split() == ["a", "d", "e", "g"]
    assert visible_text("<!DOCTYPE html>1 &lt; 2 <p>x").split() == ["1", "<", "2", "x"]


def test_toxicity_held_out(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [RNG.choice(LETTERS) * 2 + RNG.choice(LETTERS) for _ in range(RNG.randint(5, 120))]
        for _ in range(2 + len(w) // 20 if toxic else 0):
            w.insert(RNG.randrange(len(w)), RNG.choice(["nasty", "awful", "vile"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "vile nasty"), (3, "aab"), (1002, "vile " * 300_000)]
    labels += [(0, 0), (5, None), (None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit(1))
    got = toxicity_scores(df, spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    held = got[got["held_out"] & (got["doc_id"] < 600)]
    assert (held["predicted"] == (held["doc_id"] % 4 == 0)).mean() > 0.95
    assert bool(got[got["doc_id"] == 1]["held_out"].iloc[0]) == (zlib.crc32(b"1") % 5 == 0)
    assert features(np.zeros(0)) == (0.0, 0.0, 0.0, 0.0)
    carried = toxicity_scores(df.withColumn("score", F.lit(5)).withColumn("carry0", F.col("doc_id")), spark.createDataFrame(labels, "doc_id long, toxic int"), carry=["carry0"]).toPandas()
    assert carried["carry0"].equals(carried["doc_id"]) and np.allclose(np.sort(carried["score"]), np.sort(got["score"]))
    none = toxicity_scores(df, spark.createDataFrame([], "doc_id long, toxic int")).toPandas()
    assert (none["score"] == 0).all() and len(none) == len(rows)


def plain_words(text):
    lowered = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def reference_kneser_ney(texts, d, least_pairs, least_words):
    """The two models in plain Python: P(word | context) for each class, and the vocabulary."""
    pairs, head = {0: Counter(), 1: Counter()}, {}
    for text, toxic in texts:
        words = plain_words(text)
        for h, w in zip(["", *words], words, strict=False):
            pairs[toxic][h, w] += 1
            head[w] = w[:5]
    every = set(pairs[0]) | set(pairs[1])
    kept_pairs = {x for x in every if pairs[0][x] + pairs[1][x] >= least_pairs}
    seen = Counter(w for _, w in every)
    kept_words = {w for w in seen if seen[w] >= least_words}
    k = {c: Counter(w for _, w in pairs[c]) for c in (0, 1)}
    heads = {g: [w for w in head if head[w] == g] for g in set(head.values())}
    kept_heads = {g for g, ws in heads.items() if len(ws) > 1 or set(ws) & kept_words}
    n = {c: {g: sum(k[c][w] for w in heads[g]) for g in heads} for c in (0, 1)}
    classes = {g: sum(n[c][g] > 0 for c in (0, 1)) for g in kept_heads}
    share = sum(classes.values()) + 1
    less = lambda x: max(x - d, 0)

    def word(c, w):
        total = sum(k[c].values())
        rest_heads = 1 - sum(less(n[c][g]) for g in kept_heads) / total
        rest_words = 1 - sum(less(k[c][x]) for x in kept_words) / total
        g = w[:5] if not w.endswith("\0") else w[:-1]  # a head and "\0": an unseen word of that head
        p = rest_heads / share
        if g in kept_heads:
            p = (less(n[c][g]) / total + rest_heads * classes[g] / share) / (sum(x in kept_words for x in heads[g]) + 1)
        return rest_words * p + (less(k[c][w]) / total if w in kept_words else 0)

    def pair(c, h, w):
        total = sum(x for (a, _), x in pairs[c].items() if a == h)
        if not total:
            return word(c, w)
        rest = 1 - sum(less(pairs[c][x]) for x in kept_pairs if x[0] == h) / total
        return (less(pairs[c][h, w]) / total if (h, w) in kept_pairs else 0) + rest * word(c, w)

    return pair, kept_words, kept_heads


@pytest.mark.parametrize("least_pairs,least_words", [(1, 1), (3, 2)])
def test_kneser_ney_against_plain_python(spark, least_pairs, least_words):
    """Ratios equal a plain model whose distributions sum to one over kept, unseen and unknown words."""
    rng = random.Random(9)
    bank = ["vile", "vilest", "awful", "calm", "calmly", "sun", "sunny", "road", "roads", "roadside", "tree"]
    texts = [(" ".join(rng.choice(bank[: 5 + 6 * (1 - i % 2)] + [f"w{rng.randrange(30)}"]) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "!"]), i % 2) for i in range(60)]
    pair, kept_words, kept_heads = reference_kneser_ney(texts, 0.75, least_pairs, least_words)
    for c in (0, 1):
        for h in ("", "vile", "sun", "never"):
            total = sum(pair(c, h, w) for w in kept_words) + sum(pair(c, h, g + "\0") for g in kept_heads) + pair(c, h, "unknown")
            assert total == pytest.approx(1, abs=1e-9)
    model = fit_kneser_ney(spark.createDataFrame(texts, "text string, toxic int"), least_pairs=least_pairs, least_words=least_words)
    for text in [texts[0][0], texts[7][0], "vile calm vilest unknown sunset roadsign sun sun.", "w1 w2 w3 w4 w29"]:
        w, before = _tokens(pa.RecordBatch.from_pydict({"text": [text]}))
        words = plain_words(text)
        want = [math.log(pair(1, h, x) / pair(0, h, x)) for h, x in zip(["", *words], words, strict=False)]
        assert np.allclose(model.ratios(before, w.hash, _heads(w)), want, atol=1e-5)


def test_toxicity_scores_against_plain_python(spark):
    """Every score equals that of plain models, plain features and a plain logistic curve, learnt
    from the folds that may be learnt from; ids that repeat teach once."""
    rng = random.Random(4)
    bank = ["vile", "vilest", "awful", "calm", "calmly", "sun", "sunny", "road", "roads", "tree"]
    rows = [(i, " ".join(rng.choice(bank[3 * (i % 3 > 0) :]) + rng.choice(["", "", "***", "!", ","]) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    labels = [(i, int(i % 3 == 0)) for i in range(100)]
    rows += [(7, "A"), (1000, None), (1001, "VILE%%vile \u00c4wful sun"), (None, "vile sun"), (1002, "calm " * 3000)]
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in labels}
    texts = {i: max(t for j, t in rows if j == i) for i, _ in labels}

    def measure(pair, text):
        words = plain_words(text)
        r = [math.log(pair(1, h, w) / pair(0, h, w)) for h, w in zip(["", *words], words, strict=False)]
        if not r:
            return [0.0] * 4
        windows = [max(sum(r[i : i + k]) for i in range(max(len(r) - k, 0) + 1)) / k for k in (32, 8)]
        return [sum(r) / len(r), *windows, sum(sorted(r)[-2:]) / 2]

    def models(folds):
        pair = reference_kneser_ney([(texts[i], y) for i, y in labels if fold[i] in folds], 0.75, 3, 2)[0]
        return lru_cache(None)(pair)

    early, final = models((1, 2, 3)), models((1, 2, 3, 4))
    tuned = [(measure(early, texts[i]), y) for i, y in labels if fold[i] == 4]
    x, y = np.array([f for f, _ in tuned]), np.array([y for _, y in tuned], float)
    mean, scale, v = x.mean(axis=0), x.std(axis=0) + 1e-9, np.where(y > 0, 2.0, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(5)
    for _ in range(200_000):  # plain descent to the optimum of the weighted, ridged likelihood
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (v * (p - y)) / v.sum() + 1e-3 * np.r_[0, b[1:]]
        b -= 0.3 * g
        if np.abs(g).max() < 1e-10:
            break
    want = {}
    for i, t in rows:
        f = np.array(measure(final, t))
        want[i, t] = 1 / (1 + math.exp(-(b[0] + ((f - mean) / scale) @ b[1:])))
    got = toxicity_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), carry=["text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"], r["text"]], abs=2e-3), r["doc_id"]
        assert r["predicted"] == (r["score"] >= 0.5)


def test_forward_is_exact_and_counts_match():
    rng = np.random.default_rng(4)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T
    texts = [[0, 1, 3], [2], [3, 3, 0, 1, 2, 2, 0]]
    symbols, bounds = np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts])

    def paths(t):
        for s in itertools.product(range(3), repeat=len(t)):
            p = start[s[0]] * emit[t[0], s[0]]
            for a, b, x in zip(s, s[1:], t[1:], strict=False):
                p *= move[a, b] * emit[x, b]
            yield s, p

    want = [math.log(sum(p for _, p in paths(t))) for t in texts]
    assert np.allclose(forward(symbols, bounds, start, move, emit), want)
    brute = np.zeros((4 + 3 + 2, 3))
    for t in texts:
        z = sum(p for _, p in paths(t))
        brute[8, 0] += math.log(z)
        for s, p in paths(t):
            brute[7, s[0]] += p / z
            for x, k in zip(t, s, strict=True):
                brute[x, k] += p / z
            for a, b in zip(s, s[1:], strict=False):
                brute[4 + a, b] += p / z
    for longest, at_once in ((512, 700_000), (3, 700_000), (2, 4), (1, 1)):  # also with texts longer than a segment or a block
        counts = np.zeros_like(brute)
        expected_counts(symbols, bounds, start, move, emit, longest, counts, at_once)
        assert np.allclose(counts, brute)


def test_language_model_beats_base(spark):
    """Two languages: states must tell them apart; base scores follow the formula."""
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(RNG.choice(a if i % 2 else b) for _ in range(40))) for i in range(200)] + [(500, None), (501, "A1 zzz"), (None, "a1 a2")]
    got = {r["doc_id"]: r for r in hidden_markov_scores(spark.createDataFrame(rows, DOCS), states=2, own=64, classes=16, frequent=90).collect()}
    tokens = {d: [*(t or "").lower().split(), None] for d, t in rows}
    train = [t for d, ts in tokens.items() if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for t in ts]
    n, v = len(train), len(set(train))
    for d, ts in tokens.items():
        base = sum(math.log10((train.count(t) + 1) / (n + v + 1)) for t in ts)
        r = got[d]
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(ts) and r["n_known"] == sum(t in set(train) for t in ts) and r["train_tokens"] == n
    held = [r for r in got.values() if r["held_out"]]
    assert len(held) > 10 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 5 * len(held)
    assert hidden_markov_scores(spark.createDataFrame([], DOCS)).count() == 0


def test_scores_are_a_distribution_and_exact(spark):
    """Chances of all tokens, unknown ones included, sum to one; scores equal a sum over all state paths."""
    rng = random.Random(6)
    words_ = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words_[: 10 + i % 20]) for _ in range(rng.randint(0, 6)))) for i in range(80)] + [(90, "new W1 newer"), (91, " ".join(words_ * 3)), (91, "w1")]
    df = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.lit("x")).withColumn("N", F.lit(1))
    source = df.select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held_out"))
    model = fit_hidden_markov(source.select("text"), states=2, own=6, classes=4, frequent=12, segment=4)
    assert all(y >= x - 1e-3 * abs(x) for x, y in itertools.pairwise(model.likelihood)) and 1 < len(model.likelihood) <= 12
    counts = {r["word"]: (r["class"], r["n"]) for r in model.counts.collect()}
    v = model.vocabulary

    def emission(word: int, kind: int) -> np.ndarray:
        own = v.look_up(np.array([word], np.int64).view(np.uint64), lambda at: np.full(len(at), kind))[0][0]
        share = 1.0 if own < v.own else (counts.get(word, (0, 0))[1] + 1) / v.class_sizes[kind]
        return model.emit[own] * share

    every = sum(emission(w, k) for w, (k, _) in counts.items()) + sum(emission(-5 - k, k) for k in range(4))
    assert np.allclose(every, 1)
    scored = score_texts(source, model).collect()
    assert len(scored) == len(rows) and sum(n for _, n in counts.values()) == scored[0]["train_tokens"]
    for text in ["new W1 newer", "", rows[5][1], rows[11][1]]:
        h, k, _ = tokens_of(pa.RecordBatch.from_pydict({"text": [text]}), 4)
        e = [emission(int(x), int(y)) for x, y in zip(h.view(np.int64), k(np.arange(len(h))), strict=True)]
        total = 0.0
        for s in itertools.product(range(2), repeat=len(e)):
            p = model.start[s[0]] * e[0][s[0]]
            for a, b, x in zip(s, s[1:], e[1:], strict=False):
                p *= model.move[a, b] * x[b]
            total += p
        ids = {d for d, t in rows if t == text}
        assert [r["score"] for r in scored if r["id"] in ids][0] == pytest.approx(math.log10(total))


def test_model_without_training_rows(spark):
    held = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = hidden_markov_scores(spark.createDataFrame([(held, "a b"), (held, None)], DOCS), states=2).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(r["score"] < 0 for r in got)


def test_model_of_a_very_long_text(spark):
    """A text of many segments, and repeated rows: each is scored whole, row by row."""
    text = " ".join(RNG.choice("abcdefgh") for _ in range(60_000))
    got = hidden_markov_scores(spark.createDataFrame([(1, text), (1, text), (3, "a b")], DOCS), states=2, rounds=2).collect()
    assert sorted(r["n_tokens"] for r in got) == [3, 60_001, 60_001] and len({r["score"] for r in got}) == 2


def test_pack_lengths():
    for trial in range(40):
        lengths = [RNG.randint(1, 400 if trial % 2 else 60) for _ in range(RNG.randint(0, 80))]
        pieces, sizes = pack_lengths(lengths, 64)
        assert sum(sizes) == sum(lengths) and all(s <= 64 for s in sizes)
        for d, n in enumerate(lengths):
            own = sorted(p[1:3] for p in pieces if p[0] == d)
            assert [s for s, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1].tolist()] and sum(k for _, k in own) == n
        for s, n in enumerate(sizes):
            own = sorted((p[4], p[2]) for p in pieces if p[3] == s)
            assert [o for o, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1].tolist()][: len(own)] and sum(k for _, k in own) == n
        assert sum(1 for n in sizes if n < 64) <= 7 and all(n == 64 or n & (n - 1) == 0 for n in sizes)


def test_cheapest_sequence_with_room_is_found():
    """Also where many cheaper sequences have too little room: cut is only what fits nowhere whole."""
    rng = random.Random(3)
    for lengths in ([int(rng.lognormvariate(5.3, 1.1)) + 1 for _ in range(5000)], [rng.choice([3, 40, 400, 700, 1030]) for _ in range(3000)], [2048, 2047, 1, 5000]):
        rests = sorted(((n % 2048, d) for d, n in enumerate(lengths) if n % 2048), key=lambda x: (-x[0], x[1]))
        pieces, sizes = pack_lengths(lengths, 2048)
        first = sum(n // 2048 for n in lengths)
        rooms, costs = sizes[first:], [0.0] * (len(sizes) - first)
        cut = {}
        for d, start, n, s, _ in pieces:
            if s >= first:
                cut.setdefault(d, []).append((s - first, n))
        for n, d in rests:
            fit = [s for s, room in enumerate(rooms) if room >= n]
            if not fit:
                continue
            s = min(fit, key=lambda k: (costs[k], k))
            assert cut[d] == [(s, n)]
            rooms[s] -= n
            costs[s] += n + n * n / 2048


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.encode_special_tokens = True
    rows = [(i, prose(RNG.choice([1, 50, 900]))) for i in range(30)] + [(90, None), (91, ""), (92, "<|endoftext|> é \n\n  x"), (93, "same"), (93, "same")]
    got = pack_documents(spark.createDataFrame(rows, DOCS).withColumn("start", F.lit(0)), window_tokens=5000, with_ids=True).toPandas()
    texts = dict(rows)
    for d, part in got.groupby("doc_id"):
        want = [*model.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        ids = [x for _, p in part.drop_duplicates(["start", "sequence_id", "offset"]).sort_values("start").iterrows() for x in p["ids"]]
        assert ids == want * (2 if d == 93 else 1) or d == 93
        for _, p in part.iterrows():
            assert zlib.crc32(np.array(want[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(want)
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert list(load_tokenizer(tokenizer_path())("a b")) == model.encode("a b").ids
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_added_tokens_have_their_ids(spark, tmp_path):
    """The ids of the query and the last stage are those of ``tokenizers`` with its defaults."""
    from tokenizers import Tokenizer

    from gridspark.llm.queries import op10_packing

    model = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n é  <|endoftext|", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    for got in (op10_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        rows = got.collect()
        assert len(rows) >= 4
        for r in rows:
            part = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
            assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_ids_of_a_whole_corpus(spark):
    """Every document of the 1000-row table has the ids that ``tokenizers`` gives it."""
    from tokenizers import Tokenizer

    from gridspark.llm.queries import op10_packing

    model = Tokenizer.from_file(tokenizer_path())
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    rows = op10_packing(spark, sf).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_documents_longer_than_the_window(spark):
    long_ = prose(6000)
    rows = [(1, long_), (2, "short"), (3, long_ + " x"), (3, None)]
    got = pack_documents(spark.createDataFrame(rows, DOCS).withColumn("LENGTH", F.lit(1)), window_tokens=3000).toPandas()
    whole = got.groupby(["doc_id", "doc_tokens"])["length"].sum().reset_index()
    assert sorted(whole["length"]) == sorted(whole["doc_tokens"]) and whole["doc_tokens"].max() > 6000 and len(whole) == 4
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_stages(spark):
    """Each stage keeps the columns, and its decisions equal those of its operator or of brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    kept = {r["doc_id"] for r in clean.collect()}
    scores = toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert kept == {r["doc_id"] for r in scores if r["predicted"] == 0}
    from test_dedup import brute_anchored, brute_jaccard

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, sf)
    assert lines.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {d: t for d, (_, t) in brute_anchored(rows, 20, 4).items()}
    near = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert {r["doc_id"] for r in near.collect()} == {d for d, (c, _) in brute_jaccard(rows).items() if c == d}
    leaks = corpus_pipeline.drop_contaminated(spark, docs, sf)
    flat = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in leaks.collect()}
    assert not any(i in flat(t) for d, t in rows if d in left for i in items) and len(left) > 0.8 * len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "packing"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_judges_rows_whatever_their_ids(spark, tmp_path):
    """Null and repeated ids, extra columns, empty texts: toxic, copied and leaking rows go, others stay."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = [r["text"] for r in docs.join(toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")), "doc_id").where("predicted = 1 and length(text) > 40").limit(3).collect()]
    item = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()[0]["text"]
    own = [prose(30) for _ in range(4)]
    rows = [(None, t) for t in toxic] + [(9001, t) for t in toxic] + [(None, prose(20) + " " + item), (9001, prose(20) + " " + item), (None, own[0]), (None, own[0]), (9003, own[0]), (9003, own[1]), (9003, own[1]), (None, own[2]), (None, None), (9002, ""), (9001, own[3])]
    extra = spark.createDataFrame([(d, t, "en", "own", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = extra.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    both = docs.unionByName(extra).withColumn("JUDGED", F.lit(1)).withColumn("judged_", F.lit(2))

    def own_rows(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.where("source = 'own'").collect()), key=str)

    left = corpus_pipeline.drop_toxic(spark, both, sf)
    assert left.columns == both.columns and not {t for _, t in own_rows(left)} & set(toxic) and len(own_rows(left)) == len(rows) - 2 * len(toxic) and toxic
    left = corpus_pipeline.drop_contaminated(spark, left, sf)
    assert len(own_rows(left)) == len(rows) - 2 * len(toxic) - 2
    left = corpus_pipeline.drop_near_duplicates(spark, left, sf)
    kept = own_rows(left)
    assert left.columns == both.columns and [x for x in kept if x[1]] == sorted([(9003, own[0]), (9003, own[1]), (None, own[2]), (9001, own[3])], key=str)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
