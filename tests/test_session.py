"""Phrase index, retrieval as of a position, as-of sums."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridspark.operators import retrieval as R
from gridspark.operators import session as G
from gridspark.operators.asof import sum_before
from gridspark.sources.scratch import written

RNG = random.Random(2)
CHARS = "abc "


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CHARS)], "cell_idx int, ch string")


def suffixes(context):
    w = context.split(" ")
    return [s for s in dict.fromkeys(" ".join(w[i:]) for i in range(len(w))) if s]


def brute_matches(context, bank, top_k):
    """(rank order of) best match of each phrase: ``bank`` has (order key, text, weight)."""
    out = []
    for key, text, weight in bank:
        best = None
        for s in suffixes(context):
            for start in range(len(text)):
                if text.startswith(s, start) and (start == 0 or text[start - 1] == " ") and start + len(s) < len(text) and text[start + len(s)] in CHARS:
                    score = weight * (1 + len(s)) * (2 if start == 0 and s == context else 1)
                    if best is None or score > best[0]:
                        best = (score, len(s), text[start + len(s)])
        if best:
            out.append((*best, key))
    out.sort(key=lambda m: (-m[1], -m[0], m[3]))
    return out[:top_k]


def text_of(n):
    return " ".join("".join(RNG.choice("abcd'") for _ in range(RNG.randint(1, 3))) for _ in range(n))


def test_matches_equal_brute_force(spark, cells):
    """Repeated words, characters off the grid, ties, a list shorter than what matches."""
    bank = [(i, text_of(RNG.randint(1, 5)), float(RNG.randint(1, 4))) for i in range(120)]
    bank += [(200 + i, "ab ab' ab c", 2.0) for i in range(6)] + [(300, "", 1.0), (301, "a", 1.0)]
    asked = sorted({text_of(RNG.randint(1, 3)) for _ in range(60)} | {"ab", "ab ab", "a", "ab "})
    df = spark.createDataFrame(bank, "bank_pos int, text string, weight double").repartition(5)
    got = R.phrase_matches(spark.createDataFrame([(c,) for c in asked], "context string"), df, cells, top_k=4).orderBy("context", "rank").collect()
    want = [(c, key, score, n, CHARS.index(ch), i + 1) for c in asked for i, (score, n, ch, key) in enumerate(brute_matches(c, bank, 4))]
    assert [(r["context"], r["bank_pos"], r["score"], r["len"], r["cell_idx"], r["rank"]) for r in got] == want
    reasons = {r["context"]: r["reason"] for r in R.prior_reasons(spark.createDataFrame([("ab",), ("zz",)], "context string"), R.phrase_matches(spark.createDataFrame([("ab",), ("zz",)], "context string"), df, cells)).collect()}
    assert reasons == {"ab": "available", "zz": "no_matches"}
    weightless = df.withColumn("weight", F.lit(0.0))
    asked_df = spark.createDataFrame([("ab",)], "context string")
    assert R.prior_reasons(asked_df, R.phrase_matches(asked_df, weightless, cells)).first()["reason"] == "no_grid_compatible_next_char"


def test_index_of_a_shared_word_stays_small(spark, cells):
    """All of 30,000 phrases hold one word: a stretch keeps two lists of top_k."""
    bank = spark.range(30_000).selectExpr("id bank_pos", "concat('ab ', substr('abcabcab', 1 + id % 5, 3), ' ab c') text", "1.0 + id % 7 weight")
    index = R.phrase_index(bank, cells, 5)
    sizes = index.groupBy(*R.STRETCH).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 10 and sizes[1] < 1500
    asked = spark.createDataFrame([("ab",), ("x ab",), ("c ab",)], "context string")
    keys = ["context"]
    joined = R._asked(asked, keys).join(index, list(R.STRETCH)).count()
    assert joined <= 5 * 10
    top = R.phrase_matches(asked, bank, cells, 5).where("context = 'ab'").orderBy("rank").collect()
    assert [r["bank_pos"] for r in top] == [6, 13, 20, 27, 34] and {r["score"] for r in top} == {7.0 * 3 * 2}


def test_sum_before_at_span_borders(spark):
    rows = [(k, p, RNG.randint(0, 5)) for k in ("x", None) for p in [-9, -8, -1, 0, 0, 3, 4, 7, 8, 8, 15, 40]]
    got = sum_before(spark.createDataFrame(rows, "k string, pos long, v long"), ["k"], "pos", {"s": F.col("v")}, span=4).collect()
    want = Counter((k, p, v, sum(w for j, q, w in rows if j == k and q < p)) for k, p, v in rows)
    assert Counter(map(tuple, got)) == want


def test_session_prior_equals_brute_force(spark, cells):
    observed = [(s, p, text_of(RNG.randint(1, 3))) for s in ("x", "y") for p in range(40)] + [("x", 41, ""), ("x", 42, "a")]
    initial = [("x", i, text_of(2), float(i)) for i in range(4)]
    asked = [(s, p, text_of(RNG.randint(1, 2))) for s in ("x", "y", "nobody") for p in range(0, 45, 2)] + [("x", 5, ""), ("y", 5, "zq")]
    got = G.session_prior(spark.createDataFrame(asked, "subject string, pos int, context string"), spark.createDataFrame(observed, "subject string, pos int, text string"), cells, spark.createDataFrame(initial, "subject string, bank_pos int, text string, weight double"), top_k=3, span=8).collect()
    rows = {}
    for r in got:
        rows.setdefault((r["subject"], r["pos"], r["context"]), []).append(r)
    assert set(rows) == set(asked)
    for (s, p, c), own in rows.items():
        bank = [((0, i), t, w) for j, i, t, w in initial if j == s and w > 0] + [((1, q), t, 1.0) for j, q, t in observed if j == s and q < p and t]
        shares = Counter()
        for score, _, ch, _ in brute_matches(c, bank, 3):
            shares[CHARS.index(ch)] += score
        source, reason = "word_match", "available"
        if not shares:
            pairs = Counter()
            for _, t, w in bank:
                for a, b in zip(t, t[1:], strict=False):
                    if a == (c[-1:] or " ") and b in CHARS:
                        pairs[CHARS.index(b)] += w
            good = {k: n for k, n in pairs.items() if n >= 2}
            z = sum(good.values())
            import math

            h = -sum(n / z * math.log(n / z) for n in good.values()) / math.log(len(good)) if len(good) > 1 else 0.0
            shares = Counter(good) if good and h <= 0.65 else Counter()
            source = "char_backoff" if shares else "none"
            reason = "available" if shares else "no_matches" if not bank else "high_entropy" if good else "below_min_count"
        z = sum(shares.values())
        assert {r["cell_idx"]: round(r["p"], 9) for r in own if r["p"] is not None} == {k: round(n / z, 9) for k, n in shares.items()}
        assert {(r["source"], r["reason"], r["phrases"], r["tokens"]) for r in own} == {(source, reason, len(bank), sum(len(t.split(" ")) for _, t, _ in bank))}


def test_a_long_session(spark, cells):
    """One subject with 100,000 trials that share words: each sees just what came before."""
    n = 100_000
    trials = spark.range(n).selectExpr("'x' subject", "id pos", "concat(substr('abcabc', 1 + id % 3, 2), ' ab', if(id % 2 = 0, 'a', 'c')) text")
    asked = trials.selectExpr("subject", "pos", "if(pos % 2 = 0, 'ab', 'zz a') context")
    got = written(G.session_prior(asked, trials, cells), "long-session")
    at = {(r["pos"], r["cell_idx"]): r for r in got.where("pos in (0, 1, 2, 3, 50000, 99998, 99999)").collect()}
    assert at[0, None]["reason"] == "no_matches" and at[99_998, 3]["phrases"] == 99_998 and at[99_998, 3]["tokens"] == 2 * 99_998
    # ahead of trial 2: "ab aba" (begins with the context, a blank follows) and "bc abc" (inside, c follows)
    assert [(k[1], round(r["p"], 6)) for k, r in sorted(at.items(), key=str) if k[0] == 2] == [(2, 0.333333), (3, 0.666667)]
    assert at[99_999, 1]["source"] == "word_match" and got.count() >= n
    assert got.where("source = 'none'").count() == 1


def test_index_holds_what_is_asked_and_few_of_equal_texts(spark):
    """Copies of a phrase are cut up ``top_k`` times at most, and only into stretches that a context has; positions meet a list, not the index."""
    cells = spark.createDataFrame([(i, c) for i, c in enumerate("abcdefgh ")], "cell_idx int, ch string")
    bank = spark.range(400).selectExpr("id bank_pos", "'abc def gha' text", "cast(1 + id % 7 as double) weight")
    index = R.phrase_index(bank, cells, 3, asked=R._wanted(R._asked(spark.createDataFrame([("def",)], "context string"), ["context"]), []))
    assert sorted((r["bank_pos"], r["start"], r["_n"]) for r in index.collect()) == [(6, 5, 3), (13, 5, 3), (20, 5, 3)]

    asked = spark.range(500).selectExpr("'s' subject", "id pos", "'def' context")
    lists = G.session_lists(asked, G.session_bank(bank.selectExpr("'s' subject", "bank_pos pos", "text")), cells, top_k=3).collect()
    assert [(r["context"], [m["bank_pos"] for m in r["_list"]]) for r in lists] == [("def", [0, 1, 2])]
    got = G.session_matches(asked, G.session_bank(bank.selectExpr("'s' subject", "bank_pos pos", "text")), cells, top_k=3)
    assert {(r["pos"], r["rank"], r["bank_pos"]) for r in got.where("pos < 3").collect()} == {(1, 1, 0), (2, 1, 0), (2, 2, 1)}
