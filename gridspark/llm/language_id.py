"""Language of web pages by fusing text, declared language, address suffix and host evidence."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .substring_dedup import _groups

BUCKETS = 1 << 15
_DROPPED = {"script", "style", "nav", "footer", "aside", "noscript", "template"}
_MARK = re.compile(r"<!--|-->|<(/?)([A-Za-z][^\s/<>]*)[^<>]*>|<[!?/][^<>]*>")
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def visible_text(page: str) -> str:
    """The text of a page without scripts, styles, navigation, comments and tags.

    One pass over the marks of the page; a dropped element or comment without an end reaches to the
    end of the page.
    """
    out, at, inside = [], 0, None
    for m in _MARK.finditer(page):
        mark, close, name = m[0], m[1], (m[2] or "").lower()
        if inside is None:
            out += page[at : m.start()], " "
            if mark == "<!--" or (not close and name in _DROPPED):
                inside = name or mark
        elif mark == "-->" if inside == "<!--" else close and name == inside:
            inside = None
        at = m.end()
    if inside is None:
        out.append(page[at:])
    return entities.unescape("".join(out))


def trigram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram (lower case) and the text it is in; trigrams do not cross texts."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * 40503 >> 4
    inside = owner[:-2] == owner[2:]
    return code[inside] % BUCKETS, owner[:-2][inside]


def language_id(pages: DataFrame, labelled: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 5_000, text_weight: float = 0.05, strength: float = 8.0, most_langs: int = 500) -> DataFrame:
    """One row per page: (id, lang, probability, text_lang, declared, host, n_chars).

    Text likelihoods are byte-trigram counts per language, from about ``sample_rows`` labelled
    rows of each language (the documented bound), sent to all tasks as a table of fixed size. The
    posterior by text alone is summed over all pages by host, domain (last two labels), address
    suffix (last label) and declared language (``lang`` of the html tag). Host priors are smoothed
    by their domain and that by the whole, with ``strength`` pages of the level above; suffix and
    declared language give likelihood ratios smoothed likewise. All four leave the page itself out,
    so a page is judged by its own text and by what other pages say. The answer has the greatest
    product; ties go to the first language by name.

    ``text_weight`` tempers the text's log-likelihood, for neighbouring trigrams depend on each
    other. A page without html or address is judged by what is left, in the end by the overall
    prior. Null ids and repeated rows are kept, row by row; very long pages are read whole, in time
    proportional to their length; an empty table gives no rows; extra columns are ignored. Without
    labelled rows the language is null. More than ``most_langs`` languages are an error, for each is
    a column.
    """
    spark = pages.sparkSession
    named = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(sizes)
    width = len(langs)
    page = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    if not width:
        none = F.lit(None).cast("string")
        return page.select(F.col("id").alias(id_col), none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), none.alias("declared"), host.alias("host"), F.lit(0).cast("long").alias("n_chars"))

    million = 1_000_000
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(million * min(1.0, sample_rows / sizes[k]))))]), F.col("lang"))
    sample = named.where(F.pmod(F.xxhash64("text"), F.lit(million)) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, BUCKETS), np.int64)
        number = {k: i for i, k in enumerate(langs)}
        for part in _groups(batches, 0):
            bucket, owner = trigram_buckets(part.column(0).to_pylist())
            lang = np.array([number[k] for k in part.column(1).to_pylist()], np.int64)
            out += np.bincount(lang[owner] * BUCKETS + bucket, minlength=width * BUCKETS).reshape(width, BUCKETS)
        lang, bucket = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(out[lang, bucket])], names=["lang", "bucket", "n"])

    cells = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((width, BUCKETS), 0.5)
    table[cells["lang"].to_numpy(), cells["bucket"].to_numpy()] += cells["n"].to_numpy()
    sent = spark.sparkContext.broadcast(np.log(table / table.sum(axis=1, keepdims=True)).T.copy())
    chances = [f"p{i}" for i in range(width)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 2):
            pages_ = part.column(2).to_pylist()
            texts = [visible_text(x) for x in pages_]
            bucket, owner = trigram_buckets(texts)
            logs = np.zeros((len(texts), width))
            for i in range(width):
                logs[:, i] = np.bincount(owner, weights=sent.value[bucket, i], minlength=len(texts))
            logs *= text_weight
            logs -= logs.max(axis=1, keepdims=True)
            p = np.exp(logs)
            p /= p.sum(axis=1, keepdims=True)
            found = [_LANG.search(x) for x in pages_]
            declared = [m[1].lower() if m else "" for m in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(declared), pa.array([len(t) for t in texts], pa.int64()), *[pa.array(c) for c in p.T]], names=["id", "url", "declared", "n_chars", *chances])

    kinds = dict(page.dtypes)
    seen = page.mapInArrow(read, f"id {kinds['id']}, url string, declared string, n_chars long, " + ", ".join(f"{c} double" for c in chances))
    labels = F.split(F.col("host"), r"\.")
    seen = seen.withColumn("host", host).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(labels, -1))
    seen = materialize(seen.drop("url"), "language-pages")

    def sums(by: str, prefix: str) -> DataFrame:
        return materialize(seen.groupBy(by).agg(*[F.sum(c).alias(prefix + c) for c in chances], F.count(F.lit(1)).alias(prefix + "n")), f"language-{by}")

    whole = seen.agg(*[F.sum(c).alias(c) for c in chances], F.count(F.lit(1)).alias("n")).first()
    overall = [((whole[c] or 0.0) + 1.0) / (whole["n"] + width) for c in chances]
    joined = seen
    for by, prefix in (("host", "h_"), ("domain", "d_"), ("suffix", "s_"), ("declared", "c_")):
        joined = joined.join(sums(by, prefix), by)

    def smoothed(prefix: str, c: str, above: Column) -> Column:
        return (F.greatest(F.col(prefix + c) - F.col(c), F.lit(0.0)) + strength * above) / (F.col(prefix + "n") - 1 + strength)

    scores = []
    for c, g in zip(chances, overall, strict=True):
        domain = smoothed("d_", c, F.lit(g))
        prior = smoothed("h_", c, domain)
        suffix, declared = (smoothed(x, c, F.lit(g)) / g for x in ("s_", "c_"))
        scores.append(F.greatest(F.col(c), F.lit(1e-300)) * prior * suffix * F.when(F.col("declared") == "", 1.0).otherwise(declared))
    result = joined.select("id", "declared", "host", "n_chars", *chances, *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    finals = [F.col(f"s{i}") for i in range(width)]

    def best(cols: list[Column]) -> Column:
        top = F.greatest(*cols) if width > 1 else cols[0]
        return F.coalesce(*[F.when(x == top, F.lit(k)) for x, k in zip(cols, langs, strict=True)])

    total = finals[0]
    for x in finals[1:]:
        total = total + x
    top = F.greatest(*finals) if width > 1 else finals[0]
    return result.select(F.col("id").alias(id_col), best(finals).alias("lang"), (top / total).alias("probability"), best([F.col(c) for c in chances]).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "host", "n_chars")
