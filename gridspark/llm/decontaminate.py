"""Benchmark decontamination: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64
from .substring_dedup import _groups

FOUND = "doc_id long, item_id long, edits int, shared int, text_start int, text_end int, passages int"
_LIMIT = 0x110000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it alphanumeric, and its lower-case form if that is one code point."""
    alnum, low = np.zeros(_LIMIT, bool), np.arange(_LIMIT, dtype=np.uint32)
    for i in range(_LIMIT):
        c = chr(i)
        if c.isalnum():
            alnum[i] = True
            if len(x := c.lower()) == 1:
                low[i] = ord(x)
    return alnum, low


_cache: list = []


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, runs of other characters as one space, and where each came from."""
    if not _cache:
        _cache.extend(_tables())
    alnum, low = _cache
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = alnum[codes]
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    return np.where(word[at], low[codes[at]], np.uint32(32)).astype(np.uint32), at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each ``q`` consecutive code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    cur = codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    length, done, acc, rest = 1, 0, None, q
    while rest:
        if rest & 1:
            acc = cur[:n].copy() if acc is None else acc * k + cur[done : done + n]
            done += length
        rest >>= 1
        if rest:
            cur = cur[:-length] * k + cur[length:]
            k = np.uint64(int(k) * int(k) % (1 << 64))
            length *= 2
    return mix64(acc)


def aligned(passages: list[np.ndarray], regions: list[np.ndarray], budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each passage to any stretch of its region, and where that ends.

    All alignments advance one passage character at a time. Row i of a table is kept for text
    positions i - w to i + w, the band in which an alignment within the budget must lie.
    """
    n = len(passages)
    m = np.array([len(p) for p in passages])
    size = np.array([len(r) for r in regions])
    lead = int(budgets.max())
    width = max(int((size - m).max()), 0) + lead + 1  # a region cut off by the end of the buffer may be shorter than its passage
    text = np.full((n, lead + int(size.max()) + int(m.max()) + width + 2), 2**32 - 1, np.uint32)
    for i, r in enumerate(regions):
        text[i, lead : lead + len(r)] = r
    pattern = np.zeros((n, int(m.max())), np.uint32)
    for i, p in enumerate(passages):
        pattern[i, : len(p)] = p
    cols = np.arange(width + lead + 1)
    big = 1 << 14
    row = np.where((cols >= lead) & (cols[None, :] - lead <= size[:, None]), 0, big).astype(np.int32)  # any start is free
    best, end = np.full(n, big, np.int32), np.zeros(n, np.int64)
    for i in range(pattern.shape[1]):
        # column c of row i stands for text position i + c - lead
        step = np.full_like(row, big)
        step[:, :-1] = row[:, 1:] + 1  # a passage character without a text character
        step = np.minimum(step, row + (text[:, i : i + len(cols)] != pattern[:, i : i + 1]))
        step = np.minimum.accumulate(step - cols, axis=1) + cols  # text characters without a passage character
        outside = (i + 1 + cols - lead)[None, :]
        row = np.where((outside >= 0) & (outside <= size[:, None]), step, big).astype(np.int32)
        at = np.flatnonzero(m == i + 1)
        if len(at):
            c = row[at].argmin(axis=1)
            best[at], end[at] = row[at, c], i + 1 + c - lead
    return best, end


class Passages:
    """An index of benchmark items: q-gram hashes with their places, and the passages over each place.

    Equal items share one entry. ``text_of`` has the items' code points one after the other; the
    passages over place x are ``first_passage[x]`` and the next ``over[x]``.
    """

    def __init__(self, items: list[tuple[int, str]], q: int, length: int, rate: float, step: int = 16):
        self.q, self.codes, self.owners = q, [], []
        self.short: dict[int, dict[bytes, list[int]]] = {}
        known: dict[bytes, int] = {}
        texts, owner, begin, at = [], [], [], 0
        for item, text in items:
            codes, _ = normalise(text or "")
            n = len(codes)
            if n < 2 * q:
                codes = codes[: n - 1] if n and codes[-1] == 32 else codes
                if len(codes):
                    self.short.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(item)
                continue
            same = known.setdefault(codes.tobytes(), len(self.owners))
            if same < len(self.owners):
                self.owners[same].append(item)
                continue
            for s in [0] if n <= length else [*range(0, n - length, step), n - length]:
                owner.append(same)
                begin.append(at + s)
                self.codes.append(codes[s : s + length])
            self.owners.append([item])
            texts.append(codes)
            at += n
        m = np.array([len(c) for c in self.codes], np.int64)
        self.owner, self.begin = np.array(owner, np.int64), np.array(begin, np.int64)
        # the lemma must leave at least q + 1 shared q-grams
        self.budget = np.maximum(0, np.minimum(np.floor(rate * m), np.floor((m - 2 * q) / q))).astype(np.int64)
        self.needed = m + 1 - (self.budget + 1) * q
        place = np.arange(at, dtype=np.int64)
        last = self.begin + m - q  # the last q-gram of each passage; begins and lasts both ascend
        self.first_passage = np.searchsorted(last, place, side="left")
        self.over = np.searchsorted(self.begin, place, side="right") - self.first_passage
        flat = gram_hashes(np.concatenate(texts), q) if texts else np.zeros(0, np.uint64)
        inside = np.flatnonzero(self.over[: len(flat)] > 0)  # q-grams over the end of an item are in no passage
        order = inside[np.argsort(flat[inside], kind="stable")]
        self.place = order
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.load = np.add.reduceat(self.over[order], self.first) if len(order) else self.count  # passages over all places of a q-gram
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.longest, self.least = int(m.max(initial=0)), int(self.needed.min(initial=1))
        self.slack = int(self.budget.max(initial=0))
        self.size = at

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text number, item, edits, shared q-grams, start, end, passages) for each item found."""
        if not len(self.keys) and not self.short:
            return []
        normal = [normalise(t or "") for t in texts]
        gap = self.longest + self.slack + self.q
        ends = np.cumsum([len(c) + gap for c, _ in normal])
        whole = np.zeros(int(ends[-1]), np.uint32)
        for e, (c, _) in zip(ends.tolist(), normal, strict=True):
            whole[e - gap - len(c) : e - gap] = c
        out: dict[tuple[int, int], tuple] = {}  # an item id may have several texts
        for d, i, e, s, x, y, n in [*self._short(whole, normal, ends, gap), *(self._long(whole, normal, ends, gap) if len(self.keys) else [])]:
            old = out.get((d, i))
            out[d, i] = (e, s, x, y, n) if old is None else (*min(old[:2], (e, s), key=lambda v: (v[0], -v[1])), min(old[2], x), max(old[3], y), old[4] + n)
        return [(d, i, *rest) for (d, i), rest in out.items()]

    def _short(self, whole: np.ndarray, normal: list, ends: np.ndarray, gap: int) -> list[tuple[int, int, int, int, int, int, int]]:
        """Items under two q-grams, found as they are, between ends of words."""
        out: dict[tuple[int, int, int], tuple[int, int]] = {}
        border = (whole == 0) | (whole == 32)
        for m, table in self.short.items():
            at = np.flatnonzero(~border[1:] & border[:-1]) + 1
            at = np.concatenate([[0], at]) if len(border) and not border[0] else at
            at = at[at + m < len(whole)]
            at = at[border[at + m]]
            wanted = np.concatenate([gram_hashes(np.frombuffer(c, np.uint32), m) for c in table])
            for pos in at[np.isin(gram_hashes(whole, m)[at], wanted)].tolist():
                doc = int(np.searchsorted(ends, pos, side="right"))
                codes, origin = normal[doc]
                first = pos - (int(ends[doc]) - gap - len(codes))
                for item in dict.fromkeys(table.get(whole[pos : pos + m].tobytes(), ())):
                    x, y = int(origin[first]), int(origin[first + m - 1]) + 1
                    low, high = out.get((doc, item, m), (x, y))
                    out[doc, item, m] = (min(low, x), max(high, y))
        return [(d, i, 0, max(0, m - self.q + 1), x, y, 1) for (d, i, m), (x, y) in out.items()]

    def _regions(self, hit: np.ndarray, slot: np.ndarray, half: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (passage, band of diagonals) with enough shared q-grams among these hits, and how many."""
        counts = self.count[slot]
        src = np.repeat(np.arange(len(hit)), counts)
        place = self.place[np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(src))]
        over = self.over[place]
        which = np.repeat(np.arange(len(src)), over)
        passage = np.repeat(self.first_passage[place] - np.concatenate([[0], np.cumsum(over)[:-1]]), over) + np.arange(len(which))
        start = hit[src[which]] - (place[which] - self.begin[passage]) + self.longest  # where the passage would begin, made positive
        key, shared = np.unique(passage * span + start // half, return_counts=True)
        # bands overlap by half: the hits of two neighbouring halves count together
        joined = shared.copy()
        follows = np.flatnonzero(np.diff(key) == 1)
        joined[follows] += shared[follows + 1]
        near = joined >= self.needed[key // span]
        return key[near], joined[near]

    def _long(self, whole: np.ndarray, normal: list, ends: np.ndarray, gap: int, at_once: int = 500_000) -> list[tuple[int, int, int, int, int, int, int]]:
        """Items of two q-grams or more, by their passages."""
        h = gram_hashes(whole, self.q)
        hit = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        slot = np.searchsorted(self.keys, h[hit])
        slot[slot == len(self.keys)] = 0
        true = self.keys[slot] == h[hit]
        hit, slot = hit[true], slot[true]
        # a region can hold enough shared q-grams only where enough positions hit at all
        wide = self.longest + self.slack
        seen = np.searchsorted(hit, hit + wide) - np.arange(len(hit)) >= self.least
        edge = np.zeros(len(hit) + 1, np.int64)
        edge[:-1] += seen
        np.add.at(edge, np.searchsorted(hit, hit[seen] + wide), -1)
        use = np.cumsum(edge[:-1]) > 0
        hit, slot = hit[use], slot[use]
        half = self.slack + 1
        span = len(whole) // half + self.longest // half + 3
        # stretches of hits with a bounded number of passages; each reads on over one region's length
        load = np.cumsum(self.load[slot])
        keys, found, a = [], [], 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + at_once, side="right")))
            stop = int(np.searchsorted(hit, hit[b - 1] + wide + 2 * half))
            key, joined = self._regions(hit[a:stop], slot[a:stop], half, span)
            keys.append(key)
            found.append(joined)
            a = b
        if not keys:
            return []
        key, joined = np.concatenate(keys), np.concatenate(found)
        order = np.lexsort((-joined, key))
        key, joined = key[order], joined[order]
        new = np.diff(key, prepend=-1) != 0
        key, joined = key[new], joined[new]
        before = np.flatnonzero(np.diff(key) == 1) + 1
        near = np.ones(len(key), bool)
        near[before] = joined[before - 1] < joined[before]  # else the same hits, counted once
        key, joined = key[near], joined[near]
        passage, band = key // span, key % span
        low = np.maximum(band * half - self.longest - self.slack, 0)
        high = np.minimum((band + 2) * half - self.longest + self.slack + np.array([len(c) for c in self.codes])[passage], len(whole))
        out: dict[tuple[int, int], tuple] = {}
        for a in range(0, len(key), 512):
            part = slice(a, a + 512)
            best, stop = aligned([self.codes[p] for p in passage[part]], [whole[x:y] for x, y in zip(low[part], high[part], strict=True)], self.budget[passage[part]])
            for k in np.flatnonzero(best <= self.budget[passage[part]]).tolist():
                p, end = int(passage[a + k]), int(low[a + k] + stop[k])
                doc = int(np.searchsorted(ends, max(end - 1, 0), side="right"))
                codes, at = normal[doc]
                base = int(ends[doc]) - gap - len(codes)
                last = min(max(end - base - 1, 0), len(at) - 1)
                first = max(0, end - base - len(self.codes[p]))
                mine = (int(best[k]), int(joined[a + k]), int(at[min(first, last)]), int(at[last]) + 1, {p})
                old = out.get((doc, int(self.owner[p])))
                out[doc, int(self.owner[p])] = mine if old is None else (*min(old[:2], mine[:2], key=lambda x: (x[0], -x[1])), min(old[2], mine[2]), max(old[3], mine[3]), old[4] | {p})
        return [(d, i, e, s, x, y, len(ps)) for (d, o), (e, s, x, y, ps) in out.items() for i in dict.fromkeys(self.owners[o])]


_indexes: dict[str, Passages] = {}


def _index(tag: str, sent, q: int, length: int, rate: float, step: int) -> Passages:
    """The index of one block, made once for each worker process, which keeps one."""
    if tag not in _indexes:
        _indexes.clear()
        _indexes[tag] = Passages(sent.value, q, length, rate, step)
    return _indexes[tag]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator:
    """The benchmark's items in broadcasts of about ``block_chars`` characters, all texts of an item in one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for block in range(blocks):
        rows = [(r["item"], r["text"]) for r in items.where(F.col("block") == block).select("item", "text").collect()]  # one block
        yield benchmark.sparkSession.sparkContext.broadcast(rows)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 8, length: int = 48, rate: float = 0.08, step: int = 8, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` in which ``decontaminate`` finds nothing, as they are.

    The rows go through the search itself, a pass for each block of the benchmark; nothing is joined,
    hashed or shuffled, so null and repeated ids are judged row by row.
    """
    place = docs.columns.index(text_col)
    out = docs
    for sent in _blocks(benchmark, item_col, item_text, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent, tag=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(tag, sent, q, length, rate, step)
            for part in _groups(batches, place):
                leaking = {row[0] for row in index.search(part.column(place).to_pylist())}
                yield part.filter(pa.array([i not in leaking for i in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 8, length: int = 48, rate: float = 0.08, step: int = 8, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and benchmark item that it leaks: the best match and its span.

    Columns: doc_id, item_id, edits, shared (q-grams), text_start, text_end (characters of the
    text as it stands, from the first to the last matching passage), passages (how many).

    Texts are compared in lower case with runs of other characters than letters and digits as one
    space. An item is cut into passages of ``length`` characters, one every ``step`` characters
    and at the end, so each stretch of ``length + step - 1`` characters of it (some nine words by
    default) holds a whole one; a leak of a shorter part of a longer item can be missed. A shorter item is one passage; items
    under two q-grams are found as they are, as whole words; null items are not searched. A passage
    of m characters matches a stretch of text within k edits, k the lesser of rate * m and m / q - 2,
    rounded down: at q = 8 and a rate of 0.08 the second is the lesser one for some m under 50, where
    more edits would leave too few shared q-grams. By the q-gram lemma such a stretch shares
    m + 1 - (k + 1) q q-grams on at most k + 1 neighbouring diagonals, so shared q-grams are counted
    in bands of diagonals that overlap by half, bands with fewer are dropped, and the rest is
    verified by an alignment inside the band.

    The benchmark is dealt into blocks by a hash of the item id, so that a block has about
    ``block_chars`` characters and all texts of an item; each block is broadcast by itself and
    searched against all documents, so memory does not grow with the benchmark: an index takes some
    40 bytes a character. A benchmark within one block, the usual case, is one pass without a
    shuffle. Frequent q-grams are looked up in stretches of bounded size.

    Null texts match nothing; rows with null ids, repeated rows and rows with the same id are
    reported row by row, items with a null id as one item; very long texts are searched whole, one
    at a time; empty tables give no rows; extra columns, also of clashing names, are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for sent in _blocks(benchmark, item_col, item_text, block_chars):

        def search(batches: Iterator[pa.RecordBatch], sent=sent, tag=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(tag, sent, q, length, rate, step)
            for part in _groups(batches, 1):
                found = index.search(part.column(1).to_pylist())
                ids = part.column(0).to_pylist()
                cols = list(zip(*found, strict=True)) if found else [[]] * 7
                kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 5
                cols[0] = [ids[d] for d in cols[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "edits", "shared", "text_start", "text_end", "passages"])

        part = source.mapInArrow(search, FOUND)
        out = part if out is None else out.unionByName(part)
    return out
