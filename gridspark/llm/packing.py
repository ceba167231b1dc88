"""Cost-balanced packing of token sequences for training."""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file lies; the file is never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.cache
def load_tokenizer(path: str, added: bool = False):
    """A function from a text to its ids, for the byte-level vocabulary in ``path``.

    A rank file of the same name is the same vocabulary in the form that the faster library reads;
    where there is none, the JSON file itself is loaded. The file's added (special) tokens are
    ordinary text, or with ``added`` have their own ids wherever they stand in a text.
    """
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    plain = not any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
    ranks = Path(path).with_suffix(".tiktoken")
    if ranks.exists() and (plain or not added):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.open("rb"))}
        coder = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={t["content"]: t["id"] for t in tokens} if added else {})
        return lambda text: coder.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = not added
    return lambda text: model.encode(text, add_special_tokens=False).ids


def attention_cost(tokens: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> float:
    """Estimated cost of attending over one piece: a linear and a quadratic part."""
    return linear * tokens + quadratic * tokens * tokens


class OpenSequences:
    """Sequences by room, with the cheapest of each room in a tree of minima over all rooms.

    ``take(n)`` removes the cheapest sequence with room for ``n`` tokens, the first of equals; its
    work is the depth of the tree, however many cheaper sequences have too little room.
    """

    _none = (float("inf"), -1)

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.best = [self._none] * (2 * self.width)
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def put(self, room: int, cost: float, s: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, s))
        self._update(room)

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, sequence), or None if no sequence has room."""
        i, found, room = n + self.width, self.best[n + self.width], n + self.width
        while i > 1:
            if not i & 1 and self.best[i + 1] < found:
                found, room = self.best[i + 1], i + 1
            i >>= 1
        if found[1] < 0:
            return None
        while room < self.width:
            room = 2 * room + (self.best[2 * room] != found)
        room -= self.width
        heapq.heappop(self.heaps[room])
        self._update(room)
        return room, found[1]

    def _update(self, room: int) -> None:
        i, heap, best = room + self.width, self.heaps[room], self.best
        new = heap[0] if heap else self._none
        while i and best[i] != new:
            best[i] = new
            new = min(new, best[i ^ 1])
            i >>= 1


def pack_lengths(lengths: list[int], capacity: int, least: int = 1) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pack documents of these lengths; pieces (document, start, length, sequence, offset) and sequence sizes.

    Whole multiples of ``capacity`` are cut off as sequences of their own. The rest, by descending
    cost, goes to the cheapest sequence that has room; documents that fit nowhere whole are cut
    over the sequences with most room. There are just enough sequences for all tokens; the short
    rest of a group fills sequences of a power of two, which need no padding, down to ``least``.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []
    rests = []
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, len(sizes), 0))
            sizes.append(capacity)
        if n % capacity:
            rests.append((n % capacity, d))
    total = sum(n for n, _ in rests)
    rooms = [capacity] * (total // capacity)
    left = total % capacity
    power = capacity
    while left:
        power //= 2
        if left <= least or power < least:
            rooms.append(min(least, capacity))
            break
        if left >= power:
            rooms.append(power)
            left -= power
    first, used = len(sizes), [0] * len(rooms)
    costs = [0.0] * len(rooms)
    open_ = OpenSequences(capacity)
    for s, room in enumerate(rooms):
        open_.put(room, 0.0, s)
    cut = []
    for n, d in sorted(rests, key=lambda x: (-attention_cost(x[0]), x[1])):
        found = open_.take(n)
        if found is None:
            cut.append((n, d))
            continue
        room, s = found
        pieces.append((d, lengths[d] - n, n, first + s, used[s]))
        used[s] += n
        costs[s] += attention_cost(n)
        if room > n:
            open_.put(room - n, costs[s], s)
    free = [(used[s] - rooms[s], s) for s in range(len(rooms)) if used[s] < rooms[s]]
    heapq.heapify(free)
    for n, d in cut:
        start = lengths[d] - n
        while n:
            room, s = heapq.heappop(free)
            take = min(n, -room)
            pieces.append((d, start, take, first + s, used[s]))
            used[s] += take
            start, n = start + take, n - take
            if used[s] < rooms[s]:
                heapq.heappush(free, (used[s] - rooms[s], s))
    return pieces, sizes + used


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("cost", T.DoubleType()),
    ]
)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 2048, end_id: int = 1, window_tokens: int = 4_000_000, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    Columns: doc_id, start, length, ids_crc32 (of the little-endian 32-bit ids), doc_tokens,
    sequence_id, offset, cost, and ``ids`` (array) on request. Each scan task packs what it reads,
    ``window_tokens`` at a time, so nothing is shuffled and memory is bounded; a sequence id is
    the task's partition and a running number, the same again if the task is retried. A document
    longer than the window is a window by itself. With ``added_tokens``, texts that hold an added
    token of the vocabulary file (``<|endoftext|>``) get its id there, as ``tokenizers`` gives it.

    Null texts count as empty and are packed as the end id alone; repeated rows and null ids are
    packed like any others; an empty table gives no rows.
    """
    path = vocabulary or tokenizer_path()
    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else PIECES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path, added_tokens)
        task = TaskContext.get()
        state = {"next": task.partitionId() << 32}

        def flush(keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            pieces, sizes = pack_lengths([len(x) for x in ids], capacity)
            cols: list[list] = [[] for _ in schema]
            for d, start, n, seq, offset in pieces:
                part = ids[d][start : start + n]
                row = [keys[d], start, n, zlib.crc32(part.tobytes()), len(ids[d]), state["next"] + seq, offset, attention_cost(n)]
                for col, v in zip(cols, [*row, part.astype("<i4")] if with_ids else row, strict=True):
                    col.append(v)
            state["next"] += len(sizes)
            types = [pa.int64()] * 7 + [pa.float64()] + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)

        keys, ids, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.append(np.asarray(encode(text.as_py() or ""), "<u4"), np.uint32(end_id))
                keys.append(key)
                ids.append(one)
                held += len(one)
                if held >= window_tokens:
                    yield flush(keys, ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield flush(keys, ids)

    return docs.select(id_col, text_col).mapInArrow(pack, schema)
