"""Language-model scores from a hidden Markov model trained by distributed Baum-Welch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, mix64
from .substring_dedup import _groups, _lists
from .toxicity import part_of

#: The end of a text is a token; its hash is a constant that no word has in practice.
END = np.uint64(0x9E3779B97F4A7C15)
TAIL = 3  # bytes at the end of a word that choose the class of a rare word
COUNTS = "word long, class int, n long"
SCORED = "uid long, id {id}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"


def tokens_of(part: pa.RecordBatch, classes: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """Hashes of all tokens, end tokens included, a function from tokens' places to their classes, and
    the bounds of each text. The class of a word comes from its last bytes; an end token has class 0."""
    w = Words(part.column("text").to_pylist(), lower=True)
    bounds = w.bounds + np.arange(len(w.bounds))

    def classes_of(at: np.ndarray) -> np.ndarray:
        text = np.searchsorted(bounds, at, side="right") - 1
        word = np.flatnonzero(at != bounds[text + 1] - 1)
        last = at[word] - text[word]
        size, end = np.minimum(w.end[last] - w.start[last], TAIL), w.end[last]
        key = size.astype(np.uint64)
        for k in range(TAIL):
            byte = np.where(k < size, w.data[np.maximum(end - 1 - k, 0)], 0)
            key = key << np.uint64(8) | byte.astype(np.uint64)
        out = np.zeros(len(at), np.int32)
        out[word] = (mix64(key) % np.uint64(classes)).astype(np.int32)
        return out

    return np.insert(w.hash, w.bounds[1:], END), classes_of, bounds


def symbol_groups(batches: Iterator[pa.RecordBatch], tokens: int = 700_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and text bounds of slices of about ``tokens`` tokens, one text at least."""
    for batch in batches:
        lists = batch.column(0)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        group = (offsets[1:] - offsets[0]) // tokens
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
            yield values[offsets[a] : offsets[b]], (offsets[a : b + 1] - offsets[a]).astype(np.int64)


class Vocabulary:
    """Counts of the frequent words, and the symbol of the model that a token stands for.

    The ``own`` most frequent tokens are symbols themselves; all others share one symbol for each
    class, and take within it a share in proportion to their count plus one.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, own: int, class_sizes: np.ndarray, total: int, distinct: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -counts))] = np.arange(len(words))
        self.symbol = np.where(rank < own, rank, -1)[order]
        self.own, self.class_sizes, self.total, self.distinct = min(own, len(words)), class_sizes, total, distinct
        self.size = self.own + len(class_sizes)

    def look_up(self, hashes: np.ndarray, classes_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and counts of tokens; the count is -1 where it is not in this table."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        symbols = np.where(hit, self.symbol[at], -1)
        rare = np.flatnonzero(symbols < 0)
        symbols[rare] = self.own + classes_of(rare)
        return symbols, np.where(hit, self.counts[at], -1)


def in_step(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order the tokens of stretches so that all advance together: by position, longest stretch first.

    Returns the token order, the offset of each step, and the stretches in order.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    steps = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    offsets = np.concatenate([[0], np.cumsum(active)])
    index = np.concatenate([starts[:n] + t for t, n in enumerate(active)]) if steps else np.zeros(0, np.int64)
    return index, offsets, order


def segments_of(bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of segments of at most ``longest`` tokens, and their number in their text."""
    sizes = np.diff(bounds)
    parts = -(-sizes // longest)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    return bounds[:-1][owner] + number * longest, np.minimum(longest, sizes[owner] - number * longest), number


def borders(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, number: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """What the rest of its text says about each segment.

    ``inlet`` has the scaled forward state after the segment before, ``outlet`` the backward state
    after the segment's last token up to a factor. Both come from the segments' transfer matrices
    (the product of a move and an emission for each token), chained along each text.
    """
    states = emit.shape[1]
    inlet, outlet = np.zeros((len(starts), states), emit.dtype), np.ones((len(starts), states), emit.dtype)
    many = np.flatnonzero((number > 0) | np.append(number[1:] > 0, False))  # segments of texts that have several
    if not len(many):
        return inlet, outlet
    through = np.empty((len(many), states, states), emit.dtype)
    ones = np.ones(states * states, emit.dtype)
    even = emit / emit.max(axis=1, keepdims=True)  # factors of a token cancel; so products stay large for some steps
    for x in range(0, len(many), at_once):
        part = many[x : x + at_once]
        index, offsets, order = in_step(starts[part], sizes[part])
        lead = number[part][order] == 0
        product = np.where(lead[:, None, None], np.eye(states, dtype=emit.dtype), move)
        for t, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            here = product[: b - a]
            if t:
                here = (here.reshape(-1, states) @ move).reshape(here.shape)
            here = here * even[symbols[index[a:b]]][:, None, :]
            product[: b - a] = here if t % 4 else here / (here.reshape(len(here), -1) @ ones)[:, None, None]
        through[x + order] = product
    place, own = number[many], np.arange(len(many))
    for r in range(1, int(place.max()) + 1):
        at = own[place == r]
        before = np.tile(start, (len(at), 1)) if r == 1 else inlet[many[at - 1]]
        state = np.einsum("ni,nij->nj", before, through[at - 1])
        inlet[many[at]] = state / state.sum(axis=1, keepdims=True)
    for r in range(int(place.max()), 0, -1):
        at = own[place == r]
        state = np.einsum("nij,nj->ni", through[at], outlet[many[at]])
        outlet[many[at - 1]] = state / state.sum(axis=1, keepdims=True)
    return inlet, outlet


def forward(symbols: np.ndarray, bounds: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, longest: int = 512) -> np.ndarray:
    """Exact natural log-likelihood of each text by the scaled forward recursion.

    The segments of a long text advance together; each begins with the state that the text before
    it implies.
    """
    starts, sizes, number = segments_of(bounds, longest)
    inlet, _ = borders(symbols, starts, sizes, number, start, move, emit)
    index, offsets, order = in_step(starts, sizes)
    out, ones = np.zeros(len(order)), np.ones(emit.shape[1])
    state = np.where((number == 0)[:, None], start, inlet @ move)[order]
    for t, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        state = (state[: b - a] @ move if t else state) * emit[symbols[index[a:b]]]
        scale = state @ ones
        state /= scale[:, None]
        out[: b - a] += np.log(scale)
    owner = np.cumsum(number == 0) - 1
    return np.bincount(owner[order], weights=out, minlength=len(bounds) - 1)


def expected_counts(symbols: np.ndarray, bounds: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, longest: int, out: np.ndarray, at_once: int = 700_000) -> None:
    """Add one batch's expected Baum-Welch counts to ``out``.

    Rows: one per symbol, then per state its moves, then starts, then the log-likelihood. The
    counts are those of whole texts: texts are cut into segments of ``longest`` tokens that advance
    together, ``at_once`` tokens at a time, and each segment begins and ends with the states that
    the rest of its text implies.
    """
    starts, sizes, number = segments_of(bounds, longest)
    inlet, outlet = borders(symbols, starts, sizes, number, start, move, emit)
    group = np.cumsum(sizes) // at_once
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    for x, y in zip(edges, [*edges[1:], len(starts)], strict=True):
        _segment_counts(symbols, starts[x:y], sizes[x:y], number[x:y] == 0, inlet[x:y], outlet[x:y], start, move, emit, out)


def _segment_counts(symbols, starts, sizes, first, inlet, outlet, start, move, emit, out) -> None:
    index, offsets, order = in_step(starts, sizes)
    sizes, first, inlet, outlet = sizes[order], first[order], inlet[order], outlet[order]
    size, states = emit.shape
    seen = emit[symbols[index]]
    alpha, scale = np.empty_like(seen), np.empty(len(index), seen.dtype)
    alpha[: len(sizes)] = np.where(first[:, None], start, inlet @ move)
    ones = np.ones(states, seen.dtype)
    p = 0
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        state = alpha[a:b]
        if a:
            np.matmul(alpha[p : p + b - a], move, out=state)
        state *= seen[a:b]
        np.matmul(state, ones, out=scale[a:b])
        state /= scale[a:b, None]
        p = a
    last = alpha[offsets[sizes - 1] + np.arange(len(sizes))]
    beta = outlet / (last * outlet).sum(axis=1, keepdims=True)
    back = move.T.copy()
    moves = np.zeros((states, states))
    for k in range(len(offsets) - 2, 0, -1):
        a, b, p = offsets[k], offsets[k + 1], offsets[k - 1]
        n = b - a
        ahead = seen[a:b]
        ahead *= beta[:n]
        ahead /= scale[a:b, None]
        moves += alpha[p : p + n].T @ ahead
        alpha[a:b] *= beta[:n]  # from here on the posterior
        np.matmul(ahead, back, out=beta[:n])
    heads = int(offsets[1])
    entered = (beta[:heads] * seen[:heads] / scale[:heads, None])[~first]
    moves += inlet[~first].T @ entered
    alpha[:heads] *= beta[:heads]
    seen_symbols = symbols[index]
    for s in range(states):
        out[:size, s] += np.bincount(seen_symbols, weights=alpha[:, s], minlength=size)
    out[size : size + states] += moves * move
    out[size + states] += alpha[:heads][first].sum(axis=0)
    out[size + states + 1, 0] += np.log(scale.astype(np.float64)).sum()


def initial_model(together: np.ndarray, vocabulary: Vocabulary, symbol_counts: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first model from how often frequent tokens share texts.

    Tokens are placed by the leading directions of their normalised co-occurrence, the states are
    the farthest of them, and each token prefers the states near to it. States are sticky.
    """
    n = len(together)
    mass = np.maximum(together.sum(axis=1), 1e-9)
    lift = together / np.sqrt(mass[:, None] * mass[None, :])
    values, vectors = np.linalg.eigh(lift)
    place = vectors[:, -states:] * np.abs(values[-states:])
    place /= np.linalg.norm(place, axis=1, keepdims=True) + 1e-12
    seeds = [0]
    near = place @ place[0]
    while len(seeds) < states:
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, place @ place[seeds[-1]])
    for _ in range(20):
        centres = place[seeds] if _ == 0 else centres
        nearest = (place @ centres.T).argmax(axis=1)
        centres = np.stack([place[nearest == s].mean(axis=0) if (nearest == s).any() else centres[s] for s in range(states)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
    emit = np.repeat((symbol_counts + 1e-3)[:, None], states, axis=1)
    emit[:n] *= np.exp(3 * (place @ centres.T))
    emit /= emit.sum(axis=0)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, emit


@dataclass
class HiddenMarkov:
    """A fitted model: symbols of tokens, chances of states, and the table of all training counts.

    ``counts`` (word, class, n) is a written table of all training words; words whose count has a
    level under ``floor`` are in no task's vocabulary and are looked up there. ``likelihood`` has
    the training log-likelihood before each round.
    """

    vocabulary: Vocabulary
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    counts: DataFrame
    floor: int
    classes: int
    likelihood: list[float]


def _level() -> Column:
    """16 levels for each doubling of a count."""
    return F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")


def hidden_markov_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, **settings) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are words lower-cased in A-Z, then one end token. Rows whose crc32 of the id as text is
    ``held_fold`` modulo ``folds`` are held out; ``fit_hidden_markov`` learns from all others, with
    ``settings``, and ``score_texts`` scores every row. Null texts count as empty (one end token).
    Null ids train. Repeated rows and repeated ids are counted and scored row by row, very long
    texts whole. If no row trains, no token is known and all chances are even. Extra columns are
    ignored; an empty table gives no rows.
    """
    fold = part_of(F.col("id"), folds)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("held_out", F.coalesce(fold == held_fold, F.lit(False)))
    model = fit_hidden_markov(source.where(~F.col("held_out")).select("text"), **settings)
    return score_texts(source, model).withColumnRenamed("id", id_col)


def fit_hidden_markov(train: DataFrame, *, states: int = 8, own: int = 16_384, classes: int = 2_048, frequent: int = 262_144, rounds: int = 12, tolerance: float = 2e-3, segment: int = 512, leading: int = 512) -> HiddenMarkov:
    """A hidden Markov model of the texts in column ``text``, by Baum-Welch.

    Hidden states emit frequent words or classes of rarer ones (by their last letters), and a class
    gives each of its words a share in proportion to its training count plus one, with one share
    for words that training never saw. The probabilities of all texts of a length sum to one.

    Words of all rows are counted with a grouped aggregation. The ``frequent`` most frequent counts
    are broadcast (the bound is the parameter); rarer ones stay in a table. Rows are written once
    as symbols. Each round maps all of them to the expected counts of whole texts, a table of fixed
    size for each task, which Spark sums; ``segment`` only sets how many tokens of a long text
    advance together. Rounds end when the log-likelihood of a token grows by less than
    ``tolerance``, after ``rounds`` at the latest.
    """
    spark = train.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            """What is held, each word once."""
            h, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            words, first, back = np.unique(h, return_index=True, return_inverse=True)
            summed = np.bincount(back, weights=n, minlength=len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(k[first]), pa.array(summed)], names=["word", "class", "n"])

        for part in _groups(batches, 0):
            h, k, _ = tokens_of(part, classes)
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, k(at), n))
            size += len(u)
            if size > 3_000_000:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    counts = materialize(train.mapInArrow(count, COUNTS).groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("n")), "markov-counts")
    sizes = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(sizes["n"] or 0), int(sizes["v"])
    level = _level()
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 16 for each bit of a count
    floor, held = max([r["level"] for r in levels], default=0) + 1, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["words"]
        if held > frequent:
            break
        floor = r["level"]
    top = counts.where(level >= floor).select("word", "n").toArrow()  # at most ``frequent`` words
    top_words, top_counts = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    if not len(top_words):  # no level is small enough, or no training row: all counts are joined
        top_words, top_counts = np.array([1], np.uint64), np.zeros(1, np.int64)
    order = np.lexsort((top_words, -top_counts))[:own]
    least_own = spark.createDataFrame([(int(x),) for x in top_words[order].view(np.int64).tolist()], "word long")
    rarer = counts.join(F.broadcast(least_own), "word", "left_anti")  # at most ``own`` words
    class_rows = rarer.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # at most ``classes``
    class_sizes, class_counts = np.ones(classes), np.zeros(classes)
    for r in class_rows:
        class_sizes[r["class"]] += r["n"] + r["v"]
        class_counts[r["class"]] = r["n"]
    vocabulary = Vocabulary(top_words, top_counts, own, class_sizes, total, distinct)
    sent = spark.sparkContext.broadcast(vocabulary)
    size = vocabulary.size
    symbol_counts = np.concatenate([np.sort(top_counts)[::-1][: vocabulary.own], class_counts]).astype(float)
    leading = min(leading, vocabulary.own)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 0):
            h, k, bounds = tokens_of(part, classes)
            symbols = sent.value.look_up(h, k)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(symbols))], names=["symbols"])

    encoded = materialize(train.mapInArrow(encode, "symbols array<int>"), "markov-symbols")  # read by all rounds

    def summed(mapper, rows: int, width: int) -> np.ndarray:
        """Sum the tables of all tasks, element by element; ``rows`` and ``width`` are fixed."""
        cells = [f"c{i} double" for i in range(width)]
        parts = encoded.mapInArrow(mapper, "row long, " + ", ".join(cells))
        got = parts.groupBy("row").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)]).toArrow()
        out = np.zeros((rows, width))
        out[got["row"].to_numpy()] = np.column_stack([got[f"c{i}"].to_numpy() for i in range(width)]) if got.num_rows else 0
        return out

    def rows_of(matrix: np.ndarray) -> pa.RecordBatch:
        use = np.flatnonzero(matrix.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(use), *[pa.array(c) for c in matrix[use].T]], names=["row", *[f"c{i}" for i in range(matrix.shape[1])]])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((leading, leading))
        for symbols, bounds in symbol_groups(batches):
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            use = symbols < leading
            grid = np.bincount(text[use] * leading + symbols[use], minlength=(len(bounds) - 1) * leading).reshape(-1, leading)
            grid = np.minimum(grid, 1).astype(np.float32)
            out += grid.T @ grid
        # one row of the triangle at a time: (row, then its columns in cells of 64)
        flat = out.reshape(-1, 64) if leading % 64 == 0 else np.pad(out, ((0, 0), (0, -leading % 64))).reshape(-1, 64)
        yield rows_of(flat)

    wide = -(-leading // 64) * 64
    together = summed(neighbours, leading * wide // 64, 64).reshape(leading, wide)[:, :leading]
    start, move, emit = initial_model(together + 1e-6, vocabulary, symbol_counts, states)

    likelihood: list[float] = []
    for _ in range(rounds if total else 0):
        model = spark.sparkContext.broadcast((start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)))

        def learn(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            out = np.zeros((size + states + 2, states))
            for symbols, bounds in symbol_groups(batches):
                expected_counts(symbols, bounds, *model.value, segment, out)
            yield rows_of(out)

        got = summed(learn, size + states + 2, states)
        likelihood.append(float(got[-1, 0]))
        emit = got[:size] + 0.5 * (symbol_counts[:, None] + 1e-3) / (symbol_counts.sum() + 1e-3 * size) * states
        emit /= emit.sum(axis=0)
        move = got[size : size + states] + 0.1
        move /= move.sum(axis=1, keepdims=True)
        start = got[size + states] + 0.1
        start /= start.sum()
        if len(likelihood) > 1 and likelihood[-1] - likelihood[-2] < tolerance * total:
            break
    return HiddenMarkov(vocabulary, start, move, emit, counts, floor, classes, likelihood)


def score_texts(source: DataFrame, model: HiddenMarkov) -> DataFrame:
    """Score all rows of ``source`` (id, text, held_out): columns as in ``hidden_markov_scores``.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that under the model, exact
    on whole texts. Counts of words outside the vocabulary are joined to the tokens that need them,
    and enter both scores as a sum.
    """
    spark = source.sparkSession
    sent, final = spark.sparkContext.broadcast(model.vocabulary), spark.sparkContext.broadcast((model.start, model.move, model.emit))
    classes, counts, level, floor = model.classes, model.counts, _level(), model.floor

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        vocabulary = sent.value
        for part in _groups(batches, 1):
            h, k, bounds = tokens_of(part, classes)
            symbols, seen = vocabulary.look_up(h, k)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            n, texts = np.diff(bounds), len(bounds) - 1

            def per_text(values: np.ndarray, text=text, texts=texts) -> np.ndarray:
                return np.bincount(text, weights=values, minlength=texts)

            known = per_text(np.log10(np.maximum(seen, 0) + 1.0))
            in_class = symbols >= vocabulary.own
            shares = np.where(in_class, np.log10(vocabulary.class_sizes[np.where(in_class, symbols - vocabulary.own, 0)]), 0.0)
            # a class symbol's word takes (count + 1) / size; an own symbol takes all
            in_table = per_text(np.where(in_class, np.log10(np.maximum(seen, 0) + 1.0), 0.0))
            likelihood = forward(symbols, bounds, *final.value) / np.log(10)
            missing = np.flatnonzero(seen < 0)
            rare = np.split(h[missing].view(np.int64), np.searchsorted(text[missing], np.arange(1, texts)))
            columns = [
                pa.array(np.arange(uid, uid + texts)),
                part.column(0),
                part.column(2),
                pa.array(n),
                pa.array(per_text(seen > 0).astype(np.int64)),
                pa.array(known - n * np.log10(vocabulary.total + vocabulary.distinct + 1.0)),
                pa.array(likelihood + in_table - per_text(shares)),
                _lists(rare, pa.int64()),
            ]
            uid += texts
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    scored = materialize(source.mapInArrow(score, SCORED.format(id=dict(source.dtypes)["id"])), "markov-scored")
    rest = counts.where(level < floor).select("word", "n")
    rare = scored.select("uid", F.explode("rare").alias("word")).join(rest, "word")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("add"), F.count(F.lit(1)).alias("known"))
    extra = F.coalesce("add", F.lit(0.0))
    return scored.join(rare, "uid", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )
