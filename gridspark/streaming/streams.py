"""Stateful streams: edges, early-stopping decisions, growing banks, running metrics.

States, lists, maps and timers are kept in the RocksDB state store: put a query together and start it
inside ``with rocksdb(spark):``. A state of another version of these operators cannot be read on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import itr
from ..functions.text import normalize_context, normalize_text

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside use the state store that has lists, maps and timers."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _millis(x) -> int:
    return int(pd.Timedelta(x).total_seconds() * 1000)


def _newest(ts: pd.Series) -> int:
    return int(ts.max().timestamp() * 1000)


class _Timed(StatefulProcessor):
    """A processor that closes a key when the watermark passes its last event by ``limit`` milliseconds."""

    limit = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def close_at(self, newest: int, timer_values) -> None:
        """One timer a key: it moves on with each event."""
        now = self.until.get()
        at = max(newest, timer_values.getCurrentWatermarkInMs(), now[0] - self.limit if now else 0) + self.limit
        if now and now[0] != at:
            self.handle.deleteTimer(now[0])
        if not now or now[0] != at:
            self.handle.registerTimer(at)
            self.until.update((at,))

    def close(self) -> None:
        pass


def _buckets(rows: DataFrame, keys: Sequence[str], buckets: int) -> GroupedData:
    """Groups that hold many keys each, so a state is read and written once for all of them. Keys with a null
    have groups of their own: there a key's column is null in all rows or in none."""
    by = {f"_no_{k}": F.col(k).isNull() for k in keys} | {"_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets))}
    return rows.withColumns(by).groupBy(*by)


def _key(frame: pd.DataFrame, name: str, null: bool) -> np.ndarray:
    return np.zeros(len(frame), np.int64) if null else frame[name].to_numpy(np.int64)


def _shown(values: np.ndarray, null: bool) -> np.ndarray | list:
    return [None] * len(values) if null else values


def _moved(until: np.ndarray, who: np.ndarray, counts: np.ndarray, ms: pd.Series, now: int, limit: int) -> np.ndarray:
    """When keys close: ``limit`` after the last event of those that have a row that counts, never earlier than before."""
    newest, hit = np.zeros(len(until), np.int64), np.zeros(len(until), bool)
    np.maximum.at(newest, who, ms.fillna(0).to_numpy(np.int64))
    hit[who[counts]] = True
    return np.where(hit, np.maximum(np.maximum(newest, now) + limit, until), until)


_EDGES = "runs binary, passed binary, shut binary, until binary, stretches binary, start binary, stop binary, first binary, final binary"


def _edges(threshold: float, limit: int, names: tuple[str, str, str]):
    """Edges of a bucket of recordings. The state has a value a recording, and in their order the stretches without
    a gap that have come, with the numbers and values of their first and last sample: no others can meet a new one.
    Its columns are the bytes of arrays, for they are long."""
    kinds = (np.int64, np.int64, bool, np.int64, np.int64, np.int64, np.int64, float, float)
    run, order, value = names

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        runs, passed, shut, until, stretches, start, stop, first, final = (np.frombuffer(v, t).copy() for v, t in zip(state.get if state.exists else (b"",) * 9, kinds, strict=True))
        n = len(runs)
        of, known = np.repeat(np.arange(n), stretches), np.ones(n, bool)
        if not state.hasTimedOut:
            new = pd.concat(list(frames), ignore_index=True)
            counts, at, values = new["counts"].to_numpy(bool), new[order].to_numpy(np.int64), new[value].to_numpy(float)
            who, runs = pd.factorize(np.r_[runs, _key(new, run, key[0])])  # keys of the state keep their places
            known = np.bincount(who, np.r_[known, counts], len(runs)) > 0  # other rows only move the time on of keys that have one
            who, more = who[n:], len(runs) - n
            passed, shut, until = np.r_[passed, np.full(more, -1)], np.r_[shut, np.zeros(more, bool)], np.r_[until, np.zeros(more, np.int64)]
            until = _moved(until, who, counts, new["ms"], now, limit)

            use = counts & (at > passed[who])
            old = np.r_[np.ones(len(of), bool), np.zeros(use.sum(), bool)]
            of, start, stop, first, final = np.r_[of, who[use]], np.r_[start, at[use]], np.r_[stop, at[use]], np.r_[first, values[use]], np.r_[final, values[use]]
            rank = np.lexsort((~old, start, of))
            old, of, start, stop, first, final = (v[rank] for v in (old, of, start, stop, first, final))
            last = np.maximum.accumulate(np.where(old, np.arange(len(of)), -1))
            inside = ~old & (last >= 0) & (of[last] == of) & (stop[last] >= start)  # come before
            twin = ~old & np.r_[np.zeros(min(len(of), 1), bool), (of[1:] == of[:-1]) & (start[1:] == start[:-1])]  # comes again
            shut[of[~old & ~inside]] = False
            of, start, stop, first, final = (v[~inside & ~twin] for v in (of, start, stop, first, final))
            before, after = slice(None, -1), slice(1, None)
            meet = (of[after] == of[before]) & (start[after] == stop[before] + 1)
            hit = np.flatnonzero(meet & (final[before] <= threshold) & (first[after] > threshold)) + 1
            if len(hit):
                yield pd.DataFrame({run: _shown(runs[of[hit]], key[0]), order: start[hit], value: first[hit]})
            some = np.ones(min(len(of), 1), bool)
            heads, tails = np.r_[some, ~meet], np.r_[~meet, some]
            of, start, first, stop, final = of[heads], start[heads], first[heads], stop[tails], final[tails]

        due = until <= now
        late = np.r_[of[1:] != of[:-1], np.ones(min(len(of), 1), bool)]  # the last stretch of each
        left = late | ~due[of]
        of, start, stop, first, final = (v[left] for v in (of, start, stop, first, final))
        over = due[of]
        passed[of[over]] = stop[over]
        gone = ~known | due & (shut | (until + limit <= now))
        shut, until, keep = shut | due, np.where(due, until + limit, until), ~gone
        if not keep.any():
            if state.exists:
                state.remove()
            return
        held = keep[of]
        stretches = np.bincount(of, minlength=len(runs))
        state.update(tuple(v.tobytes() for v in (runs[keep], passed[keep], shut[keep], until[keep], stretches[keep], start[held], stop[held], first[held], final[held])))
        state.setTimeoutTimestamp(int(until[keep].min()))

    return step


def stream_edges(stream: DataFrame, threshold: float, run: str = "run", order: str = "sample", value: str = "signal", ts: str = "ts", timeout: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """Rising edges of samples that arrive in any order within a recording.

    Samples are numbered without gaps. A recording's state is the ends of the stretches that have come, so
    an edge is found once both of its samples have; of repeated samples the first to come counts. When the
    watermark (on ``ts``) passes a recording's last event by ``timeout``, its gaps are passed: there no edge
    is found, and samples that come later are dropped; after as long again its state goes. Until then a
    recording that was only paused goes on where it stood. Rows without a sample number or value only
    move the time on. Recordings are kept in ``buckets`` by a hash, each read and written as one; a stream
    with more open recordings than fit so should have more of them.
    """
    number, signal = F.col(order).cast("long"), F.col(value).cast("double")
    counts = number.isNotNull() & signal.isNotNull() & ~F.isnan(signal)
    rows = stream.select(F.col(run).cast("long").alias(run), F.coalesce(number, F.lit(0)).alias(order), F.coalesce(signal, F.lit(0.0)).alias(value), F.coalesce(counts, F.lit(False)).alias("counts"), F.unix_millis(ts).alias("ms"), ts)
    return _buckets(rows, [run], buckets).applyInPandasWithState(_edges(threshold, _millis(timeout), (run, order, value)), f"{run} long, {order} long, {value} double", _EDGES, "append", GroupStateTimeout.EventTimeTimeout)


def _rows_of(flat: np.ndarray, sizes: np.ndarray, width: int, rest: float) -> np.ndarray:
    """Lists of ``sizes``, one after the other in ``flat``, as rows of a matrix that ``rest`` fills up."""
    out = np.full((len(sizes), width), rest)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _shares(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


_STOPS = "runs array<long>, chars array<int>, until array<long>, done array<boolean>, steps array<int>, seen array<long>, cells array<int>, log array<double>"


def _stops(tau: float, low: int, high: int, eps: float, limit: int):
    """Early stopping for a bucket of characters, which take their next sequences together. The state has a value a
    character, and one after the other the sequences seen and the log evidence of those that are not decided."""
    kinds = (np.int64, np.int64, np.int64, bool, np.int64, np.int64, np.int64, float)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        runs, chars, until, done, steps, seen, cells, log = (np.asarray(v, t) for v, t in zip(state.get if state.exists else ([],) * 8, kinds, strict=True))
        n, out = len(runs), []
        of = np.repeat(np.arange(n), steps)

        def decide(who: np.ndarray, p: np.ndarray, stopped: np.ndarray | bool) -> None:
            if len(who):
                out.append(pd.DataFrame({"run": _shown(runs[who], key[0]), "char_idx": _shown(chars[who], key[1]), "decision": p.round(9).argmax(1), "confidence": p.max(1), "sequences_used": steps[who], "stopped": stopped}))

        if state.hasTimedOut:
            log = _rows_of(log, cells, cells.max(initial=0), -np.inf)
        else:
            new = pd.concat(list(frames), ignore_index=True)
            counts, seq = new["counts"].to_numpy(bool), new["seq_idx"].to_numpy(np.int64)
            runs, chars = np.r_[runs, _key(new, "run", key[0])], np.r_[chars, _key(new, "char_idx", key[1])]
            known = np.r_[np.ones(n, bool), counts]  # other rows only move the time on of keys that have one
            who, ids = pd.factorize(pd.factorize(runs)[0] * (1 << 32) + chars)
            first = np.zeros(len(ids), np.int64)
            first[who[::-1]] = np.arange(len(who))[::-1]
            known = np.bincount(who, known, len(ids)) > 0
            runs, chars, who = runs[first], chars[first], who[n:]  # keys of the state keep their places
            until, done, steps, cells = (np.r_[v, np.zeros(len(ids) - n, v.dtype)] for v in (until, done, steps, cells))
            until = _moved(until, who, counts, new["ms"], now, limit)

            use = np.flatnonzero(counts & ~done[who])
            use = use[~pd.DataFrame({"key": np.r_[of, who[use]], "seq": np.r_[seen, seq[use]]}).duplicated().to_numpy()[len(of) :]]
            use = use[np.lexsort((seq[use], who[use]))]
            at, seq = who[use], seq[use]
            turn = np.arange(len(at)) - np.searchsorted(at, at)
            posts = [np.asarray(p, float) for p in new["posterior"].iloc[use]]
            sizes = np.array([len(p) for p in posts], np.int64)
            before = cells.copy()
            cells[at[turn == 0]] = np.where(before[at], before[at], sizes)[turn == 0]
            if (cells[at] != sizes).any():
                raise ValueError("the posteriors of a character differ in length")
            width = cells.max(initial=0)
            log = _rows_of(log, before, width, -np.inf)
            log[(before == 0)[:, None] & (np.arange(width) < cells[:, None])] = 0.0
            gain = _rows_of(np.log(np.clip(np.concatenate([np.zeros(0), *posts]), eps, 1.0)), sizes, width, 0.0)
            for k in range(turn.max(initial=-1) + 1):
                rows = np.flatnonzero((turn == k) & ~done[at])
                if not len(rows):
                    break
                here = at[rows]
                log[here] += gain[rows]
                steps[here] += 1
                of, seen = np.r_[of, here], np.r_[seen, seq[rows]]
                p = _shares(log[here])
                sure = (steps[here] >= low) & (p.max(1) >= tau)
                end = sure | (steps[here] >= high)
                decide(here[end], p[end], sure[end])
                done[here[end]] = True

        due = until <= now
        weak = np.flatnonzero(due & ~done & (steps > 0))
        if len(weak):
            decide(weak, _shares(log[weak]), False)
        yield from out
        keep = ~due if state.hasTimedOut else known & ~due
        if not keep.any():
            state.remove()
            return
        held = keep & ~done
        order = np.argsort(of, kind="stable")
        order = order[held[of[order]]]
        steps, cells = np.where(done, 0, steps), np.where(done, 0, cells)
        full = log[held][np.arange(log.shape[1]) < cells[held][:, None]]
        state.update(tuple(v.tolist() for v in (runs[keep], chars[keep], until[keep], done[keep], steps[keep], seen[order], cells[keep], full)))
        state.setTimeoutTimestamp(int(until[keep].min()))

    return step


def stream_dynamic_stop(stream: DataFrame, tau: float = 0.8, min_sequences: int = 2, max_sequences: int = 10, eps: float = 1e-9, timeout: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """One decision per character as soon as its evidence suffices.

    ``stream`` has a posterior per sequence: (run, char_idx, seq_idx, posterior, ts) with a watermark on
    ``ts``. Sequences count in order of arrival, those of one micro-batch by number; repeated ones are
    ignored. A decided character keeps only a mark and drops what comes later; an abandoned one is decided
    on what it has when the watermark passes its last event by ``timeout``, and then no state is left.
    Rows without a posterior only move the time on. Characters are kept in ``buckets`` by a hash, each
    read and written as one; a stream with more open characters than fit so should have more of them.
    """
    counts = F.coalesce(F.col("seq_idx").isNotNull() & (F.size("posterior") > 0), F.lit(False))
    rows = stream.select(F.col("run").cast("long").alias("run"), F.col("char_idx").cast("int").alias("char_idx"), F.coalesce(F.col("seq_idx").cast("long"), F.lit(0)).alias("seq_idx"), "posterior", counts.alias("counts"), F.unix_millis("ts").alias("ms"), "ts")
    step = _stops(tau, min_sequences, max_sequences, eps, _millis(timeout))
    return _buckets(rows, ["run", "char_idx"], buckets).applyInPandasWithState(step, "run long, char_idx int, decision int, confidence double, sequences_used int, stopped boolean", _STOPS, "append", GroupStateTimeout.EventTimeTimeout)


class _Growth(_Timed):
    def __init__(self, cells: Sequence[tuple[str, int]], min_count: float, max_entropy: float, weight: float, limit: int, names: tuple[str, str, str]):
        self.cells, self.min_count, self.max_entropy, self.weight, self.limit, self.names = dict(cells), min_count, max_entropy, weight, limit, names
        self.columns = [names[0], names[1], "context", "cell_idx", "p", "reason", "phrases", "tokens", "late"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.size = handle.getValueState("size", "phrases long, tokens long, last long")
        self.follow = handle.getMapState("follow", "a string", "chars array<string>, n array<double>")
        self.waiting = handle.getListState("waiting", "pos long, context string, text string, ms long")

    def _answer(self, key: tuple, trials: list[tuple]) -> pd.DataFrame:
        """Priors of trials in their order, each learned after it is answered; only what the trials touch is read and written."""
        phrases, tokens, last = self.size.get() or (0, 0, -(1 << 62))
        table: dict[str, Counter] = {}
        changed, out = set(), []

        def successors(a: str) -> Counter:
            if a not in table:
                known = self.follow.getValue((a,)) if self.follow.containsKey((a,)) else ([], [])
                table[a] = Counter(dict(zip(*known, strict=True)))
            return table[a]

        for pos, context, text, _ in trials:
            good = {self.cells[c]: n for c, n in successors(context[-1:] or " ").items() if c in self.cells and n >= self.min_count}
            total = sum(good.values())
            shares = {c: n / total for c, n in good.items()}
            entropy = -sum(p * math.log(p) for p in shares.values()) / math.log(len(shares)) if len(shares) > 1 else 0.0
            reason = "no_matches" if not phrases else "below_min_count" if not shares else "high_entropy" if entropy > self.max_entropy else "available"
            rows = sorted(shares.items()) if reason == "available" else [(None, None)]
            out += [(key[0], pos, context, c, p, reason, phrases, tokens, pos <= last) for c, p in rows]
            last = max(last, pos)
            if not text:
                continue
            phrases, tokens = phrases + 1, tokens + len(text.split(" "))
            for a, b in zip(text, text[1:], strict=False):
                successors(a)[b] += self.weight
                changed.add(a)
        for a in changed:
            self.follow.updateValue((a,), (list(table[a]), [float(n) for n in table[a].values()]))
        self.size.update((phrases, tokens, last))
        frame = pd.DataFrame(out, columns=self.columns)
        return frame.astype({"cell_idx": "Int32", "p": "float64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, order, ts = self.names
        new = pd.concat(list(rows))
        newest = _newest(new[ts])
        new = new.dropna(subset=[order])
        if not len(new):
            return
        last = (self.size.get() or (0, 0, -(1 << 62)))[2]
        millis = (new[ts].astype("datetime64[ms]").astype("int64")).tolist()
        trials = sorted(zip(new[order].astype("int64").tolist(), new["context"].fillna("").tolist(), new["text"].fillna("").tolist(), millis, strict=True))
        late = [t for t in trials if t[0] <= last]
        if late:
            yield self._answer(key, late)
        wait = [t for t in trials if t[0] > last]
        if wait:
            self.waiting.appendList(wait)
            self.handle.registerTimer(max(t[3] for t in wait))
        self.close_at(newest, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        trials = sorted(self.waiting.get())
        due = [t for t in trials if t[3] <= now]
        if due:
            yield self._answer(key, due)
            self.waiting.clear()
            if len(due) < len(trials):
                self.waiting.appendList([t for t in trials if t[3] > now])
        closing = self.until.get()
        if closing and closing[0] <= now:
            for state in (self.size, self.follow, self.waiting, self.until):
                state.clear()


def stream_session_prior(stream: DataFrame, cells: DataFrame, subject: str = "subject", order: str = "pos", ts: str = "ts", min_count: float = 2, max_entropy: float = 0.65, weight: float = 1.0, timeout: str = "1 day") -> DataFrame:
    """For each trial of a session, the next-character prior from the phrases completed before it.

    ``stream`` has (subject, pos, context, text, ts) with a watermark on ``ts``, which rises with ``pos``.
    A trial waits until the watermark passes it, so trials may arrive in any order within the watermark's
    delay. The bank is a map with an entry for each character: what followed it in earlier phrases. Rows
    are (subject, pos, context, cell_idx, p, reason, phrases, tokens, late), one for each cell with a
    share, or one with null cell and the reason, as ``session_backoff`` gives them for a whole table. A
    trial behind one that is already answered is answered at once from the bank as it is, marked ``late``,
    and learned; rows behind the watermark are dropped. A session's state goes when the watermark passes its last event by ``timeout``.
    """
    known = [(r["ch"], r["cell_idx"]) for r in cells.select("ch", "cell_idx").collect()]  # the grid
    rows = stream.select(F.col(subject).cast("string").alias(subject), F.col(order).cast("long").alias(order), normalize_context(F.col("context")).alias("context"), normalize_text(F.col("text")).alias("text"), ts)
    kind = f"{subject} string, {order} long, context string, cell_idx int, p double, reason string, phrases long, tokens long, late boolean"
    return rows.groupBy(subject).transformWithStateInPandas(_Growth(known, min_count, max_entropy, weight, _millis(timeout), (subject, order, ts)), kind, "append", "eventTime")


def stream_phrase_growth(stream: DataFrame, subject: str = "subject", order: str = "pos", text: str = "text") -> DataFrame:
    """For each completed phrase, what its subject's bank held before: phrases, words and bigrams.

    Phrases of a subject must arrive in order over micro-batches; inside one they are sorted.
    """

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phrases, tokens, pairs, counts = state.get if state.exists else (0, 0, [], [])
        table = dict(zip(pairs, counts, strict=True))
        out = []
        for pos, phrase in pd.concat(list(frames)).sort_values(order)[[order, text]].itertuples(index=False):
            out.append((key[0], pos, phrases, tokens, sum(table.values())))
            phrases, tokens = phrases + 1, tokens + len(phrase.split())
            for a, b in zip(phrase, phrase[1:], strict=False):
                table[a + b] = table.get(a + b, 0) + 1
        state.update((phrases, tokens, list(table), list(table.values())))
        yield pd.DataFrame(out, columns=[subject, order, "phrases", "tokens", "bigrams"])

    return stream.groupBy(subject).applyInPandasWithState(grow, f"{subject} string, {order} long, phrases long, tokens long, bigrams long", "phrases long, tokens long, pairs array<string>, counts array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_metrics(stream: DataFrame, watermark: str = "1 hour", window: str = "1 day", ts: str = "ts", by: str = "condition", cells: int = 72, seconds_per_flash: float = 0.2) -> DataFrame:
    """Characters, accuracy, flashes and bits a minute per condition and time window; rows behind the watermark are dropped."""
    out = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window), by).agg(
        F.count(F.lit(1)).alias("characters"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("flashes_used").alias("flashes")
    )
    return out.withColumn("itr", itr(cells, F.col("accuracy"), F.col("flashes") * seconds_per_flash))
