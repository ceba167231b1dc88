"""Trials, leakage-safe splits, sampling, folds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_percent


def char_trials(registry: DataFrame, id_col: str = "session_id", text_col: str = "target_text") -> DataFrame:
    """One row per character of each target: position, character and the text before it."""
    chars = registry.select(id_col, text_col, F.posexplode(F.split(text_col, "")).alias("char_idx", "target_char")).where("target_char <> ''")
    return chars.select(id_col, "char_idx", "target_char", F.expr(f"substring({text_col}, 1, char_idx)").alias("context"))


def _key_pattern(keys: Sequence[str]) -> str:
    longest = sorted((k for k in keys if k), key=lambda k: (-len(k), k))
    return "|".join([*(re.escape(k) for k in longest), "[a-z]"])


def tokenize_keys(registry: DataFrame, keys: Sequence[str], id_col: str = "session_id", text_col: str = "target_text", strict: bool = True) -> DataFrame:
    """Split targets into keys: the longest key that matches, else one lower-case letter as its
    upper-case key. Text that no key covers raises an error (or, if not ``strict``, is dropped)."""
    pattern = _key_pattern(keys)
    known = F.array(*[F.lit(k) for k in keys])
    tokens = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"({pattern})"), 1), lambda t: F.when(F.array_contains(known, t), t).otherwise(F.upper(t)))
    rest = F.regexp_replace(F.col(text_col), pattern, "")
    if strict:
        tokens = F.when(rest == "", tokens).otherwise(F.raise_error(F.concat(F.lit("no key for "), rest)))
    return registry.select(id_col, tokens.alias("keys"))


def key_context(tokens: DataFrame, id_col: str = "session_id") -> DataFrame:
    """For each key its position and the text of the keys before it; long keys stand between spaces."""
    shown = F.transform("keys", lambda k: F.when(F.length(k) > 1, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(k))
    rows = tokens.select(id_col, "keys", shown.alias("shown")).select(id_col, "shown", F.posexplode("keys").alias("key_idx", "key"))
    return rows.select(id_col, "key_idx", "key", F.array_join(F.slice("shown", F.lit(1), F.col("key_idx")), "").alias("context"))


def map_special_keys(keys: DataFrame, keymap: DataFrame, key_col: str = "key") -> DataFrame:
    """Add ``text``: what a special key types, else the key in lower case."""
    return keys.join(keymap.select(F.col("key").alias("_key"), F.col("text").alias("_text")), F.col(key_col) == F.col("_key"), "left").select(*keys.columns, F.coalesce("_text", F.lower(key_col)).alias("text"))


def clean_training_pool(runs: DataFrame, heldout: DataFrame, id_col: str = "session_id") -> DataFrame:
    """Training runs that are not held out; a Test run in the result is an error."""
    pool = runs.where(F.col(id_col).contains("Train")).join(heldout.select(id_col).distinct(), id_col, "left_anti")
    return pool.withColumn(id_col, F.when(F.col(id_col).contains("Test"), F.raise_error(F.concat(F.lit("a test run in the training pool: "), F.col(id_col))).cast("string")).otherwise(F.col(id_col)))


def split_violations(runs: DataFrame, heldout: DataFrame, id_col: str = "session_id") -> DataFrame:
    """Runs that would leak: held out, or marked as Test."""
    out = heldout.select(F.col(id_col).alias("_h")).distinct()
    joined = runs.select(id_col).join(out, F.col(id_col) == F.col("_h"), "left")
    reason = F.when(F.col("_h").isNotNull(), "held out").when(F.col(id_col).contains("Test"), "test label")
    return joined.select(id_col, reason.alias("reason")).where("reason is not null")


def partition_label_vault(registry: DataFrame, vault: DataFrame, heldout: DataFrame, id_col: str = "session_id", text_col: str = "target_text") -> tuple[DataFrame, DataFrame]:
    """(visible, vault): safe training labels stay visible, the rest replaces or joins the vault."""
    safe = clean_training_pool(registry, heldout, id_col).select(id_col, text_col)
    rest = registry.join(safe.select(id_col), id_col, "left_anti").select(id_col, text_col)
    return safe, vault.select(id_col, text_col).join(rest.select(id_col), id_col, "left_anti").unionByName(rest)


def hash_split(df: DataFrame, id_col: str, salt: str, pct: int = 20) -> DataFrame:
    """Mark rows as held out by a salted hash of their id; stable over runs and machines."""
    return df.withColumn("held_out", hash_percent(F.col(id_col), salt) < pct)


def select_eval_sessions(trials: DataFrame, heldout: DataFrame | None = None, ids: Sequence[str] | None = None, id_col: str = "session_id") -> DataFrame:
    """Explicit ids, else the manifest, else all sessions marked as Test."""
    if ids is not None:
        return trials.where(F.col(id_col).isin(list(ids)))
    if heldout is not None:
        return trials.join(heldout.select(id_col).distinct(), id_col, "left_semi")
    return trials.where(F.col(id_col).contains("Test"))


def _draw(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def balanced_sample(df: DataFrame, label: str, n: int, seed: int, id_col: str, proportional: bool = False) -> DataFrame:
    """At most n / 2 rows of each class (or in proportion), drawn by a seeded hash of the id.

    A class's quota becomes a threshold on the leading hash bits plus a small surplus, so only
    the surplus is ordered, not the class.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    if proportional:
        total = sizes.agg(F.sum("_size")).first()[0] or 0
        quota = F.floor(F.col("_size") * F.lit(min(1.0, n / max(total, 1))))
    else:
        quota = F.least(F.col("_size"), F.lit(n // 2))
    quotas = sizes.select(F.col(label).alias("_label"), "_size", quota.alias("_quota"))
    near = df.join(quotas, df[label].eqNullSafe(F.col("_label"))).withColumn("_draw", _draw(seed, id_col))
    lead = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = near.where(lead <= (F.col("_quota") + 6 * F.sqrt(F.col("_quota").cast("double")) + 32) / F.col("_size"))
    order = Window.partitionBy("_label").orderBy("_draw", id_col)
    return near.withColumn("_rank", F.row_number().over(order)).where("_rank <= _quota").select(*df.columns)


def _greedy(sizes: Sequence[int], k: int) -> list[int]:
    """Fold of each size, the largest first (ties in the order given): the one with fewest rows so far."""
    loads, folds = [(0, f) for f in range(k)], [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, f = heapq.heappop(loads)
        heapq.heappush(loads, (load + sizes[at], f))
        folds[at] = f
    return folds


def _group_sizes(df: DataFrame, group: str, most: int) -> tuple[list, list[int]]:
    """The ``most`` largest groups and their rows."""
    top = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(most).collect()
    return [r[group] for r in top], [r["n"] for r in top]


def _with_folds(df: DataFrame, group: str, rows: list[tuple], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add columns of a table of groups, or their defaults for groups that it lacks."""
    kinds = ", ".join(f"_{c} {kind}" for c, (kind, _) in columns.items())
    table = df.sparkSession.createDataFrame(rows, f"_group {dict(df.dtypes)[group]}, _known boolean, {kinds}")
    out = df.join(F.broadcast(table), df[group].eqNullSafe(F.col("_group")), "left")  # at most ``most_groups`` rows
    return out.select(*[df[c] for c in df.columns], *[F.when(F.col("_known"), F.col(f"_{c}")).otherwise(rest).alias(c) for c, (_, rest) in columns.items()])


def group_kfold(df: DataFrame, group: str, k: int, most_groups: int = 500_000) -> DataFrame:
    """Add ``fold``: groups go, largest first, to the fold with fewest rows; null is a group like any other.

    The greedy pass runs on the driver over the ``most_groups`` largest groups. Any others, smaller than
    all these, go to folds by a hash, which balances so many by itself.
    """
    groups, sizes = _group_sizes(df, group, most_groups)
    rows = [(g, True, f) for g, f in zip(groups, _greedy(sizes, k), strict=True)]
    return _with_folds(df, group, rows, {"fold": ("int", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))})


def nested_folds(df: DataFrame, group: str, outer: int, inner: int, most_groups: int = 500_000) -> DataFrame:
    """Add ``fold``, and ``inner``: for each other fold f, the inner fold among the rows outside f.

    All folds come from one count of groups; they are those of ``group_kfold`` on the whole table, and on
    what is left without each fold.
    """
    groups, sizes = _group_sizes(df, group, most_groups)
    fold = _greedy(sizes, outer)
    inside = [[None] * outer for _ in groups]
    for f in range(outer):
        rest = [i for i in range(len(groups)) if fold[i] != f]
        for i, g in zip(rest, _greedy([sizes[i] for i in rest], inner), strict=True):
            inside[i][f] = g
    rows = [(g, True, o, i) for g, o, i in zip(groups, fold, inside, strict=True)]
    own = F.pmod(F.xxhash64(group), F.lit(outer)).cast("int")
    rest = F.array(*[F.when(own != f, F.pmod(F.xxhash64(F.lit(f), group), F.lit(inner)).cast("int")) for f in range(outer)])
    return _with_folds(df, group, rows, {"fold": ("int", own), "inner": ("array<int>", rest)})


def protocol_audit(runs: DataFrame, heldout: DataFrame, id_col: str = "session_id") -> DataFrame:
    """Pool sizes per condition and phase: runs, held out, and held-out runs that are in training."""
    out = heldout.select(F.col(id_col).alias("_h")).distinct()
    condition = F.when(F.col(id_col).contains("DynBigram"), "DynBigram").when(F.col(id_col).contains("Dyn"), "Dyn").otherwise("RC")
    phase = F.when(F.col(id_col).contains("Train"), "Train").otherwise("Test")
    joined = runs.join(out, F.col(id_col) == F.col("_h"), "left").select(condition.alias("condition"), phase.alias("phase"), F.col("_h").isNotNull().alias("held"))
    return joined.groupBy("condition", "phase").agg(F.count(F.lit(1)).alias("runs"), F.count_if("held").alias("held_out"), F.count_if(F.col("held") & (F.col("phase") == "Train")).alias("overlap"))


def _phased(runs: DataFrame, id_col: str) -> DataFrame:
    condition = F.when(F.col(id_col).contains("DynBigram"), "DynBigram").when(F.col(id_col).contains("Dyn"), "Dyn").otherwise("RC")
    return runs.withColumn("condition", condition).withColumn("phase", F.when(F.col(id_col).contains("Train"), "Train").otherwise("Test"))


def protocol_overlaps(runs: DataFrame, heldout: DataFrame, id_col: str = "session_id") -> DataFrame:
    """The runs that break the protocol: (id, condition, phase, held_out, test_labelled), one row each.

    ``runs`` are those a model trains on; held-out ones and ones of the test phase should not be there.
    """
    out = heldout.select(F.col(id_col).alias("_h")).distinct()
    rows = _phased(runs.select(id_col).distinct(), id_col).join(out, F.col(id_col) == F.col("_h"), "left")
    rows = rows.withColumn("held_out", F.col("_h").isNotNull()).withColumn("test_labelled", F.col("phase") == "Test").drop("_h")
    return rows.where("held_out or test_labelled")


def target_counts(flashes: DataFrame, subject: str = "subject", run: str = "run", y: str = "y") -> DataFrame:
    """Target and other flashes, and runs, that each subject has in a training pool."""
    return flashes.groupBy(subject).agg(F.count_if(F.col(y) == 1).alias("target"), F.count_if(F.col(y) == 0).alias("non_target"), F.countDistinct(run).alias("runs"))


def usable_characters(flashes: DataFrame, n_codes: int, min_sequences: int = 1, keys: Sequence[str] = ("run", "char_idx")) -> DataFrame:
    """Characters with at least ``min_sequences`` sequences that have a valid code."""
    return flashes.where(F.col("stim_code").between(1, n_codes)).groupBy(*keys).agg(F.countDistinct("seq_idx").alias("sequences")).where(F.col("sequences") >= min_sequences)


def complete_subjects(results: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per subject that has every method, a column for each."""
    wide = results.where(F.col("method").isin(list(methods))).groupBy("subject").pivot("method", list(methods)).agg(F.first("metric"))
    return wide.dropna(subset=list(methods))
