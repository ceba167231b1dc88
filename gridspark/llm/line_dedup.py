"""Line dedup by winnowing; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2, least: int | None = None, alone: int | None = None) -> DataFrame:
    """The input's columns with later repeats of runs of lines deleted from the text.

    Adds n_lines and n_removed. Lines are split at newlines and told apart by two hashes of 60 and
    64 bits; lines of white space only are no part of a run and always stay. Runs are judged on the
    input. A run starts earlier where it starts in a row with a smaller id, or further up in the
    same row.

    Lines are ordered by their hash, lines that occur once after all others, for they match
    nothing. The first line of each ``window`` neighbouring ones in this order is a fingerprint, so
    each repeated run of ``window`` lines holds one, and so does each repeated line whose
    neighbours are its own. A line that is a fingerprint anywhere is an anchor at all its places.
    From an anchor a match is extended up and down: each run of ``least`` (default ``window``) to
    ``window`` lines that holds the anchor is compared with the first place of the same run, and
    longer matches are the union of those runs. With ``alone``, the anchor by itself counts too if
    it has that many characters, so a match that cannot be extended is cut as well. All runs of
    ``window`` lines that also start earlier are deleted; shorter ones if they hold an anchor.
    Only first places travel, never pairs of places, so a line that a third of all rows hold costs
    its own rows.

    Null texts stay null and have no lines. Rows with null ids come first. Rows with the same id
    and text count as one document: each gets the same result. Very long texts cost time in
    proportion to their lines; an empty table gives no rows. Extra columns are passed on; an input
    column called n_lines or n_removed, in any case, is replaced; names that start with _cut are
    taken.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"))
    second = F.lit(7)  # another seed
    least = window if least is None else least

    def unit(x, i):
        solid = F.trim(x, F.lit(" \t\r\x0b\x0c")) != ""
        order = F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")
        long = F.lit(False) if alone is None else F.length(x) >= alone
        return F.struct(i.alias("i"), F.when(solid, order).alias("h"), F.xxhash64(second, x).alias("g"), long.alias("single"))

    lines = F.filter(F.transform(F.split(text, "\n"), unit), lambda s: s["h"].isNotNull())
    units = docs.select(key.alias("key"), F.posexplode(lines).alias("j", "unit"))
    units = materialize(units.select("key", "j", "unit.*"), "line-units")
    place = F.xxhash64("key", "j")
    shared = units.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("h")
    shared = materialize(shared, "line-shared")
    rows = units.join(shared, "h").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("j", "i", "h", "g", "single"))).alias("lines"))
    rows = materialize(rows, "line-rows")  # lines that occur once are left out here
    discard(units, shared)

    me = F.col("me")
    top = F.greatest(F.col("k") - window + 2, F.lit(1))
    around = F.slice("lines", top, F.least(F.col("k") + window, F.size("lines")) - top + 1)
    prints = rows.select("key", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("k"))
    prints = prints.select("key", F.element_at("lines", F.col("k") + 1).alias("me"), around.alias("around"))
    prints = prints.select("key", "me", F.filter("around", lambda s: F.abs(s["j"] - me["j"]) < window).alias("near"))

    def smaller(side) -> Column:
        """Distance to the next line of a smaller hash on one side, ``window`` if there is none so near."""
        lower = F.filter("near", lambda s: (s["h"] < me["h"]) & side(s["j"], me["j"]))
        return F.coalesce(F.array_min(F.transform(lower, lambda s: F.abs(s["j"] - me["j"]))), F.lit(window))

    mark = smaller(lambda a, b: a < b) + smaller(lambda a, b: a > b) > window  # a window around it fits in between
    prints = materialize(prints.select("key", me["h"].alias("print"), me["j"].alias("j"), me["single"].alias("single"), "near", mark.alias("mark")), "line-prints")
    anchors = materialize(prints.where("mark").select("print").distinct(), "line-anchors")
    found = prints.join(anchors, "print")
    found = found.withColumn("at", F.size(F.filter("near", lambda s: s["j"] < F.col("j"))) + 1)

    def run_of(before: int, n: int) -> Column:
        """The run of ``n`` lines with ``before`` of them above the anchor; null if there is none."""
        start = F.col("at") - before
        end = start + n - 1
        whole = (start >= 1) & (end <= F.size("near")) & (F.get("near.j", end - 1) - F.get("near.j", start - 1) == n - 1)
        if n < least:
            whole = whole & F.col("single")
        hashes, checks, at = (F.slice(f"near.{c}", start, n) for c in "hgi")
        return F.when(whole, F.struct(F.xxhash64(hashes).alias("run"), F.xxhash64(second, checks).alias("check"), at.alias("at")))

    sizes = {*range(least, window + 1), *([1] if alone is not None else [])}
    runs = F.array(*[run_of(before, n) for n in sorted(sizes) for before in range(n)])
    places = materialize(found.select("key", F.inline(F.array_compact(runs))), "line-runs")
    discard(rows, prints, anchors)
    place = F.struct("key", F.col("at")[0].alias("first"))
    firsts = places.groupBy("run", "check").agg(F.min(place).alias("origin"), F.max(place).alias("last")).where(F.col("origin") < F.col("last"))
    firsts = materialize(firsts.select("run", "check", "origin"), "line-firsts")
    later = places.join(firsts, ["run", "check"]).where(place > F.col("origin"))
    cuts = later.select("key", F.explode("at").alias("i")).groupBy("key").agg(F.collect_set("i").alias("cut"))
    cuts = cuts.select(F.col("key.id").alias("_cut_id"), F.col("key.t").alias("_cut_text"), F.col("cut").alias("_cut"))

    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    own = docs.drop("n_lines", "n_removed").withColumn("_cut_key", F.xxhash64(text))
    joined = own.join(cuts, own[id_col].eqNullSafe(cuts["_cut_id"]) & (own["_cut_key"] == cuts["_cut_text"]), "left")
    joined = joined.withColumn("_cut_lines", F.split(F.col(text_col), "\n"))  # split once for each row
    rest = F.array_except(F.sequence(F.lit(0), F.size("_cut_lines") - 1), "_cut")
    new = F.concat_ws("\n", F.transform(rest, lambda i: F.get("_cut_lines", i)))
    out = [F.when(F.col("_cut").isNull(), F.col(c)).otherwise(new).alias(c) if c.lower() == text_col.lower() else F.col(c) for c in kept]
    return joined.select(
        *out,
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_cut_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("n_removed"),
    )
