"""Benchmark decontamination by template canonicalisation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, free, saved, text_key

#: Unit words that count as a slot after a number.
UNITS = "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp kb mb gb tb hz khz mhz ghz v w kw j kj cal kcal".split()
NUMBER, NAME, UNIT = "#n", "#p", "#u"
BROADCAST_ROWS = 200_000


def _spaced(text: Column) -> Column:
    """Runs of letters or digits, one space between; a number and the letters at it are two tokens."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+|(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})", " ")
    return F.trim(apart)


def _canonical(spaced: Column) -> Column:
    """The same tokens: digits become #n, capitalised words #p, unit words after a number #u, others lower case."""
    c = F.regexp_replace(spaced, r"(?<![^ ])\p{N}+(?![^ ])", NUMBER)
    c = F.regexp_replace(c, r"(?<![^ ])\p{Lu}\p{Ll}+(?![^ ])", NAME)
    return F.regexp_replace(F.lower(c), f"(?<=#n )({'|'.join(UNITS)})(?![^ ])", UNIT)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def _good(docs: DataFrame, bench: DataFrame, width: int = 12, min_literals: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(t1, t2, item_id, fits, n, slots, same): alignments that leaks() accepts, by the hash of the text, so a text and all its copies are one."""
    spaced = bench.select(F.col(item_col).alias("item_id"), _spaced(F.col(item_text)).alias("spaced")).where("spaced <> ''").distinct()
    # Items without an id are told apart by their text.
    items = spaced.select("item_id", F.when(F.col("item_id").isNull(), F.xxhash64("spaced")).alias("ih"), _tokens("spaced").alias("raw"), _tokens(_canonical(F.col("spaced"))).alias("can"))
    items = items.withColumn("width", F.least(F.size("can"), F.lit(width)))
    at = F.sequence(F.lit(1), F.size("can") - F.col("width") + 1)
    low = F.size(F.filter("part", lambda x: ~x.startswith("#"))) < F.col("width") * min_literals
    wins = items.withColumn("ipos", F.explode(at)).withColumn("part", F.slice("can", F.col("ipos"), F.col("width"))).withColumn("low", low).withColumn("iraw", F.slice("raw", F.col("ipos"), F.col("width")))
    # The second key of a window of mostly placeholders is its raw tokens; the others have none.
    exact = lambda raw: F.when(F.col("low"), F.xxhash64(F.transform(raw, lambda x: F.xxhash64(x)))).otherwise(F.lit(0).cast("long"))
    wins = saved(wins.select("item_id", "ih", "ipos", "width", "low", F.xxhash64("width", F.transform("part", lambda x: F.xxhash64(x))).alias("h"), exact(F.col("iraw")).alias("rh"), "part", "iraw"), "bench-windows")
    widths = sorted(r[0] for r in wins.select("width").distinct().collect()) or [width]  # at most `width` values
    small = wins.count() <= BROADCAST_ROWS

    t1, t2 = text_key(F.col(text_col))
    d = docs.select(F.col(text_col).alias("text"), t1.alias("t1"), t2.alias("t2")).where("text <> ''")
    hashed = d.select("t1", "t2", F.transform(_tokens(_canonical(_spaced(F.col("text")))), lambda x: F.xxhash64(x)).alias("hs"))

    def windows(w: int) -> Column:
        places = F.when(F.size("hs") >= w, F.sequence(F.lit(1), F.size("hs") - w + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.lit(w), F.slice("hs", i, w)))

    # One pass over the texts, whatever widths there are: the windows of each width, one after the other, as bare numbers.
    rows = hashed.select("t1", "t2", F.size("hs").alias("n"), F.posexplode(F.concat(*map(windows, widths))).alias("at", "h"))
    keys = wins.select("h", "width").distinct()
    found = rows.join(F.broadcast(keys) if small else keys, "h")
    before: Column = F.lit(0)
    for i, w in enumerate(widths[1:], 1):
        before = F.when(F.col("width") == w, sum((F.greatest(F.col("n") - x + 1, F.lit(0)) for x in widths[:i]), F.lit(0))).otherwise(before)
    found = found.withColumn("pos", (F.col("at") - before + 1).cast("int"))
    # Matched positions, per text; then their raw tokens are fetched from the few texts that match.
    spots = saved(found.groupBy("t1", "t2").agg(F.collect_set(F.struct("pos", "h")).alias("spots")), "bench-spots")
    few = spots.count() <= BROADCAST_ROWS // 20
    texts = d.join(F.broadcast(spots.select("t1", "t2")) if few else spots.select("t1", "t2"), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    cut = texts.join(spots, ["t1", "t2"]).withColumn("raw", _tokens(_spaced(F.col("text")))).withColumn("s", F.explode("spots"))
    one = wins.select(F.col("h").alias("wh"), "width", "low").distinct()
    cut = cut.join(F.broadcast(one) if small else one, F.col("s.h") == F.col("wh")).select("t1", "t2", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"), "low", F.slice("raw", F.col("s.pos"), F.col("width")).alias("draw"))
    cut = cut.withColumn("rh", exact(F.col("draw"))).drop("low")
    pairs = cut.join(F.broadcast(wins) if small else wins, ["h", "rh"])
    slots = F.filter(F.arrays_zip("part", "iraw", "draw"), lambda z: z["part"].startswith("#"))
    pairs = pairs.select("t1", "t2", "item_id", "ih", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos", "low", (F.col("iraw") == F.col("draw")).alias("verbatim"), slots.alias("slots"))
    of = lambda kind: [F.countDistinct(F.when(kind, F.col("ipos"))), F.array_distinct(F.flatten(F.collect_set(F.when(kind, F.col("slots")))))]
    (n, map_), (n_own, map_own) = of(~F.col("low")), of(F.col("verbatim"))
    lines = pairs.groupBy("t1", "t2", "item_id", "ih", "diag").agg(n.alias("n"), map_.alias("map"), n_own.alias("n_own"), map_own.alias("map_own"))
    n_from = F.size(F.array_distinct(F.transform("map", lambda z: F.struct(z["part"], z["iraw"]))))
    n_to = F.size(F.array_distinct(F.transform("map", lambda z: F.struct(z["part"], z["draw"]))))
    fits = lines.withColumn("fits", (F.col("n") > 0) & (n_from == F.size("map")) & (n_to == F.size("map"))).where("fits or n_own > 0")
    same = F.forall("map", lambda z: z["iraw"] == z["draw"])
    out = fits.select("t1", "t2", "item_id", "fits", F.when(F.col("fits"), F.col("n")).otherwise(F.col("n_own")).alias("n"), F.size(F.when(F.col("fits"), F.col("map")).otherwise(F.col("map_own"))).alias("slots"), (~F.col("fits") | same).alias("same"))
    out = saved(out, "bench-alignments")
    drop(wins, spots)
    return out


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, exact): documents that hold a passage of a benchmark item, its slots filled alike or anew.

    A passage is a window of `width` tokens; an item of fewer tokens, down to one, is found by all
    of them. A document token is a run of letters or of digits; a placeholder stands for every run of digits,
    every word that begins with a capital (sentence heads and German nouns too) and unit words after a number. Windows of
    which the share min_literals at least is no placeholder are compared by template, the
    others (names, numbers) by their own tokens, without freedom in the slots.
    Template matches of one alignment (document position less item position) must replace slots
    consistently: a value of the item always by the same value, and different values of a
    kind by different ones. Windows with the item's own tokens are copies, whatever the rest of their alignment holds.
    n_windows and n_slots are those of the best alignment: one that is consistent counts its template windows, another
    its copied ones; exact says that one has the item's own values in every slot counted. Null and empty texts hold nothing;
    null ids are kept as null, those of items too (one row for all); rows that repeat an id count as one document; an empty
    table gives no rows; other columns are ignored.
    """
    good = _good(docs, bench, text_col=text_col, **options)
    t1, t2 = text_key(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"))
    hit = rows.join(F.broadcast(good) if good.count() <= BROADCAST_ROWS else good, ["t1", "t2"])
    best = F.max(F.struct("fits", "n", "slots"))
    return hit.groupBy("doc_id", "item_id").agg(best["n"].cast("long").alias("n_windows"), best["slots"].cast("long").alias("n_slots"), F.bool_or("same").alias("exact"))


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a passage (see leaks); other rows of the same id, or without one, stay. Any column names."""
    found = _good(docs, bench, text_col=text_col, **options)
    b1, b2 = free(docs, "t1", "t2")
    bad = found.select(F.col("t1").alias(b1), F.col("t2").alias(b2)).distinct()
    t1, t2 = text_key(F.col(text_col))
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, (t1 == F.col(b1)) & (t2 == F.col(b2)), "left_anti")
