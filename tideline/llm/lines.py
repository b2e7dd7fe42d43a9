"""Cross-site boilerplate line removal by distinct-site spread."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, free, saved, text_key

#: Log2 of the buckets of a HyperLogLog sketch; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Rows of 24 bytes up to which a checked table is broadcast, or sent along with the look at each document's lines.
BROADCAST_ROWS = 200_000


def _key(line: Column) -> tuple[Column, Column]:
    """128 bits from two independent seeds: equal keys are taken for equal lines."""
    return F.xxhash64(line), F.xxhash64(F.lit(8), line)


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line that holds more than white space: (id, t1, t2, pos, h1, h2, site)."""
    t1, t2 = text_key(F.col(text_col))
    d = docs.select(F.col(id_col).cast("long").alias("id"), t1.alias("t1"), t2.alias("t2"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    h1, h2 = _key(F.col("line"))
    return d.where(F.trim("line", F.lit(" \t\r\x0b\x0c")) != "").select("id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"), "site")


def boilerplate(docs: DataFrame, min_sites: int = 6, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h1, h2, first_id): lines found on at least min_sites distinct sites.

    Sketches are merged by partial aggregation, so a line that a third of all documents
    hold costs a row per task. Lines whose estimate lies within five standard errors (at
    least one site) of the threshold are counted exactly; further ones are decided by
    the estimate.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    margin = max(1.0, 5 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min("id").alias("first_id")).where(F.col("sites") >= min_sites - margin)
    spread = saved(spread, "line-spread")
    near = spread.where(F.col("sites") <= min_sites + margin).select("h1", "h2")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    exact = lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    out = spread.join(exact, ["h1", "h2"], "left").where(F.coalesce(F.col("exact"), F.lit(min_sites)) >= min_sites).select("h1", "h2", "first_id")
    out = saved(out, "line-boilerplate")
    drop(spread)
    return out


def _finder(bad: DataFrame) -> Callable[..., Column]:
    """(id, h1 of every line, h2 of every line) -> places of the lines to cut, by binary search in the boilerplate that goes with it."""
    t = bad.toArrow()
    k1, k2 = (t.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2"))
    first = t.column("first_id")
    none, first = first.is_null().to_numpy(), first.fill_null(0).to_numpy().astype(np.int64)
    order = np.lexsort((k2, k1))
    k1, k2, none, first = k1[order], k2[order], none[order], first[order]
    most = int(np.unique(k1, return_counts=True)[1].max()) if len(k1) else 0  # keys that share their first half

    @F.arrow_udf("array<int>")
    def find(ids: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        sizes = h1.value_lengths().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        a, b = h1.flatten().to_numpy(), h2.flatten().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        no_id, own = ids.is_null().to_numpy(zero_copy_only=False)[row], ids.fill_null(0).to_numpy()[row]
        at, cut = np.searchsorted(k1, a), np.zeros(len(a), bool)
        for step in range(most):
            k = np.minimum(at + step, len(k1) - 1)
            same = (k1[k] == a) & (k2[k] == b) & (at + step < len(k1))
            cut |= same & ~((none[k] & no_id) | (~none[k] & ~no_id & (first[k] == own)))
        place = (np.arange(len(a)) - starts[row])[cut].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[cut], minlength=len(sizes)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(place))

    return find


def remove_boilerplate(docs: DataFrame, min_sites: int = 6, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with boilerplate lines cut from the text, plus n_lines and n_removed.

    A line is boilerplate if it occurs on min_sites distinct sites or more (a null site
    is one site); its copies go everywhere but in the document with the smallest id that
    holds it, so nothing is lost altogether. Lines are the pieces between line feeds and
    compared exactly; lines of white space only are never boilerplate. Texts that lose
    nothing come back as they were (null stays null, with no lines; '' has one). Rows
    that repeat get equal results, null ids sort last (rows without id count as one
    document), and an empty table stays empty.
    Columns named n_lines or n_removed are replaced; others may have any name.
    With up to BROADCAST_ROWS boilerplate lines every document is cut where it lies; with more, the places
    of the cuts are joined to the documents.
    """
    bad = boilerplate(docs, min_sites, id_col, text_col, site_col)
    i, p1, p2, gone = free(docs, "id", "t1", "t2", "gone")
    own = docs.drop("n_lines", "n_removed")
    if bad.count() <= BROADCAST_ROWS:
        lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
        h1, h2 = F.transform(lines, lambda x: _key(x)[0]), F.transform(lines, lambda x: _key(x)[1])
        found = _finder(bad)(F.col(id_col).cast("long"), h1, h2)
        return _cut(own.withColumn(gone, found).withColumn(gone, F.when(F.size(gone) > 0, F.col(gone))), own.columns, text_col, gone)
    hits = _lines(docs, id_col, text_col, site_col).join(bad, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first_id")))
    # Rows of one text lose the same lines but where one of them keeps a line as the first to hold it.
    cut_at = saved(hits.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone")), "line-cuts")
    side = cut_at.select(F.col("id").alias(i), F.col("t1").alias(p1), F.col("t2").alias(p2), F.col("gone").alias(gone))
    t1, t2 = text_key(F.col(text_col))
    d = own.join(F.broadcast(side) if cut_at.count() <= BROADCAST_ROWS // 8 else side, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (t1 == F.col(p1)) & (t2 == F.col(p2)), "left")
    return _cut(d, own.columns, text_col, gone)


def _cut(d: DataFrame, columns: list[str], text_col: str, gone: str) -> DataFrame:
    """The columns, with the lines at the places in `gone` (null: none) cut from the text, and both counts."""
    parts = F.split(text_col, "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    cut = F.array_join(F.transform(rest, lambda k: F.get(parts, k)), "\n")
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(F.regexp_replace(text_col, "[^\n]", "")) + 1).cast("long")
    lost = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    return d.select(*[F.when(F.col(gone).isNotNull(), cut).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in columns], n.alias("n_lines"), lost.alias("n_removed"))
