"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, saved
from .graph import components, forest

BITS = 64
#: Distinct fingerprints from which on a tile is keyed by more bits: 4 bands of 16 bits, each alone; 5 bands, by two (25 bits or
#: more); 6 bands, by three (31 or more).
WIDER = ((0, 4), (1 << 22, 5), (1 << 28, 6))
#: Rows of a tile that one comparison holds; larger tiles are split and compared in pairs.
TILE = 512


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one whole text: XXH64 (seed 42) of each space-joined word shingle, A-Z lowered; 0 without words."""
    import xxhash

    digest, parts = xxhash.xxh64_digest, (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return int.from_bytes(digest(b" ".join(parts), 42), "big")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones = len(parts) - words + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        upto = min(n, at + (1 << 14))
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at:upto].tolist(), ends[at + words - 1 : upto + words - 1].tolist())])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes (unsigned longs), as a signed long; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed long. Null and empty texts: 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def tile_links(x: np.ndarray, radius: int, y: np.ndarray | None = None, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into x, into y or x) at Hamming distance 0..radius.

    Both sides are cut into tiles in order of their population counts; a pair of tiles
    whose counts lie further apart than the radius can hold no link and is skipped.
    """
    other = x if y is None else y
    px, py = np.bitwise_count(x), np.bitwise_count(other)
    ox, oy = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    left, right = [], []
    for i in range(0, len(ox), size):
        ti = ox[i : i + size]
        for j in range(i if y is None else 0, len(oy), size):
            tj = oy[j : j + size]
            if int(py[tj[0]]) - int(px[ti[-1]]) > radius:
                break
            if int(px[ti[0]]) - int(py[tj[-1]]) > radius:
                continue
            r, c = np.nonzero(np.bitwise_count(x[ti][:, None] ^ other[tj][None, :]) <= radius)
            if y is None and i == j:
                keep = r < c
                r, c = r[keep], c[keep]
            left.append(ti[r])
            right.append(tj[c])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _unit_edges(unit: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal units. side: 0 compares within, 1 and 2 across."""
    x, n = fp.view(np.uint64), len(fp)
    first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.concatenate((first, [n])))
    small = sizes <= 32
    a_all, b_all = [], []
    at, room = np.repeat(first, sizes), np.repeat(np.where(small, sizes, 0), sizes)
    place = np.arange(n) - at
    for d in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero(place + d < room)
        if not len(i):
            break
        ok = (np.bitwise_count(x[i] ^ x[i + d]) <= radius) & ((side[i] == 0) | (side[i] != side[i + d]))
        a_all.append(i[ok])
        b_all.append(i[ok] + d)
    for f, m in zip(first[~small].tolist(), sizes[~small].tolist()):
        s, t = side[f : f + m], x[f : f + m]
        if s[0] == 0 and (s == 0).all():
            a, b = tile_links(t, radius)
        else:
            one, two = np.flatnonzero(s == 1), np.flatnonzero(s == 2)
            a, b = tile_links(t[one], radius, t[two])
            a, b = one[a], two[b]
        a_all.append(a + f)
        b_all.append(b + f)
    a, b = (np.concatenate(a_all), np.concatenate(b_all)) if a_all else (np.empty(0, np.int64),) * 2
    label = forest(a, b, n)
    i = np.flatnonzero(label != np.arange(n))
    return fp[i], fp[label[i]]


def masks(radius: int, bands: int) -> list[int]:
    """Bit masks one of which two fingerprints agree under if they differ in at most `radius` bits: all but `radius` of the bands."""
    if radius >= bands:
        raise ValueError(f"the radius must be below {bands}")
    ends = [BITS * i // bands for i in range(bands + 1)]
    band = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]
    return [sum(some) for some in itertools.combinations(band, bands - radius)]


def links(fps: DataFrame, radius: int = 3, bands: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that span all links of at most radius bits.

    The bits are cut into bands; fingerprints that differ in at most radius bits agree in all but
    radius of them, so every link lies inside a tile (bands that agree, their value). The more fingerprints there are, the more bands
    are used, so that tiles stay small. A tile of over TILE rows is split by
    population count and then by hash into blocks; each pair of blocks whose counts
    differ by at most the radius is one unit of work, so that no tile has to fit a task.
    """
    n = 0 if bands else fps.count()
    bands = bands or max(b for least, b in WIDER if n >= least)
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for i, m in enumerate(masks(radius, bands))])).alias("t")
    rows = fps.select("fp", F.expr("bit_count(fp)").cast("int").alias("ones"), band).select("fp", "ones", "t.*")
    sizes = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    large = sizes.groupBy("band", "value").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / TILE).cast("int").alias("b")))).alias("blocks")).where(F.col("all") > TILE)
    tiled = rows.join(large, ["band", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")[F.col("ones")].cast("long"))
    # A unit names an unordered pair of blocks (count, block); each row goes to every unit that holds its own block.
    near = F.filter(F.map_keys("blocks"), lambda p: F.abs(p - F.col("ones")) <= radius)
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), F.col("blocks")[p] - 1), lambda s: F.struct(p.alias("p"), s.cast("long").alias("s")))))
    units = F.when(F.col("all").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("s")))).otherwise(others)
    dealt = tiled.withColumn("own", own).select("fp", "band", "value", "ones", "own", "all", F.explode(units).alias("o"))
    mine, that = F.struct("ones", "own"), F.struct(F.col("o.p").alias("ones"), F.col("o.s").alias("own"))
    whole = F.col("all").isNull()
    unit = F.when(whole, F.xxhash64("band", "value")).otherwise(F.xxhash64("band", "value", F.least(mine, that), F.greatest(mine, that)))
    side = F.when(whole | (mine == that), 0).when(mine < that, 1).otherwise(2)
    radius_ = radius

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            u = b["unit"].to_numpy()
            cut = int(np.searchsorted(u, u[-1], "left")) if len(u) else 0
            rest, b = b.iloc[cut:].reset_index(drop=True), b.iloc[:cut]
            if len(b):
                yield edges(b)
        if rest is not None and len(rest):
            yield edges(rest)

    def edges(b: pd.DataFrame) -> pd.DataFrame:
        u, v = _unit_edges(b["unit"].to_numpy(), b["fp"].to_numpy(), b["side"].to_numpy(), radius_)
        return pd.DataFrame({"u": u, "v": v})

    return dealt.select(unit.alias("unit"), "fp", side.alias("side")).repartition(F.col("unit")).sortWithinPartitions("unit").mapInPandas(lean(run), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id), one row per row of docs.

    component_id: the smallest document id reachable over links of at most radius bits.
    Copies share a fingerprint and are one node, so a group of copies costs one row after
    the first aggregation. Null texts count as empty; null ids come last and stand for
    themselves only if nothing else is reachable (then component_id is null). Repeated
    rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    prints = saved(fingerprints(docs, words, id_col, text_col), "simhash-docs")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    edges = saved(links(nodes.select("fp"), radius).distinct(), "simhash-links")
    roots = components(edges)
    # The root of a component is a fingerprint; its id is the least over its members.
    placed = saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    comp = placed.join(ids, "root").select("fp", "component_id")
    drop(edges)
    return prints.join(comp, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
