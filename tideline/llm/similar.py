"""Near copies by the exact similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import drop, lean, saved, small_batches
from .graph import components

#: Documents of the bounded sample that names frequent shingles, and how many of those are named at most.
SAMPLE, FREQUENT = 20_000, 200_000
#: Pairs that a task holds before it hands them on.
HELD = 1 << 20
#: Texts of a shingle that all its others are compared with first.
PIVOTS = 4
#: Texts whose prefixes are handed on at once.
SOME = 1024
#: Longs of the sketch that travels with a prefix shingle.
SHORT = 4
BROADCAST_ROWS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(parts: list[bytes], words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the space-joined shingles of one whole text; fewer words are one shingle, none are none."""
    import xxhash

    digest = xxhash.xxh64_digest
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.frombuffer(digest(joined, 42), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def frequency(found: np.ndarray, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often the sample holds each shingle; 0 for one that isn't named."""
    if not len(names) or not len(found):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
    return np.where(names[at] == found, counts[at], 0)


def prefix(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of similarity 0.8 or more share one at least: n - ceil(0.8 n) + 1, the rarest first."""
    n = len(found)
    return found[np.argsort(often, kind="stable")[: n - (4 * n + 4) // 5 + 1]] if n else found


def sketch(found: np.ndarray) -> bytes:
    """Parities of the shingles by the low bits of their hash: 64 to 4,096 bits, about as many as there are shingles."""
    bits = 1 << min(12, max(6, (max(len(found), 1) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def short_sketch(found: np.ndarray) -> np.ndarray:
    """Parities by the low 8 bits of the hashes, as SHORT longs."""
    odd = np.bincount((found & np.uint64(64 * SHORT - 1)).astype(np.int64), minlength=64 * SHORT) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differ(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether short sketches (rows of a and b) of sets of m and n shingles show that they differ in too many."""
    odd = np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return odd > m + n - 2 * ((4 * (m + n) + 8) // 9)


def may_match(x: bytes, m: int, y: bytes, n: int) -> bool:
    """False only if sets of m and n shingles with these sketches differ in too many for similarity 0.8."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    i, j = 8 * len(x), 8 * len(y)
    while i != j:  # the wider one is folded to the width of the other
        if i > j:
            i //= 2
            a = a >> i ^ a & (1 << i) - 1
        else:
            j //= 2
            b = b >> j ^ b & (1 << j) - 1
    return (a ^ b).bit_count() <= m + n - 2 * -(-4 * (m + n) // 9)


def _fit(n: np.ndarray, pos: np.ndarray, short: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether set sizes, places of the shingle and short sketches of rows i and j allow similarity 0.8."""
    least = np.minimum(n[i], n[j])
    most = np.minimum(n[i] - pos[i], n[j] - pos[j])  # as if no rarer shingle were common: so it is at the first that a pair shares
    ok = (5 * least >= 4 * np.maximum(n[i], n[j])) & (9 * most >= 4 * (n[i] + n[j]))
    ok[ok] = ~_differ(short[i[ok]], short[j[ok]], n[i[ok]], n[j[ok]])
    return ok


def pairs(h: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, short: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one prefix shingle and of different known components that may be similar; rows are sorted by (h, n)."""
    i, d, held, u, v = np.arange(len(h)), 1, 0, [], []
    while len(i):
        i = i[i + d < len(h)]
        i = i[(h[i] == h[i + d]) & (5 * n[i] >= 4 * n[i + d])]
        apart = i[comp[i] != comp[i + d]]
        ok = apart[_fit(n, pos, short, apart, apart + d)]
        a, b = node[ok], node[ok + d]
        u.append(np.minimum(a, b))
        v.append(np.maximum(a, b))
        held, d = held + len(a), d + 1
        if held >= HELD:
            yield np.concatenate(u), np.concatenate(v)
            held, u, v = 0, [], []
    if held:
        yield np.concatenate(u), np.concatenate(v)


def pivot_pairs(h: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each row with the first PIVOTS rows of its shingle that may be similar; rows are sorted by h, the most central first."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    u, v = [], []
    for k in range(PIVOTS):
        i = np.flatnonzero(first + k < np.arange(len(h)))
        i = i[_fit(n, pos, short, i, first[i] + k)]
        a, b = node[i], node[first[i] + k]
        u.append(np.minimum(a, b))
        v.append(np.maximum(a, b))
    return np.concatenate(u), np.concatenate(v)


def in_company(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows, sorted by h, whose h another row has too. One row at most is held between batches."""
    held, last = None, None  # a row that may have company in the next batch; an h that is known to have
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        h = b["h"].to_numpy()
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= same[1:]
        if last is not None:
            same |= h == last
        held = None if same[-1] else b.iloc[-1:]
        last = h[-1] if same[-1] else None
        yield b[same]


def near_copies(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2, component), one row per row of docs; h1 and h2 hash the text, rows of one component are near copies.

    Two texts are linked if the Jaccard similarity of their sets of word shingles (split at
    white space, A-Z lowered) is 0.8 or more; components are closed over links. No link is
    lost: sets that similar share one of their rarest 20 % of shingles in any one order of
    all shingles, and each pair that does is compared by all its shingles, unless parities
    of their hashes show already that too many differ, or other links join the two. First come the pairs that
    SimHash fingerprints of at most 3 different bits propose, and texts that share a shingle are compared
    with the few of them that hold most frequent shingles (an original, where most others are edited copies of it), and pairs
    that these links have joined are left out of the rest. The sample of
    frequent shingles only sets that order. Texts of equal words are one node; null texts
    and texts without a word are equal. An empty table gives no rows; other columns are
    ignored.
    """
    import xxhash

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))

    def key(parts: list[bytes]) -> bytes:
        return xxhash.xxh128_digest(b" ".join(parts))

    # Words are many objects: one text's at a time.
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                parts = words_of(t)
                k = key(parts)
                rows.append((k, int.from_bytes(k[:8], "big", signed=True), shingles(parts, words).tobytes()))
            yield pd.DataFrame(rows, columns=["k", "node", "s"])

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["s"]:
                yield pd.DataFrame({"h": np.frombuffer(s, np.int64)})

    n_docs = d.count()
    drawn = d.where(F.pmod(F.col("h1"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(n_docs, 1)) * (1 << 30)).select("text")
    often = drawn.mapInPandas(lean(sets), "k binary, node long, s binary").dropDuplicates(["k"]).select("s").mapInPandas(lean(numbers), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    with small_batches(docs.sparkSession):
        top = often.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    names, counts = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(names)
    known = docs.sparkSession.sparkContext.broadcast((names[order], counts[order]))

    def about(text: str | None) -> tuple:
        parts = words_of(text)
        found = shingles(parts, words)
        often = frequency(found, *known.value)
        central = int(1000 * (often > 0).mean()) if len(often) else 0
        return key(parts), len(found), central, prefix(found, often).view(np.int64), sketch(found), short_sketch(found), simhash.of_hashes(found)

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SOME):
                some = b.iloc[at : at + SOME]
                out = pd.DataFrame([about(t) for t in some["text"]], columns=["k", "n", "central", "prefix", "sketch", "short", "fp"])
                yield pd.concat([some[["doc_id", "h1", "h2"]].reset_index(drop=True), out], axis=1)

    with small_batches(docs.sparkSession):
        rows = saved(d.select("doc_id", "h1", "h2", "text").mapInPandas(lean(prints), "doc_id long, h1 long, h2 long, k binary, n long, central long, prefix array<long>, sketch binary, short array<long>, fp long"), "near-docs")
    nodes = saved(rows.groupBy("k").agg(F.min(F.struct("h1", "h2")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "central", "prefix", "sketch", "short", "fp")], F.count("*").alias("copies")), "near-nodes")
    slim = saved(rows.select("doc_id", "h1", "h2", "k"), "near-rows")
    drop(rows)
    shorts = [f"s{i}" for i in range(SHORT)]
    arrays = lambda b: (b["h"].to_numpy(), b["node"].to_numpy(), b["n"].to_numpy(np.int64), b["pos"].to_numpy(np.int64))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            h = b["h"].to_numpy()
            cut = int(np.argmax(h == h[-1])) if len(h) else 0  # rows of the last shingle may go on in the next batch
            rest, b = b.iloc[cut:].reset_index(drop=True), b.iloc[:cut]
            yield from couples(b)
        if rest is not None:
            yield from couples(rest)

    def couples(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for u, v in pairs(*arrays(b), b["comp"].to_numpy(), b[shorts].to_numpy(np.int64)):
            yield pd.DataFrame({"u": u, "v": v}).drop_duplicates()

    def meet_pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the pivots of the last shingle, which may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            u, v = pivot_pairs(*arrays(b), b[shorts].to_numpy(np.int64))
            held = b[b["h"] == b["h"].iloc[-1]].iloc[:PIVOTS]
            yield pd.DataFrame({"u": u, "v": v}).drop_duplicates()

    node = F.conv(F.hex(F.substring("k", 1, 8)), 16, -10).cast("long")

    def rough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[may_match(*r) for r in zip(b["a"], b["m"], b["b"], b["n"])], ["u", "v"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["a"], b["b"]):
                m, n = len(x) // 8, len(y) // 8
                same = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(9 * same >= 4 * (m + n))
            yield b.loc[keep, ["u", "v"]]

    # Most prefix shingles are one text's alone: what is known of a text travels only with those that are not.
    spread = nodes.select(node.alias("node"), F.posexplode("prefix").alias("pos", "h")).select("h", "node", "pos")
    shared = saved(spread.repartition(F.col("h")).sortWithinPartitions("h").mapInPandas(lean(in_company), "h long, node long, pos int"), "near-shared")

    def met(placed: DataFrame, by: list, how) -> DataFrame:
        about = placed.select(node.alias("node"), "n", "comp", "central", "copies", *[F.col("short")[i].alias(c) for i, c in enumerate(shorts)])
        return shared.join(about, "node").repartition(F.col("h")).sortWithinPartitions("h", *by, "node").mapInPandas(lean(how), "u long, v long")

    def linked(met: DataFrame) -> DataFrame:
        """Pairs of nodes that are similar."""
        met = saved(met.distinct(), "near-met")
        one = nodes.select(node.alias("u"), F.col("n").alias("m"), F.col("sketch").alias("a"))
        two = nodes.select(node.alias("v"), "n", F.col("sketch").alias("b"))
        maybe = saved(met.join(one, "u").join(two, "v").mapInPandas(lean(rough), "u long, v long").distinct(), "near-pairs")

        # Texts of the pairs that are left, one a node.
        wanted = maybe.select(F.col("u").alias("node")).union(maybe.select("v")).distinct()
        reps = saved(nodes.select(node.alias("node"), "rep.h1", "rep.h2").join(wanted, "node", "left_semi").select("h1", "h2").distinct(), "near-reps")
        few = reps.count() <= BROADCAST_ROWS
        texts = d.join(F.broadcast(reps) if few else reps, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("text")
        with small_batches(docs.sparkSession):
            full = saved(texts.mapInPandas(lean(sets), "k binary, node long, s binary"), "near-sets")
        left = full.select(F.col("node").alias("u"), F.col("k").alias("ku"), F.col("s").alias("a"))
        right = full.select(F.col("node").alias("v"), F.col("k").alias("kv"), F.col("s").alias("b"))
        both = maybe.join(left, "u").join(right, "v").select(F.col("ku").alias("u"), F.col("kv").alias("v"), "a", "b")
        edges = saved(both.mapInPandas(lean(compare), "u binary, v binary"), "near-links")
        drop(met, maybe, reps, full)
        return edges

    # SimHash proposes pairs: texts of one fingerprint with the least of them, and the least ones of linked fingerprints.
    least = saved(nodes.groupBy("fp").agg(F.min(node).alias("least"), F.count("*").alias("texts")), "near-prints")
    close = simhash.links(least.select("fp"))
    ends = close.join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    alike = nodes.select("fp", node.alias("a")).join(least.where("texts > 1").select("fp", F.col("least").alias("b")), "fp").where("a <> b")
    proposed = ends.select("a", "b").unionByName(alike.select("a", "b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    near = linked(met(nodes.withColumn("comp", node), [F.desc("central"), F.desc("copies")], meet_pivots).unionByName(proposed))
    known_roots = components(near).withColumnRenamed("node", "k")
    placed = nodes.join(known_roots, "k", "left").withColumn("comp", F.xxhash64(F.coalesce("root", "k"))).drop("root")
    rest = linked(met(saved(placed, "near-placed"), ["n"], meet))
    edges = near.unionByName(rest)
    roots = components(edges)
    drop(near, rest, shared, least)
    return slim.join(roots.withColumnRenamed("node", "k"), "k", "left").select("doc_id", "h1", "h2", F.coalesce("root", "k").alias("component"))
