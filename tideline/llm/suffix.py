"""Exact removal of repeated byte strings: suffix arrays over shards that share an anchor.

Every window of `width` bytes has an anchor, the least-hashed `k`-byte string in it
(its minimizer). Equal windows have equal anchors, so a window whose anchor occurs once
in the corpus is unique and needs no further look. Consecutive windows of one anchor are a
run. Runs are merged by anchor: equal runs are settled by their hash, and different runs
of one anchor get their bytes fetched and a suffix array per shard; windows of an anchor that lies in several shards are
merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, saved

#: Anchor lengths, each used on what the one before left in groups of over GROUP runs.
ANCHORS = (40, 88, 100)
#: Runs of one anchor that one shard compares by their bytes.
GROUP = 512
#: An anchor with more than one in HOT of all runs, or with more than HOT_RUNS (judged by the documents of one hash value of SAMPLE),
#: is dealt out by window from the start. At most MOST_HOT anchors are, the commonest, which bounds what is broadcast (8 bytes each).
HOT, SAMPLE, HOT_RUNS, MOST_HOT = 2048, 32, 1 << 20, 1 << 17
#: Bytes of text that are hashed at once, and of run text in a shard.
BLOCK, SHARD = 1 << 20, 1 << 20

#: Stands for a null id in comparisons, so null ids come last, level with a real id of this value.
LAST = 2**63 - 1

_B1 = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
ROWS = "kind int, key long, content long, id long, tag long, start long, n int"
TEXTS = ROWS + ", bytes binary"


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(BLOCK + 1, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[base] = (pair[0], pair[1])
    return _POWERS[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sums(x: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(base)[0][: len(x)], out=out[1:])
    return out


def runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(first, n, key, content) of the runs of windows in x, none across the texts [starts, ends).

    Of several least-hashed anchors in a window the leftmost counts, so no run holds two
    equal windows. len(x) is at most BLOCK.
    """
    none = np.empty(0, np.int64)
    if len(x) < width:
        return none, none, none, none
    p, inverse = _sums(x, _B1), _powers(_B1)[1]
    g = _mix((p[k:] - p[:-k]) * inverse[: len(x) - k + 1])
    low = (g & ~np.uint64(BLOCK - 1)) | np.arange(len(g), dtype=np.uint64)
    span, done = width - k + 1, 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    anchor = (low & np.uint64(BLOCK - 1)).astype(np.int64)  # of the window at each place
    ok = np.zeros(len(x) + 1, np.int32)
    lasts = ends - width + 1
    real = lasts > starts
    np.add.at(ok, starts[real], 1)
    np.add.at(ok, lasts[real], -1)
    ok = np.cumsum(ok)[: len(anchor)] > 0
    text = np.zeros(len(x) + 1, np.int32)
    np.add.at(text, starts, 1)
    text = np.cumsum(text)[: len(anchor)]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none, none, none, none
    # A run ends before the next run or at the last window of its text.
    stop = np.append(first[1:], len(anchor))
    inside = np.concatenate(([0], np.cumsum(ok)))
    n = inside[stop] - inside[first]
    return first, n, g[anchor[first]].view(np.int64), _digests(x, first, n + width - 1)


def _digests(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """XXH3 of the bytes x[start : start + n], as longs. With the anchor's own 64 bits it tells runs apart by 128."""
    import xxhash

    whole, digest = memoryview(x), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(whole[a:b]) for a, b in zip(start.tolist(), (start + n).tolist())), np.uint64, len(start)).view(np.int64)


def _group_ends(*keys: np.ndarray) -> np.ndarray:
    """Where a group of equal sorted keys begins (bool)."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def suffix_array(codes: np.ndarray, rest: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Order of all suffixes of the pieces, by Larsson-Sadakane refinement.

    codes: the bytes of all pieces, one after the other; rest: the bytes from each place to
    the end of its piece; piece: its number. A piece ends in a symbol of its own, below all
    bytes and ordered by number, so no two suffixes are equal. Sorted by 7 symbols first,
    each round doubles the depth, and only groups not told apart yet are sorted again.
    """
    n = len(codes)
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | np.where(rest > i, padded[i : i + n], 0)
    tail = np.where(rest < 7, piece + 1, 0)
    order = np.lexsort((tail, key))
    new = _group_ends(key[order], tail[order])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    h = 7
    size = np.diff(np.append(np.flatnonzero(new), n))
    todo = np.repeat(size > 1, size)
    while todo.any():
        at = np.flatnonzero(todo)  # places in the order
        s = order[at]
        # All in a group have h bytes left at least; after the last one comes the end of the piece.
        second = np.where(rest[s] > h, rank[np.minimum(s + h, n - 1)], piece[s] - n)
        again = np.lexsort((second, rank[s]))
        s, second, group = s[again], second[again], rank[s][again]
        order[at] = s
        new = _group_ends(group, second)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(s)))
        rank[s] = at[np.repeat(begin, size)]
        todo[at] = np.repeat(size > 1, size)
        h *= 2
    return order


def common_prefixes(codes: np.ndarray, rest: np.ndarray, order: np.ndarray, step: int = 16) -> np.ndarray:
    """Length of the common prefix of each suffix in the order with the one before it (Kasai et al., 2001).

    Along the text, place plus common prefix never falls. So it is computed for every
    step-th place first, and in between only where the ends around differ, from the lower on.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]

    def extend(at: np.ndarray, have: np.ndarray) -> np.ndarray:
        other, have = before[at], have.copy()
        limit = np.where(other >= 0, np.minimum(rest[at], rest[np.maximum(other, 0)]), 0)
        have = np.minimum(have, limit)
        live = np.flatnonzero(have < limit)
        while len(live):
            same = codes[at[live] + have[live]] == codes[other[live] + have[live]]
            live = live[same]
            have[live] += 1
            live = live[have[live] < limit[live]]
        return have

    common = np.zeros(n, np.int64)
    some = np.arange(0, n, step)
    common[some] = extend(some, np.zeros(len(some), np.int64))
    ends = some + common[some]
    places = np.setdiff1d(np.arange(n), some, assume_unique=True)
    low = ends[places // step]
    high = np.append(ends[1:], n)[places // step]
    least = np.maximum(low - places, 0)
    common[places] = least
    open_ = np.flatnonzero(high > low)
    common[places[open_]] = extend(places[open_], least[open_])
    return common[order]


def repeats_in_shard(texts: list[bytes], ids: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place, first) of all windows in suffix order: first, the row of the equal window with the smallest (id, start + place)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(lens) - lens
    piece = np.repeat(np.arange(len(texts)), lens)
    place = np.arange(len(codes)) - begin[piece]
    rest = lens[piece] - place
    order = suffix_array(codes, rest, piece)
    same = common_prefixes(codes, rest, order) >= width
    group = np.cumsum(~same)
    order, group = (a[rest[order] >= width] for a in (order, group))
    p, at = piece[order], place[order]
    sort = np.lexsort((starts[p] + at, ids[p], group))
    head = _group_ends(group[sort])
    return p[sort], at[sort], np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


class Merged:
    """Distinct windows of one anchor over shards, sorted, each with the first place it was seen at."""

    def __init__(self, windows: np.ndarray, rows: np.ndarray):
        self.windows, self.rows = windows, rows

    def add(self, windows: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Merge another shard's sorted windows (rows: id, tag, start) by binary search; rows that start later than an equal window."""
        at = np.searchsorted(self.windows, windows)
        hit = at < len(self.windows)
        hit[hit] = self.windows[at[hit]] == windows[hit]
        old, new = self.rows[at[hit]], rows[hit]
        new_first = (new[:, 0] < old[:, 0]) | ((new[:, 0] == old[:, 0]) & (new[:, 2] < old[:, 2]))
        differ = (new[:, 0] != old[:, 0]) | (new[:, 2] != old[:, 2])
        late = np.where(new_first[:, None], old, new)[differ]
        self.rows[at[hit]] = np.where(new_first[:, None], new, old)
        self.windows = np.insert(self.windows, at[~hit], windows[~hit])
        self.rows = np.insert(self.rows, at[~hit], rows[~hit], axis=0)
        return late


def _table(kind, key, content, ids, tag, start, n, texts=None) -> pa.RecordBatch:
    cols = [pa.array(np.broadcast_to(np.asarray(c), len(ids)).astype(t)) for c, t in ((kind, np.int32), (key, np.int64), (content, np.int64), (ids, np.int64), (tag, np.int64), (start, np.int64), (n, np.int32))]
    names = ["kind", "key", "content", "id", "tag", "start", "n"]
    if texts is not None:
        cols.append(pa.array(texts, pa.binary()))
        names.append("bytes")
    return pa.RecordBatch.from_arrays(cols, names=names)


#: Kinds of rows: runs to merge by anchor, run bytes to compare, found spans, runs whose bytes or shorter runs are wanted.
RUN, TEXT, SPAN, WANT_TEXT, WANT_RUNS = range(5)


def _spans(ids: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Span rows; touching ones of a document become one."""
    sort = np.lexsort((end, start, tag, ids))
    ids, tag, start, end = ids[sort], tag[sort], start[sort], end[sort]
    if len(ids):
        doc = np.cumsum(_group_ends(ids, tag)) - 1
        room = int(end.max()) + 1
        reach = np.maximum.accumulate(doc * room + end) - doc * room
        new = _group_ends(doc)
        new[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(ids)) - 1
        ids, tag, start, end = ids[at], tag[at], start[at], reach[last]
    return _table(SPAN, ids ^ (start << 20), 0, ids, tag, start, end - start)


def _first_runs(width: int, hot: np.ndarray | Broadcast) -> Callable:
    """Map step: the runs of whole documents, equal ones of a task once; those later in the order are spans at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = hot if isinstance(hot, np.ndarray) else hot.value
        held: list[tuple] = []
        count = 0
        parts: list[tuple[bytes, int, int, int]] = []
        size = 0
        for b in batches:
            for i, t, text in zip(b["id"].to_pylist(), b["tag"].to_pylist(), b["text"]):
                raw = text.as_py() or b""
                for at in range(0, max(1, len(raw) - width + 1), BLOCK - width + 1):
                    part = raw[at : at + BLOCK]
                    if len(part) < width:
                        continue
                    if size + len(part) > BLOCK:
                        held.append(_block(parts, width, ANCHORS[0], keys))
                        count += len(held[-1][0])
                        parts, size = [], 0
                    parts.append((part, i, t, at))
                    size += len(part)
            if count > 2_000_000:
                yield from _settled(held, width)
                held, count = [], 0
        if parts:
            held.append(_block(parts, width, ANCHORS[0], keys))
        if held:
            yield from _settled(held, width)

    return run


def _block(parts: list[tuple[bytes, int, int, int]], width: int, k: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, content, id, tag, start, n) of the runs of the parts; runs of hot anchors are cut into their windows."""
    lens = np.fromiter((len(p[0]) for p in parts), np.int64, len(parts))
    ends = np.cumsum(lens)
    x = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
    first, n, key, content = runs(x, ends - lens, ends, min(width, BLOCK), min(k, width))
    if len(hot) and len(key):
        split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        if split.any():
            m = n[split]
            places = np.repeat(first[split] - np.cumsum(m) + m, m) + np.arange(m.sum())
            p = _sums(x, _B1)
            k1 = _mix((p[places + width] - p[places]) * _powers(_B1)[1][places]).view(np.int64)
            k2 = _digests(x, places, np.full(len(places), width))
            first, n = np.concatenate([first[~split], places]), np.concatenate([n[~split], np.ones(len(places), np.int64)])
            key, content = np.concatenate([key[~split], k1]), np.concatenate([content[~split], k2])
    at = np.searchsorted(ends, first, "right")
    ids, tags, base = (np.array([p[j] for p in parts], np.int64) for j in (1, 2, 3))
    return key, content, ids[at], tags[at], base[at] + first - (ends - lens)[at], n


def _settled(held: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    key, content, ids, tag, start, n = (np.concatenate(c) for c in zip(*held))
    sort = np.lexsort((start, ids, content, key))
    key, content, ids, tag, start, n = (c[sort] for c in (key, content, ids, tag, start, n))
    head = _group_ends(key, content)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    late = (ids != ids[lead]) | (start != start[lead])
    if late.any():
        yield _spans(ids[late], tag[late], start[late], start[late] + n[late] + width - 1)
    keep = ~late
    yield _table(RUN, key[keep], content[keep], ids[keep], tag[keep], start[keep], n[keep])


def _merge(width: int) -> Callable:
    """Reduce step over rows sorted by anchor: spans pass; anchors of one run go; equal runs are settled; others are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, size = None, [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < 100_000:
                continue
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from settle(t.slice(0, cut))
                t = t.slice(cut)
            held, size = t.to_batches(), 0
        if held:
            yield from settle(pa.Table.from_batches(held))

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, key, content, ids, tag, start, n = (t[c].to_numpy() for c in ("kind", "key", "content", "id", "tag", "start", "n"))
        old = kind == SPAN
        got = [(ids[old], tag[old], start[old], start[old] + n[old])]
        has_texts = "bytes" in t.column_names and (kind == TEXT).any()
        if has_texts:
            got += compare(t, np.flatnonzero(kind == TEXT))
        live = kind == RUN
        key, content, ids, tag, start, n = (c[live] for c in (key, content, ids, tag, start, n))
        sort = np.lexsort((start, ids, content, key))
        key, content, ids, tag, start, n = (c[sort] for c in (key, content, ids, tag, start, n))
        if len(key):
            head = _group_ends(key, content)
            lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            late = (ids != ids[lead]) | (start != start[lead])
            got.append((ids[late], tag[late], start[late], start[late] + n[late] + width - 1))
            # One run of each content goes on if its anchor has another one.
            at = np.flatnonzero(head)
            groups = _group_ends(key[at])
            sizes = np.diff(np.append(np.flatnonzero(groups), len(at)))
            size = np.repeat(sizes, sizes)
            at, size = at[size > 1], size[size > 1]
            if len(at):
                yield _table(np.where(size > GROUP, WANT_RUNS, WANT_TEXT), key[at], 0, ids[at], tag[at], start[at], n[at])
        yield _spans(*(np.concatenate(c) for c in zip(*got)))

    def compare(t: pa.Table, rows: np.ndarray) -> list[tuple]:
        out = []
        key = t["key"].to_numpy()[rows]
        sort = np.argsort(key, kind="stable")
        rows, key = rows[sort], key[sort]
        ids, tag, start, n = (t[c].to_numpy()[rows] for c in ("id", "tag", "start", "n"))
        texts = t["bytes"].take(pa.array(rows)).to_pylist()
        size = np.cumsum(n + width - 1)
        begin, open_ = 0, None  # open_: the anchor that goes on from the shard before
        while begin < len(rows):
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SHARD, "right")))
            p, at, first = repeats_in_shard(texts[begin:end], ids[begin:end], start[begin:end], width)
            p = p + begin
            row = np.stack([ids[p], tag[p], start[p] + at], axis=1)
            lead = row[first]
            late = row[(row[:, 0] != lead[:, 0]) | (row[:, 2] != lead[:, 2])]
            goes_on = end < len(rows) and key[end] == key[end - 1]
            if open_ is not None or goes_on:
                heads = np.flatnonzero(first == np.arange(len(first)))
                window = np.array([texts[i][j : j + width] for i, j in zip(p[heads].tolist(), at[heads].tolist())], f"S{width}")
                whose = key[p[heads]]
                if open_ is not None:
                    mine = whose == key[begin]
                    late = np.concatenate([late, open_.add(window[mine], row[heads[mine]])])
                if goes_on and (open_ is None or key[end - 1] != key[begin]):
                    mine = whose == key[end - 1]
                    open_ = Merged(window[mine], row[heads[mine]])
                elif not goes_on:
                    open_ = None
            out.append((late[:, 0], late[:, 1], late[:, 2], late[:, 2] + width))
            begin = end
        return out

    return run


def _fetch(width: int, k: int) -> Callable:
    """Map step: bytes of the runs wanted, or their runs under the next anchor length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[tuple] = []
            parts: list[tuple[bytes, int, int, int]] = []
            size = 0
            for i, t, text, wants in zip(b["id"].to_pylist(), b["tag"].to_pylist(), b["text"], b["wants"].to_pylist()):
                raw = text.as_py() or b""
                for w in wants:
                    part = raw[w["start"] : w["start"] + w["n"] + width - 1]
                    if w["kind"] == WANT_TEXT:
                        texts.append((w["key"], i, t, w["start"], w["n"], part))
                        continue
                    if size + len(part) > BLOCK:
                        yield shorter(parts)
                        parts, size = [], 0
                    parts.append((part, i, t, w["start"]))
                    size += len(part)
            if texts:
                key, i, t, s, n, raw = zip(*texts)
                yield _table(TEXT, key, 0, np.array(i), t, s, n, list(raw))
            if parts:
                yield shorter(parts)

    def shorter(parts: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
        key, content, ids, tag, start, n = _block(parts, width, k, np.empty(0, np.int64))
        return _table(RUN, key, content, ids, tag, start, n, [None] * len(key))

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, nameless, tag, text as bytes): tag tells rows of one id apart, and is 0 while ids are unique."""
    own = F.col(id_col).cast("long")
    d = docs.select(F.coalesce(own, F.lit(LAST)).alias("id"), own.isNull().alias("nameless"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unique = d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    tag: Column = F.lit(0).cast("long") if unique else F.xxhash64("text")
    return d.select("id", "nameless", tag.alias("tag"), F.col("text").cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, start, n): bytes covered by a string of `width` bytes that starts earlier too; spans may overlap."""
    keyed = _keyed(docs, id_col, text_col)
    long = keyed.where(F.length("text") >= width)
    some = long.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(SAMPLE)) == 0).mapInArrow(_first_runs(width, np.empty(0, np.int64)), ROWS)
    some = some.where(F.col("kind") == RUN).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    common = some.where(F.col("n") >= 8).orderBy(F.desc("n")).limit(MOST_HOT).collect()
    runs_seen = long.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(SAMPLE)) == 0).agg(F.sum(F.length("text"))).first()[0] or 0
    least = max(8, min(runs_seen * 2 / (width - ANCHORS[0] + 2) / HOT, HOT_RUNS / SAMPLE)) if width > ANCHORS[0] else 8
    hot = np.sort(np.array([r["key"] for r in common if r["n"] >= least], np.int64))
    rows = long.mapInArrow(_first_runs(width, docs.sparkSession.sparkContext.broadcast(hot)), ROWS)
    found: list[DataFrame] = []
    anchors = [min(a, width) for a in ANCHORS if a < width] + [width]
    for k in [*anchors[1:], width]:
        done = saved(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_merge(width), ROWS), "suffix-round")
        found.append(done.where(F.col("kind") == SPAN).select("id", "tag", "start", "n"))
        wants = done.where(F.col("kind") > SPAN)
        del rows
        release(docs.sparkSession)
        if not wants.limit(1).count():
            break
        asked = wants.groupBy("id", "tag").agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("wants"))
        rows = keyed.join(asked, ["id", "tag"]).select("id", "tag", "text", "wants").mapInArrow(_fetch(width, k), TEXTS)
    else:
        raise AssertionError("runs of one window each can't want anything")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept (the bytes left)].

    A byte goes if a string of `width` bytes over it also starts earlier: in a smaller id, or
    in the same document before. Null texts are empty, and null ids sort last. Rows of one
    id compare by their places alone, so a row that repeats another as it is loses nothing
    to it. Texts below `width` bytes lose nothing; an empty table gives no rows; other
    columns are ignored.
    """
    spans = repeated_spans(docs, width, id_col, text_col)
    cuts = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, nameless, text, cuts_ in zip(b["id"].to_pylist(), b["nameless"].to_pylist(), b["text"], b["cuts"].to_pylist()):
                raw = text.as_py()
                kept, at, removed, n = [], 0, 0, 0
                until = -1
                for s, e in sorted((c["start"], c["start"] + c["n"]) for c in cuts_ or ()):
                    if s > until:
                        kept.append(raw[at:s])
                        n += 1
                        at = until = e
                        removed += e - s
                    elif e > until:
                        removed += e - until
                        at = until = e
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((None if nameless else i, len(raw), removed, n, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
    return _keyed(docs, id_col, text_col).join(cuts, ["id", "tag"], "left").select("id", "nameless", "text", "cuts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
