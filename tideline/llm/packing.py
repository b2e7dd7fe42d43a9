"""Packing of tokenised documents by shortest-pack-first over the length histogram."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved, with_rank

#: Pieces of one length that a bucket of the ranking holds on average at most.
BUCKET_ROWS = 200_000
#: Buckets of every length, so that a common length is ranked by many tasks in a small table too.
LEAST_BUCKETS = 64
#: Texts on which two libraries must agree before one stands in for the other.
PROBE = ["", " a", " The cat's 12,345 hats\n\n  don't\tfit", " été où ñandú Straße 北京 😀", " <|endoftext|>", " a<|endoftext|>b<|endoftext|>", " x\u00a0y\u3000z", " \r\n!!?? ''s 've", " aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
#: Chunks of text whose ids a Python worker remembers.
CACHE = 600_000


class Tokens:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    The vocabulary's pattern always starts a new word at a single space between two
    other characters, so a text is cut there, and each distinct chunk is encoded once
    and remembered. Chunks are encoded by tiktoken with the file's own vocabulary and
    pattern, several times faster than by tokenizers; on loading, both must agree on
    PROBE, else tokenizers does it all. The ids equal those of encode(text, add_special_tokens=False) on the
    text at once; an added token that a text holds, such as <|endoftext|>, is one id there as here.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.many = self._by_tokenizers
        try:
            self.fast = self._same_vocabulary(path)
            self.added = sorted(self.fast.special_tokens_set)
            if self._by_tiktoken(PROBE) == self._by_tokenizers(PROBE):
                self.many = self._by_tiktoken
        except (ImportError, KeyError, ValueError):
            pass
        self.odd, self.cut = re.compile(r" \s|\s "), re.compile(r"(?<=\S) (?=\S)")
        self._reset()

    @staticmethod
    def _same_vocabulary(path: str):
        """A tiktoken encoding of the file's vocabulary: in it a token's id is its merge rank."""
        import public_tokenizers
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t[flag] for t in file["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")) or any(" " in t for t in added):
            raise ValueError("an added token reaches beyond its own characters")
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in added}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def _by_tiktoken(self, chunks: list[str]) -> list[list[int]]:
        plain, added = self.fast.encode_ordinary, self.added
        return [self.fast.encode(c, allowed_special="all") if any(t in c for t in added) else plain(c) for c in chunks]

    def _by_tokenizers(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lens = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        for chunk, ids in zip(chunks, self.many([" " + c for c in chunks])):
            k = len(self.index)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(len(ids), len(self.ids)), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[k], self.lens[k] = self.used, len(ids)
            self.used += len(ids)
            self.index[chunk] = k

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text as uint32."""
        if not text:
            return np.empty(0, np.uint32)
        parts = self.cut.split(text) if self.odd.search(text) else text.split(" ")
        out = [np.array(self.many([parts[0]])[0], np.uint32)]
        for at in range(1, len(parts), CACHE // 2):
            some = parts[at : at + CACHE // 2]
            places = list(map(self.index.get, some))
            if None in places:
                new = list(dict.fromkeys(p for p, k in zip(some, places) if k is None))
                if len(self.index) + len(new) > CACHE or self.used > 64 << 20:
                    self._reset()
                    new = list(dict.fromkeys(some))
                self._learn(new)
                places = list(map(self.index.__getitem__, some))
            k = np.array(places, np.int64)
            lens = self.lens[k]
            ends = np.cumsum(lens)
            out.append(self.ids[np.repeat(self.starts[k] - ends + lens, lens) + np.arange(ends[-1])])
        return np.concatenate(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of each document plus end_id, cut every `size` ids: (doc_id, start, length, ids_crc32, doc_tokens[, ids])."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokens(path)
        for b in batches:
            rows: list[tuple] = []
            for d, text in zip(b["doc_id"], b["text"]):
                ids = np.append(t.encode(text or ""), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), size):
                    raw = ids[s : s + size].tobytes()
                    rows.append((d, s, len(raw) // 4, zlib.crc32(raw), len(ids), *([raw] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def place(histogram: dict[int, int], size: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Shortest-pack-first: placements (length, first rank, count, first pack, offset) and the number of packs.

    Lengths are placed longest first, each into the packs with the most room left. Equal
    packs are one pattern with a count, a run of pack numbers; a placement takes the head
    of a pattern's run. A length splits at most one pattern, so there are fewer than
    2 * size patterns and 2 * size ** 2 placements, however many pieces there are.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}
    out, packs = [], 0
    for length in range(size, 0, -1):
        left, rank = histogram.get(length, 0), 0
        fresh: list[tuple[int, int, int]] = []
        rooms = sorted((r for r in by_room if r >= length), reverse=True)
        while left and rooms:
            first, count = by_room[rooms[0]].pop()
            take = min(left, count)
            out.append((length, rank, take, first, size - rooms[0]))
            fresh.append((rooms[0] - length, first, take))
            if take < count:
                by_room[rooms[0]].append((first + take, count - take))
            left, rank = left - take, rank + take
            if not by_room[rooms[0]]:
                del by_room[rooms[0]]
                rooms.pop(0)
            # A pack just filled may be the shortest that fits again.
            if not rooms or fresh[-1][0] >= length:
                for room, f, n in fresh:
                    if room:
                        by_room.setdefault(room, []).append((f, n))
                fresh = []
                rooms = sorted((r for r in by_room if r >= length), reverse=True)
        for room, f, n in fresh:
            if room:
                by_room.setdefault(room, []).append((f, n))
        if left:
            per = size // length
            n = -(-left // per)
            for k in range(per):
                take = min(left, n)
                if take:
                    out.append((length, rank, take, packs, k * length))
                    room, before = size - (k + 1) * length, size - k * length
                    if k:
                        f, c = by_room[before].pop()
                        if c > take:
                            by_room[before].append((f + take, c - take))
                        if not by_room[before]:
                            del by_room[before]
                    if room:
                        by_room.setdefault(room, []).append((packs, take))
                    left, rank = left - take, rank + take
            packs += n
    return out, packs


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: one row per piece.

    A document is its ids and end_id, cut every `size` ids. Pieces are placed by their
    length alone: a histogram of at most `size` lengths goes to the driver, the placements
    go back, and a piece finds its place by its rank among those of its length. Null and
    empty texts are documents of one id; null ids and repeated rows are packed like
    others; an empty table gives no rows; other columns are ignored.
    """
    cut = saved(pieces(docs, tokenizer, size, end_id, id_col, text_col, with_ids), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps, _ = place(histogram, size)
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) | table[:, 1]
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((key, table))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = known.value
        at = np.searchsorted(keys, (length.to_numpy().astype(np.int64) << 48) | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 3] + rank.to_numpy() - rows[at, 1], "offset": rows[at, 4]})

    # A length with many pieces (most documents are cut into full ones) is dealt into as many buckets as it needs.
    deal = {k: -(-n // BUCKET_ROWS) for k, n in histogram.items() if n > BUCKET_ROWS}
    count = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(deal.items()) for x in pair])[F.col("length")], F.lit(1)) if deal else F.lit(1)
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.greatest(count, F.lit(LEAST_BUCKETS)).cast("long"))
    ranked = with_rank(cut, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], bucket)
    return ranked.withColumn("_p", find("length", "rank")).select(*cut.columns, "_p.sequence_id", "_p.offset")
