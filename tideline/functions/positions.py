"""Codecs for the resume positions of the sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsn(position: Column) -> Column:
    """A log sequence number 'X/Y' in hexadecimal as DECIMAL(20,0): it is unsigned and has 64 bits."""
    half = [F.conv(F.split_part(position, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)") for i in (1, 2)]
    return (half[0] * F.lit(4294967296).cast("decimal(11,0)") + half[1]).cast("decimal(20,0)")


def lsn_text(high: Column, low: Column) -> Column:
    return F.format_string("%X/%08X", high, low)


def parse_lsn(text: str) -> int:
    m = re.fullmatch(r"([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})", text or "")
    if not m:
        raise ValueError(f"not a log sequence number: {text!r}")
    return int(m[1], 16) << 32 | int(m[2], 16)


def lag_bytes(server: Column, acked: Column) -> Column:
    """Bytes from acked to server, never negative; unknown (null) while either is 0 or null."""
    return F.when((server > 0) & (acked > 0), F.greatest(server - acked, F.lit(0))).cast("decimal(20,0)")


def mongo_position(position: Column) -> Column:
    """struct(kind, token, t, i) of 'token:<data>' or 'ts:<T>,<I>'; any other prefix raises."""
    ts = F.regexp_extract(position, r"^ts:(\d+),(\d+)$", 0) != ""
    kind = F.when(position.startswith("token:"), "token").when(ts, "ts").otherwise(F.raise_error(F.concat(F.lit("unknown position: "), F.coalesce(position, F.lit("null")))))
    number = lambda g: F.regexp_extract(position, r"^ts:(\d+),(\d+)$", g)
    return F.struct(
        kind.alias("kind"),
        F.when(position.startswith("token:"), F.substring(position, 7, F.length(position))).alias("token"),
        F.when(ts, F.try_to_number(number(1), F.lit("99999999999999")).cast("long")).alias("t"),
        F.when(ts, F.try_to_number(number(2), F.lit("99999999999999")).cast("long")).alias("i"),
    )


def parse_mongo_position(text: str) -> tuple[str, object]:
    if text.startswith("token:"):
        return "token", text[6:]
    if m := re.fullmatch(r"ts:(\d+),(\d+)", text):
        return "ts", (int(m[1]), int(m[2]))
    raise ValueError(f"unknown position: {text!r}")


# A GTID set is {source uuid: disjoint sorted [first, last] intervals}, written 'uuid:1-5:7,uuid2:1'.


def parse_gtid(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for part in re.sub(r"\s", "", text).split(","):
        if not part:
            continue
        uuid, *spans = part.split(":")
        if not spans:
            raise ValueError(f"not a GTID set: {text!r}")
        for span in spans:
            first, _, last = span.partition("-")
            out.setdefault(uuid.lower(), []).append((int(first), int(last or first)))
    return {u: _joined(s) for u, s in out.items()}


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def gtid_text(gtids: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(u + "".join(f":{a}" if a == b else f":{a}-{b}" for a, b in spans) for u, spans in sorted(gtids.items()))


def gtid_union(*texts: str) -> str:
    out: dict[str, list[tuple[int, int]]] = {}
    for t in texts:
        for u, spans in parse_gtid(t).items():
            out[u] = _joined(out.get(u, []) + spans)
    return gtid_text(out)


def gtid_contains(whole: str, part: str) -> bool:
    w = parse_gtid(whole)
    return all(any(a <= x and y <= b for a, b in w.get(u, [])) for u, spans in parse_gtid(part).items() for x, y in spans)
