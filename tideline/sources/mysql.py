"""Decoding of row-based binary log events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statements that change the schema or end a transaction.
BOUNDARY = ("ALTER", "CREATE", "DROP", "RENAME", "TRUNCATE")

def is_boundary(query: Column) -> Column:
    q = F.upper(F.trim(query))
    return (q == "COMMIT") | q.rlike(f"^({'|'.join(BOUNDARY)})")


def invalidates_schema(query: Column) -> Column:
    return query.rlike("(?i)ALTER|DROP|CREATE|RENAME")


def stamp_positions(log: DataFrame, gtid: str = "gtid", start: str = "") -> DataFrame:
    """log with position: the GTID set of the last transaction that ended before each event.

    log: seq, file, boundary, gtid (the set executed at a boundary). The running value is
    carried by binlog file: within a file by a window, between files by each one's last
    boundary, so no window spans the whole log; the second window holds one row a file.
    """
    ended = F.when(F.col("boundary"), F.col(gtid))
    own = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = log.groupBy("file").agg(F.max_by(F.col(gtid), F.when(F.col("boundary"), F.col("seq"))).alias("_g"), F.min("seq").alias("_s"))
    carried = files.select(F.col("file").alias("_f"), F.last("_g", ignorenulls=True).over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    d = log.withColumn("_in", F.last(ended, ignorenulls=True).over(own)).join(carried, F.col("file") == F.col("_f"))
    return d.withColumn("position", F.coalesce("_in", "_before", F.lit(start))).drop("_in", "_before", "_f")


def row_pairs(events: DataFrame, kind: str = "kind", rows: str = "rows") -> DataFrame:
    """One change per row image, or per pair of images of an update; an odd image at the end is left out.

    kind: write, update or delete; rows: the array of images. Adds ordinal, op, before, after.
    """
    n = F.size(rows)
    pair = lambda i: F.struct(i.cast("int").alias("ordinal"), F.get(rows, (2 * i).cast("int")).alias("before"), F.get(rows, (2 * i + 1).cast("int")).alias("after"))
    one = lambda before: F.transform(rows, lambda r, i: F.struct(i.cast("int").alias("ordinal"), (r if before else F.when(F.lit(False), r)).alias("before"), (F.when(F.lit(False), r) if before else r).alias("after")))
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), pair))
    out = F.when(F.col(kind) == "update", pairs).when(F.col(kind) == "delete", one(True)).otherwise(one(False))
    op = F.when(F.col(kind) == "update", "u").when(F.col(kind) == "delete", "d").otherwise("c")
    return events.withColumn("_r", F.explode(out)).select(*[c for c in events.columns if c != rows], op.alias("op"), "_r.ordinal", "_r.before", "_r.after")


def captures(tables: list[str]) -> Column:
    """Whether schema.table is configured, in any case; no configuration captures everything."""
    if not tables:
        return F.lit(True)
    return F.lower(F.concat_ws(".", "schema", "table")).isin([t.lower() for t in tables])


def snapshot_tables(configured: list[str], known: list[str], database: str) -> list[str]:
    """Tables to read: those configured, each named database.table, else all known ones of the connection's database."""
    for name in configured:
        left, dot, right = name.partition(".")
        if not (left and dot and right):
            raise ValueError(f"table {name!r} must be named database.table")
    if configured:
        by_name = {k.lower(): k for k in known}
        missing = [t for t in configured if t.lower() not in by_name]
        if missing:
            raise ValueError(f"unknown table {missing[0]!r}")
        return [by_name[t.lower()] for t in configured]
    if not database:
        raise ValueError("name tables to read, or a database in the dsn")
    return sorted(k for k in known if k.partition(".")[0] == database)


def parse_dsn(dsn: str) -> dict[str, object]:
    """user, password, host, port, database of 'user:password@tcp(host:port)/database'."""
    m = re.fullmatch(r"(?:(?P<user>[^:@/]*)(?::(?P<password>.*))?@)?(?P<net>\w+)\((?P<addr>[^)]*)\)/(?P<database>[^?]*)(?:\?.*)?", dsn)
    if not m:
        raise ValueError("the dsn must read user:password@tcp(host:port)/database")
    if m["net"] != "tcp":
        raise ValueError(f"only tcp is supported, not {m['net']}")
    host, _, port = m["addr"].partition(":")
    return {"user": m["user"] or "", "password": m["password"] or "", "host": host, "port": int(port or 3306), "database": m["database"]}


def check_settings(settings: dict[str, str]) -> tuple[list[str], list[str]]:
    """(errors, warnings) of the server's variables."""
    errors, warnings = [], []
    if settings.get("binlog_format", "").upper() != "ROW":
        errors.append("binlog_format must be ROW")
    if settings.get("gtid_mode", "").upper() != "ON":
        errors.append("gtid_mode must be ON")
    if settings.get("binlog_row_image", "").upper() != "FULL":
        warnings.append("binlog_row_image is not FULL: images may lack columns")
    return errors, warnings


class SchemaCache:
    """Column names by (database, table); a schema change forgets a database, or all if it names none."""

    def __init__(self, lookup):
        self.lookup, self.known = lookup, {}

    def columns(self, database: str, table: str) -> list[str]:
        key = (database, table)
        if key not in self.known:
            self.known[key] = self.lookup(database, table)
        return self.known[key]

    def invalidate(self, database: str, query: str) -> None:
        if re.search("ALTER|DROP|CREATE|RENAME", query, re.I):
            self.known = {k: v for k, v in self.known.items() if database and k[0] != database}
