"""Decoding of logical-replication messages, and the choices made when a capture starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of a column in a tuple.
NULL, UNCHANGED, TEXT = "n", "u", "t"
#: Kinds of messages that change rows, and the ops they become.
ROW_KINDS = {"I": "c", "U": "u", "D": "d", "T": "t"}


def decode_tuple(names: Column, kinds: Column, values: Column) -> Column:
    """A tuple as an image: null columns are present, unchanged out-of-line ones absent, columns beyond the relation ignored."""
    cells = F.slice(F.arrays_zip(names.alias("name"), kinds.alias("kind"), values.alias("value")), F.lit(1), F.least(F.size(names), F.size(kinds)))
    sent = F.filter(cells, lambda c: c["kind"] != UNCHANGED)
    return F.map_from_entries(F.transform(sent, lambda c: F.struct(c["name"].alias("key"), F.when(c["kind"] != NULL, c["value"]).alias("value"))))


def typed(image: Column, columns: dict[str, str]) -> list[Column]:
    """Columns of an image by their declared types; a text that doesn't parse gives null (see unparsed)."""
    return [image[c].try_cast(t).alias(c) for c, t in columns.items()]


def unparsed(image: Column, columns: dict[str, str]) -> Column:
    """The texts of an image that don't parse by their declared types, by column: what typed() can't keep."""
    odd = F.array_compact(F.array(*[F.when(image[c].isNotNull() & image[c].try_cast(t).isNull(), F.struct(F.lit(c).alias("key"), image[c].alias("value"))) for c, t in columns.items()]))
    return F.map_from_entries(odd)


def dispatch(messages: DataFrame, relations: DataFrame) -> DataFrame:
    """Row messages with the name of their relation; one truncate of several relations becomes several rows.

    messages: seq, relation_ids array<long>, ... ; relations: relation_id, schema, table.
    A relation that is not known fails the query when it is read.
    """
    rows = messages.select("*", F.posexplode("relation_ids").alias("ordinal", "relation_id"))
    named = rows.join(F.broadcast(relations), "relation_id", "left")
    return named.withColumn("table", F.coalesce("table", F.raise_error(F.concat(F.lit("unknown relation "), F.col("relation_id").cast("string")))))


def snapshot_action(server_version: int) -> str:
    """How a replication slot is asked to export its snapshot, by server version (15.2 is 150002)."""
    return "(SNAPSHOT 'export')" if server_version >= 150000 else "EXPORT_SNAPSHOT"


def parse_table(name: str) -> tuple[str, str]:
    """(schema, table); public is the default schema."""
    schema, dot, table = name.partition(".")
    if not dot:
        schema, table = "public", name
    if not schema or not table:
        raise ValueError(f"invalid table name {name!r}")
    return schema, table


def captured_tables(publication: DataFrame) -> DataFrame:
    """(schema, table) of a publication in order."""
    return publication.select("schema", "table").distinct().orderBy("schema", "table")


def primary_keys(columns: DataFrame) -> DataFrame:
    """(schema, table, keys) of index columns (schema, table, column, place): keys in the order of the index; null without any."""
    placed = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "column"))))
    keys = F.transform(placed, lambda x: x["column"])
    return columns.groupBy("schema", "table").agg(placed.alias("p"), keys.alias("keys")).select("schema", "table", F.when(F.size("keys") > 0, F.col("keys")).alias("keys"))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quoted_table(name: str) -> str:
    return ".".join(map(quoted, parse_table(name)))


def publication_statement(name: str, tables: list[str], exists: bool = False) -> str:
    """Creates a publication of the tables (none: of all), or adds them to one that exists."""
    listed = ", ".join(map(quoted_table, tables))
    if exists:
        return f"ALTER PUBLICATION {quoted(name)} ADD TABLE {listed}"
    return f"CREATE PUBLICATION {quoted(name)} FOR " + (f"TABLE {listed}" if tables else "ALL TABLES")


def page_statement(table: str, keys: list[str], size: int, resume: bool) -> str:
    """One page of a table in key order; `resume` starts after a key given by parameters, compared as a row."""
    by = ", ".join(map(quoted, keys))
    after = f" WHERE ({by}) > ({', '.join('%s' for _ in keys)})" if resume else ""
    return f"SELECT * FROM {quoted_table(table)}{after} ORDER BY {by} LIMIT {int(size)}"


#: Prefix of this engine's marks among the log's messages.
MARKS = "tideline"


def mark_statement() -> str:
    """Writes a mark (prefix and text by parameters) into the log, with the transaction it stands in."""
    return "SELECT pg_logical_emit_message(true, %s, %s)"


def replication_dsn(dsn: str) -> str:
    """The same connection for replication: as an URL's parameter, or as a keyword."""
    if "://" in dsn:
        return dsn + ("&" if "?" in dsn else "?") + "replication=database"
    return f"{dsn} replication=database".strip()


def drop_slot(drop: Callable[[], bool], sleep: Callable[[float], None], timeout: float = 30, every: float = 2) -> None:
    """Drop what an earlier run left: drop() says whether it is gone, or raises while somebody still holds it."""
    waited, last = 0.0, None
    while True:
        try:
            if drop():
                return
        except Exception as e:  # noqa: BLE001  still in use
            last = e
        if waited >= timeout:
            raise TimeoutError(f"the replication slot is still in use after {timeout:g} s: {last}")
        sleep(every)
        waited += every


class Progress:
    """What a reader may acknowledge: never backwards, and idle progress only if everything emitted is acknowledged."""

    def __init__(self, acked: int = 0):
        self.acked, self.emitted, self.server = acked, acked, 0

    def emit(self, position: int) -> None:
        self.emitted = max(self.emitted, position)

    def ack(self, position: int) -> None:
        self.acked = max(self.acked, position)

    def idle(self, server: int) -> None:
        self.server = max(self.server, server)
        if self.acked >= self.emitted:
            self.acked = self.emitted = max(self.acked, server)

    def lag(self) -> int | None:
        return max(self.server - self.acked, 0) if self.server and self.acked else None


def reconcile(configured: list[str], captured: list[str], all_tables: bool = False, add: bool = False) -> tuple[list[str], list[str]]:
    """(tables to add, warnings) for a publication that exists; missing tables fail unless add is set."""
    want, have = {parse_table(t) for t in configured}, {parse_table(t) for t in captured}
    missing = sorted(".".join(t) for t in want - have)
    if missing and not all_tables and not add:
        raise ValueError("the publication does not capture " + ", ".join(missing))
    extra = sorted(".".join(t) for t in have - want) if want else []
    return ([] if all_tables else missing), [f"{t} is captured but not configured" for t in extra]
