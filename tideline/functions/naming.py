"""Names and texts made for sinks: identifiers, statements, topics, subjects, partition keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DELETE, TRUNCATE, image, keys_for, qualified


def quote_ident(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def target(schema: str | None = None) -> Column:
    """Quoted table name; a schema given takes the place of the event's."""
    s = F.lit(schema) if schema else F.col("schema")
    return F.when(s == "", quote_ident(F.col("table"))).otherwise(F.concat(quote_ident(s), F.lit("."), quote_ident(F.col("table"))))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_")


def kafka_topic(prefix: str = "", fixed: str = "") -> Column:
    """The fixed topic if there is one, else prefix.schema.table in the characters a topic may have."""
    if fixed:
        return F.lit(fixed)
    parts = [F.lit(prefix)] * bool(prefix) + [F.when(F.col("schema") != "", F.col("schema")), F.col("table")]
    return F.regexp_replace(F.concat_ws(".", *parts), "[^A-Za-z0-9._-]", "_")


def nats_subject(prefix: str) -> Column:
    """prefix.schema.table; characters with a meaning in subjects become '_' in the last two."""
    clean = lambda c: F.regexp_replace(c, "[.*> ]", "_")
    return F.concat_ws(".", F.lit(prefix), F.when(F.col("schema") != "", clean(F.col("schema"))), clean(F.col("table")))


def partition_key(keys: Mapping[str, Sequence[str]]) -> Column:
    """table, or table|key|... where key columns are configured; a value that is missing or NULL reads <nil>."""
    cols, img = keys_for(keys), image()
    values = F.transform(cols, lambda k: F.coalesce(F.try_element_at(img, k), F.lit("<nil>")))
    return F.when(F.coalesce(F.size(cols), F.lit(0)) <= 0, qualified()).otherwise(F.concat_ws("|", qualified(), F.array_join(values, "|")))


def upsert_statement(keys: Mapping[str, Sequence[str]], schema: str | None = None, soft_delete: bool = False, deleted_column: str = "_deleted_at") -> Column:
    """The parametrised statement that applies one valid event to a PostgreSQL table.

    Columns are sorted, so equal shapes give equal texts. An upsert sets only the columns
    the event holds; a truncate needs no key.
    """
    cols, table = keys_for(keys), target(schema)
    names = F.array_sort(F.map_keys("after"))
    joined = lambda a: F.array_join(a, ", ")
    updates = F.transform(F.filter(names, lambda c: ~F.array_contains(cols, c)), lambda c: F.concat(quote_ident(c), F.lit(" = excluded."), quote_ident(c)))
    if soft_delete:
        updates = F.array_append(updates, F.concat(quote_ident(F.lit(deleted_column)), F.lit(" = NULL")))
    conflict = F.when(F.size(updates) > 0, F.concat(F.lit("DO UPDATE SET "), joined(updates))).otherwise("DO NOTHING")
    upsert = F.concat(
        F.lit("INSERT INTO "), table, F.lit(" ("), joined(F.transform(names, quote_ident)), F.lit(") VALUES ("),
        joined(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat(F.lit("$"), i.cast("string")))),
        F.lit(") ON CONFLICT ("), joined(F.transform(cols, quote_ident)), F.lit(") "), conflict,
    )
    where = F.array_join(F.transform(cols, lambda k, i: F.concat(quote_ident(k), F.lit(" = $"), (i + 1).cast("string"))), " AND ")
    stamp = quote_ident(F.lit(deleted_column))
    if soft_delete:
        delete = F.concat(F.lit("UPDATE "), table, F.lit(" SET "), stamp, F.lit(" = now() WHERE "), where)
        truncate = F.concat(F.lit("UPDATE "), table, F.lit(" SET "), stamp, F.lit(" = now() WHERE "), stamp, F.lit(" IS NULL"))
    else:
        delete, truncate = F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), where), F.concat(F.lit("DELETE FROM "), table)
    return F.when(F.col("op") == TRUNCATE, truncate).when(F.col("op") == DELETE, delete).otherwise(upsert)
