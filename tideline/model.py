"""The change record: one row per change of a source row, and the keys derived from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CREATE, UPDATE, DELETE, READ, TRUNCATE = "c", "u", "d", "r", "t"
OPS = (CREATE, UPDATE, DELETE, READ, TRUNCATE)
UPSERTS = (CREATE, UPDATE, READ)

_IMAGE = T.MapType(T.StringType(), T.StringType(), True)

#: An absent key of an image was not sent; a key with NULL is an explicit NULL.
#: seq is the arrival order and the only ordering key; position is opaque.
SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("schema", T.StringType(), False),
        T.StructField("table", T.StringType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("before", _IMAGE, True),
        T.StructField("after", _IMAGE, True),
        T.StructField("position", T.StringType(), False),
        T.StructField("commit_ts", T.TimestampType(), True),
    ]
)


def qualified(schema: Column | str = "schema", table: Column | str = "table") -> Column:
    """schema.table, or the table alone where the source has no schema."""
    s, t = (F.col(x) if isinstance(x, str) else x for x in (schema, table))
    return F.when(s == "", t).otherwise(F.concat_ws(".", s, t))


def idempotency_key() -> Column:
    """source|table|position. Rows of one snapshot, chunk or transaction share it: don't deduplicate by it."""
    return F.concat_ws("|", "source_id", qualified(), "position")


def image() -> Column:
    """The after image, or the before image where there is no after."""
    return F.when(F.size(F.coalesce("after", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))) > 0, F.col("after")).otherwise(F.col("before"))


def row_key(keys: Sequence[str], of: Column | str = "after") -> Column:
    """Key values as one struct; null unless the image has every key column."""
    m = F.col(of) if isinstance(of, str) else of
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.map_contains_key(m, F.lit(k))
    return F.when(m.isNotNull() & whole, F.struct(*[m[k].alias(k) for k in keys]))


def dedupe_key(keys: Sequence[str]) -> Column:
    """What tells one event from another within a position: table, position, op and row."""
    return F.struct("source_id", qualified().alias("q"), "position", "op", F.coalesce(row_key(keys, "after"), row_key(keys, "before")).alias("key"))


def keys_for(keys: Mapping[str, Sequence[str]]) -> Column:
    """Key columns configured for the event's table: by qualified name, then by bare name; else null."""
    if not keys:
        return F.lit(None).cast("array<string>")
    table = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, qualified()), F.try_element_at(table, F.col("table")))
