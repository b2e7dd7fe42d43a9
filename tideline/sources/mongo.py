"""Decoding of change-stream documents held as JSON text (extended JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Change kinds and the ops they become; other kinds are skipped.
KINDS = {"insert": "c", "update": "u", "replace": "u", "delete": "d", "drop": "t"}


_TEXT = r'"(?:[^"\\]|\\.)*"'


def _unwrapped(text: Column, name: str, value: str, out: str) -> Column:
    """{"$name": value} becomes out; an inner quote of a text is always escaped, so no text is mistaken for a wrapper."""
    return F.regexp_replace(text, r'\{\s*"\$' + name + r'"\s*:\s*' + value + r'\s*\}', out)


def _date(after: Column) -> Column:
    """What follows a date's opening: milliseconds become RFC 3339 in UTC, a text stays; needs spark.sql.session.timeZone=UTC."""
    ms = F.regexp_extract(after, r"^(-?\d+)\s*\}", 1)
    stamp = F.regexp_replace(F.date_format(F.timestamp_millis(ms.try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), r"\.?0+$", "")
    number = F.concat(F.lit('"'), stamp, F.lit('Z"'), F.regexp_replace(after, r"^-?\d+\s*\}", ""))
    return F.when(ms != "", number).otherwise(F.regexp_replace(after, f"^({_TEXT})\\s*\\}}", "$1"))


def normalised(text: Column | str) -> Column:
    """Extended JSON as plain JSON text: ids and decimals are texts, dates RFC 3339 in UTC, cluster times 'T,I'. Null stays null."""
    out = F.col(text) if isinstance(text, str) else text
    for name in ("oid", "numberDecimal"):
        out = _unwrapped(out, name, f"({_TEXT})", "$1")
    for name in ("numberLong", "numberInt", "numberDouble"):
        out = _unwrapped(out, name, r'"(-?[0-9][0-9.eE+-]*)"', "$1")
    out = _unwrapped(out, "numberDouble", f"({_TEXT})", "$1")
    out = _unwrapped(out, "timestamp", r'\{\s*"t"\s*:\s*(\d+)\s*,\s*"i"\s*:\s*(\d+)\s*\}', '"$1,$2"')
    parts = F.split(out, r'\{\s*"\$date"\s*:\s*', -1)
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _date)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def _image(text: Column) -> Column:
    """Top-level fields of a JSON object as an image, in plain JSON; nested values stay JSON text."""
    return F.from_json(normalised(text), "map<string,string>")


def change_events(docs: DataFrame, text: str = "doc", source_id: str = "mongo-main", full_document: str = "updateLookup") -> DataFrame:
    """Change records of change-stream documents (columns seq and text).

    insert and replace carry the full document. An update without it carries the changed
    fields and the document key, as does any update if full_document is not updateLookup. A delete carries the image before, or the key. Other kinds and
    documents without a collection are skipped.
    """
    get = lambda path: F.get_json_object(text, path)
    kind = get("$.operationType")
    op = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    d = docs.withColumn("op", F.try_element_at(op, kind)).withColumn("coll", get("$.ns.coll")).where(F.col("op").isNotNull() & (F.coalesce("coll", F.lit("")) != ""))
    full, changed, key, before = (_image(get(p)) for p in ("$.fullDocument", "$.updateDescription.updatedFields", "$.documentKey", "$.fullDocumentBeforeChange"))
    # A changed field wins over the same field of the key.
    rest = F.map_filter(key, lambda k, v: ~F.coalesce(F.map_contains_key(changed, k), F.lit(False)))
    if full_document != "updateLookup":
        full = F.when(kind.isin("insert", "replace"), full)
    after = F.when(F.col("op").isin("c", "u"), F.coalesce(full, F.map_concat(changed, rest), changed, key))
    secs = F.coalesce(get("$.clusterTime.$timestamp.t"), get("$.clusterTime.t")).cast("long")
    return d.select(
        "seq",
        F.lit(source_id).alias("source_id"),
        F.coalesce(get("$.ns.db"), F.lit("")).alias("schema"),
        F.col("coll").alias("table"),
        "op",
        F.when(F.col("op") == "d", F.coalesce(before, key)).alias("before"),
        after.alias("after"),
        F.concat(F.lit("token:"), get("$._id._data")).alias("position"),
        F.timestamp_seconds(secs).alias("commit_ts"),
    )


def start_time(operation: tuple[int, int] | None, cluster: tuple[int, int] | None) -> tuple[int, int]:
    """The later of two cluster times: what a stream must start from before a snapshot is read."""
    known = [t for t in (operation, cluster) if t]
    if not known:
        raise ValueError("the server reported no cluster time; is it a replica set?")
    return max(known)
