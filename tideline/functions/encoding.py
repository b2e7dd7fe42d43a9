"""Wire encodings of change events: JSON as a column expression, protobuf by an Arrow UDF."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT_TYPES = {"json": "application/json", "protobuf": "application/x-protobuf"}


#: Texts that JSON holds as they are; to_json costs several times as much.
PLAIN = r"\A[ !#-\[\]-~]*\z"


def _quoted(text: Column) -> Column:
    one = F.to_json(F.array(text))
    return F.when(text.rlike(PLAIN), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def image_json(image: Column, numbers: Iterable[str] = ()) -> Column:
    """An image as a JSON object with sorted keys; columns named in numbers stay bare, and NULL is null."""
    numbers = tuple(numbers)

    def entry(e: Column) -> Column:
        value = F.when(e["value"].isNull(), "null")
        value = value.when(e["key"].isin(*numbers), e["value"]) if numbers else value
        return F.concat(_quoted(e["key"]), F.lit(":"), value.otherwise(_quoted(e["value"])))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(image)), entry), ","), F.lit("}"))


def timestamp_text(ts: Column) -> Column:
    """RFC 3339 in UTC without trailing zeros; year 1 for none. Needs spark.sql.session.timeZone=UTC."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.concat(F.regexp_replace(full, r"\.?0+$", ""), F.lit("Z")), F.lit("0001-01-01T00:00:00Z"))


def json_event(numbers: Iterable[str] = ()) -> Column:
    """The event as one JSON object. Fields come in the record's order; empty images are left out; <, > and & are escaped."""
    numbers = tuple(numbers)
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    part = lambda name: F.when(F.coalesce(F.size(name), F.lit(0)) > 0, field(name, image_json(F.col(name), numbers)))
    text = F.concat_ws(",", *[field(n, _quoted(F.col(n))) for n in ("source_id", "schema", "table", "op")], part("before"), part("after"), field("position", _quoted(F.col("position"))), field("commit_ts", _quoted(timestamp_text(F.col("commit_ts")))))
    text = F.concat(F.lit("{"), text, F.lit("}"))
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


#: Field numbers of the wire message.
FIELDS = {"source_id": 1, "schema": 2, "table": 3, "op": 4, "before": 5, "after": 6, "position": 7, "commit_ts": 8}


@functools.cache
def message_class():
    """The protobuf message type, built once a process."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory, struct_pb2, timestamp_pb2

    pool = descriptor_pool.DescriptorPool()
    for m in (struct_pb2, timestamp_pb2):
        pool.AddSerializedFile(m.DESCRIPTOR.serialized_pb)
    f = descriptor_pb2.FileDescriptorProto(name="tideline/event.proto", package="tideline", syntax="proto3")
    f.dependency.extend([struct_pb2.DESCRIPTOR.name, timestamp_pb2.DESCRIPTOR.name])
    message = f.message_type.add(name="ChangeEvent")
    kinds = {"before": ".google.protobuf.Struct", "after": ".google.protobuf.Struct", "commit_ts": ".google.protobuf.Timestamp"}
    for name, number in FIELDS.items():
        d = message.field.add(name=name, number=number, label=1, type=11 if name in kinds else 9)
        if name in kinds:
            d.type_name = kinds[name]
    pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("tideline.ChangeEvent"))


def encode_message(event: dict, numbers: Iterable[str] = (), cls=None) -> bytes:
    """One event as protobuf bytes. A value that a Struct refuses becomes its text; no timestamp is no field."""
    m = (cls or message_class())()
    for name in ("source_id", "schema", "table", "op", "position"):
        setattr(m, name, event.get(name) or "")
    for name in ("before", "after"):
        values = event.get(name)
        if values is None:
            continue
        out = getattr(m, name)
        out.SetInParent()
        for k, v in values.items():
            if k in numbers and isinstance(v, str):
                v = float(v)
            try:
                out[k] = v
            except (ValueError, TypeError):
                out[k] = str(v)
    if (ts := event.get("commit_ts")) is not None and not pd.isna(ts):
        m.commit_ts.FromDatetime(ts.to_pydatetime() if hasattr(ts, "to_pydatetime") else ts)
    return m.SerializeToString(deterministic=True)


def protobuf_event(numbers: Iterable[str] = ()) -> Column:
    """The event as protobuf bytes, batch by batch through Arrow."""
    numbers = tuple(numbers)

    @F.pandas_udf("binary")
    def encode(rows: pd.DataFrame) -> pd.Series:
        cls = message_class()
        return pd.Series([encode_message({k: dict(v) if k in ("before", "after") and v is not None else v for k, v in r.items()}, numbers, cls) for r in rows.to_dict("records")], dtype=object)

    return encode(F.struct(*FIELDS))


ENCODERS: dict[str, Callable[..., Column]] = {"json": json_event, "protobuf": protobuf_event}


def encoder(name: str = "") -> tuple[Callable[..., Column], str]:
    """(expression builder, content type); no name is json, an unknown one raises."""
    name = name or "json"
    if name not in ENCODERS:
        raise ValueError(f"unknown encoding {name!r}; known: {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name], CONTENT_TYPES[name]


def encode(df: DataFrame, fmt: str = "json", column: str = "payload", numbers: Iterable[str] = ()) -> DataFrame:
    build, content_type = encoder(fmt)
    return df.withColumn(column, build(numbers)).withColumn("content_type", F.lit(content_type))
