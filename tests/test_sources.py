import json

import pytest
from pyspark.sql import functions as F

from tideline.functions import positions
from tideline.sources import mongo, mysql, postgres
from tideline.sources.base import SourceNotAvailable, build_reader


def test_lsn(spark):
    got = spark.createDataFrame([("0/10",), ("16/B374D848",), ("FFFFFFFF/FFFFFFFF",)], "p string").select(positions.lsn(F.col("p"))).collect()
    assert [int(r[0]) for r in got] == [16, 0x16B374D848, 2**64 - 1]
    assert positions.parse_lsn("16/B374D848") == 0x16B374D848
    with pytest.raises(ValueError):
        positions.parse_lsn("nope")


def test_gtid_sets():
    assert positions.gtid_union("a:1-3,b:7", "a:4-5:9") == "a:1-5:9,b:7"
    assert positions.gtid_contains("a:1-5:9", "a:2-3:9") and not positions.gtid_contains("a:1-5", "a:5-6")
    assert positions.gtid_union("a:1-3,\nb:1") == "a:1-3,b:1"


def test_mongo_positions(spark):
    assert positions.parse_mongo_position("ts:5,2") == ("ts", (5, 2))
    assert positions.parse_mongo_position("token:ab:c") == ("token", "ab:c")
    with pytest.raises(ValueError):
        positions.parse_mongo_position("0/10")
    with pytest.raises(Exception, match="unknown position"):
        spark.createDataFrame([("0/10",)], "p string").select(positions.mongo_position(F.col("p"))).collect()


@pytest.mark.parametrize("name, parts", [("orders", ("public", "orders")), ("shop.orders", ("shop", "orders")), ("a.b.c", ("a", "b.c"))])
def test_table_names(name, parts):
    assert postgres.parse_table(name) == parts


@pytest.mark.parametrize("name", ["", ".t", "s."])
def test_bad_table_names(name):
    with pytest.raises(ValueError):
        postgres.parse_table(name)


def test_publication():
    assert postgres.reconcile(["t"], ["public.t", "public.extra"])[1] == ["public.extra is captured but not configured"]
    with pytest.raises(ValueError, match="public.u"):
        postgres.reconcile(["t", "u"], ["public.t"])
    assert postgres.reconcile(["t", "u"], ["public.t"], add=True)[0] == ["public.u"]


def test_progress_never_goes_back():
    p = postgres.Progress()
    assert p.lag() is None
    p.emit(100)
    p.ack(50)
    p.ack(40)
    p.idle(200)
    assert (p.acked, p.lag()) == (50, 150)
    p.ack(100)
    p.idle(300)
    assert (p.acked, p.lag()) == (300, 0)


def test_snapshot_action():
    assert postgres.snapshot_action(140009) == "EXPORT_SNAPSHOT" and "(" in postgres.snapshot_action(150000)


def test_unknown_relation_fails(spark):
    rel = spark.createDataFrame([(1, "public", "a")], "relation_id int, `schema` string, `table` string")
    with pytest.raises(Exception, match="unknown relation 2"):
        postgres.dispatch(spark.createDataFrame([(1, [1, 2])], "seq long, relation_ids array<int>"), rel).collect()


def test_mysql_dsn():
    assert mysql.parse_dsn("u:p@tcp(db:3307)/shop?x=1") == {"user": "u", "password": "p", "host": "db", "port": 3307, "database": "shop"}
    assert mysql.parse_dsn("u@tcp(db)/")["port"] == 3306
    for bad in ("u:p@unix(/s)/d", "postgres://x"):
        with pytest.raises(ValueError):
            mysql.parse_dsn(bad)


def test_mysql_settings():
    assert mysql.check_settings({"binlog_format": "ROW", "gtid_mode": "ON", "binlog_row_image": "FULL"}) == ([], [])
    errors, warnings = mysql.check_settings({"binlog_format": "MIXED", "gtid_mode": "OFF", "binlog_row_image": "MINIMAL"})
    assert len(errors) == 2 and len(warnings) == 1


def test_schema_cache():
    calls = []
    c = mysql.SchemaCache(lambda d, t: calls.append((d, t)) or ["id"])
    c.columns("a", "t"), c.columns("a", "t"), c.columns("b", "t")
    c.invalidate("a", "alter table t add c int")
    c.columns("a", "t"), c.columns("b", "t")
    assert calls == [("a", "t"), ("b", "t"), ("a", "t")]
    c.invalidate("", "DROP TABLE x")
    c.columns("b", "t")
    assert len(calls) == 4


def test_empty_row_events(spark):
    df = spark.createDataFrame([(1, "update", ["x"]), (2, "write", []), (3, "delete", ["y"])], "seq long, kind string, rows array<string>")
    assert [tuple(r) for r in mysql.row_pairs(df).select("seq", "op", "before", "after").collect()] == [(3, "d", "y", None)]


def test_mongo_values(spark):
    doc = {"_id": {"$oid": "65a"}, "d": {"$numberDecimal": "1.10"}, "n": {"x": [{"$timestamp": {"t": 5, "i": 2}}, {"$numberLong": "7"}]}, "at": {"$date": {"$numberLong": "1500"}}, "z": None}
    got = spark.createDataFrame([(json.dumps(doc),), (None,)], "doc string").select(mongo.normalised("doc")).collect()
    assert json.loads(got[0][0]) == {"_id": "65a", "d": "1.10", "n": {"x": ["5,2", 7]}, "at": "1970-01-01T00:00:01.5Z", "z": None} and got[1][0] is None


def test_mongo_update_without_document(spark):
    doc = {"_id": {"_data": "A1"}, "operationType": "update", "ns": {"db": "app", "coll": "c"}, "documentKey": {"_id": 7, "n": "old"}, "updateDescription": {"updatedFields": {"n": "new"}}}
    skip = [{**doc, "operationType": "invalidate"}, {**doc, "ns": {"db": "app"}}, {**doc, "operationType": "drop"}]
    got = mongo.change_events(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([doc, *skip])], "seq long, doc string")).collect()
    assert [(r.seq, r.op) for r in got] == [(0, "u"), (3, "t")] and got[0].after == {"_id": "7", "n": "new"} and got[0].position == "token:A1"


def test_mongo_start():
    assert mongo.start_time((5, 1), (5, 3)) == (5, 3)
    with pytest.raises(ValueError):
        mongo.start_time(None, None)


def test_readers():
    from tideline.config import Source

    with pytest.raises(ValueError, match="oracle"):
        build_reader(Source(type="oracle"))
    with pytest.raises(SourceNotAvailable):
        build_reader(Source(type="postgres")).read_changes(None, None)
