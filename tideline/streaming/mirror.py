"""A mirror of a table as versioned Parquet, folded batch by batch."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DELETE, TRUNCATE, UPSERTS, row_key


class Mirror:
    """Rows of one table by key, each column with the log number that set it, in hash buckets under path.

    What is kept of a row is a maximum: per column the newest value, the newest upsert and
    the newest delete (a row that is gone stays as a tombstone), and for the table the
    newest truncate. Taking a maximum again, late or in another order changes nothing, so
    batches may repeat, overlap or come from a new checkpoint; no batch is told by its number.

    A batch is folded on its own and joined with the buckets it touches, once, on the key; only
    those are written anew. A pointer names the version of every bucket and is added
    last, so a failure leaves the old state whole; versions that neither this pointer nor the one before
    names are deleted. compact() drops tombstones that no replay can reach any more.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], columns: Mapping[str, str], buckets: int = 16):
        self.spark, self.path, self.keys, self.columns, self.buckets = spark, path.rstrip("/"), list(keys), dict(columns), buckets
        self.rest = [c for c in self.columns if c not in self.keys]
        cells = [f"c{i} struct<seq: bigint, v: {self.columns[c]}>" for i, c in enumerate(self.rest)]
        self.schema = ", ".join([*(f"`{k}` {self.columns[k]}" for k in self.keys), *cells, "up bigint", "gone bigint"])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/pointer")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def _read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/pointer/{number}", wholetext=True).first()[0])

    def _pointer(self) -> dict:
        """The newest pointer: the number of the state, the version of each bucket, and the newest truncate."""
        numbers = self._pointers()
        return self._read(numbers[-1]) if numbers else {"number": 0, "buckets": {}, "fence": -1}

    def _point(self, state: dict) -> None:
        fs, tmp = self._fs(f"{self.path}/pointer/tmp-{state['number']}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/pointer/{state['number']}")
        if not fs.rename(tmp, final):
            raise RuntimeError(f"state {state['number']} of {self.path} was written by someone else")
        numbers = self._pointers()
        keep = {(b, v) for n in numbers[-2:] for b, v in self._read(n)["buckets"].items()}
        for n in numbers[:-2]:
            for b, v in self._read(n)["buckets"].items():
                if (b, v) not in keep:
                    fs.delete(self._fs(self._place(b, v))[1], True)
            fs.delete(self._fs(f"{self.path}/pointer/{n}")[1], True)

    def _place(self, bucket: str, version: int) -> str:
        return f"{self.path}/v={version}/bucket={bucket}"

    def _rows(self, state: dict, only: Sequence[str] | None = None) -> DataFrame:
        places = [self._place(b, v) for b, v in sorted(state["buckets"].items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        """The rows that are there: columns and last_seq."""
        state = self._pointer()
        reset = F.greatest(F.coalesce("gone", F.lit(-1)), F.lit(state["fence"]))
        value = lambda i, c: F.when(F.col(f"c{i}.seq") > reset, F.col(f"c{i}.v")).alias(c)
        return self._rows(state).where(F.col("up") > reset).select(*self.keys, *[value(i, c) for i, c in enumerate(self.rest)], F.col("up").alias("last_seq")).select(*self.columns, "last_seq")

    def _folded(self, batch: DataFrame) -> DataFrame:
        """A batch in the form of the stored rows: one partial aggregation."""
        up = F.col("op").isin(*UPSERTS)
        key = F.when(up, row_key(self.keys, "after")).otherwise(row_key(self.keys, "before"))
        sent = lambda c: up & F.map_contains_key("after", F.lit(c))
        cell = lambda c: F.max(F.when(sent(c), F.struct("seq", F.col("after")[c].cast(self.columns[c]).alias("v"))))
        rows = batch.where((F.col("op") != TRUNCATE) & key.isNotNull()).select("seq", "op", "after", *[key[k].cast(self.columns[k]).alias(k) for k in self.keys])
        return rows.groupBy(*self.keys).agg(*[cell(c).alias(f"c{i}") for i, c in enumerate(self.rest)], F.max(F.when(up, F.col("seq"))).alias("up"), F.max(F.when(F.col("op") == DELETE, F.col("seq"))).alias("gone"))

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """For writeStream.foreachBatch; batch_id says nothing."""
        state = self._pointer()
        number = state["number"] + 1
        batch = batch.persist()
        try:
            fence = batch.where(F.col("op") == TRUNCATE).agg(F.max("seq")).first()[0]
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
            new = self._folded(batch).withColumn("bucket", bucket).persist()
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most `buckets` names
            fence = max(state["fence"], -1 if fence is None else fence)
            if not touched and fence == state["fence"]:
                return
            merged = state | {"number": number, "fence": fence}
            if touched:
                maxima = [f"c{i}" for i in range(len(self.rest))] + ["up", "gone"]
                old = self._rows(state, touched).withColumn("bucket", bucket)
                both = old.unionByName(new).groupBy("bucket", *self.keys).agg(*[F.max(c).alias(c) for c in maxima])
                both.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={number}")
                merged["buckets"] = state["buckets"] | dict.fromkeys(touched, number)
            self._point(merged)
            new.unpersist()
        finally:
            batch.unpersist()

    def compact(self, below: int) -> None:
        """Drop rows that a delete or truncate ended before log number `below`, from which on alone events can come again."""
        state = self._pointer()
        if not state["buckets"]:
            return
        number = state["number"] + 1
        reset = F.greatest(F.coalesce("gone", F.lit(-1)), F.lit(state["fence"]))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        kept = self._rows(state).where((F.coalesce("up", F.lit(-1)) > reset) | (reset >= below)).withColumn("bucket", bucket)
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={number}")
        fs, _ = self._fs(self.path)
        left = {b: number for b in state["buckets"] if fs.exists(self._fs(self._place(b, number))[1])}
        self._point(state | {"number": number, "buckets": left})
