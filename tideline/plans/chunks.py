"""Queries on chunked snapshots of a table whose key has two columns, with marks that come back in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Source
from ..operators import apply, snapshot
from ..sources.base import ChangelogReader
from ..sources.changelog import change_log
from ..streaming.delivery import Stopped
from ..streaming.runner import plan_resume
from ..streaming.service import Bootstrap
from .readers import _Router
from .registry import LOG, query
from .scratch import folder, kept, write_log

KEYS = ["id", "slot"]
COLUMNS = {"id": "bigint", "slot": "int", "kind": "string", "value": "double", "props": "string"}
KINDS = {"id": "bigint", "slot": "int"}
#: Rows a chunk, and log numbers between the low marks of two chunks, from a low mark to the read, and to the high mark.
SIZE, SPACING, READ, HIGH = 40, 400, 100, 250
PREFIX = "tideline"


def pair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log keyed by (id, slot); every fifth purchase moves its row to the next slot, with the old key in the before image."""
    log = change_log(spark, sf_dir)
    slot = (F.col("seq") - 1) % 3
    entry = lambda c: F.create_map(F.lit("slot"), c.cast("string"))
    moved = (F.col("op") == "u") & (F.col("after")["kind"] == "purchase") & (F.col("seq") % 5 == 0)
    old = F.create_map(F.lit("id"), F.col("after")["id"], F.lit("slot"), ((slot + 1) % 3).cast("string"))
    before = F.when(F.col("before").isNotNull(), F.map_concat("before", entry(slot))).when(moved, old)
    return log.withColumn("before", before).withColumn("after", F.when(F.col("after").isNotNull(), F.map_concat("after", entry(slot))))


PAIRS = f"""{LOG}, pairs as (select *, ((seq - 1) % 3)::int as slot, op = 'u' and kind = 'purchase' and seq % 5 = 0 as moved, (seq % 3)::int as old_slot from log)"""
STATE = """gone as (select id, slot, max(seq) as d from pairs where op = 'd' group by id, slot), fence as (select coalesce(max(seq), -1) as t from pairs where op = 't'),
  live as (select p.* from pairs p left join gone g on g.id = p.id and g.slot = p.slot, fence where p.op in ('c','u') and p.seq > greatest(coalesce(g.d, -1), t)),
  state as (select id, slot, arg_max(kind, seq) as kind, arg_max({'v': value}, seq).v::double as value, arg_max({'p': props}, seq) filter (has_props) as pp, max(seq) as last_seq from live group by id, slot)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, its numbers times ten, with marks between: of every chunk a low mark that was given up, a low and a high one, and marks of another prefix; the last chunk's high mark is lost."""
    log = pair_log(spark, sf_dir).withColumn("seq", F.col("seq") * 10)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    chunks = spark.range(0, n * 3 // 4 // SPACING + 1).withColumnRenamed("id", "chunk")
    low = (F.lit(n // 4) + F.col("chunk") * SPACING) * 10 + 5
    mark = lambda seq, prefix, kind: F.struct(seq.cast("long").alias("seq"), F.lit(prefix).alias("prefix"), F.lit(kind).alias("kind"))
    last = F.col("chunk") == n * 3 // 4 // SPACING
    every = F.array(mark(low - 60, PREFIX, "low"), mark(low, PREFIX, "low"), mark(low + HIGH * 10, PREFIX, "high"), mark(low + HIGH * 10 + 20, PREFIX, "high"), mark(low + 50, "other", "low"), mark(low + 100, "other", "high"))
    rows = chunks.select("chunk", F.explode(every).alias("m")).where(~(last & (F.col("m.kind") == "high") & (F.col("m.prefix") == PREFIX)))
    after = F.create_map(F.lit("prefix"), F.col("m.prefix"), F.lit("kind"), F.col("m.kind"), F.lit("chunk"), F.col("chunk").cast("string"))
    none = F.lit(None).cast("map<string,string>")
    marks = rows.select(F.col("m.seq").alias("seq"), F.lit("pg-main").alias("source_id"), F.lit("").alias("schema"), F.lit("").alias("table"), F.lit("w").alias("op"), none.alias("before"), after.alias("after"), F.lit("").alias("position"), F.lit(None).cast("timestamp").alias("commit_ts"))
    return log.unionByName(marks)


MARKS = f"""n as (select count(*) as n from events), marks as (select chunk, (n // 4 + {SPACING} * chunk) * 10 + 5 as lw, (n // 4 + {SPACING} * chunk) * 10 + 5 + {HIGH * 10} as hw from n, (select unnest(range(0, (select n * 3 // 4 // {SPACING} from n))) as chunk))"""


@query(f"with {MARKS} select * from marks")
def chunk_marks_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of each chunk as its marks came back; foreign, given-up and unfinished ones count for nothing."""
    return snapshot.marks(marked(spark, sf_dir), PREFIX)


def _ids(log: DataFrame) -> DataFrame:
    rows = log.where(~F.col("op").isin("t", "w"))
    return rows.select(F.explode(F.array_compact(F.array("after", "before"))).alias("i")).select(F.col("i")["id"].cast("bigint").alias("id"), F.col("i")["slot"].cast("int").alias("slot")).distinct()


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log without marks, plan by the marks that came back, rows of the chunks)."""
    both = spark.read.parquet(write_log(marked(spark, sf_dir), folder(spark, "marked-log")))
    log, windows = snapshot.without_marks(both), snapshot.marks(both, PREFIX)
    rank = snapshot.dense_rank(_ids(both), KEYS, F.floor(F.col("id") / 64))
    paged = rank.withColumn("chunk", F.floor(F.col("rank") / SIZE).cast("long")).drop("rank")
    plan = paged.join(windows, "chunk").withColumn("read_seq", F.col("lw") + READ * 10).select("chunk", *KEYS, "lw", "read_seq", "hw")
    path = folder(spark, "chunk-plan")
    plan.write.parquet(path)
    plan = spark.read.parquet(path)
    return log, plan, snapshot.read_chunks(log, plan, KEYS, COLUMNS, apply.apply_changes)


PLAN = f"""{PAIRS}, {MARKS}, ids as (select id, slot from pairs where op <> 't' union select id, old_slot from pairs where moved),
  plan as (select i.*, m.* from (select id, slot, (row_number() over (order by id, slot) - 1) // {SIZE} as chunk from ids) i join marks m using (chunk)),
  ev as (select p.*, c.chunk, c.lw, c.hw from pairs p join plan c on c.id = p.id and c.slot = p.slot where p.op <> 't' and p.seq * 10 <= c.lw + {READ * 10}),
  fenced as (select * from ev e where seq > coalesce((select max(t.seq) from pairs t where t.op = 't' and t.seq * 10 <= e.lw + {READ * 10}), -1)),
  page as (select chunk, id, slot, max(seq) filter (op <> 'd') as last_seq from fenced group by chunk, id, slot having max(seq) filter (op <> 'd') > coalesce(max(seq) filter (op = 'd'), -1)),
  touched as (select distinct c.chunk, c.id, c.slot from plan c join (select seq, id, slot from pairs where op <> 't' union all select seq, id, old_slot from pairs where moved) e on e.id = c.id and e.slot = c.slot where e.seq * 10 > c.lw and e.seq * 10 <= c.hw),
  cut as (select distinct m.chunk from marks m join pairs p on p.op = 't' and p.seq * 10 > m.lw and p.seq * 10 <= m.hw)"""


@query(f"with {PLAN} select chunk, id, slot, last_seq from page")
def chunk_pages_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every chunk as they stood between its marks."""
    return _pages(spark, sf_dir)[2].select("chunk", *KEYS, (F.col("last_seq") / 10).cast("long").alias("last_seq"))


@query(f"with {PLAN} select chunk, id, slot from touched")
def chunk_observed_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that events between the marks touch, by the old key as by the new one."""
    log, plan, _ = _pages(spark, sf_dir)
    return snapshot.observed(log, plan, KEYS, KINDS)


@query(f"with {PLAN} select chunk, id, slot from page where (chunk, id, slot) in (select (chunk, id, slot) from touched) or chunk in (select chunk from cut)")
def chunk_superseded_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, plan, rows = _pages(spark, sf_dir)
    return snapshot.superseded(log, plan, rows, KEYS, KINDS).select("chunk", *KEYS)


@query(f"with {PLAN} select p.chunk, p.id, p.slot, case when t.id is not null or c.chunk is not null then m.lw else m.hw end as at from page p join marks m on m.chunk = p.chunk left join touched t on t.chunk = p.chunk and t.id = p.id and t.slot = p.slot left join cut c on c.chunk = p.chunk")
def chunk_flush_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chunk's rows stand in the log: changed ones under their window, the others at its end."""
    log, plan, rows = _pages(spark, sf_dir)
    return snapshot.place_rows(log, plan, rows, KEYS, KINDS).select("chunk", *KEYS, "at")


@query(f"with {PAIRS}, ids as (select id, slot from pairs where op <> 't' union select id, old_slot from pairs where moved) select id, slot from ids where (id, slot) > (9, 1)")
def chunk_resume_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys still to be read after (9, 1) was the last one accepted: compared as numbers, so 10 comes after 9."""
    return snapshot.resume_after_key(_ids(pair_log(spark, sf_dir)), KEYS, ["9", "1"])


@query(f"with {PAIRS}, ids as (select id, slot from pairs where op <> 't' union select id, old_slot from pairs where moved) select id, slot from ids where (id, slot) > (7, 0) order by id, slot limit 25")
def chunk_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 keys after (7, 0) in row order."""
    return snapshot.keyset_page(_ids(pair_log(spark, sf_dir)), KEYS, [7, 0], 25)


@query("select 'public' as \"schema\", r_name as \"table\" from region where r_regionkey % 2 = 1")
def keyless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that chunks refuse, as they have no primary key."""
    from ..sources.postgres import primary_keys

    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    place = F.when(F.col("r_regionkey") % 2 == 0, F.lit(1))
    return snapshot.keyless(primary_keys(region.select(F.lit("public").alias("schema"), F.col("r_name").alias("table"), F.lit("id").alias("column"), place.alias("place"))))


@query("select 'n' || n_regionkey as \"schema\", 't' as \"table\", string_agg(n_name, ',' order by (n_nationkey * 7) % 25) as keys from nation group by n_regionkey")
def primary_keys_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key columns in the order of the index, not of the table."""
    from ..sources.postgres import primary_keys

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cols = nation.select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("schema"), F.lit("t").alias("table"), F.col("n_name").alias("column"), (F.col("n_nationkey") * 7 % 25).alias("place"))
    return primary_keys(cols).select("schema", "table", F.array_join("keys", ",").alias("keys"))


class LiveLog(ChangelogReader):
    """A stored log that grows while it is read: each look at its end finds it `step` events further."""

    def __init__(self, config: Source, start: int, step: int):
        super().__init__(config)
        self.at, self.step, self.keys = start, step, {"public.users": KEYS}

    def tables(self, spark: SparkSession) -> dict[str, list[str]]:
        return self.keys

    def end(self, spark: SparkSession) -> tuple[str, int]:
        last = super().end(spark)[1]
        self.at = min(self.at + self.step, last)
        return f"0/{self.at:04X}", self.at


def _live(spark: SparkSession, sf_dir: str) -> tuple[str, Source, int, int]:
    path = write_log(pair_log(spark, sf_dir), folder(spark, "live-log"))
    config = Source("changelog", "pg-main")
    config.changelog.path, config.changelog.max_files = path, 64
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rows = spark.read.parquet(path).select(F.coalesce("after", "before")["id"], F.coalesce("after", "before")["slot"]).distinct().count()
    return path, config, n, max(3, rows // 4)


@query(f"with {PAIRS}, {STATE} select id, slot, kind, value, pp.p as props from state")
def chunked_bootstrap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a two-column key between marks of a log that goes on, then the stream: the state of the whole log."""
    path, config, n, size = _live(spark, sf_dir)
    mirror = folder(spark, "mirror")
    router = _Router(spark, mirror, "public.users", KEYS, COLUMNS)
    reader = LiveLog(config, n // 4, max(1, n // 16))
    start = Bootstrap(spark, reader, router, router.hooks).begin(plan_resume(None, None), True, "chunked", size, "slot")
    assert router.store.snapshot_state("p")["phase"] == "done"
    router.stream(reader, start)
    return kept(spark, router.state().drop("last_seq"), "chunked-state", path, mirror)


@query(f"with {PAIRS}, {STATE} select id, slot, kind, value, pp.p as props from state")
def snapshot_crash_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leader that dies after its second chunk, or before it says that all is done, and one that goes on from what the control store holds: the same state."""
    path, config, n, size = _live(spark, sf_dir)
    mirror = folder(spark, "mirror")
    router = _Router(spark, mirror, "public.users", KEYS, COLUMNS)
    reader, accepted = LiveLog(config, n // 4, max(1, n // 16)), []
    save, complete = router.hooks.chunk_accepted, router.hooks.completed

    def chunk_accepted(table: str, key: str) -> None:
        save(table, key)
        accepted.append(key)
        if len(accepted) == 2:
            raise Stopped(table)

    def completed(*position) -> None:
        raise Stopped("public.users")  # truncates leave a table of fewer than two chunks

    router.hooks.chunk_accepted, router.hooks.completed = chunk_accepted, completed
    try:
        Bootstrap(spark, reader, router, router.hooks).begin(plan_resume(None, None), True, "chunked", size, "slot")
    except Stopped:
        pass
    router.hooks.chunk_accepted, router.hooks.completed = save, complete
    store = router.store
    plan = plan_resume(store.snapshot_state("p"), *store.progress("p"))
    assert plan.force_bootstrap != bool(accepted) and plan.chunk_table == ("public.users" if accepted else None)
    start = Bootstrap(spark, reader, router, router.hooks).begin(plan, True, "chunked", size, "slot")
    assert store.snapshot_state("p")["phase"] == "done"
    router.stream(reader, start)
    return kept(spark, router.state().drop("last_seq"), "crash-state", path, mirror)
