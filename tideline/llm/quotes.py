"""Chat formatting by quotation linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, saved, text_key, with_rank

#: Characters from which a normalised passage can link messages of different conversations, and tokens of the window it is looked up by.
MIN_PASSAGE, SPAN = 12, 8
BROADCAST_ROWS = 200_000


def _normal(text: Column) -> Column:
    """Letters and digits of a passage in lower case, one space between runs of others."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with `parts`: per line of the text its quote level (0: own words) and the words after the marks.

    A mark is '>' or '|' at the head of a line, with or without a space between marks.
    """
    lines = F.split(F.coalesce(text_col, F.lit("")), "\r?\n")

    def part(line: Column) -> Column:
        marks = F.regexp_extract(line, r"^(?:[ \t]{0,3}[>|])*", 0)
        rest = F.regexp_replace(line, r"^(?:[ \t]{0,3}[>|])+[ \t]?", "")
        return F.struct(F.length(F.regexp_replace(marks, r"[^>|]", "")).alias("level"), rest.alias("words"))

    return messages.withColumn("parts", F.transform(lines, part))


def own_words(parts: Column) -> Column:
    """The text without quotes and without the line that introduces one ('On ... wrote:'); null for a text without quotes."""
    keep = F.filter(parts, lambda p, i: (p["level"] == 0) & ~((F.get(parts, i + 1)["level"] > 0) & p["words"].rlike(r"(?i)^\s*(on\b.*\bwrote|.{1,80}\b(wrote|said|writes|schrieb|écrit|escribió))\s*:\s*$")))
    text = F.array_join(F.transform(keep, lambda p: p["words"]), "\n")
    cut = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return F.when(F.exists(parts, lambda p: p["level"] > 0), cut)


def _tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda x: x != "")


def _windows(tokens: Column, width: int, conv: Column | None = None) -> Column:
    """(hash, pos) of every window of `width` tokens; with a conversation, the hash holds it."""
    at = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda i: F.xxhash64(F.lit(width), F.array_join(F.slice(tokens, i, width), " "), *([] if conv is None else [F.lit("own"), conv]))
    return F.transform(at, lambda i: F.struct(of(i).alias("key"), i.alias("pos")))


def passages(parsed: DataFrame) -> DataFrame:
    """(mid, mid2, conv_id, turn, at, level, norm) of messages with parts: consecutive quoted lines of one level, however they are wrapped.

    at is the passage's first line; norm its letters and digits. Equal messages count once; a message's lines are dealt by
    message, so the window that joins them holds one message.
    """
    one = parsed.where(F.exists("parts", lambda p: p["level"] > 0)).dropDuplicates(["mid", "mid2"])
    lines = one.select("mid", "mid2", "conv_id", "turn", F.posexplode("parts").alias("at", "part")).where("part.level > 0").select("mid", "mid2", "conv_id", "turn", "at", "part.level", _normal(F.col("part.words")).alias("norm"))
    w = Window.partitionBy("mid", "mid2").orderBy("at")
    begins = F.coalesce((F.lag("at").over(w) != F.col("at") - 1) | (F.lag("level").over(w) != F.col("level")), F.lit(True))
    block = lines.withColumn("begins", begins.cast("int")).withColumn("block", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]), " ")
    found = block.groupBy("mid", "mid2", "block").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.min("at").alias("at"), F.first("level").alias("level"), joined.alias("norm"))
    return found.withColumn("norm", F.trim(F.regexp_replace("norm", " +", " "))).drop("block")


def _originals(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """(p1, p2, conv_id, src_turn): for each passage and conversation the earliest message whose own words hold the passage.

    A passage is looked up by one window of it, the least-hashed of its SPAN (or all its) tokens, among all windows of all
    messages; where that is found the passage's whole length is hashed in the message and compared with its 128 bits.
    Passages below MIN_PASSAGE characters are only looked for in their own conversation.
    """
    d = quoted.withColumn("tokens", _tokens(F.col("norm"))).withColumn("n", F.size("tokens")).withColumn("own", F.length("norm") < MIN_PASSAGE)
    widths = [tuple(r) for r in d.select(F.least("n", F.lit(SPAN)).alias("w"), "own").distinct().orderBy("w", "own").collect()]  # at most 2 * SPAN
    if not widths:  # nothing is quoted
        return own.select(F.col("mid").alias("p1"), F.col("mid2").alias("p2"), "conv_id", F.col("turn").alias("src_turn")).limit(0)
    anchor: Column = F.lit(None).cast("struct<key: bigint, pos: int>")
    for width, within in widths:
        anchor = F.when((F.least("n", F.lit(SPAN)) == width) & (F.col("own") == within), F.array_min(_windows(F.col("tokens"), width, F.col("conv_id") if within else None))).otherwise(anchor)
    wanted = saved(d.withColumn("a", anchor).select(F.col("a.key").alias("key"), F.col("a.pos").alias("from"), "n", "p1", "p2").distinct(), "quote-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    said = own.dropDuplicates(["mid", "mid2"]).withColumn("tokens", _tokens(_normal(F.col("text"))))
    every = F.concat(*[_windows(F.col("tokens"), width, F.col("conv_id") if within else None) for width, within in widths])
    seen = said.select("mid", "mid2", F.explode(every).alias("w")).select("mid", "mid2", "w.*")
    met = seen.join(F.broadcast(wanted) if few else wanted, "key").where(F.col("pos") >= F.col("from"))
    asked = saved(met.groupBy("mid", "mid2").agg(F.collect_set(F.struct((F.col("pos") - F.col("from") + 1).alias("at"), "n", "p1", "p2")).alias("asked")), "quote-asked")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS // 20 else asked
    there = said.join(side, ["mid", "mid2"]).withColumn("a", F.explode("asked")).withColumn("words", F.array_join(F.slice("tokens", F.col("a.at"), F.col("a.n")), " "))
    h1, h2 = text_key(F.col("words"))
    same = there.where((h1 == F.col("a.p1")) & (h2 == F.col("a.p2")))
    out = saved(same.groupBy("a.p1", "a.p2", "conv_id").agg(F.min("turn").alias("src_turn")), "quote-own")
    drop(wanted, asked)
    return out


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text_col: str = "text") -> DataFrame:
    """Per row: conv_id, turn, role, text (no quotes), position, reply_conv, reply_turn, n_quotes, n_linked, depth.

    Consecutive quoted lines of one level are a passage, whatever its wrapping; a passage without a letter or digit
    is none. Its original is a message whose own words hold it as a whole, word by word: the earliest
    earlier one of the same conversation, else the first elsewhere (passages below MIN_PASSAGE characters stay in
    their own conversation). A message answers
    the original of its last least-nested linked quote, and without one the turn before.
    position is the place in the conversation from 0 by turn, with messages of one turn in a
    fixed order of hashes, so a message never precedes what it answers in its conversation. n_quotes counts
    passages, depth is the deepest level of any quoted line. Null texts are null and empty ones empty, without quotes; null
    conversations form one, null turns come first; repeated rows get places in a row; an empty table gives no
    rows; other columns are ignored. Messages of a conversation never meet in one task.
    """
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text_col).alias("text"))
    # Equal messages share all but their place, so what is joined back goes by this key.
    key = F.xxhash64("conv_id", "turn", "role", "text").alias("mid"), F.xxhash64(F.lit(7), "conv_id", "turn", "role", "text").alias("mid2")
    p = parse(m).select("*", *key)
    deep = F.array_max(F.transform("parts", lambda x: x["level"]))
    flat = saved(p.select("conv_id", "turn", "role", F.coalesce(own_words(F.col("parts")), "text").alias("text"), deep.alias("depth"), "mid", "mid2"), "quote-messages")
    p1, p2 = text_key(F.col("norm"))
    quoted = saved(passages(p).where("norm <> ''").select("*", p1.alias("p1"), p2.alias("p2")), "quote-passages")
    first = _originals(quoted, flat.where("text <> ''").select("mid", "mid2", "conv_id", "turn", "text"))
    # Elsewhere: the first conversation that has it, and the first after that for those who are in it.
    one = first.groupBy("p1", "p2").agg(F.min(F.struct("conv_id", "src_turn")).alias("one"))
    two = first.join(one, ["p1", "p2"]).where(~F.col("conv_id").eqNullSafe(F.col("one.conv_id"))).groupBy("p1", "p2").agg(F.min(F.struct("conv_id", "src_turn")).alias("two"))
    away = one.join(two, ["p1", "p2"], "left")
    here = quoted.join(first.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("c"), "src_turn"), (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("q1", "q2", "c")
    far = F.when(~F.col("one.conv_id").eqNullSafe(F.col("conv_id")), F.col("one")).otherwise(F.col("two"))
    inside = F.col("src_turn") < F.col("turn")
    src = F.when(inside, F.struct("conv_id", "src_turn")).when(F.length("norm") >= MIN_PASSAGE, far)
    found = here.join(away, ["p1", "p2"], "left").select("mid", "mid2", "level", "at", src.alias("src"))
    links = found.groupBy("mid", "mid2").agg(F.count("*").alias("n_quotes"), F.count("src").alias("n_linked"), F.max_by("src", F.when(F.col("src").isNotNull(), F.struct(-F.col("level"), "at"))).alias("src"))
    # Places in a bucket of a turn, and buckets in the order of turns: no conversation has to fit a task.
    bucket = F.struct("turn", F.pmod("mid", F.lit(16)).alias("s"))
    ranked = with_rank(flat, ["conv_id"], [F.col("role"), F.col("mid"), F.col("mid2")], bucket, "position")
    turns = flat.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).drop("one")
    before = with_rank(saved(turns, "quote-turns"), ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / 1024), "k")
    before = saved(before.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("k").alias("k")), "quote-order")
    last = before.alias("a").join(before.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.k") == F.col("b.k") + 1)).select(F.col("a.c").alias("c"), F.col("a.t").alias("t"), F.col("b.t").alias("last_turn"))
    out = ranked.join(links, ["mid", "mid2"], "left").join(last, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    linked = F.col("src").isNotNull()
    return out.select(
        "conv_id", "turn", "role", "text", "position",
        F.when(linked, F.col("src.conv_id")).when(F.col("last_turn").isNotNull(), F.col("conv_id")).alias("reply_conv"),
        F.when(linked, F.col("src.src_turn")).otherwise(F.col("last_turn")).alias("reply_turn"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
