"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, packing, quality, quotes, simhash, suffix, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(_fold(3) != 1)
    held_out = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    return quality.score(docs.select("doc_id", held_out, "text"), quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("id", F.lit(50)) == 0)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_table(spark, sf_dir, "conversations"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def train_language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(_fold(5) != 0))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held_out, "text"), train_language_model(docs)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_suffix_array_dedup, op3_quality_classifier, op4_simhash_near_dedup, op5_url_filters, op6_exact_topk, op7_chat_formatting, op8_line_dedup, op9_benchmark_decontamination, op10_language_id)}

def _template_sql() -> str:
    """op9 in SQL: tokens and templates as lists, windows by unnest, slots by position."""
    spaced = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(\p{N})(\p{L})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')"
    raw = f"list_filter(string_split({spaced}, ' '), lambda x: x <> '')"
    units = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
    can = rf"""list_transform(raw, lambda x, i: case when regexp_full_match(x, '\p{{N}}+') then '#n' when regexp_full_match(x, '\p{{Lu}}\p{{Ll}}+') then '#p'
      when i > 1 and regexp_full_match(raw[i - 1], '\p{{N}}+') and list_contains([{units}], lower(x)) then '#u' else lower(x) end)"""
    return f"""
        with i0 as (select distinct item_id, {raw} as raw from benchmark where item_id is not null), i1 as (select item_id, raw, {can} as can, least(len(raw), 12) as w from i0 where len(raw) > 0),
        d0 as (select distinct doc_id, {raw} as raw from documents), d1 as (select doc_id, raw, {can} as can from d0 where len(raw) > 0),
        i2 as (select item_id, w, ipos, can[ipos:ipos + w - 1] as part, raw[ipos:ipos + w - 1] as iraw from (select *, unnest(generate_series(1, len(raw) - w + 1)) as ipos from i1)),
        i3 as (select *, array_to_string(part, ' ') as t, len(list_filter(part, lambda x: x[1] <> '#')) < w * 0.5 as low from i2),
        d2 as (select doc_id, w, pos, array_to_string(can[pos:pos + w - 1], ' ') as t, raw[pos:pos + w - 1] as draw
               from (select *, unnest(generate_series(1, len(raw) - w + 1)) as pos from d1 cross join (select distinct w from i3))),
        m as (select doc_id, item_id, pos - ipos as diag, ipos, low, iraw = draw as verbatim, unnest(generate_series(0, i3.w)) as j, part, iraw, draw from d2 join i3 using (t) where not low or iraw = draw),
        s as (select doc_id, item_id, diag, ipos, low, verbatim, case when part[j][1] = '#' then part[j] end as p, iraw[j] as a, draw[j] as b from m),
        g as (select doc_id, item_id, diag, count(distinct ipos) filter (not low) as n, count(distinct (p, a, b)) filter (p is not null and not low) as slots, count(distinct (p, a)) filter (p is not null and not low) as na,
                count(distinct (p, b)) filter (p is not null and not low) as nb, coalesce(bool_and(a = b) filter (p is not null and not low), true) as same,
                count(distinct ipos) filter (verbatim) as own, count(distinct (p, a, b)) filter (verbatim and p is not null) as own_slots from s group by all),
        k as (select doc_id, item_id, n > 0 and slots = na and slots = nb as fits, * exclude (doc_id, item_id) from g),
        r as (select doc_id, item_id, fits, case when fits then n else own end as n, case when fits then slots else own_slots end as slots, not fits or same as same from k where fits or own > 0)
        select doc_id, item_id, arg_max(n, (fits, n, slots))::bigint as n_windows, arg_max(slots, (fits, n, slots))::bigint as n_slots, bool_or(same) as exact from r group by all"""


def _quote_sql(table: str) -> str:
    """op7 in SQL: lines, passages as islands of one level, originals by containment of whole words."""
    return rf"""
        with m as (select row_number() over () as k, conv_id, turn, role, text, string_split_regex(coalesce(text, ''), '\r?\n') as parts from {table}),
        u as (select k, conv_id, turn, unnest(generate_series(1, len(parts))) as ln, parts from m),
        l as (select k, conv_id, turn, ln, length(regexp_replace(regexp_extract(parts[ln], '^(?:[ \t]{{0,3}}[>|])*'), '[^>|]', '', 'g')) as level,
                regexp_replace(parts[ln], '^(?:[ \t]{{0,3}}[>|])+[ \t]?', '') as words from u),
        n as (select *, trim(regexp_replace(lower(words), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as norm, lead(level, 1, 0) over (partition by k order by ln) > 0 as introduces,
                lag(level, 1, -1) over (partition by k order by ln) <> level as begins from l),
        own as (select k, bool_or(level > 0) as quotes, max(level) as depth, regexp_replace(regexp_replace(coalesce(string_agg(words, chr(10) order by ln) filter (level = 0 and not (introduces and
                regexp_matches(words, '(?i)^\s*(on\b.*\bwrote|.{{1,80}}\b(wrote|said|writes|schrieb|écrit|escribió))\s*:\s*$'))), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') as left_ from n group by k),
        kept as (select m.k, conv_id, turn, role, case when own.quotes then own.left_ else text end as text, depth from m join own using (k)),
        said as (select k, conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' as norm from kept where text <> ''),
        b as (select *, sum(begins::int) over (partition by k order by ln) as block from n),
        q as (select k, conv_id, turn, any_value(level) as level, min(ln) as ln, trim(regexp_replace(string_agg(norm, ' ' order by ln), ' +', ' ', 'g')) as norm from b where level > 0 group by k, conv_id, turn, block),
        p as (select * from q where norm <> ''),
        o as (select x.norm, s.conv_id, min(s.turn) as src from (select distinct norm from p) x join said s on contains(s.norm, ' ' || x.norm || ' ') group by x.norm, s.conv_id),
        f as (select p.k, p.ln, p.level, case when h.src < p.turn then p.conv_id when length(p.norm) >= 12 then a.conv_id end as c, case when h.src < p.turn then h.src when length(p.norm) >= 12 then a.src end as t
              from p left join o h on h.norm = p.norm and h.conv_id is not distinct from p.conv_id
              left join o a on a.norm = p.norm and a.conv_id = (select min(z.conv_id) from o z where z.norm = p.norm and z.conv_id <> p.conv_id)),
        links as (select k, count(*) as n_quotes, count(t) as n_linked, arg_max(c, 1000000 - level * 1000 + ln) filter (t is not null) as c, arg_max(t, 1000000 - level * 1000 + ln) filter (t is not null) as t from f group by k),
        r as (select kept.*, row_number() over (partition by conv_id order by turn) - 1 as position, lag(turn) over (partition by conv_id order by turn) as last_turn from kept)
        select r.conv_id, r.turn, r.role, r.text, r.position, case when links.t is not null then links.c when last_turn is not null then r.conv_id end as reply_conv,
          coalesce(links.t, last_turn) as reply_turn, coalesce(n_quotes, 0)::bigint as n_quotes, coalesce(n_linked, 0)::bigint as n_linked, r.depth::int as depth
        from r left join links using (k)"""


#: conversations whose messages quote: every other one the turn before, wrapped anew, and the one before that, nested; a first turn some other conversation's.
QUOTING = r"""(with c as (select *, lag(text) over w as t1, lag(text, 2) over w as t2 from conversations window w as (partition by conv_id order by turn)),
  d as (select c.*, o.text as other from c left join conversations o on c.turn = 0 and c.conv_id % 7 = 3 and o.turn = 0 and o.conv_id = c.conv_id - 2)
  select conv_id, turn, role, case when turn % 2 = 1 and t2 is not null then '> > ' || replace(t2, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(replace(t1, chr(10), ' '), ', ', ',' || chr(10) || '> ') || chr(10) || text
    when turn % 2 = 1 then 'On Monday, ' || role || ' wrote:' || chr(10) || '> ' || replace(t1, chr(10), chr(10) || '> ') || chr(10) || chr(10) || text
    when other is not null then '| ' || replace(other, chr(10), chr(10) || '| ') || chr(10) || text else text end as text from d)"""


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator on conversations made to quote: nested, wrapped anew, and across conversations."""
    c = _table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    other = c.where("turn = 0").select((F.col("conv_id") + 2).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("text").alias("other"))
    d = c.withColumn("t1", F.lag("text").over(w)).withColumn("t2", F.lag("text", 2).over(w)).join(other, ["conv_id", "turn"], "left")
    mark = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))
    anew = F.concat(F.lit("> "), F.replace(F.replace("t1", F.lit("\n"), F.lit(" ")), F.lit(", "), F.lit(",\n> ")))
    odd = F.col("turn") % 2 == 1
    text = F.when(odd & F.col("t2").isNotNull(), F.concat_ws("\n", mark("t2", "> > "), anew, "text")).when(odd, F.concat(F.lit("On Monday, "), "role", F.lit(" wrote:\n"), mark("t1", "> "), F.lit("\n\n"), "text"))
    text = text.when(F.col("other").isNotNull() & (F.col("conv_id") % 7 == 3), F.concat(mark("other", "| "), F.lit("\n"), "text")).otherwise(F.col("text"))
    return quotes.link(d.select("conv_id", "turn", "role", text.alias("text")))


QUERIES["quoted_threads"] = quoted_threads


ORACLE: dict[str, str] = {
    "op9_benchmark_decontamination": _template_sql(),
    "op6_exact_topk": """
        with v as (select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
        from s qualify rank <= 5""",
    "op7_chat_formatting": _quote_sql("conversations"),
    "quoted_threads": _quote_sql(QUOTING),
    "op8_line_dedup": r"""
        with l as (select doc_id, coalesce(source, '') as site, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos,
                          unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
        b as (select line, min(doc_id) as first_id from l where trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
              group by line having count(distinct site) >= 6),
        k as (select l.*, b.line is not null and l.doc_id <> b.first_id as gone from l left join b using (line))
        select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from k group by doc_id""",
}
