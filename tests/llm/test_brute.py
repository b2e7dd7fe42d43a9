"""Whole operators against plain Python: tokens, votes, duels, template trees, quoted threads, and the pipeline on awkward rows."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tideline.llm import decontaminate, langid, lines, packing, quality, queries, quotes, suffix, urls


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# op1


def test_packed_ids_are_the_librarys(spark):
    """Pieces laid end to end are what the untouched library says, sequences are gapless, and padding is small."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10**9, "a <|endoftext|> b<|endoftext|>"), (10**9 + 1, None), (10**9 + 2, "")], "doc_id long, text string"))
    out, texts = packing.pack(docs, with_ids=True).collect(), {r.doc_id: r.text or "" for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in texts.items():
        ids = np.frombuffer(b"".join(raw for _, raw in sorted(pieces[d])), "<u4").tolist()
        assert ids == [*library.encode(t, add_special_tokens=False).ids, 0] and [s for s, _ in sorted(pieces[d])] == list(itertools.accumulate([0, *[len(raw) // 4 for _, raw in sorted(pieces[d])]]))[:-1]
    assert library.encode("a <|endoftext|>", add_special_tokens=False).ids[-1] == 50256
    used, room = 0, 0
    for s in sequences.values():
        ends = list(itertools.accumulate([0, *[n for _, n in sorted(s)]]))
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= 1024
        used, room = used + ends[-1], room + (ends[-1] if ends[-1] & (ends[-1] - 1) == 0 else 1024)
    assert used >= 0.98 * room - 1024


# op3


def test_votes_row_by_row(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.train(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), m, block=7).collect()
    for r in rows[:60]:
        x = quality.features(r.text or "").astype(np.float64)
        z = (x - m.mean * bool(x.any())) @ m.project.astype(np.float64)
        z /= max(math.sqrt(sum(v * v for v in z)), 1e-12)
        votes = sorted(((float(z @ v), y, w) for v, y, w in zip(m.vectors, m.labels, m.weights)), key=lambda t: -t[0])[: quality.NEIGHBOURS]
        weight = [max(c, 0) ** 4 * w for c, _, w in votes]
        want = (sum(w * y for w, (_, y, _) in zip(weight, votes)) + 1e-3 * m.prior) / (sum(weight) + 1e-3)
        assert abs(want - r.score) < 1e-4 and r.predicted == int(r.score >= 0.5)


def test_labels_are_drawn_once(spark):
    """Repeated labels and documents don't widen the sample, and per_label is its bound."""
    docs = spark.createDataFrame([(i % 40, f"text number {i % 40} " * 5) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(800)], "doc_id long, quality int")
    m = quality.train(docs, labels, per_label=6)
    assert sorted(m.labels.tolist()) == [0.0] * 6 + [1.0] * 6 and m.prior == 0.5


# op10


def test_duels_row_by_row(spark):
    docs = documents(spark)
    m = langid.train(docs)
    for r in langid.identify(docs.select("doc_id", "text"), m).collect()[:80]:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = [*langid.features(r.text).astype(np.float64).tolist(), 1.0]
        dot = lambda w: sum(a * b for a, b in zip(x, w))  # noqa: E731, B023
        margins = {f: dot(w) for f, w in m.by_family.items()}
        family = max(sorted(margins), key=margins.get)
        score = 1 / (1 + math.exp(-2 * (margins[family] - max(v for f, v in margins.items() if f != family))))
        duels = {lang: [] for lang in m.families[family]}
        for (a, b), w in m.by_pair.items():
            if a in duels:
                duels[a].append(dot(w))
                duels[b].append(-dot(w))
        best = max(sorted(duels), key=lambda k: (sum(v >= 0 for v in duels[k]), sum(duels[k])))
        if duels[best]:
            score /= 1 + math.exp(-2 * min(duels[best]))
        assert r.lang_pred == best and abs(r.score - score) < 1e-6


def test_numerals_are_no_letters(spark):
    m = langid.train(documents(spark))
    rows = [(1, "½ ² Ⅷ 12"), (2, "٣ ४ ①"), (3, "ª"), (4, "1 a"), (5, "_ - _")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    assert {d for d, lang in got.items() if lang == "und"} == {1, 2, 5}


def test_many_languages(spark, monkeypatch):
    rows = [(i, f"{lang} word{lang} {lang}{i}", lang) for i in range(60) for lang in ("en", "de", "nl", "fr", "xx")]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=10)
    assert sorted(m.families["germanic"]) == ["de", "en", "nl"] and len(m.by_pair) == 3 and "only-xx" in m.families
    x = np.stack([langid.features(t) for _, t, _ in rows])
    assert [m.predict(v)[0] for v in x] == m.predict_all(x)[0]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 4)
    with pytest.raises(ValueError, match="more than 4 languages"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


# op5


def shaped(path):
    def one(s):
        if re.fullmatch(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", s) or (re.fullmatch(r"(?i)[0-9a-f]{8,}", s) and re.search("[0-9]", s) and re.search("(?i)[a-f]", s)):
            s = "{hex}"
        return re.sub("[0-9]+", "{id}", s)

    return "/".join(map(one, path.split("/")))


def brute_judge(rows, rules, variable, levels, smooth=4.0, differs=2.0, reject=0.5):
    """Verdicts by the template tree, host by host in plain Python."""
    pages = []
    for url in rows:
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        pages.append((host, path, max(fits, key=lambda r: len(r.host + r.path)) if fits else None))
    leaves = {}
    for host, path, rule in pages:
        b, n = leaves.get((host, shaped(path)), (0, 0))
        leaves[host, shaped(path)] = b + bool(rule and rule.verdict == "block"), n + bool(rule)
    segs = {}
    for host, leaf in leaves:
        s = leaf[1:].split("/") if leaf else []
        segs[host, leaf] = s[:levels] + (["/".join(s[levels:])] if len(s) > levels else [])
    up = dict.fromkeys(leaves, "")
    for level in range(max(map(len, segs.values()), default=0)):
        seen = {}
        for k, s in segs.items():
            if len(s) > level:
                seen.setdefault((k[0], up[k]), set()).add(s[level])
        up = {k: u if len(segs[k]) <= level else f"{u}/{'{*}' if len(seen[k[0], u]) > variable else segs[k][level]}" for k, u in up.items()}
    nodes = {}
    for k, u in up.items():
        b, n = nodes.get((k[0], u), (0, 0))
        nodes[k[0], u] = b + leaves[k][0], n + leaves[k][1]
    template = {k: k[1] for k in nodes}
    for level in reversed(range(max(map(len, segs.values()), default=0))):
        groups = {}
        for (host, branch), t in template.items():
            parts = t.split("/")
            if len(parts) > level + 1 and "{" not in parts[level + 1]:
                around = "/".join([*parts[: level + 1], "{+}", *parts[level + 2 :]])
                g = groups.setdefault((host, around), {}).setdefault(t, [0, 0])
                g[0] += nodes[host, branch][0]
                g[1] += nodes[host, branch][1]
        merged = {}
        for (host, around), kinds in groups.items():
            for known in (True, False):
                some = {t: g for t, g in kinds.items() if (g[1] > 0) == known}
                if len(some) < 2:
                    continue
                p = (sum(g[0] for g in some.values()) + 0.5) / (sum(g[1] for g in some.values()) + 1)
                for t, (b, n) in some.items():
                    if not known or abs(b / n - p) / math.sqrt(p * (1 - p) / n) < differs:
                        merged[host, t] = around if known else around.replace("{+}", "{-}")
        template = {k: merged.get((k[0], t), t) for k, t in template.items()}
    sums, hosts = {}, {}
    for (host, branch), t in template.items():
        for where, key in ((sums, (host, t)), (hosts, host)):
            b, n = where.get(key, (0, 0))
            where[key] = b + nodes[host, branch][0], n + nodes[host, branch][1]
    all_b, all_n = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    prior = all_b / all_n if all_n else 0.0
    out = []
    for host, path, rule in pages:
        t = template[host, up[host, shaped(path)]]
        own = (hosts[host][0] + smooth * prior) / (hosts[host][1] + smooth)
        b, n = sums[host, t]
        purity = (b + smooth * own) / (n + smooth)
        out.append((host, path, rule.host + rule.path if rule else None, rule.verdict if rule else ("block" if n and purity >= reject else "allow"), t, round(purity, 9)))
    return out


def test_template_tree(spark, monkeypatch):
    monkeypatch.setattr(urls, "VARIABLE", 4)
    monkeypatch.setattr(urls, "LEVELS", 3)
    rng = np.random.default_rng(5)
    rules = (urls.Rule("block", "a.com", "/spam/x"), urls.Rule("allow", "a.com", "/docs/x"), urls.Rule("block", "b.org", "/p/1"), urls.Rule("allow", "org", "/p/"))
    pick = lambda *v: v[rng.integers(len(v))]
    rows = [f"http://{pick('a.com', 'www.a.com', 'b.org', 'C.org')}/{pick('spam', 'docs', 'new', 'p')}/{pick('x', 'x1', 'y', '1', '17', 'abc', 'q', 'r', 's')}{pick('', '/1', '/deadbeef01', '/t/u', '/t/u/v/w')}{pick('', '?q=1', '#f')}" for _ in range(400)]
    rows += ["", "no scheme", "HTTP://A.COM", "http://a.com/" + "long/" * 3000, "http://a.com//x", *rows[:5]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)] + [(len(rows), None)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in urls.judge(df, rules).collect()}
    want = brute_judge([*rows, None], rules, 4, 3)
    assert len(got) == len(want) and [got[i] for i in range(len(want))] == want


# op7


def norm(text):
    return re.sub(r"\s+", " ", "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower())).strip()


def brute_links(messages):
    """messages: (conv, turn, text), turns distinct in a conversation: conv, turn -> (reply_conv, reply_turn, n_quotes, n_linked, depth)."""
    said, found = [], {}
    for conv, turn, text in messages:
        rows = [(len(re.sub("[^>|]", "", re.match(r"(?:[ \t]{0,3}[>|])*", x)[0])), re.sub(r"^(?:[ \t]{0,3}[>|])+[ \t]?", "", x)) for x in text.split("\n")]
        own = [w for i, (lv, w) in enumerate(rows) if lv == 0 and not (i + 1 < len(rows) and rows[i + 1][0] > 0 and w.endswith("wrote:"))]
        blocks = [(lv, [w for _, w in g]) for lv, g in itertools.groupby(rows, key=lambda r: r[0]) if lv]
        said.append((conv, turn, f" {norm(' '.join(own))} "))
        found[conv, turn] = ([(lv, norm(" ".join(ws))) for lv, ws in blocks if norm(" ".join(ws))], max(lv for lv, _ in rows))
    out = {}
    for (conv, turn), (blocks, depth) in found.items():
        links = []
        for at, (lv, p) in enumerate(blocks):
            holds = [(c, t) for c, t, s in said if f" {p} " in s]
            here = [t for c, t in holds if c == conv]
            if here and min(here) < turn:
                links.append((lv, -at, conv, min(here)))
            elif len(p) >= quotes.MIN_PASSAGE and any(c != conv for c, _ in holds):
                c = min(c for c, _ in holds if c != conv)
                links.append((lv, -at, c, min(t for d, t in holds if d == c)))
        before = [t for c, t, _ in said if c == conv and t < turn]
        src = min(links)[2:] if links else ((conv, max(before)) if before else (None, None))
        out[conv, turn] = (*src, len(blocks), len(links), depth)
    return out


def test_quoted_threads(spark):
    """Nested, wrapped anew, partly quoted, short, across conversations, a passage that many quote, a very long message."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)] + ["über", "naïve", "7"]
    say = lambda n: " ".join(rng.choice(words, n))
    wrap = lambda text, width, mark: "\n".join(mark + " ".join(text.split()[i : i + width]) for i in range(0, len(text.split()), width))
    hot = say(25)
    rows, texts = [], {}
    for conv in range(12):
        for turn in range(6):
            own, quoted = say(int(rng.integers(2, 40))), []
            if turn and rng.random() < 0.8:
                src = texts[conv, int(rng.integers(0, turn))]
                cut = src.split()
                a = int(rng.integers(0, len(cut)))
                if turn > 2 and rng.random() < 0.5:
                    quoted.append(wrap(texts[conv, 0], 5, "> > "))
                quoted.append(wrap(" ".join(cut[a:]), int(rng.integers(1, 9)), "> "))
            if rng.random() < 0.3:
                quoted.append(wrap(hot, 6, "| "))
            if conv > 3 and rng.random() < 0.3:
                quoted.append("On Monday, Ann wrote:\n" + wrap(texts[conv - 3, 1], 7, ">"))
            if rng.random() < 0.1:
                quoted.append(">\n> nothing anyone ever said before\n>")
            texts[conv, turn] = own
            rows.append((conv, turn, "\n\n".join([*quoted, own])))
    long = " ".join(f"n{i}" for i in range(30000))
    rows += [(20, 0, hot), (21, 0, long), (21, 1, wrap(" ".join(long.split()[29000:29900]), 11, "> ") + "\nyes"), (22, 0, wrap(long, 50, "> "))]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn, r.n_quotes, r.n_linked, r.depth) for r in quotes.link(df).collect()}
    want = brute_links(rows)
    assert got == want and sum(v[3] for v in want.values()) > 40


# names, nulls, extremes

CLASH = ["_id", "_bad", "_th", "_gone", "id", "t1", "t2", "h1", "h2", "gone", "judged", "item_id", "rank", "ID_", "key"]


def clashing(spark, rows):
    names = [c for c in CLASH if c != "item_id"]
    return spark.createDataFrame([(d, t, "en", s, 0, *["x"] * len(names)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))


def test_any_column_names(spark):
    rows = [(i, f"own {i}\nshared line", f"s{i}") for i in range(8)] + [(None, "shared line", "s1")]
    cut = lines.remove_boilerplate(clashing(spark, rows))
    got = {r.doc_id: (r.text, r.n_removed, r._id, r._gone) for r in cut.collect()}
    assert got[0] == ("own 0\nshared line", 0, "x", "x") and got[5] == ("own 5", 1, "x", "x") and got[None][0] == ""
    bench = spark.createDataFrame([(1, "seven plain words that make an item")], "item_id long, text string")
    left = decontaminate.decontaminate(clashing(spark, [(1, "it has seven plain words that make an item too", "s"), (2, "clean", "s")]), bench)
    assert [(r.doc_id, r._bad, r.t1) for r in left.collect()] == [(2, "x", "x")]


def test_the_largest_id_is_an_id(spark):
    top, text = 2**63 - 1, "the same words again and again, " * 8
    got = suffix.remove_repeats(clashing(spark, [(top, text, "s"), (1, text, "s"), (None, "other", "s")])).collect()
    assert {r.doc_id: r.n_removed > 0 for r in got} == {top: True, 1: True, None: False}  # each repeats itself
    bench = spark.createDataFrame([(1, "seven plain words that make an item")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(clashing(spark, [(top, "seven plain words that make an item", "s")]), bench).collect()] == [top]


def test_texts_longer_than_a_block(spark, monkeypatch):
    """Runs are found across the cuts of a long text."""
    monkeypatch.setattr(suffix, "BLOCK", 1 << 12)
    monkeypatch.setattr(suffix, "_POWERS", {})
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 30000))
    docs = [(1, text), (2, "x" * 50 + text[4000:4200] + "y" + text[8100:9000]), (3, text[:12000])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: (0, 0), 2: (1100, 2), 3: (12000, 1)}


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, repeats, empty texts and names that clash pass through all stages; an empty table gives nothing."""
    import corpus_pipeline as p

    good = [r for r in documents(spark).where("length(text) between 200 and 2000").limit(60).collect()]
    rows = [(None, "New: " + good[0].text, None), (None, good[1].text, None), (10**7, good[2].text + " more", "a"), (10**7, good[3].text, "b"), (10**7 + 8, good[2].text, "c"), (10**7 + 9, None, "a"), (10**7 + 10, "", "a"), (10**7 + 11, " \n ", None), (10**7 + 11, " \n ", None)]
    base = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    extra = clashing(spark, rows)
    more = base.select("*", *[F.lit("x").alias(c) for c in extra.columns[5:]]).unionByName(extra)
    for name, table in (("some", more), ("none", more.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for name, stage in p.STAGES[:-1]:
        docs = p.saved(stage(spark, docs, str(tmp_path / "some")), "t")
        assert docs.columns == more.columns, name
    # What copies, or nearly copies, a document of a smaller id goes, and so does what has no letter.
    assert docs.where("doc_id is null or doc_id >= 10000000").count() == 0 and docs.count() > 50
    out = p.run(spark, str(tmp_path / "some"))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_registered_names():
    assert [q for q in queries.QUERIES if re.match(r"op\d+_", q)] == ["op1_packing", "op2_suffix_array_dedup", "op3_quality_classifier", "op4_simhash_near_dedup", "op5_url_filters", "op6_exact_topk", "op7_chat_formatting", "op8_line_dedup", "op9_benchmark_decontamination", "op10_language_id"]
