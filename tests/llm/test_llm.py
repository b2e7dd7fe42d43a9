"""The llm operators against brute force on small fixtures with awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.duck import connect, spark_rows, sql_rows
from tideline.llm import decontaminate, graph, langid, lines, packing, quality, queries, quotes, similar, simhash, suffix, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, start string, rank string, kind string"


def table(spark, rows, extra=("x",) * 6):
    """Documents (doc_id, text[, source]) with columns that clash with names used inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, *extra[:5]) for r in rows], DOCS)


AWKWARD = [(None, "null id"), (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (5, "same words here and there"), (6, "same words here and there"), (7, "ÄÖ 北京 😀 \u0000 x"), (8, "word " * 30000)]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, tmp_path, name):
    assert spark_rows(queries.QUERIES[name](spark, SF), str(tmp_path / "o"), duck) == sql_rows(duck, queries.ORACLE[name])


# packing


@pytest.mark.parametrize("size", [4, 16, 64])
def test_place(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        h = {int(k): int(v) for k, v in zip(rng.integers(1, size + 1, 8), rng.integers(1, 40, 8))}
        steps, n = packing.place(h, size)
        packs, seen = {}, set()
        for length, rank, count, first, offset in steps:
            for i in range(count):
                packs.setdefault(first + i, []).append((offset, length))
                assert (length, rank + i) not in seen
                seen.add((length, rank + i))
        assert len(seen) == sum(h.values()) and set(packs) == set(range(n))
        for p in packs.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= size


def test_tokens_equal_the_library():
    t = packing.Tokens(packing.default_tokenizer())
    rng = np.random.default_rng(0)
    alphabet = ["a", "B", " ", "  ", "\n", "'s", "7", ".", "é", "北", "😀", "\u00a0", "\t", "<|endoftext|>", "don't", ", "]
    for _ in range(300):
        text = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        assert t.encode(text).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark):
    rows = packing.pack(table(spark, AWKWARD), size=64, with_ids=True).collect()
    docs = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(len(packing.Tokens(packing.default_tokenizer()).encode(t or "")) + 1 for _, t in AWKWARD)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(table(spark, [])).count() == 0


# suffix arrays


def brute_repeats(docs, width):
    first, out = {}, []
    rows = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in docs]
    for d, b in rows:
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            first[k] = min(first.get(k, (d, i)), (d, i))
    for d, b in rows:
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (d, i):
                cover[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        kept = bytes(c for c, k in zip(b, cover) if not k)
        out.append((None if d == 2**63 - 1 else d, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_docs(seed):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "é", "x"]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(30) for _ in range(4)]
    docs = [(i, text(int(rng.integers(0, 20))) + "".join(" " + shared[k] for k in rng.integers(0, 4, rng.integers(0, 3))) + text(int(rng.integers(0, 20)))) for i in range(24)]
    return docs + [(24, docs[3][1]), (None, docs[4][1]), (25, "ab" * 300), (26, None), (27, ""), (9, docs[9][1]), (9, "other " + shared[0])]


@pytest.mark.parametrize("seed, group, hot, shard", [(0, 512, 10**9, 1 << 18), (1, 2, 10**9, 1 << 18), (2, 2, 1, 1 << 18), (3, 512, 1, 1 << 18), (4, 512, 10**9, 300), (5, 512, 10**9, 1000)])
def test_repeats(spark, monkeypatch, seed, group, hot, shard):
    """All ways through: anchors in one shard and over several, groups cut by longer anchors, and anchors dealt out by window."""
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "SHARD", shard)
    if hot == 1:
        monkeypatch.setattr(suffix, "SAMPLE", 1)
        monkeypatch.setattr(suffix, "HOT", 10**6)
    docs = repeated_docs(seed)
    got = suffix.remove_repeats(table(spark, docs).repartition(3), 100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats(docs, 100)


def test_repeats_edges(spark):
    assert suffix.remove_repeats(table(spark, [])).count() == 0
    docs = [(1, "a" * 99), (2, "a" * 99), (3, None)]
    assert [r.n_removed for r in suffix.remove_repeats(table(spark, docs)).collect()] == [0, 0, 0]


@pytest.mark.parametrize("seed", range(25))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.choice([0, 97, 98], rng.integers(1, 25)).tolist()) for _ in range(4)]
    texts += texts[:2]
    lens = np.array(list(map(len, texts)))
    codes, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lens) - lens
    piece = np.repeat(np.arange(len(texts)), lens)
    rest = lens[piece] - (np.arange(len(codes)) - begin[piece])
    order = suffix.suffix_array(codes, rest, piece)
    full = [[c + 1000 for c in texts[piece[i]][lens[piece[i]] - rest[i] :]] + [int(piece[i])] for i in range(len(codes))]
    assert order.tolist() == sorted(range(len(codes)), key=full.__getitem__)
    common = suffix.common_prefixes(codes, rest, order, 4)
    for j in range(1, len(order)):
        a, b = full[order[j - 1]], full[order[j]]
        assert common[j] == next(k for k in range(len(a)) if a[k] != b[k])


# simhash


def brute_fingerprint(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def test_fingerprints(spark):
    assert all(simhash.fingerprint(t, n) == brute_fingerprint(t, n) for _, t in AWKWARD for n in (1, 3, 5))
    native = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("One TWO three") == native % 2**64


@pytest.mark.parametrize("tile, bands", [(4, None), (512, None), (512, 5), (8, 6)])
def test_links_and_components(spark, monkeypatch, tile, bands):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {0, 2**64 - 1}
    for b in base.tolist():
        for _ in range(20):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bands=bands)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                p, q = find(signed[i]), find(signed[j])
                parent[max(p, q)] = min(p, q)
    assert {x: find(x) for x in signed} == {x: roots.get(x, x) for x in signed}


def test_near_duplicates_edges(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(table(spark, AWKWARD)).collect()}
    empty = "0" * 16
    assert got[1, empty] == got[2, empty] == got[3, empty] == 1 and len({got[k] for k in got if k[0] in (5, 6)}) == 1
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [10**6, 50, 0])
def test_long_chain(spark, monkeypatch, edges):
    monkeypatch.setattr(graph, "EDGES", edges)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 7)], "u long, v long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(i, 0) for i in range(201)} | {(500, 500)}


def test_sketches_refuse_no_similar_pair():
    rng = np.random.default_rng(4)
    refused = 0
    for n in (1, 5, 64, 65, 300, 2000, 9000):
        for cut in (0.0, 0.1, 0.11, 0.2, 0.5, 1.0):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[: n - int(cut * n)], rng.integers(0, 2**63, int(cut * n * rng.uniform(0, 2)), dtype=np.uint64)])
            if len(b):
                same = len(np.intersect1d(a, b))
                ok = similar.may_match(similar.sketch(a), n, similar.sketch(b), len(b))
                assert ok or 9 * same < 4 * (n + len(b))
                refused += not ok
    assert refused > 10


def edited(words, rng, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False).tolist():
        out[i] = f"edit{i}"
    return " ".join(out)


def test_near_copies_against_brute_force(spark, monkeypatch):
    """All pairs of similarity 0.8 or more meet, whatever the sample names as frequent."""
    rng = np.random.default_rng(3)
    common = [f"often{i}" for i in range(30)]
    texts = [" ".join(common)]
    for k in range(25):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(3, 160)))] + (common if k % 2 else [])
        texts += [" ".join(base)] + [edited(base, rng, min(len(base), n)) for n in (1, 2, 4)]
    docs = list(enumerate(texts)) + [(500, texts[5].upper()), (501, None), (502, " "), (None, texts[9])]
    sets = [frozenset(similar.shingles(similar.words_of(t)).tolist()) for _, t in docs]
    want = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    at = {t: w for (_, t), w in zip(docs, want)}
    rows = table(spark, docs).select("doc_id", "text", F.xxhash64("text").alias("h1"))
    for sample in (similar.SAMPLE, 0):
        monkeypatch.setattr(similar, "SAMPLE", sample)
        got = similar.near_copies(table(spark, docs)).join(rows, "h1").collect()
        groups = {}
        for r in got:
            groups.setdefault(bytes(r.component), set()).add(at[r.text])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))
    assert similar.near_copies(table(spark, [])).count() == 0


def test_pipeline_drops_unknown_languages(spark):
    import corpus_pipeline as p

    unknown = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        "xkcd qwrt zzpq vbnm lkjh wqzx",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**9 + i, t, "xx", "s", len(t)) for i, t in enumerate(unknown)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    model = p.train_language_model(docs)
    judged = langid.identify(extra, model).collect()
    assert all(r.lang_pred != "und" for r in judged)
    stage = langid.identify(docs.select(*extra.columns).unionByName(extra), model)
    kept = {r.doc_id for r in stage.where((F.col("lang_pred") != "und") & (F.col("score") > p.MIN_LANGUAGE_SCORE)).collect()}
    assert not any(10**9 + i in kept for i in range(len(unknown)))
    known = docs.where(F.length("text") >= 100)
    assert known.where(F.col("doc_id").isin(sorted(kept))).count() >= 0.99 * known.count()


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    copy = edited(base, rng, 5)
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(copy)).bit_count() > 3
    docs = table(spark, [(1, " ".join(base)), (2, copy), (3, " ".join(base[::-1]))])
    assert sorted(r.doc_id for r in p.simhash_near_dedup(spark, docs, SF).collect()) == [1, 3]


def test_pipeline_keeps_unrelated_rows_of_an_id(spark):
    import corpus_pipeline as p

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(None, f"a first text {i} " + " ".join(f"n{i}x{j}" for j in range(20))) for i in range(4)] + [(7, "one text under the id"), (7, "quite another one here"), (8, "one text under the id"), (None, "one TEXT under the id"), (None, None), (9, "")]
    kept = [(r.doc_id, r.text) for r in p.simhash_near_dedup(spark, table(spark, rows), SF).collect()]
    assert sorted(kept, key=repr) == sorted([*rows[:6], (9, "")], key=repr)
    left = p.benchmark_decontamination(spark, table(spark, [(None, leak), (7, "x " + leak), *rows[:6]]), SF)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(rows[:6], key=repr)


# lines


def test_lines(spark):
    rows = [(i, f"own {i}\nshared line\n\nshared line\nlocal", f"site{i % 7}") for i in range(14)] + [(20, None, "a"), (21, "", None), (22, "shared line", None), (22, "shared line", None), (None, "shared line\nx", "z"), (23, "local", "site0")]
    got = lines.remove_boilerplate(table(spark, rows), min_sites=6).collect()
    by = {r.doc_id: r for r in got}
    assert by[0].text == "own 0\nshared line\n\nshared line\nlocal" and by[0].n_removed == 0
    assert by[3].text == "own 3\n" and by[3].n_removed == 3 and by[20].text is None and by[20].n_lines == 0 and by[21].text == "" and by[21].n_lines == 1
    assert by[22].text == "" and by[None].text == "x" and by[23].text == "" and len(got) == len(rows)
    assert lines.remove_boilerplate(table(spark, [])).count() == 0


def test_lines_threshold_is_exact(spark):
    rows = [(100 * k + i, f"line {k}", f"s{i}") for k in (5, 6, 7) for i in range(k)]
    got = lines.remove_boilerplate(table(spark, rows), min_sites=6)
    assert {r.doc_id // 100 for r in got.where("n_removed > 0").collect()} == {6, 7}


# decontamination

ITEM = "If Anna buys 12 kg of red apples at 3 euros each and gives Bob half of the apples, how much did the rest cost Anna?"


def test_templates(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "short item of six words only"), (5, "Just Capital Names Here And There Are No Plain Words In It At All")], "item_id long, text string")
    again = ITEM.replace("Anna", "Carla").replace("12", "70").replace("kg", "lb").replace("Bob", "Dora")
    mixed = ITEM.replace("Anna", "Carla", 1)  # one person under two names, but many windows word for word
    odd = again.replace("Carla", "Eve", 1)  # one person under two names, and no window of its own words
    docs = [(1, "Before. " + ITEM + " After."), (2, again), (3, mixed), (10, odd), (4, "clean text about apples and pears that shares no passage with it"), (5, None), (6, ""), (7, "it is a short item of six words only indeed"), (8, "x " * 5000 + ITEM), (8, "x " * 5000 + ITEM), (None, ITEM), (9, "Every Word Here Has A Capital And So Matches Any Names At All Really")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 4), (8, 1), (None, 1)} and got[1, 1].exact and not got[2, 1].exact and got[3, 1].exact
    left = decontaminate.decontaminate(table(spark, docs), bench)
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 9, 10] and left.columns == table(spark, []).columns
    assert decontaminate.leaks(table(spark, []), bench).count() == 0 and decontaminate.leaks(table(spark, docs), bench.limit(0)).count() == 0


def test_items_of_names_and_numbers(spark):
    names = "Present were Anna Bell, Carl Dorn, Emma Falk, Gerd Hahn, Ida Jung, Karl Lenz and Mia Noll"
    sums = "Compute 12 + 7 * 3 - 4"
    bench = spark.createDataFrame([(1, names), (2, sums), (None, ITEM), (None, "an item without any id holds these plain words and a few more of them")], "item_id long, text string")
    docs = [(1, f"So: {names}."), (2, f"Task: {sums}."), (3, names.replace("Anna", "Olga").replace("Gerd", "Paul")), (4, "Compute 12 + 7 * 3 - 5"), (5, ITEM), (None, f"x {sums} y")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, None), (None, 2)} and all(r.exact and r.n_windows > 0 for r in got.values())
    assert sorted(r.doc_id for r in decontaminate.decontaminate(table(spark, docs), bench).collect()) == [3, 4]


def test_leaks_against_containment(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    planted = {(r.doc_id, r.item_id) for r in docs.alias("d").join(bench.alias("b"), F.contains("d.text", "b.text")).select("doc_id", "item_id").collect()}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == planted and planted


# classifiers


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    model = langid.train(docs)
    rows = langid.identify(table(spark, AWKWARD + [(9, "123 !!")]), model).collect()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 9} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(table(spark, AWKWARD), none).collect()} == {"und"} and langid.identify(table(spark, []), model).count() == 0


def test_language_features_of_long_texts():
    text = "der kleine hund läuft " * 9000
    raw = np.frombuffer((" " + " ".join(text.split()) + " ").encode(), np.uint8).astype(np.uint32)
    whole = np.bincount(((raw[:-1] << 8 | raw[1:]) * np.uint32(2654435761)) >> np.uint32(21), minlength=langid.DIMS) + np.bincount(((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:] | 1 << 24) * np.uint32(2654435761)) >> np.uint32(21), minlength=langid.DIMS)
    assert np.allclose(langid.features(text), np.sqrt(whole) / np.linalg.norm(np.sqrt(whole)), atol=1e-6)


def test_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op3_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in got]), np.array([r.quality for r in got])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.9
    none = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels.limit(0))
    rows = quality.score(table(spark, AWKWARD), none).collect()
    assert len(rows) == len(AWKWARD) and {r.score for r in rows} == {0.5} and quality.score(table(spark, []), none).count() == 0


# top-k


def brute_topk(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, d - len(v)))) for i, v in ok]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        best = sorted(((-int(np.dot(a, b)), i) for i, b in ok if i != q))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("part, step", [(4096, 512), (7, 3)])
def test_topk(spark, monkeypatch, part, step):
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "STEP", step)
    monkeypatch.setattr(topk, "HEAD", 20)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(160)]
    same = rows[3][1]
    rows += [(300 + i, same) for i in range(30)] + [(301, same), (400, None), (401, [None, 1.0]), (450, [float("nan")] * 6), (403, [float("inf")] * 6), (None, same), (500, [1.0, 2.0]), (404, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(df, F.pmod("id", F.lit(50)) == 0)
    assert {tuple(r) for r in got.collect()} == brute_topk(rows)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_topk_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.pmod("id", F.lit(50)) == 0).collect()] == [(0, 1, 1, 131072)]


# urls


def test_urls(spark):
    cases = [
        ("HTTP://WWW.Example.COM/en/1", "www.example.com", "/en/1", "com/en/", "block"),
        ("http://a.example.com/en/7x?q=1", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("https://example.net/de/81#t", "example.net", "/de/81", "example.net/de/8", "block"),
        ("https://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("https://a.org/es/", "a.org", "/es/", "org/es/", "block"),
        ("https://a.org/es", "a.org", "/es", None, None),
        ("https://com?x", "com", "", None, None),
        (None, "", "", None, None),
        ("no scheme", "", "", None, None),
        ("http://h.com:80/en/1/2/3/4/5/6/7/8/9/10", "h.com:80", "/en/1/2/3/4/5/6/7/8/9/10", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)] + [(0, cases[0][0], "h")], "page_id long, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert urls.judge(df.limit(0)).count() == 0


def test_url_templates(spark):
    """A template full of blocked pages is rejected beyond them, and a clean one is not."""
    rules = (urls.Rule("block", "h.com", "/spam/a"), urls.Rule("allow", "h.com", "/docs/a"))
    names = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)]
    rows = [f"http://h.com/spam/a{n}/1" for n in names] + [f"http://h.com/docs/a{n}/1" for n in names] + ["http://h.com/spam/zz/1", "http://h.com/docs/zz/1", "http://h.com/new/zz/1"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, rules).collect()}
    assert [got[i].verdict for i in (120, 121, 122)] == ["block", "allow", "allow"] and got[120].rule is None


# quotes


def test_quotes(spark):
    rows = [
        (1, 0, "user", "First thing I want to say.\nThe second line of words."),
        (1, 1, "assistant", "On Monday, Ann wrote:\n> First thing i want, to say\nI agree with that."),
        (1, 2, "user", "> > First thing I want to say.\n> I agree with that.\nSo do I, very much."),
        (1, 3, "user", "> never said by anyone here\nWhat is this?"),
        (2, 0, "user", "> The second line of words.\nSeen elsewhere."),
        (2, 1, "user", None),
        (2, 1, "user", ""),
        (None, 5, "user", "alone"),
        (None, None, None, None),
        (2, 2, "user", ">"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = {(r.conv_id, r.turn, r.position): r for r in quotes.link(df).collect()}
    assert len(got) == len(rows)
    a, b, c, d = (got[1, i, i] for i in range(4))
    assert (a.reply_turn, a.text) == (None, rows[0][3])
    assert (b.text, b.reply_conv, b.reply_turn, b.n_quotes, b.n_linked, b.depth) == ("I agree with that.", 1, 0, 1, 1, 1)
    assert (c.text, c.reply_turn, c.n_linked, c.depth) == ("So do I, very much.", 1, 2, 2)
    assert (d.reply_turn, d.n_quotes, d.n_linked) == (2, 1, 0)
    assert (got[2, 0, 0].reply_conv, got[2, 0, 0].reply_turn) == (1, 0) and got[2, 2, 3].text == ""
    assert quotes.link(df.limit(0)).count() == 0


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
    texts = {r.doc_id: r.text for r in kept.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in t for t in texts.values() for b in bench)
    prints = {d: simhash.fingerprint(t) for d, t in texts.items()}
    assert min((a ^ b).bit_count() for i, a in prints.items() for j, b in prints.items() if i < j) > 3
    out = p.run(spark, SF).collect()
    t = packing.Tokens(packing.default_tokenizer())
    assert {r.doc_id: r.doc_tokens for r in out} == {d: len(t.encode(x)) + 1 for d, x in texts.items()}
    # A clean document is one that no stage has a reason to drop.
    all_ = {r.doc_id: (r.text or "") for r in docs.collect()}
    lost = set(all_) - set(texts)
    first = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id <> component_id").collect()} | {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(lost - first) <= 0.02 * len(all_), lost - first
