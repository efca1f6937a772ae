"""Operators on pairs and spans against brute force, and their edge cases."""

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from changelake.llm import chunk_dedup, common, graph, ngram_join, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def made_texts(seed, count=120, words=80):
    """Copies, near copies, shared passages, junk, repeats within a text, nulls and empty texts."""
    rng = random.Random(seed)
    word = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [[rng.choice(word) for _ in range(rng.randint(1, words))] for _ in range(count // 4)]
    passage = [rng.choice(word) for _ in range(90)]
    out = []
    for i in range(count):
        text = list(rng.choice(base))
        kind = i % 6
        if kind == 1:
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(word)
        elif kind == 2:
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[rng.randint(0, 20):rng.randint(60, 90)]
        elif kind == 3:
            text = text * rng.randint(1, 12)
        elif kind == 4:
            text = [rng.choice(word) for _ in range(rng.randint(0, 9))]
        out.append((i, (" " if i % 5 else "\n").join(text).title() if i % 7 == 0 else " ".join(text)))
    out += [(count, None), (count + 1, ""), (count + 2, " \t\n"), (count + 3, "one"), (count + 4, "ONE"),
            (count + 5, "x" * 3000), (count + 6, "ab" * 1500), (count + 7, "ab" * 1500 + "c"),
            (count + 8, " ".join(word) * 12)]
    return out + [out[1], out[1]]


@pytest.mark.parametrize("rule", [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_join_links_as_brute_force_does(spark, rule):
    for seed in (1, 2):
        rows = made_texts(seed)
        got = ngram_join.link(spark.createDataFrame(rows, DOCS), ngram_join.Rule(*rule))
        assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.linked(rows, *rule)


def test_join_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.link(docs, ngram_join.Rule(4, 85, 100))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.linked(rows, 4, 85, 100)


def test_join_in_tiles_and_with_a_long_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    rows = made_texts(3, 200)
    # Many near copies of one text: blocks far above the tile, whose ends do not link directly.
    rng, words = random.Random(9), [f"w{i}" for i in range(120)]
    for i in range(60):
        words[rng.randrange(120)] = f"v{i}"
        rows.append((1000 + i, " ".join(words)))
    got = ngram_join.link(spark.createDataFrame(rows, DOCS), ngram_join.Rule(4, 85, 100))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.linked(rows, 4, 85, 100)


def test_join_with_null_and_repeated_ids_and_other_columns(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, "other words of this one document here"), (7, text), (9, None)]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows],
                               "doc_id long, text string, component_id string, n int, mark int")
    got = ngram_join.link(df, ngram_join.Rule(4, 85, 100))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(
        [(None, 37, None), (5, 37, 5), (5, 4, 5), (7, 37, 5), (9, 0, 9)], key=repr)
    assert ngram_join.link(spark.createDataFrame([], DOCS)).count() == 0


def test_join_takes_small_batches_and_workers_give_back(spark, monkeypatch):
    documents = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "x")], DOCS)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert rows_of(ngram_join.link(documents), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]
    assert int(spark.conf.get(setting)) <= 1 << 20
    common.prepare(spark)
    assert int(spark.conf.get(setting)) == 4 << 20
    given = []
    pool = type("Pool", (), {"release_unused": lambda self: given.append(1)})()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2] and given == [1]


def test_texts_that_only_share_a_passage_are_not_searched(spark, monkeypatch):
    across, asked = ngram_join._across, []
    monkeypatch.setattr(ngram_join, "_across", lambda blocks, *rest: (
        asked.append(blocks.select("doc_id").distinct().count()), across(blocks, *rest))[1])
    passage = " ".join(f"p{i}" for i in range(42))
    rows = [(d, " ".join(f"w{d}-{i}" for i in range(58)) + " " + passage) for d in range(300)]
    rows.append((1000, rows[7][1] + " more"))
    got = ngram_join.link(spark.createDataFrame(rows, DOCS), ngram_join.Rule(4, 85, 100))
    assert rows_of(got, "doc_id", "component_id") == sorted([(d, d) for d in range(300)] + [(1000, 7)], key=repr)
    assert asked[0] < 75


def test_linked_sets_keep_a_mark_in_any_order():
    import numpy as np

    rng = np.random.default_rng(7)
    for rule in (ngram_join.Rule(4, 85, 100), ngram_join.Rule(5, 80, 100)):
        for n in (6, 9, 14, 25, 40, 90, 400):
            for _ in range(40):
                a = rng.integers(0, 2**64, n, dtype=np.uint64)
                gone = rng.integers(0, int(n * (rule.over - rule.part) / (rule.over + rule.part)) + 1)
                b = np.concatenate([a[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)])
                a, b = np.unique(a), np.unique(b)
                linked = rule.over * len(np.intersect1d(a, b)) >= rule.part * len(np.union1d(a, b))
                if not linked or len(np.setxor1d(a, b)) == 0:
                    continue
                kept = []
                for tokens in (a, b):
                    bounds = np.array([0, len(tokens)])
                    marks, _ = ngram_join.group_marks(tokens, bounds, rule)
                    rests = ngram_join.group_rests(tokens, bounds, rule)
                    keep = set()
                    for parity in (0, 1):
                        own = marks[(marks & np.uint64(1)) == parity]
                        extra = own[(own & np.uint64(2)) != 0]
                        own = np.sort(own[(own & np.uint64(2)) == 0])
                        keep |= set(own[:len(own) - int(rests[parity][0])].tolist()) | set(extra.tolist())
                    kept.append(keep)
                assert kept[0] & kept[1], (n, gone)


def test_count_tree_keeps_what_a_scan_keeps():
    import numpy as np

    rng, rule = np.random.default_rng(4), ngram_join.Rule(4, 85, 100)
    points = rng.poisson(5, (300, 16)).astype(np.int32)
    points[100:200] = points[50] + rng.integers(0, 2, (100, 16))
    sizes = points.sum(1)
    tree = ngram_join.CountTree(points, sizes)
    for i in range(0, 300, 17):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) >= rule.shared(sizes[i], sizes))
        assert sorted(tree.survivors(points[i], sizes[i], rule)) == list(want)


@pytest.mark.parametrize("length", [80, 400])
def test_repeats_go_as_brute_force_says(spark, length):
    for seed in (5, 6):
        rows = made_texts(seed, words=200)
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), length)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.removed(rows, length)


def test_repeats_in_long_texts_and_parts(spark, monkeypatch):
    rows = made_texts(8, words=300)
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    want = brute.removed(rows, 400)
    got = rows_of(suffix_dedup.remove_repeats(docs, 400, batches=3), "doc_id", "n_bytes", "n_removed", "n_spans",
                  "kept_sha256")
    assert got == want


def test_minimisers_of_parts_are_those_of_the_whole():
    import numpy as np
    import pyarrow as pa

    text = random.Random(3).choices("abc d", k=9000)
    column = pa.array(["".join(text)])
    (_, data, offsets, _), = suffix_dedup.parts(column, 400)
    whole = {(int(a), int(p)) for a, _, f, l in zip(*suffix_dedup.minimisers(data, offsets, 400), strict=True)
             for p in range(f, l + 1)}
    old, suffix_dedup.PART = suffix_dedup.PART, 2000
    try:
        parts = set()
        for _, data, offsets, base in suffix_dedup.parts(column, 400):
            for a, _, f, l in zip(*suffix_dedup.minimisers(data, offsets, 400), strict=True):
                parts |= {(int(a) + base, int(p) + base) for p in range(f, l + 1)}
    finally:
        suffix_dedup.PART = old
    assert parts == whole and len(whole) == 9000 - 399
    values = np.random.default_rng(1).integers(0, 99, 100)
    assert list(suffix_dedup.sliding_min(values, 7)) == [min(values[i:i + 7]) for i in range(94)]


def test_repeats_of_the_table_and_of_an_empty_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.remove_repeats(docs.withColumn("t", F.lit(1)).withColumn("starts", F.lit(2)), 400)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.removed(rows, 400)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS), 400).count() == 0


def test_index_family_sizes_double(spark):
    family = suffix_dedup.IndexFamily()
    found = []
    for i in range(5):
        batch = spark.createDataFrame([(k, k * 100 + i) for k in (i, 50, 60 + i // 2)], "key long, place long")
        found.append({r["key"] for r in family.add(batch).collect()})
    assert found == [set(), {50, 60}, {50}, {50, 61}, {50}]
    assert [rank for rank, _ in family.levels] == [2, 0]


# -- chunks

def test_gear_is_the_rolling_form():
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert list(chunk_dedup.gear(data)) == want


def plain_cuts(text):
    data, h, last, out = text.encode(), 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        cut = i + 1
        if b in b" \t\n\v\f\r" and h >> 30 == 0 and cut >= 32 and cut - last >= 24 and cut < len(data):
            while cut - last > chunk_dedup.MOST:
                last += chunk_dedup.MOST
                while data[last] & 0xC0 == 0x80:
                    last += 1
                out.append(last)
            if cut > last:
                out.append(cut)
                last = cut
    while len(data) - last > chunk_dedup.MOST:
        last += chunk_dedup.MOST
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def test_chunks_of_joined_texts_are_those_of_each():
    import numpy as np

    texts = [t or "" for _, t in made_texts(11, words=300)] + ["日" * 2000]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ends = chunk_dedup.cuts(np.frombuffer(b"".join(data), np.uint8), offsets)
    owner = np.searchsorted(offsets, ends - 1, "right") - 1
    for i, text in enumerate(texts):
        assert list(ends[owner == i] - offsets[i]) == plain_cuts(text), i


def test_chunk_dedup_keeps_the_first_of_a_passage(spark):
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passage, clean = words(70), [words(200) for _ in range(20)]
    rows = [(i, f"{c[:len(c) // 2]} {passage} {c[len(c) // 2:]}" if i % 2 else c) for i, c in enumerate(clean)]
    rows += [(30, None), (31, ""), (None, clean[0]), (40, clean[3])]
    df = spark.createDataFrame([(d, t, 7, 8) for d, t in rows], "doc_id long, text string, n_spans int, start int")
    got = {r["doc_id"]: r for r in chunk_dedup.deduplicate(df).collect()}
    assert len(got) == len(rows)
    middle = passage[len(passage) // 3:2 * len(passage) // 3]
    for i, text in rows:
        if i is None or i in (30, 31):
            assert got[i]["text"] == text and got[i]["n_removed"] == 0
        elif i == 40:
            assert got[i]["n_removed"] > len(text) * 0.8
        elif i % 2 and i > 1:
            assert middle not in got[i]["text"] and len(got[i]["text"]) >= len(clean[i]) - 80
            assert len(got[i]["text"].encode()) == got[i]["n_bytes"] - got[i]["n_removed"]
        elif i > 0:
            assert got[i]["text"] == text, i
    # The row without an id has the first text and comes before it.
    assert got[0]["n_removed"] > 0
    assert chunk_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("letters", [[chr(c) for c in range(0x4E00, 0x4F00)], [chr(c) for c in range(0x0E01, 0x0E2F)],
                                     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_shifted_passages_without_white_space(spark, letters):
    rng = random.Random(8)

    def run(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage = run(500)
    rows = [(i, run(300 + 37 * i) + passage + run(400)) for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicate(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == rows[0][1]
    for i, text in rows[1:]:
        assert passage[170:330] not in got[i] and got[i].startswith(text[:200]) and got[i].endswith(text[-300:])
        # Characters beside the passage may be the same by chance.
        assert len(text) - 503 <= len(got[i]) < len(text) - 350, i


def test_passages_of_51_words_go_whole(spark):
    rng = random.Random(21)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
                        for _ in range(n))

    rows, planted = [], []
    for i in range(300):
        passage = words(51)
        planted.append(passage)
        rows += [(i, f"{words(60)} {passage} {words(60)}"),
                 *((1000 * k + i, f"{words(rng.randint(20, 90))} {passage} {words(30)}") for k in (1, 2))]
    # A part of a passage has an earlier place in another document.
    rows.append((-1, f"{words(20)} {planted[0][80:160]} {words(20)}"))
    got = {r["doc_id"]: r for r in chunk_dedup.deduplicate(spark.createDataFrame(rows, DOCS)).collect()}
    whole = 0
    for doc, text in rows:
        i = doc % 1000
        if doc < 1000:
            assert doc == 0 or got[doc]["text"] == text
            continue
        before, after = text.split(planted[i])
        left = got[doc]["text"]
        # A space or a letter beside the passage may be the same by chance.
        assert left == text or left.startswith(before[:-5]) and left.endswith(after[5:])
        whole += len(text) - len(left) >= len(planted[i])
        assert left == text or len(text) - len(left) >= len(planted[i])
    assert whole >= 0.99 * 600


def test_rows_that_share_an_id_are_cut_by_their_own_repeats(spark):
    rng = random.Random(22)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    first, other = words(150), words(150)
    rows = [(1, first), (2, first), (2, other), (2, other), (2, None)]
    got = rows_of(chunk_dedup.deduplicate(spark.createDataFrame(rows, DOCS)), "doc_id", "text")
    assert got == sorted([(1, first), (2, ""), (2, other), (2, other), (2, None)], key=repr)


def test_pipeline_stages_keep_other_texts_of_an_id(spark):
    rng = random.Random(23)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    a, b, c, d = (words(150) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (2, near), (2, b), (2, b), (3, c), (3, d), (4, c), (None, a), (None, a), (5, None), (5, "")]
    df = spark.createDataFrame(rows, DOCS)
    # By hand: ``near`` and the later ``c`` go, repeated rows stay once.
    left = [(1, a), (2, b), (3, c), (3, d), (None, a), (None, a), (5, None), (5, "")]
    assert rows_of(corpus_pipeline.keep_one_of_near_copies(spark, df, SF), "doc_id", "text") == sorted(left, key=repr)
    # Rows without an id come first, so ``a`` goes; other texts of an id that loses text are whole.
    cut = [(2, near), (2, a), (2, b), (2, b), (3, c), (3, d), (4, c + " " + a), (None, a)]
    got = rows_of(corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame(cut, DOCS), SF), "doc_id", "text")
    assert {(2, b), (3, c), (3, d), (None, a)} <= set(got) and got.count((2, b)) == 2
    assert (2, a) not in got and not any(a[:300] in (t or "") for i, t in got if i)


def test_stages_keep_columns_named_like_their_own(spark):
    names = ("key", "spans", "hit", "__key", "__hit", "__spans", "node", "several", "__node", "__shared", "component_id", "text2")
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "")], DOCS).withColumns(
        {n: F.lit(n) for n in names})
    for stage in (corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.drop_repeated_passages):
        got = stage(spark, df, SF)
        assert got.columns == df.columns
        rows = got.collect()
        assert rows and all(r[n] == n for r in rows for n in names)
        assert corpus_pipeline.keep_one_of_near_copies(spark, df.limit(0), SF).count() == 0


# -- graph and urls

def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)]
    edges += [(700, i) for i in range(600, 690)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = brute.union_find({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(got) == {n for a, b in edges if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "x string, y string")).count() == 0


def test_url_rules_and_aliases(spark):
    rows = [(1, "http://a.Example.NET/en/x"), (2, "https://b.net/q?utm_source=z#t"), (3, "http://www.b.net/q/"),
            (4, "https://x.example.com/de/1"), (5, "https://y.org/fr"), (6, "https://y.org/fr/"),
            (7, "https://notexample.com/de/"), (8, "no scheme"), (9, None), (10, "http://net"), (11, "://net/"),
            (12, "https://clean.org/a"), (13, "https://clean.org/b"), (14, "https://clean.org/c"),
            (15, "x://p.example.com/de/?://net/")]
    html = {12: '<link rel="canonical" href="https://x.example.com/de/1">',
            13: "<meta http-equiv=refresh content='0; URL=/c'>", 14: "<link href=https://y.org/fr/ rel=canonical>"}
    df = spark.createDataFrame([(i, u, html.get(i), "v", "r") for i, u in rows] * 2,
                               "page_id long, url string, html string, verdict string, rule string")
    got = {}
    out = url_filter.judge(df, url_filter.page_links(df)).collect()
    assert len(out) == 2 * len(rows)
    for r in out:
        got[r["page_id"]] = (r["host"], r["path"], r["rule"], r["verdict"], r["method"])
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow", "rule"),
        2: ("b.net", "/q", "net/", "block", "rule"), 3: ("www.b.net", "/q/", "net/", "block", "rule"),
        4: ("x.example.com", "/de/1", "example.com/de/", "block", "rule"),
        # Its normal form has no closing slash either; the one with a slash carries its allowance.
        5: ("y.org", "/fr", None, "allow", "alias"), 6: ("y.org", "/fr/", "org/fr/", "allow", "rule"),
        7: ("notexample.com", "/de/", None, "allow", "default"), 8: ("", "", None, "allow", "default"),
        # The address without a slash is the one with it.
        9: ("", "", None, "allow", "default"), 10: ("net", "", None, "block", "alias"),
        11: ("net", "/", "net/", "block", "rule"), 12: ("clean.org", "/a", None, "block", "alias"),
        13: ("clean.org", "/b", None, "allow", "alias"), 14: ("clean.org", "/c", None, "allow", "alias"),
        15: ("p.example.com", "/de/", "example.com/de/", "block", "rule")}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(empty, url_filter.page_links(empty)).count() == 0


def test_page_links_resolve_as_a_browser_does(spark):
    page = "http://shop.org/a/b/c.html?x=1#top"
    cases = {"//other.org/p": "http://other.org/p", "page.html": "http://shop.org/a/b/page.html",
             "../x": "http://shop.org/a/x", "../../../x/./y": "http://shop.org/x/y", "..": "http://shop.org/a/",
             "?id=1&amp;p=2": "http://shop.org/a/b/c.html?id=1&p=2", "/q?a=1&amp;b=2": "http://shop.org/q?a=1&b=2",
             "/r/../s?u=/../t": "http://shop.org/s?u=/../t", "#end": "http://shop.org/a/b/c.html?x=1#end",
             "go?to=http://z.org/": "http://shop.org/a/b/go?to=http://z.org/",
             "https://z.org/1?a=1&amp;b=2": "https://z.org/1?a=1&b=2", "mailto:a@b.org": None}
    for form in ("<link rel=canonical href='%s'>", '<meta http-equiv="refresh" content="0; url=%s">'):
        df = spark.createDataFrame([(f"{page}{i}", form % t) for i, t in enumerate(cases)], "url string, html string")
        got = {}
        for r in url_filter.page_links(df).collect():
            got.setdefault(r["src"], set()).add(r["dst"])
        for i, want in enumerate(cases.values()):
            own = "https://shop.org/a/b/c.html?x=1"
            if want is None:
                assert got[f"{page}{i}"] == {own}
            else:
                assert want in got[f"{page}{i}"] and len(got[f"{page}{i}"] - {own, want}) <= 1, want
    rows = [("http://h.org", "<link rel=canonical href=x>", "http://h.org/x"),
            ("http://h.org/p/q", "<base href='/z/'><link rel=canonical href=x>", "http://h.org/z/x"),
            ("http://h.org/p/r", "<base href='//i.org/z/'><link rel=canonical href=x>", "http://i.org/z/x")]
    found = {tuple(r) for r in url_filter.page_links(spark.createDataFrame(
        [r[:2] for r in rows], "url string, html string")).collect()}
    assert {(r[0], r[2]) for r in rows} <= found


def test_verdicts_reach_aliases_over_relative_targets(spark):
    link = "<link rel=canonical href='%s'>"
    rows = [(1, "https://clean.org/a", link % "//x.example.com/de/1"), (2, "https://x.org/fr/p?a=1&b=2", ""),
            (3, "https://x.org/other/q", link % "../fr/p?a=1&amp;b=2"), (4, "https://x.org/fr", link % "fr/z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["method"]) for r in url_filter.judge(df, url_filter.page_links(df)).collect()}
    assert got == {1: ("block", "alias"), 2: ("allow", "rule"), 3: ("allow", "alias"), 4: ("allow", "alias")}
