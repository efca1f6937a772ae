"""Text and vector operators against brute force, libraries and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelake.llm import bit_sliced, hilbert, html_extract, packing, toxicity, trie_bpe
from changelake.llm.dom import parse

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\x1c a\x1fb", "İstanbul ΑΣ ΟΔΟΣ", "don't I'LL we've'd", "a<|endoftext|>b <|startoftext|>",
       "é ́x", "日本語テキスト 123 ½ ⅷ", "​zero﻿", "x" * 20000, "a\xa0b c\x85d", "🙂🙂👩‍👩‍👧", "ß ẞ ŉ ﬁ",
       "\x00\x01", "<|endof text|>", "foo'sbar 'tis", "don't I'LL we've'd"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def odd_texts():
    rng = random.Random(1)
    letters = "abcdefghijklmnop'!.,0123ÀéñΣİß́日 \t\n　<|>"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]


# -- tokens

def test_trie_encodes_as_the_library_does(tokenizer):
    encoder = trie_bpe.TrieEncoder(VOCABULARY)
    for text in odd_texts():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode(text or "") == ids, text
        assert encoder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_trie_query_on_odd_rows_and_the_table(spark, tokenizer):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "twice"), (3, "twice")]
    odd = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = trie_bpe.encode_decode(docs, VOCABULARY)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert trie_bpe.encode_decode(odd.limit(0), VOCABULARY).count() == 0


# -- packing

def test_shortest_pack_first():
    assert packing.pack_histogram({}, 10) == []
    # 7 and 6 open packs; 4 goes to the shortest (6), 3 to the next (7).
    assert sorted(packing.pack_histogram({7: 1, 6: 1, 4: 1, 3: 1}, 10)) == [((6, 4), 1), ((7, 3), 1)]
    histogram = {int(n): int(c) for n, c in zip(*np.unique(np.random.default_rng(1).integers(1, 101, 5000),
                                                           return_counts=True), strict=True)}
    packs = packing.pack_histogram(histogram, 100)
    total = Counter()
    for pattern, count in packs:
        assert sum(pattern) <= 100
        for length in pattern:
            total[length] += count
    assert total == histogram
    assert sum(n * c for n, c in histogram.items()) / sum(c for _, c in packs) > 95


@pytest.mark.parametrize("size", [16, 4096])
def test_packing_places_every_id_once(spark, tokenizer, size):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:300])] + [(None, "no id"), (3, "twice"), (3, "twice")]
    rows += [(1000 + i, "same words here") for i in range(200)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, length int").repartition(5)
    pieces = [r.asDict() for r in packing.pack(docs, VOCABULARY, size).collect()]
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), size):
            part = np.array(ids[start:start + size], "<u4")
            want[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert set(by_sequence) == set(range(len(by_sequence)))
    assert packing.pack(docs.limit(0), VOCABULARY, size).count() == 0


# -- toxicity

def test_toxicity_learns_phrases_and_calibrates():
    rng, words = random.Random(4), [f"w{i}" for i in range(300)]

    def text(toxic):
        out = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(2):
                out.insert(rng.randrange(len(out)), rng.choice(("Badword", "vileia", "vileon", "vileck")))
        return " ".join(out)

    y = [i % 2 for i in range(600)]
    model = toxicity.fit([text(t) for t in y], y, toxicity.Shape())
    data, offsets = toxicity._joined([text(t) for t in y] + ["", "  "])
    scores = model.scores(data, offsets)
    assert ((scores[:600] >= 0.5) == np.array(y)).mean() > 0.98
    assert scores[600] == scores[601] < 0.5
    # An unseen form of a known stem, in another case.
    data, offsets = toxicity._joined(["w1 w2 VILEUNG w4 vilemo", "w1 w2 w3"])
    assert np.diff(model.scores(data, offsets))[0] < 0
    assert toxicity.threshold(np.array([0.1, 0.2, 0.9]), np.array([0, 0, 1])) == pytest.approx(0.6, abs=0.1)


def test_toxicity_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels.unionByName(labels.limit(3)).union(
        spark.createDataFrame([(None, 1, 1), (1, 1, None), (-5, 1, 1)], labels.schema)))
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    rows = scored.select("predicted", "toxic", "score").collect()
    assert len(rows) > 40 and sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    assert toxicity.held_out(F.lit(None)) is not None
    kept = toxicity.score(spark.createDataFrame(
        [(1, None, None, 9.0), (None, "", "xx", 9.0), (1, None, None, 9.0), (4, "w " * 50_000, "en", 9.0)],
        "doc_id long, text string, lang string, score double"), model)
    assert kept.columns == ["doc_id", "text", "lang", "score", "predicted", "rejected"]
    assert [r["predicted"] for r in kept.collect()] == [0, 0, 0, 0]
    empty = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


# -- html

def test_parse_repairs_markup():
    page = parse("<p>a<p>b<b>c<br>d</b><li>x<li>y <a href='>'>z</a></ul></p>&amp;&lt;tail<!-- no --><script>a<p></script>")
    assert list(page.text.values()) == ["a", "bc d", "x", "y z", "&<tail"]
    assert [page.linked[n] for n in page.text] == [0, 0, 0, 1, 0]
    for junk in ("", "<", "<p", "</", "<!-- open", "<script>never", "a < b > c", "<p <p>", "<a b='>x", "\x00"):
        parse(junk)
    assert " ".join(parse("a < b").text.values()) == "a < b"


def test_messages_give_the_marginals_of_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    page = parse("<div><p>one</p><ul><li>two<li>three</ul></div><aside>four</aside>")
    forest = html_extract.Forest.of([page])
    weights, ties = rng.normal(size=html_extract.BUCKETS), rng.normal(size=(2, 2))
    odds, expected = html_extract.marginals(forest, weights, ties)
    own = np.bincount(forest.rows, weights[forest.features], len(page.name))
    total, ones, pairs = 0.0, np.zeros(len(own)), np.zeros((2, 2))
    for state in itertools.product((0, 1), repeat=len(own)):
        s = np.array(state)
        weight = np.exp(own @ s + sum(ties[s[p], s[c]] for c, p in enumerate(forest.parent) if p >= 0))
        total += weight
        ones += weight * s
        for c, p in enumerate(forest.parent):
            if p >= 0:
                pairs[s[p], s[c]] += weight
    assert np.allclose(1 / (1 + np.exp(-odds)), ones / total)
    assert np.allclose(expected, pairs / total)


def test_extraction_of_the_table_and_of_other_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.train(pages)
    import re
    from html import unescape

    got = {r["page_id"]: r for r in html_extract.extract(pages, model).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", c)).split()) for c in re.split(r"<p>|</p>|<h1>|</h1>", article)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    # Labelled pages of templates that were not trained on.
    texts = ["Some words of a sentence that goes on for a while, and then some more of them. " * 3]
    right = total = 0
    for seed in range(60):
        page, labels = html_extract.template_page(texts, random.Random(10_000 + seed))
        kept = model.keep([page])
        right += sum(bool(labels[n]) == kept[n] for n in page.text)
        total += len(page.text)
    assert right / total > 0.97
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "plain words", "x"),
                                 (4, "u", "<nav>" * 5000, "x"), (4, "u", "<nav>" * 5000, "x")],
                                "page_id long, url string, html string, text string")
    assert [r["page_id"] for r in html_extract.extract(odd, model).collect()] == [1, 2, None, 4, 4]
    assert [r["text"] for r in html_extract.extract(odd.where("page_id <> 0"), model).collect()] == [""] * 4
    assert html_extract.extract(odd.limit(0), html_extract.train(odd.limit(0), templates=5)).count() == 0


# -- vectors

def made_vectors(seed, count, dims):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5], x[7], x[count - 1] = x[3], x[3], 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(None, rows[0][1]), (count + 1, None), (count + 2, []), (count + 3, [float("nan")] * dims),
           (count + 4, [float("inf")] + [0.0] * (dims - 1)), (count + 5, [None] + [0.0] * (dims - 1)),
           (count + 6, [1.0] * (dims + 1)), rows[2]]
    return rows, rows + odd


VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("dropped", [0, 2, 4])
def test_bit_sliced_top_k_is_exact(spark, dropped):
    rows, everything = made_vectors(1, 300, 12)
    got = bit_sliced.top_k(spark.createDataFrame(everything, VECTORS), every=7, k=5, dropped=dropped).collect()
    q = np.floor(256 * np.array([r[1] for r in rows])).astype(int)
    want = []
    for i in range(0, 300, 7):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -scores)) if j != i][:5]
        want += [(i, rank + 1, j, int(scores[j])) for rank, j in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_bit_sliced_packs_are_shuffled_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK", 4)
    monkeypatch.setattr(bit_sliced, "QUERIES", 10)
    rows, everything = made_vectors(3, 200, 4)
    found = bit_sliced.top_k(spark.createDataFrame(everything, VECTORS), every=5, k=3)
    assert "Join" not in found._jdf.queryExecution().toString()
    q = np.floor(256 * np.array([r[1] for r in rows])).astype(int)
    want = [(i, rank + 1, int(j), int((q @ q[i])[j])) for i in range(0, 200, 5) for rank, j in enumerate(
        [j for j in np.lexsort((np.arange(200), -(q @ q[i]))) if j != i][:3])]
    assert sorted(map(tuple, found.collect())) == want


def test_bit_sliced_over_several_blocks_few_rows_and_none(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK", 64)
    monkeypatch.setattr(bit_sliced, "QUERIES", 10)
    rows, everything = made_vectors(2, 500, 6)
    got = bit_sliced.top_k(spark.createDataFrame(everything, VECTORS), every=5, k=3).collect()
    q = np.floor(256 * np.array([r[1] for r in rows])).astype(int)
    for r in got:
        scores = q @ q[r["query_id"]]
        order = [j for j in np.lexsort((np.arange(500), -scores)) if j != r["query_id"]]
        assert (r["vec_id"], r["score"]) == (order[r["rank"] - 1], scores[order[r["rank"] - 1]])
    assert len(got) == 300
    few = spark.createDataFrame([(0, [1.0, -1.0], 5), (1, [0.5, 0.5], 5)], "vec_id long, embedding array<float>, rank int")
    assert [tuple(r) for r in bit_sliced.top_k(few, k=5).collect()] == [(0, 1, 1, 0)]
    for make in (bit_sliced.top_k, hilbert.nearest):
        assert make(spark.createDataFrame([], VECTORS)).count() == 0


def test_hilbert_keys_walk_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_are_exact_distances_with_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = {}
    for r in hilbert.nearest(vectors, every=10, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for query, found in got.items():
        i = np.searchsorted(ids, query)
        exact = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, exact)) if j != i][:10]
        hits += len({ids[j] for j in order} & {v for _, v, _ in found})
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == pytest.approx(exact[np.searchsorted(ids, v)], abs=1e-12)
    assert len(got) == sum(ids % 10 == 0) and hits >= 0.9 * 10 * len(got)


def test_neighbours_with_odd_rows_ties_and_hot_keys(spark, monkeypatch):
    rows, everything = made_vectors(3, 200, 4)
    got = hilbert.nearest(spark.createDataFrame(everything, VECTORS), every=3, k=4, share=1.0).collect()
    x = np.array([r[1] for r in rows])
    for r in got:
        exact = np.sqrt(((x[:199] - x[r["query_id"]]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(199), exact)) if j != r["query_id"]]
        assert r["vec_id"] == order[r["rank"] - 1]
    assert len(got) == 4 * 67  # vec_id 0, 3, ... 198; the zero vector is 199
    # One vector that most rows share: its range is split, and all its copies are found.
    monkeypatch.setattr(hilbert, "RANGE_ROWS", 20)
    same = [(i, [1.0, 0.5, 0.25, 0.0]) for i in range(400)] + [(1000 + i, [float(v) for v in x[i]]) for i in range(100)]
    got = hilbert.nearest(spark.createDataFrame(same, VECTORS), every=100, k=5).where("query_id = 100").collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(i + 1, i, 0.0) for i in range(5)]


@pytest.mark.parametrize("size", [2, 5, 11])
def test_neighbours_of_small_tables_are_whole(spark, size):
    x = np.random.default_rng(size).normal(size=(size, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(size)]
    got = {}
    for r in hilbert.nearest(spark.createDataFrame(rows, VECTORS), every=1, k=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for i in range(size):
        order = [int(j) for j in np.argsort(((x - x[i]) ** 2).sum(1)) if j != i][:10]
        assert got[i] == dict(enumerate(order, 1))


def test_few_rows_beside_a_hot_key_find_enough(spark):
    x = np.random.default_rng(1).normal(size=(4, 16)) * 0.1 + 3
    rows = [(i, [1.0] * 16) for i in range(300)] + [(1000 + i, [float(v) for v in x[i]]) for i in range(4)]
    got = hilbert.nearest(spark.createDataFrame(rows, VECTORS), every=1, k=10).where("query_id >= 1000").collect()
    assert len(got) == 40


@pytest.mark.parametrize("remembered", [600_000, 40])
def test_packing_word_ids_match_the_library(remembered):
    words = packing.WordIds(VOCABULARY, remembered)
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x250) if not chr(c).isspace()] + list("'stremvdl'<|>09") * 15
    batches = [
        ["", None, " ", "a\x1cb c", "\x1f", "x\x85y\xa0z w", "\u0130stanbul \u03a3\u0391\u03a3", "it's 'S ''s\tend\n",
         "<|endoftext|> a<|startoftext|>b <|", "e\u0301 \u00e9", "x\u200by"],
        [None], [], [chr(c) for c in range(0x600)],
        ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)],
        ["".join(rng.choices("'stremvdlSTE<|> .1\xbd\xaa", k=8)) for _ in range(3000)],
    ]
    for batch in batches:
        got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(pa.array(batch, pa.string()))]
        assert got == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in batch]


def test_toxicity_learns_from_every_labelled_text(spark):
    """Long texts and those beyond the first sample teach as well: one word is in long ones only."""
    rng, words = random.Random(7), [f"w{i}" for i in range(200)]

    def text(i):
        toxic, long = i % 2, i % 4 > 1
        out = [rng.choice(words) for _ in range(60 if long else 12)]
        if toxic:
            for _ in range(2):
                out.insert(rng.randrange(len(out)), "zorgle" if long else "badword")
        return i, " ".join(out), "en" if long else "de", toxic

    rows = [text(i) for i in range(2400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.Shape(sample=300, longest_sampled=120, **(
        {"part": 500} if "part" in toxicity.Shape.__dataclass_fields__ else {})))
    told = {r[0]: r for r in rows}
    scored = [r for r in toxicity.score(docs, model, ["doc_id"]).where(toxicity.held_out(F.col("doc_id"))).collect()]
    for lang in ("en", "de"):
        own = [r for r in scored if told[r["doc_id"]][2] == lang]
        assert sum(r["predicted"] == told[r["doc_id"]][3] for r in own) >= 0.95 * len(own), lang
    assert set(model.thresholds) == {"en", "de"}
