"""Source mix, source audit and conversation trie against plain forms on small and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from changelake.llm import prefix_trie, source_audit, source_mix

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "  two words ", "a\x0bb\x0cc\rd", "a b \u0085 c", "日本語 テキスト", "x " * 3000, "x\x1cy\x00z"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- mix

def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, weights, repeats, budget):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest = budget - sum(repeats * sizes[s] for s in stopped)
        total = sum(weight[s] for s in names if s not in stopped)
        more = {s for s in names if s not in stopped and weight[s] * rest >= repeats * sizes[s] * total}
        if not more:
            return names, {s: Fraction(repeats * sizes[s]) if s in stopped else Fraction(weight[s] * rest, total)
                           for s in names}
        stopped |= more


def plain_mix(docs, weights=(1, 2, 3), repeats=3, budget=None):
    """[(doc_id, size, source_size, target, taken)] by serving word by word of the queue's order."""
    sizes, queues = Counter(), defaultdict(list)
    for doc, text, source in docs:
        mark = hashlib.md5(f"mix:{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()
        sizes[source] += len(words(text))
        queues[source].append((mark, doc if doc is not None else -1, len(words(text)), doc))
    budget = sum(sizes.values()) if budget is None else budget
    names, target = plain_targets(sizes, weights, repeats, budget)
    served = {s: math.floor(target[s]) for s in names}
    spare = budget - sum(served.values())
    for s in sorted((s for s in names if target[s] != served[s]),
                    key=lambda s: ((served[s] + 1) / float(target[s]), names.index(s)))[:max(spare, 0)]:
        served[s] += 1
    out = []
    for s in names:
        place = 0
        for _, _, size, doc in sorted(queues[s]):
            taken = sum(max(0, min(size, served[s] - r * sizes[s] - place)) for r in range(repeats))
            out.append((doc, size, sizes[s], float(target[s]), taken))
            place += size
    return sorted(out, key=repr)


def mixed(df, **options):
    return rows_of(source_mix.mix(df, **options).documents.select("doc_id", "size", "source_size", "target", "taken"))


def odd_documents():
    rng = random.Random(5)
    docs = [(i, t, s) for i, (t, s) in enumerate(zip(ODD, ["a", None, "b", "", "é", "a", "Z", "z", "b", "none"], strict=True))]
    docs += [(100 + i, "w " * rng.randint(0, 40), rng.choice(["hot", "hot", "hot", "a", "é", None])) for i in range(300)]
    return docs + [(7, "same text", "hot")] * 5 + [(None, "no id", "b"), (None, "no id", "b"), (None, None, None)]


SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("slice_rows", [4, 1 << 18])
def test_mix_of_odd_rows(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(source_mix, "SLICE_ROWS", slice_rows)
    docs = odd_documents()
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"rank": F.lit("x"), "part": F.lit(1), "size": F.lit(None), "mark": F.lit(0)})
    assert mixed(df) == plain_mix(docs) == mixed(df.repartition(3))
    assert mixed(df, weights=(5, 1), repeats=1, budget=900) == plain_mix(docs, (5, 1), 1, 900)


def test_mix_of_no_words_and_no_rows(spark):
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None), (None, None, None)], SCHEMA)
    assert mixed(empty) == sorted([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)], key=repr)
    assert mixed(empty.limit(0)) == []
    assert mixed(spark.createDataFrame([(1, "a b c", None)], SCHEMA)) == [(1, 3, 3, 3.0, 3)]


def test_mix_reaches_targets_and_gives_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = source_mix.mix(docs)
    by_source = mix.documents.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert by_source and all(abs(r["t"] - r["n"]) <= 1 for r in by_source)
    assert mix.documents.where("taken > 3 * size").count() == 0
    total = mix.documents.agg(F.sum("size")).first()[0]
    texts = source_mix.texts(docs, mix.queue).collect()
    assert sum(r["words"] for r in texts) == total and all(len(words(r["text"])) == r["words"] for r in texts)
    order = [(r["finish"], r["rank"]) for r in texts]
    assert order == sorted(order)
    per = Counter()
    for r in texts:
        per[r["doc_id"]] += r["words"]
    assert per == Counter({r["doc_id"]: r["taken"] for r in mix.documents.collect()})


# -- audit

def plain_audit(docs, min_docs, top):
    counts, found, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[lang, source].update(terms)
        found[lang].update(set(terms))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in found[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(own, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 512])
def test_audit_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    rng = random.Random(3)
    made = ["The", "the", "É", "é", "naïve", "a b", "日本", "😀x", "it's", "A1b", "zz", "\x00y", "ſ"]
    docs = [(rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None]),
             " ".join(rng.choices(made, k=rng.randint(0, 12)))) for _ in range(150)]
    docs += [("xx", "only", "rare words"), ("yy", "p", "rare"), ("yy", "q", None), ("en", "silent", "12 34"), ("en", "s1", "the " * 30_000)]
    docs += [("en", "copies", "the same text")] * 40
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumns(
        {c: F.lit(1) for c in ("term", "terms", "part", "p", "value", "rank", "number")})
    for min_docs, top in ((30, 50), (3, 2)):
        assert rows_of(source_audit.audit(df, min_docs, top)) == plain_audit(docs, min_docs, top)


def test_audit_of_no_rows(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert source_audit.audit(none).collect() == []
    one = spark.createDataFrame([(None, None, None)], none.schema)
    assert source_audit.audit(one).collect() == []


@pytest.mark.parametrize("held", [50, 1_000_000])
def test_audit_counts_before_it_vectorizes(spark, monkeypatch, held):
    """CountVectorizer gets few strings of terms that many documents have, with the same result."""
    monkeypatch.setattr(source_audit, "TERMS_HELD", held, raising=False)
    rng = random.Random(5)
    made = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = [(rng.choice("xy"), rng.choice("abc"), " ".join(rng.choices(made, k=80))) for _ in range(600)]
    docs += [("x", "a", "just " * n) for n in range(1, 31)] + [("x", "b", "under")] * 29 + [("y", "b", "under")] * 30
    seen, keep = [], source_audit._vectors

    def vectors(tokens, min_docs):
        seen.append(tokens.agg(F.sum(F.size("terms"))).first())
        return keep(tokens, min_docs)

    monkeypatch.setattr(source_audit, "_vectors", vectors)
    df = spark.createDataFrame(docs, "lang string, source string, text string").coalesce(1)
    assert rows_of(source_audit.audit(df)) == plain_audit(docs, 30, 50)
    strings = sum(len(set(text.split())) for _, _, text in docs)
    assert len(seen) == 2 and (held == 50 or sum(s[0] for s in seen) < strings / 4)


def test_pairs_of_one_source_or_without_common_terms(spark):
    """Blocks in which no two sources have a term in common have no corrections, and fail nothing."""
    rows = [("x", "a", 1, 5, 1), ("x", "a", 2, 5, 1), ("y", "a", 1, 5, 1), ("y", "b", 2, 5, 1)]
    df = spark.createDataFrame(rows, "lang string, source string, number int, p bigint, zero bigint")
    assert df.groupBy("lang").applyInPandas(
        source_audit.pair_corrections, "lang STRING, a STRING, b STRING, value BIGINT").collect() == []


# -- trie

def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_conversations():
    rng = random.Random(11)
    cell = [("user", "hi"), ("assistant", "hello"), ("user", "é"), (None, "hi"), ("user", None), ("", ""), ("us", "erhi")]
    rows = []
    for c in list(range(60)) + [-1, -5, -7, 1003, 2**53 + 5, 2**53 + 6]:
        for turn in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), *rng.choice(cell[:2] if c < 30 else cell)))
    rows += [(200 + i, t, "user", "copy") for i in range(25) for t in range(2)]         # many copies
    rows += [(300, t, "user", f"step {t}") for t in range(70)] + [(301, t, "user", f"step {t}") for t in range(40)]
    rows += [(400, 0, "user", "x")] + [(400, 1, "user", "twice")] * 3
    rows += [(500 + i, t, "user", "caterpillar" if t < i else f"leg {i}") for i in range(30) for t in range(i + 1)]
    return rows + [(None, 0, "user", "no id"), (600, None, None, None)]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size", [2, 4096])
def test_trie_of_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "SLICE", size)
    monkeypatch.setattr(prefix_trie, "IDS", 4 if size == 2 else 1 << 16)
    rows = made_conversations()
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("pos", "a", "b", "node", "depth", "h", "n", "bytes")})
    assert rows_of(prefix_trie.trie(df)) == plain_trie(rows)


def test_trie_of_the_table_long_turns_and_no_rows(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows_of(prefix_trie.trie(table)) == plain_trie([tuple(r) for r in table.collect()])
    assert prefix_trie.trie(table.limit(0)).collect() == []
    long = [(1, 0, "user", "é" * 2_000_000), (2, 0, "user", "é" * 2_000_000), (2, 1, "user", "")]
    assert rows_of(prefix_trie.trie(spark.createDataFrame(long, TURNS))) == plain_trie(long)


def test_chain_shrinks_in_few_rounds(spark, monkeypatch):
    """A chain of 3,000 nodes and slices of 16: rounds grow with the logarithm."""
    monkeypatch.setattr(prefix_trie, "SLICE", 16)
    stored = []
    keep = prefix_trie.store
    monkeypatch.setattr(prefix_trie, "store", lambda df, name: stored.append(name) or keep(df, name))
    rows = [(0, t, "user", str(t)) for t in range(3000)]
    got = {r["depth"]: r for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert stored.count("contracted") <= 6
    assert len(got) == 3001 and all(r["n_leaves"] == 1 and r["saved_tokens"] == 0 for r in got.values())
