"""Source divergence, the additive quality model and the conversation trie against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest

from lodeweave.llm import divergence, gam, queries, trie

DOCS = "doc_id long, text string, lang string, source string, item string, term string, value long"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is None, x) for x in t))


# 11 divergence


def brute_divergence(rows, least, top):
    """rows of (text, lang, source)."""
    groups, docs = defaultdict(Counter), defaultdict(lambda: defaultdict(int))
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups[lang, source].update(terms)
        for t in set(terms):
            docs[lang][t] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, own = len(kept), {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            out += [(lang, s, "pair", o, -f, i + 1) for i, (f, _, o) in enumerate(sorted(pairs))]
            over = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -f, i + 1) for i, (f, _, t) in enumerate(sorted(over)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 2, 1])
def test_divergence_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(divergence, "GROUP", 300)
    monkeypatch.setattr(divergence, "HELD", 20)
    rnd = random.Random(2)
    words = ["the", "The", "of", "ÉTÉ", "été", "x9y", "日本", "don't", "a\0b", "Z", "[q]", "rare%d"]
    rows = [(" ".join(rnd.choice(words).replace("%d", chr(97 + rnd.randint(0, 25))) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "c", "é", "B", None])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "de", "only"), ("1 2 3", "de", "digits"), ("the the", "xx", "s"), ("of", "xx", "t")] + [rows[0]] * 40
    df = spark.createDataFrame([(i, t, x, s, "i", "t", 1) for i, (t, x, s) in enumerate(rows)], DOCS)
    want = brute_divergence(rows, 12, 4)
    got = rows_of(divergence.divergence(df, least=12, top=4, block=block), "lang", "source", "part", "item", "value", "rank")
    assert got == want and {r[2] for r in want} == {"pair", "term"} and [r for r in want if r[4] == 0]


def test_divergence_edges(spark):
    none = divergence.divergence(spark.createDataFrame([], DOCS))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and none.count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000 + "end", "en", "a", None, None, None), (2, "word", "en", "b", None, None, None)], DOCS)
    assert rows_of(divergence.divergence(long, least=2), "source", "part", "item", "value", "rank") == [("a", "pair", "b", 0, 1), ("b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("name, table", [("op11_divergence", "documents"), ("op13_trie", "conversations")])
def test_queries_equal_their_sql(spark, sf, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=lambda t: tuple((x is None, x) for x in t))
    assert rows_of(queries.queries()[name](spark, sf), *columns) == want


# 12 additive model


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in queries.op12_gam(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in scored.items())
    held = [(scored[d].predicted, q) for d, q in labels.items() if scored[d].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.97 * len(held)


def test_model_finds_a_table_and_an_interaction():
    rnd = np.random.RandomState(1)
    x = rnd.rand(6000, 4).astype(np.float32)
    margin = 3 * (x[:, 0] > 0.6) - 2 + 3 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 1.5
    y = (rnd.rand(6000) < 1 / (1 + np.exp(-margin))).astype(float)
    model = gam.train(x[:4000], y[:4000], np.ones(4000))
    assert {1, 2} in [{a, b} for a, b, _ in model.pairs]
    loss = lambda p: -np.mean(y[4000:] * np.log(p) + (1 - y[4000:]) * np.log(1 - p))
    plain = gam.train(x[:4000], y[:4000], np.ones(4000), pairs=0)
    best = loss(1 / (1 + np.exp(-margin[4000:])))
    assert loss(model.scores(x[4000:])) < best + 0.06 < loss(plain.scores(x[4000:])) - 0.05
    # scores are base plus table entries, number by number
    bins = [[int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, row, strict=True)] for row in x[:50]]
    sums = [model.base + sum(model.tables[f][b] for f, b in enumerate(r)) + sum(t[r[a] // 4][r[b] // 4] for a, b, t in model.pairs) for r in bins]
    assert np.allclose(model.scores(x[:50]), 1 / (1 + np.exp(-np.array(sums))))


@pytest.mark.parametrize("size", [5, 40])
def test_trees_against_all_cuts(size):
    rnd = np.random.RandomState(size)
    g, h = rnd.randn(size), rnd.rand(size) + 0.1
    gain, at = gam._best_cut(g, h)
    def worth(a, b):
        return a.sum() ** 2 / (b.sum() + gam.RIDGE)

    all_cuts = [worth(g[:i], h[:i]) + worth(g[i:], h[i:]) - worth(g, h) for i in range(1, size)]
    assert np.isclose(gain, max(all_cuts)) and all_cuts[at - 1] == pytest.approx(max(all_cuts))
    assert len(set(gam.line_tree(g, h))) <= 3
    plane = gam.plane_tree(rnd.randn(8, 8), np.ones((8, 8)))
    assert len(np.unique(plane)) <= 4


def test_features_do_not_depend_on_parts(monkeypatch):
    text = ("Some words, and more. " * 40 + "\n- item ***\n") * 30
    whole = gam.features(text)
    assert len(whole) == gam.FEATURES and np.isfinite(whole).all() and (gam.features("") == 0).all()
    monkeypatch.setattr(gam, "PART", 5000)
    parts = gam.features(text)
    same = [i for i in range(gam.FEATURES) if i not in (13, 14, 19, 20, 21, 26)]  # those that look at a part as a whole: entropy, packing, distinct words, pairs and lines
    assert np.allclose(whole[same], parts[same], rtol=0.05)
    assert np.isfinite(gam.features("x" * 3_000_000)).all()


def test_model_edges(spark):
    rows = [(1, "good words in a sentence here", "a", 1.0, "y"), (1, "good words in a sentence here", "a", 1.0, "y"), (None, None, None, None, None), (2, "", "b", None, None), (3, "### ### $$$", "b", 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score double, x string")
    found = gam.described(docs)
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in gam.score(found, gam.learn(found, no_labels)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (9, 0), (None, 0), (2, None)], "doc_id long, label int")
    assert len({r.score for r in gam.score(found, gam.learn(found, one)).collect()}) == 1
    both = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (3, 7)], "doc_id long, label int")
    scored = gam.score(found, gam.learn(found, both))
    assert scored.count() == 5 and scored.select("row.row", "row.score", "row.x").count() == 5
    nothing = gam.described(docs.limit(0))
    assert gam.score(nothing, gam.learn(nothing, both)).count() == 0


# 13 trie


def brute_trie(rows):
    """rows of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, label, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        built[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(children[x] == 0 for x in below), saved, sha))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string, depth int, labels string, n string"


def built(df, **more):
    return rows_of(trie.trie(trie.branched(trie.sequences(df)), **more), *COLUMNS)


@pytest.mark.parametrize("limit, chunk, few", [(4096, 1 << 18, 50_000), (30, 40, 50_000), (5, 10, 0), (1, 1, 0)])
def test_trie_against_brute_force(spark, monkeypatch, limit, chunk, few):
    monkeypatch.setattr(trie, "FEW", few)
    monkeypatch.setattr(trie, "PIECE", 10)
    rnd = random.Random(limit)
    texts, rows = ["hi", "hi there", "日本 é", "", None, "bye"], []
    for c in [*range(60), *range(100, 130), 305, 999, -7, -100, 10**12]:
        rows += [(c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for t in range(rnd.choice([1, 2, 3, 6, 9]))]
    rows += [(c, t, "user", "the same") for c in range(400, 440) for t in range(7)]  # a group of copies
    rows += [(700, t, "user", f"turn {t % 5}") for t in range(150)] + rows[:9] + [(None, 1, "user", "no id")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "l", "n") for r in rows], TURNS)
    assert built(df, limit=limit, chunk=chunk) == brute_trie(rows)


def test_louds_bits():
    # a root with two children, the first with one child, and a second root
    f = trie.Louds(np.array([2, 0, 1, 0, 0]), 2)
    bits = np.unpackbits(f.bits, count=f.length).tolist()
    assert bits == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    assert f.parents().tolist() == [-1, -1, 0, 0, 2] and f.degrees().tolist() == [2, 0, 1, 0, 0]


def test_trie_edges(spark):
    none = trie.trie(trie.branched(trie.sequences(spark.createDataFrame([], TURNS))))
    assert none.count() == 0 and none.columns == list(COLUMNS)
    c = next(c for c in range(1, 100) if crc32(str(c).encode()) % 6 >= 1)
    lone = spark.createDataFrame([(c, 0, "user", "replaced by nothing", 1, "", "")], TURNS)
    assert built(lone) == brute_trie([(c, 0, "user", "replaced by nothing")]) and built(lone)[0][:5] == (c, 0, None, 1, 0)
    long = [(0, t, "user", "x" * (1000 if t == 5 else 1)) for t in range(3000)] + [(200, 0, "user", "y" * 3_000_000)]
    assert len(built(spark.createDataFrame([(*r, 1, "", "") for r in long], TURNS), limit=100)) == 3002
