"""Rows that told the queries of a round's findings from their SQL, and bounds of what a task holds."""

import hashlib
import math
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_queries import QUERIES, SQL, canonical

from lodeweave import shared
from lodeweave.operators import catalogue, containment, enrichment, rules, taxonomy, vectors


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over made tables, (columns, rows) each."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"copy ({sql}) to '{folder}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, rows = QUERIES[name](spark, str(folder)), con.sql(SQL[name])
    return canonical(df.collect(), df.columns), canonical(rows.fetchall(), rows.columns)


def test_dates_of_spans_in_milliseconds(spark, tmp_path):
    times = [f"2024-01-01 00:00:{s}" for s in ("59.999499", "59.999500", "59.999600", "00.000001")]
    made = " union all ".join(f"select {i}::bigint as event_id, timestamp '{t}' as ts" for i, t in enumerate(times))
    got, want = both(spark, tmp_path, "formula_dates", events=made)
    assert got == want


def test_titles_with_references_cut_off(spark, tmp_path):
    titles = ["a &amp; b", "b &lt;c", "c &amp", "d &quot", "e &#x27", "f &#x27;s", "g & h"]
    made = " union all ".join(f"select {i}::bigint as page_id, 'https://x.example/' as url, '<html><head><title>{t}</title></head><body><h1>x</h1></body></html>' as html" for i, t in enumerate(titles))
    got, want = both(spark, tmp_path, "html_title", pages=made)
    assert got == want


def test_progress_adds_in_the_order_of_keys(spark, tmp_path):
    """0.1 + 0.2 + ... is below a whole number in one order and above in another; rows dealt to many partitions."""
    made = "select i::bigint as o_orderkey, (i % 97)::bigint as o_custkey, case when i % 3 = 0 then 'F' else 'O' end as o_orderstatus, ((i * 7919) % 100000) / 100.0::double as o_totalprice from range(20000) t(i)"
    got, want = both(spark, tmp_path, "formula_progress", orders=made)
    assert got == want
    df = spark.read.parquet(f"{tmp_path}/orders.parquet").repartition(13)
    df.write.parquet(f"{tmp_path}/dealt/orders.parquet")
    again = QUERIES["formula_progress"](spark, f"{tmp_path}/dealt")
    assert canonical(again.collect(), again.columns) == want


def test_folders_of_equal_addresses_by_page(spark, tmp_path):
    rows = [(i, f"https://x.example/{i % 3}", "") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7, "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.folder for r in QUERIES["output_folders"](spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: "x.example/page" + (f"_{n}" if n > 1 else "") for n, r in enumerate(order, 1)}


def test_dictionary_in_a_text_of_many_words(spark):
    """Stretches are told apart in steps in proportion to the text, and only those of as many words as an option has are made."""
    text = " ".join(f"w{i}" for i in range(60_000)) + " ¡one two! three"
    docs = spark.createDataFrame([(1, text), (2, "One  two"), (3, "xw5 w6 w5")], "id long, t string")
    options = spark.createDataFrame([(0, "w5 w6"), (1, "¡One two!"), (2, "three"), (3, "one two"), (4, "W5 w6")], "ord int, option string")
    start = time.monotonic()
    found = {r.id: r.found for r in taxonomy.dictionary_scan(docs, "id", "t", options).collect()}
    assert found == {1: ["w5 w6", "¡One two!", "three", "one two", "W5 w6"], 2: [], 3: []}
    assert time.monotonic() - start < 30


def test_containment_prunes_before_it_shuffles(spark):
    """Ten thousand sets that share one element each with a hundred others, few of them contained: few pairs leave the index."""
    links = spark.sql("select id, explode(array(id % 100, 1000 + id, 20000 + id, 40000 + id)) e from range(10000) union all select 10000 + id, explode(array(id % 100, 1000 + id)) from range(50) union all select 20000, 7 union all select 20001, null")
    pairs = containment.contained(links, links, "id", "e")
    want = {(10000 + i, i) for i in range(50)} | {(20000, i) for i in range(7, 10000, 100)} | {(20000, 10007)}
    assert {tuple(r) for r in pairs.collect()} == want
    folder = next(p for p in reversed(shared._written) if p.endswith("open_pairs"))
    assert spark.read.parquet(folder).count() < 2 * len(want)


def test_products_of_a_cell_are_held_in_part():
    rnd = np.random.RandomState(1)
    x, y = rnd.randn(4096, 16), np.tile(rnd.randn(1024, 16), (4, 1))
    ids = np.arange(4096)
    tracemalloc.start()
    rows, cols, found = vectors._best_products(x, y, ids, ids, 3, -1.0, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = np.clip(x @ y.T, -1, 1)
    sims[ids, ids] = -2
    want = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    assert (cols.reshape(-1, 3) == want).all() and np.allclose(found.reshape(-1, 3), np.take_along_axis(sims, want, axis=1)) and (rows == np.repeat(ids, 3)).all()
    assert peak < 32 << 20, peak


def test_rollup_deals_rows_to_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "ROLLUP_ROWS", 100)
    links = spark.range(5000).selectExpr("id % 700 as k", "cast(id % 4 as double) as v", "id % 3 = 0 as done")
    rolled = catalogue.rollup(links, "k", "v", "done")
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and ", 50)" in plan and plan.split("+- == Initial Plan ==")[-1].count("Exchange") == 1
    assert {(r.k, r.n, r.n_unique) for r in rolled.collect()} == {(k, len(range(k, 5000, 700)), len({i % 4 for i in range(k, 5000, 700)})) for k in range(700)}


def test_kinds_and_fields_look_words_up(spark):
    """A text is cut into words once, not searched once per word of the tables; what is found stays the same."""
    texts = [("Studio Ä", "visual studio code, a Studio and studio", "Org"), ("designer's", "freelance", "Solo"), ("x", "visual  studio", None), ("Società", "", "Org"), ("ÉDesigner", "designer designer_ designer", "Solo")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, p string, b string, kind string")
    made = df.select("id", "kind", enrichment.org_or_solo(F.col("p"), F.col("b"), F.lit(None).cast("string")).alias("k"), enrichment.fields(F.col("p"), F.col("b")).alias("f"))
    assert {r.id: r.k for r in made.collect()} == {i: t[2] for i, t in enumerate(texts)}
    assert {r.id: r.f for r in made.collect()}[0] == ["Studio"]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_count") <= 12 and plan.lower().count("rlike") < 30


def _hashed_text(texts):
    """The vector of an id's texts, by the described hash."""
    v = [0.0] * 768
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        terms = [(w, 1 / math.log2(i + 3)) for i, w in enumerate(words)] + [("_".join(p), 0.5) for p in zip(words, words[1:])]
        for term, weight in terms:
            n = int(hashlib.sha256(term.encode()).hexdigest(), 16) % 1536
            v[n % 768] += weight if n < 768 else -weight
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def test_texts_meet_options_in_the_task_that_reads_them(spark, monkeypatch):
    """Neither words nor vectors are shuffled; texts of one id count as one, and taxonomies beyond a block give the same."""
    described = [("Home", "furniture household the of and"), ("Car", "automobile der die und"), ("Été", "été d'une machinery"), ("None", "xyzzy")]
    rnd = random.Random(9)
    bits = " ".join(d for _, d in described).split() + ["été", "日本", "x_y", "a-b", "ÉTÉ", "9"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60)))) for i in range(300)]
    options = vectors.taxonomy_vectors(spark.createDataFrame(described, "option string, description string")).cache()
    by_hash = [r.option for r in options.orderBy(F.xxhash64("option")).collect()]
    want_vectors = {o: _hashed_text([d]) for o, d in described}

    def check(rows):
        texts = {}
        for i, t in rows:
            texts.setdefault(i, []).append(t)
        made = vectors.match_texts(spark.createDataFrame(rows, "id long, t string"), "id", "t", options, -1.0)
        got = {r.id: (r.option, r.similarity) for r in made.collect()}
        assert made.count() == len(got) and set(got) == {i for i, ts in texts.items() if any(re.search(r"\w", t or "") for t in ts)}
        for i, (option, similarity) in got.items():
            own = _hashed_text(texts[i])
            sims = {o: sum(a * b for a, b in zip(own, want_vectors[o], strict=True)) for o in by_hash}
            assert abs(similarity - max(sims.values())) < 1e-9 and (len(texts[i]) > 1 or option == next(o for o in by_hash if sims[o] > max(sims.values()) - 1e-12))
        return made, got

    made, got = check(rows + [(900, None), (901, ""), (902, "-- !"), (903, "qqqq")])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and got[903][1] == 0.0
    check(rows + [(1, "furniture household"), (2, "der die und"), (2, None)])
    monkeypatch.setattr(vectors, "STEP_WORDS", 50)
    assert check(rows)[1] == {i: got[i] for i, _ in rows}
    monkeypatch.setattr(vectors, "BLOCK", 2)
    many = check(rows)[1]
    assert all(abs(many[i][1] - got[i][1]) < 1e-9 for i, _ in rows)
    none = vectors.match_texts(spark.createDataFrame(rows, "id long, t string"), "id", "t", options.where("false"), -1.0)
    assert none.count() == 0


def test_words_are_those_between_word_borders(spark):
    texts = ["a\u0301b \u0301c", "x\u200dy z\u200c", "日本 x_y ß9 ²", "\U00010400a-\U0001f600b", "ａ１ ª №", "e\u20dd ⓐ", "plain - text_1, 9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(rules.words_of(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(r"(?U)\b\w+\b"), F.lit(0)).alias("b")).collect():
        assert r.a == r.b


def test_texts_are_cut_into_words_once_for_all_rules(spark):
    """Category, type, tags and genre look up the same words, and patterns of several words are tried only where one begins."""
    assert rules._leads(r"\bguest house\b|\bb&b\b|\bno-code\b|\bfree\s*stock\b|\bab*c d\b") == ({"guest", "b", "no"}, {("free", 4), ("a", 1)})
    assert rules._leads(r"\bguest house\b|house") is None and rules._leads(r"\b(?i)x y") is None and rules._leads("") == (frozenset(), frozenset())
    rnd = random.Random(5)
    bits = ["guest", "house", "b&b", "bed and breakfast", "freestock", "free", "stock photos", "title", "case", "no-code", "web", "app", "é", "_", "hiking", "design", "machine learning", "qrcode", "x"]
    bits += [w for t in (rules.CATEGORY_RULES, rules.TYPE_RULES, rules.TAG_RULES, rules.GENRE_RULES) for p, _ in t for w in rules._terms(p)[0]]
    rows = [(i, *("".join(rnd.choice(bits) + rnd.choice([" ", " ", ", ", "-", ""]) for _ in range(rnd.randint(0, n))) for n in (6, 40))) for i in range(300)] + [(900, None, None), (901, "", "guest  house Guest House")]
    p, b = F.col("p"), F.col("b")
    made = spark.createDataFrame(rows, "id int, p string, b string").select(rules.labels(p, b).alias("l"), rules.category(p, b).alias("c"), rules.page_type(p, b).alias("k"), rules.tags(p, b).alias("t"), rules.first_label(p).alias("g"))
    for r in made.collect():
        assert (r.l.category, r.l.type, r.l.tags, r.l.genre) == (r.c, r.k, r.t, r.g)
    # two texts, each by one of two patterns
    once = spark.createDataFrame(rows, "id int, p string, b string").select(rules.labels(p, b).alias("l"))
    assert once._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 4
