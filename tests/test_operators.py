"""Pages, sitemaps, catalogue and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import catalogue as cat
from lodeweave.operators import html, rules, vectors
from lodeweave.sources import sitemaps, tables
from lodeweave.streaming import jobs


@pytest.mark.parametrize("sizes, href, size", [("180x180", "", 180), ("16x16 32x32 64x64", "", 64), ("any", "", 0), ("", "/icon_512.png?v=2", 512), ("", "/favicon.ico", 0)])
def test_icon_size(sizes, href, size):
    assert html.icon_size(sizes, href) == size


def test_markdown():
    page = """<html><body><nav>skip</nav><main><h1>Head</h1><p>A <b>bold</b> <a href="/x">link</a><br>line and more text here.</p>
    <ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><table><tr><th>a|b</th><th>c</th></tr><tr><td>1</td></tr></table><pre>x  y</pre>
    <div class="cookie-banner">no</div><div style="display: none">hidden</div><script>var a</script><blockquote><p>said</p></blockquote><img src="i.png" alt="pic"></main></body></html>"""
    got = html.to_markdown(page, "https://a.example/p")
    for part in ("# Head", "A **bold** [link](https://a.example/x) line", "- one\n  - in\n- two", "| a\\|b | c |\n|---|---|\n| 1 |  |", "```\nx  y\n```", "> said", "![pic](https://a.example/i.png)"):
        assert part in got, part
    for part in ("skip", "no\n", "hidden", "var a"):
        assert part not in got
    assert html.to_markdown(None, None) == "" and html.read_page("", None)["text_len"] == 0


def test_titles(spark):
    cases = [("<title>Just a moment...</title><h1>Real</h1>", "Real"), ("<title> A  b </title>", "A b"), ("<meta name='twitter:title' content='T'>", "T"), ("", "Untitled")]
    d = html.parse_pages(spark.createDataFrame([(str(i), h) for i, (h, _) in enumerate(cases)], "url string, html string"))
    got = {r.url: r.t for r in d.select("url", html.title(F.col("page")).alias("t")).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [t for _, t in cases]


def test_sitemaps(spark):
    d = spark.createDataFrame([("a", "https://x.example/a&b", "2024-01-01"), ("a", "https://x.example/0", None)], "k string, loc string, lastmod string")
    xml = sitemaps.to_xml(d, "k").first().xml
    assert "a&amp;b" in xml and xml.index("/0") < xml.index("a&amp;b")
    back = spark.createDataFrame([(xml,)], "x string").select(sitemaps.entries(F.col("x")).alias("e")).first().e
    assert [(e.loc, e.lastmod) for e in back] == [("https://x.example/0", None), ("https://x.example/a&b", "2024-01-01")]


def test_tables(spark, tmp_path):
    (tmp_path / "services").mkdir()
    (tmp_path / "services" / "t.json").write_text('{"Type": ["A", "B"], "Tags": ["x"]}')
    rows = tables.read_taxonomy(spark, f"{tmp_path}/services/t.json").collect()
    assert {(r.db, r.relation, r.ord, r.option) for r in rows} == {("services", "Type", 0, "A"), ("services", "Type", 1, "B"), ("services", "Tags", 0, "x")}
    (tmp_path / "c.csv").write_text("Key,Value\nEmail, a@b.example\n ,x\n")
    assert [(r.key, r.value) for r in tables.read_contacts(spark, f"{tmp_path}/c.csv").collect()] == [("Email", "a@b.example")]
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    assert tables.read_texts(spark, f"{tmp_path}/bad.txt").first().text == "ab"
    d = spark.createDataFrame([(1, "u2", "f", "t2"), (1, "u1", "f", "t1")], "job int, url string, folder string, title string")
    assert [r.folder for r in tables.output_folders(d.withColumnRenamed("folder", "dir"), "job", ["dir"], "url").orderBy("url").collect()] == ["f", "f_2"]
    assert [(r.ordinal, r.title) for r in tables.page_index(d, "job", "title", "url", "folder").orderBy("ordinal").collect()] == [(1, "t1"), (2, "t2")]


def test_catalogue(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id int, slug string")
    d = spark.createDataFrame([(1,), (2,), (None,)], "fk int")
    assert cat.optional_filter(d, "fk", "b", known).count() == 1
    assert cat.optional_filter(d, "fk", "zz", known).count() == 3 and cat.optional_filter(d, "fk", "zz", known, strict=True).count() == 0
    assert cat.optional_filter(d, "fk", "all").count() == 3 and cat.optional_filter(d, "fk", 2).count() == 1
    merged = cat.evolve(known, d).columns
    assert merged == ["id", "slug", "fk"]


def test_labels_and_cosine(spark):
    d = spark.createDataFrame([(["A", "b"], ["B", "c"], [1.0, 0.0], [0.0, 2.0], [])], "x array<string>, y array<string>, u array<double>, v array<double>, w array<double>")
    r = d.select(rules.union_labels(F.col("x"), F.col("y"), 5).alias("l"), vectors.cosine(F.col("u"), F.col("v")).alias("o"), vectors.cosine(F.col("u"), F.col("u")).alias("i"), vectors.cosine(F.col("u"), F.col("w")).alias("e")).first()
    assert (r.l, r.o, r.i, r.e) == (["A", "b", "c"], 0.0, 1.0, 0.0)


def test_nearest_in_blocks_equals_one_block(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(60)
    r = e.withColumnRenamed("vec_id", "near")
    key = lambda x: (x.vec_id, x.place, x.near, round(x.similarity, 9))
    for other_ids in (False, True):
        a, b = (vectors.nearest(e, r, "vec_id", "near", "embedding", "embedding", block=n, other_ids=other_ids).collect() for n in (4096, 7))
        assert sorted(map(key, a)) == sorted(map(key, b)) and a
        assert all((x.vec_id == x.near) == (not other_ids) for x in b if x.place == 1)


def test_upsert_sink(spark, tmp_path):
    def merge(stored, batch):
        return batch if stored is None else stored.join(batch, "k", "left_anti").unionByName(batch)

    sink = jobs.upsert_into(spark, str(tmp_path), merge)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink(one, 0)
    for _ in range(2):  # a replayed batch changes nothing
        sink(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/v1").collect())) == [(1, "a"), (2, "c")]


def test_json_ld_of_long_lists_and_graphs(spark):
    things = ",".join('{"@type":"Thing","sku":"no"}' for _ in range(6))
    org = '{"@type":"Organization","foundingDate":"1987","description":"Far down.","address":{"addressLocality":"Bern","addressCountry":"CH"}}'
    product = '{"@type":["Thing","Product"],"sku":"zz9-blue"}'
    blocks = [f"[{things},{org},{product}]", f'{{"@graph":[{things},{{"@graph":[{org}]}},[{product}]]}}', "{broken", '"\\ud800"']
    rows = [(i, "u", f'<script type="application/ld+json">{b}</script>') for i, b in enumerate(blocks)]
    p = F.col("page")
    got = html.parse_pages(spark.createDataFrame(rows, "id int, url string, html string")).select("id", html.about(p), html.founded(p), html.location(p), F.array_join(html.skus(p), ",")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [("Far down.", 1987, "Bern, CH", "ZZ9,BLUE")] * 2 + [(None, None, None, "")] * 2
