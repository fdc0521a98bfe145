"""Every registered query runs, and equals its SQL where it has one."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from lodeweave.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, db):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(got, df.columns) == canonical(want.fetchall(), want.columns)


def test_classification_is_not_vacuous(spark, sf):
    assert QUERIES["classify_rules_category"](spark, sf).count() > 20
    assert QUERIES["classify_rules_category"](spark, sf).where("label is not null").count() > 20
    assert QUERIES["taxonomy_scan"](spark, sf).where("found <> ''").count() > 20


def test_whole_table_classification_against_python(spark, sf):
    from lodeweave.plans.content_queries import CORPUS_RULES
    from lodeweave.plans.page_queries import _WORDS

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {name: {r.doc_id: r for r in QUERIES[name](spark, sf).collect()} for name in ("classify_rules_category", "classify_rules_type", "classify_rules_tags", "infer_scored_tags", "taxonomy_scan")}
    for d, text in docs.items():
        low = text.lower()
        first, body = low.split("\n")[0], low.strip(" ")[:2500]
        hits = [(len(re.findall(p, first)), len(re.findall(p, body)), label) for p, label in CORPUS_RULES]
        category = [((3 if a else 0) + (min(2, b / 2) if b >= 2 else 0), label) for a, b, label in hits]
        kind = [(3 if a else 1 if b else 0, label) for a, b, label in hits]
        for name, scores in (("classify_rules_category", category), ("classify_rules_type", kind)):
            best = max(scores, key=lambda s: s[0])
            r = found[name][d]
            assert (r.score, r.label) == (best if best[0] else (None, None)), (name, d)
        r = found["classify_rules_tags"][d]
        assert r.tags == ",".join([label for a, b, label in hits if a or b >= 2][:3])
        assert r.genre == next((label for a, _, label in hits if a), None)
        scored = [(5 if a else 3 if b >= 5 else 2 if b >= 3 else 1 if b else 0, label) for a, b, label in hits if label != "verb"]
        assert found["infer_scored_tags"][d].tags == ",".join([label for s, label in sorted(scored, key=lambda s: -s[0]) if s >= 3][:2])
        assert found["taxonomy_scan"][d].found == ",".join(o for o in _WORDS if (len(o) > 2 or o == "AI") and re.search(rf"(?<!\w){o.lower()}(?!\w)", low))
    assert all(len(x) == len(docs) for x in found.values())


def test_nearest_of_whole_table_against_brute_force(spark, sf):
    import numpy as np

    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, m = [i for i, _ in rows], np.stack([v / np.linalg.norm(v) for _, v in rows])
    want = {}
    for i, v in zip(ids, m, strict=True):
        if i % 20 == 0:
            want[i] = [round(s, 5) for s in sorted((float(x) for j, x in zip(ids, m @ v, strict=True) if j != i and x >= 0), reverse=True)[:3]]
    got = {}
    for r in sorted(QUERIES["vec_cosine_topk"](spark, sf).collect(), key=lambda r: (r.vec_id, r.place)):
        assert r.near_id != r.vec_id and r.place == len(got.get(r.vec_id, [])) + 1
        got.setdefault(r.vec_id, []).append(r.similarity)
    assert got.keys() == {i for i in want if want[i]} and all(np.allclose(got[i], want[i], atol=2e-5) for i in got)


def test_hashed_vectors_of_all_texts_against_python(spark, tmp_path):
    from hashlib import sha256

    texts = ["Plain words here, plain", "\u00c9t\u00e9 \u00e0 Z\u00fcrich na\u00efve", "\u6f22\u5b57 and \u0441\u043b\u043e\u0432\u043e", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        terms = [(x, 1 / math.log2(k + 3)) for k, x in enumerate(w)] + [(f"{a}_{b}", 0.5) for a, b in zip(w, w[1:], strict=False)]
        v = {}
        for x, weight in terms:
            r = int(sha256(x.encode()).hexdigest(), 16) % 1536
            v[r % 768] = v.get(r % 768, 0) + (weight if r < 768 else -weight)
        size = math.sqrt(sum(x * x for x in v.values()))
        want |= {(i, pos): x / size for pos, x in v.items()}
    got = {(r.item_id, r.pos): r.value for r in QUERIES["hash_embedding_sparse"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_page_cascades_run_over_all_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    contact = QUERIES["html_contact"](spark, sf).collect()
    assert {r.page_id for r in contact} == set(pages) and len(contact) == len(pages)
    for r in contact:
        tel = re.search(r"""<a\b[^>]*\bhref=["']tel:([^"']*)""", pages[r.page_id].html or "", re.I)
        assert r.phone == (tel[1].strip() or None if tel else None)
    assert QUERIES["html_skus"](spark, sf).count() == len(pages)
    media = QUERIES["media_urls"](spark, sf).collect()
    assert {r.page_id for r in media} == set(pages)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
