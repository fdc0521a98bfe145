"""corpus_pipeline's stages against brute force, one after the other; each works on what its predecessor kept; odd tables pass."""

import re
from collections import Counter, defaultdict

import pytest
from test_llm_operators import BYTE, WORD, WORDS, brute_draw, brute_links, brute_pii, brute_targets, check_pieces  # noqa: F401

from lodeweave.llm import tokenization

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    by_id = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        rows = kept.collect()
        assert kept.columns == columns and rows, name
        assert {r.doc_id for r in rows} <= set(by_id), name
        kept = spark.createDataFrame(rows, docs.schema)
        if name == "personal_data":
            assert not any("@mail" in r.text for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def brute_quality(rows):
    """(row, text without frequent lines) of the rows that pass."""
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    by_host = defaultdict(set)
    for r in rows:
        by_host[r.source].add(r.text or "")
    over = {h: {x for x, n in Counter(x for t in ts for x in {normal(y) for y in t.split("\n") if WORDS.search(y)}).items() if n > 20} for h, ts in by_host.items()}
    for r in rows:
        w = WORDS.findall(r.text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        covered = {i + k for i, g in enumerate(windows) if n[g] > 1 for k in range(3)}
        clean = "\n".join(x for x in (r.text or "").split("\n") if not WORDS.search(x) or normal(x) not in over[r.source])
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and len(WORDS.findall(clean)) >= 0.3 * len(w):
            yield r, clean


def brute_redacted(text):
    out, at = "", 0
    for k, a, z in sorted((x.split(":") for x in brute_pii(text).split(",") if x), key=lambda x: (int(x[1]), ["email", "ip", "card", "phone"].index(x[0]))):
        if int(a) >= at:
            out += text[at : int(a)] + f"[{k.upper()}]"
        at = max(at, int(z))
    return out + text[at:]


def test_chain_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    want = [(r.doc_id, t, r.lang, r.source, len(t)) for r, t in brute_quality(docs.collect())]
    kept = stages["quality_rules"](spark, docs, sf).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(tuple, kept.collect())) == sorted(want) and 0 < len(want) < docs.count()
    kept = spark.createDataFrame(want, kept.schema)
    roots = brute_links({d: t for d, t, *_ in want}, 5, 80)
    want = [r for r in want if roots[r[0]][1] == r[0]]
    kept = stages["near_duplicates"](spark, kept, sf)
    assert sorted(map(tuple, kept.collect())) == sorted(want) and len(want) < len(roots)
    kept = spark.createDataFrame(want, kept.schema)
    want = [(d, brute_redacted(t), lang, s, len(brute_redacted(t))) for d, t, lang, s, _ in want]
    kept = stages["personal_data"](spark, kept, sf)
    assert sorted(map(tuple, kept.collect())) == sorted(want)
    kept = spark.createDataFrame(want, kept.schema)
    size = {r: len(WORDS.findall(r[1])) for r in want}
    targets = brute_targets({s: sum(n for r, n in size.items() if r[3] == s) for s in {r[3] for r in want}})
    mixed = []
    for source, target in targets.items():
        own = [r for r in want if r[3] == source]
        total = sum(size[r] for r in own)
        whole = min(3, int(target // total))
        taken = brute_draw([(r[0], r[1], size[r]) for r in own], target - whole * total)[0] if whole < 3 else set()
        mixed += [r for r in own for _ in range(whole + ((r[0], r[1], size[r]) in taken))]
    kept = stages["mixed_sources"](spark, kept, sf)
    assert sorted(map(tuple, kept.collect())) == sorted(mixed)
    once = spark.createDataFrame(want, kept.schema)
    encode = tokenization.Encoder(WORD).encode
    check_pieces(stages["packed_sequences"](spark, once, sf).collect(), {r[0]: encode(r[1]) + (1).to_bytes(4, "little") for r in want})


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None), (1, "", None, None, 0, "x"), (1, "two words", "en", "a", 9, "x")]])
def test_odd_tables(spark, sf, rows):
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, kept, sf)
        assert done.count() <= len(rows), name
        if name == "quality_rules":
            assert done.count() == 0
        elif name != "packed_sequences":
            assert done.columns == kept.columns
