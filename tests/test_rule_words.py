"""Rules looked up by words give what their patterns give; exact rounding."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import rules

TABLES = {"category": rules.CATEGORY_RULES, "type": rules.TYPE_RULES, "tag": rules.TAG_RULES, "genre": rules.GENRE_RULES}


def test_alternatives_written_out():
    assert rules._alternatives(r"\bpens?\b|\bab(?:c|d(?:e|f)?)\b") == [r"\bpen\b", r"\bpens\b", r"\babc\b", r"\babd\b", r"\babde\b", r"\babdf\b"]
    words, starts, rest = rules._terms(r"\bstreet\w*|\bhik\w+|\bno-code\b|\bcar\b|\bqr(?:\s*codes?)?\b")
    assert words == {"car", "qr"} and starts == {("street", 6), ("hik", 4)} and rest == r"\bno-code\b|\bqr\s*code\b|\bqr\s*codes\b"


@pytest.mark.parametrize("name", TABLES)
def test_words_give_what_patterns_give(spark, name):
    table, rnd = TABLES[name], random.Random(name)
    bits = ["street", "streetwear", "hik", "hiking", "é", "ärt", "art", "guest", "house", "virtual", "assistant", "no-code", "no", "code", "-", "qr", "codes", "b&b", "bed and breakfast", "free stock", "stock photos", "_", "ai", "7", "\n", "web", "app", "content", "x"]
    bits += [w for p, _ in table for w in rules._terms(p)[0]]
    texts = ["".join(rnd.choice(bits) + rnd.choice([" ", " ", " ", ", ", "", "-", "é"]) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    low, patterns = F.lower(F.coalesce("text", F.lit(""))), tuple(p for p, _ in table)
    rows = df.withColumn("t", rules._looked_up(low, patterns)).select("id", F.array(*[F.struct(rules._found(F.col("t"), p), rules._found_times(F.col("t"), p)) for p in patterns]).alias("r")).collect()
    for r in rows:
        text = (texts[r.id] or "").lower()
        assert [(a, b) for a, b in r.r] == [(re.search(p, text) is not None, sum(1 for _ in re.finditer(p, text))) for p in patterns]


def test_exact_rounding(spark):
    rnd = random.Random(8)
    values = [rnd.random() * 10 ** rnd.randint(-3, 6) * rnd.choice([-1, 1]) for _ in range(60_000)] + [round(rnd.random(), 3) for _ in range(30_000)] + [k / 8 for k in range(-4000, 4000)] + [2.675, 0.125, 0.375, 1.005, 0.0, 1e300, 0.285, 1.115]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", rules.half_even(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != round(r.x, 2)] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(rules.half_even(F.col("x")).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r and odd[2].r == float("inf")
