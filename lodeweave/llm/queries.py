"""The registered queries of this subpackage: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, gam, langid, lm, mixing, neardup, packing, pii, quality, secrets, tokenbin, topk, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "sequence_tokens", "padded_to", "step_group")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), _held_out(5, 1))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.number_of(k, "base").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("row.doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = [secrets.number_of(k, "base").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("row.doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenbin.write(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return tokenbin.read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def _held_out(parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _held_out(4, 2).alias("held_out"), "lang", "text")
    profiles = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), profiles).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gam.described(_table(spark, sf_dir, "documents").select("doc_id", _held_out(5, 0).alias("held_out"), "text"))
    labels = _table(spark, sf_dir, "labels").where(~_held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    scored = gam.score(found, gam.learn(found, labels))
    return scored.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.branched(trie.sequences(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_WORD = r"[^\x20\x09-\x0D]+"

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, string_split(text, chr(10)) AS lines, regexp_extract_all(text, '{_WORD}') AS w FROM d),
n AS (SELECT *, list_transform(lines, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM t),
freq AS (SELECT source, line, count(DISTINCT text) AS c FROM (SELECT source, text, unnest(norm) AS line FROM n) WHERE line <> '' GROUP BY source, line),
lim AS (SELECT source, list(line) AS over FROM freq WHERE c > 20 GROUP BY source),
j AS (SELECT n.*, lim.over FROM n LEFT JOIN lim ON n.source IS NOT DISTINCT FROM lim.source),
g AS (SELECT rid, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x, unnest(generate_series(1, len(w) - 2)) AS i FROM t),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT j.rid, doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  CASE WHEN over IS NULL THEN len(w) ELSE len(regexp_extract_all(array_to_string(list_transform(list_filter(generate_series(1, len(lines)), lambda i: NOT list_contains(over, norm[i])), lambda i: lines[i]), chr(10)), '{_WORD}')) END AS n_left
  FROM j LEFT JOIN rep ON j.rid = rep.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left >= n_words * 0.3::DOUBLE AS kept FROM f
"""

_NEARDUP_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT c.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.id
"""

_MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
n AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS need, (sum(source_size) OVER ())::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
f AS (SELECT *, max(CASE WHEN need > level THEN level END) OVER () AS free_level FROM l),
t AS (SELECT source, source_size, n_docs, coalesce(CASE WHEN need <= level THEN cap ELSE free_level * weight END, 0) AS target FROM f),
p AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3)::BIGINT AS whole FROM t),
g AS (SELECT *, CASE WHEN whole >= 3 THEN 0 ELSE target - whole * source_size END AS budget FROM p),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
y AS (SELECT g.source, z.size, (g.budget - coalesce(sum(z.size * z.n) OVER (PARTITION BY g.source ORDER BY z.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(z.size::DOUBLE * z.size * z.n) OVER (PARTITION BY g.source ORDER BY z.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM z JOIN g ON z.source IS NOT DISTINCT FROM g.source WHERE g.budget > 0),
x AS (SELECT source, arg_max(scale, size) AS scale FROM y WHERE scale * size <= 1 GROUP BY source),
u AS (SELECT d.doc_id, d.size, d.source, g.source_size, g.target, g.whole, g.budget, coalesce(x.scale, 0) * d.size AS pi,
  (('0x' || left(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.digest), 12))::BIGINT::DOUBLE + 0.5) / 281474976710656::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
q AS (SELECT *, CASE WHEN pi <= 0 THEN NULL WHEN pi >= 1 THEN 0 ELSE (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM u),
c AS (SELECT source, max(q) AS q_cut FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q) AS upto, sum(size) OVER (PARTITION BY source, q) AS equal FROM q WHERE q IS NOT NULL)
  WHERE upto - equal / 2.0::DOUBLE <= budget GROUP BY source)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * (q.whole + CASE WHEN q.q <= c.q_cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source
"""

_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (v.total + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN t ON g.lang = t.lang AND g.source = t.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""

_TRIE_SQL = """
WITH r AS (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS label, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'label': label, 'chars': chars} ORDER BY turn NULLS FIRST, label) AS t FROM r GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h FROM own),
b AS (SELECT h.conv_id, list_concat(coalesce(o.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100),
s AS (SELECT conv_id, list_transform(t, lambda x: x.label) AS l, list_transform(t, lambda x: x.chars) AS c FROM b),
x AS (SELECT conv_id, l, c, unnest(range(0, len(l) + 1)) AS d FROM s),
g AS (SELECT array_to_string(l[1:d], '') AS p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d > 0 THEN c[d] ELSE 0 END) AS chars,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(l) = d), '')) AS ends FROM x GROUP BY ALL),
k AS (SELECT left(p, 32 * (d::INT - 1)) AS p, count(*) AS k FROM g WHERE d > 0 GROUP BY 1),
m AS (SELECT g.*, coalesce(k.k, 0) AS k FROM g LEFT JOIN k ON k.p = g.p),
u AS (SELECT p, k, n, chars, unnest(range(0, d + 1)) AS e FROM m),
t AS (SELECT left(p, 32 * e::INT) AS p, sum((k = 0)::INT) AS leaves, sum((n - 1) * chars) AS saved FROM u GROUP BY 1)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, m.k AS n_children, t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN t ON t.p = m.p LEFT JOIN m q ON m.d > 0 AND q.p = left(m.p, 32 * (m.d::INT - 1))
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _TOPK_SQL, "op6_neardup": _NEARDUP_SQL, "op7_quality": _QUALITY_SQL, "op9_mixing": _MIXING_SQL, "op11_divergence": _DIVERGENCE_SQL, "op13_trie": _TRIE_SQL}
