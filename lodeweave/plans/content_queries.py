"""Registered text, rule and vector queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.operators import rules, vectors
from lodeweave.plans.registry import query, table


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\t ]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+', ''), '\s+$', '') AS cleaned FROM documents")
def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'default') AS slug, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(replace(p_type, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') AS param, left(replace(regexp_replace(p_name, '[^-_.() A-Za-z0-9]', '', 'g'), ' ', '_'), 100) AS file_name FROM part")
def text_slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"), tx.param_case(F.col("p_type")).alias("param"), tx.file_name(F.col("p_name")).alias("file_name"))


_PARKED = " OR ".join(f"contains(t, '{p}')" for p in tx.PARKED_PHRASES)
_CHROME = " OR ".join(f"contains(lower(c), '{p}')" for p in tx.CHROME_PHRASES)


@query(rf"WITH a AS (SELECT doc_id, lower(text) AS t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\t ]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^\s+', ''), '\s+$', '') AS c FROM documents) SELECT doc_id, {_PARKED} AS parked, len(c) >= 50 AND NOT (({_CHROME}) AND len(c) < 200) AND len(regexp_extract_all(c, 'http')) / (len(c) + 1) <= 0.1 AS meaningful FROM a")
def text_meaningful_parked(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.is_parked(t).alias("parked"), tx.is_meaningful(t).alias("meaningful"))


#: Common words of the corpus, so that scores, ties and caps occur on the tables.
CORPUS_RULES = ((r"\bthe\b|\bof\b", "article"), (r"\bthat\b", "relative"), (r"\band\b|\bor\b", "joiner"), (r"\bwas\b|\bis\b", "verb"), (r"\bin\b|\bon\b|\bat\b", "place"))


def _count(p: str, ws: str) -> str:
    words = ", ".join("'" + x.replace(r"\b", "") + "'" for x in p.split("|"))
    return f"len(list_filter({ws}, lambda x: x IN ({words})))"


#: Letters, marks, digits and connectors: what a word is made of wherever a pattern has Unicode word borders.
_LETTERS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
_DOCUMENTS = rf"SELECT doc_id, regexp_extract_all(lower(split_part(text, chr(10), 1)), '{_LETTERS}') AS ps, regexp_extract_all(lower(left(trim(text, ' '), 2500)), '{_LETTERS}') AS bs FROM documents"
_SCORES = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {i} AS ord, (CASE WHEN {_count(p, 'ps')} > 0 THEN 3.0 ELSE 0 END + CASE WHEN {_count(p, 'bs')} >= 2 THEN least(2.0, {_count(p, 'bs')} * 0.5) ELSE 0 END)::DOUBLE AS score FROM e" for i, (p, label) in enumerate(CORPUS_RULES))
_KINDS = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {i} AS ord, (CASE WHEN {_count(p, 'ps')} > 0 THEN 3.0 WHEN {_count(p, 'bs')} > 0 THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM e" for i, (p, label) in enumerate(CORPUS_RULES))
_BEST = "SELECT doc_id, CASE WHEN score > 0 THEN label END AS label, CASE WHEN score > 0 THEN score END AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1"


def _classified(spark, sf):
    """Every document, with the features of its whole text; its first line stands for the title."""
    title = F.substring_index("text", "\n", 1)
    none = F.lit(None).cast("string")
    return table(spark, sf, "documents").select("doc_id", rules.features(title, none, F.col("text"), none).alias("f")).select("doc_id", "f.primary", "f.body")


@query(f"WITH e AS ({_DOCUMENTS}), s AS ({_SCORES}) {_BEST}")
def classify_rules_category(spark, sf):
    return _classified(spark, sf).select("doc_id", rules.category(F.col("primary"), F.col("body"), CORPUS_RULES).alias("b")).select("doc_id", "b.label", "b.score")


@query(f"WITH e AS ({_DOCUMENTS}), s AS ({_KINDS}) {_BEST}")
def classify_rules_type(spark, sf):
    return _classified(spark, sf).select("doc_id", rules.page_type(F.col("primary"), F.col("body"), CORPUS_RULES).alias("b")).select("doc_id", "b.label", "b.score")


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {_count(p, 'ps')} > 0 OR {_count(p, 'bs')} >= 2 THEN '{label}' END" for p, label in CORPUS_RULES) + "], lambda x: x IS NOT NULL)[1:3]"
_GENRE = "CASE " + " ".join(f"WHEN {_count(p, 'ps')} > 0 THEN '{label}'" for p, label in CORPUS_RULES) + " END"


@query(f"WITH e AS ({_DOCUMENTS}) SELECT doc_id, coalesce(array_to_string({_TAGS}, ','), '') AS tags, {_GENRE} AS genre FROM e")
def classify_rules_tags(spark, sf):
    p, b = F.col("primary"), F.col("body")
    return _classified(spark, sf).select("doc_id", F.array_join(rules.tags(p, b, CORPUS_RULES, 3), ",").alias("tags"), rules.first_label(p, CORPUS_RULES).alias("genre"))


#: A text whose word borders are those of ASCII: other marks as blanks, other letters as one capital.
_ASCII = r"regexp_replace(regexp_replace({}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]', ' ', 'g'), '[^\x00-\x7F]', 'Z', 'g')"
_TITLED = f"SELECT d.doc_id, {_ASCII.format("lower(coalesce(c_mktsegment, '') || ' ' || split_part(d.text, chr(10), 1))")} AS p, {_ASCII.format("lower(left(trim(d.text, ' '), 2500))")} AS b FROM documents d LEFT JOIN customer ON c_custkey = d.doc_id"


def _rule_rows(rules, points: str) -> str:
    """Rows (doc_id, kind of rule, score) of a rule table; points over h (hits in the title) and n (hits in the body)."""
    return " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {i} AS ord, ({points}) AS score FROM (SELECT doc_id, regexp_matches(p, '{p}') AS h, len(regexp_extract_all(b, '{p}')) AS n FROM t)" for i, (p, label) in enumerate(rules))


@query(f"""WITH t AS ({_TITLED}), c AS ({_rule_rows(rules.CATEGORY_RULES, "CASE WHEN h THEN 3.0 ELSE 0 END + CASE WHEN n >= 2 THEN least(2.0, n * 0.5) ELSE 0 END")}),
k AS ({_rule_rows(rules.TYPE_RULES, "CASE WHEN h THEN 3.0 WHEN n > 0 THEN 1.0 ELSE 0 END")}), g AS ({_rule_rows(rules.TAG_RULES, "CASE WHEN h OR n >= 2 THEN 1 ELSE 0 END")}),
bc AS (SELECT doc_id, arg_max(label, {{'s': score, 'o': -ord}}) FILTER (WHERE score > 0) AS category, (max(score) FILTER (WHERE score > 0))::DOUBLE AS score FROM c GROUP BY doc_id),
bk AS (SELECT doc_id, arg_max(label, {{'s': score, 'o': -ord}}) FILTER (WHERE score > 0) AS type FROM k GROUP BY doc_id),
bg AS (SELECT doc_id, coalesce(array_to_string((list(label ORDER BY ord) FILTER (WHERE score > 0))[1:5], ','), '') AS tags FROM g GROUP BY doc_id)
SELECT t.doc_id, category, score, type, tags FROM t JOIN bc USING (doc_id) JOIN bk USING (doc_id) JOIN bg USING (doc_id)""")
def classify_production(spark, sf):
    """Every document by the production rules; a customer's segment and the first line stand for the title."""
    segment = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(segment, "doc_id", "left")
    title, none = F.concat(F.coalesce("c_mktsegment", F.lit("")), F.lit(" "), F.substring_index("text", "\n", 1)), F.lit(None).cast("string")
    f = docs.select("doc_id", rules.features(title, none, F.col("text"), none).alias("f")).select("doc_id", "f.primary", "f.body")
    p, b = F.col("primary"), F.col("body")
    done = f.select("doc_id", rules.category(p, b).alias("c"), rules.page_type(p, b).alias("k"), rules.tags(p, b).alias("tags"))
    return done.select("doc_id", F.col("c.label").alias("category"), F.col("c.score").alias("score"), F.col("k.label").alias("type"), F.array_join("tags", ",").alias("tags"))


_SCORED = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {i} AS ord, CASE WHEN {_count(p, 'ps')} > 0 THEN 5 WHEN {_count(p, 'bs')} >= 5 THEN 3 WHEN {_count(p, 'bs')} >= 3 THEN 2 WHEN {_count(p, 'bs')} >= 1 THEN 1 ELSE 0 END AS score FROM e" for i, (p, label) in enumerate(CORPUS_RULES))


@query(f"WITH e AS ({_DOCUMENTS}), s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n FROM s WHERE score >= 3 AND label <> 'verb'), t AS (SELECT doc_id, string_agg(label, ',' ORDER BY n) AS tags FROM r WHERE n <= 2 GROUP BY doc_id) SELECT documents.doc_id, coalesce(tags, '') AS tags FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id")
def infer_scored_tags(spark, sf):
    t = rules.scored_tags(F.col("primary"), F.col("body"), CORPUS_RULES, ("verb",), 3, 2)
    return _classified(spark, sf).select("doc_id", F.array_join(t, ",").alias("tags"))


_PAIRS = "SELECT a.vec_id AS vec_id, b.vec_id AS near_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"


@query(f"WITH p AS ({_PAIRS}) SELECT vec_id, near_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near_id) AS place FROM p WHERE s >= 0 QUALIFY place <= 3")
def vec_cosine_topk(spark, sf):
    """Ids divisible by 20 against all other rows."""
    e = table(spark, sf, "embeddings")
    n = vectors.nearest(e.where("vec_id % 20 = 0"), e.withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", "embedding", "embedding", k=3, other_ids=True)
    return n.withColumn("similarity", F.round("similarity", 6))


@query(rf"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '{_LETTERS}') AS w FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT item_id, unnest(w) AS t, 1 / log2(unnest(generate_series(0, len(w) - 1)) + 3) AS weight FROM w UNION ALL SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1])), 0.5 FROM w),
h AS (SELECT item_id, weight, (('0x' || substr(sha256(t), 62, 3))::BIGINT + 1024 * list_sum(list_transform(string_split(substr(sha256(t), 1, 61), ''), lambda c: ('0x' || c)::BIGINT))) % 1536 AS r FROM t),
s AS (SELECT item_id, (r % 768)::BIGINT AS pos, sum(CASE WHEN r < 768 THEN weight ELSE -weight END) AS v FROM h GROUP BY ALL)
SELECT item_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) + 0.0 AS value FROM s""")
def hash_embedding_sparse(spark, sf):
    return vectors.hash_embedding(table(spark, sf, "benchmark"), "item_id", "text").select("item_id", "pos", (F.round("value", 6) + 0.0).alias("value"))
