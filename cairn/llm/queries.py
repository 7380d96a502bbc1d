"""Queries that apply the operators to the tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, collocations, filteraudit, htmltext, langid, packing, personal, quality, sharding, simhash, tokencount, topk, urlfilter
from cairn.llm.common import table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; install the public_tokenizers package or pass paths to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 4-word SimHash at 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language, score and mixture of every document; learnt from the other four folds only."""
    docs = table(spark, sf_dir, "documents")
    langs, prob = langid.learn(docs.filter(F.col("doc_id").isNotNull() & ~langid.held_out()))
    return langid.predict(docs, langs, prob).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "shares")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under law `bytes`; the digest is taken from the rows that arrive."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every hundredth one."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rule_table(spark)).drop("url")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, through a new cache."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoded text, as digests."""
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), digests=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")).drop("ids")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by language."""
    return filteraudit.audit(filteraudit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of personal data of every document, and all its spans."""
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in personal.KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language among phrases of 2 to 5 words that occur 100 times."""
    return collocations.collocations(collocations.phrase_counts(table(spark, sf_dir, "documents"))).drop("cut")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality_rules, op3_language_id, op4_sharding, op5_exact_top_k, op6_url_filters, op7_token_counts, op8_html_extraction, op9_bpe, op10_packing, op11_filter_audit, op12_personal_data, op13_collocations)}

WORDS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram FROM w, range(1, 6) AS s(size) WHERE len(w) >= size),
c AS (SELECT lang, size, gram, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
d AS (SELECT *, string_split(gram, ' ') AS w FROM c WHERE size >= 2),
k AS (SELECT lang, gram, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM d, range(1, 5) AS r(k) WHERE k < size),
s AS (SELECT k.lang, k.gram, k.f AS a, k.k, x.f AS l, y.f AS r, n, 1000 * k.f * n // (x.f * y.f) AS score FROM k JOIN t ON t.lang = k.lang JOIN c x ON x.lang = k.lang AND x.gram = k.head JOIN c y ON y.lang = k.lang AND y.gram = k.tail),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS place FROM s),
i AS (SELECT lang, array_to_string(w[a:z], ' ') AS gram, max(f) AS f FROM d, range(1, 5) AS q(a), range(2, 6) AS e(z) WHERE z > a AND z <= size AND z - a + 1 < size GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.gram = b.gram WHERE place = 1 AND (i.f IS NULL OR 100 * i.f < 100 * b.a))
SELECT lang, rank, gram AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM o) WHERE rank <= 2000""",
    "op11_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS own, list_sum(list_concat([0], bits[1:k - 1])) AS seen FROM o, range(1, 6) AS r(k)),
x AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (seen::INT | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & seen::INT = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & seen::INT > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & seen::INT = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & seen::INT = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x""",
    "op2_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT row_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM w),
r AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT row_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY row_id),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(list_distinct(words)) AS n_distinct,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals FROM w LEFT JOIN c USING (row_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
v AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 5 * n_dup_lines > 2 * n_lines OR (n_words > 100 AND 100 * n_distinct < 15 * n_words)
  OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * n_lettered < 3 * n_words OR 2 * n_capitals > word_chars AS rejected FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT rejected AS kept FROM v""",
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op6_url_filters": r"""
WITH u AS (SELECT row_number() OVER () AS row_id, page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT row_id, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r(verdict, rule, h, f) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
m AS (SELECT row_id, rule, r.verdict, row_number() OVER (PARTITION BY row_id ORDER BY length(rule) DESC) AS k FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.f))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.row_id = m.row_id AND m.k = 1""",
}
