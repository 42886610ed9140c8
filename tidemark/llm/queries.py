"""Registered queries of the text operators, with their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    ann,
    filter_audit,
    line_dedup,
    mixing,
    near_dup,
    packing,
    prefix_trie,
    quality,
    repetition,
    sharding,
    substring,
    token_counts,
    url_filter,
)
from tidemark.llm.tables import table

#: Place of the public vocabulary on every machine; a parameter of the operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


SHARD_BYTES = 1 << 20
KEY60 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@query("op1_extendible_sharding", f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         {KEY60.format("coalesce(doc_id::VARCHAR, '') || '=' || md5(coalesce(text, ''))")} AS h
  FROM documents),
nodes AS (
  SELECT d, h >> (60 - d) AS p, sum(n_bytes)::BIGINT AS b, min(h) = max(h) AS one
  FROM r, range(0, 61) AS t(d) GROUP BY ALL),
leaf AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(d) AS depth
  FROM r JOIN nodes ON nodes.p = r.h >> (60 - d) WHERE b <= {SHARD_BYTES} OR one GROUP BY ALL)
SELECT doc_id, n_bytes, depth::INT AS depth, h >> (60 - depth) AS prefix, 0::BIGINT AS page, b AS shard_bytes
FROM leaf JOIN nodes ON d = depth AND p = h >> (60 - depth)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, 2048)


@query("op5_substring_dedup", """
WITH w0 AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w0),
g AS (SELECT doc_id, pos, word, CASE WHEN pos <= n - 49 THEN
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS g FROM w),
m AS (SELECT doc_id, pos, word, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM g),
c AS (SELECT doc_id, pos, word, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
t AS (SELECT doc_id, count(*) AS n_words, sum(gone::INT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM c GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN t USING (doc_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


@query("op4_nearest_vectors", """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(table(spark, sf_dir, "embeddings"))


def repetition_sql(limits: repetition.Limits) -> str:
    """Words as rows; n-grams as texts of windows; what they cover by a running maximum."""
    grams = []
    for n in (limits.repeat_window, *limits.grams):
        grams.append(f"""
g{n} AS (SELECT doc_id, pos, chars, CASE WHEN pos <= n_words - {n} + 1 THEN
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g FROM w),
m{n} AS (SELECT doc_id, pos, chars, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS shared,
    g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) > 1 AS later FROM g{n}),
c{n} AS (SELECT doc_id, chars, max(shared) OVER b AS shared, max(later) OVER b AS later FROM m{n}
    WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
t{n} AS (SELECT doc_id, sum(CASE WHEN shared THEN 1 ELSE 0 END)::BIGINT AS shared, sum(CASE WHEN later THEN chars ELSE 0 END)::BIGINT AS inside FROM c{n} GROUP BY 1)""")
    shares = " OR ".join([f"100 * chars_in_lines > {limits.lines} * word_chars", *(f"100 * chars_in_{n}grams > {p} * word_chars" for n, p in limits.grams.items())])
    return f"""
WITH w0 AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, length(unnest(ws)) AS chars, len(ws) AS n_words FROM w0),
ln0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
ln1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM ln0),
ln2 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS later FROM ln1 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lines AS (SELECT doc_id, sum(later::INT)::BIGINT AS n, sum(CASE WHEN later THEN length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) ELSE 0 END)::BIGINT AS inside FROM ln2 GROUP BY 1),
{",".join(grams)},
d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_words,
    coalesce(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(t{limits.repeat_window}.shared, 0)::BIGINT AS n_repeat_words,
    coalesce(lines.inside, 0)::BIGINT AS chars_in_lines, {", ".join(f"coalesce(t{n}.inside, 0)::BIGINT AS chars_in_{n}grams" for n in limits.grams)}
  FROM documents LEFT JOIN lines USING (doc_id) {" ".join(f"LEFT JOIN t{n} USING (doc_id)" for n in (limits.repeat_window, *limits.grams))}),
b AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words} * n_words AS base_failed FROM d)
SELECT *, NOT base_failed AND NOT ({shares}) AS kept FROM b"""


@query("op6_repetition", repetition_sql(repetition.Limits()))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query("op7_pack_sequences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


@query("op3_quality_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [
    url_filter.rule("allow", "org/"),
    url_filter.rule("block", "example.org/es/"),
    url_filter.rule("block", "example.org/en/1"),
    url_filter.rule("allow", "com/fr/"),
    url_filter.rule("block", "com/de/"),
]
#: A page is listed when its source shows this many runs of symbols.
SYMBOL_RUN, LISTED_RUNS = r"[#*$%]{3}", 20


def fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


@query("op9_url_filter", f"""
WITH u AS (
  SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         coalesce(len(regexp_extract_all(html, '{SYMBOL_RUN}')) >= {LISTED_RUNS}, false) AS l
  FROM u),
j AS (
  SELECT page_id, host, path, bool_or(l) OVER (PARTITION BY host || path) AS listed,
    CASE WHEN {fits('example.org', '/en/1')} THEN 'example.org/en/1' WHEN {fits('example.org', '/es/')} THEN 'example.org/es/'
         WHEN {fits('com', '/fr/')} THEN 'com/fr/' WHEN {fits('com', '/de/')} THEN 'com/de/'
         WHEN {fits('org', '/')} THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM j""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.regexp_count(F.col("html"), F.lit(SYMBOL_RUN)) >= LISTED_RUNS
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, runs)


@query("op10_mix_sources", f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         {KEY60.format("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS ratio, sum(source_size) OVER ()::BIGINT AS total FROM s),
l AS (
  SELECT *, ratio < (total - coalesce(sum(cap) OVER b, 0)::BIGINT) / sum(w) OVER a AS capped
  FROM r WINDOW b AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                a AS (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()::BIGINT) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * w END AS target FROM l),
x AS (
  SELECT doc_id, size, source_size, target, floor(target / source_size)::BIGINT AS e,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t USING (source))
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN (e + CASE WHEN 2 * (floor(target)::BIGINT - e * source_size - before) >= size THEN 1 ELSE 0 END) * size ELSE 0 END)::BIGINT AS taken
FROM x""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


WORDS = "coalesce(len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')), 0)"


@query("op11_filter_audit", f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
    CASE WHEN {WORDS.format('text')} < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) < 80 * {WORDS.format('text')} THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM m GROUP BY ALL),
o(filter_order, used) AS (
  SELECT '', 0 UNION ALL
  SELECT filter_order || chr(65 + k::INT), used | (1 << k::INT) FROM o, range(0, 5) AS r(k) WHERE used & (1 << k::INT) = 0),
s AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[:step], '')])::INT AS after
  FROM o, range(1, 6) AS q(step) WHERE used = 31),
x AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & after = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & after = bit THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & after <> bit THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & after = bit THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & after = bit THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_line_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


#: CRC-32 of an ASCII text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({}, '')]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


@query("op13_prefix_trie", f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC32.format('conv_id::VARCHAR')} % 4 AS h FROM t GROUP BY 1),
r AS (
  SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
  UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t USING (conv_id) WHERE i > h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, {WORDS.format('text')} AS words,
    sha256(length(role) || ':' || role || text) AS key FROM r),
p AS (
  SELECT conv_id, depth, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
z AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
  SELECT path, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM z GROUP BY path),
k AS (SELECT left(path, -64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (
  SELECT p.path, sum((b.n_convs - 1) * b.words) AS saved, sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM n b JOIN p ON p.conv_id = b.conv_id AND p.depth <= b.depth LEFT JOIN k ON k.path = b.path GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN u USING (path) LEFT JOIN k USING (path) LEFT JOIN n o ON n.depth > 0 AND o.path = left(n.path, -64)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
