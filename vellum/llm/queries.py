"""The training-data operators as queries over the whole tables; ORACLE has the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe, langid, mixing, pii, quality_model, quality_rules, resampling, sharding, simhash, substring, topk, trie, urls
from vellum.llm.common import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=24)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the current policy's rules do, each alone and without it, counted from the ledger's bits."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_topk": op3_topk, "op4_mixing": op4_mixing, "op5_urls": op5_urls, "op6_bpe": op6_bpe, "op7_langid": op7_langid, "op8_rules": op8_rules, "op9_substring": op9_substring, "op10_quality": op10_quality, "op11_pii": op11_pii, "op12_trie": op12_trie, "op13_resampling": op13_resampling, "rule_ablations": rule_ablations}

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
"""

_LEDGER = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, array_to_string(w, '') AS j,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), a AS (
  SELECT m.doc_id, n_words, word_chars, length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(j) - length(regexp_replace(j, '\p{Lu}', '', 'g')) AS n_capitals, length(j) - length(regexp_replace(j, '\p{L}', '', 'g')) AS n_letters,
    (length(j) - length(replace(j, '!!', ''))) // 2 AS n_shouts
  FROM m LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT
    + 32 * (100 * n_capitals > 50 * word_chars)::INT + 64 * (100 * n_shouts > 30 * n_words)::INT
    + 128 * (100 * n_letters < 60 * word_chars)::INT AS BIGINT) AS failed
  FROM a
)
"""
OP8_SQL = _LEDGER + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept,
  n_lines, n_capitals, n_letters, n_shouts, failed FROM f"""

_BITS = ", ".join(f"('{rule}', {1 << b})" for b, rule in enumerate(quality_rules.RULES))
ABLATIONS_SQL = _LEDGER + f"""SELECT r.rule, count(*) FILTER (WHERE failed & bit <> 0) AS failed, count(*) FILTER (WHERE failed = bit) AS alone,
  count(*) FILTER (WHERE failed IN (0, bit)) AS kept_without FROM f, (VALUES {_BITS}) r(rule, bit) GROUP BY r.rule"""

#: CRC-32 of a list of bytes, with the table made from its polynomial, which DuckDB has no function for.
_CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
)
"""


def _crc(text: str) -> str:
    """SQL of the CRC-32 of the UTF-8 bytes of the SQL value ``text``, where the column ``crc`` holds the table."""
    bytes_of = f"list_transform(range(CAST(length(hex(encode({text}))) // 2 AS BIGINT)), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({bytes_of}, lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1]), 4294967295), 4294967295)"


OP12_SQL = f"""
WITH {_CRC_TABLE}, t AS (
  SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS p FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, n, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc_table
), r AS (
  SELECT c.conv_id, p, k, b FROM c JOIN t ON t.conv_id = c.base AND p < h
  UNION ALL
  SELECT c.conv_id, p - c.h + least(c.h, coalesce(o.n, 0)), k, b FROM c JOIN t ON t.conv_id = c.conv_id AND p >= c.h LEFT JOIN c o ON o.conv_id = c.base
), s AS (
  SELECT conv_id, p + 1 AS depth, b, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY p) AS path FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c
), l AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM s
), n AS (
  SELECT path, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM l GROUP BY path
), k AS (
  SELECT above AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above
), u AS (
  SELECT s.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((n_convs - 1) * n.b) AS saved
  FROM n JOIN s ON s.conv_id = n.conv_id AND s.depth <= n.depth LEFT JOIN k ON k.path = n.path GROUP BY s.path
)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN u ON u.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n m ON m.path = n.above AND n.depth > 0
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP13_SQL = f"""
WITH {_CRC_TABLE}, d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT {_WORDS} AS w FROM benchmark
), df AS (
  SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d
), bf AS (
  SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b
), h AS (
  SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table
), s AS (
  SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket
), sums AS (
  SELECT CAST((SELECT count(*) FROM df) AS DOUBLE) AS all_s, CAST((SELECT count(*) FROM bf) AS DOUBLE) AS all_t
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000)) / ((coalesce(s, 0) + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums
), m AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN gains USING (bucket) GROUP BY doc_id
), o AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN m USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM o WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM o LEFT JOIN r USING (doc_id)
"""

ORACLE: dict[str, str] = {"op3_topk": OP3_SQL, "op8_rules": OP8_SQL, "op12_trie": OP12_SQL, "op13_resampling": OP13_SQL, "rule_ablations": ABLATIONS_SQL}
