"""The llm operators bound to the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import (
    decontaminate, hard_negatives, kneser_ney, packing, pii, prefix_trie, pu_quality, repeats, secret_entropy, shingle_join,
    suffix_repeats, url_rules, vector_links,
)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(function):
    _QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op3_kneser_ney(spark, folder):
    docs = _table(spark, folder, "documents")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    scored = kneser_ney.score_texts(docs, kneser_ney.train(docs.where(~out)))
    return scored.withColumn("held_out", out)


@_query
def op4_pattern_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path())


@_query
def op1_weak_pii(spark, folder):
    return pii.find_personal_data(_table(spark, folder, "documents")).drop("found")


#: Host, path and verdict of the rules that the query judges by.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


@_query
def op2_url_rules(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, folder, "pages"), rules)


_SQL["op2_url_rules"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host) * 10000 + length(rule_path)) AS rule,
         arg_max(verdict, length(rule_host) * 10000 + length(rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)"""


@_query
def op7_secret_entropy(spark, folder):
    return secret_entropy.span_report(secret_entropy.find_secrets(_table(spark, folder, "documents")))


@_query
def op6_repeated_windows(spark, folder):
    done = repeats.drop_repeats(_table(spark, folder, "documents"), digest=True)
    return done.withColumnRenamed("kept", "kept_sha256")


_SQL["op6_repeated_windows"] = r"""
WITH cut AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS parts FROM documents),
spread AS (SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS place FROM cut),
words AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM spread WHERE word <> ''),
texts AS (SELECT doc_id, list(word ORDER BY i) AS words, count(*) AS n FROM words GROUP BY doc_id),
windows AS (
  SELECT doc_id, start, array_to_string(words[start : start + 19], ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(1, n - 18)) AS start FROM texts WHERE n >= 20)),
later AS (SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM later),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS said
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(t.n, 0) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.said, '')) AS kept_sha256
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


#: Score from which a text counts as good.
QUALITY = 0.3


@_query
def op5_pu_quality(spark, folder):
    scored = pu_quality.score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY).cast("int"))


@_query
def op8_int8_links(spark, folder):
    return vector_links.vector_links(_table(spark, folder, "embeddings"))


_SQL["op8_int8_links"] = r"""
WITH RECURSIVE sized AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
clean AS (
  SELECT vec_id, label, v FROM sized
  WHERE label IS NOT NULL AND len(v) > 0 AND list_dot_product(v, v) > 0 AND isfinite(list_sum(v))
    AND len(v) = list_count(v)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)"""


@_query
def op9_shingle_join(spark, folder):
    return shingle_join.near_duplicates(_table(spark, folder, "documents"))


_SQL["op9_shingle_join"] = r"""
WITH RECURSIVE cut AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS parts FROM documents),
spread AS (SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS place FROM cut),
texts AS (SELECT doc_id, list(word ORDER BY place) AS words, count(*) AS n FROM spread WHERE word <> '' GROUP BY doc_id),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[s : s + 4], ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(1, greatest(n - 4, 1) + 1)) AS s FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (said)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n, 0) AS n_links,
       doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN roots USING (doc_id) LEFT JOIN counts USING (doc_id)"""


@_query
def op10_edit_decontamination(spark, folder):
    return decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, numbered by ``place``, and all their ids.

    Conversation c begins with the first h turns of conversation c - c % 100
    and goes on with its own after its first h; h is crc32 of c in decimals, modulo 6.
    """
    turns = turns.where("conv_id IS NOT NULL")
    order = W.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = turns.withColumn("place", F.row_number().over(order)).select("conv_id", "place", "role", "text")
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    ids = turns.select("conv_id").distinct()
    own = numbered.where(F.col("place") > h)
    first = numbered.where("conv_id % 100 = 0 AND place <= 5").withColumnRenamed("conv_id", "base")
    lent = ids.withColumn("base", F.expr("conv_id - conv_id % 100")).join(first, "base").where(F.col("place") <= h)
    return own.unionByName(lent.drop("base")), ids


@_query
def op11_prefix_trie(spark, folder):
    turns, ids = rebuilt_conversations(_table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(turns, order="place", everyone=ids)


_SQL["op11_prefix_trie"] = r"""
WITH ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT conv_id, place, role, text FROM numbered JOIN ids USING (conv_id) WHERE place > h
  UNION ALL
  SELECT ids.conv_id, place, role, text FROM ids JOIN numbered f ON f.conv_id = ids.conv_id - ids.conv_id % 100 WHERE place <= h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, length(text) AS last,
         string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY place) AS name
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
paths AS MATERIALIZED (
  SELECT conv_id, depth, last, min(conv_id) OVER (PARTITION BY name) AS owner, max(depth) OVER (PARTITION BY conv_id) AS n FROM turns),
nodes AS (
  SELECT owner, depth, any_value(last) AS last, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
  FROM paths GROUP BY owner, depth),
linked AS (
  SELECT node.*, CASE WHEN node.depth > 0 THEN above.owner END AS parent
  FROM nodes node LEFT JOIN paths above ON above.conv_id = node.owner AND above.depth = node.depth - 1),
kids AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT above.owner, above.depth, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((below.n_convs - 1) * below.last)::BIGINT AS saved
  FROM nodes below JOIN paths above ON above.conv_id = below.owner AND above.depth <= below.depth
  LEFT JOIN kids ON kids.owner = below.owner AND kids.depth = below.depth GROUP BY above.owner, above.depth)
SELECT owner AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, n_leaves,
       saved AS saved_tokens, ends_sha256
FROM linked LEFT JOIN kids USING (owner, depth) JOIN sums USING (owner, depth)"""


@_query
def op12_suffix_repeats(spark, folder):
    done = suffix_repeats.drop_repeated_strings(_table(spark, folder, "documents"), keep="none", digest=True)
    return done.withColumnRenamed("kept", "kept_sha256")


_SQL["op12_suffix_repeats"] = r"""
WITH texts AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS body FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(body, 2 * s + 1, 400)) AS said
  FROM (SELECT doc_id, body, unnest(range(0, length(body) // 2 - 199)) AS s FROM texts)),
again AS (SELECT doc_id, s FROM windows QUALIFY count(*) OVER (PARTITION BY said) > 1),
beside AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS after
  FROM again),
gaps AS (
  SELECT doc_id, count(*) FILTER (WHERE before IS NULL OR s - before > 200) AS n_spans,
         sum(least(200, coalesce(after - s, 200)))::BIGINT AS n_removed, min(s) AS head,
         string_agg(CASE WHEN after > s + 200 THEN substr(body, 2 * (s + 200) + 1, 2 * (after - s - 200))
                         WHEN after IS NULL THEN substr(body, 2 * (s + 200) + 1) ELSE '' END, '' ORDER BY s) AS rest
  FROM beside JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(body) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN head IS NULL THEN body ELSE substr(body, 1, 2 * head) || rest END)) AS kept_sha256
FROM texts LEFT JOIN gaps USING (doc_id)"""


@_query
def op13_hard_negatives(spark, folder):
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


_SQL["op13_hard_negatives"] = r"""
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = list_count(embedding)
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM clean a JOIN clean b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
firsts AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM firsts JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
