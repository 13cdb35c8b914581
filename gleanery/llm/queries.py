"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import byte_bpe, chat_format, chosen_path, embedding_graph, language_id, mixing, quality_rules, substring_dedup, token_alignment, token_counts, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "rep_id", "n_shingles")


@query
def op6_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: Conversation -1: its texts hold the template's own control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.windows(rows.unionByName(extra)))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


#: Verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


SQL["op10_url_filter"] = """
WITH rules(v, h, p) AS (VALUES {rules}),
cut AS (SELECT page_id, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS pos FROM pages),
rest AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(u, pos + 3) ELSE '' END AS r FROM cut),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, x.rule AS rule, coalesce(x.v, 'allow') AS verdict
FROM parts LEFT JOIN LATERAL (
    SELECT arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
    FROM rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) x ON true
""".format(rules=", ".join(map(str, RULES)))


#: Words of every text in SQL.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op3_chosen_path"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, k, x.n AS na, y.n AS nb FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, least(d.doc_id, coalesce(c.m, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links, least(d.doc_id, coalesce(l.same, d.doc_id)) AS rep_id, coalesce(s.n, 0) AS n_shingles
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n, min(CASE WHEN k = na AND k = nb THEN b END) AS same FROM links GROUP BY 1) l ON l.a = d.doc_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) c ON c.a = d.doc_id
"""

SQL["op6_embedding_graph"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) l ON l.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) c ON c.a = vec_id
"""

SQL["op7_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (h), (SELECT unnest(range(0, 50)) AS k) WHERE m < doc_id),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN lists ON lists.doc_id = w.doc_id
"""
