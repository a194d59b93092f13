"""The queries of this subpackage, as the driver runs them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import ann, html_text, impact_topk, lm_score, mixing, near_dedup, packing, quality, token_counts, url_filter
from affinity.llm.common import table
from affinity.storage import ship_package

#: Tokens a document may have before op8 marks it.
TOKEN_LIMIT = 4096
#: The least score of op5 that counts as good.
QUALITY_LEAST = 0.3
#: Shares of all tokens that op3 gives the languages.
LANGUAGES = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The language of the documents that the labels table covers."""
    return docs.join(labels.select("doc_id").distinct(), "doc_id").select("doc_id", F.col("lang").alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGES)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.SITE_RULES + url_filter.PATTERN_RULES).drop("candidates")


def quality_held_out() -> Column:
    """Documents whose labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_held_out()
    model = quality.learn(docs, labels.filter(~held_out))
    scored = docs.select("doc_id", quality.scorer(docs, model).alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.vocabulary(tokenizer_path()), TOKEN_LIMIT)
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {TOKEN_LIMIT} AS over_limit", "fits_chars", "prefix_table")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), F.crc32(F.col("id").cast("string")) % 7 == 2)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_shingles", "component_id", "doc_id = component_id AS kept")


#: The contract's rules as conditions on host and path, and the method's host words, longest first; written out apart from the operator's rules.
_OP4_SQL = """
    WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    ruled AS (SELECT *, CASE
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
        string_split_regex(host, '[^a-z0-9]+') AS words FROM parts),
    patterned AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
        WHEN regexp_matches(host, '(^|[^a-z0-9])ads[^a-z0-9]*track([^a-z0-9]|$)') THEN 'ads track'
        WHEN list_contains(words, 'adserver') THEN 'adserver' WHEN list_contains(words, 'phishing') THEN 'phishing' WHEN list_contains(words, 'malware') THEN 'malware'
        WHEN list_contains(words, 'casino') THEN 'casino' WHEN list_contains(words, 'viagra') THEN 'viagra' WHEN list_contains(words, 'adult') THEN 'adult'
        WHEN list_contains(words, 'pills') THEN 'pills' WHEN list_contains(words, 'poker') THEN 'poker' WHEN list_contains(words, 'bets') THEN 'bets'
        WHEN list_contains(words, 'porn') THEN 'porn' WHEN list_contains(words, 'spam') THEN 'spam' END AS pattern FROM ruled)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM patterned
"""


_OP7_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
    SELECT * FROM ranked WHERE rank <= 5
"""


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run after executors have this package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


#: All pairs that share a shingle, and all that can be reached; for small tables.
_OP10_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
    e AS (SELECT doc_id, unnest(s) AS g FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
    parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN parts USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_html_text": op6_html_text,
    "op7_exact_topk": op7_exact_topk,
    "op8_token_counts": op8_token_counts,
    "op9_lm_score": op9_lm_score,
    "op10_near_dedup": op10_near_dedup,
}
QUERIES = {name: _with_package(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": _OP4_SQL, "op7_exact_topk": _OP7_SQL, "op10_near_dedup": _OP10_SQL}
