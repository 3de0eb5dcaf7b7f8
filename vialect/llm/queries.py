"""One query for each operator, with production parameters, and the SQL that DuckDB can check it with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialect.llm import bpe, fingerprints, html_extract, langid, line_dedup, ngram_join, packing, quality, topk, url_filter
from vialect.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts. A null text counts as empty; repeated rows stay; a null doc_id comes last. An empty table gives no rows."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: class_id, n_links and copy_of of every row, repeated rows too. Texts without words, nulls among them, are copies of each other. An empty table gives no rows."""
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "copy_of")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for each vector whose id 100 divides. Null, empty and non-finite vectors take no part; repeated rows count once. An empty table gives no rows."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", "vec_id % 100 = 0")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page, repeated rows too. A null url has empty host and path and no rule. An empty table gives no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, [*url_filter.SITE_RULES, *url_filter.PATTERN_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, repeated rows too. A null or empty page has an empty text. An empty table gives no rows."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that one of smaller id holds. A null text has one empty line; rows of one id count as one document. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", line_dedup.sha256_hex(F.col("text")).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences. A null or empty text is its end id; repeated rows are documents of their own. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, repeated rows alike. A null text counts as empty; a null doc_id is not held out. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    held = docs.select("doc_id", "text", quality.held_out(F.col("doc_id")).alias("held_out"))
    return quality.score(held, model).select("doc_id", "held_out", "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document, repeated rows alike: und where a text is null or has no letter. A null doc_id is not held out. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    held = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.predict(held, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, repeated rows alike. A null text counts as empty. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encoded(docs, tokenizer("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_ngram_join, op3_exact_topk, op4_url_filter, op5_html_extraction, op6_line_dedup, op7_packing, op8_quality_classifier, op9_language_id, op10_bpe)}

_SITES = ", ".join(f"('{r.text}', '{r.verdict}', '{r.text.split('/', 1)[0]}', '/{r.text.split('/', 1)[1]}')" for r in url_filter.SITE_RULES)
_BLOCKED = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in url_filter.PATTERN_RULES)

ORACLES = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
 c AS (SELECT min(doc_id) AS rep, list(doc_id) AS docs, count(*) AS copies, g FROM (SELECT doc_id, list_sort(g) AS g FROM g) GROUP BY g),
 e AS (SELECT rep, unnest(g) AS gram FROM c),
 n AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM e a JOIN e b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY ALL),
 l AS (SELECT a, b FROM n JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 9 * i >= 4 * (len(x.g) + len(y.g))),
 r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 k AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a),
 d AS (SELECT l.a AS rep, sum(y.copies) AS links FROM l JOIN c y ON y.rep = l.b GROUP BY l.a)
SELECT unnest(docs) AS doc_id, class_id, (copies - 1 + coalesce(links, 0))::BIGINT AS n_links, c.rep AS copy_of FROM c JOIN k USING (rep) LEFT JOIN d USING (rep)""",
    "op3_exact_topk": """
WITH x AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM x q JOIN x c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
 keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
 firsts AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k),
 marked AS (SELECT doc_id, line, pos, coalesce(f < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op4_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
 raw AS (SELECT page_id, tail, regexp_extract(tail, '^[^/?#]*') AS raw_host FROM cut),
 parts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(substr(tail, length(raw_host) + 1), '^[^?#]*') AS path FROM raw),
 rules(rule, verdict, rule_host, rule_path) AS (VALUES {_SITES}),
 best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules
   ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)"""
}
