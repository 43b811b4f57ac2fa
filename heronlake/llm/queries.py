"""The registered queries of this subpackage and their SQL. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import alignment, bitplane, htmlcrf, jaccard, kdtree, langid, linewinnow, negatives, packing, suffixtree, templates, transducer, warc
from heronlake.llm.common import read_table
from heronlake.llm.tokens import tokenizer_path


def op1_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.token_files_digest(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op2_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kdtree.quantised(read_table(spark, sf_dir, "embeddings"))
    return kdtree.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(read_table(spark, sf_dir, "documents"))


def op5_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=8, cover=0.5)


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"), declared="lang", host="source").drop("row_hash")


def language_fusion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evidence for raw pages: markup language, address suffix, host."""
    rows = langid.page_rows(read_table(spark, sf_dir, "pages"))
    return langid.identify(rows, declared="declared", host="host", suffix="suffix", label="declared").drop("row_hash").withColumnRenamed("doc_id", "page_id")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(read_table(spark, sf_dir, "documents"), size=5, num=80, den=100)


def op9_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return linewinnow.dedup_lines(docs, min_words=50, gram_words=25, removed="lines_removed").select("doc_id", "lines_removed", "text")


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op11_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.main_text(read_table(spark, sf_dir, "pages"))


def op13_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.prepared(read_table(spark, sf_dir, "embeddings"), label)
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (op1_bitplane_tokens, op2_kdtree_topk, op3_best_fit_packing, op4_suffix_tree_scores, op5_transducer_counts, op6_template_decontamination, op7_language_fusion, language_fusion_pages, op8_ngram_jaccard, op9_winnow_lines, op10_warc_bundles, op11_diagonal_alignment, op12_crf_main_text, op13_segment_negatives)}

ORACLE_SQL = {
    "op2_kdtree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_warc_bundles": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.url, d.payload_bytes, d.payload_digest, true AS intact,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
""",
    "op13_segment_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
}
